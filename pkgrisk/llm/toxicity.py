"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (for words of the training sample) beside the mean embedding of its character n-grams, so unseen
words are read by their characters.  The network reads windows of WINDOW words, STRIDE apart, to the end of the text; attention pools
the states of a window into one logit.  A document's logit is the mean of its windows' logits under their own softmax, close to the
largest one, and a logistic curve fitted to documents left out of the training turns it into a score.

The fit sees a bounded sample of labelled rows (``Settings.fit_docs``); every row is scored as a whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgrisk.llm.quality import logistic, train_rows
from pkgrisk.llm.text import words_of

__all__ = ["Settings", "Network", "fit", "train_rows", "with_toxicity"]

WINDOW = 32
STRIDE = 24
# Rows of word inputs that a worker keeps, and windows it reads at once; only speed and memory depend on them.
KEPT_WORDS = 150_000
WINDOWS_AT_ONCE = 2048
NO_WORDS = -8.0


@dataclass(frozen=True)
class Settings:
    fit_docs: int = 3000  # bound of the training sample; each class gives at most half
    longest_fit: int = 120_000  # code points of a document that the fit may use
    vocabulary: int = 4096  # words with an embedding of their own, by documents of the sample
    gram_rows: int = 1 << 13
    grams: tuple[int, ...] = (3, 4)
    starts: tuple[int, ...] = (3, 4, 5, 6)  # sizes of the n-grams at a word's start, which have a mean of their own
    word_size: int = 8
    gram_size: int = 6
    hidden: int = 8
    attention: int = 8
    epochs: int = 5
    batch_docs: int = 32
    rate: float = 0.01
    seed: int = 11


def gram_rows(words: list[bytes], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the gram table, and the word of each: for all character n-grams, and for those at the start of a word."""
    joined = np.frombuffer(b"\x01" + b"\x02\x01".join(words) + b"\x02", np.uint8).astype(np.uint64)
    owner = np.concatenate(([0], np.cumsum(joined == 2)))[:-1]
    out = []
    for sizes, at_start in ((settings.grams, False), (settings.starts, True)):
        rows, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in sizes:
            size = len(joined) - n + 1
            if size < 1:
                continue
            at = np.flatnonzero((owner[:size] == owner[n - 1 :]) & ((joined[:size] == 1) if at_start else True))
            code = np.full(len(at), n + 16 * at_start, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + joined[at + k]
                code ^= code >> np.uint64(29)
            rows.append((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % settings.gram_rows)
            of.append(owner[at])
        out.append((np.concatenate(rows), np.concatenate(of)))
    return out


def windows_of(count: int) -> list[tuple[int, int]]:
    """Start and end of the overlapping windows of a text of ``count`` words."""
    if not count:
        return []
    starts = range(0, max(count - WINDOW + STRIDE, 1), STRIDE)
    return [(s, min(s + WINDOW, count)) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and the forward pass."""

    def __init__(self, settings: Settings, vocabulary: list[bytes]):
        s, random = settings, np.random.default_rng(settings.seed)
        self.settings, self.vocabulary = s, {w: i + 1 for i, w in enumerate(vocabulary)}

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        size, h = s.word_size + 2 * s.gram_size, s.hidden
        self.p = {
            "word": normal(len(vocabulary) + 1, s.word_size, scale=0.1), "gram": normal(s.gram_rows, s.gram_size, scale=0.3),
            "attend": normal(2 * h, s.attention, scale=0.3), "attend_b": np.zeros(s.attention, np.float32), "query": normal(s.attention, scale=0.3),
            "out": normal(2 * h, scale=0.3), "out_b": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.p |= {f"x{way}": normal(size, 3 * h, scale=size**-0.5), f"c{way}": np.zeros(3 * h, np.float32), f"u{way}": normal(h, 3 * h, scale=h**-0.5)}
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        parts, read = [self.p["word"][ids]], []
        table = self.p["gram"]
        for rows, of in gram_rows(words, self.settings):
            count = np.bincount(of, minlength=len(words)).clip(1).astype(np.float32)
            sums = np.stack([np.bincount(of, table[rows, k], minlength=len(words)) for k in range(table.shape[1])], 1)
            parts.append((sums / count[:, None]).astype(table.dtype))
            read.append((rows, of, count))
        return np.concatenate(parts, 1), (ids, read)

    def states(self, way: str, projected: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction for ``projected`` of shape (windows, steps, 3 * hidden); words past a window's end leave them."""
        n, steps, width = projected.shape
        size, u = width // 3, self.p[f"u{way}"]
        h, out, kept = np.zeros((n, size), np.float32), np.empty((n, steps, size), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, hu = projected[:, t], h @ u
            gates = _sigmoid(x[:, : 2 * size] + hu[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            new = np.tanh(x[:, 2 * size :] + r * hu[:, 2 * size :])
            m = mask[:, t, None] * (1 - z)
            after = h + m * (new - h)
            if keep:
                kept.append((t, h, z, r, new, hu[:, 2 * size :], mask[:, t, None]))
            out[:, t] = h = after
        return out, kept

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """One logit for each window."""
        hidden = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        score = np.where(mask > 0, hidden @ self.p["query"], -1e9)
        score = np.exp(score - score.max(1, keepdims=True))
        alpha = score / score.sum(1, keepdims=True)
        context = (alpha[:, :, None] * states).sum(1)
        return context @ self.p["out"] + self.p["out_b"][0], (hidden, alpha, context)


def document_logits(logits: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each document's window logits under their softmax, and the weights; NO_WORDS without windows."""
    most = np.full(docs, -np.inf)
    np.maximum.at(most, owner, logits)
    weight = np.exp(logits - most[owner])
    weight /= np.bincount(owner, weight, docs)[owner]
    out = np.bincount(owner, weight * logits, docs)
    return np.where(np.bincount(owner, minlength=docs) > 0, out, NO_WORDS), weight


def _frames(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, and for each window its word numbers, mask and document."""
    seen: dict[bytes, int] = {}
    places, owner, sizes = [], [], []
    for d, words in enumerate(texts):
        ids = [seen.setdefault(w, len(seen)) for w in words]
        for a, b in windows_of(len(ids)):
            places.append(ids[a:b] + [0] * (WINDOW - b + a))
            owner.append(d)
            sizes.append(b - a)
    mask = (np.arange(WINDOW)[None, :] < np.array(sizes, np.int64).reshape(-1, 1)).astype(np.float32)
    return list(seen), np.array(places, np.int64).reshape(-1, WINDOW), mask, np.array(owner, np.int64)


def gradients(net: Network, texts: list[list[bytes]], y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Gradient and value of the mean logistic loss over documents; every text has a word."""
    words, places, mask, owner = _frames(texts)
    inputs, (ids, read) = net.inputs(words)
    x = inputs[places]
    sides = {w: net.states(w, x @ net.p[f"x{w}"] + net.p[f"c{w}"], mask, True) for w in ("f", "b")}
    states = np.concatenate((sides["f"][0], sides["b"][0]), 2)
    logits, (hidden, alpha, context) = net.pool(states, mask)
    total, weight = document_logits(logits, owner, len(texts))
    p = _sigmoid(total)
    loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -total, total))))
    d = ((p - y) / len(y))[owner] * weight * (1 + logits - total[owner])
    d = d.astype(np.float32)
    g = {"out": context.T @ d, "out_b": np.array([d.sum()], np.float32)}
    d_context = d[:, None] * net.p["out"]
    d_alpha = (states * d_context[:, None, :]).sum(2)
    d_states = alpha[:, :, None] * d_context[:, None, :]
    d_score = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
    d_hidden = d_score[:, :, None] * net.p["query"] * (1 - hidden**2)
    g["query"] = np.einsum("nt,nta->a", d_score, hidden)
    g["attend"] = np.tensordot(states, d_hidden, ((0, 1), (0, 1)))
    g["attend_b"] = d_hidden.sum((0, 1))
    d_states += d_hidden @ net.p["attend"].T
    size = net.settings.hidden
    d_x = np.zeros_like(x)
    for way, part in (("f", d_states[:, :, :size]), ("b", d_states[:, :, size:])):
        u = net.p[f"u{way}"]
        d_u, d_h = np.zeros_like(u), np.zeros((len(x), size), np.float32)
        d_in = np.zeros((*x.shape[:2], 3 * size), np.float32)
        for t, h, z, r, new, hn, m in reversed(sides[way][1]):
            d_h = d_h + part[:, t]
            d_new = d_h * m * (1 - z) * (1 - new**2)
            d_z = d_h * m * (h - new) * z * (1 - z)
            d_r = d_new * hn * r * (1 - r)
            d_in[:, t] = np.concatenate((d_z, d_r, d_new), 1)
            d_hu = np.concatenate((d_z, d_r, d_new * r), 1)
            d_u += h.T @ d_hu
            d_h = d_h * (1 - m * (1 - z)) + d_hu @ u.T
        g[f"u{way}"], g[f"c{way}"] = d_u, d_in.sum((0, 1))
        g[f"x{way}"] = np.tensordot(x, d_in, ((0, 1), (0, 1)))
        d_x += d_in @ net.p[f"x{way}"].T
    flat, at = d_x.reshape(-1, d_x.shape[2]), places.ravel()
    d_inputs = np.stack([np.bincount(at, flat[:, k], len(words)) for k in range(flat.shape[1])], 1)
    s = net.settings
    g["word"] = np.zeros_like(net.p["word"])
    np.add.at(g["word"], ids, d_inputs[:, : s.word_size].astype(np.float32))
    g["word"][0] = 0  # words outside the vocabulary are read by their characters alone
    g["gram"] = np.zeros_like(net.p["gram"])
    for n, (rows, of, count) in enumerate(read):
        at = s.word_size + n * s.gram_size
        per_word = d_inputs[:, at : at + s.gram_size] / count[:, None]
        g["gram"] += np.stack([np.bincount(rows, per_word[of, k], s.gram_rows) for k in range(s.gram_size)], 1).astype(net.p["gram"].dtype)
    return g, loss


def train(texts: list[list[bytes]], y: np.ndarray, settings: Settings) -> Network:
    """Adam over shuffled batches of whole documents."""
    # A word of many documents gets an embedding of its own.
    counts = Counter(w for t in texts for w in set(t))
    net = Network(settings, sorted((w for w, n in counts.items() if n >= 5), key=lambda w: (-counts[w], w))[: settings.vocabulary])
    net.p["word"][0] = 0
    mean, square, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    random = np.random.default_rng(settings.seed)
    for epoch in range(settings.epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), settings.batch_docs):
            chosen = order[at : at + settings.batch_docs]
            g, _ = gradients(net, [texts[i] for i in chosen], y[chosen])
            step += 1
            rate = settings.rate * (1 - epoch / settings.epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 5 / max(norm, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v**2
                net.p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts; word inputs are projected once for both directions and kept."""

    def __init__(self, net: Network):
        self.net = net
        self._row: dict[bytes, int] = {}
        self._kept = np.zeros((KEPT_WORDS, 6 * net.settings.hidden), np.float32)
        # Both directions run as one network of twice the size; columns go gate by gate, forward before backward.
        h, p = net.settings.hidden, net.p
        self._u = np.zeros((2 * h, 6 * h), np.float32)
        for g in range(3):
            self._u[:h, 2 * g * h : (2 * g + 1) * h] = p["uf"][:, g * h : (g + 1) * h]
            self._u[h:, (2 * g + 1) * h : (2 * g + 2) * h] = p["ub"][:, g * h : (g + 1) * h]
        self._x = np.concatenate([p[f"x{w}"][:, g * h : (g + 1) * h] for g in range(3) for w in ("f", "b")], 1)
        self._c = np.concatenate([p[f"c{w}"][g * h : (g + 1) * h] for g in range(3) for w in ("f", "b")])

    def _rows(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self._row.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, r in zip(words, found, strict=True) if r is None))
            if len(self._row) + len(new) > len(self._kept):
                self._row = {}
                new = list(dict.fromkeys(words))
                if len(new) > len(self._kept):
                    self._kept = np.zeros((len(new), self._kept.shape[1]), np.float32)
            x, _ = self.net.inputs(new)
            at = len(self._row)
            self._kept[at : at + len(new)] = x @ self._x + self._c
            self._row.update(zip(new, range(at, at + len(new)), strict=True))
            found = list(map(self._row.__getitem__, words))
        return np.array(found, np.int64)

    def _states(self, x: np.ndarray) -> np.ndarray:
        """States of shape (steps, windows, 2 * hidden) for projected inputs of full windows."""
        h = self.net.settings.hidden
        steps, n, _ = x.shape
        own = x.copy()
        for g in range(3):
            back = slice((2 * g + 1) * h, (2 * g + 2) * h)
            own[:, :, back] = x[::-1, :, back]
        state, out = np.zeros((n, 2 * h), np.float32), np.empty((steps, n, 2 * h), np.float32)
        for t in range(steps):
            hu = state @ self._u
            gates = own[t, :, : 4 * h] + hu[:, : 4 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new = np.tanh(own[t, :, 4 * h :] + gates[:, 2 * h :] * hu[:, 4 * h :])
            state = new + gates[:, : 2 * h] * (state - new)
            out[t, :, :h] = state[:, :h]
            out[steps - 1 - t, :, h:] = state[:, h:]
        return out

    def _pooled(self, states: np.ndarray) -> np.ndarray:
        p = self.net.p
        score = np.tanh(states @ p["attend"] + p["attend_b"]) @ p["query"]
        score = np.exp(score - score.max(0))
        context = np.einsum("tn,tnh->nh", score / score.sum(0), states)
        return context @ p["out"] + p["out_b"][0]

    def window_logits(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.float32)
        # Windows of one length run together, so that a short one takes no more steps than it has words.
        for steps in np.unique(ends - starts):
            chosen = np.flatnonzero(ends - starts == steps)
            for part in np.array_split(chosen, -(-len(chosen) // WINDOWS_AT_ONCE)):
                out[part] = self._pooled(self._states(self._kept[rows[starts[part] + np.arange(steps)[:, None]]]))
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Document logits; texts go together up to WINDOWS_AT_ONCE windows, a longer text in pieces of that size."""
        out, kept, windows = np.empty(len(texts)), [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            kept.append((i, words))
            windows += len(words) // STRIDE + 1
            if windows >= WINDOWS_AT_ONCE or i == len(texts) - 1:
                every = [w for _, own in kept for w in own]
                rows = self._rows(every)
                pairs, owner, at = [], [], 0
                for n, (_, own) in enumerate(kept):
                    found = windows_of(len(own))
                    pairs += [(at + a, at + b) for a, b in found]
                    owner += [n] * len(found)
                    at += len(own)
                spans = np.array(pairs, np.int64).reshape(-1, 2)
                logits = self.window_logits(rows, spans[:, 0], spans[:, 1]).astype(float)
                out[[j for j, _ in kept]] = document_logits(logits, np.array(owner, np.int64), len(kept))[0]
                kept, windows = [], 0
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(np.clip(self.net.slope * self.logits(texts) + self.net.shift, -30, 30))


def fit(rows: DataFrame, settings: Settings = Settings()) -> Network:
    """Trains on ``doc_id, text, y``.  Without rows of both classes the network stays untrained and scores that class's share."""
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    usable = rows.filter(F.length("text") <= settings.longest_fit)
    sample = [r for y, n in ((0, negative), (1, positive)) for r in _some(usable.filter(F.col("y") == y), n, settings)]
    texts = [words_of(r["text"]) for r in sample]
    sample = [(r["doc_id"], t, r["y"]) for r, t in zip(sample, texts, strict=True) if t]
    y = np.array([s[2] for s in sample], np.float64)
    if not (y > 0).any() or not (y < 1).any():
        net = Network(settings, [])
        share = 0.5 if not positive + negative else (positive + 0.5) / (positive + negative + 1)
        net.slope, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    aside = np.array([zlib.crc32(str(s[0]).encode()) % 5 == 2 for s in sample])
    if not all((y[aside] == c).any() and (y[~aside] == c).any() for c in (0, 1)):
        aside = np.zeros(len(y), bool)
    net = train([s[1] for s, a in zip(sample, aside, strict=True) if not a], y[~aside], settings)
    scorer = Scorer(net)
    judged = [s for s, a in zip(sample, aside if aside.any() else ~aside, strict=True) if a]
    of = np.array([s[2] for s in judged])
    logits = scorer.logits([b" ".join(s[1]).decode("utf-8", "surrogatepass") for s in judged])
    weight = np.where(of > 0, positive / max(1, (y > 0).sum()), negative / max(1, (y < 1).sum()))
    net.slope, net.shift = logistic(logits, of > 0, weight)
    return net


def _some(rows: DataFrame, of: int, settings: Settings) -> list:
    """At most half of ``fit_docs`` rows of one class, the first by a hash of the id."""
    most = settings.fit_docs // 2
    if of > most:
        order = F.xxhash64("doc_id", F.lit(settings.seed))
        low = rows.filter(order.bitwiseAND(F.lit(0xFFFFFF)) < int(min(1.0, 1.2 * most / of) * 0x1000000))
        rows = low.orderBy(order, "doc_id", "text").limit(most)
    return rows.orderBy("doc_id", "text").collect()


def with_toxicity(docs: DataFrame, net: Network, text: str | Column = "text", name: str = "toxicity_score") -> DataFrame:
    """All columns and a score from 0 to 1 for each row; null, empty and wordless texts get the score of NO_WORDS."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.array(scorer.scores(batch.to_pylist()), pa.float64())

    return docs.withColumn(name, F.arrow_udf(scores, "double")(F.coalesce(text, F.lit(""))))
