"""One thin query for each operator, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgrisk.llm import (
    decontaminate, divergence, filter_audit, fingerprint, html_text, jaccard_join, license_scan, line_dedup, piece_lattice, quality,
    record_files, token_count, toxicity,
)
from pkgrisk.llm.vocabulary import model_path
from pkgrisk.session import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUALITY_CUT = 0.3
TOXIC_CUT = 0.7
TOKEN_LIMIT = 4096
RECORD_END = 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _remainder(n: int) -> F.Column:
    return F.expr(f"crc32(cast(doc_id as string)) % {n}")


# Shared SQL: A-Z to a-z, and the words of a text.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query()
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document; SQL cannot run a tokenizer, tests compare with the library."""
    counted = token_count.with_token_counts(table(spark, folder, "documents").select("doc_id", "text"), model_path(), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


_OP7 = f"""
WITH items AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, w[i:i + 9] AS win, len(w[i:i + 9]) AS n
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) AS u(pos) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@_query(_OP7)
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in ten-word windows of benchmark items."""
    hits = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontaminate.hit_report(hits)


@_query()
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of every document, learnt from labels outside the held-out fifth."""
    docs, held_out = table(spark, folder, "documents"), _remainder(5) == 0
    rows = quality.train_rows(docs, table(spark, folder, "labels"), "quality", ~held_out)
    scored = quality.with_quality(docs.select("doc_id", "text"), quality.fit(rows), name="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


_OP9 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
kept AS (SELECT doc_id, pos, line, first IS NULL OR first = doc_id AS keep FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT keep))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


@_query(_OP9)
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document without those that a smaller doc_id holds."""
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query()
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, without the recurring subtrees of its host."""
    pages = html_text.extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query()
def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every document, of its edited text, and how alike they and the next document's are."""
    docs = table(spark, folder, "documents")
    return fingerprint.compare_with_next(docs, fingerprint.corpus_rarity(docs))


def _values() -> str:
    rows = [(label, text, "true") for label, text in license_scan.PHRASES] + [(label, text, "false") for label, text in license_scan.NOTICES]
    return ", ".join(f"({n}, '{label}', '{text}', {base})" for n, (label, text, base) in enumerate(rows, 1))


_OP6 = f"""
WITH templates AS (SELECT template, label, base, {_WORDS.format('text')} AS w FROM (VALUES {_values()}) AS t(template, label, text, base)),
known AS (SELECT template, label, base, len(w) - 1 AS pairs, j, w[j] AS w1, w[j + 1] AS w2 FROM templates, unnest(range(1, len(w))) AS u(j)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
pairs AS (SELECT r, i, w[i] AS w1, w[i + 1] AS w2 FROM docs, unnest(range(1, len(w))) AS u(i)),
votes AS (SELECT r, template, label, base, pairs, i - j AS d, count(*) AS v, bit_or(1::BIGINT << j::INT) AS places
  FROM pairs JOIN known USING (w1, w2) GROUP BY ALL),
phrases AS (SELECT r, label, true AS base, d AS start, 1.0::DOUBLE AS c FROM votes WHERE base AND v = pairs),
near AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, template ORDER BY d) <= {license_scan.NEAR} THEN 0 ELSE 1 END AS o
  FROM votes WHERE NOT base AND v >= {license_scan.MIN_VOTES}),
grouped AS (SELECT *, sum(o) OVER (PARTITION BY r, template ORDER BY d) AS g FROM near),
notices AS (SELECT r, label, false AS base, NULL AS start, bit_count(bit_or(places)) / any_value(pairs)::DOUBLE AS c FROM grouped GROUP BY r, template, label, g),
spans AS (SELECT * FROM phrases UNION ALL SELECT * FROM notices),
report AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (c >= {license_scan.COVERAGE}) AS labels, max(c) AS score FROM spans GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN report USING (r)
"""


@_query(_OP6)
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.license_report(license_scan.license_spans(table(spark, folder, "documents")))


@_query()
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document, at a similarity of 0.8 on five-word shingles."""
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


@_query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of every document, learnt from labels outside the held-out third."""
    docs, held_out = table(spark, folder, "documents"), _remainder(3) == 1
    rows = toxicity.train_rows(docs, table(spark, folder, "labels"), "toxic", ~held_out)
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), toxicity.fit(rows), name="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"))


@_query()
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Piece ids of every document, and the digest of the text that they decode to."""
    model = model_path()
    encoded = piece_lattice.encode(table(spark, folder, "documents").select("doc_id", "text"), model)
    return encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(piece_lattice.decode(F.col("ids"), model), 256).alias("decoded_sha256")
    )


@_query()
def op11_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, read back from the record files they were written to; tests compare with the library."""
    path = Scratch(spark, "token-records").path
    record_files.write_records(table(spark, folder, "documents"), path, model_path("word_bpe_49k.json"), RECORD_END)
    read = record_files.read_records(spark, path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


_OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format('text')} AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(c.n) AS total FROM counts c JOIN kept USING (lang, term) GROUP BY lang, source),
groups AS (SELECT lang, source, coalesce(t.total, 0) AS total, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals t USING (lang, source) LEFT JOIN langs l USING (lang)),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({divergence.UNIT} * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p,
    1 + ({divergence.UNIT} * (k.n + 1)) // (g.lang_total + g.v) AS whole
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - whole) * (p - whole)) // whole)::BIGINT FROM shares WHERE n > 0 AND p > whole),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


@_query(_OP12)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergences of the sources of each language, and the terms that set each source apart."""
    return divergence.source_divergence(table(spark, folder, "documents"))


_OP13 = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts JOIN firsts USING (t)),
marked AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, (len(w) < {filter_audit.MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {filter_audit.MIN_DISTINCT_PERCENT} * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {filter_audit.MAX_CAPITAL_PERCENT} * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marked USING (doc_id)),
counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
letters AS (SELECT 'ABCDE'[i:i] AS l, (1 << (i - 1))::INT AS bit FROM unnest(range(1, 6)) AS u(i)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS seen FROM orders, unnest(range(1, 6)) AS u(k)),
audit AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (seen | bit) = 0) AS kept, sum(n) FILTER (mask & seen = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (mask & bit <> 0 AND mask & seen <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(n) FILTER (mask & seen = 0 AND mask & bit <> 0 AND good) AS good_lost, sum(n) FILTER (mask & seen = 0 AND mask & bit <> 0 AND toxic) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM audit
"""


@_query(_OP13)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove in every order, by source."""
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
