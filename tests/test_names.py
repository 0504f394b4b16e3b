import random
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pkgrisk.functions.distance import deletion_keys, transposition_distance
from pkgrisk.functions.text import csv_cell, normalize_name, repository, tags
from pkgrisk.operators.resolve import _key_sketch, candidate_names, parse_requests, similar_names, suggest_names
from pkgrisk.session import Scratch


def plain_distance(a: str, b: str) -> int:
    last, far, table = {}, len(a) + len(b), {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        table[i, -1], table[i, 0] = far, i
    for j in range(len(b) + 1):
        table[-1, j], table[0, j] = far, j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, m, cost = last.get(b[j - 1], 0), column, 1
            if a[i - 1] == b[j - 1]:
                cost, column = 0, j
            table[i, j] = min(
                table[i - 1, j - 1] + cost, table[i, j - 1] + 1, table[i - 1, j] + 1,
                table[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1),
            )
        last[a[i - 1]] = i
    return table[len(a), len(b)]


def words(rng, n, size):
    return ["".join(rng.choice("abc") for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_distance_matches_the_definition():
    rng = random.Random(1)
    a, b = words(rng, 2000, 8), words(rng, 2000, 8)
    got = transposition_distance(pd.Series(a), pd.Series(b))
    assert [int(x) for x in got] == [plain_distance(x, y) for x, y in zip(a, b)]
    assert transposition_distance(pd.Series(["ca"]), pd.Series(["abc"]))[0] == 2


def mutated(rng, text):
    chars = list(text)
    for _ in range(rng.randint(0, 5)):
        i, kind = rng.randrange(len(chars)) if chars else 0, rng.randint(0, 3)
        if kind == 0:
            chars.insert(i, rng.choice("abcd"))
        elif kind == 1 and chars:
            chars.pop(i)
        elif kind == 2 and chars:
            chars[i] = rng.choice("abcd")
        elif i + 1 < len(chars):
            chars[i], chars[i + 1] = chars[i + 1], chars[i]
    return "".join(chars) or "a"


def test_candidate_join_loses_nothing(spark):
    rng = random.Random(2)
    base = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 22))) for _ in range(120)}
    wanted = {mutated(rng, x) for x in sorted(base) for _ in range(4)}
    offered = base | {mutated(rng, x) for x in sorted(base)}
    expected = {
        (a, b) for a in wanted if len(a) >= 5 for b in offered
        if 1 - plain_distance(a, b) / max(len(a), len(b)) >= 0.8
    }
    rows = similar_names(
        spark.createDataFrame([(x,) for x in wanted], "name string"),
        spark.createDataFrame([(x,) for x in offered], "name string"),
    ).collect()
    assert {(r.wanted, r.offered) for r in rows} == expected


def test_a_common_prefix_makes_no_crowd(spark):
    rng = random.Random(3)

    def names(n):
        return spark.createDataFrame([("lib" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)),) for _ in range(n)], "name string")

    assert candidate_names(names(100), names(20_000)).count() < 100 * 20_000 * 0.02


def test_names_of_few_syllables_make_no_crowd(spark):
    rng = random.Random(4)
    syllables = [a + b for a in "bdgklmnprst" for b in "aeio"]

    def names(n):
        return spark.createDataFrame([("".join(rng.choice(syllables) for _ in range(5)),) for _ in range(n)], "name string")

    # Pieces of two letters, as many as six to a name, were shared by 4 % of all pairs.
    assert candidate_names(names(200), names(20_000)).count() < 200 * 20_000 * 0.001


def test_remainders_of_a_name_are_listed_once(spark):
    df = spark.createDataFrame([("a" * 12,), ("a" * 24,), ("-----",), ("é" * 10,), (None,)], "name string")
    rows = {(r.wanted, r.offered): r.score for r in similar_names(df, df).collect()}
    assert rows == {(x, x): 1.0 for x in ("a" * 12, "a" * 24, "-----", "é" * 10)}
    keys = [k for b in deletion_keys(iter([pa.RecordBatch.from_pydict({"w": ["a" * 24]})])) for k in b.column(0).to_pylist()]
    assert len(keys) == 1


def test_keys_that_the_other_side_cannot_have_are_left_out(spark):
    def keys(name, held=None):
        return [k for b in deletion_keys(iter([pa.RecordBatch.from_pydict({"w": [name]})]), held) for k in b.column(0).to_pylist()]

    df = spark.createDataFrame([("tokioruntime", "tokioruntime")], "wanted string, w string")
    held = _key_sketch(df, "w").value
    assert keys("tokioruntime", held) == keys("tokioruntime")
    shared = set(keys("tokioruntime")) & set(keys("tokiorumtine"))
    assert shared and shared <= set(keys("tokiorumtine", held)) and len(keys("tokiorumtine", held)) < len(keys("tokiorumtine"))
    assert len(keys("serde-derives", held)) < 5


def test_long_names_meet_by_pieces(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(n)) for n in (19, 20, 23, 24, 25, 26, 29, 30, 40) for _ in range(8)]
    wanted = {mutated(rng, x) for x in base for _ in range(3)}
    rows = similar_names(
        spark.createDataFrame([(x,) for x in wanted], "name string"), spark.createDataFrame([(x,) for x in set(base)], "name string")
    ).collect()
    expected = {(a, b) for a in wanted for b in base if 1 - plain_distance(a, b) / max(len(a), len(b)) >= 0.8}
    assert {(r.wanted, r.offered) for r in rows} == expected


def test_distance_is_computed_once(spark):
    df = spark.createDataFrame([("serde",), ("tokio",)], "name string")
    plan = similar_names(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 and plan.split("Initial Plan")[0].count("ArrowEvalPython") == 1


def test_names_and_their_keys_are_never_broadcast(spark, monkeypatch):
    """Keys are estimated by the names, and names by their compressed file."""
    df, frames, save = spark.createDataFrame([("serde",), ("tokio",)], "name string"), [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, frame, name: frames.append(frame) or save(self, frame, name))
    frames += [suggest_names(df, df, df), candidate_names(df, df)]
    plans = "".join(f._jdf.queryExecution().executedPlan().toString() for f in frames)
    joins = re.findall(r"(SortMerge|BroadcastHash)Join(?:\(skew=\w+\))? \[(key|w|o|name)#\d+L?\], ", plans)
    assert {key for _, key in joins} == {"key", "w", "o", "name"} and {kind for kind, _ in joins} == {"SortMerge"}


def test_suggestions(spark):
    crates = spark.createDataFrame([("serde",), ("serde-json",), ("serde_derive",), ("tokio",)], "name string")
    missing = spark.createDataFrame([("serdee",), ("serdejson",), ("abcd",)], "name string")
    got = {r.name: r.suggestions for r in suggest_names(missing, crates).collect()}
    assert got == {"serdee": ["serde"], "serdejson": ["serde-json"]}
    asked = spark.createDataFrame([("serde",)], "name string")
    assert "serdee" not in {r.name for r in suggest_names(missing, crates, asked).collect()}


def test_normalized_name(spark):
    row = spark.createDataFrame([("Foo-Bar_baz qux",)], "n string").select(normalize_name(F.col("n")).alias("n")).head()
    assert row.n == "foobarbazqux"


def test_requests(spark):
    df = spark.createDataFrame([("a",), ("a@1.2.3",), ("a@1",), ("a@1.0.0@2",)], "request string")
    rows = parse_requests(df).collect()
    assert [(r.name, r.version, r.error is None) for r in rows] == [
        ("a", None, True), ("a", "1.2.3", True), ("a", None, False), ("a", None, False),
    ]


def test_repositories(spark):
    cases = {
        "https://github.com/serde-rs/serde.git": "https://github.com/serde-rs/serde",
        "https://github.com/tokio-rs/tokio/tree/master/tokio-util": "https://github.com/tokio-rs/tokio",
        "https://github.com/a/b.git.git": "https://github.com/a/b",
        "https://github.com/onlyowner": None,
        "https://github.com//b": None,
        "not a url": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string")
    assert df.filter(~repository(F.col("u"))["url"].eqNullSafe(F.col("want"))).collect() == []


def test_small_texts(spark):
    df = spark.createDataFrame([("rust, cli,tool", 'a "b", c', "plain")], "t string, q string, p string")
    row = df.select(tags(F.col("t")).alias("t"), csv_cell(F.col("q")).alias("q"), csv_cell(F.col("p")).alias("p")).head()
    assert row.t == "#rust, #cli, #tool"
    assert row.q == '"a ""b"", c"'
    assert row.p == "plain"
