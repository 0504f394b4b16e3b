from pyspark.sql import functions as F

from pkgrisk.functions.source_text import line_statistics, statistics
from pkgrisk.operators.codebase import source_files, source_stats
from pkgrisk.plans.shadow import SNIPPETS, Shadow

CASES = [
    ("", (0, 0, 0, 0, False)),
    ("\n  \n\n", (0, 0, 0, 0, False)),
    ("fn main() {\n    let x = 1;\n\n    // c\n    println!(\"{}\", x);\n}\n", (5, 0, 1, 0, False)),
    ("#[test]\nfn t() {\n    assert!(true);\n}\n", (0, 4, 0, 0, False)),
    (
        "#[cfg(test)]\nmod tests {\n    use super::*;\n    #[test]\n    fn t() {\n        assert!(true);\n    }\n}\n",
        (0, 7, 0, 0, False),
    ),
    ("mod a;\npub mod b;\nuse x::y;\n", (1, 0, 0, 0, False)),
    (
        "unsafe fn a() {}\nfn b() { unsafe { } }\nunsafe impl S for T {}\nunsafe trait Q {}\n"
        "unsafe extern \"C\" fn z() {}\nunsafe extern \"C\" { }\ntype F = unsafe fn(i32);\n",
        (7, 0, 0, 5, False),
    ),
    ("/* a\n b\n*/\n\n/// doc\nstruct X;\n// free\n\nfn q() { /* { */ }\n", (3, 0, 6, 0, False)),
    ("fn broken( {\n", (1, 0, 0, 0, True)),
    ("}}}} garbage", (1, 0, 0, 0, True)),
    ("fn a() {\n let s = \"}\n\n {\";\n}\nfn b() {}\n", (5, 0, 0, 0, False)),
    ("impl X {\n  #[test]\n  fn t() {\n  }\n  fn p() {}\n}\n", (6, 3, 0, 0, False)),
    ("//! inner\n\n#[derive(Debug)]\npub struct A {\n  b: u8,\n}\n", (4, 0, 1, 0, False)),
    ("#[cfg(test)]\nuse a::b;\nfn x() {}\n", (3, 0, 0, 0, False)),
    ("pub(crate) const fn x(a: [u8; 4]) -> u8 {\n a[0]\n}\n", (3, 0, 0, 0, False)),
    ("fn c<'a>(x: &'a str) -> char { '{' }\nfn d() { let c = '\\''; }\n", (2, 0, 0, 0, False)),
    ("let r = r#\"a \" {{ \"#;\n", (1, 0, 0, 0, False)),
]


MORE = [
    ("/* a /* b */ c */\nfn x() {}\n", (2, 0, 1, 0, False)),
    ("/* never closed\nfn x() {}\n", (2, 0, 0, 0, False)),
    ("fn f() {\n    let r = r##\"a \"# /* { \"##;\n    /* one\n\n    /* two */ */ g();\n}\n", (5, 0, 3, 0, False)),
    ("#[cfg(\n    test\n)]\nmod tests {\n    fn t() {}\n}\n", (0, 3, 0, 0, False)),
    ("fn f() {\n    #[cfg(test)]\n    {\n        g();\n    }\n}\n", (6, 0, 0, 0, False)),
    ("unsafe impl Send for A {}\nunsafe extern \"C\" fn e() {}\nfn f() { unsafe { g() } }\n", (3, 0, 0, 3, False)),
    ("", (0, 0, 0, 0, False)), ("\n \n\t\n", (0, 0, 0, 0, False)), ("fn f( {\n", (1, 0, 0, 0, True)),
]


def test_more_texts():
    for text, expected in MORE:
        assert statistics(text) == expected, text


def test_no_text(spark):
    assert spark.createDataFrame([(None,)], "c string").select(line_statistics(F.col("c")).alias("s")).head().s is None


def test_line_statistics(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    for row in df.select("i", line_statistics(F.col("c")).alias("s")).collect():
        assert tuple(row.s) == CASES[row.i][1], CASES[row.i][0]


FILES = [
    ("src/a.rs", 10), ("src/x/b.rs", 10), ("src/big.rs", 5_000_001), ("src/limit.rs", 5_000_000),
    ("tests/c.rs", 10), ("src/d.txt", 10), ("src/.rs", 10), ("src/" + "d/" * 50 + "e.rs", 10),
]


def test_source_file_selection(spark):
    df = spark.createDataFrame([("p", p, n) for p, n in FILES], "package string, path string, length bigint")
    deep = "src/" + "d/" * 50 + "e.rs"
    assert {r.path for r in source_files(df).collect()} == {"src/a.rs", "src/x/b.rs", "src/limit.rs", "src/big.rs", deep}


def test_package_sums(spark):
    df = spark.createDataFrame([("p", c) for c, _ in CASES], "package string, content string")
    row = source_stats(df).head()
    assert row.source_files == len(CASES)
    assert row.production_lines == sum(c[1][0] for c in CASES)
    assert row.source_files_with_errors == 2


def test_words_and_brackets_on_a_line_count_it_once():
    text = "#[test]\nfn t() {\n    a(1, [2]);\n\n    b; c\n}\nfn f() {\n    d(\n        e)\n}\n"
    assert statistics(text) == (4, 5, 0, 0, False)
    assert statistics("fn f() {\n    a)\n}\n")[4]


def test_files_are_shuffled_as_line_numbers(spark, tmp_path):
    lines = [(1, 3), (1, 1), (1, 1), (2, None), (97, 2), (97, None), (97, 12), (11, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = Shadow(spark, str(tmp_path)).source_files
    assert {r.path: r.content for r in files.collect()} == {
        "src/f1.rs": SNIPPETS[1] * 2 + SNIPPETS[3], "src/f2.rs": "", "src/f97.rs": SNIPPETS[2] + SNIPPETS[0] + "fn bad( {\n", "tests/f11.rs": SNIPPETS[5],
    }
    below = files._jdf.queryExecution().sparkPlan().toString().split("partial_collect_list")[1]
    assert SNIPPETS[1] not in below


def test_line_statistics_of_missing_texts(spark):
    df = spark.createDataFrame([(0, "fn a() {}\n"), (1, None), (2, "}")], "i int, c string").coalesce(1)
    rows = {r.i: r.s for r in df.select("i", line_statistics(F.col("c")).alias("s")).collect()}
    assert (tuple(rows[0]), rows[1], tuple(rows[2])) == ((1, 0, 0, 0, False), None, (1, 0, 0, 0, True))
    assert df.limit(0).select(line_statistics(F.col("c")).alias("s")).collect() == []
