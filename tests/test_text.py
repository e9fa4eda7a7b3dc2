import random
import re
import sys

from pyspark.sql import functions as F

from winnow.functions import text as X


def column(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("out", expression(F.col("t")))
    return [r.out for r in df.orderBy("i").collect()]


def test_whitespace_matches_the_runtime(spark):
    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (c < 0x3100 or c % 997 == 0)]
    texts = [f" a{c}{c}b{c}" for c in points]
    want = [re.sub(r"\s+", " ", t).strip() for t in texts]
    assert column(spark, texts, X.normalize_ws) == want


def test_line_breaks_match_the_runtime(spark):
    points = [chr(c) for c in range(1, 0x3100)]
    texts = [f"a{c}b{c}" for c in points] + ["", "\n", "a\r\nb", "a\n\nb", "\r\n\r\n"]
    assert column(spark, texts, X.text_lines) == [t.splitlines() for t in texts]


NUMBERED = [
    ("", 3, "3 | "),
    ("only", 9, "9 | only"),
    ("one\ntwo\n", 9, " 9 | one\n10 | two"),
    ("\n\n", 99, " 99 | \n100 | "),
    ("  4 | looks numbered\n\n\tx", 1, "1 |   4 | looks numbered\n2 | \n3 | \tx"),
    ("a\rb", 100, "100 | a\n101 | b"),
]

STRIPPED = [
    (" 9 | one\n10 | two", "one\ntwo"),
    ("12|x\n13 |  y", "x\n y"),
    ("no number | here\n7 no bar", "no number | here\n7 no bar"),
    ("\n\n 5 |\tz", "z"),
    (" ٣ | arabic digit", "arabic digit"),
]


def test_numbered_lines(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(NUMBERED)], "i int, t string, n int")
    out = df.withColumn("out", X.numbered(X.text_lines(F.col("t")), F.col("n"))).orderBy("i").collect()
    assert [r.out for r in out] == [want for *_, want in NUMBERED]


def test_numbers_come_off_again(spark):
    assert column(spark, [t for t, _ in STRIPPED], X.strip_line_prefixes) == [want for _, want in STRIPPED]


# version, rule, path, match, function, and the first 16 digits of the SHA-256 of the normalized parts
KEYS = [
    ("7", "sql.concat", "db/orders.py", 'run("a" + b)', 'def add(b):\n    run("a" + b)', "50eb9b69767168cb"),
    ("7", "sql.concat", "db/orders.py", '  run("a"\t+ b)\n', 'def add(b):\r\n\trun("a" + b)', "50eb9b69767168cb"),
    ("7", "sql.format", "db/orders.py", 'run("a" + b)', 'def add(b): run("a" + b)', "5db5f11c4c8db1e2"),
    ("8", "sql.concat", "db/orders.py", 'run("a" + b)', 'def add(b): run("a" + b)', "c6038454a3b7ae08"),
    ("7", "sql.concat", "db/items.py", 'run("a" + b)', None, "faa35393c2f1acaf"),
    ("7", "größe", "é/λ.py", "\xa0x\u3000y", " \n", "68713cc6744d7576"),
]


def fingerprints(spark, rows):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, v string, r string, p string, m string, f string")
    out = df.withColumn("out", X.fingerprint(*[F.col(c) for c in "vrpmf"]))
    return [r.out for r in out.orderBy("i").collect()]


def test_fingerprint(spark):
    assert fingerprints(spark, KEYS) == [r[5] for r in KEYS]


def test_random_whitespace_edits_keep_the_fingerprint(spark):
    rng = random.Random(7)
    words = "def f ( x ) : return g ( x )".split()
    rows = []
    for _ in range(60):
        body = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n    "]) for w in words)
        rows.append(("0.1.0", "r", "p", body, body))
    assert len(set(fingerprints(spark, rows))) == 1


def test_whole_texts_are_normalized_alike(spark):
    points = [chr(c) for c in range(1, 0x3100)]
    texts = [f" a{c}{c}b{c}" for c in points] + ["", " ", "\n", "a b", " a\t\n b  c ", None]
    whole = column(spark, texts, X.normalize_texts)
    assert whole == column(spark, texts, X.normalize_ws)
    assert whole[: len(points)] == [" ".join(t.split()) for t in texts[: len(points)]] and whole[-1] is None
    assert column(spark, texts, X.is_blank) == [None if t is None else not t.strip() for t in texts]


def test_fingerprints_take_no_pattern_over_whole_texts(spark):
    df = spark.createDataFrame([tuple("vrpmf")], "v string, r string, p string, m string, f string")
    plan = df.select(X.fingerprint(*[F.col(c) for c in "vrpmf"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
