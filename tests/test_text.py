"""Text annotators on odd texts, and how their work grows with a text."""

import sys

from pyspark.sql import functions as F

from riskloom.functions import text as TX
from riskloom.operators.textops import enrich_articles

TEXTS = ["", " ", "\n\t　\x1c", "profit", "  Profit and LOSS,\x1floss growth\x85crisis  ", "a b​c \U0001f600 d᠎e",
         "x " * 40 + "upgrade", "risk\n", None, "Été Straße İK strong"]


def brute(text):
    if text is None:
        return None, 0.0
    n, low = len(text.split()), text.lower()
    net = sum(w in low for w in TX.SENTIMENT_POSITIVE) - sum(w in low for w in TX.SENTIMENT_NEGATIVE)
    return n, min(max(5.0 * net / max(n, 10), -1.0), 1.0)


def test_whitespace_class_is_pythons(spark):
    points = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["".join(map(chr, points[i:i + 4096])) for i in range(0, len(points), 4096)]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(
        *[F.regexp_extract_all("t", F.lit(c), F.lit(0)).alias(n) for c, n in ((TX.WS, "ws"), (TX.NOT_WS + "+", "other"))]).collect()
    assert sorted("".join("".join(r.ws) for r in both)) == sorted(TX.WHITESPACE_CHARS)
    assert sum(len(s) for r in both for s in r.other) == len(points) - len(TX.WHITESPACE_CHARS)


def test_word_count_and_score_against_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    c = F.col("t")
    got = {r.id: r for r in df.select("id", TX.word_count(c).alias("n"), TX.sentiment_score(c).alias("s"),
                                      TX.is_blank(c).alias("blank")).collect()}
    for i, t in enumerate(TEXTS):
        n, s = brute(t)
        assert got[i].n == n and abs(got[i].s - s) < 1e-12 and got[i].blank == (not (t or "").strip())


def test_long_texts_take_one_cheap_scan(spark, capfd):
    """No class that lists its members (a microsecond a character) and the text
    lower-cased once, not once a keyword."""
    a = spark.createDataFrame([(1, "s", "t.", "d", "x")], "doc_id long, ticker string, title string, description string, content string")
    enrich_articles(a.repartition(2)).explain()
    plan = capfd.readouterr().out
    assert TX.WS_CLASS not in plan and TX.WS_CLASS[1:-1] not in plan
    assert plan.count("lower(content") == 1


def test_runs_of_whitespace_are_scanned_in_linear_time(spark):
    import time
    df = spark.range(1).select(F.concat(F.repeat(F.lit(" "), 400000), F.lit("end")).alias("t")).repartition(1)
    start = time.time()
    assert df.select(TX.word_count(F.col("t"))).first()[0] == 1
    assert time.time() - start < 20
