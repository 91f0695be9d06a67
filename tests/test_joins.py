import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import joins as J
from riskloom.operators.joins import asof_nearest_join, longest_substring_join


def d(s):
    return dt.date.fromisoformat(s)


def test_asof_ties_tolerance_unmatched(spark):
    left = spark.createDataFrame([
        ("A", d("2024-01-10"), 1),   # equidistant 01-05 / 01-15 → backward
        ("A", d("2024-02-14"), 2),   # forward 02-15 (1 day) beats backward 01-15
        ("A", d("2024-03-16"), 3),   # nearest 02-15 exactly 30 days → kept
        ("A", d("2024-05-01"), 4),   # nearest 31+ days away → NULL
        ("B", d("2024-01-01"), 5),   # key without right rows → NULL
    ], "ticker string, date date, id int")
    right = spark.createDataFrame([
        ("A", d("2024-01-05"), 10.0), ("A", d("2024-01-15"), 20.0), ("A", d("2024-02-15"), 30.0),
        ("C", d("2024-01-01"), 99.0),
    ], "ticker string, date date, close double")
    out = {r.id: r.close for r in asof_nearest_join(left, right, "ticker", "date", 30, ["close"]).collect()}
    assert out == {1: 10.0, 2: 30.0, 3: 30.0, 4: None, 5: None}


def test_asof_exact_match_and_just_over(spark):
    left = spark.createDataFrame([("A", d("2024-01-08"), 1), ("A", d("2024-01-20"), 2)], "ticker string, date date, id int")
    right = spark.createDataFrame([("A", d("2024-01-08"), 1.0), ("A", d("2024-01-12"), 2.0)], "ticker string, date date, v double")
    out = {r.id: r.v for r in asof_nearest_join(left, right, "ticker", "date", 7, ["v"]).collect()}
    assert out == {1: 1.0, 2: None}  # 01-20 is 8 days after 01-12


def test_longest_substring(spark):
    names = spark.createDataFrame([("BURO_AMT_CREDIT_SUM_MEAN",), ("NEW_THING",)], "name string")
    dic = spark.createDataFrame([("AMT_CREDIT", 0), ("AMT_CREDIT_SUM", 1), ("AMT", 2)], "entry string, ord int")
    out = {r.name: r.matched for r in longest_substring_join(names, "name", dic, "entry", "ord").collect()}
    assert out == {"BURO_AMT_CREDIT_SUM_MEAN": "AMT_CREDIT_SUM", "NEW_THING": "_new_col"}


def test_longest_substring_across_chunk_boundary(spark):
    # a long name: the best entry starts a few characters before position 256
    name = "x" * 250 + "boundaryword" + "y" * 400
    names = spark.createDataFrame([(name,), ("yyy",), ("",)], "name string")
    dic = spark.createDataFrame([("boundaryword", 1), ("boundary", 0), ("yyyy", 2), ("zz", 3)], "entry string, ord int")
    out = {r.name: r.matched for r in longest_substring_join(names, "name", dic, "entry", "ord").collect()}
    assert out == {name: "boundaryword", "yyy": "_new_col", "": "_new_col"}


def test_longest_word_of_whole_texts(spark, tmp_path):
    from riskloom.plans.registry import queries
    texts = {1: "Nothing here. But later: the überzeugend word", 2: "plain", 3: "", 4: None, 5: "ab. xhelloY",
             6: "x" * 9000 + " hello " + "ü" * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("Hello über! PLAIN zeugen ab",), ("zeug",), (None,)], "text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.doc_id: r.matched for r in queries()["longest_substring_join"](spark, str(tmp_path)).collect()}
    assert got == {1: "zeugen", 2: "plain", 3: "_new_col", 4: "_new_col", 5: "hello", 6: "hello"} | {
        1: max((e for e in ("hello", "über", "plain", "zeugen", "zeug") if e in texts[1].lower()), key=len)}


def test_longest_substring_of_least_length(spark):
    names = spark.createDataFrame([("credit_sum", 6), ("amt_credit", 7), ("sum", 1)], "name string, least int")
    dic = spark.createDataFrame([("credit", 0), ("sum", 1), ("amt", 2), ("sum", 3)], "entry string, ord int")
    got = {r.name: r.matched for r in longest_substring_join(names, "name", dic, "entry", "ord", least_col="least").collect()}
    assert got == {"credit_sum": "credit", "amt_credit": "_new_col", "sum": "sum"}


def _recorded(monkeypatch):
    """The names that the substring join is given from now on."""
    searched, search = [], J.longest_substring_join
    monkeypatch.setattr(J, "longest_substring_join", lambda names, *a, **k: (
        searched.extend(r[0] for r in names.select("word").collect()), search(names, *a, **k))[1])
    return searched


@pytest.mark.parametrize("keys", [0, 2_000_000])
def test_longest_entries_of_texts(spark, monkeypatch, keys):
    """Every key gets its longest entry, also where it is not in one of the
    longest words, is tied, or lies in another row of the key."""
    monkeypatch.setattr(J, "BROADCAST_KEYS", keys)
    entries = ["abc", "abd", "planet", "harbour", "zebra"]
    junk = [c * n for c, n in zip("qwxvjkyfg", range(20, 29))]   # nine long words that hold no entry
    texts = [(1, ["abc", "abd", "xplanetx"]), (2, ["abd", "abc"]), (3, [*junk, "harbour", "planets", "zebra"]), (4, junk),
             (5, ["zebra"]), (5, [*junk, "planet"]), (6, []), (7, None), (None, ["planet"])]
    t = spark.createDataFrame(texts, "id long, words array<string>")
    dic = spark.createDataFrame([(e,) for e in [*entries, "abc", None]], "entry string")
    got = {r.id: r.matched for r in J.longest_entry_of_texts(t, "id", F.col("words"), dic, "entry").collect()}
    assert got == {1: "planet", 2: "abc", 3: "harbour", 5: "planet"}


def test_longest_words_query_searches_no_word_too_short_to_matter(spark, tmp_path, monkeypatch):
    from riskloom.plans.registry import queries
    searched = _recorded(monkeypatch)
    small = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(300)]
    big = ["considerable", *[f"longerthanthose{x}" for x in small[:7]]]
    spark.createDataFrame([(1, " ".join(small + big)), (2, "acd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("Considerable acd",)], "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.doc_id: r.matched for r in queries()["longest_substring_join"](spark, str(tmp_path)).collect()}
    assert got == {1: "considerable", 2: "acd"}
    assert sorted(searched) == sorted([*big, "acd"])
