"""XML metrics: values of the source, malformed filings, repeated elements."""

import pytest

from riskloom.plans import source_queries as SQ
from riskloom.sources import filings as FL


def test_elements_and_malformed_rows(spark):
    rows = [(1, '<x xmlns:g="u"><g:Assets>n/a</g:Assets><g:Assets>5</g:Assets></x>', 5.0, None),
            (2, "<x><Assets>7</Assets", None, None),
            (3, "not xml", None, None),
            (4, "<x><a><Revenues unit='usd'>(1,234.5)</Revenues></a><AssetsCurrent>9</AssetsCurrent></x>", None, -1234.5),
            (5, "<x><SalesRevenueNet>3</SalesRevenueNet><Revenues>bad</Revenues></x>", None, 3.0),
            (6, None, None, None), (7, "", None, None)]
    got = FL.extract_xml_metrics(spark.createDataFrame([r[:2] for r in rows], "id long, xml string"), "xml").collect()
    assert sorted((r.id, r.total_assets, r.revenue) for r in got) == [(r[0], r[2], r[3]) for r in rows]


def test_values_of_the_source(spark, sf_small):
    out = FL.extract_xml_metrics(SQ._xml_filings(spark, sf_small), "xml")
    rows = out.collect()
    assert rows
    import re
    for r in rows:
        for metric, tags in FL.XBRL_TAGS.items():
            texts = [re.search(f"<us-gaap:{t}>([^<]*)<", r.xml) for t in tags]
            want = next((m.group(1) for m in texts if m), None)
            if want is None:
                assert r[metric] is None
            else:
                v = float(want.strip("()").replace(",", ""))
                assert r[metric] == pytest.approx(-v if want.startswith("(") else v)


def test_category_names_are_unique():
    from riskloom.operators.aggregates import category_tokens
    names = category_tokens(["A-B", "A B", "a_b", "C", "nan"])
    assert len({n.lower() for n in names.values()}) == 5 and names["C"] == "C"


def test_sums_keep_small_and_infinite_values(spark):
    from pyspark.sql import functions as F
    from riskloom.operators.aggregates import mean_of, sum_of, var_of
    df = spark.createDataFrame([("s", 4e-7), ("s", 3e-7), ("s", 2e-7), ("i", float("inf")), ("i", 1.0), ("b", 2e12), ("b", 1e15),
                                ("n", None), ("o", 5.0), ("f", float("nan"))], "k string, v double")
    got = {r.k: r for r in df.groupBy("k").agg(sum_of(F.col("v")).alias("s"), mean_of(F.col("v")).alias("m"),
                                               var_of(F.col("v")).alias("v")).collect()}
    assert got["s"].s == pytest.approx(9e-7) and got["s"].v == pytest.approx(1e-14)
    assert got["i"].s == float("inf") and got["b"].s == pytest.approx(1.002e15)
    assert got["n"].s is None and got["o"].v is None and got["f"].s != got["f"].s


def test_clean_names():
    from riskloom.operators.profiling import clean_name
    want = {"order key": "order_key", "ages - (93_years)": "ages_93_years", "NAME CONTRACT TYPE": "NAME_CONTRACT_TYPE",
            "CREDIT_PRIORITY_1-URGENT": "CREDIT_PRIORITY_1URGENT", "total__price ($)": "total_price_", "a___b": "a__b"}
    assert {n: clean_name(n) for n in want} == want
