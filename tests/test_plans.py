"""Plan checks: shuffles, Python nodes and pushdown."""

import re

import pytest

import __spark_entry__ as E

QUERIES = E.queries()
PYTHON_NODES = re.compile(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|"
                          r"FlatMapCoGroupsInPandas|PythonUDF")


@pytest.fixture
def plan(spark, sf_small):
    return lambda name: QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rolling_std", "rsi_14"])
def test_tick_features_one_exchange_on_ticker(plan, name):
    # keys fit in one block here: one hash exchange on ticker, one sort
    ex = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(name))
    assert len(ex) == 1 and re.match(r"ticker#\d+L?, \d+$", ex[0]), ex


@pytest.mark.parametrize("name", ["wide_feature_join", "agg_conditional_subset", "asof_nearest_join", "rolling_std",
                                  "rsi_14", "composite_weighted", "keyword_relevance", "auc_roc",
                                  "score_change_alert", "impute_median_by_group", "longest_substring_join"])
def test_headline_plans_stay_in_the_jvm(plan, name):
    assert not PYTHON_NODES.search(plan(name))


def test_filters_reach_the_scan(plan):
    p = plan("rolling_mean_news")
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type", p)


def test_projection_reaches_the_scan(plan):
    p = plan("rsi_14")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all("props" not in s or "value" in s for s in schemas)
    assert all(len(s.split(",")) <= 5 for s in schemas)  # not all columns of events


def test_client_row_scans_each_base_table_at_most_twice(plan):
    p = plan("wide_feature_join")
    final = p.split("== Initial Plan ==")[0]
    for t, most in (("lineitem", 2), ("orders", 2), ("customer", 1)):
        assert 1 <= len(re.findall(rf"FileScan parquet[^\n]*{t}\.parquet", final)) <= most, t


@pytest.mark.parametrize("name", ["missing_share", "fill_rate", "downcast_types", "columns_full"])
def test_profiles_without_distinct_counts_do_not_expand(plan, name):
    assert "Expand" not in plan(name)


def test_client_row_shuffles_narrow_rows(plan):
    """Rows are brought together by key before the wide aggregates: no partial
    aggregate of a client or an order goes through an exchange."""
    final = plan("wide_feature_join").split("== Initial Plan ==")[-1]
    lines = [x.lstrip(" :+-*()0123456789") for x in final.splitlines()]
    below = [b for a, b in zip(lines, lines[1:]) if re.match(r"Exchange hashpartitioning\((SK_ID|l_orderkey|o_orderkey)", a)]
    assert len(below) >= 4 and not any("Aggregate" in b for b in below)
