import re

import pytest

from riskloom.operators import cleaning as C

SCHEMA = "k long, small int, wide long, price double, sparse double, half int, flag int, name string, nothing int"


@pytest.fixture
def raw(spark, tmp_path):
    rows = [(i, i % 100, (1 << 40) + i, i / 4, float(i) if i % 10 == 0 else None, i if i % 2 else None, 1, f"n{i}", None)
            for i in range(1000)]
    path = str(tmp_path / "raw")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def rules_of(found):
    return {d.column: d.rule for d in found if d.rule}


def test_each_rule_drops_its_columns(raw):
    assert rules_of(C.decide(raw, ("single_value",))) == {"flag": "single_value"}
    assert rules_of(C.decide(raw, ("non_var",))) == {"flag": "non_var"}
    assert rules_of(C.decide(raw, ("sparse",))) == {"sparse": "sparse", "nothing": "sparse"}
    assert rules_of(C.decide(raw, ("missing", "sparse"), protect=["half"])) == {"sparse": "missing", "nothing": "missing"}
    with pytest.raises(ValueError):
        C.decide(raw, ("no_rule",))


def test_dropped_columns_do_not_reach_the_scan(raw):
    found = C.decide(raw, ("single_value", "sparse"))
    out = C.clean(raw, found)
    assert out.columns == ["k", "small", "wide", "price", "half", "name"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert len(read) == 1
    assert [c.split(":")[0] for c in read[0].split(",")] == out.columns
    assert {f.name: f.dataType.simpleString() for f in out.schema.fields} == {
        "k": "smallint", "small": "tinyint", "wide": "bigint", "price": "float", "half": "smallint", "name": "string"}
    same = raw.select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, same.collect()))


def test_record_is_kept_and_overflow_is_seen(spark, raw):
    found = C.from_text(C.to_text(C.decide(raw, ("single_value", "sparse"))))
    assert found == C.decide(raw, ("single_value", "sparse"))
    later = spark.createDataFrame([(1, 5, 7, 1e300, None, None, 1, "a", None), (70000, -128, 1, float("inf"), None, 3, 2, "b", 1),
                                   (None, 1000, None, None, None, None, None, None, None)], SCHEMA)
    lost = {r.column_name: (r.target_dtype, r.n_lost) for r in C.overflow_counts(later, found).collect()}
    assert lost == {"k": ("smallint", 1), "small": ("tinyint", 1), "price": ("float", 1), "half": ("smallint", 0)}
    got = [tuple(r) for r in C.clean(later, found, overflow="null").collect()]
    assert got == [(1, 5, 7, None, None, "a"), (None, -128, 1, float("inf"), 3, "b"), (None, None, None, None, None, None)]
    with pytest.raises(Exception, match="holds a value beyond"):
        C.clean(later, found).collect()


def test_layout_changes(spark, raw):
    found = C.decide(raw, ("single_value",))
    more = C.clean(raw.selectExpr("*", "k AS new"), found)
    assert more.columns[-1] == "new" and "flag" not in more.columns
    with pytest.raises(ValueError, match="price"):
        C.clean(raw.drop("price"), found)
    assert C.clean(raw.drop("flag"), found).columns == [c for c in raw.columns if c != "flag"]


def test_empty_table_is_left_alone(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = C.decide(empty, tuple(C.RULES))
    assert rules_of(found) == {} and C.clean(empty, found).schema == empty.schema
    assert C.overflow_counts(empty, found).count() == 0


def test_ratios_are_null_where_the_divisor_says_nothing(spark):
    from riskloom.operators.ratios import APPLICATION_RATIOS, ratio_columns
    rows = [(-500, -1000, 100.0, 400.0, 4, 20.0), (365243, -1000, 0.0, 0.0, 0, 5.0), (None, 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "DAYS_EMPLOYED int, DAYS_BIRTH int, AMT_INCOME_TOTAL double, AMT_CREDIT double, "
                                     "CNT_FAM_MEMBERS int, AMT_ANNUITY double")
    got = [tuple(r)[6:] for r in ratio_columns(df, APPLICATION_RATIOS).collect()]
    assert got == [(.5, .25, 25.0, .2, .05), (None,) * 5, (None,) * 5]
