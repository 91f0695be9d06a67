import pytest
from pyspark.sql import functions as F

from riskloom.operators.aggregates import agg_multi_stat, discover_vocabulary


def test_pandas_semantics(spark):
    df = spark.createDataFrame([
        (1, None, "A"), (1, None, None),           # all-NULL values: sum 0, mean NULL
        (2, 5.0, "A"),                             # single row: var NULL
        (3, 1.0, "B"), (3, 3.0, "A"), (None, 7.0, "A"),  # NULL key dropped
    ], "k int, x double, c string")
    vocab = discover_vocabulary(df, ["c"])
    assert vocab == {"c": ["A", "B"]}
    out = {r.k: r for r in agg_multi_stat(df, "k", {"x": ["sum", "mean", "var", "size", "nunique"]}, "P_",
                                          vocab=vocab, subsets={"ACT_": F.col("c") == "B"}).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].P_x_SUM == 0.0 and out[1].P_x_MEAN is None and out[1].P_x_SIZE == 2
    assert out[2].P_x_VAR is None
    assert abs(out[3].P_x_VAR - 2.0) < 1e-12 and out[3].P_x_NUNIQUE == 2
    assert out[1].P_c_nan_MEAN == 0.5 and out[1].P_c_A_MEAN == 0.5
    # conditional subset: clients without a 'B' row get NULL, also for sums
    assert out[1].ACT_x_SUM is None and out[2].ACT_x_SIZE is None
    assert out[3].ACT_x_SUM == 1.0 and out[3].ACT_x_SIZE == 1


def test_vocabulary_beyond_the_bound_is_an_error(spark, monkeypatch):
    from riskloom.operators import aggregates as A
    df = spark.range(50).selectExpr("cast(id AS string) AS c", "cast(id % 3 AS string) AS k")
    assert A.discover_vocabulary(df, ["k", "c"])["k"] == ["0", "1", "2"]
    monkeypatch.setattr(A, "MAX_CATEGORIES", 20)
    with pytest.raises(ValueError, match="category values"):
        A.discover_vocabulary(df, ["c"])
    assert A.discover_vocabulary(df.where("false"), ["c"]) == {"c": []}
