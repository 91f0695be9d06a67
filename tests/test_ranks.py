import numpy as np

from riskloom.operators.ranks import exact_quantiles
from riskloom.operators.stats import auc_roc, ks_two_sample


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_auc_ties_match_brute_force(spark):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 20, 400).astype(float).tolist()   # many ties
    labels = rng.integers(0, 2, 400).tolist()
    df = spark.createDataFrame(list(zip(scores, labels)), "s double, y int")
    got = auc_roc(df, "s", "y").collect()[0].auc
    assert abs(got - brute_auc(scores, labels)) < 1e-12


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=301).round(3).tolist() + [0.5] * 20
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    row = exact_quantiles(df, "v", [0.25, 0.5, 0.75]).collect()[0]
    exp = np.quantile(np.array(vals), [0.25, 0.5, 0.75])
    assert np.allclose([row.q0, row.q1, row.q2], exp, atol=1e-12)


def test_ks_statistic(spark):
    a = [1.0, 2.0, 3.0, 4.0]
    b = [3.0, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame([(v, 0) for v in a] + [(v, 1) for v in b], "v double, s int")
    r = ks_two_sample(df, "v", "s").collect()[0]
    assert abs(r.ks_stat - 0.6) < 1e-12  # largest ECDF gap at v = 4: 1.0 - 0.4
    assert 0.0 <= r.p_value <= 1.0
