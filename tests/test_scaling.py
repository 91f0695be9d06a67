"""Group scaling against numpy, as fitted, saved and reused models."""

import numpy as np

from riskloom.operators.scaling import GroupScaler, GroupScalerModel, members
from riskloom.session import scratch_table_path

COLS = ["debt_ratio", "price", "news_volume", "sentiment", "flat_margin", "other"]
GROUPS = [{"name": "financial", "method": "robust", "keywords": ["ratio", "margin"]},
          {"name": "market", "method": "standard", "keywords": ["price", "volume"]},
          {"name": "news", "method": "minmax", "keywords": ["news", "sentiment"]}]


def _rows(seed, n):
    r = np.random.default_rng(seed)
    x = r.normal(3, 2, (n, len(COLS)))
    x[:, 4] = 7.0
    x[r.random((n, len(COLS))) < .1] = np.nan
    return x


def _frame(spark, x):
    return spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)],
                                 "i int, " + ", ".join(f"{c} double" for c in COLS))


def _by_hand(fit, x):
    fit, x = fit.copy(), x.copy()
    for g in GROUPS:
        for j in [COLS.index(c) for c in members(COLS, g)]:
            v = fit[:, j][~np.isnan(fit[:, j])]
            centre, scale = {"robust": (np.median(v), np.subtract(*np.percentile(v, [75, 25]))), "standard": (v.mean(), v.std()),
                             "minmax": (v.min(), np.ptp(v))}[g["method"]]
            scale = scale or 1.0
            fit[:, j], x[:, j] = (fit[:, j] - centre) / scale, (x[:, j] - centre) / scale
    return x


def test_groups_in_order_saved_and_reused(spark):
    fit, new = _rows(1, 200), _rows(2, 50)
    model = GroupScaler(COLS, GROUPS).fit(_frame(spark, fit))
    assert [(s["group"], s["column"]) for s in model.fitted()] == [
        ("financial", "debt_ratio"), ("financial", "flat_margin"), ("market", "price"), ("market", "news_volume"),
        ("news", "news_volume"), ("news", "sentiment")]
    path = scratch_table_path(spark, "test-scaler")
    model.save(path)
    again = GroupScalerModel.load(path)
    assert again.fitted() == model.fitted()
    for m in (model, again):
        out = m.transform(_frame(spark, new))
        assert out.columns == ["i", *COLS]
        got = np.array([[np.nan if v is None else v for v in r[1:]] for r in sorted(map(tuple, out.collect()))])
        assert np.allclose(got, _by_hand(fit, new), equal_nan=True, atol=1e-9)


def test_estimator_round_trip_and_no_rows(spark):
    path = scratch_table_path(spark, "test-estimator")
    GroupScaler(COLS, GROUPS).save(path)
    fit = _frame(spark, _rows(3, 40))
    assert GroupScaler.load(path).fit(fit).fitted() == GroupScaler(COLS, GROUPS).fit(fit).fitted()
    empty = GroupScaler(COLS, GROUPS).fit(fit.limit(0))
    assert all(s["centre"] == 0.0 and s["scale"] == 1.0 for s in empty.fitted())
