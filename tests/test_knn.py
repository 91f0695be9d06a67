import math
import random

import numpy as np

from riskloom.operators.knn import impute_knn


def brute_force(rows, cols, k, min_rows):
    """Direct nan-euclidean k-NN imputation per group on plain Python lists."""
    p = len(cols)
    by_g = {}
    for g, i, *vals in rows:
        by_g.setdefault(g, []).append((i, vals))
    out = {}
    for g, members in by_g.items():
        n = len(members)
        for i, x in members:
            res = list(x)
            if n > min_rows:
                for j in range(p):
                    if x[j] is not None:
                        continue
                    cand = []
                    for i2, y in members:
                        if i2 == i or y[j] is None:
                            continue
                        common = [t for t in range(p) if x[t] is not None and y[t] is not None]
                        if not common:
                            continue
                        d = math.sqrt(p / len(common) * sum((x[t] - y[t]) ** 2 for t in common))
                        cand.append((d, i2, y[j]))
                    cand.sort()
                    if cand:
                        res[j] = sum(v for _, _, v in cand[:k]) / len(cand[:k])
                    else:
                        present = [y[j] for _, y in members if y[j] is not None]
                        res[j] = sum(present) / len(present) if present else None
            out[(g, i)] = res
    return out


def _fixture(seed=7):
    rnd = random.Random(seed)
    rows = []
    for g, n in (("hot", 57), ("b", 14), ("small", 6)):
        for i in range(n):
            vals = [None if rnd.random() < 0.3 else round(rnd.uniform(-5, 5), 3) for _ in range(4)]
            rows.append((g, i, *vals))
    rows.append(("hot", 999, None, None, None, None))  # no common feature with anyone → group mean
    return rows


def test_knn_matches_brute_force_across_block_sizes(spark):
    cols = ["a", "b", "c", "d"]
    rows = _fixture()
    df = spark.createDataFrame(rows, "g string, i int, a double, b double, c double, d double")
    want = brute_force(rows, cols, k=5, min_rows=10)
    for block in (4, 1024):  # many blocks per group vs one block
        got = {(r.g, r.i): [r[c] for c in cols]
               for r in impute_knn(df, "g", "i", cols, k=5, min_rows=10, block_rows=block).collect()}
        assert set(got) == set(want)
        for key, w in want.items():
            for a, b in zip(got[key], w):
                assert (a is None and b is None) or np.isclose(a, b, rtol=1e-12, atol=1e-12), (block, key, a, b)


def test_knn_small_groups_untouched(spark):
    rows = [("s", i, None if i == 0 else float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, a double")
    got = {r.i: r.a for r in impute_knn(df, "g", "i", ["a"], k=5, min_rows=10).collect()}
    assert got[0] is None and got[3] == 3.0


def test_far_blocks_are_not_scored(spark):
    """Two columns always present, one with gaps: only neighbouring blocks meet,
    so pairs grow with the rows, not with their square."""
    rnd = random.Random(3)
    share = {}
    for n in (400, 1600):
        rows = [("g", i, float(i % 97), i / 7.0 + rnd.random(), None if rnd.random() < .2 else float(i)) for i in range(n)]
        rows = [(g, i, 0.001 * a, b, c) for g, i, a, b, c in rows]
        df = spark.createDataFrame(rows, "g string, i int, a double, b double, c double")
        seen = []
        got = {(r.g, r.i): [r.a, r.b, r.c] for r in impute_knn(df, "g", "i", ["a", "b", "c"], block_rows=20, seen=seen).collect()}
        scored, every = seen
        share[n] = scored / (n / 20)
        assert scored < every / 4
        if n == 400:
            for key, w in brute_force(rows, ["a", "b", "c"], 5, 10).items():
                assert np.allclose(got[key], w, rtol=1e-12, atol=1e-12)
    assert share[1600] < 2 * share[400]


def test_knn_plan_and_null_groups(spark):
    rows = [(None if i % 2 else "g", i, None if i % 5 == 0 else float(i), float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double")
    out = impute_knn(df, "g", "i", ["a", "b"], block_rows=4)
    got = {(r.g, r.i): [r.a, r.b] for r in out.collect()}
    for key, w in brute_force(rows, ["a", "b"], 5, 10).items():
        assert np.allclose(got[key], w)
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") <= 10
    assert impute_knn(df.limit(0), "g", "i", ["a", "b"]).count() == 0
