import math

import duckdb
import numpy as np

from riskloom.llm import metric_join as M


def brute(rows, cosine):
    good = {}
    for i, v, g in rows:
        if i is None or g is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, (np.array(v, float), g))
    ids = sorted({r[0] for r in rows if r[0] is not None})
    near = {i: set() for i in ids}
    for a, (x, g) in good.items():
        for b, (y, h) in good.items():
            if a != b and g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                near[a].add(b)
    comp = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    return sorted((i, len(near[i]), comp[i], comp[i] == i) for i in ids)


def rows_of(seed, n=160, dim=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0, .05, .15])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3.5])], int(rng.integers(3))))
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [1.0, None] + [0.0] * (dim - 2), 1),
             (n + 3, [float("nan")] * dim, 1), (n + 4, rows[0][1], None), (n + 5, [float("inf")] * dim, 0),
             (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [], 1), rows[5]]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_against_brute_force(spark, monkeypatch):
    for seed, rows_a_block in ((1, 4096), (2, 16)):
        monkeypatch.setattr(M, "BLOCK_ROWS", rows_a_block)
        monkeypatch.setattr(M, "ASSIGN_ROWS", 20 if seed == 2 else 8192)
        rows = rows_of(seed)
        df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", component_id string")
        got = M.near_vectors(df).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, M.COSINE)
    assert M.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    from riskloom.llm.registry import queries
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = sorted(con.execute(M.COMPONENTS_SQL).fetchall())
    got = sorted(tuple(r) for r in queries()["op7_metric_join"](spark, sf).collect())
    assert got == [(int(a), int(b), int(c), d) for a, b, c, d in want]
