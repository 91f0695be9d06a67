"""Hard negatives against a brute-force version, over several blocks and parts."""

import random

import numpy as np
import pytest

from riskloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label long, vec array<long>, q int, run int, part int, place int, dim string"


def _brute(rows, is_anchor, k=5):
    rows = [r for r in dict.fromkeys((i, v, None if x is None else tuple(x)) for i, v, x in rows)
            if None not in r and None not in r[2] and all(abs(x) < H.LIMIT for x in r[2])]
    out = []
    for i, label, q in rows:
        if not is_anchor(i):
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), j, m) for j, m, v in rows if len(v) == len(q)]
        near = sorted((s, j) for s, j, m in scored if m == label and j != i)[:k]
        for s, j in near:
            fit = sorted((t, n) for t, n, m in scored if m != label and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def _run(spark, rows, anchors="vec_id % 10 = 0"):
    df = spark.createDataFrame([(i, v, x, 1, 2, 3, 4, "d") for i, v, x in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, anchors).collect())


def _clustered(n, dim, seed, labels=4, hot=None):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 60, (12, dim))
    out = []
    for i in range(n):
        label = hot if hot is not None and rnd.random() < .4 else int(rnd.integers(labels))
        out.append((i, label, np.floor(centres[rnd.integers(12)] + rnd.normal(0, 12, dim)).astype(int).tolist()))
    return out


@pytest.fixture
def small_runs(monkeypatch):
    monkeypatch.setattr(H, "BOX_CHUNK", 2)


def test_blocks_and_parts_equal_brute_force(spark, small_runs, monkeypatch):
    rows = _clustered(600, 6, 1, hot=2)
    want = _brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    monkeypatch.setattr(H, "PART_ANCHORS", 7)
    assert _run(spark, rows) == want
    assert _run(spark, rows[::-1]) == want


def test_many_pages_in_a_block_equal_brute_force(spark):
    rows = _clustered(3000, 4, 9, hot=1)      # 24 pages, 2 nodes
    assert _run(spark, rows, "vec_id % 50 = 0") == _brute(rows, lambda i: i % 50 == 0)


def test_special_rows(spark, small_runs, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "PART_ANCHORS", 4)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, None]), [rnd.randint(-2, 3) for _ in range(3)]) for i in range(120)]     # many ties
    rows += [(200, 0, None), (210, None, [1, 2, 3]), (None, 0, [1, 2, 3]), (220, 0, [1, None, 3]), (230, 1, [H.LIMIT, 0, 0]),
             (240, 0, [H.LIMIT - 1, 5, 5]), (241, 0, [H.LIMIT - 1, 5, 6]), (242, 1, [H.LIMIT - 1, 5, 4]),
             (250, 0, [1, 2]), (251, 0, [2, 2]), (252, 1, [2, 1]), (253, 0, []), (260, 1, []), (270, 9, [7, 7, 7]),
             (10, 1, [3, 3, 3]), *[(300, 1, [3, 3, 2])] * 4, (301, 0, [0, 0, 0]), (310, 0, [0, 0, 0]), (311, 1, [0, 0, 0])]
    assert _run(spark, rows) == _brute(rows, lambda i: i is not None and i % 10 == 0)


def test_groups_of_equal_vectors(spark, small_runs, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 50)
    rows = [(i, i % 2, [5, 5, -5, 1]) for i in range(300)] + [(300 + i, 3, [5, 5, -5, i]) for i in range(40)]
    assert _run(spark, rows) == _brute(rows, lambda i: i % 10 == 0)


def test_search_prunes_pages(monkeypatch):
    """On clustered vectors of few dimensions the queue opens few pages."""
    monkeypatch.setattr(H, "PAGE_ROWS", 16)
    rows = _clustered(4000, 3, 5, labels=1)
    m = np.array([r[2] for r in rows], dtype=np.int32)
    labels = np.zeros(len(m), np.int64)
    order = H.tile(m, labels)
    m = m[order]
    block = H.Run({"dim": 3, "n": len(m), "ids": order.astype(np.int64).tobytes(), "labels": labels.tobytes(), "body": m.tobytes()})
    least, most = H.bounds(m[:50], *block.boxes()[1][:2])
    scores = m[:50].astype(np.int64) @ m.T.astype(np.int64)
    kth = np.sort(scores, axis=1)[:, -5]
    assert ((most >= kth[:, None]).mean()) < .2
    page = np.arange(len(m)) // 16
    assert all((scores[:, page == p].max(1) <= most[:, p]).all() and (scores[:, page == p].min(1) >= least[:, p]).all()
               for p in range(most.shape[1]))


def test_query_and_empty_table(spark, sf_small):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA), "vec_id % 10 = 0").count() == 0
    rows = H.quantised(spark.createDataFrame([(0, 1, [.5, float("nan")]), (1, 1, [-.001, .999]), (2, 1, [None, 1.0]), (3, 1, None),
                                              (4, None, [1e300, 0.0])], "vec_id long, label int, embedding array<double>"))
    assert [r.vec for r in rows.orderBy("vec_id").collect()] == [[128, None], [-1, 255], [None, 256], None, [None, 0]]
    assert H.q_hard_negatives(spark, sf_small).columns == [c.split()[0] for c in H.RESULT_SCHEMA.split(", ")]
