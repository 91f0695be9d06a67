import random

import numpy as np

from riskloom.llm import shingle_join as J


def shingles(t, width):
    w = bytes(t or "", "utf-8").lower().split()
    return {tuple(w)} - {()} if len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    near = {i: set() for i in ids}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i != j and a and b and 100 * len(a & b) >= percent * len(a | b):
                near[i].add(j)
    comp = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    return sorted(((i, len(a), comp.get(i)) for i, a in sets), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    base = [rng.choices(words, k=rng.choice([5, 30, 80, 200])) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < .3:
            w[:0] = passage
        rows.append((i, " ".join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "ONE two"), (n + 5, "\xa0one"),
             (n + 6, "É a b c"), (n + 7, "é a b c"), (None, rows[0][1]), rows[3], (4, rows[9][1]), (n + 8, "x " * 20000),
             (n + 9, "X " * 30000)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    return sorted([tuple(r) for r in J.near_documents(df, **kw).collect()], key=repr)


def test_against_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        want = brute(rows, 4, 85)
        assert run(spark, rows) == want
        assert any(r[0] != r[2] for r in want)
    assert run(spark, rows, width=5, percent=80) == brute(rows, 5, 80)
    assert J.near_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_keys_and_large_groups(spark, monkeypatch):
    rows = corpus(5)
    want = brute(rows, 4, 85)
    monkeypatch.setattr(J, "HOT_KEY", 3)
    monkeypatch.setattr(J, "BLOCK", 5)
    monkeypatch.setattr(J, "HUBS", 2)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    assert run(spark, rows) == want


def test_repeated_rows_keep_links(spark, monkeypatch):
    rows = corpus(7, n=60)
    for times in (2, 3):
        many = rows * times
        want = brute(many, 4, 85)
        assert any(r[0] != r[2] for r in want)
        assert run(spark, many) == want
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    # some repeated, some with a second text
    many = rows + rows[::3] + [(i, rows[k + 1][1]) for k, (i, _) in enumerate(rows[:40:4])]
    assert run(spark, many) == brute(many, 4, 85)


def test_tree_keeps_every_pair():
    rng = np.random.default_rng(3)
    sets = []
    for i in range(300):
        s = rng.integers(0, 5000, rng.choice([3, 40, 90])).astype(np.uint64)
        if i % 3:
            s = np.concatenate([sets[rng.integers(len(sets))][:85], s[:4]])
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    bits = J.bitmaps(sets, 256)
    whole = J.SignatureTree(sizes, bits)
    got = {tuple(sorted(x)) for i, j in J.survivors(whole, whole, 85) for x in zip(i.tolist(), j.tolist())}
    a, b = np.arange(0, 120), np.arange(120, 300)
    ta, tb = J.SignatureTree(sizes[a], bits[a]), J.SignatureTree(sizes[b], bits[b])
    got2 = {(int(a[x]), int(b[y])) for i, j in J.survivors(ta, tb, 85) for x, y in zip(i, j)}
    for i in range(300):
        for j in range(i + 1, 300):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got
                assert not (i < 120 <= j) or (i, j) in got2
    assert len(got) < 300 * 299 / 2
