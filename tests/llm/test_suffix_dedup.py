import hashlib
import random

import numpy as np

from riskloom.llm import suffix_dedup as S
from riskloom.llm.suffix_sort import BlindTrie, deep_shallow


def brute(docs):
    """docs: (id, bytes) -> id, kept per row, by the definition."""
    first = {}
    for i, b in docs:
        key = S.NO_ID if i is None else i
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            first[w] = min(first.get(w, S.NO_ID), key)
    out = []
    for i, b in docs:
        key = S.NO_ID if i is None else i
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < key:
                gone[p:p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "andere", "éa", "thing", "\n", "ing", "aaaa", "x"]
    passage = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(20)) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        x = rng.random()
        if x < .5:
            parts.insert(1, rng.choice(passage)[rng.randint(0, 40):])
        if x < .15 and docs:
            parts = [docs[rng.randrange(len(docs))][1]]
        if .15 < x < .25 and docs:
            t = docs[rng.randrange(len(docs))][1]
            k = rng.randint(0, len(t))
            parts = [t[:k] + "#" + t[k + 1:]]
        docs.append((i, "".join(parts)))
    docs += [(n, ""), (n + 1, "a" * 400), (n + 2, "a" * 300 + "b"), (n + 3, "ab" * 100), (n + 4, "\0" * 80 + "q"),
             (n + 5, "\0" * 70), (3, docs[3][1]), (n + 6, "short")]
    rng.shuffle(docs)
    return docs


def run(spark, docs, parts=3, **kw):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(t, i, "z") for i, t in docs], "text string, doc_id long, kept string").repartition(parts)
    out = S.remove_repeats(df, **kw).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    return sorted([tuple(r) for r in out.collect()], key=repr)


def test_trie_and_sort():
    rng = np.random.default_rng(1)
    for width in (8, 30, 50):
        m = rng.integers(0, 2, (500, width)).astype(np.uint8)
        m[:200, :width // 2] = 1
        m[100:200] = m[100]
        m[300:320, :width - 2] = 0
        order, lcp = deep_shallow(m)
        texts = [m[i].tobytes() for i in order]
        assert texts == sorted(texts)
        for a, b, k in zip(texts, texts[1:], lcp[1:]):
            assert k == next((i for i in range(width) if a[i] != b[i]), width)
    strings = {i: bytes(x) for i, x in enumerate({bytes(rng.integers(0, 3, 12).astype(np.uint8)) for _ in range(300)})}
    trie = BlindTrie(12)
    for i, x in strings.items():
        trie.add(i, x, strings)
    rows, lcp = trie.ordered()
    texts = [strings[i] for i in rows]
    assert texts == sorted(strings.values())
    for a, b, k in zip(texts, texts[1:], lcp[1:]):
        assert k == next(i for i in range(12) if a[i] != b[i])


def test_anchors_own_each_string_once():
    rng = np.random.default_rng(2)
    for buf in (rng.integers(0, 4, 3000).astype(np.uint8), np.zeros(500, np.uint8), np.tile(np.arange(3, dtype=np.uint8), 200)):
        starts = np.array([0, 0, 100, 130, 131, 600]) if len(buf) > 600 else np.array([0, 60])
        p, first, last = S.anchors(buf, starts)
        owned = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]) if len(p) else []
        ends = np.append(starts[1:], len(buf))
        want = [i for s, e in zip(starts, ends) for i in range(s, e - 49)]
        assert sorted(owned) == want
        assert ((first <= p) & (p - last >= 0) & (p - first <= 30)).all()
        assert (S._hash_at(buf, p, S.ANCHOR) == S._rolling(buf, S.ANCHOR)[p]).all()


def test_against_brute_force(spark):
    for seed in range(3):
        docs = corpus(seed)
        want = brute([(i, t.encode()) for i, t in docs])
        assert run(spark, docs) == want
        assert run(spark, docs, block_bytes=300, hot=1) == want
        assert run(spark, docs, block_bytes=2000, hot=5) == want


def test_edges(spark):
    long = "The same passage stands in all of these documents, word by word and to the end."
    docs = [(None, long), (None, long), (5, long), (2, None), (7, ""), (9, long + "!")]
    want = brute([(i, (t or "").encode()) for i, t in docs])
    assert run(spark, docs) == want
    short = [(1, "too short"), (2, "too short"), (3, ""), (4, None)]
    assert run(spark, short) == brute([(i, (t or "").encode()) for i, t in short])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0
