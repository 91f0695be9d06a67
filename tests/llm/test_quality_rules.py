import random
import re

import numpy as np

from riskloom.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string, kept string, g string"


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = t.split("\n")
    seen, dup = set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    cover = {k for p in at.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover),
            len(w) < 20 or 100 * len(cover) > 30 * len(w))


def texts(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "ß", "x#", "$5", "<b>", "naïve", "🙂", "a\xa0b", "a\x1cb", "and", "hat", "man"]
    out = []
    for _ in range(80):
        w = rng.choices(words, k=rng.randint(0, 60))
        if rng.random() < .4 and len(w) > 12:
            w += w[:rng.randint(8, 12)]
        if rng.random() < .2:
            w = w[:3] * 12
        out.append("".join(x + rng.choice([" ", "\n", "\t ", " \n", "\r\n", "\v"]) for x in w))
    return [*out, "", None, " \n\t", "a a a a a a a a a", "same\nsame\n \n \nsame", "w " * 30000, "v" * 100000]


def test_base_counts(spark):
    xs = texts()
    rows = [(i, x, "en", "s", "clash", "g") for i, x in enumerate(xs)] + [(None, xs[0], None, None, "c", "g"), (3, xs[3], "en", "s", "c", "g")]
    got = Q.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r[1:7]) == brute(xs[r.doc_id]), xs[r.doc_id]
            assert not (r.base_failed and r.kept)
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def mcd(x, floors, steps=Q.STEPS):
    """The estimate by numpy, with exact quantiles as the sketch has them for
    few rows."""
    f = np.array(floors)
    low = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    m = np.array([low(c, .5) for c in x.T])
    s = np.maximum([low(np.abs(c - k), .5) * 1.4826 for c, k in zip(x.T, m)], f)
    d2 = (((x - m) / s) ** 2).sum(axis=1)
    for i in range(steps + 1):
        near = x[d2 <= (low(d2, Q.KEEP) if i < steps else Q.INSIDE)]
        m = near.mean(axis=0)
        c = np.cov(near.T, bias=True) * (Q.CONSISTENCY if i < steps else 1) + np.diag(f ** 2)
        d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    return d2


def test_distances(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        n = rng.randint(30, 90)
        w = [rng.choice("abcdefgh") * rng.randint(2, 8) for _ in range(n)]
        if i % 25 == 0:
            w = [x + "$#" for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), rng.choice("st"), "c", "g"))
    rows += [(1000 + i, rows[i][1], "fr", f"tiny{i}", "c", "g") for i in range(9)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, SCHEMA), min_group=50).collect()}
    groups = {}
    for i, t, lang, source, *_ in rows:
        n, chars, sym, dup, rep, failed = brute(t)
        if not failed:
            lines = sum(bool(x.strip()) for x in t.split("\n"))
            groups.setdefault((lang, source), []).append((i, [(sym / chars) ** .5, np.log(chars / n), (dup / lines) ** .5, (rep / n) ** .5]))
    for (lang, _), members in groups.items():
        if lang == "fr":
            assert all(got[i].d2 is None and got[i].kept for i, _ in members)
            continue
        assert len(members) >= 50
        d2 = mcd(np.array([v for _, v in members]), [f for _, f in Q.STATS.values()])
        for (i, _), d in zip(members, d2):
            assert abs(got[i].d2 - d) <= 1e-6 * (1 + d)
    assert all(not got[i].kept for i in range(0, 300, 25))
    assert sum(got[i].kept for i in range(300)) >= 280


def test_clean_stay_and_no_python(spark):
    sf = "/root/testdata/sf0.01"
    from riskloom.llm.registry import queries
    df = queries()["op6_quality_rules"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = df.join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= .99 * len(good) and sum(bad) <= .2 * len(bad)


def test_each_statistic_alone_rejects(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    lines = lambda n: [" ".join(word() for _ in range(8)) for _ in range(n)]
    rows = [(i, "\n".join(lines(10)), "en", "s", "c", "g") for i in range(200)]
    same = lines(6)
    twice = [word() for _ in range(12)]
    few = [word() for _ in range(8)]
    planted = {
        900: "\n".join(" ".join(w + "#" for w in x.split()) for x in lines(10)),   # symbols
        901: "\n".join(" ".join(w * 6 for w in x.split()) for x in lines(10)),     # word length
        902: "\n".join(rng.choice(few) for _ in range(60)),                        # repeated lines, few windows twice
        903: " ".join(twice + [word() for _ in range(29)] + twice + [word() for _ in range(29)]),  # repeated words, one line
        904: "\n".join(same + lines(4)),                                            # clean
    }
    rows += [(i, t, "en", "s", "c", "g") for i, t in planted.items()]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i].base_failed for i in planted)
    assert got[902].n_dup_lines == 52 and got[902].n_repeat_words == 0
    assert got[903].n_dup_lines == 0 and got[903].n_repeat_words == 24
    assert [got[i].kept for i in planted] == [False, False, False, False, True]
    assert sum(got[i].kept for i in range(200)) >= 198


def test_salted_groups_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(2, 8) for _ in range(rng.randint(20, 60))), rng.choice(["en", None]),
             rng.choice("sst"), "c", "g") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {r.doc_id: r for r in Q.quality_rules(df).collect()}
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    got = {r.doc_id: r for r in Q.quality_rules(df).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r[:7] == want[i][:7] and r.kept == want[i].kept
        assert (r.d2 is None) == (want[i].d2 is None) and (r.d2 is None or abs(r.d2 - want[i].d2) <= 1e-6 * (1 + r.d2))
