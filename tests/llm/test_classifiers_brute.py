"""op5 and op8 against plain numpy versions on small corpora."""

import random
import re
import zlib

import numpy as np

from riskloom.llm import quality_model as Q
from riskloom.llm import toxicity as T


def logistic(x, y, penalty, scaled):
    """Weights and base of the penalised mean loss, by Newton steps."""
    n, p = x.shape
    scale = x.std(axis=0, ddof=1) if scaled else np.ones(p)
    scale[scale == 0] = 1
    z = np.hstack([x / scale, np.ones((n, 1))])
    ridge = np.diag([penalty] * p + [0.0])
    w = np.zeros(p + 1)
    for _ in range(100):
        mu = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (mu - y) / n + ridge @ w
        hess = (z * (mu * (1 - mu))[:, None]).T @ z / n + ridge
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return w[:-1] / scale, w[-1]


def stats_of(text):
    t = text or ""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, n = sum(map(len, words)), len(words)
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeat = len({k for p in at.values() if len(p) > 1 for i in p for k in range(i, i + 8)})
    symbols, marks, digits = (len(re.findall(c, t)) for c in (r"[#*$%&|<>]", "[.,!?;:]", "[0-9]"))
    return [min((symbols / max(chars, 1)) ** .5, 1) * 5, min(((len(lines) - len(set(lines))) / max(len(lines), 1)) ** .5, 1) * 2,
            min((repeat / max(n, 1)) ** .5, 1) * 4, np.log(max(chars, 1) / max(n, 1)), np.log(n + 1) / 2,
            min((marks / max(n, 1)) ** .5, 2) * 2, min(len(set(words)) / max(n, 1), 1) * 3, min((digits / max(chars, 1)) ** .5, 1) * 2]


def strength(sites, mean_of):
    between = sum(n * (s / n - mean_of(k)) ** 2 - mean_of(k) * (1 - mean_of(k)) for k, (s, n) in sites.items())
    inner = sum(n * mean_of(k) * (1 - mean_of(k)) for k, (s, n) in sites.items())
    return Q.MAX_K if between <= 0 or inner <= 0 else min(max(inner / between - 1, 1.0), Q.MAX_K)


def test_quality_model_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = ["alpha", "beta,", "gamma.", "de", "x#", "77", "long-word", "it;", "über"]
    rows, labels = [], []
    for i in range(400):
        at, lang = rng.randint(0, 5), rng.choice(["en", "de"])
        host, bad = f"h{at}", rng.random() < (.1, .2, .4, .6, .8, .9)[at] + (.1 if lang == "en" else -.1)
        w = rng.choices(vocab, weights=[3, 2, 2, 3, 4 if bad else 1, 3 if bad else 1, 1, 1, 1], k=rng.randint(3, 40))
        t = "".join(x + rng.choice([" ", " ", " ", "\n"]) for x in w) + (t[:60] if i and bad else "")
        rows.append((i, t, host if i % 11 else None, lang))
        if rng.random() < .6:
            labels.append((i, int(bad == (rng.random() < .1))))
    rows += [(900, None, "h1", "en"), (901, "", "lone", None), (3, rows[3][1], rows[3][2], rows[3][3])]
    labels += [(labels[0][0], 1), (None, 1), (5, None), (77777, 0)]
    got = Q.quality_model(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3),
                          spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    y = {}
    for i, v in labels:
        if i is not None and v is not None:
            y[i] = max(v, y.get(i, 0))
    x = np.array([stats_of(r[1]) for r in rows])
    train = [k for k, r in enumerate(rows) if r[0] in y]
    w, b = logistic(x[train], np.array([y[rows[k][0]] for k in train], float), Q.PENALTY, True)
    z = x @ w + b
    q = [float(y[r[0]]) if r[0] in y else 1 / (1 + np.exp(-z[k])) for k, r in enumerate(rows)]
    paths, hosts = {}, {}
    for r, v in zip(rows, q, strict=True):
        for sites, key in ((paths, (r[2], r[3])), (hosts, r[2])):
            s, n = sites.get(key, (0.0, 0))
            sites[key] = s + v, n + 1
    mean = (sum(q) + 1) / (len(q) + 2)
    k0 = strength(hosts, lambda h: mean)
    host_mean = {h: (s + k0 * mean) / (n + k0) for h, (s, n) in hosts.items()}
    k1 = strength(paths, lambda p: host_mean[p[0]])
    path_mean = {p: (s + k1 * host_mean[p[0]]) / (n + k1) for p, (s, n) in paths.items()}
    logit = lambda p: np.log(p / (1 - p))
    want = sorted((r[0], host_mean[r[2]], path_mean[r[2], r[3]], 1 / (1 + np.exp(-(z[k] + logit(path_mean[r[2], r[3]]) - logit(mean)))))
                  for k, r in enumerate(rows))
    assert k0 < Q.MAX_K and k1 < Q.MAX_K
    assert len(got) == len(want)
    for a, e in zip(sorted((r.doc_id, r.host_mean, r.path_mean, r.score) for r in got), want, strict=True):
        assert a[0] == e[0] and np.allclose(a[1:], e[1:], atol=5e-3), (a, e)
    assert all(r.kept == (r.score >= Q.KEEP) for r in got)


def test_toxicity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "FEATURES", 80)
    rng = random.Random(6)
    clean, foul = ["garden", "river", "stone", "walk", "green"], ["vexing", "grotty", "river", "Vile", "stone"]
    rows, labels = [], []
    for i in range(240):
        toxic = rng.random() < .4
        rows.append((i, " ".join(rng.choices(foul if toxic else clean, k=rng.randint(1, 9))) + rng.choice(["", " \n ok", "!"])))
        labels.append((i, int(toxic)))
    rows += [(500, None), (501, "")]
    labels += [(500, 1), (0, 1), (1, None), (None, 1)]
    got = {r.doc_id: r for r in T.toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                           spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    y = {}
    for i, v in labels:
        if i is not None and v is not None and not held(i):
            y[i] = max(v, y.get(i, 0))
    has = {i: set(T.grams(t or "").tolist()) for i, t in rows}
    p, n = sum(y.values()), len(y) - sum(y.values())
    pos, neg = {}, {}
    for i, v in y.items():
        for g in has[i]:
            (pos if v else neg)[g] = (pos if v else neg).get(g, 0) + 1
    rank = []
    for g in pos.keys() | neg.keys():
        a, b = pos.get(g, 0), neg.get(g, 0)
        if a + b >= T.LEAST_ROWS:
            expect = (a + b) * (p / (p + n))
            rank.append((-((a - expect) ** 2 / expect), g))
    chosen = sorted(g for _, g in sorted(rank)[:80])
    assert len(rank) > 80
    ratio = np.array([np.log((pos.get(g, 0) + 1) / (p + 2)) - np.log((neg.get(g, 0) + 1) / (n + 2)) for g in chosen])
    x = {i: np.array([g in has[i] for g in chosen], float) * ratio for i in has}
    w, b = logistic(np.array([x[i] for i in y]), np.array([y[i] for i in y], float), T.PENALTY, False)
    assert len(got) == len(rows)
    for i in has:
        want = 1 / (1 + np.exp(-(x[i] @ w + b)))
        assert abs(got[i].score - want) < 5e-3, (i, got[i].score, want)
        assert got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= .7)


def test_grams_count_every_ngram_of_the_folded_text(spark):
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice("ab C\tß\n🙂") for _ in range(rng.randint(0, 40)))
        b = (" " + " ".join(text.lower().split()) + " ").encode()
        pieces = [b[i:i + k] for k in T.ORDERS for i in range(len(b) - k + 1)]
        found = T.grams(text).tolist()
        assert len(found) == len(pieces)
        assert len({(c, h) for c, h in zip(pieces, found, strict=True)}) == len(set(pieces))
