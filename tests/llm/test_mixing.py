import random
from collections import Counter
from fractions import Fraction

from riskloom.llm import mixing as M

SCHEMA = "doc_id long, source string, slot string, n long"


def docs_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i * 7 + k, s, "clash", i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rng.shuffle(rows)
    return rows


def fluid(blocks, w):
    """Slots at which the shares change, and what each source has had then."""
    had, t, out = {s: Fraction(0) for s in blocks}, Fraction(0), []
    while any(had[s] < blocks[s] for s in blocks):
        live = [s for s in blocks if had[s] < blocks[s]]
        total = sum(w[s] for s in live)
        step = min((blocks[s] - had[s]) * total / w[s] for s in live)
        out.append((t, dict(had), {s: w[s] / total for s in live}))
        for s in live:
            had[s] += step * w[s] / total
        t += step
    return out


def check(order, blocks, w, slack=Fraction(0)):
    """order: source of each slot.  At every slot every source is within a
    block of the fluid."""
    assert Counter(order) == Counter(blocks)
    phases, p, had = fluid(blocks, w), 0, Counter()
    for t, s in enumerate(order, 1):
        had[s] += 1
        while p + 1 < len(phases) and phases[p + 1][0] <= t:
            p += 1
        start, before, rate = phases[p]
        for x in blocks:
            want = before[x] + (t - start) * rate.get(x, 0)
            assert abs(had[x] - want) < 1 + slack, (t, x, had[x], float(want))


def order_of(spark, blocks, w):
    names = list(blocks)
    rows = [(k, blocks[s], w[s]) for k, s in enumerate(names)]
    got = M.schedule(spark.createDataFrame(rows, "sid long, blocks long, w long")).collect()
    got.sort(key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    assert all(r.release <= r.slot < r.due for r in got)
    for k, s in enumerate(names):
        assert [r.i for r in got if r.sid == k] == list(range(blocks[s]))
    return [names[r.sid] for r in got]


def test_every_slot_within_a_block_of_the_fluid(spark, monkeypatch):
    rng = random.Random(5)
    for part, n in ((7, 2), (16, 6), (64, 21)):
        monkeypatch.setattr(M, "PART", part)
        for equal in (False, True):
            blocks = {k: rng.choice([1, 3, 20, 90]) for k in range(n)}
            w = {k: Fraction(4 if equal else rng.choice([1, 2, 7, 30, 1000])) for k in range(n)}
            w[0], blocks[0] = sum(w.values()) / 2, 150                       # one holds a third of the shares
            check(order_of(spark, blocks, {k: int(v) for k, v in w.items()}), blocks, {k: Fraction(int(v)) for k, v in w.items()})


def test_many_slots_keep_to_the_given_weights(spark):
    given = {"a": .6664, "b": .3332, "c": .0004}
    blocks = {"a": 66640, "b": 33320, "c": 40}
    w = {s: round(x * M.SHARES) for s, x in given.items()}
    order, had = order_of(spark, blocks, w), Counter()
    for t, s in enumerate(order, 1):
        had[s] += 1
        assert all(abs(had[x] - given[x] * t) < 1 + 1e-4 for x in given)


def test_rows_of_blocks(spark):
    sizes = {"hot": 400, "b": 100, "c": 57, "d": 3, None: 20}
    rows = docs_of(sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    given = {"hot": 5.0, "b": 3.0, "c": 1.5, None: .5}
    weights = spark.createDataFrame([*given.items(), ("absent", 9.0)], "source string, weight double")
    for block in (1, 5):
        got = M.mix(df, weights, block_rows=block).collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
        by_slot = {}
        for r in got:
            by_slot.setdefault(r.mix_place.slot, []).append(r)
        assert sorted(by_slot) == list(range(len(by_slot)))
        order = []
        for t in range(len(by_slot)):
            assert len({(r.source, r.mix_place.block) for r in by_slot[t]}) == 1
            assert sorted(r.mix_place.place for r in by_slot[t]) == list(range(len(by_slot[t])))
            order.append(by_slot[t][0].source)
        blocks = {s: -(-n // block) for s, n in sizes.items()}
        w = {s: Fraction(max(1, round(given.get(s, 0) / 10 * M.SHARES))) for s in sizes}
        check(order, blocks, w)


def test_repeated_rows_and_one_source(spark):
    rows = [(1, "a", "x", 0)] * 10 + [(None, "a", "x", 0)] * 5
    got = M.mix(spark.createDataFrame(rows, SCHEMA), block_rows=4).collect()
    assert sorted(r.mix_place["rank"] for r in got) == list(range(15))
    assert sorted((r.mix_place.slot, r.mix_place.place) for r in got) == [divmod(i, 4) for i in range(15)]
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_buckets_number_rows_once(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 3)
    rows = docs_of({"a": 300, "b": 30})
    got = M.mix(spark.createDataFrame(rows, SCHEMA), block_rows=3).collect()
    for s, n in (("a", 300), ("b", 30)):
        assert sorted(r.mix_place["rank"] for r in got if r.source == s) == list(range(n))
    again = M.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), block_rows=3).collect()
    assert {(r.doc_id, r.source): r.mix_place for r in got} == {(r.doc_id, r.source): r.mix_place for r in again}


def test_columns_of_any_name_are_kept(spark):
    names = ["__s", "__h", "__r", "__b", "s", "id", "h", "b", "r", "row", "block", "part", "mix_place"]
    rows = [(i, "ab"[i % 2], *[f"{c}{i}" for c in names]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{c} string" for c in names))
    got = M.mix(df, block_rows=3, out_col="at").collect()
    assert sorted(tuple(r)[:-1] for r in got) == rows
    assert sorted((r["at"].slot, r["at"].place) for r in got) == sorted(
        (r.mix_place.slot, r.mix_place.place) for r in M.mix(df.select("doc_id", "source"), block_rows=3).collect())


def test_query_and_no_python_in_plan(spark):
    from riskloom.llm.registry import queries
    sf = "/root/testdata/sf0.001"
    df = queries()["op1_mixing"](spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
