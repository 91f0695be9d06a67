"""The pipeline against a brute-force version on a small corpus."""

import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
import test_quality_rules as TQ
import test_secret_scan as TS
import test_shingle_join as TJ
from riskloom.llm import secret_scan as S
from riskloom.llm.common import written
from riskloom.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.choice([25, 60, 120])) for _ in range(12)]
    rows = []
    for i in range(45):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 9])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), 'token = "%040x"' % rng.getrandbits(160))
        if i % 7 == 0:
            w.insert(3, "Zk9abCdeF0123ghIJklMN45%02d" % i)
        if i % 11 == 0:
            w = w[:6] * 9
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), rng.choice(["a", "b", None])))
    rows += [(90, None, "en", "a"), (91, "", None, "b"), (92, "too short", "en", "a"), rows[4], (5, rows[9][1], "en", "b")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def test_stages_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "secrets", "mixing", "tokens"]
    key = lambda xs: sorted(map(tuple, xs), key=repr)

    def run(name, df):
        out = written(stages[name](spark, df, None), name)
        if name != "tokens":
            assert out.columns == docs.columns
        return out
    # groups are too small to be judged together, so the base rules decide
    want = [r for r in rows if not TQ.brute(r[1])[5]]
    docs1 = run("quality_rules", docs)
    assert key(docs1.collect()) == key(want) and len(want) < len(rows)
    comp = {i: c for i, _, c in TJ.brute([(r[0], r[1]) for r in want], 5, 80)}
    want = [r for r in want if comp[r[0]] == r[0]]
    docs2 = run("near_duplicates", docs1)
    assert key(docs2.collect()) == key(want) and len(want) < docs1.count()
    live = TS.live_values([(t, s, lang) for _, t, lang, s, _ in want])
    masked = []
    for i, t, lang, s, _ in want:
        out, at = "", 0
        for x in sorted(TS.base(t) + [x for x in TS.others(t) if x[4] in live]):
            if x[0] >= at:
                out += t[at:x[0]] + S.MASK
            at = max(at, x[2])
        out += t[at:]
        masked.append((i, out, lang, s, len(out)))
    docs3 = run("secrets", docs2)
    assert key(docs3.collect()) == key(masked) and masked != want
    docs4 = run("mixing", docs3)
    assert key(docs4.collect()) == key(masked)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_padding()
    lib.no_truncation()
    got = run("tokens", docs4).collect()
    assert key((r.doc_id, r.n_tokens, r.ids) for r in got) == key(
        (i, len(e), e) for i, e in ((r[0], lib.encode(r[1], add_special_tokens=False).ids) for r in masked))


def test_mixture_reaches_the_last_rows(spark):
    sizes = {"hot": 200, "b": 50, None: 20}
    rows = [(k * 1000 + i, f"text {i}", "en", s, 9) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(7, "other text", "en", "hot", 9), rows[3]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((r.doc_id, r.mix_place.slot, r.mix_place.place) for r in mix(docs).collect())
    stages = dict(P.STAGES)
    mixed = written(stages["mixing"](spark, docs, None), "mixing")
    got = written(stages["tokens"](spark, mixed, None), "tokens").collect()
    assert sorted((r.doc_id, r.slot, r.place) for r in got) == want
    source = {r[0]: r[3] for r in rows}
    slots = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.slot, r.place)):
        slots[r.slot].append(r)
    assert sorted(slots) == list(range(len(slots)))
    order = [source[slots[t][0].doc_id] for t in range(len(slots))]
    assert all({source[r.doc_id] for r in slots[t]} == {s} for t, s in enumerate(order))


def test_credential_of_two_sources_is_masked(spark):
    two, three = "Zk9abCdeF0123ghIJklMN4501", "Zk9abCdeF0123ghIJklMN4502"
    rows = [(i, f"key {v} {i}", "en", s, 9) for i, (v, s) in enumerate(
        [(two, "a"), (two, "b"), (three, "a"), (three, "b"), (three, None)])]
    got = {r.doc_id: r.text for r in P.secrets(spark, spark.createDataFrame(rows, SCHEMA), None).collect()}
    assert got == {i: f"key {S.MASK} {i}" if i < 2 else f"key {three} {i}" for i in range(5)}


CLASHES = ["row", "name", "gone", "id", "hash", "spans", "of_id", "of_hash", "s", "h", "b", "r", "i", "cs", "cb", "n", "offset", "part",
           "parts", "share", "own_source", "block", "period", "slot", "place", "rank", "release", "due", "__row", "__id", "__hash", "__spans",
           "__s", "__h", "__b", "__r", "__block", "__part", "value_hash", "text_hash", "base", "other", "owner", "repo", "g", "d2", "kept",
           "component_id", "n_shingles", "ids", "sizes", "words", "codes", "mix_place", "source.name"]


def test_clashing_columns_pass_every_stage(spark):
    rows = corpus()
    schema = SCHEMA + ", " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame([(*r, *[f"{c}-{r[0]}" for c in CLASHES]) for r in rows], schema).repartition(3)
    plain = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, stage in P.STAGES:
        docs, plain = (written(stage(spark, d, None), name) for d in (docs, plain))
        if name == "tokens":
            assert sorted(map(tuple, docs.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
            break
        assert docs.columns[:5] == plain.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        assert docs.columns[5:] == CLASHES
        got = docs.collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        assert all(tuple(r)[5:] == tuple(f"{c}-{r[0]}" for c in CLASHES) for r in got)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, None), name)
        assert docs.count() == 0
