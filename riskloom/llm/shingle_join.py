r"""Jaccard join of word n-gram sets by signature trees.

A document's set holds its distinct word shingles, as 64-bit hashes.  Every
set has a signature: a bitmap of its shingles and its size.  A signature tree
groups signatures into nodes with OR-combined bitmaps and size ranges; walking
a tree against another one drops each pair of nodes whose greatest possible
overlap is below what the threshold asks of their smallest sizes.  Two sets
overlap in at most the bits they share plus the shingles beyond one per bit.

1. Subtrees: a set goes below the keys of its prefix, the ``n - ceil(t n) + 1``
   shingles that come first in a fixed order; sets that link share one.  The
   order puts shingles last that are frequent in a bounded sample; it affects
   work, never results.  Keys with equal members count once.
2. The tree of each key gives candidate groups (connected survivors).  Keys
   with very many sets join all of them without looking; the next step decides.
3. Inside a candidate group the sets themselves are compared, again by
   trees; pairs already connected are passed over.  Large groups first
   meet some of their own members, which connects almost all of them; those
   that stay apart are compared with the whole group, in blocks.
4. Components over the found links give the class of every document.

Equal sets of one task's input are one unit from the start, so groups of exact
copies cost next to nothing, and no list of pairs is ever written.

Results for special cases: null or empty text, or text without words, has an
empty set and links with nothing; shorter texts than a shingle are one
shingle; rows that share an id pool their links; a null id links with nothing
and has no class; extra columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed, register, table, text_of, written
from riskloom.llm.components import components

WIDTH, PERCENT = 4, 85
LEAST_BITS, MOST_BITS = 256, 8192  # of signatures below keys; between, the power of two from the set size on
SAMPLE_DOCS = 10_000    # documents, about, from which frequent shingles are learnt
SAMPLE_SHINGLES = 65_536
HOT_KEY = 4_096         # sets below one key; beyond, all are joined at once
BLOCK = 1_024           # sets of a candidate group on either side of a task
HUBS = 32               # members of a large group that meet all others first
BROADCAST_ROWS = 2_000_000  # rows of two longs that may be sent to all tasks; beyond, a shuffled join
FANOUT = 32

_WORDS_KEPT = 500_000


class _WordHashes(dict):
    def __missing__(self, w):
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[w] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = min(width, len(w))
    out = np.full(len(h) - n + 1, n if n < width else 0, np.uint64)
    for i in range(n):
        out = _mixed(out + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        at = np.zeros(bits, np.bool_)
        at[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(at)
    return out.view(np.uint64)


def signature_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n - 1).bit_length()))


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps at half their length: shingles keep their low bits."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def _need(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    total = percent * (a + b)
    return -(-total // (100 + percent))


class SignatureTree:
    """Signatures in nodes of ``FANOUT``, level upon level; the last level has
    few nodes.  ``sizes`` and ``bits`` are of the leaves in tree order."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        sizes, bits = sizes[self.order], bits[self.order]
        extra = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels[-1][1]) > FANOUT:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))


def _possible(a, ia, b, ib, percent: int) -> np.ndarray:
    """Whether nodes ia of level a and ib of level b may hold a linked pair."""
    out = np.empty(len(ia), np.bool_)
    for s in range(0, len(ia), 4096):
        x, y = ia[s:s + 4096], ib[s:s + 4096]
        most = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1).astype(np.int64) + np.minimum(a[3][x], b[3][y])
        most = np.minimum(most, np.minimum(a[2][x], b[2][y]))
        out[s:s + 4096] = most >= _need(np.maximum(a[1][x], -(-percent * b[1][y] // 100)),
                                        np.maximum(b[1][y], -(-percent * a[1][x] // 100)), percent)
    return out


def survivors(left: SignatureTree, right: SignatureTree, percent: int,
              differ=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: leaf pairs (numbers as given to the trees) that the
    bounds cannot rule out, in portions.  ``differ(i, j)`` may rule out more
    when its turn comes."""
    same = left is right
    top = max(len(left.levels), len(right.levels)) - 1

    def level(t, k):
        return t.levels[min(k, len(t.levels) - 1)]

    def children(t, k, nodes, n_below):
        if k > len(t.levels) - 1:
            return nodes, np.arange(len(nodes))
        first = nodes * FANOUT
        count = np.minimum(first + FANOUT, n_below) - first
        return np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)), np.repeat(
            np.arange(len(nodes)), count)

    a, b = level(left, top), level(right, top)
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(len(a[1])), np.arange(len(b[1])), indexing="ij"))
    stack = [(top, ia, ib)]
    while stack:
        k, ia, ib = stack.pop()
        if len(ia) > 20_000:
            half = len(ia) // 2
            stack += [(k, ia[half:], ib[half:]), (k, ia[:half], ib[:half])]
            continue
        if same:
            keep = ia <= ib if k else ia < ib
            ia, ib = ia[keep], ib[keep]
        if k == 0:
            i, j = left.order[ia], right.order[ib]
            if differ is not None and len(i):
                keep = differ(i, j)
                ia, ib, i, j = ia[keep], ib[keep], i[keep], j[keep]
            keep = _possible(left.levels[0], ia, right.levels[0], ib, percent)
            if keep.any():
                yield i[keep], j[keep]
            continue
        keep = _possible(level(left, k), ia, level(right, k), ib, percent)
        ia, ib = ia[keep], ib[keep]
        if not len(ia):
            continue
        ca, pa_ = children(left, k, ia, len(level(left, k - 1)[1]))
        cb, at = children(right, k, ib[pa_], len(level(right, k - 1)[1]))
        stack.append((k - 1, ca[at], cb))


def _connect(low: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest-number labels after also connecting u and v pairwise."""
    while True:
        new = low.copy()
        least = np.minimum(low[u], low[v])
        np.minimum.at(new, low[u], least)
        np.minimum.at(new, low[v], least)
        new = new[new]
        new = np.minimum(new, new[low])
        if (new == low).all():
            return low
        low = new


# ------------------------------------------------------------ Spark jobs
def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in three or more documents of a sample of about
    ``SAMPLE_DOCS`` (by hash of the id), the most frequent ``SAMPLE_SHINGLES``,
    with their counts.  Only the order of keys depends on it."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_DOCS / max(n, 1))))

    def read(batches):
        words = _WordHashes()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x, width, words).view(np.int64))], names=["s"])
    top = (some.select("text").mapInArrow(read, "s long").groupBy("s").count().where("count >= 3")
           .orderBy(F.desc("count"), "s").limit(SAMPLE_SHINGLES).collect())
    top.sort(key=lambda r: np.uint64(r.s & 0xFFFFFFFFFFFFFFFF))
    return (np.array([r.s for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64))


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, unit, prefix, bits): ``unit`` is the id of the task's first
    row with the same set, which alone has prefix and bitmap."""
    frequent, counts = frequent_shingles(docs, width)
    types = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("unit", pa.int64()),
                       ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, units = _WordHashes(), {}
        for batch in batches:
            out = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(x, width, words)
                row = {"doc_id": doc_id, "n": len(s), "unit": None, "prefix": None, "bits": None}
                if len(s) and doc_id is not None:
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    first = digest not in units
                    row["unit"] = units.setdefault(digest, doc_id)
                    if first:
                        take = len(s) - (percent * len(s) + 99) // 100 + 1
                        common = np.zeros(len(s), np.int64)
                        if len(frequent):
                            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                            hit = frequent[at] == s
                            common[hit] = counts[at[hit]]
                        row["prefix"] = s[np.argsort(common, kind="stable")[:take]].view(np.int64)
                        row["bits"] = bitmaps([s], signature_bits(len(s))).tobytes()
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=types)
    return docs.mapInArrow(read, "doc_id long, n long, unit long, prefix array<long>, bits binary")


def _sent(df: DataFrame) -> DataFrame:
    """``df`` (checkpointed, a few longs a row) marked for broadcast where its
    counted size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key_links(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, id, n, bits), sorted by token in each partition, as links
    (a, b) that connect what survives below each token."""
    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def stacked(bits, rows):
            return np.frombuffer(b"".join(bits[rows].tolist()), np.uint64).reshape(len(rows), -1)

        def level(n, bits):
            return bits, n, n, n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)

        def pairs(first, n, bits, width):
            """Which of the pairs (first, first + 1) may link."""
            ok = np.zeros(len(first), np.bool_)
            wide, narrow = np.maximum(width[first], width[first + 1]), np.minimum(width[first], width[first + 1])
            for w in np.unique(narrow):
                for twice in (False, True):
                    at = np.flatnonzero((narrow == w) & (wide == (2 * w if twice else w)))
                    if not len(at):
                        continue
                    low = np.where(width[first[at]] == w, first[at], first[at] + 1)
                    high = 2 * first[at] + 1 - low
                    x, y = stacked(bits, low), stacked(bits, high)
                    y = folded(y) if twice else y
                    k = np.arange(len(at))
                    ok[at] = _possible(level(n[low], x), k, level(n[high], y), k, percent)
            return ok

        def links(token, ids, n, bits):
            width = np.fromiter(map(len, bits), np.int64, len(bits))
            cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            two = two[pairs(two, n, bits, width)]
            a, b = [ids[two]], [ids[two + 1]]
            for s, m in zip(cuts[:-1][size > 2], size[size > 2], strict=True):
                low = np.arange(m)
                # sets that link have sizes within a factor of two: their
                # bitmaps are of equal length, or one is folded once
                for w in np.unique(width[s:s + m]):
                    own = np.flatnonzero(width[s:s + m] == w)
                    above = np.flatnonzero(width[s:s + m] == 2 * w)
                    tree = SignatureTree(n[s + own], stacked(bits, s + own))
                    for i, j in survivors(tree, tree, percent, lambda i, j: low[own[i]] != low[own[j]]):  # noqa: B023
                        low = _connect(low, own[i], own[j])
                    if len(above):
                        other = SignatureTree(n[s + above], folded(stacked(bits, s + above)))
                        for i, j in survivors(tree, other, percent, lambda i, j: low[own[i]] != low[above[j]]):  # noqa: B023
                            low = _connect(low, own[i], above[j])
                moved = np.flatnonzero(low != np.arange(m))
                a.append(ids[s:s + m][moved])
                b.append(ids[s:s + m][low[moved]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=types)
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.empty(batch.num_rows, dtype=object)
            bits[:] = batch.column(3).to_pylist()
            got = [batch.column(i).to_numpy() for i in range(3)] + [bits]
            if held is not None:
                got = [np.concatenate(x) for x in zip(held, got, strict=True)]
            last = np.searchsorted(got[0], got[0][-1])  # the last token may go on in the next batch
            held = [x[last:] for x in got]
            if last:
                yield links(*[x[:last] for x in got])
        if held is not None:
            yield links(*held)
    return rows.mapInArrow(walk, "a long, b long")


def candidate_links(sigs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) whose components hold every linked pair of units."""
    units = sigs.where("prefix IS NOT NULL").select(F.col("doc_id").alias("id"), "n", "prefix", "bits")
    # ids with several units: a key's hash is that of a set only where each of
    # its ids is there once, and equal signatures of an id are one
    shared = checkpointed(units.groupBy("id").agg(F.count("*").alias("n_units"), F.count_distinct(
        F.xxhash64("n", "bits")).alias("rows")).where("n_units > 1").select("id", "rows"))
    sides = units.select("id", "n", "bits")
    keys = units.select(F.explode("prefix").alias("token"), "id", F.lit(1).cast("long").alias("rows"))
    if not shared.isEmpty():
        few = _sent(shared)
        alone, more = units.join(few, "id", "left_anti"), units.join(few, "id")
        sides = alone.select("id", "n", "bits").union(more.select("id", "n", "bits").distinct())
        keys = alone.select(F.explode("prefix").alias("token"), "id", F.lit(1).cast("long").alias("rows")).union(
            more.select(F.explode("prefix").alias("token"), "id", "rows").distinct())
    kept = (keys.groupBy("token").agg(F.count("*").alias("ids"), F.sum("rows").alias("members"),
                                      F.bit_xor(F.xxhash64("id")).alias("who"))
            .where("ids > 1").groupBy("ids", "who").agg(F.min(F.struct("token", "members")).alias("key")).select("key.*"))
    kept = checkpointed(kept)
    below = checkpointed(keys.drop("rows").join(_sent(kept), "token"))
    hot = below.where(F.col("members") > HOT_KEY).select("token", "id")
    below = below.where(F.col("members") <= HOT_KEY)
    rows = below.join(sides, "id").select("token", "id", "n", "bits")
    n_parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _key_links(rows.repartition(n_parts, "token").sortWithinPartitions("token"), percent)
    first = hot.groupBy("token").agg(F.min("id").alias("b"))
    return found.union(hot.join(first, "token").select("id", "b")).distinct()


def _verified(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (grp, i, j, side, id, label, text), one task a key (grp, i, j), as
    links between ids of side 0 and side 1 that connect different labels."""
    types = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(t: pa.Table) -> pa.Table:
        words = _WordHashes()
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        sets = [shingle_set(x.as_py(), width, words) for x in t["text"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = bitmaps(sets, max(64, min(1 << 15, 1 << (2 * int(sizes.max())).bit_length())))
        parts = [np.flatnonzero(side == s) for s in (0, 1)]
        alone = len(parts[0]) == 0 or len(parts[1]) == 0
        if alone:
            parts = [np.arange(len(ids))] * 2
        _, low = np.unique(t["label"].to_numpy(), return_inverse=True)
        first = np.full(low.max() + 1, len(ids))
        np.minimum.at(first, low, np.arange(len(ids)))
        low = first[low]                      # label: first row of the same component
        root = low.tolist()

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x
        trees = [SignatureTree(sizes[p], bits[p]) for p in (parts[:1] * 2 if alone else parts)]
        if alone:
            trees[1] = trees[0]
        a, b = [], []

        def differ(i, j):
            now = np.array([find(x) for x in range(len(ids))])
            return now[parts[0][i]] != now[parts[1][j]]
        for i, j in survivors(trees[0], trees[1], percent, differ):
            for x, y in zip(parts[0][i].tolist(), parts[1][j].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx == ry:
                    continue
                s, big = (sets[x], sets[y]) if len(sets[x]) < len(sets[y]) else (sets[y], sets[x])
                at = np.minimum(np.searchsorted(big, s), len(big) - 1)
                both = int((big[at] == s).sum())
                if 100 * both >= percent * (len(s) + len(big) - both):
                    root[max(rx, ry)] = min(rx, ry)
                    a.append(ids[x])
                    b.append(ids[y])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=types)
    return rows.groupBy("grp", "i", "j").applyInArrow(check, "a long, b long")


def verified_links(docs: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect the linked units of each candidate group.  ``docs``
    (doc_id, text), ``groups`` (id, grp)."""
    sized = checkpointed(groups.join(groups.groupBy("grp").agg(F.count("*").alias("size")), "grp"))
    texts = written(docs.join(_sent(sized), docs["doc_id"] == sized["id"]).select("grp", "size", "id", "text"), "candidates")
    zero = F.lit(0)
    small = texts.where(F.col("size") <= BLOCK).select(
        "grp", zero.alias("i"), zero.alias("j"), zero.alias("side"), "id", F.col("id").alias("label"), "text")
    found = _verified(small, width, percent)
    large = sized.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return found
    # hubs: the members with the smallest hashes; a cut by hash bounds the list
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    big = texts.where(F.col("size") > BLOCK)
    h = F.xxhash64("id", F.lit(1))
    share = F.least(F.lit(1.0), 4.0 * HUBS / F.col("size"))
    near = large.where(h / float(2 ** 64) + 0.5 <= share).groupBy("grp").agg(F.slice(F.array_sort(
        F.collect_list(F.struct(h.alias("h"), "id"))), 1, HUBS).alias("top"))
    hub_ids = checkpointed(near.select("grp", F.explode("top.id").alias("id")))
    hubs = big.join(_sent(hub_ids), ["grp", "id"]).select(
        "grp", F.explode(F.sequence(zero, n - 1)).alias("i"), zero.alias("j"), zero.alias("side"), "id",
        F.col("id").alias("label"), "text")
    others = big.select("grp", own.alias("i"), zero.alias("j"), F.lit(1).alias("side"), "id", F.col("id").alias("label"), "text")
    links = checkpointed(_verified(hubs.union(others), width, percent))
    labels = checkpointed(large.select("grp", "id").join(components(links), "id", "left").select(
        "grp", "id", F.coalesce("component", "id").alias("label")))
    main = labels.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    known = labels.join(main, "grp")
    apart = known.where("label <> main").groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_apart"))
    known = checkpointed(known.join(apart, "grp").select("grp", "id", "label", "main", "n_apart"))
    rows = big.join(_sent(known), ["grp", "id"])
    left = rows.where("label <> main").select(
        "grp", F.pmod(F.xxhash64("id"), F.col("n_apart")).cast("int").alias("i"),
        F.explode(F.sequence(zero, n - 1)).alias("j"), zero.alias("side"), "id", "label", "text")
    right = rows.select("grp", F.explode(F.sequence(zero, F.col("n_apart") - 1)).alias("i"), own.alias("j"),
                        F.lit(1).alias("side"), "id", "label", "text")
    return found.union(links).union(_verified(left.union(right), width, percent))


def near_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``,
    the smallest id that links reach."""
    rows = text_of(docs, id_col, text_col)
    sigs = checkpointed(signatures(rows, width, percent))
    groups = components(candidate_links(sigs, percent)).select("id", F.col("component").alias("grp"))
    links = verified_links(rows, groups, width, percent)
    copies = sigs.where("unit <> doc_id").select(F.col("doc_id").alias("a"), F.col("unit").alias("b"))
    comp = components(links.union(copies))
    return sigs.select("doc_id", F.col("n").alias("n_shingles")).join(comp, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE_SQL = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_transform(
    range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END) AS g FROM w WHERE len(w) > 0),
  n AS (SELECT rid, doc_id, count(g) AS n FROM w LEFT JOIN s USING (rid) GROUP BY rid, doc_id),
  p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.rid <> b.rid GROUP BY a.rid, b.rid),
  l AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b
    WHERE 100 * c >= {PERCENT} * (x.n + y.n - c) AND x.doc_id <> y.doc_id),
  reach(doc_id, low) AS (
    SELECT DISTINCT doc_id, doc_id FROM documents
    UNION
    SELECT l.b, reach.low FROM reach JOIN l ON l.a = reach.doc_id WHERE reach.low < l.b),
  c AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
  SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n LEFT JOIN c ON c.doc_id = n.doc_id"""


@register("op10_shingle_join", ORACLE_SQL)
def q_shingle_join(spark, sf_dir):
    return near_documents(table(spark, sf_dir, "documents"))
