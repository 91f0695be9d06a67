"""Removal of byte strings that an earlier document has, by suffix sorting.

A byte goes when some ``LENGTH``-byte string covers it that also starts in a
document with a smaller id.  Sorting every suffix of the corpus is not needed
for that: each string is decided at its anchor, the start of the shingle of
``ANCHOR`` bytes in it whose hash is smallest (the first, in ties).  Equal
strings have equal anchors at equal places, and about one position in sixteen
is one.

1. Documents are packed into blocks with the places of their anchors, written
   once, bucketed by block.
2. Hashes of all anchors go to buckets, sorted and packed; a bucket answers
   which of them occur in several documents.
3. Only those anchors send their context, the bytes around them that their
   strings cover.  Contexts of a bucket are sorted as suffixes (to the right
   of the anchor, and to the left backwards) by deep-shallow sorting.  Two
   strings at offset j are equal when the common prefixes to the left and
   right reach j and LENGTH - j, so classes of equal strings fall out of the
   two orders; the smallest id of a class decides.
4. Blocks remove what is decided.

Equal contexts of a block are sent once.  Anchors with very many occurrences
send one row per string, keyed by the string, so that no key gathers more than
a row per block.  Comparisons are of bytes; hashes only bring rows together.

Results for special cases: null text counts as empty; a null id counts as
larger than any (such rows lose what others have, and take nothing); rows that
share an id never remove from each other; extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bucketed, checkpointed, register, shuffle_partitions, table, text_of
from riskloom.llm.suffix_sort import deep_shallow

LENGTH, ANCHOR = 50, 20
SPAN = LENGTH - ANCHOR + 1     # shingles of a string
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20        # bytes of text for which a bucket of hashes and contexts is added
HOT = 100_000                  # occurrences of an anchor's shingle from which strings are keyed one by one
NO_ID = np.iinfo(np.int64).max


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))


def _byte_hash(buf: np.ndarray) -> np.ndarray:
    h = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hash_at(buf: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``_rolling(buf, k)[at]``, worked out at these positions only."""
    of = _byte_hash(np.arange(256, dtype=np.uint8))
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h *= _powers(1)
        h += of[buf[at + i]]
    return _mixed(h)


def _rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from every position, by doubling lengths."""
    h = _byte_hash(buf)
    out, done, size = None, 0, 1
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:
                n = len(h) - done
                out, done = out[:n] * _powers(size) + h[done:], done + size
        if done == k:
            break
        n = len(h) - size
        h, size = h[:n] * _powers(size) + h[size:], size * 2
    return _mixed(out)


def _sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each w values."""
    size = 1
    while size * 2 <= w:
        a = f(a[:len(a) - size], a[size:])
        size *= 2
    rest = w - size
    return f(a[:len(a) - rest], a[rest:]) if rest else a


def anchors(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors that own strings of the packed documents (which begin at
    ``starts``): position, first and last start of their strings."""
    n = len(buf) - LENGTH + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none
    h = _rolling(buf, ANCHOR)
    low = _sliding(h, SPAN, np.minimum)                        # of each string
    inside = np.ones(n, np.bool_)                              # strings within one document
    for s in np.append(starts[1:], len(buf)):
        inside[max(0, s - LENGTH + 1):s] = False
    # runs of strings with one smallest hash
    edge = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])])
    run_end = np.append(edge[1:], n) - 1
    run_of = np.cumsum(np.bincount(edge, minlength=n)) - 1
    # positions that are smallest in some string
    top = np.concatenate([np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)])
    at = np.flatnonzero(_sliding(top, SPAN, np.maximum)[:len(h)] == h)
    # a string belongs to the first position with its smallest hash: those with
    # the same hash and run share the run in turn
    r_last = run_of[np.minimum(at, n - 1)]
    r_first = run_of[np.maximum(at - SPAN + 1, 0)]
    out = []
    depth = int((r_last - r_first).max()) + 1 if len(at) else 0
    for back in range(depth):
        r = r_last - back
        ok = (r >= r_first)
        p, r = at[ok], r[ok]
        ok = (low[edge[r]] == h[p]) & inside[edge[r]]
        out.append((p[ok], r[ok]))
    p = np.concatenate([x[0] for x in out]) if out else none
    r = np.concatenate([x[1] for x in out]) if out else none
    order = np.lexsort((p, r))
    p, r = p[order], r[order]
    before = np.where(np.r_[False, r[1:] == r[:-1]], np.r_[0, p[:-1]] + 1, 0)
    first = np.maximum(np.maximum(edge[r], before), p - SPAN + 1)
    last = np.minimum(run_end[r], p)
    ok = first <= last
    return p[ok], first[ok], last[ok]


def _pack(a: np.ndarray) -> bytes:
    """A sorted or small-valued array, byte planes of its differences."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Block:
    """Documents of one block: ids, bytes and anchors."""

    def __init__(self, row: dict):
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        self.null = [i is None for i in row["ids"]]
        self.sizes = np.array(row["sizes"], np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=int(self.sizes.sum()))
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.at = np.cumsum(_unpack(row["at"], np.int64))
        self.first = self.at - _unpack(row["first"], np.uint8)
        self.last = self.at - _unpack(row["last"], np.uint8)
        self.hash = _hash_at(self.buf, self.at, ANCHOR)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Ids of the documents at byte positions."""
        return self.ids[self.doc(at)]

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, whether in two documents, and counts."""
        kinds, place, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        own = self.owner(self.at)
        low = np.full(len(kinds), NO_ID)
        high = np.full(len(kinds), np.iinfo(np.int64).min)
        np.minimum.at(low, place, own)
        np.maximum.at(high, place, own)
        self.place = place
        return kinds, low != high, count

    def contexts(self, shared: np.ndarray, hot: np.ndarray):
        """Distinct contexts of shared anchors: (key, left, right, first, last
        offsets, smallest id), and for every anchor used its context."""
        use = shared[self.place]
        cold = use & ~hot[self.place]
        p, first, last, h = self.at[cold], self.first[cold], self.last[cold], self.hash[cold]
        rows = np.flatnonzero(use & hot[self.place])
        if len(rows):                                        # one row per string
            n = self.last[rows] - self.first[rows] + 1
            w = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = _rolling(self.buf, LENGTH)[w] ^ np.uint64(0x5851F42D4C957F2D)
            p, first, last, h = (np.concatenate(x) for x in ((p, w), (first, w), (last, w), (h, key)))
        left, right = p - first, last + LENGTH - p           # bytes before and from the anchor
        low = p - last                                       # least offset of a string
        width = SPAN - 1 + LENGTH
        m = np.zeros((len(p), width), np.uint8)              # left backwards, then right
        pad = np.concatenate([np.zeros(SPAN, np.uint8), self.buf, np.zeros(LENGTH, np.uint8)])
        back = SPAN + p[:, None] - 1 - np.arange(SPAN - 1)[None, :]
        m[:, :SPAN - 1] = np.where(np.arange(SPAN - 1)[None, :] < left[:, None], pad[back], 0)
        ahead = SPAN + p[:, None] + np.arange(LENGTH)[None, :]
        m[:, SPAN - 1:] = np.where(np.arange(LENGTH)[None, :] < right[:, None], pad[ahead], 0)
        own = self.owner(p)
        meta = np.stack([low, left], axis=1).astype(np.uint8)
        whole = np.concatenate([h.view(np.uint8).reshape(len(p), 8), meta, m], axis=1)
        flat = np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel()
        _, pick, place = np.unique(flat, return_index=True, return_inverse=True)
        least = np.full(len(pick), NO_ID)
        np.minimum.at(least, place, own)
        return {"h": h[pick], "low": meta[pick, 0], "left": meta[pick, 1], "m": m[pick], "id": least}, (p, own, place, least)


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    types = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                       ("body", pa.binary()), ("at", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def full():
            body, sizes = b"".join(texts), [len(x) for x in texts]
            at, first, last = anchors(np.frombuffer(body, np.uint8), np.cumsum([0, *sizes[:-1]]))
            return pa.RecordBatch.from_pylist([{
                "block": block, "ids": ids, "sizes": sizes, "body": zstandard.ZstdCompressor(level=3).compress(body),
                "at": _pack(np.diff(at, prepend=0)), "first": _pack((at - first).astype(np.uint8)),
                "last": _pack((at - last).astype(np.uint8))}], schema=types)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text.encode())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield full()
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield full()
    return docs.mapInArrow(
        pack, "block long, ids array<long>, sizes array<long>, body binary, at binary, first binary, last binary")


def _rows(t: pa.Table) -> list[dict]:
    return t.to_pylist()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray, buckets: int):
    """Rows of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[cuts[b]:cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def _sent_hashes(blocks: DataFrame, buckets: int) -> DataFrame:
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kinds, several, count = Block(row).hashes()
                for b, at in _parts(_bucket(kinds, buckets), buckets):
                    h = kinds[at]
                    yield pa.RecordBatch.from_pydict({
                        "bucket": [b], "block": [row["block"]], "hashes": [_pack(np.diff(h, prepend=np.uint64(0)))],
                        "several": [np.packbits(several[at]).tobytes()],
                        "count": [_pack(np.minimum(count[at], 1 << 30).astype(np.int32))]})
    return blocks.mapInArrow(send, "bucket long, block long, hashes binary, several binary, count binary")


def _shared(sent: DataFrame, hot_from: int) -> DataFrame:
    """For every block and bucket, which of its hashes occur in two documents,
    and which of them are hot."""
    types = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary()),
                       ("answer", pa.binary())])

    def join(t: pa.Table) -> pa.Table:
        hs, flags, counts, sizes = [], [], [], []
        for row in _rows(t):
            h = np.cumsum(_unpack(row["hashes"], np.uint64), dtype=np.uint64)
            hs.append(h)
            flags.append(np.unpackbits(np.frombuffer(row["several"], np.uint8))[:len(h)])
            counts.append(_unpack(row["count"], np.int32))
            sizes.append(len(h))
        kinds, place = np.unique(np.concatenate(hs), return_inverse=True)
        n_blocks = np.bincount(place)
        total = np.bincount(place, weights=np.concatenate(counts))
        several = np.bincount(place, weights=np.concatenate(flags)) > 0
        shared = ((n_blocks > 1) | several)[place]
        hot = (total >= hot_from)[place] & shared
        cuts = np.cumsum(sizes)[:-1]
        return pa.table([t["block"], t["bucket"], pa.array([np.packbits(x).tobytes() for x in np.split(shared, cuts)]),
                         pa.array([np.packbits(x).tobytes() for x in np.split(hot, cuts)]),
                         pa.nulls(t.num_rows, pa.binary())], schema=types)
    return sent.groupBy("bucket").applyInArrow(join, "block long, bucket long, shared binary, hot binary, answer binary")


def _marked(block: Block, told: list[dict], buckets: int):
    kinds, _, _ = block.hashes()
    shared, hot = np.zeros(len(kinds), np.bool_), np.zeros(len(kinds), np.bool_)
    by = {row["bucket"]: row for row in told if row["answer"] is None}
    for b, at in _parts(_bucket(kinds, buckets), buckets):
        row = by[b]
        shared[at] = np.unpackbits(np.frombuffer(row["shared"], np.uint8))[:len(at)]
        hot[at] = np.unpackbits(np.frombuffer(row["hot"], np.uint8))[:len(at)]
    return block.contexts(shared, hot)


def _sent_contexts(blocks: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    types = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()),
                       ("low", pa.binary()), ("left", pa.binary()), ("m", pa.binary()), ("id", pa.binary())])

    def send(mine: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in _rows(mine):
            ctx, _ = _marked(Block(row), _rows(answers), buckets)
            for b, at in _parts(_bucket(ctx["h"], buckets), buckets):
                out.append({"bucket": b, "block": row["block"], "n": len(at),
                            "low": _pack(ctx["low"][at]), "left": _pack(ctx["left"][at]),
                            "m": zstandard.ZstdCompressor(level=3).compress(ctx["m"][at].tobytes()),
                            "id": _pack(ctx["id"][at])})
        return pa.Table.from_pylist(out, schema=types)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        send, "bucket long, block long, n long, low binary, left binary, m binary, id binary")


def repeated_offsets(low: np.ndarray, left: np.ndarray, m: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every context a bit mask of the offsets j whose string a smaller id
    has too."""
    n, back = len(low), SPAN - 1
    mask = np.zeros(n, np.uint32)
    r_order, r_lcp = deep_shallow(np.ascontiguousarray(m[:, back:]))
    l_order, l_lcp = deep_shallow(np.ascontiguousarray(m[:, :back]))
    r_class, l_class = np.empty(n, np.int64), np.zeros(n, np.int64)
    for j in range(SPAN):
        own = np.flatnonzero((low <= j) & (j <= left))
        if not len(own):
            continue
        r_class[r_order] = np.cumsum(r_lcp < LENGTH - j)
        if j:
            l_class[l_order] = np.cumsum(l_lcp < j)
        both = r_class[own] * (n + 1) + l_class[own]
        order = np.argsort(both, kind="stable")
        both, held = both[order], ids[own][order]
        cuts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        least = np.repeat(np.minimum.reduceat(held, cuts), np.diff(np.append(cuts, len(both))))
        mask[own[order][least < held]] |= np.uint32(1 << j)
    return mask


def _decided(sent: DataFrame) -> DataFrame:
    types = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary()),
                       ("answer", pa.binary())])

    def sort(t: pa.Table) -> pa.Table:
        rows = _rows(t)
        get = lambda c, kind: np.concatenate([_unpack(r[c], kind) for r in rows])
        m = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["m"]) for r in rows), np.uint8)
        mask = repeated_offsets(get("low", np.uint8), get("left", np.uint8),
                                m.reshape(-1, SPAN - 1 + LENGTH), get("id", np.int64))
        cuts = np.cumsum([r["n"] for r in rows])[:-1]
        return pa.table([t["block"], t["bucket"], pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary()),
                         pa.array([_pack(x) for x in np.split(mask, cuts)])], schema=types)
    return sent.groupBy("bucket").applyInArrow(sort, "block long, bucket long, shared binary, hot binary, answer binary")


def _removed(block: Block, told: list[dict], buckets: int) -> np.ndarray:
    """Which bytes of a block go."""
    ctx, (p, own, place, least) = _marked(block, told, buckets)
    mask = np.zeros(len(ctx["h"]), np.uint32)
    by = {row["bucket"]: row for row in told if row["answer"] is not None}
    for b, at in _parts(_bucket(ctx["h"], buckets), buckets):
        mask[at] = _unpack(by[b]["answer"], np.uint32)
    low, left = ctx["low"][place].astype(np.int64), ctx["left"][place].astype(np.int64)
    later = own > least[place]                 # another document of the block has the whole context
    delta = np.zeros(len(block.buf) + 1, np.int32)
    for j in range(SPAN):
        hit = (low <= j) & (j <= left) & (later | ((mask[place] >> np.uint32(j)) & 1).astype(np.bool_))
        start = p[hit] - j
        np.add.at(delta, start, 1)
        np.add.at(delta, start + LENGTH, -1)
    return np.cumsum(delta[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                   hot: int = HOT) -> DataFrame:
    """One row per document: ``n_bytes``, ``n_removed``, removed ``spans``
    (start and end in bytes) and the bytes ``kept``."""
    spark = docs.sparkSession
    blocks = bucketed(blocks_of(text_of(docs, id_col, text_col), block_bytes), "block", "text_blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    told = checkpointed(_shared(_sent_hashes(blocks, buckets), hot))
    answers = _decided(_sent_contexts(blocks, told, buckets))
    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                       ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cut(mine: pa.Table, answer: pa.Table) -> pa.Table:
        out = []
        for row in _rows(mine):
            block = Block(row)
            gone = _removed(block, _rows(answer), buckets)
            for i, null, start, size in zip(block.ids.tolist(), block.null, block.starts.tolist(), block.sizes.tolist(), strict=True):
                g = gone[start:start + size]
                edges = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8))).reshape(-1, 2)
                body = block.buf[start:start + size]
                out.append({"doc_id": None if null else i, "n_bytes": size, "n_removed": int(g.sum()),
                            "spans": [{"start": a, "end": b} for a, b in edges.tolist()], "kept": body[~g].tobytes()})
        return pa.Table.from_pylist(out, schema=types)
    return blocks.groupBy("block").cogroup(told.union(answers).groupBy("block")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


ORACLE_SQL = f"""WITH h AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  win AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS w FROM (
    SELECT rid, doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM h)),
  m AS (SELECT w, min(doc_id) AS low FROM win GROUP BY w),
  dup AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM win JOIN m USING (w) WHERE low < doc_id),
  g AS (SELECT rid, i, sum(CASE WHEN i <= prev + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM dup),
  sp AS (SELECT rid, min(i) AS s, max(i) + {LENGTH} AS e FROM g GROUP BY rid, k),
  gap AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS pe FROM sp),
  k AS (SELECT rid, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last,
    string_agg(substr(h, 2 * pe + 1, 2 * (s - pe)), '' ORDER BY s) AS head FROM gap JOIN h USING (rid) GROUP BY rid)
  SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN k USING (rid)"""


@register("op4_suffix_dedup", ORACLE_SQL)
def q_suffix_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
