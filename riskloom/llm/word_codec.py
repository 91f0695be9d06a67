"""BPE encoding and decoding through a table of distinct words.

1. Splitting: each task packs documents into blocks of about 6 million
   characters and numbers the block's distinct words in the order of a hash; a
   document becomes a run of word numbers.  Blocks are written once, bucketed
   by block.
2. The hash cuts every block's words into ranges, their number counted from the
   words' bytes.  A (range, block) is one packed row, so a frequent word is
   there once a block, and a range's distinct words meet in one task, which
   reads the packed rows one after another and encodes each word once.
3. A packed row goes back to its block as the packed ids of its words.  Ranges
   in order are the words in the order of their numbers, so each block replaces
   word numbers by ids, position by position.
4. Decoding joins ids to the pieces of the vocabulary (whose size is fixed)
   and strings them together as the library does.

Results for special cases: null text counts as empty (no ids, decoded text
empty); special strings inside a text become their special id; a null doc_id
is kept; repeated rows give repeated rows; a very long word is one word; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.byte_pieces import to_alphabet, vocabulary
from riskloom.llm.common import bucketed, register, shuffle_partitions, table, text_of

BLOCK_CHARS = 6 << 20
RANGE_BYTES = 64 << 20    # packed words of a hash range, about
TABLE_WORDS = 500_000     # distinct words a task holds with their ids; the table is emptied beyond
SLICE_WORDS = 250_000     # words whose ids are put in place at once, if a document has no more
SLICE_ROWS = 500          # documents decoded at once

BLOCK_SCHEMA = "block long, ids array<long>, sizes array<int>, words binary, codes binary"


def packed(lens: list[int] | np.ndarray, body: bytes) -> bytes:
    """Lengths and what they cut, compressed."""
    head = np.asarray(lens, np.int32)
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(head)).tobytes() + head.tobytes() + body)


def unpacked_parts(blob: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int32, n, 8), data[8 + 4 * n:]


def cut_words(blob: bytes) -> list[bytes]:
    lens, body = unpacked_parts(blob)
    ends = np.cumsum(lens, dtype=np.int64).tolist()
    return [body[e - n:e] for e, n in zip(ends, lens.tolist(), strict=True)]


def word_blocks(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per block: its documents, their numbers of words, its distinct
    words by hash, packed, the word numbers of all documents in order, and the
    documents' ``carry`` columns."""
    types = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                       ("words", pa.binary()), ("codes", pa.binary()),
                       *[(c, pa.list_(pa.int64())) for c in carry]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, block = vocabulary(path), TaskContext.get().partitionId() << 32
        ids, sizes, codes, words, chars, kept = [], [], array("i"), {}, 0, [[] for _ in carry]

        def full():
            raw = [w.encode() for w in words]
            order = np.argsort(np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)), kind="stable")
            number = np.empty(len(raw), np.int32)
            number[order] = np.arange(len(raw), dtype=np.int32)
            raw = [raw[i] for i in order.tolist()]
            body = zstandard.ZstdCompressor(level=3).compress(number[np.frombuffer(codes, np.int32)].tobytes())
            return pa.RecordBatch.from_pylist([{
                "block": block, "ids": ids, "sizes": sizes, "words": packed([len(w) for w in raw], b"".join(raw)),
                "codes": body, **dict(zip(carry, kept, strict=True))}], schema=types)
        for batch in batches:
            for doc_id, text, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                before = len(codes)
                for i, segment in enumerate(voc.segments(text)):
                    found = [segment] if i % 2 else voc.pieces(segment)
                    codes.extend([words.setdefault(w, len(words)) for w in found])
                ids.append(doc_id)
                sizes.append(len(codes) - before)
                for values, value in zip(kept, more, strict=True):
                    values.append(value)
                chars += len(text)
                if chars >= block_chars:
                    yield full()
                    block += 1
                    ids, sizes, codes, words, chars, kept = [], [], array("i"), {}, 0, [[] for _ in carry]
        if ids:
            yield full()
    return docs.mapInArrow(pack, ", ".join([BLOCK_SCHEMA, *[f"{c} array<long>" for c in carry]]))


def hash_ranges(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """A block's words as one packed row per hash range that has some."""
    types = pa.schema([("range", pa.int32()), ("of", pa.int64()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = cut_words(blob)
                hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
                own = (hashes * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int32)
                found, first = np.unique(own, return_index=True)
                ends = [*first[1:].tolist(), len(words)]
                rows = [packed([len(w) for w in words[i:j]], b"".join(words[i:j])) for i, j in zip(first.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block] * len(rows), pa.int64()),
                                                  pa.array(rows, pa.binary())], schema=types)
    return blocks.select("block", "words").mapInArrow(cut, "range int, of long, words binary")


def range_ids(ranges: DataFrame, path: str) -> DataFrame:
    """Packed ids of the words of every (range, block); rows of a range are in
    one task, which encodes a distinct word once."""
    types = pa.schema([("range", pa.int32()), ("of", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        model, special = voc.library.model, {w.encode(): i for w, i in voc.special.items()}
        table: dict[bytes, tuple[int, ...]] = {}

        def ids_of(word: bytes) -> tuple[int, ...]:
            if len(table) >= TABLE_WORDS:
                table.clear()
            ids = (special[word],) if word in special else tuple(t.id for t in model.tokenize(to_alphabet(word)))
            table[word] = ids
            return ids
        for batch in batches:
            rows = []
            for blob in batch.column(2).to_pylist():
                got = [table.get(w) or ids_of(w) for w in cut_words(blob)]
                flat = array("i", [i for ids in got for i in ids])
                rows.append(packed([len(ids) for ids in got], flat.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], schema=types)
    return ranges.mapInArrow(work, "range int, of long, ids binary")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, its ``ids`` and its ``carry`` columns
    (long)."""
    blocks = bucketed(word_blocks(text_of(docs, id_col, text_col, *carry), path, block_chars, carry), "block", "word_blocks")
    total = blocks.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_ranges = max(shuffle_partitions(docs.sparkSession), -(-total // RANGE_BYTES))
    coded = range_ids(hash_ranges(blocks, n_ranges).repartition(n_ranges, "range"), path)
    types = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *[(c, pa.int64()) for c in carry]])

    def place(block: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        parts = [unpacked_parts(x.as_py()) for x in words.sort_by("range")["ids"]]
        lens = np.concatenate([n for n, _ in parts] or [np.empty(0, np.int32)]).astype(np.int64)
        flat = np.concatenate([np.frombuffer(body, np.int32) for _, body in parts] or [np.empty(0, np.int32)])
        starts = np.cumsum(lens) - lens
        for row in block.to_pylist():
            codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), dtype=np.int32)
            if len(codes) and codes.max() >= len(lens):
                raise ValueError("a block's word table is not whole")
            ends = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
            i = 0
            while i < len(row["ids"]):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_WORDS, "right")) - 1)
                own = codes[ends[i]:ends[j]]
                after = np.cumsum(lens[own])
                take = np.arange(after[-1] if len(after) else 0) + np.repeat(starts[own] - (after - lens[own]), lens[own])
                cuts = np.concatenate([[0], after])[ends[i:j + 1] - ends[i]]
                out.append(pa.table([pa.array(row["ids"][i:j], pa.int64()),
                                     pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat[take])),
                                     *[pa.array(row[c][i:j], pa.int64()) for c in carry]], schema=types))
                i = j
        return pa.concat_tables(out) if out else types.empty_table()
    return (blocks.select("block", "ids", "sizes", "codes", *carry).groupBy("block").cogroup(coded.groupBy("of"))
            .applyInArrow(place, ", ".join(["doc_id long, ids array<int>", *[f"{c} long" for c in carry]])))


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids: each id's piece, joined as the
    library's ``decode(ids, skip_special_tokens=False)`` joins them (by one
    space, as the vocabulary has no decoder).  Null ids give null."""
    schema = coded.drop(out_col).schema.add(out_col, "string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        named = {**voc.vocab, **voc.special}
        pieces = np.full(max(named.values()) + 1, None, dtype=object)
        for piece, i in named.items():
            pieces[i] = piece
        pieces = pa.array(pieces, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = part.column(part.schema.get_field_index(ids_col))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(), dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                text = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(pieces, ids.flatten())), " ")
                text = pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, out_col])
    return coded.drop(out_col).mapInArrow(join, schema)


@register("op3_word_codec")
def q_word_codec(spark, sf_dir):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
