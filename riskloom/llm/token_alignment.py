"""Alignment of two tokenizers over a corpus, with corpus-wide link counts.

Both tokenizers cut the same bytes (a space and the text).  Places where both
end a token cut the tokens into groups; the last tokens of a group end together
and are linked.  A link that joins an A token and a B token of equal bytes is a
group of its own, and the identity map (A id -> B id of the same bytes) knows
its B id, so it is counted by A id alone.

1. Units.  Neither tokenizer joins a space to what stands before it (checked
   on the vocabularies; else the whole text is one unit), so texts are cut
   there and every unit is aligned once per block.  Blocks of about 8 million
   characters are written: a unit table, and each document as unit numbers.
2. Counts.  One-to-one groups are summed in vectors of the vocabulary's length;
   only the other, irregular links are exploded as (A id, B id) pairs and
   shuffled, one row per block and pair, so that no pair is hot.
3. The totals of its irregular links go back to each block, which adds up
   counts per document.  The vectors (one long per vocabulary entry) go with
   the tasks.

A group cannot hold more than one link: tokens have at least one byte.

Results for special cases: null or empty texts, and texts that the tokenizers
do not give back byte by byte (U+2581 in the text, say), have no tokens, no
counts and add nothing to the counts of others; special strings are plain text;
a text without spaces is one unit, however long; repeated rows give repeated
rows and count as often as they occur; a null doc_id is kept; ties for the
highest count are all the highest; extra columns, whatever their names, are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.byte_pieces import alphabet_bytes
from riskloom.llm.common import bucketed, checkpointed, register, table, text_of

BLOCK_CHARS = 8 << 20
CHUNK_UNITS = 4_096       # units that a worker encodes in one call
_CUT = re.compile(r" (?<=\S )(?!\Z)")   # a space alone would be no text for B

BLOCK_SCHEMA = ("block long, ids array<long>, body binary, regular array<int>, regular_n array<long>, "
                "pairs array<long>, pairs_n array<long>")
DOC_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Aligner:
    """Two tokenizers over the same bytes; opened inside a worker."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        back = alphabet_bytes()
        raw = {i: bytes([back[c] for c in s]) if all(c in back for c in s) else s.encode()
               for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [raw.get(i, b"") for i in range(max(raw) + 1)]
        n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        same = {}
        for i in sorted(range(n_b), key=lambda i: self.b.is_byte(i)):   # ordinary pieces before bytes
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                same.setdefault(self.bytes_b[i], i)
        self.identity = [same.get(x, -1) for x in self.bytes_a]
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        split_a = ((spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer")
                   and not spec["pre_tokenizer"].get("add_prefix_space") and all(t["special"] for t in spec["added_tokens"]))
        self.cuts = split_a and not any(re.search("[^▁]▁", p) for p in pieces)
        self.identity_of = np.array(self.identity, dtype=np.int64)
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))

    def units(self, text: str) -> list[str]:
        """The text cut at spaces after something else; each unit's own space
        stands before it, unwritten."""
        if not text:
            return []
        return _CUT.split(text) if self.cuts else [text]

    def encode(self, text: str):
        """Ids of both tokenizers on a space and ``text``, or None where one of
        them does not give back the bytes."""
        ids_a = self.a.encode(" " + text, add_special_tokens=False).ids
        ids_b, raw = self.b.encode(text), b" " + text.encode()
        if any(b"".join([t[i] for i in ids]) != raw for t, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            return None
        return np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)

    def tables(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Of all units, one after the other: tokens per unit (A, B), ids (A, B),
        and whether a token ends a group (A, B); then whether a unit is given
        back whole (others have no tokens).  Units are encoded many at a time,
        joined by the spaces at which texts are cut."""
        whole = np.ones(len(units), dtype=bool)
        out = []
        joins = np.array([self.cuts and bool(u) and not u[-1].isspace() and "▁" not in u for u in units], dtype=bool)
        own = [np.flatnonzero(joins)[i:i + CHUNK_UNITS] for i in range(0, int(joins.sum()), CHUNK_UNITS)]
        own += [np.array([i]) for i in np.flatnonzero(~joins)]
        while own:
            part = own.pop()
            got = self.encode(" ".join([units[i] for i in part]))
            if got is None and len(part) > 1:
                own += [part[:len(part) // 2], part[len(part) // 2:]]
                continue
            if got is None:
                whole[part] = False
                continue
            ends_a, ends_b = np.cumsum(self.size_a[got[0]]), np.cumsum(self.size_b[got[1]])
            unit_ends = np.cumsum([1 + len(units[i].encode()) for i in part])
            out.append((part, np.diff(np.searchsorted(ends_a, unit_ends, side="right"), prepend=0),
                        np.diff(np.searchsorted(ends_b, unit_ends, side="right"), prepend=0), *got,
                        np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)))
        n_a, n_b = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        for part, x, y, *_ in out:
            n_a[part], n_b[part] = x, y
        flat = [np.empty(n.sum(), dtype=t) for n, t in ((n_a, np.int32), (n_b, np.int32), (n_a, bool), (n_b, bool))]
        starts = [np.cumsum(n) - n for n in (n_a, n_b)]
        for part, x, y, *arrays in out:
            for k, values in enumerate(arrays):
                n = (x, y)[k % 2]
                flat[k][np.repeat(starts[k % 2][part] - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
        return n_a, n_b, *flat, whole


class Links:
    """The links of a block's units, worked out from the unit tables."""

    def __init__(self, pair: Aligner, n_a, n_b, ids_a, ids_b, end_a, end_b):
        last_a, last_b = np.flatnonzero(end_a), np.flatnonzero(end_b)
        x, y = ids_a[last_a].astype(np.int64), ids_b[last_b].astype(np.int64)
        single = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1) & (pair.identity_of[x] == y)
        unit = np.repeat(np.arange(len(n_a)), n_a)[last_a]
        self.n_groups = np.bincount(unit, minlength=len(n_a))
        self.regular, self.regular_unit = x[single], unit[single]
        self.pairs, self.places = np.unique((x << 32 | y)[~single], return_inverse=True)
        self.irregular_unit = unit[~single]


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Block:
    """Documents as unit numbers, and the units' tables."""

    def __init__(self, pair: Aligner):
        self.pair, self.codes, self.sizes, self.ids, self.chars = pair, array("i"), array("i"), [], 0
        self.numbers: dict[str, int] = {}

    def add(self, doc_id, text: str) -> None:
        numbers = self.numbers
        codes = [numbers.setdefault(u, len(numbers)) for u in self.pair.units(text)]
        self.codes.extend(codes)
        self.sizes.append(len(codes))
        self.ids.append(doc_id)
        self.chars += len(text)

    def row(self, block: int) -> dict:
        *tables, whole = self.pair.tables(list(self.numbers))
        codes, sizes = np.frombuffer(self.codes, dtype=np.int32), np.frombuffer(self.sizes, dtype=np.int32)
        if not whole.all():                               # documents with such a unit have no tokens
            doc = np.repeat(np.arange(len(sizes)), sizes)
            broken = np.zeros(len(sizes), dtype=bool)
            broken[doc[~whole[codes]]] = True
            codes, sizes = codes[~broken[doc]], np.where(broken, 0, sizes).astype(np.int32)
        uses = np.bincount(codes, minlength=len(self.numbers))
        links = Links(self.pair, *tables)
        vector = np.zeros(len(self.pair.bytes_a), dtype=np.int64)
        np.add.at(vector, links.regular, uses[links.regular_unit])
        pairs_n = np.zeros(len(links.pairs), dtype=np.int64)
        np.add.at(pairs_n, links.places, uses[links.irregular_unit])
        used = np.flatnonzero(vector)
        parts = [p.astype(np.int32) for p in (sizes, codes, *tables)]
        head = np.array([len(p) for p in parts], dtype=np.int64)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *[p.tobytes() for p in parts]]))
        return {"block": block, "ids": self.ids, "body": body, "regular": used, "regular_n": vector[used],
                "pairs": links.pairs, "pairs_n": pairs_n}


def _parts(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    head = np.frombuffer(raw, dtype=np.int64, count=8)
    return np.split(np.frombuffer(raw, dtype=np.int32, offset=head.nbytes), np.cumsum(head)[:-1])


def unit_groups(n_a, n_b, ids_a, ids_b, end_a, end_b) -> list[str]:
    """Every unit's groups as ``a1,a2|b1;a3|b2;``, a semicolon after each."""
    before_a = np.cumsum(end_a) - end_a                      # groups that ended before each token
    before_b = np.cumsum(end_b) - end_b
    upto_a = np.concatenate([[0], np.flatnonzero(end_a) + 1])
    upto_b = np.concatenate([[0], np.flatnonzero(end_b) + 1])
    pieces = np.empty(len(ids_a) + len(ids_b), dtype=object)
    for at, ids, end, (inner, last) in ((np.arange(len(ids_a)) + upto_b[before_a], ids_a, end_a, ",|"),
                                        (np.arange(len(ids_b)) + upto_a[before_b + 1], ids_b, end_b, ",;")):
        names = np.array([f"{i}{c}" for c in (inner, last) for i in range(int(ids.max(initial=0)) + 1)], dtype=object)
        pieces[at] = names[ids + end * (len(names) // 2)]
    pieces, ends = pieces.tolist(), np.cumsum(n_a + n_b).tolist()
    return ["".join(pieces[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


_BLOCK_TYPES = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("body", pa.binary()),
                          ("regular", pa.list_(pa.int32())),
                          ("regular_n", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())), ("pairs_n", pa.list_(pa.int64()))])


def alignment_blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of documents (``doc_id``, ``text``), written once."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(pair)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, text)
                if block.chars >= block_chars:
                    yield pa.RecordBatch.from_pylist([block.row(number)], schema=_BLOCK_TYPES)
                    block, number = Block(pair), number + 1
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(number)], schema=_BLOCK_TYPES)
    return bucketed(docs.mapInArrow(pack, BLOCK_SCHEMA), "block", "alignment_blocks")


def link_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus-wide counts: (a_id, n) of one-to-one links of equal bytes, at most
    one row per vocabulary entry, and (pair, n) of all other links, where
    ``pair`` is the A id shifted by 32 bits plus the B id."""
    def summed(ids: str, n: str, name: str) -> DataFrame:
        return (blocks.select(F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(n).alias("n"))).alias("x"))
                .groupBy(F.col("x.i").alias(name)).agg(F.sum("x.n").alias("n")))
    return summed("regular", "regular_n", "a_id"), summed("pairs", "pairs_n", "pair")


def aligned(blocks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, ``n_best``
    (links whose count is the highest of their B id), ``count_sum`` and
    ``groups`` (``a1,a2|b1;a3|b2``)."""
    regular, irregular = link_counts(blocks)
    irregular = checkpointed(irregular)
    pair = aligner(path_a, path_b)
    total = np.zeros(len(pair.bytes_a), dtype=np.int64)          # both vectors are as long as a vocabulary
    best = np.zeros(len(pair.bytes_b), dtype=np.int64)
    for a_id, n in regular.collect():
        total[a_id] = n
        best[pair.identity[a_id]] = max(best[pair.identity[a_id]], n)
    for b_id, n in irregular.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")).agg(F.max("n")).collect():
        best[b_id] = max(best[b_id], n)
    is_best = (total > 0) & (total == best[pair.identity_of])
    used = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    counted = used.join(irregular, "pair").select("of", "place", "n")
    types = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                       ("groups", pa.string())])

    def place(block: pa.Table, counts: pa.Table) -> pa.Table:
        pair, out = aligner(path_a, path_b), []
        n = counts.sort_by("place").column("n").to_numpy()
        for row in block.to_pylist():
            sizes, codes, *tables = _parts(row["body"])
            links = Links(pair, *tables)
            if len(links.pairs) != len(n):
                raise ValueError("a block's pair table is not whole")
            n_units = len(tables[0])
            unit = np.zeros((5, n_units + 1), dtype=np.int64)        # n_a, n_b, n_groups, n_best, count_sum
            unit[:3, :-1] = tables[0], tables[1], links.n_groups
            np.add.at(unit[3], links.regular_unit, is_best[links.regular])
            np.add.at(unit[3], links.irregular_unit, (best[links.pairs & 0xFFFFFFFF] == n)[links.places])
            np.add.at(unit[4], links.regular_unit, total[links.regular])
            np.add.at(unit[4], links.irregular_unit, n[links.places])
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            sums = np.stack([np.concatenate([[0], np.cumsum(u[codes])])[ends] for u in unit])
            n_a, n_b, n_groups, n_best, count_sum = np.diff(sums, axis=1)
            strings = unit_groups(*tables)
            groups = ["".join([strings[c] for c in codes[s:e].tolist()])[:-1] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            out.append(pa.table([pa.array(row["ids"], pa.int64()), *[pa.array(x) for x in (n_a, n_b, n_groups, n_groups, n_best, count_sum)],
                                 pa.array(groups, pa.string())], schema=types))
        return pa.concat_tables(out) if out else types.empty_table()
    return (blocks.select("block", "ids", "body").groupBy("block").cogroup(counted.groupBy("of"))
            .applyInArrow(place, DOC_SCHEMA))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Aligns a byte-level tokenizer file (A) with a sentence-piece model (B)
    on every text; one row per document (see ``aligned``)."""
    return aligned(alignment_blocks(text_of(docs, id_col, text_col), path_a, path_b, block_chars), path_a, path_b)


@register("op13_token_alignment")
def q_token_alignment(spark, sf_dir):
    import public_tokenizers
    out = align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.select(*[c for c in out.columns if c != "groups"], digest.alias("groups_sha256"))
