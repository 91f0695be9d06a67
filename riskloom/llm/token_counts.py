"""Token counts by prefix dynamic programming.

A byte-pair encoding has one property that makes prefixes cheap: a token
sequence is the encoding of its text exactly when each two neighbours encode
to themselves.  So for every prefix of a piece there is one last token, and

    tokens(prefix i) = tokens(prefix i - length of its last token) + 1

Filling this table once answers every question on a prefix (how many tokens
has it, how many bytes do the first n tokens cover) without encoding again.
Pieces repeat, so a worker keeps a bounded memo of piece tables; a document's
prefix counts are running sums over its pieces.

Results for special cases: null text counts as empty (0 tokens, 0 bytes);
special strings inside a text count as their one special token; very long
pieces take time in proportion to their length; repeated rows give repeated
rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.byte_pieces import alphabet_bytes, vocabulary
from riskloom.llm.common import register, table, text_of

MEMO_PIECES = 1_000_000   # pieces a worker remembers (about 150 bytes each); the memo is emptied beyond
MEMO_PIECE_CHARS = 48     # longer pieces are worked out each time


class PrefixTables:
    """Prefix tables of pieces under one byte-level vocabulary."""

    def __init__(self, path: str):
        self.voc = vocabulary(path)
        back = alphabet_bytes()
        raw = lambda s: bytes([back[c] for c in s])
        special = set(self.voc.special.values())
        self.tokens = {raw(s) for s, i in self.voc.vocab.items() if i not in special}
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(self.voc.merges)}
        self.longest = max(map(len, self.tokens))
        self.pair_ok: dict[tuple[bytes, bytes], bool] = {}
        self.memo: dict[str, int] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The encoding of a short byte string by merging; only used on two
        neighbouring tokens, to learn whether they stay apart."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, left: bytes, right: bytes) -> bool:
        """Whether ``right`` may stand after ``left`` (b'': at the start)."""
        ok = self.pair_ok.get((left, right))
        if ok is None:
            if len(self.pair_ok) > 2_000_000:
                self.pair_ok.clear()
            want = [left, right] if left else [right]
            ok = self.pair_ok[left, right] = self.merged(left + right) == want
        return ok

    def table(self, piece: bytes) -> tuple[list[int], list[bytes]]:
        """Token count and last token of every prefix of a piece."""
        n, count, last = len(piece), [0], [b""]
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in self.tokens and self.follows(last[start], token):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends here: the vocabulary lacks a byte")
        return count, last

    def n_tokens(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = self.table(piece.encode())[0][-1]
            if len(piece) <= MEMO_PIECE_CHARS:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = n
        return n

    def bytes_of_first(self, piece: bytes, n: int) -> int:
        """Bytes that the first ``n`` tokens of a piece cover."""
        count, last = self.table(piece)
        end = len(piece)
        while count[end] > n:
            end -= len(last[end])
        return end

    def prefixes(self, text: str) -> tuple[list[str], list[int]]:
        """A text's pieces (special strings as pieces of their own) and the
        number of tokens up to the end of each."""
        pieces: list[str] = []
        counts: list[int] = []
        for i, segment in enumerate(self.voc.segments(text)):
            if i % 2:
                pieces.append(segment)
                counts.append(1)
            elif segment:
                own = self.voc.pieces(segment)
                memo = self.memo
                got = [memo.get(p) for p in own]
                if None in got:
                    got = [self.n_tokens(p) if n is None else n for p, n in zip(own, got, strict=True)]
                pieces += own
                counts += got
        return pieces, list(accumulate(counts))

    def count_prefix(self, text: str, n_chars: int) -> int:
        """Tokens of ``text[:n_chars]``.  Pieces before the cut stand; only
        those that the cut can change are split again: the cut one, white
        space before it, and special strings that the cut breaks."""
        pieces, counts = self.prefixes(text)
        ends = list(accumulate(map(len, pieces)))
        k = bisect_right(ends, n_chars) - 1                # last piece wholly inside
        while k >= 0 and (pieces[k].isspace() and pieces[k] not in self.voc.special):
            k -= 1
        start, before = (ends[k], counts[k]) if k >= 0 else (0, 0)
        tail = self.prefixes(text[start:n_chars])[1]
        return before + (tail[-1] if tail else 0)

    def first_tokens(self, pieces: list[str], counts: list[int], n: int) -> int:
        """Bytes covered by the first ``n`` tokens of a text."""
        if not counts or counts[-1] <= n:
            return sum(len(p.encode()) for p in pieces)
        k = bisect_right(counts, n)
        done = sum(len(p.encode()) for p in pieces[:k])
        left = n - (counts[k - 1] if k else 0)
        if left and pieces[k] not in self.voc.special:
            done += self.bytes_of_first(pieces[k].encode(), left)
        return done


@functools.lru_cache(maxsize=2)
def prefix_tables(path: str) -> PrefixTables:
    return PrefixTables(path)


def token_counts(docs: DataFrame, path: str, budget: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: ``n_bytes``, ``n_tokens`` and ``budget_bytes``,
    the bytes that its first ``budget`` tokens cover (where truncation cuts)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_tables(path)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                pieces, counts = t.prefixes(text)
                n, size = (counts[-1] if counts else 0), len(text.encode())
                out.append((size, n, size if n <= budget else t.first_tokens(pieces, counts, budget)))
            got = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": got[:, 0], "n_tokens": got[:, 1],
                                              "budget_bytes": got[:, 2]})
    return text_of(docs, id_col, text_col).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, budget_bytes long")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table itself, one row per document: ``ends`` (characters) and
    ``tokens`` (running count) at the end of every piece."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_tables(path)
        for batch in batches:
            rows = [t.prefixes(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "ends": pa.array([list(accumulate(map(len, p))) for p, _ in rows], pa.list_(pa.int64())),
                "tokens": pa.array([c for _, c in rows], pa.list_(pa.int64()))})
    return text_of(docs, id_col, text_col).mapInArrow(count, "doc_id long, ends array<long>, tokens array<long>")


def counts_at(docs: DataFrame, path: str, cut_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token count of ``text[:cut]`` for a column of cuts in characters
    (null: the whole text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prefix_tables(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts = [len(x) if c is None else max(0, min(int(c), len(x)))
                    for x, c in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "cut": pa.array(cuts, pa.int64()), "n_tokens": pa.array(
                [t.count_prefix(x, c) for x, c in zip(texts, cuts, strict=True)], pa.int64())})
    return text_of(docs, id_col, text_col, cut_col).mapInArrow(count, "doc_id long, cut long, n_tokens long")


@register("op2_token_counts")
def q_token_counts(spark, sf_dir):
    import public_tokenizers
    limit = 1024
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit)
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} AS over_limit", "budget_bytes")
