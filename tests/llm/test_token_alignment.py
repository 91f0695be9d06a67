"""Token alignment against a brute-force version with the libraries themselves."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from riskloom.llm import token_alignment as T

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block int, pair string, groups string, n string"
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATH_B)


def _brute(rows, libraries):
    """Whole texts, every occurrence pair, plain counters."""
    a, b = libraries
    kept = {chr(x): x for x in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    rest = [x for x in range(256) if x not in kept.values()]
    letters = kept | {chr(256 + i): x for i, x in enumerate(rest)}
    found = []
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(y) else p.replace("▁", " ").encode()
                   for y, p in ((y, b.id_to_piece(y)) for y in ids_b)]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            ids_a, ids_b, parts_a, parts_b = [], [], [], []
        ends_a = [sum(map(len, parts_a[:k + 1])) for k in range(len(parts_a))]
        ends_b = [sum(map(len, parts_b[:k + 1])) for k in range(len(parts_b))]
        links = [(x, y) for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f]
        groups, low = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(x) for x, e in zip(ids_a, ends_a) if low < e <= end) + "|"
                          + ",".join(str(y) for y, f in zip(ids_b, ends_b) if low < f <= end))
            low = end
        found.append((i, len(ids_a), len(ids_b), groups, links))
    count = Counter(p for r in found for p in r[4])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted([(i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
                    sum(count[p] for p in links), ";".join(groups)) for i, n_a, n_b, groups, links in found], key=repr)


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "p", "g", "n") for i, t in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in T.align_tokens(df, PATH_A, PATH_B, **kw).select(*COLS).collect()], key=repr)


EDGES = [None, "", " ", "  ", "\n", " leading", "trailing ", "two  spaces   three", "tab\tand \t mixed\r\n \x85 \x1c x \xa0y",
         "a▁b stands for a space", "▁", "<|endoftext|> in <s> a </s> text <unk> <0x41>", "nul \x00 byte", "don't we'll I'm 'tis",
         "naïve café Übermaß ß ẞ", "日本語のテキスト 漢字", "emoji 👩‍👩‍👧 🇩🇪 flags", "x" * 3000, "1234567890 12 3.14 1e-5",
         "é combining", "﻿bom", "​zero width", "ﬁ ligature ①", " \n \n ", "word\nnext line\n\n  indented", "　wide space"]


def test_edge_texts_equal_the_libraries(spark, libraries):
    rows = [*enumerate(EDGES), (None, "no id"), (3, EDGES[7]), (3, EDGES[7])]
    want = _brute(rows, libraries)
    assert sum(r[1] == 0 for r in want) >= 4
    assert _run(spark, rows) == want
    assert _run(spark, rows, block_chars=40) == want


def test_corpus_texts_equal_the_libraries(spark, sf_small, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
            if len(r[1] or "") < 3000][:120]
    assert _run(spark, rows, block_chars=20_000) == _brute(rows, libraries)


def test_random_strings(spark, libraries):
    rnd = random.Random(3)
    letters = "ab  \n\t'sé1.,-▁日\xa0\x1f" + "the "
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    assert _run(spark, rows, block_chars=500) == _brute(rows, libraries)


def test_digest_and_empty_table(spark, sf_small):
    out = T.q_token_alignment(spark, sf_small)
    assert out.columns == [*COLS[:-1], "groups_sha256"]
    first = spark.read.parquet(f"{sf_small}/documents.parquet").where("doc_id = 1").select("doc_id", "text")
    groups = T.align_tokens(first, PATH_A, PATH_B).first()["groups"]
    assert out.where("doc_id = 1").first()["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest()
    assert T.align_tokens(spark.createDataFrame([], SCHEMA), PATH_A, PATH_B).count() == 0
