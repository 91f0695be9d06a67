import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm.token_counts import PrefixTables, counts_at, prefix_counts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tables():
    return PrefixTables(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=300, seed=1):
    rng = random.Random(seed)
    bits = ["the", " cat", "ing", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "1234", "é", "ß", "中文", "🙂", "́",
            "<|endoftext|>", "<|endof", "...", "==", "\x1c", "\x85", "\xa0", "aaaa", "Zürich", "‘", "naïve", "ABC", "ՠ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_counts_are_the_librarys(tables, library):
    for x in [*texts(), "", "a" * 5000, " " * 3000, "ab" * 4000]:
        pieces, counts = tables.prefixes(x)
        ids = library.encode(x, add_special_tokens=False).ids
        assert (counts[-1] if counts else 0) == len(ids), repr(x)
        assert "".join(pieces) == x


def test_every_prefix(tables, library):
    for x in texts(60, 7):
        for k in range(len(x) + 1):
            assert tables.count_prefix(x, k) == len(library.encode(x[:k], add_special_tokens=False).ids), (x, k)


def test_budget_bytes(tables, library):
    from riskloom.llm.byte_pieces import alphabet_bytes
    back = alphabet_bytes()
    for x in texts(60, 3):
        ids = library.encode(x, add_special_tokens=False).ids
        pieces, counts = tables.prefixes(x)
        size = [13 if i == 50256 else len(library.id_to_token(i)) for i in ids]
        assert all(c in back for i in ids if i != 50256 for c in library.id_to_token(i))
        for n in range(len(ids) + 2):
            assert tables.first_tokens(pieces, counts, n) == sum(size[:n]), (x, n)


def test_operator(spark, library):
    xs = [*texts(50, 5), None, "", "w" * 20000, "same", "same"]
    docs = spark.createDataFrame([(i, x, i) for i, x in enumerate(xs)] + [(None, "no id", 1)],
                                 "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts(docs, PATH, 5).collect()}
    assert len(got) == len(xs) + 1
    for i, x in enumerate(xs):
        assert got[i].n_tokens == len(library.encode(x or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((x or "").encode())
    assert token_counts(docs.limit(0), PATH).count() == 0
    for r in prefix_counts(docs, PATH).collect():
        if r.doc_id is not None:
            assert (r.tokens[-1] if r.tokens else 0) == got[r.doc_id].n_tokens
    for r in counts_at(docs, PATH, "n_tokens").where("doc_id < 50").collect():
        assert r.n_tokens == len(library.encode(xs[r.doc_id][:r.cut], add_special_tokens=False).ids)
