import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from riskloom.llm import word_codec as W
from test_token_counts import texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encode_decode_as_library(spark):
    lib = Tokenizer.from_file(PATH)
    lib.no_padding()
    lib.no_truncation()
    xs = [*texts(200, 11), "", None, "İstanbul ΣΑΣ", "Ⅷ ﬁ Å", "x" * 30000, "it's WE'LL <|startoftext|>hi<|endoftext|>",
          "same same", "same same", "a\x1cb\x85c\xa0d"]
    docs = spark.createDataFrame([(i, x, "e") for i, x in enumerate(xs)] + [(None, "no id", "e")],
                                 "doc_id long, text string, ids string").repartition(3)
    for chars in (W.BLOCK_CHARS, 50):
        got = W.decode(W.encode(docs, PATH, block_chars=chars), PATH).collect()
        assert len(got) == len(xs) + 1
        for r in got:
            x = "no id" if r.doc_id is None else (xs[r.doc_id] or "")
            ids = lib.encode(x, add_special_tokens=False).ids
            assert r.ids == ids, x
            assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert W.decode(W.encode(docs.limit(0), PATH), PATH).count() == 0


def test_query(spark):
    from riskloom.llm.registry import queries
    sf = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(PATH)
    lib.no_padding()
    lib.no_truncation()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op3_word_codec"](spark, sf).collect()}
    assert got == want
