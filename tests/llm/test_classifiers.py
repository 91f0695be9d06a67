import zlib

from riskloom.llm import quality_model as Q
from riskloom.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def auc(rows):
    rows = sorted(rows)
    ranks, i = {}, 0
    pos = sum(y for _, y in rows)
    total = 0.0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        total += (i + 1 + j) / 2 * sum(y for _, y in rows[i:j])
        i = j
    return (total - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= .7) for r in got.values())
    rows = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc(rows) > .95
    assert sum(s >= .7 for s, y in rows if not y) <= .01 * sum(not y for _, y in rows)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, .5), (2, "", .5), (3, "word " * 50000, .5), (None, "text", .5), (4, "a", .5), (4, "a", .5)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {.5}
    one = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    assert all(r.score < .5 for r in T.toxicity(docs, one).collect())
    assert T.toxicity(docs.limit(0), one).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    out = Q.quality_model(docs, labels, train_only=f"not ({fold})")
    rows = out.join(labels, "doc_id").where(fold).select("score", "quality", "kept").collect()
    assert auc([(r.score, r.quality) for r in rows]) > .98
    assert sum(r.kept for r in rows if r.quality) >= .99 * sum(r.quality for r in rows)


def test_sparse_sites_fall_back(spark):
    """A site of one document stays near its host, a large bad site is bad."""
    rows, labels = [], []
    for i in range(400):
        host = "bad" if i < 100 else "good"
        rows.append((i, "some plain words stand here and there " * 3, host, "p1" if i % 2 else "p2", "x"))
        labels.append((i, int(host == "good" or i % 10 == 0)))
    rows += [(900, rows[0][1], "good", "rare", "x"), (901, rows[0][1], "new", "p1", "x"), (902, None, None, None, "x"), rows[3]]
    schema = "doc_id long, text string, source string, lang string, score string"
    got = {r.doc_id: r for r in Q.quality_model(spark.createDataFrame(rows, schema), spark.createDataFrame(
        labels, "doc_id long, quality int")).collect()}
    assert got[0].path_mean < .3 < .9 < got[399].path_mean
    assert got[900].path_mean > .9
    assert got[0].path_mean < got[901].path_mean < got[900].path_mean
    assert not got[0].kept and got[399].kept and 902 in got
    assert Q.quality_model(spark.createDataFrame([], schema), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
