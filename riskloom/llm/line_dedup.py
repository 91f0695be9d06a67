"""Line-level deduplication: lines that many documents share stay in one.

1. Texts are exploded into lines at ``\\n``.  A line's key is the line without
   white space (``[\\x20\\x09-\\x0D]``) at both ends, A-Z in lower case; keys of
   fewer than ``min_chars`` code points are never dropped.
2. Keys are hashed (128 bits) and documents are counted per hash, each once:
   distinct (hash, document) pairs, then a count and the largest ``doc_id``.
3. The lines of hashes that ``min_docs`` documents or more hold are dropped,
   except in the largest ``doc_id``.
4. The places of dropped lines go back to their documents, which are put
   together again from the lines between them.  Texts cross the network once,
   in this last join.

Skew: pairs spread by (hash, document), so a line that a third of all documents
hold costs one partial count a task.  Joining hashes back to lines, those with
more than 1/``HOT_KEYS`` of all pairs are broadcast (at most ``HOT_KEYS`` rows
by arithmetic); any other hash has fewer lines than that share.

Results for special cases: null or empty text is one empty line and stays as it
is; a very long text is one row, its places one array; lines that occur several
times in a document count it once and are all dropped or all stay; rows without
a ``doc_id`` count as no document and never hold the kept line; rows that share
an id count as one document, each cleaned by itself; repeated rows give repeated
rows; ties cannot occur (the largest id decides); extra columns, whatever their
names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import register, table, text_of, written

MIN_CHARS = 20
MIN_DOCS = 3
HOT_KEYS = 10_000        # rows of the broadcast side at most (24 bytes each)
BLANKS = " \t\n\x0b\f\r"


def _hash128(col: str, *names: str):
    """Two hashes of a string with different seeds, as two long columns."""
    return F.xxhash64(F.col(col)).alias(names[0]), F.xxhash64(F.lit(1), F.col(col)).alias(names[1])


def line_keys(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, r1, r2, place, h1, h2): every line whose key is long enough;
    ``r1``, ``r2`` stand for the text, ``h1``, ``h2`` for the key."""
    lines = texts.select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANKS)), ascii_uppercase, ascii_lowercase)
    # shorter lines cannot have long keys; the test keeps them from the two string functions
    return (lines.where(F.char_length("line") >= min_chars).select("doc_id", "r1", "r2", "place", key.alias("key"))
            .where(F.char_length("key") >= min_chars).select("doc_id", "r1", "r2", "place", *_hash128("key", "h1", "h2")))


def common_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs, keeper): hashes that ``min_docs`` documents hold."""
    pairs = keys.where("doc_id IS NOT NULL").select("h1", "h2", "doc_id").distinct()
    return (pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs))


def dropped_places(keys: DataFrame, common: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(doc_id, r1, r2, places): the sorted places of each text's dropped lines."""
    total = common.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * F.lit(hot_keys) > F.lit(total)
    lines = keys.alias("l")
    lost = F.col("l.doc_id").isNull() | (F.col("l.doc_id") != F.col("keeper"))
    same = (F.col("l.h1") == F.col("c.h1")) & (F.col("l.h2") == F.col("c.h2"))
    found = [lines.join(side, same).where(lost).select("l.doc_id", "r1", "r2", "place")
             for side in (F.broadcast(common.where(hot)).alias("c"), common.where(~hot).alias("c"))]
    return (found[0].unionByName(found[1]).groupBy("doc_id", "r1", "r2")
            .agg(F.sort_array(F.collect_set("place")).alias("places")))


def without_lines(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Texts put together from the lines between the dropped places."""
    t, p = texts.alias("t"), places.alias("p")
    joined = t.join(p, F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.r1") == F.col("p.r1"))
                    & (F.col("t.r2") == F.col("p.r2")), "left")
    split = joined.select("t.doc_id", "text", "places", F.split("text", "\n").alias("lines"))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "places"), F.concat("places", F.array(F.size("lines"))),
                      lambda a, b: F.slice("lines", a + 2, b - a - 1))
    between = F.array_join(F.flatten(runs), "\n")
    return split.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"),
                        F.when(F.col("places").isNull(), F.col("text")).otherwise(between).alias("kept_text"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines`` before dropping,
    ``n_dropped`` and ``kept_text``."""
    texts = text_of(docs, id_col, text_col).select("doc_id", "text", *_hash128("text", "r1", "r2"))
    keys = written(line_keys(texts, min_chars), "line_keys")
    common = written(common_lines(keys, min_docs), "common_lines")
    return without_lines(texts, dropped_places(keys, common, hot_keys))


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM x),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id IS DISTINCT FROM g.keeper AS lost FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id, rid"""


@register("op12_line_dedup", SQL)
def q_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
