"""File sources and sinks: CSV, JSON landing files, Parquet.

Readers always take an explicit schema (no inference pass over the data);
sinks write to shared storage and are idempotent where the reference is
("skip if it exists" → ``mode('ignore')``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def scan_csv(spark: SparkSession, path: str, schema: str, header: bool = True, nrows: int | None = None,
             encoding: str | None = None) -> DataFrame:
    """CSV with a declared schema; ``nrows`` keeps the first n records (the
    reference's ``nrows``), pushed down as a per-partition limit."""
    r = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
    if encoding:
        r = r.option("encoding", encoding)
    df = r.csv(path)
    return df.limit(nrows) if nrows else df


def sink_csv(df: DataFrame, path: str) -> str:
    """Write with a header unless the target already exists (mode 'ignore')."""
    df.write.mode("ignore").option("header", True).csv(path)
    return path


def sink_parquet_dated(df: DataFrame, base: str, run_date: str) -> str:
    """Snappy Parquet partitioned by run date; re-running a date replaces
    only that date's partition (dynamic partition overwrite)."""
    (df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
       .partitionBy("run_date").parquet(base))
    return base


def json_safe(df: DataFrame) -> DataFrame:
    """NaN / ±inf → NULL in every floating column."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def to_json_records(df: DataFrame, key: str) -> DataFrame:
    """One JSON object per row (NULL fields written as null)."""
    safe = json_safe(df)
    return safe.select(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in safe.columns]),
                                      {"ignoreNullFields": "false"}).alias("json"))


def reuse_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Reload the stored result if present, else compute, store and reload
    (the stored table also cuts the lineage of the computation)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    # only a committed table is reused: a half-written folder has no marker
    if not done.getFileSystem(conf).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def input_version(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files below ``path``: a key
    under which derived results may be kept."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files, seen = at.getFileSystem(conf).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


ARTICLE_SCHEMA = ("title string, description string, content string, url string, publishedAt string, "
                  "source struct<name: string>")


def scan_json_articles(spark: SparkSession, landing: str, query: str) -> DataFrame:
    """Landed article pages (JSON lines, one folder per page=N) plus lineage
    columns: source file, query used, page number."""
    a = spark.read.schema(ARTICLE_SCHEMA + ", page int").json(landing)
    return a.withColumn("query_used", F.lit(query)).withColumn("source_file", F.input_file_name())
