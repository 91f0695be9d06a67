"""Shared pieces of the training-data operators: tables, scratch, registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, ensure_checkpoint_dir, scratch_table_path

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

# White space of every word rule of this package: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def register(name: str, sql: str | None = None):
    """Adds ``f(spark, sf_dir)`` to the registered queries."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``."""
    return cut_lineage(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back."""
    spark = df.sparkSession
    path = scratch_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once to shared scratch as a table bucketed by ``key``, so
    that later joins and cogroups on the key read it without a shuffle."""
    spark = df.sparkSession
    path = scratch_table_path(spark, name)
    full = f"{name}_{path.rsplit('-', 1)[1]}"
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), key).option("path", path).saveAsTable(full)
    return spark.table(full)


def text_of(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator works on, renamed: ``doc_id`` (long) and
    ``text`` (null as empty).  Extra columns, whatever their names, stay out."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *[F.col(f"`{c}`") for c in more])


def packed_rows(df: DataFrame, **named) -> DataFrame:
    """The caller's columns as one struct column ``row`` beside ``named``
    columns, so that no name of theirs can clash with one of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named.items()])


def unpacked(columns: list[str], replaced: dict | None = None) -> list:
    """The caller's columns again, some of them replaced."""
    replaced = replaced or {}
    return [replaced[c].alias(c) if c in replaced else F.col(f"row.`{c}`").alias(c) for c in columns]


__all__ = ["packed_rows", "unpacked", "QUERIES", "ORACLE", "WORD", "SPACE", "register", "table", "shuffle_partitions", "checkpointed",
           "written", "bucketed", "text_of", "ensure_checkpoint_dir", "scratch_table_path"]
