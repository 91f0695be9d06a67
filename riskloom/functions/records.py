"""Split-oriented JSON records {feature_names, shape, index, data}."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_split_json(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    body = F.struct(F.array(*[F.lit(f) for f in features]).alias("feature_names"),
                    F.array(F.lit(1), F.lit(len(features))).alias("shape"),
                    F.array(F.col(key)).alias("index"),
                    F.array(F.array(*[F.col(f).cast("double") for f in features])).alias("data"))
    return df.select(key, F.to_json(body).alias("json"))


def from_split_json(df: DataFrame, key: str, json_col: str, features: Sequence[str]) -> DataFrame:
    schema = "feature_names array<string>, shape array<int>, index array<bigint>, data array<array<double>>"
    p = df.select(key, F.from_json(json_col, schema).alias("r"))
    return p.select(key, "r.feature_names", "r.shape",
                    *[F.col("r.data")[0][i].alias(f) for i, f in enumerate(features)])
