"""Scaling of feature groups as a fitted, saved and reused pyspark.ml model.

A column belongs to every group one of whose keywords is in its name; groups
are fitted and applied in order, so a column of two groups is scaled twice, the
second time on what the first made of it.  Statistics come from aggregates over
the rows of the fit (nulls ignored); a fitted model is a short list of centres
and scales and transforms any rows by plain projections.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords of the groups and how each is scaled.
GROUPS = [
    {"name": "financial", "method": "robust", "keywords": ["ratio", "margin", "growth", "roa", "roe", "debt", "asset"]},
    {"name": "market", "method": "standard", "keywords": ["price", "volume", "momentum", "volatility", "beta", "rsi"]},
    {"name": "news", "method": "standard", "keywords": ["sentiment", "news", "event"]},
]


def members(columns: list[str], group: dict) -> list[str]:
    return [c for c in columns if any(k in c.lower() for k in group["keywords"])]


def _scaled(steps: list[dict], column: str) -> Column:
    """The column after all of its steps."""
    out = F.col(f"`{column}`").cast("double")
    for s in steps:
        if s["column"] == column:
            out = (out - F.lit(s["centre"])) / F.lit(s["scale"])
    return out


def _centres(df: DataFrame, columns: list[str], method: str) -> list[tuple[float, float]]:
    from riskloom.operators.stats import column_quantiles
    if method == "standard":
        row = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"c{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
        return [(row[f"c{i}"], row[f"s{i}"]) for i in range(len(columns))]
    if method == "minmax":
        row = df.agg(*[x for i, c in enumerate(columns) for x in (F.min(c).alias(f"c{i}"), (F.max(c) - F.min(c)).alias(f"s{i}"))]).first()
        return [(row[f"c{i}"], row[f"s{i}"]) for i in range(len(columns))]
    if method == "robust":
        row = column_quantiles(df, columns, [0.25, 0.5, 0.75]).first()
        return [(row[f"{c}__q1"], None if row[f"{c}__q2"] is None else row[f"{c}__q2"] - row[f"{c}__q0"]) for c in columns]
    raise ValueError(f"no way of scaling is called {method}")


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "columns that may be scaled", typeConverter=TypeConverters.toListString)

    def chosen(self) -> list[str]:
        return self.getOrDefault(self.columns)


class GroupScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the groups one after the other on the columns given."""

    groups = Param(Params._dummy(), "groups", "name, keywords and method (robust, standard, minmax, none) of each group, as JSON",
                   typeConverter=TypeConverters.toString)

    def __init__(self, columns: list[str] | None = None, groups: list[dict] | None = None):
        super().__init__()
        self._set(columns=columns or [], groups=json.dumps(groups or GROUPS))

    def _fit(self, df: DataFrame) -> GroupScalerModel:
        steps: list[dict] = []
        for group in json.loads(self.getOrDefault(self.groups)):
            own = members(self.chosen(), group)
            if not own or group["method"] == "none":
                continue
            now = df.select(*[_scaled(steps, c).alias(c) for c in own])
            for c, (centre, scale) in zip(own, _centres(now, own, group["method"]), strict=True):
                # as fitted scalers do: a column that does not vary keeps its unit
                steps.append({"group": group["name"], "column": c, "centre": 0.0 if centre is None else float(centre),
                              "scale": float(scale) if scale else 1.0})
        return GroupScalerModel(self.chosen(), steps)


class GroupScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted centres and scales, in the order in which they apply."""

    steps = Param(Params._dummy(), "steps", "group, column, centre and scale of each step, as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, columns: list[str] | None = None, steps: list[dict] | None = None):
        super().__init__()
        self._set(columns=columns or [], steps=json.dumps(steps or []))

    def fitted(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.steps))

    def _transform(self, df: DataFrame) -> DataFrame:
        steps = self.fitted()
        scaled = {s["column"] for s in steps}
        return df.select(*[_scaled(steps, c).alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns])
