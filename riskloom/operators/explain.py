"""Explanations for a linear scoring model.

For a linear model the Shapley value of feature i is exactly
``w_i · (x_i − E[x_i])`` and ``Σ contributions + base = prediction`` with
``base = b + Σ w_i E[x_i]``.  Everything is a projection over the feature
table plus one broadcast row of feature means; per-client work explodes a
bounded number of rows (features × alternatives).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.aggregates import mean_of
from riskloom.plans.common import round_half_away

SIGNIFICANT, MODERATE = 10.0, 5.0
CHANGE_EPS = 1e-6


def linear_score(coef: Mapping[str, float], intercept: float) -> Column:
    s = F.lit(float(intercept))
    for f, w in coef.items():
        s = s + F.lit(float(w)) * F.col(f)
    return s


def contributions(df: DataFrame, key: str, coef: Mapping[str, float], intercept: float,
                  means: DataFrame | None = None) -> DataFrame:
    """Long table (key, feature, value, contribution, base_value, prediction)."""
    feats = list(coef)
    if means is None:
        means = df.agg(*[mean_of(F.col(f)).alias(f"__mu_{f}") for f in feats])
    base = F.lit(float(intercept))
    for f in feats:
        base = base + F.lit(float(coef[f])) * F.col(f"__mu_{f}")
    j = df.crossJoin(F.broadcast(means))  # one row
    structs = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"),
                        (F.lit(float(coef[f])) * (F.col(f) - F.col(f"__mu_{f}"))).alias("contribution")) for f in feats]
    return j.select(key, base.alias("base_value"), linear_score(coef, intercept).alias("prediction"),
                    F.explode(F.array(*structs)).alias("s")).select(key, "s.*", "base_value", "prediction")


def top_by_abs(long: DataFrame, key: str, k: int, value: str = "contribution") -> DataFrame:
    """k largest |value| per key (ties by feature name); per-key rows are bounded
    by the feature count."""
    w = Window.partitionBy(key).orderBy(F.abs(F.col(value)).desc(), F.col("feature"))
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .withColumn("sign", F.when(F.col(value) > 0, "positive").when(F.col(value) < 0, "negative").otherwise("zero")))


def global_importance(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(mean_of(F.abs(F.col("contribution"))).alias("mean_abs_contribution"),
                                       F.count(F.lit(1)).alias("n"))


def alternatives(feature: str, improve: bool) -> list[tuple[str, float]]:
    """(kind, amount) candidates: ratio features step ±0.1·i (i = 1..3, kept in
    [0, 2]); other features ×1.1/1.2/1.3 (or ×0.9/0.8/0.7)."""
    if "ratio" in feature.lower():
        step = 0.1 if improve else -0.1
        return [("add", step * i) for i in range(1, 4)]
    return [("mul", m) for m in ([1.1, 1.2, 1.3] if improve else [0.9, 0.8, 0.7])]


def counterfactuals(long: DataFrame, key: str, coef: Mapping[str, float], target_delta: float = 1.0,
                    max_changes: int = 3, keep: int = 5) -> DataFrame:
    """Top-``max_changes`` features by |contribution| x realistic alternatives,
    rescored; a feature's alternatives stop after the first one that gets
    closer to the target; the ``keep`` closest scenarios per key."""
    improve = target_delta > 0
    top = top_by_abs(long, key, max_changes)
    w = F.create_map(*[x for f, v in coef.items() for x in (F.lit(f), F.lit(float(v)))])
    rows = []
    for f in coef:
        for i, (kind, amt) in enumerate(alternatives(f, improve)):
            rows.append((f, i, kind, amt))
    alt = top.sparkSession.createDataFrame(rows, "feature string, alt_idx int, kind string, amount double")
    c = top.join(F.broadcast(alt), "feature")  # fixed table: features x 3
    new = F.when(F.col("kind") == "add", F.col("value") + F.col("amount")).otherwise(F.col("value") * F.col("amount"))
    c = c.withColumn("new_value", new).where((F.col("kind") == "mul") | ((F.col("new_value") >= 0) & (F.col("new_value") <= 2)))
    current = F.col("prediction")
    target = current + F.lit(float(target_delta))
    pred = current + F.element_at(w, F.col("feature")) * (F.col("new_value") - F.col("value"))
    c = c.withColumn("predicted_score", pred).withColumn("target_score", target)
    closer = (F.abs(F.col("predicted_score") - F.col("target_score")) < F.abs(current - F.col("target_score"))).cast("int")
    wf = Window.partitionBy(key, "feature").orderBy("alt_idx").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__closer", closer).withColumn("__before", F.coalesce(F.sum("__closer").over(wf), F.lit(0)))
    c = c.where(F.col("__before") == 0)
    n_all = Window.partitionBy(key)
    c = c.withColumn("n_generated", F.count(F.lit(1)).over(n_all))
    wk = Window.partitionBy(key).orderBy(F.abs(F.col("predicted_score") - F.col("target_score")), "feature", "alt_idx")
    c = c.withColumn("scenario", F.row_number().over(wk)).where(F.col("scenario") <= keep)
    return c.select(key, "scenario", F.col("feature").alias("feature_changed"), F.col("value").alias("original_value"),
                    "new_value", "predicted_score", "target_score",
                    (F.col("predicted_score") - current).alias("score_change"), "n_generated")


def score_change_attribution(old: DataFrame, new: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Per changed feature: value change and contribution change (new vs old
    snapshot under one background), top ``top`` by |contribution change|."""
    o = old.select(key, "feature", F.col("value").alias("old_value"), F.col("contribution").alias("old_contribution"),
                   F.col("prediction").alias("old_score"))
    n = new.select(key, "feature", F.col("value").alias("new_value"), F.col("contribution").alias("new_contribution"),
                   F.col("prediction").alias("new_score"))
    j = o.join(n, [key, "feature"])
    sc = F.col("new_score") - F.col("old_score")
    j = (j.withColumn("value_change", F.col("new_value") - F.col("old_value"))
          .withColumn("contribution_change", F.col("new_contribution") - F.col("old_contribution"))
          .withColumn("score_change", sc))
    ch = j.where(F.abs(F.col("value_change")) > CHANGE_EPS)
    w = Window.partitionBy(key).orderBy(F.abs(F.col("contribution_change")).desc(), "feature")
    ch = ch.withColumn("rank", F.row_number().over(w))
    n_sig = F.sum((F.abs(F.col("contribution_change")) > 1.0).cast("int")).over(Window.partitionBy(key))
    ch = ch.withColumn("temporal_confidence", F.least(F.lit(0.95), F.lit(0.5) + n_sig * 0.1))
    out = ch.where(F.col("rank") <= top)
    return out.select(key, "feature", "rank", "old_value", "new_value", "value_change", "old_contribution",
                      "new_contribution", "contribution_change", "score_change",
                      F.when(sc > 0, "improved").otherwise("declined").alias("direction"),
                      F.when(F.abs(sc) > SIGNIFICANT, "significant").when(F.abs(sc) > MODERATE, "moderate")
                       .otherwise("minor").alias("category"), "temporal_confidence")


def performance_category(rel: Column) -> Column:
    return (F.when(rel > 20, "excellent").when(rel > 10, "good").when(rel > -10, "average")
             .when(rel > -20, "below_average").otherwise("poor"))


def ranking_category(score: Column) -> Column:
    return (F.when(score > 80, "top_quartile").when(score > 60, "above_average").when(score > 40, "average")
             .when(score > 20, "below_average").otherwise("bottom_quartile"))


def peer_comparison(long: DataFrame, key: str, sector: DataFrame, sector_col: str) -> DataFrame:
    """Feature value vs the sector average of that feature."""
    lj = long.join(sector, key)
    bench = lj.groupBy(sector_col, "feature").agg(mean_of(F.col("value")).alias("sector_average"))
    j = lj.join(bench, [sector_col, "feature"])
    diff = F.col("value") - F.col("sector_average")
    rel = F.when(F.col("sector_average") != 0, F.try_divide(diff, F.col("sector_average")) * 100).otherwise(F.lit(0.0))
    j = j.select(key, sector_col, "feature", F.col("value").alias("company_value"), "sector_average",
                 diff.alias("difference"), rel.alias("relative_performance"))
    score = F.when(F.col("relative_performance") > 0, F.least(F.lit(100.0), 50 + F.col("relative_performance"))) \
             .otherwise(F.greatest(F.lit(0.0), 50 + F.col("relative_performance")))
    wk = Window.partitionBy(key)
    j = (j.withColumn("performance_category", performance_category(F.col("relative_performance")))
          .withColumn("overall_peer_score", F.avg(score).over(wk))
          .withColumn("n_strengths", F.sum((F.col("relative_performance") > 10).cast("int")).over(wk))
          .withColumn("n_weaknesses", F.sum((F.col("relative_performance") < -10).cast("int")).over(wk))
          .withColumn("comparison_confidence", F.least(F.lit(0.9), F.count(F.lit(1)).over(wk) / 10.0)))
    return j.withColumn("ranking_category", ranking_category(F.col("overall_peer_score")))


def fmt(x: Column, decimals: int) -> Column:
    """Python-like fixed format of a value pre-rounded half away from zero."""
    return F.format_string(f"%.{decimals}f", round_half_away(x, decimals))
