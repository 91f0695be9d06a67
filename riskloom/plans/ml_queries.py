"""Model-based selection, cross-validated boosting, VIF, scoring, Shapley
sampling and online SGD (§2.11 'R', §2.12, §2.10).  Rows-only checks: the
models are iterative or randomised, so no SQL oracle is given; unit tests
check invariants instead (see tests/test_ml.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import ml as ML
from riskloom.operators.sampling import kfold
from riskloom.plans import stats_queries as SQ
from riskloom.plans.common import register, round_doubles

DIGITS = 6
K_SELECT = 4


@register("select_l1_logistic")
def q_l1(spark, d):
    return round_doubles(ML.select_l1_logistic(SQ.feats(spark, d), SQ.FEATS, "y", c=1.0, k=100), DIGITS)


@register("select_random_forest")
def q_rf(spark, d):
    return round_doubles(ML.select_random_forest(SQ.feats(spark, d), SQ.FEATS, "y", trees=100, k=100), DIGITS)


@register("select_gbdt")
def q_gbdt(spark, d):
    return round_doubles(ML.select_gbdt(SQ.feats(spark, d), SQ.FEATS, "y", iters=30, k=100), DIGITS)


@register("select_rfe_ridge")
def q_rfe(spark, d):
    return ML.select_rfe_ridge(SQ.feats(spark, d), SQ.FEATS, "y", n_select=K_SELECT, step=2, alpha=2000.0)


def _flags(df: DataFrame, name: str, col: str = "selected") -> DataFrame:
    return df.select("feature", F.col(col).cast("boolean").alias(name))


@register("feature_vote")
def q_vote6(spark, d):
    """Six selectors → boolean table → Total → best K (ties: feature name descending)."""
    from riskloom.plans.misc_queries import selector_scores
    from riskloom.operators.selection import vote_table
    f = SQ.feats(spark, d)
    stats = vote_table({k: v for k, v in selector_scores(spark, d).items() if k in ("pearson", "chi2")}, K_SELECT)
    t = (stats.join(_flags(ML.select_rfe_ridge(f, SQ.FEATS, "y", K_SELECT, 2), "rfe"), "feature")
              .join(_flags(ML.select_l1_logistic(f, SQ.FEATS, "y"), "logistics"), "feature")
              .join(_flags(ML.select_random_forest(f, SQ.FEATS, "y", trees=50), "random_forest"), "feature")
              .join(_flags(ML.select_gbdt(f, SQ.FEATS, "y", iters=20), "lightgbm"), "feature"))
    names = ["pearson", "chi2", "rfe", "logistics", "random_forest", "lightgbm"]
    total = sum((F.col(n).cast("int") for n in names[1:]), F.col(names[0]).cast("int"))
    t = t.select("feature", *names, total.alias("total"))
    best = t.orderBy(F.col("total").desc(), F.col("feature").desc()).limit(K_SELECT).select("feature", F.lit(True).alias("best"))
    return t.join(best, "feature", "left").withColumn("best", F.coalesce("best", F.lit(False)))


N_FOLDS, FOLD_SEED = 2, 1001
# few rows at the small scale factors: shallower trees than the defaults, larger steps
SMALL = {"iters": 40, "stepSize": 0.1, "maxDepth": 3, "minInstancesPerNode": 5, "minInfoGain": 0.0}


def boosted(spark, d):
    """Cross-validated boosting on three quarters of the rows, stratified folds;
    the other quarter is scored by the mean of the models."""
    from riskloom.operators.sampling import stratified_kfold, train_test_split
    f = train_test_split(SQ.feats(spark, d), "vec_id", 75, 42)
    train = stratified_kfold(f.where("is_train"), "vec_id", "y", N_FOLDS, FOLD_SEED)
    return ML.kfold_gbdt(train, f.where(~F.col("is_train")), "vec_id", SQ.FEATS, "y", "fold", N_FOLDS, **SMALL)


@register("kfold_gbdt")
def q_kfold_gbdt(spark, d):
    """Out-of-fold rows with their fold, and test rows (no fold)."""
    oof, test, _, _ = boosted(spark, d)
    rows = oof.select("vec_id", "fold", F.col("oof_probability").alias("probability")).unionByName(
        test.select("vec_id", F.col("test_probability").alias("probability")), allowMissingColumns=True)
    return round_doubles(rows, DIGITS)


@register("kfold_gbdt_auc")
def q_kfold_auc(spark, d):
    return round_doubles(boosted(spark, d)[3], DIGITS)


@register("importance_mean_top40")
def q_top40(spark, d):
    """Mean boosting importance over the folds, the 40 best."""
    from riskloom.operators.selection import top_features
    imp = boosted(spark, d)[2]
    return round_doubles(top_features(imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance")), 40), DIGITS)


@register("semi_join_top_features")
def q_semi(spark, d):
    """Per-fold boosting importances of the best features by their mean."""
    from riskloom.operators.selection import top_features
    imp = boosted(spark, d)[2].select("fold", "feature", "importance")
    top = top_features(imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance")), 3).select("feature")
    return round_doubles(imp.join(top, "feature", "left_semi"), DIGITS)


STRATIFIED_SQL = f"""SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(vec_id AS VARCHAR) || '|{FOLD_SEED}')) - 1)
  % {N_FOLDS} AS INTEGER) AS fold FROM feats"""


@register("stratified_kfold_split", SQ.fsql(f"SELECT vec_id, y, fold FROM ({STRATIFIED_SQL}) f"))
def q_stratified(spark, d):
    from riskloom.operators.sampling import stratified_kfold
    return round_doubles(stratified_kfold(SQ.feats(spark, d).select("vec_id", "y"), "vec_id", "y", N_FOLDS, FOLD_SEED), DIGITS)


def _auc_sql(where: str, fold: str) -> str:
    return f"""SELECT {fold} AS fold, (sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
      / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)) AS auc,
    count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y <> 1) AS n_neg
  FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM sf {where}) x"""


@register("kfold_auc", SQ.fsql(f"""WITH sf AS (SELECT y, fold, {SQ.FEATS[0]} AS s FROM ({STRATIFIED_SQL}) f) """
          + " UNION ALL ".join([_auc_sql(f"WHERE fold = {k}", str(k)) for k in range(N_FOLDS)] + [_auc_sql("", "-1")])))
def q_fold_auc(spark, d):
    """AUC of one feature per stratified fold and over all (fold -1): the
    scoring step of ``kfold_gbdt`` on a score that SQL has too."""
    from riskloom.operators.sampling import stratified_kfold
    from riskloom.operators.stats import auc_roc
    f = stratified_kfold(SQ.feats(spark, d), "vec_id", "y", N_FOLDS, FOLD_SEED)
    whole = auc_roc(f, SQ.FEATS[0], "y").withColumn("fold", F.lit(-1))
    return round_doubles(auc_roc(f, SQ.FEATS[0], "y", group="fold").unionByName(whole), DIGITS)


@register("vif")
def q_vif(spark, d):
    return round_doubles(ML.vif(SQ.feats(spark, d), SQ.FEATS), DIGITS)


@register("vif_elimination")
def q_vif_elim(spark, d):
    return ML.vif_elimination(SQ.feats(spark, d), SQ.FEATS, "y", threshold=5.0)


@register("predict_probability")
def q_predict(spark, d):
    f = SQ.feats(spark, d)
    model = ML.fit_probability_model(f, SQ.FEATS, "y")
    return round_doubles(ML.predict_probability(model, f, "vec_id"), DIGITS)


@register("sampled_contributions")
def q_shap(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    f = SQ.feats(spark, d)
    model = Pipeline(stages=[VectorAssembler(inputCols=SQ.FEATS, outputCol="features"),
                             RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=20, seed=42)]).fit(f)
    return round_doubles(ML.sampled_contributions(model, f, f, "vec_id", SQ.FEATS, permutations=8), DIGITS)


@register("tree_contributions")
def q_tree_contributions(spark, d):
    """Exact contributions to a forest's probability, every row and feature."""
    from pyspark.ml.classification import RandomForestClassifier
    from riskloom.operators.trees import tree_contributions
    f = SQ.feats(spark, d)
    m = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=20, seed=42).fit(ML.assembled(f, SQ.FEATS))
    return round_doubles(tree_contributions(m, f, "vec_id", SQ.FEATS), DIGITS)


@register("tree_contributions_gbdt")
def q_tree_contributions_gbdt(spark, d):
    """Exact contributions to a boosted ensemble's margin."""
    from pyspark.ml.classification import GBTClassifier
    from riskloom.operators.trees import tree_contributions
    f = SQ.feats(spark, d)
    m = GBTClassifier(featuresCol="features", labelCol="y", maxIter=20, stepSize=0.1, seed=42).fit(ML.assembled(f, SQ.FEATS))
    return round_doubles(tree_contributions(m, f, "vec_id", SQ.FEATS), DIGITS)


@register("online_sgd")
def q_online_sgd(spark, d):
    from riskloom.streaming.online import online_sgd_batches
    f = kfold(SQ.feats(spark, d), "vec_id", 5, 7).withColumnRenamed("fold", "batch")
    return round_doubles(online_sgd_batches(f, SQ.FEATS, "y", "batch"), DIGITS)


@register("stream_online_sgd")
def q_stream_online_sgd(spark, d):
    """online_sgd as a foreachBatch stream over mini-batch files landed in
    batch order (the batch twin is ``online_sgd``)."""
    from riskloom.session import scratch_table_path
    from riskloom.streaming.online import METRICS_SCHEMA, online_sgd_stream
    f = kfold(SQ.feats(spark, d), "vec_id", 5, 7).withColumnRenamed("fold", "batch")
    base = scratch_table_path(spark, "stream-sgd")
    cols = ["batch", "vec_id", "y", *SQ.FEATS]
    f = f.select(*cols)
    # one folder per mini-batch, written oldest first (5 batch ids: a bounded loop)
    for bid in range(5):
        f.where(F.col("batch") == bid).coalesce(1).write.parquet(f"{base}/landing/b={bid}")
    schema = ", ".join(f"{fld.name} {fld.dataType.simpleString()}" for fld in f.schema.fields)
    online_sgd_stream(spark, f"{base}/landing", schema, SQ.FEATS, "y", "batch", f"{base}/state", f"{base}/sink",
                      f"{base}/checkpoint").awaitTermination()
    m = spark.read.schema(METRICS_SCHEMA).parquet(f"{base}/sink")
    return round_doubles(m.select(*[c.split()[0] for c in METRICS_SCHEMA.split(", ")]), DIGITS)
