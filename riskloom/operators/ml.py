"""Model-based selection, cross-validated boosting, VIF and scoring (SURVEY §2.11 'R').

Data-sized work runs on Spark (MLlib estimators, one-pass Gramian /
correlation aggregates, ``transform``); only k×k matrices -- k = number of
features, bounded by the schema -- are solved on the driver with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def assembled(df: DataFrame, feats: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="keep").transform(df)


def _importance_table(spark: SparkSession, feats: Sequence[str], values, name: str) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(feats, values)]
    return spark.createDataFrame(rows, f"feature string, {name} double")


def select_l1_logistic(df: DataFrame, feats: Sequence[str], label: str, c: float = 1.0, k: int = 100) -> DataFrame:
    """SelectFromModel on an L1 logistic regression (sklearn's summed loss with
    C maps to MLlib's averaged loss with regParam = 1 / (C·n))."""
    n = df.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=1.0,
                            regParam=1.0 / (c * n), standardization=False, maxIter=200)
    m = lr.fit(assembled(df, feats))
    t = _importance_table(df.sparkSession, feats, m.coefficients.toArray(), "coef")
    t = t.withColumn("score", F.abs("coef"))
    return _top_selected(t.withColumn("selected", F.col("score") > 1e-5), k)


def _top_selected(t: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window
    w = Window.orderBy(F.col("score").desc(), F.col("feature"))  # one row per feature
    return t.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("selected") & (F.col("rank") <= k))


def select_random_forest(df: DataFrame, feats: Sequence[str], label: str, trees: int = 100, k: int = 100,
                         seed: int = 42) -> DataFrame:
    m = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed).fit(assembled(df, feats))
    imp = m.featureImportances.toArray()
    t = _importance_table(df.sparkSession, feats, imp, "score")
    return _top_selected(t.withColumn("selected", F.col("score") >= float(np.mean(imp))), k)


def select_gbdt(df: DataFrame, feats: Sequence[str], label: str, iters: int = 50, k: int = 100, seed: int = 42) -> DataFrame:
    m = GBTClassifier(featuresCol="features", labelCol=label, stepSize=0.05, maxIter=iters, seed=seed).fit(assembled(df, feats))
    imp = m.featureImportances.toArray()
    t = _importance_table(df.sparkSession, feats, imp, "score")
    return _top_selected(t.withColumn("selected", F.col("score") >= float(np.mean(imp))), k)


def gramian(df: DataFrame, feats: Sequence[str], label: str | None = None):
    """One distributed pass: n, Σx, Σxxᵀ (and Σxy, Σy) over complete rows."""
    cols = list(feats) + ([label] if label else [])
    k = len(cols)
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()

    def partial(batches):
        # a leading column of ones gives n and the sums in the same product
        g = np.zeros((k + 1, k + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns]])
            g += x.T @ x
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": g[i, j]})
    rows = d.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    g = np.zeros((k + 1, k + 1))   # (k + 1)(k + 2) / 2 numbers: as large as the result
    for r in rows:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    return int(round(g[0, 0])), g[0, 1:], g[1:, 1:]


def ridge_coefficients(n, s, p, k, alpha):
    """Ridge with a free intercept on centred data: (Sxx + αI)⁻¹ Sxy."""
    sxx = p[:k, :k] - np.outer(s[:k], s[:k]) / n
    sxy = p[:k, k] - s[:k] * s[k] / n
    return np.linalg.solve(sxx + alpha * np.eye(k), sxy)


def select_rfe_ridge(df: DataFrame, feats: Sequence[str], label: str, n_select: int, step: int,
                     alpha: float = 2000.0) -> DataFrame:
    """Recursive elimination with a ridge classifier (targets ±1): drop the
    ``step`` smallest coef² per round until ``n_select`` remain.  One Gramian
    pass; every round is a k×k solve on a sub-matrix."""
    y = df.withColumn("__y", F.when(F.col(label) == 1, 1.0).otherwise(-1.0))
    n, s, p = gramian(y, feats, "__y")
    k = len(feats)
    alive = list(range(k))
    ranking = {}
    rnd = 0
    while len(alive) > n_select:
        idx = alive + [k]
        coef = ridge_coefficients(n, s[idx], p[np.ix_(idx, idx)], len(alive), alpha)
        drop = min(step, len(alive) - n_select)
        order = np.argsort(coef ** 2, kind="stable")[:drop]
        rnd += 1
        for o in order:
            ranking[alive[o]] = rnd
        alive = [a for j, a in enumerate(alive) if j not in set(order)]
    rows = [(f, i in alive, 0 if i in alive else ranking[i]) for i, f in enumerate(feats)]
    return df.sparkSession.createDataFrame(rows, "feature string, selected boolean, eliminated_round int")


def correlation_matrix_np(df: DataFrame, feats: Sequence[str]) -> np.ndarray:
    """Pearson matrix over complete rows (0 where a column does not vary)."""
    n, s, p = gramian(df, feats)
    cov = p - np.outer(s, s) / max(n, 1)
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(np.outer(sd, sd) > 0, cov / np.outer(sd, sd), 0.0)
    np.fill_diagonal(c, 1.0)
    return c


VIF_EPS = 1e-4


def vif_from_corr(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R²_j = 1 − 1/[C⁻¹]_jj; tolerance = 1 − R²; VIF = 1/(tolerance + 1e-4)."""
    inv = np.linalg.pinv(c)
    r2 = 1.0 - 1.0 / np.diag(inv)
    tol = np.clip(1.0 - r2, 0.0, None)
    return 1.0 / (tol + VIF_EPS), tol


def vif(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    v, tol = vif_from_corr(correlation_matrix_np(df, feats))
    rows = [(f, float(a), float(b)) for f, a, b in zip(feats, v, tol)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, tolerance double")


def vif_elimination(df: DataFrame, feats: Sequence[str], target: str, threshold: float = 5.0) -> DataFrame:
    """Drop the max-VIF feature while it exceeds ``threshold``; a zero
    tolerance drops the feature least correlated with the target instead."""
    feats = list(feats)
    c_all = correlation_matrix_np(df, feats + [target])
    c = c_all[:-1, :-1]
    tc = np.abs(c_all[:-1, -1])
    alive = list(range(len(feats)))
    dropped = {}
    step = 0
    while len(alive) > 1:
        sub = c[np.ix_(alive, alive)]
        v, tol = vif_from_corr(sub)
        if v.max() <= threshold:
            break
        step += 1
        if np.any(tol == 0):
            j = min(alive, key=lambda a: tc[a])
        else:
            j = alive[int(np.argmax(v))]
        dropped[j] = step
        alive.remove(j)
    rows = [(f, i in alive, dropped.get(i, 0)) for i, f in enumerate(feats)]
    return df.sparkSession.createDataFrame(rows, "feature string, kept boolean, dropped_step int")


# Parameters of the cross-validated boosting.
BOOSTING = {"stepSize": 0.02, "maxDepth": 8, "subsamplingRate": 0.8715623, "featureSubsetStrategy": "0.9497036",
            "minInfoGain": 0.0222415, "minInstancesPerNode": 39}


def kfold_gbdt(train: DataFrame, test: DataFrame | None, key: str, feats: Sequence[str], label: str, fold_col: str,
               n_folds: int, iters: int = 200, seed: int = 42, tolerance: float = 0.01, **params):
    """Cross-validated boosting with early stopping.

    Per fold a model is fitted on the other folds and stops once the fold's own
    loss improves by less than ``tolerance`` (relative); it keeps the trees of
    the best round.  Returns four tables:

    - out-of-fold probabilities (key, fold, label, oof_probability);
    - test probabilities (key, test_probability), the mean over the models
      (None without ``test``);
    - importances (fold, feature, importance, n_trees);
    - AUC (fold, auc, n_pos, n_neg), with one row of fold -1 over all folds.
    """
    from riskloom.operators.stats import auc_roc
    data = cut_lineage(assembled(train, feats).select(key, label, fold_col, "features"))
    scored = None if test is None else assembled(test, feats).select(key, "features")
    oof, imps = None, []
    for k in range(n_folds):
        gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=iters, seed=seed, validationTol=tolerance,
                            validationIndicatorCol="is_valid", **{**BOOSTING, **params})
        m = gbt.fit(data.withColumn("is_valid", F.col(fold_col) == k))
        p = m.transform(data.where(F.col(fold_col) == k)).select(
            key, F.lit(k).alias("fold"), label, vector_to_array("probability")[1].alias("oof_probability"))
        oof = p if oof is None else oof.unionByName(p)
        imps += [(k, f, float(v), m.getNumTrees) for f, v in zip(feats, m.featureImportances.toArray())]
        if scored is not None:
            kept = [c for c in scored.columns if c.startswith("p_")]
            scored = m.transform(scored).select(key, "features", *kept, vector_to_array("probability")[1].alias(f"p_{k}"))
    oof = cut_lineage(oof)
    imp = train.sparkSession.createDataFrame(imps, "fold int, feature string, importance double, n_trees int")
    auc = auc_roc(oof, "oof_probability", label, group="fold").unionByName(
        auc_roc(oof, "oof_probability", label).withColumn("fold", F.lit(-1)))
    if scored is not None:
        mean = sum((F.col(f"p_{k}") for k in range(1, n_folds)), F.col("p_0")) / n_folds
        scored = scored.select(key, mean.alias("test_probability"))
    return oof, scored, imp, auc


def fit_probability_model(df: DataFrame, feats: Sequence[str], label: str):
    """Median imputation + assembler + logistic regression, as one pipeline."""
    imp_cols = [f"{f}__imp" for f in feats]
    pipe = Pipeline(stages=[Imputer(inputCols=list(feats), outputCols=imp_cols, strategy="median"),
                            VectorAssembler(inputCols=imp_cols, outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol=label, maxIter=100)])
    return pipe.fit(df)


def predict_probability(model, df: DataFrame, key: str) -> DataFrame:
    return model.transform(df).select(key, vector_to_array("probability")[1].alias("y_pred_proba"))


# Fixed value: scored instances of one task of ``sampled_contributions``.
INSTANCES = 250_000


def sampled_contributions(model, rows: DataFrame, background: DataFrame, key: str, feats: Sequence[str],
                          permutations: int = 8, seed: int = 7) -> DataFrame:
    """Permutation-sampling Shapley values for any fitted model.

    Each (row, permutation p) is paired with background row p (an equi-join on
    p, no cross product); features enter in a seeded-hash order; the k+1
    partial instances are scored by one distributed ``transform`` and the
    marginal changes averaged per (row, feature).

    An instance's score counts for the feature that entered last and against
    the one that enters next, so the changes are sums by (row, feature), one
    for each permutation, combined in the task that scored them: instances are
    neither shuffled nor sorted.  Rows of one key share its contribution by equal parts.
    """
    from pyspark.sql import Window
    k = len(feats)
    # background rows: the ``permutations`` smallest seeded hashes -- a
    # distributed top-n (TakeOrderedAndProject), numbered after it is taken
    h = F.xxhash64(*[F.col(f"__b_{f}") for f in feats], F.lit(seed))
    picked = (background.select(*[F.col(f).alias(f"__b_{f}") for f in feats]).withColumn("__h", h)
                        .orderBy("__h").limit(permutations))
    bg = cut_lineage(picked.select((F.row_number().over(Window.orderBy("__h")) - 1).alias("__p"),
                                   F.struct(*[F.col(f"__b_{f}").alias(f"f{i}") for i, f in enumerate(feats)]).alias("__bg")))
    pairs = bg.count()
    # a row becomes pairs * (k + 1) instances: tasks are cut by their number, not by the bytes of the rows
    r = rows.select(key, F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(feats)]).alias("__own"))
    tasks = -(-rows.count() * pairs * (k + 1) // INSTANCES)
    r = r.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, tasks))
    j = (r.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
          .join(F.broadcast(bg), "__p"))   # at most ``permutations`` rows
    # features in the order of this (row, p) permutation, by seeded hash
    hashed = F.array(*[F.struct(F.xxhash64(F.col(key), F.col("__p"), F.lit(f), F.lit(seed)).alias("h"), F.lit(i).alias("i"))
                       for i, f in enumerate(feats)])
    j = j.withColumn("__order", F.sort_array(hashed)["i"])
    # and the place of each feature in it
    j = j.withColumn("__place", F.sort_array(F.transform("__order", lambda i, at: F.struct(i.alias("i"), at.alias("at"))))["at"])
    j = j.withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(k))))
    # step s has the row's own value of the first s features
    inst = j.select(key, "__p", F.get("__order", F.col("__step") - 1).alias("__last"), F.get("__order", F.col("__step")).alias("__next"),
                    *[F.when(F.get("__place", F.lit(i)) < F.col("__step"), F.col(f"__own.f{i}")).otherwise(F.col(f"__bg.f{i}")).alias(f)
                      for i, f in enumerate(feats)])
    scored = model.transform(inst).select(key, "__p", "__last", "__next", vector_to_array("probability")[1].alias("__pr"))
    both = F.array(F.struct(F.col("__last").alias("i"), F.col("__pr").alias("v"), F.lit(1).alias("n")),
                   F.struct(F.col("__next").alias("i"), (-F.col("__pr")).alias("v"), F.lit(0).alias("n")))
    marg = scored.select(key, "__p", F.explode(both).alias("__m")).where(F.col("__m.i").isNotNull())
    sums = marg.groupBy(key, F.col("__m.i").alias("__i")).agg(
        *[F.sum(F.when(F.col("__p") == p, F.col("__m.v")).otherwise(0.0)).alias(f"__v{p}") for p in range(pairs)],
        F.sum("__m.n").alias("n_permutations"))
    n = F.col("n_permutations")
    total = sum((F.col(f"__v{p}") for p in range(pairs)), F.lit(0.0))
    return sums.select(key, F.get(F.array(*[F.lit(f) for f in feats]), F.col("__i")).alias("feature"),
                       (total / n / (n / F.lit(pairs))).alias("contribution"), "n_permutations")
