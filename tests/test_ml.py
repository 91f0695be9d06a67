"""Invariants of the iterative / randomised operators (rows-only in the oracle check)."""

import math

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators import ml as ML
from riskloom.operators import stats as ST
from riskloom.operators.sampling import kfold, undersample_majority
from riskloom.plans import stats_queries as SQ


def test_auc_in_unit_interval_and_equals_mllib(spark, sf_small):
    f = SQ.feats(spark, sf_small)
    ours = ST.auc_roc(f, "e0", "y").first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="e0", labelCol="y", metricName="areaUnderROC")
    theirs = ev.evaluate(f.select(F.col("e0").cast("double"), F.col("y").cast("double")))
    assert 0.0 <= ours <= 1.0
    assert math.isclose(ours, theirs, abs_tol=1e-9)


def test_kfold_covers_each_row_once(spark, sf_small):
    f = SQ.feats(spark, sf_small)
    k = kfold(f, "vec_id", 5, 7)
    assert k.count() == f.count() == k.select("vec_id").distinct().count()
    folds = {r["fold"]: r["n"] for r in k.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(folds) == set(range(5)) and all(n > 0 for n in folds.values())


def test_undersample_gives_equal_classes(spark, sf_small):
    f = SQ.feats(spark, sf_small)
    u = undersample_majority(f, "vec_id", "y")
    counts = {r["y"]: r["n"] for r in u.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = {r["y"]: r["n"] for r in f.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(set(counts.values())) == 1 and list(counts.values())[0] == min(full.values())


def test_contributions_sum_to_prediction(spark, sf_small):
    f = SQ.feats(spark, sf_small)
    coef = {"e0": 0.7, "e1": -1.3, "e2": 0.25}
    long = X.contributions(f, "vec_id", coef, 0.4)
    chk = long.groupBy("vec_id").agg(F.sum("contribution").alias("s"), F.first("base_value").alias("b"),
                                     F.first("prediction").alias("p"))
    bad = chk.where(F.abs(F.col("s") + F.col("b") - F.col("p")) > 1e-9).count()
    assert bad == 0


def test_selectors_and_vif(spark, sf_small):
    f = SQ.feats(spark, sf_small)
    rfe = ML.select_rfe_ridge(f, SQ.FEATS, "y", n_select=4, step=2, alpha=2000.0)
    assert rfe.where(F.col("selected")).count() == 4
    assert rfe.count() == len(SQ.FEATS)
    v = ML.vif(f, SQ.FEATS).collect()
    assert len(v) == len(SQ.FEATS) and all(r["vif"] >= 1.0 - 1e-9 for r in v)


def test_stratified_folds_spread_every_class(spark, sf_small):
    from riskloom.operators.sampling import stratified_kfold
    f = SQ.feats(spark, sf_small).select("vec_id", "y")
    k = stratified_kfold(f, "vec_id", "y", 3).cache()
    assert k.columns == ["vec_id", "y", "fold"] and k.count() == f.count() == k.select("vec_id").distinct().count()
    n = {(r["y"], r["fold"]): r["n"] for r in k.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in {y for y, _ in n}:
        counts = [n[y, fold] for fold in range(3)]
        assert max(counts) - min(counts) <= 1


def test_kfold_gbdt_folds_early_stop_auc_and_test_mean(spark, sf_small):
    from riskloom.operators.sampling import stratified_kfold, train_test_split
    f = train_test_split(SQ.feats(spark, sf_small), "vec_id", 75, 42)
    train, test = stratified_kfold(f.where("is_train"), "vec_id", "y", 2), f.where("NOT is_train")
    small = {"stepSize": 0.3, "maxDepth": 3, "minInstancesPerNode": 5, "minInfoGain": 0.0}
    feats = SQ.FEATS[:12]
    oof, scored, imp, auc = ML.kfold_gbdt(train, test, "vec_id", feats, "y", "fold", 2, iters=60, tolerance=0.05, **small)
    assert oof.count() == train.count() == oof.select("vec_id").distinct().count()
    got = {r["vec_id"]: r["test_probability"] for r in scored.collect()}
    assert len(got) == test.count() and all(0 <= p <= 1 for p in got.values())
    n_trees = {r["fold"]: r["n_trees"] for r in imp.collect()}
    assert imp.count() == 2 * len(feats) and all(1 <= n < 60 for n in n_trees.values())      # stopped before the last round
    rows = {r["fold"]: r["auc"] for r in auc.collect()}
    ev = BinaryClassificationEvaluator(rawPredictionCol="oof_probability", labelCol="y")
    y = oof.withColumn("y", F.col("y").cast("double"))
    assert math.isclose(rows[-1], ev.evaluate(y), abs_tol=1e-9)
    assert all(math.isclose(rows[k], ev.evaluate(y.where(F.col("fold") == k)), abs_tol=1e-9) for k in (0, 1))


def _enumerated(model, x, k):
    """Shapley values by their definition: expected output for every subset of
    known features, walking each tree with node counts."""
    from itertools import combinations
    forest = type(model).__name__.startswith("RandomForest")

    def value(node, known):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats) if forest else node.prediction()
        f, cut = node.split().featureIndex(), node.split().threshold()
        sides = [node.leftChild(), node.rightChild()]
        if f in known:
            return value(sides[0] if x[f] <= cut else sides[1], known)
        n = [s.impurityStats().count() for s in sides]
        return (n[0] * value(sides[0], known) + n[1] * value(sides[1], known)) / sum(n)
    total = sum(model.treeWeights) if forest else 1.0
    roots = [(t._call_java("rootNode"), w / total) for t, w in zip(model.trees, model.treeWeights)]
    out = {s: sum(w * value(r, set(s)) for r, w in roots) for n in range(k + 1) for s in combinations(range(k), n)}
    phi = []
    for f in range(k):
        rest = [i for i in range(k) if i != f]
        phi.append(sum(math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k)
                       * (out[tuple(sorted((*s, f)))] - out[s]) for n in range(k) for s in combinations(rest, n)))
    return phi, out[()], out[tuple(range(k))]


def test_tree_contributions_equal_enumeration(spark, sf_small):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from riskloom.operators.trees import tree_contributions
    feats = SQ.FEATS[:6]
    f = SQ.feats(spark, sf_small).select("vec_id", "y", *[F.col(c).cast("double") for c in feats])
    data = ML.assembled(f, feats).cache()
    for m, margin in ((RandomForestClassifier(labelCol="y", numTrees=5, maxDepth=5, seed=1).fit(data), False),
                      (GBTClassifier(labelCol="y", maxIter=5, maxDepth=4, seed=1).fit(data), True)):
        got = {}
        for r in tree_contributions(m, f, "vec_id", feats).collect():
            got.setdefault(r["vec_id"], {})[r["feature"]] = r
        assert len(got) == f.count()
        p = {r["vec_id"]: r["p"] for r in m.transform(data).select("vec_id", vector_to_array("probability")[1].alias("p")).collect()}
        for i, rows in got.items():
            base, out = rows[feats[0]]["base_value"], rows[feats[0]]["output"]
            assert math.isclose(base + sum(r["contribution"] for r in rows.values()), out, abs_tol=1e-9)
            assert math.isclose(1 / (1 + math.exp(-2 * out)) if margin else out, p[i], abs_tol=1e-9)
        for row in f.orderBy("vec_id").limit(4).collect():
            phi, base, out = _enumerated(m, [row[c] for c in feats], len(feats))
            rows = got[row["vec_id"]]
            assert math.isclose(base, rows[feats[0]]["base_value"], abs_tol=1e-9)
            assert all(math.isclose(rows[c]["contribution"], v, abs_tol=1e-9) for c, v in zip(feats, phi))


def test_tree_contributions_of_missing_values_and_empty_tables(spark, sf_small):
    from pyspark.ml.classification import RandomForestClassifier
    from riskloom.operators.trees import tree_contributions
    feats = SQ.FEATS[:3]
    f = SQ.feats(spark, sf_small).select("vec_id", "y", *[F.col(c).cast("double") for c in feats])
    m = RandomForestClassifier(labelCol="y", numTrees=3, seed=1).fit(ML.assembled(f, feats))
    gap = f.limit(2).withColumn(feats[0], F.lit(None).cast("double"))
    rows = tree_contributions(m, gap, "vec_id", feats).collect()
    assert len(rows) == 6 and all(r["contribution"] is not None for r in rows)
    assert all((r["value"] is None) == (r["feature"] == feats[0]) for r in rows)
    assert tree_contributions(m, f.limit(0), "vec_id", feats).count() == 0


def test_sampled_contributions_add_up_without_sorting_instances(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    feats = ["a", "b", "c"]
    data = [(i, float(i % 5), math.sin(i), i % 7, int(i % 3 == 0)) for i in range(60)]
    f = spark.createDataFrame([*data, data[11], (None, 1.0, 2.0, 3, 1)], "id long, a double, b double, c int, y int")   # one row twice, one without key
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                             LogisticRegression(labelCol="y", regParam=0.01)]).fit(f)
    out = ML.sampled_contributions(model, f, f, "id", feats, permutations=4)
    # instances are summed where they are scored: no window brings them together by row and permutation
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], {})[r["feature"]] = r
    assert set(got) == {*range(60), None} and all(set(v) == set(feats) for v in got.values())
    h = F.xxhash64(*feats, F.lit(7))
    p = vector_to_array("probability")[1].alias("p")
    base = [r["p"] for r in model.transform(f.orderBy(h).limit(4)).select(p).collect()]
    for r in model.transform(f).select("id", p).collect():
        copies = 2 if r["id"] == 11 else 1
        rows = got[r["id"]].values()
        assert all(x["n_permutations"] == 4 * copies for x in rows)
        assert math.isclose(copies * sum(x["contribution"] for x in rows), r["p"] - sum(base) / 4, abs_tol=1e-9)
    few = ML.sampled_contributions(model, f.limit(3), f.limit(2), "id", feats, permutations=4)   # fewer background rows than asked for
    assert {r["n_permutations"] for r in few.collect()} == {2}
    assert ML.sampled_contributions(model, f.limit(0), f, "id", feats).count() == 0
