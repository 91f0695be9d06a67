"""Online logistic SGD with drift-adaptive learning rate.

Mini-batches arrive in order; for each one the job (1) tests drift with the
two-sample KS statistic per feature against the reference window (the last
``window`` rows already seen), averaging the asymptotic p-values, (2) adapts
the learning rate, (3) takes one gradient step.  Every data pass is a
distributed aggregate; only the k+1 coefficients live on the driver (the
state a ``foreachBatch`` sink would carry between micro-batches).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.stats import ks_two_sample

# Reference learner settings.
WINDOW = 100
DRIFT_P = 0.2
LR_START, LR_MAX, LR_MIN = 0.1, 1.0, 0.01


def adapt_learning_rate(lr: float, p_value: float) -> float:
    if p_value < 0.05:
        return min(LR_MAX, lr * 1.5)
    if p_value < 0.1:
        return min(LR_MAX, lr * 1.2)
    return max(LR_MIN, lr * 0.9)


def _logit(w, b, feats: Sequence[str]):
    z = F.lit(float(b))
    for wi, f in zip(w, feats):
        z = z + F.lit(float(wi)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return z


def sgd_step(batch: DataFrame, w, b, lr: float, feats: Sequence[str], label: str):
    """One full-batch gradient step of the logistic loss (one aggregate pass),
    plus accuracy and log-loss of the pre-update model on this batch."""
    # the prediction is projected once per row: inlined into each of the k+1
    # gradient sums it would grow the generated code past the JVM method limit
    eps = 1e-15
    pre = batch.select(F.col(label).cast("double").alias("__y"),
                       *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, f in enumerate(feats)],
                       (F.lit(1.0) / (F.lit(1.0) + F.exp(-_logit(w, b, feats)))).alias("__p"))
    p, y = F.col("__p"), F.col("__y")
    err = p - y
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    row = pre.agg(F.count(F.lit(1)).alias("n"), F.sum(err).alias("g0"),
                  *[F.sum(err * F.col(f"__x{i}")).alias(f"g_{i}") for i in range(len(feats))],
                  F.avg(((p > 0.5).cast("double") == y).cast("double")).alias("acc"),
                  (-F.avg(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("ll")).collect()[0]
    n = row["n"] or 1
    w2 = [wi - lr * (row[f"g_{i}"] or 0.0) / n for i, wi in enumerate(w)]
    b2 = b - lr * (row["g0"] or 0.0) / n
    return w2, b2, row["n"], row["acc"], row["ll"]


def mean_ks_pvalue(reference: DataFrame, batch: DataFrame, feats: Sequence[str]) -> float:
    u = (reference.select(F.lit(0).alias("sample"), *feats).unionByName(batch.select(F.lit(1).alias("sample"), *feats)))
    long = u.select("sample", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"))
                                                  for f in feats])).alias("s")).select("sample", "s.*")
    k = ks_two_sample(long, "v", "sample", group="feature")
    v = k.agg(F.avg("p_value").alias("p")).collect()[0]["p"]  # one row per feature, averaged
    return 1.0 if v is None or math.isnan(v) else float(v)


def online_sgd_batches(df: DataFrame, feats: Sequence[str], label: str, batch_col: str, order_key: str = "vec_id",
                       window: int = WINDOW) -> DataFrame:
    spark = df.sparkSession
    batches = [r[0] for r in df.select(batch_col).distinct().orderBy(batch_col).collect()]  # batch ids only
    w, b, lr = [0.0] * len(feats), 0.0, LR_START
    out = []
    for bid in batches:
        cur = df.where(F.col(batch_col) == bid)
        seen = df.where(F.col(batch_col) < bid)
        ref = seen.orderBy(F.col(batch_col).desc(), F.col(order_key).desc()).limit(window)
        n_ref = ref.count()
        p = mean_ks_pvalue(ref, cur, feats) if n_ref >= window else 1.0
        drift = n_ref >= window and p < DRIFT_P
        lr = adapt_learning_rate(lr, p) if n_ref >= window else lr
        w, b, n, acc, ll = sgd_step(cur, w, b, lr, feats, label)
        out.append((int(bid), int(n), float(lr), float(p), bool(drift), acc, ll, float(math.sqrt(sum(x * x for x in w)))))
    return spark.createDataFrame(out, "batch int, n long, learning_rate double, mean_p_value double, drift boolean, "
                                      "accuracy double, log_loss double, coef_norm double")


# ---------------------------------------------------------------- streaming
METRICS_SCHEMA = ("batch int, n long, learning_rate double, mean_p_value double, drift boolean, "
                  "accuracy double, log_loss double, coef_norm double")


def online_sgd_stream(spark, landing: str, schema: str, feats: Sequence[str], label: str, batch_col: str,
                      state_dir: str, sink: str, checkpoint: str, order_key: str = "vec_id", window: int = WINDOW):
    """The same learner as a Structured Streaming job: each micro-batch (one
    landed mini-batch file) is tested for drift against the reference window
    and takes one gradient step inside ``foreachBatch``.

    Between micro-batches the model (k+1 coefficients and the learning rate)
    and the reference window (at most ``window`` rows) are small tables under
    ``state_dir``, written per micro-batch id: a restarted query (or a
    re-executed micro-batch) reads the state of the last completed batch and
    overwrites its own outputs, so results are written exactly once.
    """
    feats = list(feats)
    model_schema = "w array<double>, b double, lr double"

    def path(kind: str, batch_id: int) -> str:
        return f"{state_dir.rstrip('/')}/{kind}/id={batch_id}"

    def latest(kind: str, upto: int, schema: str | None = None):
        """State of the newest micro-batch id < upto, read through Spark (works
        on any shared file system); None before the first batch."""
        from pyspark.errors import AnalysisException
        try:
            r = spark.read
            if schema:
                r = r.schema(schema + ", id long")
            allv = r.parquet(f"{state_dir.rstrip('/')}/{kind}")
        except AnalysisException:
            return None
        top = allv.where(F.col("id") < upto).agg(F.max("id")).first()[0]
        return None if top is None else allv.where(F.col("id") == top).drop("id")

    def step(batch_df: DataFrame, batch_id: int):
        if batch_df.isEmpty():
            return
        mp = latest("model", batch_id, model_schema)
        m = mp.first() if mp is not None else None
        if m is not None:
            w, b, lr = list(m["w"]), m["b"], m["lr"]
        else:
            w, b, lr = [0.0] * len(feats), 0.0, LR_START
        ref = latest("reference", batch_id)
        n_ref = ref.count() if ref is not None else 0   # at most `window` rows
        cur = batch_df.select(batch_col, order_key, label, *feats)
        p = mean_ks_pvalue(ref, cur, feats) if n_ref >= window else 1.0
        drift = n_ref >= window and p < DRIFT_P
        lr = adapt_learning_rate(lr, p) if n_ref >= window else lr
        w, b, n, acc, ll = sgd_step(cur, w, b, lr, feats, label)
        bid = cur.agg(F.min(batch_col)).first()[0]
        norm = float(math.sqrt(sum(x * x for x in w)))
        spark.createDataFrame([(w, float(b), float(lr))], model_schema).coalesce(1).write.mode("overwrite") \
            .parquet(path("model", batch_id))
        both = cur if ref is None else ref.select(*cur.columns).unionByName(cur)
        (both.orderBy(F.col(batch_col).desc(), F.col(order_key).desc()).limit(window)   # the reference window
             .write.mode("overwrite").parquet(path("reference", batch_id)))
        spark.createDataFrame([(int(bid), int(n), float(lr), float(p), bool(drift), acc, ll, norm)], METRICS_SCHEMA) \
            .coalesce(1).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/id={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())
