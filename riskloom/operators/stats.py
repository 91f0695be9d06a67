"""Statistics for feature selection and model evaluation (SURVEY §2.11 'S').

Every statistic is one (or two) distributed aggregate passes producing a
row per feature; per-feature tables are bounded by the number of columns,
so broadcasting them back is safe.  Rank-based statistics (AUC, KS, exact
quantiles) use the two-phase prefix counts of ``operators.ranks``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.aggregates import mean_of, var_of
from riskloom.operators.ranks import exact_quantiles, value_counts_ranked
from riskloom.operators.scores import nclip


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson r over complete (a, b) pairs; NULL when a variance is 0."""
    both = a.isNotNull() & b.isNotNull()
    pa, pb = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(pa, pb), F.stddev_samp(pa) * F.stddev_samp(pb))


def unpivot_row(df: DataFrame, names: Sequence[str], value_cols: dict[str, str], name_col: str = "feature") -> DataFrame:
    """A one-row (or few-row) wide result → one row per name."""
    structs = [F.struct(F.lit(n).alias(name_col), *[F.col(f"{pfx}{n}").alias(out) for out, pfx in value_cols.items()])
               for n in names]
    return df.select(F.explode(F.array(*structs)).alias("__s")).select("__s.*")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All-pairs Pearson r (pairwise complete), clipped to [-1, 1], long form."""
    aggs = [nclip(pair_corr(F.col(a).cast("double"), F.col(b).cast("double")), -1.0, 1.0).alias(f"{a}__{b}")
            for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*aggs)
    at = {c: i for i, c in enumerate(cols)}
    structs = [F.struct(F.lit(a).alias("feature"), F.lit(b).alias("feature_b"),
                        F.col(f"{a}__{b}" if at[a] <= at[b] else f"{b}__{a}").alias("corr"))
               for a in cols for b in cols]
    return row.select(F.explode(F.array(*structs)).alias("__s")).select("__s.*")


def target_correlation(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    row = df.agg(*[pair_corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r_{c}") for c in cols])
    long = unpivot_row(row, cols, {"corr": "r_"})
    return long.withColumn("abs_corr", F.abs("corr"))


def select_by_correlation(df: DataFrame, cols: Sequence[str], target: str, k: int = 100) -> DataFrame:
    """Top-k features by |r| (NULL r counts as 0); ties by feature name."""
    tc = target_correlation(df, cols, target).withColumn("score", F.coalesce(F.col("abs_corr"), F.lit(0.0)))
    return tc.orderBy(F.col("score").desc(), F.col("feature").asc()).limit(k)


def feature_quality(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """|r|, missing ratio, outlier ratio (|z| > 3, ddof=1), quality score."""
    n = F.count(F.lit(1))
    s1 = df.agg(n.alias("__n"),
                *[pair_corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r_{c}") for c in cols],
                *[F.count(c).alias(f"nn_{c}") for c in cols],
                *[mean_of(F.col(c).cast("double")).alias(f"mu_{c}") for c in cols],
                *[F.sqrt(var_of(F.col(c).cast("double"))).alias(f"sd_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(s1))  # one row
    s2 = j.agg(F.first("__n").alias("__n"),
               *[F.first(f"{p}_{c}").alias(f"{p}_{c}") for c in cols for p in ("r", "nn")],
               *[F.sum(F.coalesce(F.abs(F.try_divide(F.col(c) - F.col(f"mu_{c}"), F.col(f"sd_{c}"))) > 3,
                                  F.lit(False)).cast("int")).alias(f"out_{c}") for c in cols])
    long = s2.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), "__n", F.col(f"r_{c}").alias("correlation_with_target"),
        F.col(f"nn_{c}").alias("non_null"), F.col(f"out_{c}").alias("outliers")) for c in cols])).alias("s")).select("s.*")
    miss = (F.col("__n") - F.col("non_null")) / F.col("__n")
    outr = F.col("outliers") / F.col("__n")
    return long.select("feature", F.abs("correlation_with_target").alias("importance_score"),
                       miss.alias("missing_ratio"), outr.alias("outlier_ratio"), "correlation_with_target",
                       ((F.lit(1.0) - miss) * (F.lit(1.0) - outr) * F.abs("correlation_with_target"))
                       .alias("data_quality_score"))


def chi2_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """sklearn chi2 on non-negative features: Σ_c (O - E)² / E with
    O = class sum of x, E = P(class) · total sum of x."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"),
                                      *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in cols])
    tot = per_class.agg(F.sum("__nc").alias("__N"), *[F.sum(f"s_{c}").alias(f"t_{c}") for c in cols])
    j = per_class.crossJoin(F.broadcast(tot))  # classes x 1: bounded
    terms = []
    for c in cols:
        e = F.col("__nc") / F.col("__N") * F.col(f"t_{c}")
        terms.append(F.sum(F.try_divide((F.col(f"s_{c}") - e) * (F.col(f"s_{c}") - e), e)).alias(f"chi_{c}"))
    row = j.agg(*terms)
    return unpivot_row(row, cols, {"chi2": "chi_"})


def auc_roc(df: DataFrame, score: str, label: str, group: str | None = None) -> DataFrame:
    """ROC AUC with average ranks for ties (Mann-Whitney), exact and distributed:
    Σ_v pos_v · (neg_before_v + neg_v / 2) / (P · N)."""
    y = F.col(label)
    r = value_counts_ranked(df, score, {"pos": (y == 1).cast("int"), "neg": (y != 1).cast("int")}, group=group)
    gk = [group] if group else []
    a = r.groupBy(*gk).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("__u"),
                           F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select(*gk, F.try_divide(F.col("__u"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def ks_two_sample(df: DataFrame, value: str, sample: str, group: str | None = None) -> DataFrame:
    """Two-sample KS statistic per ``group`` (sample column: 0 = reference,
    1 = current) and the asymptotic p-value 2 Σ (-1)^(j-1) exp(-2 j² λ²)."""
    s = F.col(sample)
    r = value_counts_ranked(df, value, {"a": (s == 0).cast("int"), "b": (s == 1).cast("int")}, group=group)
    gk = [group] if group else []
    tot = r.groupBy(*gk).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    j = r.join(tot, gk) if gk else r.crossJoin(F.broadcast(tot))  # per group: AQE sizes it
    d = j.groupBy(*gk, "n_a", "n_b").agg(
        F.max(F.abs(F.col("a_upto") / F.col("n_a") - F.col("b_upto") / F.col("n_b"))).alias("ks_stat"))
    lam = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("ks_stat")
    return d.withColumn("p_value", ks_pvalue(lam))


def ks_pvalue(lam: Column, terms: int = 100) -> Column:
    """2 Σ_{j=1..terms} (-1)^(j-1) exp(-2 j² λ²), summed left to right by one
    ``aggregate`` over ``sequence(1, terms)`` (an unrolled sum would repeat
    λ in every term and outgrow the JVM's generated-method limit)."""
    def add(acc, j):
        jd = j.cast("double")
        sign = F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return acc + sign * F.exp(F.lit(-2.0) * jd * jd * lam * lam)
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), add)
    return F.when(lam <= 0, F.lit(1.0)).otherwise(nclip(s, 0.0, 1.0))


# ----------------------------------------------------------------- scaling
def scale(df: DataFrame, cols: Sequence[str], how: str = "standard", suffix: str = "") -> DataFrame:
    """sklearn-style scalers fitted on the whole table (NULLs ignored in the
    fit and kept): standard (x-μ)/σ_pop, minmax (x-min)/range, robust
    (x-median)/IQR; a zero scale is replaced by 1."""
    if how == "standard":
        st = df.agg(*[mean_of(F.col(c)).alias(f"__c_{c}") for c in cols],
                    *[F.sqrt(var_of(F.col(c), ddof=0)).alias(f"__s_{c}") for c in cols])
    elif how == "minmax":
        st = df.agg(*[F.min(c).alias(f"__c_{c}") for c in cols],
                    *[(F.max(c) - F.min(c)).alias(f"__s_{c}") for c in cols])
    elif how == "robust":
        q = column_quantiles(df, cols, [0.25, 0.5, 0.75])
        st = q.select(*[F.col(f"{c}__q1").alias(f"__c_{c}") for c in cols],
                      *[(F.col(f"{c}__q2") - F.col(f"{c}__q0")).alias(f"__s_{c}") for c in cols])
    else:
        raise ValueError(how)
    j = df.crossJoin(F.broadcast(st))
    out = []
    for c in cols:
        sc = F.when(F.col(f"__s_{c}").isNull() | (F.col(f"__s_{c}") == 0), F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
        out.append(((F.col(c) - F.col(f"__c_{c}")) / sc).alias(f"{c}{suffix}"))
    keep = [F.col(c) for c in df.columns if suffix or c not in cols]
    return j.select(*keep, *out)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], group: str | None = None) -> DataFrame:
    """Exact quantiles of all columns in one job: one row (per ``group``) with
    ``{column}__q{i}``.  Columns are unpivoted, ranked together by (column,
    group), and the few results laid side by side."""
    key = lambda c: F.struct(F.lit(c).alias("c"), *([F.col(group).alias("g")] if group else []))
    long = df.select(F.explode(F.array(*[F.struct(key(c).alias("__k"), F.col(f"`{c}`").cast("double").alias("__v"))
                                         for c in cols])).alias("__p")).select("__p.*")
    q = exact_quantiles(long, "__v", list(probs), prefix="__q", group="__k")
    names = ["__q"] if len(probs) == 1 else [f"__q{i}" for i in range(len(probs))]
    wide = [F.max(F.when(F.col("__k.c") == c, F.col(n))).alias(f"{c}__q{i}") for c in cols for i, n in enumerate(names)]
    return q.groupBy(F.col("__k.g").alias(group)).agg(*wide) if group else q.agg(*wide)


def impute_median(df: DataFrame, cols: Sequence[str], group: str | None = None) -> DataFrame:
    """NULL → the column median (per ``group`` if given), exact quantiles."""
    m = column_quantiles(df, cols, [0.5], group)
    # one row per group (AQE sizes the join) or one row overall (broadcast)
    out = df.join(m, group, "left") if group else df.crossJoin(F.broadcast(m))
    names = set(cols)
    return out.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"{c}__q0")).alias(c) if c in names
                        else F.col(f"`{c}`") for c in df.columns])
