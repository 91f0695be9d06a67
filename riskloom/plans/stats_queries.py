"""Statistics, selection scores, encodings, imputation, peers (§2.11 'S', §2.4, §2.5).

Feature table: embeddings → e0..e63 (all dimensions as double), class
= label (0..9), binary target y = label >= 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators import peers as PE
from riskloom.operators import stats as ST
from riskloom.operators.aggregates import discover_vocabulary, mean_of, var_of, one_hot_exprs
from riskloom.plans import sqlgen
from riskloom.plans.common import register, round_doubles, sql_round, with_cte
from riskloom.session import scratch_table_path
from riskloom.sources.tables import table

DIGITS = 6
NF = 64   # all dimensions
FEATS = [f"e{i}" for i in range(NF)]


def feats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", (F.col("label") >= 5).cast("int").alias("y"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(NF)])


FEATS_SQL = ("SELECT vec_id, label, CAST(label >= 5 AS INTEGER) AS y, "
             + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(NF)) + " FROM embeddings")


def fsql(body: str, keep=(), digits=DIGITS) -> str:
    return sql_round(with_cte(f"feats AS ({FEATS_SQL})", body), keep=list(keep), digits=digits)


def s_corr(a: str, b: str) -> str:
    pa = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END"
    pb = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    return (f"(CASE WHEN stddev_samp({pa}) * stddev_samp({pb}) <> 0 THEN covar_samp({pa}, {pb}) / "
            f"(stddev_samp({pa}) * stddev_samp({pb})) END)")


TC_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, {s_corr(c, 'y')} AS corr, abs({s_corr(c, 'y')}) AS abs_corr FROM feats"
                            for c in FEATS)


@register("target_correlation", fsql(TC_SQL))
def q_target_corr(spark, d):
    return round_doubles(ST.target_correlation(feats(spark, d), FEATS, "y"), DIGITS)


@register("select_by_correlation", fsql(f"""SELECT feature, corr, abs_corr, coalesce(abs_corr, 0.0) AS score
  FROM ({TC_SQL}) t ORDER BY score DESC, feature LIMIT 100"""))
def q_select_corr(spark, d):
    return round_doubles(ST.select_by_correlation(feats(spark, d), FEATS, "y", 100), DIGITS)


def _fq_sql() -> str:
    parts = []
    for c in FEATS:
        parts.append(f"""SELECT '{c}' AS feature, abs(r) AS importance_score, miss AS missing_ratio, outr AS outlier_ratio,
          r AS correlation_with_target, (1.0 - miss) * (1.0 - outr) * abs(r) AS data_quality_score FROM (
          SELECT max(st.r) AS r, (max(st.n) - max(st.nn)) * 1.0 / max(st.n) AS miss,
            sum(CASE WHEN st.sd <> 0 AND abs((f.{c} - st.mu) / st.sd) > 3 THEN 1 ELSE 0 END) * 1.0 / max(st.n) AS outr
          FROM feats f, (SELECT count(*) AS n, count({c}) AS nn, {s_corr(c, 'y')} AS r,
                          {sqlgen.mean_of(c)} AS mu, sqrt({sqlgen.var_of(c)}) AS sd FROM feats) st) x""")
    return " UNION ALL ".join(parts)


@register("feature_quality", fsql(_fq_sql()))
def q_feature_quality(spark, d):
    return round_doubles(ST.feature_quality(feats(spark, d), FEATS, "y"), DIGITS)


@register("feature_quality_summary", fsql(f"""SELECT count(*) AS total_features, avg(importance_score) AS avg_importance,
  count(*) FILTER (WHERE data_quality_score > 0.7) AS high_quality_features,
  count(*) FILTER (WHERE missing_ratio > 0.2) AS features_with_high_missing FROM ({_fq_sql()}) q"""))
def q_feature_quality_summary(spark, d):
    q = ST.feature_quality(feats(spark, d), FEATS, "y")
    return round_doubles(q.agg(F.count(F.lit(1)).alias("total_features"), F.avg("importance_score").alias("avg_importance"),
                               F.count_if(F.col("data_quality_score") > 0.7).alias("high_quality_features"),
                               F.count_if(F.col("missing_ratio") > 0.2).alias("features_with_high_missing")), DIGITS)


def scaled_sql(how: str) -> str:
    if how == "minmax":
        cols = ", ".join(f"(e{i} - min(e{i}) OVER ()) / (CASE WHEN max(e{i}) OVER () - min(e{i}) OVER () = 0 THEN 1.0 "
                         f"ELSE max(e{i}) OVER () - min(e{i}) OVER () END) AS e{i}" for i in range(NF))
    elif how == "standard":
        cols = ", ".join(
            f"(e{i} - s.mu{i}) / (CASE WHEN s.sd{i} IS NULL OR s.sd{i} = 0 THEN 1.0 ELSE s.sd{i} END) AS e{i}" for i in range(NF))
        stats = ", ".join(f"{sqlgen.mean_of(f'e{i}')} AS mu{i}, sqrt({sqlgen.var_of(f'e{i}', ddof=0)}) AS sd{i}"
                          for i in range(NF))
        return f"SELECT vec_id, label, y, {cols} FROM feats, (SELECT {stats} FROM feats) s"
    else:
        cols = ", ".join(
            f"(e{i} - s.q2_{i}) / (CASE WHEN s.q3_{i} - s.q1_{i} = 0 THEN 1.0 ELSE s.q3_{i} - s.q1_{i} END) AS e{i}" for i in range(NF))
        stats = ", ".join(f"quantile_cont(e{i}, 0.25) AS q1_{i}, quantile_cont(e{i}, 0.5) AS q2_{i}, "
                          f"quantile_cont(e{i}, 0.75) AS q3_{i}" for i in range(NF))
        return f"SELECT vec_id, label, y, {cols} FROM feats, (SELECT {stats} FROM feats) s"
    return f"SELECT vec_id, label, y, {cols} FROM feats"


for _how in ("standard", "minmax", "robust"):
    def _q(spark, d, how=_how):
        return round_doubles(ST.scale(feats(spark, d), FEATS, how), DIGITS)
    register(f"scale_{_how}", fsql(scaled_sql(_how)))(_q)


CHI_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS feature, sum((s - e) * (s - e) / e) AS chi2 FROM (
  SELECT sum({c}) AS s, count(*) * 1.0 / max(t.n) * max(t.tot) AS e FROM mm, (SELECT count(*) AS n, sum({c}) AS tot FROM mm) t
  GROUP BY label) x""" for c in FEATS)


@register("select_chi2", fsql(f"WITH mm AS ({scaled_sql('minmax')}) SELECT * FROM ({CHI_SQL}) c ORDER BY chi2 DESC LIMIT 100"))
def q_chi2(spark, d):
    m = ST.scale(feats(spark, d), FEATS, "minmax")
    return round_doubles(ST.chi2_scores(m, FEATS, "label").orderBy(F.col("chi2").desc()).limit(100), DIGITS)


@register("auc_roc", fsql("""SELECT sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc,
  sum(pos) AS n_pos, sum(neg) AS n_neg FROM (
  SELECT e0, pos, neg, coalesce(sum(neg) OVER (ORDER BY e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM (SELECT e0, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg
        FROM feats WHERE e0 IS NOT NULL GROUP BY e0) g) r"""))
def q_auc(spark, d):
    return round_doubles(ST.auc_roc(feats(spark, d), "e0", "y"), DIGITS)


@register("auc_roc_by_label", fsql("""SELECT label, sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc,
  sum(pos) AS n_pos, sum(neg) AS n_neg FROM (
  SELECT label, e1, pos, neg, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY e1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM (SELECT label, e1, sum(CASE WHEN e0 > 0 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN e0 > 0 THEN 0 ELSE 1 END) AS neg
        FROM feats WHERE e1 IS NOT NULL GROUP BY label, e1) g) r GROUP BY label"""))
def q_auc_group(spark, d):
    f = feats(spark, d).withColumn("pos_e0", (F.col("e0") > 0).cast("int"))
    return round_doubles(ST.auc_roc(f, "e1", "pos_e0", group="label"), DIGITS)


# ------------------------------------------------------------- encodings
@register("one_hot", sql_round("SELECT o_orderkey, " + ", ".join(
    sqlgen.one_hot({"o_orderstatus": sqlgen.DOMAINS["o_orderstatus"], "o_orderpriority": sqlgen.DOMAINS["o_orderpriority"]},
                   nan_category=True)) + " FROM orders", digits=DIGITS))
def q_one_hot(spark, d):
    o = table(spark, d, "orders")
    vocab = discover_vocabulary(o, ["o_orderstatus", "o_orderpriority"])
    return o.select(*one_hot_exprs(vocab, nan_category=True, keep=["o_orderkey"]))


@register("factorize", """WITH f AS (SELECT c_mktsegment AS v, min(c_custkey) AS first_seen FROM customer
  WHERE c_mktsegment IS NOT NULL GROUP BY 1)
  SELECT c_custkey, coalesce(f.code, -1) AS code FROM customer LEFT JOIN (
    SELECT v, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS INTEGER) AS code FROM f) f ON c_mktsegment = f.v""")
def q_factorize(spark, d):
    from riskloom.operators.encode import factorize
    c = table(spark, d, "customer")
    return factorize(c, "c_mktsegment", "c_custkey", "code").select("c_custkey", "code")


# ------------------------------------------------------------- imputation
IMP_COLS = ["POS_SK_DPD_MEAN", "POS_MONTHS_BALANCE_MEAN", "AMT_RESERVE", "AMT_OVERDRAFT"]


@register("impute_median", None)
def q_impute(spark, d):
    from riskloom.plans.profiling_queries import pf
    p = pf(spark, d).select("SK_ID_CURR", *IMP_COLS)
    return round_doubles(ST.impute_median(p, IMP_COLS), DIGITS)


@register("impute_median_by_group", None)
def q_impute_group(spark, d):
    from riskloom.plans.company_panel import merged_panel
    m = merged_panel(spark, d).select("ticker", "date", "sentiment_score", "close")
    return round_doubles(ST.impute_median(m, ["sentiment_score", "close"], group="ticker"), DIGITS)


def _register_impute_sql():
    from riskloom.plans.common import ORACLE
    from riskloom.plans.company_panel import MERGED_SQL
    from riskloom.plans.profiling_queries import pfsql
    from riskloom.sources.panel import with_panel_views
    ORACLE["impute_median"] = pfsql("SELECT SK_ID_CURR, " + ", ".join(
        f"coalesce({c}, quantile_cont({c}, 0.5) OVER ()) AS {c}" for c in IMP_COLS) + " FROM pf")
    ORACLE["impute_median_by_group"] = with_panel_views(sql_round(
        "SELECT ticker, date, " + ", ".join(f"coalesce({c}, quantile_cont({c}, 0.5) OVER (PARTITION BY ticker)) AS {c}"
                                            for c in ["sentiment_score", "close"]) + f" FROM ({MERGED_SQL}) m",
        digits=DIGITS), "fundamentals", "prices_daily", "news_daily")


_register_impute_sql()


# ------------------------------------------------------------- peers (suppliers by region)
def suppliers(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    # nation / region: fixed-size dimensions
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
             .select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"),
                     F.col("s_acctbal").alias("score"), (F.col("s_acctbal") * 1e8).alias("market_cap")))


SUPP_SQL = """SELECT s_suppkey AS ticker, r_name AS sector, s_acctbal AS score, s_acctbal * 1e8 AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def psql(body: str, keep=()) -> str:
    return sql_round(with_cte(f"sup AS ({SUPP_SQL})", body), keep=list(keep), digits=DIGITS)


@register("peer_group_stats", psql(f"""SELECT sector, {sqlgen.mean_of('score')} AS mean,
  sqrt({sqlgen.var_of('score', ddof=0)}) AS std_pop, count(score) AS peer_count,
  (list_sort(list(score)))[CAST(floor(count(score) / 2) AS BIGINT) + 1] AS upper_median FROM sup GROUP BY sector"""))
def q_peer_stats(spark, d):
    return round_doubles(PE.peer_group_stats(suppliers(spark, d), "sector", "score"), DIGITS)


@register("peer_rank", psql("""SELECT ticker, sector, score, count(*) OVER (PARTITION BY sector) AS total,
  rank() OVER (PARTITION BY sector ORDER BY score) * 100.0 / count(*) OVER (PARTITION BY sector) AS percentile_rank,
  rank() OVER (PARTITION BY sector ORDER BY score DESC) AS rank FROM sup"""))
def q_peer_rank(spark, d):
    return round_doubles(PE.peer_rank(suppliers(spark, d), "ticker", "sector", "score"), DIGITS)


MCAP = ("CASE WHEN market_cap > 200000000000 THEN 'mega_cap' WHEN market_cap > 10000000000 THEN 'large_cap' "
        "WHEN market_cap > 2000000000 THEN 'mid_cap' ELSE 'small_cap' END")


@register("select_peers", psql(f"""WITH b AS (SELECT ticker, sector, {MCAP} AS bucket FROM sup),
  h AS (SELECT sector, bucket, ticker AS peer, row_number() OVER (PARTITION BY sector, bucket ORDER BY ticker) AS pos FROM b),
  c AS (SELECT b.ticker, b.sector, b.bucket, h.peer, h.pos FROM b JOIN h USING (sector, bucket) WHERE h.pos <= 11 AND h.peer <> b.ticker)
  SELECT ticker, sector, bucket, peer, peer_rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS peer_rank FROM c) x
  WHERE peer_rank <= 10""", keep=["bucket"]))
def q_select_peers(spark, d):
    from riskloom.operators.rules import market_cap_bucket
    s = suppliers(spark, d).withColumn("bucket", market_cap_bucket("market_cap"))
    return PE.select_peers(s, "ticker", ["sector", "bucket"], 10)


@register("relative_strength_text", psql(f"""WITH g AS (SELECT sector, {sqlgen.mean_of('score')} AS sector_avg,
    sqrt({sqlgen.var_of('score', ddof=0)}) AS sector_std FROM sup GROUP BY sector),
  r AS (SELECT ticker, sector, score, rank() OVER (PARTITION BY sector ORDER BY score) * 100.0 / count(*) OVER (PARTITION BY sector) AS pct FROM sup)
  SELECT r.ticker, CASE WHEN pct >= 75 THEN 'Strong performer - significantly above sector average by ' || printf('%.1f', round((score - sector_avg) * 10) / 10) || ' points'
    WHEN pct >= 50 THEN 'Above average performer - ' || printf('%.1f', round((score - sector_avg) * 10) / 10) || ' points above sector average'
    WHEN pct >= 25 THEN 'Below average performer - ' || printf('%.1f', round(abs(score - sector_avg) * 10) / 10) || ' points below sector average'
    ELSE 'Weak performer - significantly below sector average by ' || printf('%.1f', round(abs(score - sector_avg) * 10) / 10) || ' points' END AS message,
    CASE WHEN pct < 25 THEN 'Higher risk relative to peers in ' WHEN pct > 75 THEN 'Lower risk relative to peers in '
      ELSE 'Average risk profile relative to peers in ' END || CASE WHEN sector_std > 10 THEN 'high' WHEN sector_std > 5 THEN 'moderate' ELSE 'low' END
      || ' volatility sector' AS level
  FROM r JOIN g USING (sector)"""))
def q_rel_text(spark, d):
    s = suppliers(spark, d)
    g = s.groupBy("sector").agg(mean_of(F.col("score")).alias("sector_avg"),
                                F.sqrt(var_of(F.col("score"), ddof=0)).alias("sector_std"))
    r = PE.peer_rank(s, "ticker", "sector", "score").join(g, "sector")
    return r.select("ticker", PE.relative_strength_text("score", "sector_avg", "percentile_rank").alias("message"),
                    PE.peer_risk_text("percentile_rank", "sector_std").alias("level"))


# ------------------------------------------------------------- per-column ECDF
@register("ecdf", None)
def q_ecdf(spark, d):
    from riskloom.operators import profiling as PR
    from riskloom.plans.profiling_queries import pf
    p = PR.profile(pf(spark, d)).select("column_name", "pct_missing")
    # one row per column: a window without partitioning is bounded by the schema width
    return round_doubles(p.withColumn("ecdf", F.cume_dist().over(Window.orderBy("pct_missing"))), DIGITS)


def _ecdf_sql():
    from riskloom.plans.common import ORACLE
    from riskloom.plans.profiling_queries import PROFILE_SQL, pfsql
    ORACLE["ecdf"] = pfsql(f"SELECT column_name, pct_missing, cume_dist() OVER (ORDER BY pct_missing) AS ecdf FROM ({PROFILE_SQL}) p")


_ecdf_sql()


# ------------------------------------------------------------- KNN imputation (per ticker)
def _knn_cols():
    from riskloom.plans.company_panel import FUND_COLS, NEWS_COLS, PRICE_COLS
    return FUND_COLS + PRICE_COLS + NEWS_COLS


@register("impute_knn", None)
def q_impute_knn(spark, d):
    from riskloom.operators.knn import impute_knn
    from riskloom.plans.company_panel import merged_panel
    path = scratch_table_path(spark, "panel")      # read several times below: written once
    merged_panel(spark, d).select("ticker", "date", *_knn_cols()).write.parquet(path)
    m = spark.read.parquet(path)
    return round_doubles(impute_knn(m, "ticker", "date", _knn_cols(), k=5, min_rows=10), DIGITS)


def _knn_sql(k: int = 5, min_rows: int = 10) -> str:
    """Brute force within each ticker: every ordered row pair, nan-euclidean
    distance, k nearest donors per (row, column)."""
    from riskloom.plans.company_panel import MERGED_SQL
    cols = _knn_cols()
    p = len(cols)
    cnt = " + ".join(f"CAST(r.{c} IS NOT NULL AND o.{c} IS NOT NULL AS INTEGER)" for c in cols)
    ssq = " + ".join(f"coalesce((r.{c} - o.{c}) * (r.{c} - o.{c}), 0.0)" for c in cols)
    ctes = [f"m AS (SELECT ticker, date, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM ({MERGED_SQL}) m0)",
            "sz AS (SELECT ticker, count(*) AS n, " + ", ".join(f"avg({c}) AS mean_{c}" for c in cols) + " FROM m GROUP BY 1)",
            f"""pr AS (SELECT r.ticker, r.date AS rdate, o.date AS odate, {cnt} AS common, {ssq} AS ssq,
                {', '.join(f'r.{c} AS r_{c}, o.{c} AS o_{c}' for c in cols)}
                FROM m r JOIN m o ON r.ticker = o.ticker AND r.date <> o.date)""",
            f"pd AS (SELECT *, CASE WHEN common > 0 THEN sqrt({float(p)} / common * ssq) END AS dist FROM pr)"]
    for c in cols:
        ctes.append(f"""k_{c} AS (SELECT ticker, rdate, avg(v) AS v FROM (
            SELECT ticker, rdate, o_{c} AS v, row_number() OVER (PARTITION BY ticker, rdate ORDER BY dist, odate) AS rn
            FROM pd WHERE r_{c} IS NULL AND o_{c} IS NOT NULL AND dist IS NOT NULL) t WHERE rn <= {k} GROUP BY 1, 2)""")
    sel = ", ".join(f"CASE WHEN sz.n > {min_rows} THEN coalesce(m.{c}, k_{c}.v, sz.mean_{c}) ELSE m.{c} END AS {c}"
                    for c in cols)
    joins = " ".join(f"LEFT JOIN k_{c} ON k_{c}.ticker = m.ticker AND k_{c}.rdate = m.date" for c in cols)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT m.ticker, m.date, {sel} FROM m JOIN sz ON sz.ticker = m.ticker {joins}"


def _register_knn_sql():
    from riskloom.plans.common import ORACLE
    from riskloom.sources.panel import with_panel_views
    ORACLE["impute_knn"] = with_panel_views(sql_round(_knn_sql(), digits=DIGITS),
                                            "fundamentals", "prices_daily", "news_daily")


_register_knn_sql()
