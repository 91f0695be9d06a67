"""Explanations over a linear client score (§2.12) and feature trends (§2.5).

Client features (customer ⋈ order aggregate) and a fixed linear model; the
DuckDB oracle repeats the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import explain as X
from riskloom.operators.aggregates import mean_of
from riskloom.plans import sqlgen
from riskloom.plans.common import register, round_doubles, sql_round, with_cte
from riskloom.plans.sets_queries import s_hash
from riskloom.sources.tables import table

DIGITS = 6
# Our scoring model (coefficients on the client features).
COEF = {"balance_k": -0.8, "n_orders": 0.15, "price_ratio": 0.5, "nation_scaled": 0.05}
INTERCEPT = -0.2
CUTOFF = "1997-01-01"   # the "old" snapshot sees orders before this date
KEY = "SK_ID_CURR"


def client_table(spark: SparkSession, d: str, cutoff: str | None = None) -> DataFrame:
    c = table(spark, d, "customer")
    o = table(spark, d, "orders")
    if cutoff:
        o = o.where(F.to_date("o_orderdate") < F.lit(cutoff).cast("date"))
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("__n"), mean_of(F.col("o_totalprice")).alias("__avgp"))
    j = c.join(g, c.c_custkey == g.o_custkey, "left")
    return j.select(F.col("c_custkey").alias(KEY), (F.col("c_acctbal") / 1000.0).alias("balance_k"),
                    F.coalesce(F.col("__n"), F.lit(0)).cast("double").alias("n_orders"),
                    F.coalesce(F.col("__avgp") / 100000.0, F.lit(0.0)).alias("price_ratio"),
                    (F.col("c_nationkey").cast("double") / 10.0).alias("nation_scaled"))


def means(ct: DataFrame) -> DataFrame:
    return ct.agg(*[mean_of(F.col(f)).alias(f"__mu_{f}") for f in COEF])


def contrib(spark, d, cutoff=None, background=None) -> DataFrame:
    ct = client_table(spark, d, cutoff)
    return X.contributions(ct, KEY, COEF, INTERCEPT, background if background is not None else means(ct))


# ------------------------------------------------------------------ SQL twins
def dl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def ct_sql(cutoff: str | None = None) -> str:
    where = f"WHERE CAST(o_orderdate AS DATE) < DATE '{cutoff}'" if cutoff else ""
    return f"""SELECT c_custkey AS {KEY}, c_acctbal / 1000.0 AS balance_k, CAST(coalesce(g.n, 0) AS DOUBLE) AS n_orders,
      coalesce(g.avgp / 100000.0, 0.0) AS price_ratio, CAST(c_nationkey AS DOUBLE) / 10.0 AS nation_scaled
      FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, {sqlgen.mean_of('o_totalprice')} AS avgp FROM orders {where}
      GROUP BY o_custkey) g ON c_custkey = g.o_custkey"""


MU_SQL = "SELECT " + ", ".join(f"{sqlgen.mean_of(f)} AS mu_{f}" for f in COEF) + " FROM ct"


def _lin(prefix: str) -> str:
    s = dl(INTERCEPT)
    for f, w in COEF.items():
        s = f"({s} + {dl(w)} * {prefix}{f})"
    return s


def contrib_sql(ct: str = "ct") -> str:
    parts = [f"""SELECT {KEY}, '{f}' AS feature, {f} AS value, {dl(w)} * ({f} - mu_{f}) AS contribution,
      {_lin('mu_')} AS base_value, {_lin('')} AS prediction FROM {ct}, mu""" for f, w in COEF.items()]
    return " UNION ALL ".join(parts)


def esql(body: str, keep=()) -> str:
    return sql_round(with_cte(f"ct AS ({ct_sql()}), mu AS ({MU_SQL}), lc AS ({contrib_sql()})", body),
                     keep=list(keep), digits=DIGITS)


@register("local_contributions", esql("SELECT * FROM lc"))
def q_local(spark, d):
    return round_doubles(contrib(spark, d), DIGITS)


@register("global_importance", esql(f"""SELECT feature, {sqlgen.mean_of('abs(contribution)')} AS mean_abs_contribution,
  count(*) AS n FROM lc GROUP BY feature"""))
def q_global(spark, d):
    return round_doubles(X.global_importance(contrib(spark, d)), DIGITS)


def _top_sql(k: int) -> str:
    return f"""SELECT {KEY}, feature, value, contribution, base_value, prediction, rank,
      CASE WHEN contribution > 0 THEN 'positive' WHEN contribution < 0 THEN 'negative' ELSE 'zero' END AS sign FROM (
      SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY abs(contribution) DESC, feature) AS rank FROM lc) x WHERE rank <= {k}"""


@register("top_drivers", esql(_top_sql(10), keep=["sign"]))
def q_top_drivers(spark, d):
    return round_doubles(X.top_by_abs(contrib(spark, d), KEY, 10), DIGITS)


@register("top_k_abs", esql(_top_sql(2), keep=["sign"]))
def q_top_k_abs(spark, d):
    return round_doubles(X.top_by_abs(contrib(spark, d), KEY, 2), DIGITS)


def _alt_rows():
    return [(f, i, kind, amt) for f in COEF for i, (kind, amt) in enumerate(X.alternatives(f, True))]


def cf_sql() -> str:
    alt = ", ".join(f"('{f}', {i}, '{k}', {dl(a)})" for f, i, k, a in _alt_rows())
    wcase = "CASE feature " + " ".join(f"WHEN '{f}' THEN {dl(w)}" for f, w in COEF.items()) + " END"
    return f"""WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY abs(contribution) DESC, feature) AS rk FROM lc) t WHERE rk <= 3),
      alt AS (SELECT * FROM (VALUES {alt}) a(feature, alt_idx, kind, amount)),
      c AS (SELECT top.*, alt.alt_idx, alt.kind, CASE WHEN alt.kind = 'add' THEN value + alt.amount ELSE value * alt.amount END AS new_value
            FROM top JOIN alt USING (feature)),
      c2 AS (SELECT *, prediction + {wcase} * (new_value - value) AS predicted_score, prediction + 1.0 AS target_score
             FROM c WHERE kind = 'mul' OR (new_value >= 0 AND new_value <= 2)),
      c3 AS (SELECT *, coalesce(sum(closer) OVER (PARTITION BY {KEY}, feature ORDER BY alt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
             FROM (SELECT *, CAST(abs(predicted_score - target_score) < abs(prediction - target_score) AS INTEGER) AS closer FROM c2) z),
      c5 AS (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n_generated,
             row_number() OVER (PARTITION BY {KEY} ORDER BY abs(predicted_score - target_score), feature, alt_idx) AS scenario FROM c3 WHERE bef = 0)
      SELECT {KEY}, scenario, feature AS feature_changed, value AS original_value, new_value, predicted_score, target_score,
        predicted_score - prediction AS score_change, n_generated FROM c5 WHERE scenario <= 5"""


@register("counterfactuals", esql(cf_sql(), keep=["feature_changed"]))
def q_cf(spark, d):
    return round_doubles(X.counterfactuals(contrib(spark, d), KEY, COEF), DIGITS)


@register("counterfactual_text", esql(f"""WITH cf AS ({cf_sql()})
  SELECT {KEY}, string_agg('To reach score ' || printf('%.2f', round(target_score * 100) / 100 + 0.0) || ', primarily need to '
    || CASE WHEN new_value - original_value > 0 THEN 'increase' ELSE 'decrease' END || ' ' || feature_changed, '; ' ORDER BY scenario) AS message
  FROM cf WHERE scenario <= 2 GROUP BY {KEY}"""))
def q_cf_text(spark, d):
    cf = X.counterfactuals(contrib(spark, d), KEY, COEF).where(F.col("scenario") <= 2)
    line = F.concat(F.lit("To reach score "), X.fmt(F.col("target_score"), 2), F.lit(", primarily need to "),
                    F.when(F.col("new_value") - F.col("original_value") > 0, "increase").otherwise("decrease"),
                    F.lit(" "), F.col("feature_changed"))
    g = cf.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("scenario", line.alias("l")))).alias("__s"))
    return g.select(KEY, F.array_join(F.transform("__s", lambda s: s["l"]), "; ").alias("message"))


def _attr_sql() -> str:
    old_lc = contrib_sql("cto")
    return f"""WITH cto AS ({ct_sql(CUTOFF)}), lo AS ({old_lc}),
      j AS (SELECT n.{KEY}, n.feature, o.value AS old_value, n.value AS new_value, n.value - o.value AS value_change,
                   o.contribution AS old_contribution, n.contribution AS new_contribution,
                   n.contribution - o.contribution AS contribution_change, n.prediction - o.prediction AS score_change
            FROM lc n JOIN lo o ON n.{KEY} = o.{KEY} AND n.feature = o.feature),
      ch AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY abs(contribution_change) DESC, feature) AS rank,
             CAST(least(0.95, 0.5 + sum(CAST(abs(contribution_change) > 1.0 AS INTEGER)) OVER (PARTITION BY {KEY}) * 0.1) AS DOUBLE) AS temporal_confidence
             FROM j WHERE abs(value_change) > 1e-6)
      SELECT {KEY}, feature, rank, old_value, new_value, value_change, old_contribution, new_contribution, contribution_change,
        score_change, CASE WHEN score_change > 0 THEN 'improved' ELSE 'declined' END AS direction,
        CASE WHEN abs(score_change) > 10 THEN 'significant' WHEN abs(score_change) > 5 THEN 'moderate' ELSE 'minor' END AS category,
        temporal_confidence FROM ch WHERE rank <= 10"""


def attribution(spark, d) -> DataFrame:
    ct = client_table(spark, d)
    bg = means(ct)
    new = X.contributions(ct, KEY, COEF, INTERCEPT, bg)
    old = X.contributions(client_table(spark, d, CUTOFF), KEY, COEF, INTERCEPT, bg)
    return X.score_change_attribution(old, new, KEY)


@register("score_change_attribution", esql(_attr_sql()))
def q_attr(spark, d):
    return round_doubles(attribution(spark, d), DIGITS)


SECTOR_SQL = f"""SELECT c_custkey AS {KEY}, r_name AS sector FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""


def _peer_sql() -> str:
    return f"""WITH s AS ({SECTOR_SQL}), lj AS (SELECT lc.*, s.sector FROM lc JOIN s USING ({KEY})),
      b AS (SELECT sector, feature, {sqlgen.mean_of('value')} AS sector_average FROM lj GROUP BY sector, feature),
      j AS (SELECT lj.{KEY}, lj.sector, lj.feature, lj.value AS company_value, b.sector_average, lj.value - b.sector_average AS difference,
             CASE WHEN b.sector_average <> 0 THEN (lj.value - b.sector_average) / b.sector_average * 100 ELSE 0.0 END AS relative_performance
            FROM lj JOIN b USING (sector, feature)),
      k AS (SELECT *, CASE WHEN relative_performance > 20 THEN 'excellent' WHEN relative_performance > 10 THEN 'good'
               WHEN relative_performance > -10 THEN 'average' WHEN relative_performance > -20 THEN 'below_average' ELSE 'poor' END AS performance_category,
             avg(CASE WHEN relative_performance > 0 THEN least(100.0, 50 + relative_performance) ELSE greatest(0.0, 50 + relative_performance) END)
               OVER (PARTITION BY {KEY}) AS overall_peer_score,
             sum(CAST(relative_performance > 10 AS INTEGER)) OVER (PARTITION BY {KEY}) AS n_strengths,
             sum(CAST(relative_performance < -10 AS INTEGER)) OVER (PARTITION BY {KEY}) AS n_weaknesses,
             CAST(least(0.9, count(*) OVER (PARTITION BY {KEY}) / 10.0) AS DOUBLE) AS comparison_confidence FROM j)
      SELECT *, CASE WHEN overall_peer_score > 80 THEN 'top_quartile' WHEN overall_peer_score > 60 THEN 'above_average'
        WHEN overall_peer_score > 40 THEN 'average' WHEN overall_peer_score > 20 THEN 'below_average' ELSE 'bottom_quartile' END AS ranking_category
      FROM k"""


def sectors(spark, d) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    # nation / region: fixed-size dimension tables
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
             .select(F.col("c_custkey").alias(KEY), F.col("r_name").alias("sector")))


def peers(spark, d) -> DataFrame:
    return X.peer_comparison(contrib(spark, d).select(KEY, "feature", "value"), KEY, sectors(spark, d), "sector")


@register("peer_comparison", esql(_peer_sql(), keep=["performance_category", "ranking_category"]))
def q_peer_cmp(spark, d):
    return round_doubles(peers(spark, d), DIGITS)


@register("explanation_confidence", esql(f"""WITH cf AS ({cf_sql()}), atr AS ({_attr_sql()})
  SELECT ct.{KEY}, CAST(0.9 AS DOUBLE) AS conf_shap, CAST(coalesce((SELECT least(0.9, max(n_generated) * 0.2) FROM cf WHERE cf.{KEY} = ct.{KEY}), 0.0) AS DOUBLE) AS conf_counterfactual,
    CAST(coalesce((SELECT max(temporal_confidence) FROM atr WHERE atr.{KEY} = ct.{KEY}), 0.0) AS DOUBLE) AS conf_temporal,
    CAST(least(0.9, {len(COEF)} / 10.0) AS DOUBLE) AS conf_comparative FROM ct"""))
def q_conf(spark, d):
    ct = client_table(spark, d).select(KEY)
    cf = X.counterfactuals(contrib(spark, d), KEY, COEF).groupBy(KEY).agg(
        F.least(F.lit(0.9), F.max("n_generated") * 0.2).alias("conf_counterfactual"))
    at = attribution(spark, d).groupBy(KEY).agg(F.max("temporal_confidence").alias("conf_temporal"))
    out = ct.join(cf, KEY, "left").join(at, KEY, "left")
    return round_doubles(out.select(KEY, F.lit(0.9).alias("conf_shap"),
                                    F.coalesce("conf_counterfactual", F.lit(0.0)).alias("conf_counterfactual"),
                                    F.coalesce("conf_temporal", F.lit(0.0)).alias("conf_temporal"),
                                    F.least(F.lit(0.9), F.lit(len(COEF) / 10.0)).alias("conf_comparative")), DIGITS)


@register("plain_language", esql(f"""WITH atr AS ({_attr_sql()}), pc AS ({_peer_sql()}),
  t AS (SELECT {KEY}, 'Credit score ' || CASE WHEN score_change > 0 THEN 'improved' ELSE 'declined' END || ' by '
          || printf('%.2f', round(abs(score_change) * 100) / 100 + 0.0) || ' points, primarily driven by changes in ' || feature || '.' AS temporal
        FROM atr WHERE rank = 1),
  p AS (SELECT DISTINCT {KEY}, 'Overall peer performance ranks in ' || replace(ranking_category, '_', ' ') || ' with a composite score of '
          || printf('%.1f', round(overall_peer_score * 10) / 10 + 0.0) || '/100.' AS peer FROM pc)
  SELECT p.{KEY}, p.peer, t.temporal FROM p LEFT JOIN t USING ({KEY})""", keep=["peer", "temporal"]))
def q_plain(spark, d):
    at = attribution(spark, d).where(F.col("rank") == 1)
    t = at.select(KEY, F.concat(F.lit("Credit score "), F.col("direction"), F.lit(" by "),
                                X.fmt(F.abs(F.col("score_change")), 2),
                                F.lit(" points, primarily driven by changes in "), F.col("feature"), F.lit(".")).alias("temporal"))
    p = peers(spark, d).select(KEY, F.concat(F.lit("Overall peer performance ranks in "),
                                             F.regexp_replace("ranking_category", "_", " "),
                                             F.lit(" with a composite score of "), X.fmt(F.col("overall_peer_score"), 1),
                                             F.lit("/100.")).alias("peer")).distinct()
    return p.join(t, KEY, "left")


# ------------------------------------------------------------------ feature trends
@register("feature_trend_stats", sql_round(f"""WITH p AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS date,
    {sqlgen.mean_of('value')} AS close, {sqlgen.mean_of("CAST(json_extract_string(props, '$.k') AS DOUBLE)")} AS volume
    FROM events GROUP BY 1, 2),
  l AS (SELECT ticker, date, 'close' AS feature, close AS v FROM p UNION ALL SELECT ticker, date, 'volume', volume FROM p),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker, feature ORDER BY date) - 1 AS DOUBLE) AS idx FROM l WHERE v IS NOT NULL),
  g AS (SELECT ticker, feature, regr_slope(v, idx) AS slope, stddev_samp(v) AS volatility,
          arg_max(v, idx) - arg_min(v, idx) AS recent_change, arg_max(v, idx) AS current_value, avg(v) AS average_value, count(*) AS n
        FROM r GROUP BY ticker, feature HAVING count(*) >= 2)
  SELECT *, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""",
    digits=DIGITS))
def q_trend_stats(spark, d):
    from riskloom.sources.panel import prices_daily
    from riskloom.operators.trends import feature_trend_stats
    p = prices_daily(spark, d)
    return round_doubles(feature_trend_stats(p, "ticker", "date", ["close", "volume"]), DIGITS)
