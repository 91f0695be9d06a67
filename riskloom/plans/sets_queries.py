"""Ordering, top-k, sampling, splits, set operations, dedup (§2.6, §2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import sampling as S
from riskloom.plans.common import register, round_doubles, sql_round, with_views
from riskloom.sources import panel as P
from riskloom.sources.tables import table

DIGITS = 6
HEX = S.HEX


def s_hash(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


def s_bucket(key: str, seed: int) -> str:
    h = s_hash(key, seed)
    v = "0"
    for i in range(4):
        v = f"(({v}) * 16 + (strpos('{HEX}', substr({h}, {i + 1}, 1)) - 1))"
    return v


@register("order_by", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def q_order_by(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_custkey", F.col("o_orderdate").desc(), "o_orderkey")


@register("top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def q_top_k(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(15)


@register("last_n_rows", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def q_last_n(spark, d):
    return (table(spark, d, "orders").select("o_orderkey", "o_orderdate")
            .orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(30))


@register("head_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1000")
def q_head(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(1000)


@register("sample_n", f"SELECT c_custkey FROM customer ORDER BY {s_hash('c_custkey', 42)} LIMIT 100")
def q_sample(spark, d):
    return S.sample_n(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100, 42)


@register("undersample_majority", with_views(f"""WITH h AS (SELECT SK_ID_CURR, TARGET, {s_hash('SK_ID_CURR', 42)} AS hh FROM application),
  m AS (SELECT min(n) AS nmin FROM (SELECT TARGET, count(*) AS n FROM h GROUP BY TARGET) c)
  SELECT SK_ID_CURR, TARGET FROM (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY hh) AS rn FROM h) x, m
  WHERE rn <= nmin""", "application"))
def q_undersample(spark, d):
    from riskloom.sources.tables import application
    a = application(spark, d).select("SK_ID_CURR", "TARGET")
    return S.undersample_majority(a, "SK_ID_CURR", "TARGET", 42)


@register("train_test_split", f"SELECT c_custkey, ({s_bucket('c_custkey', 42)}) % 100 < 75 AS is_train FROM customer")
def q_split(spark, d):
    return S.train_test_split(table(spark, d, "customer").select("c_custkey"), "c_custkey", 75, 42)


@register("kfold_split", f"SELECT c_custkey, CAST(({s_bucket('c_custkey', 1001)}) % 5 AS INTEGER) AS fold FROM customer")
def q_kfold(spark, d):
    return S.kfold(table(spark, d, "customer").select("c_custkey"), "c_custkey", 5, 1001)


def _ts_sql(n: int = 5) -> str:
    probs = [k / (n + 1) for k in range(1, n + 1)]
    cuts = ", ".join(f"quantile_cont(dd, {p!r}) AS c{i}" for i, p in enumerate(probs))
    tile = " + ".join(f"CAST(dd >= c{i} AS INTEGER)" for i in range(n))
    return f"""WITH o AS (SELECT o_orderkey, o_orderdate, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS dd FROM orders),
      c AS (SELECT {cuts} FROM o)
      SELECT o_orderkey, o_orderdate, {tile} AS tile FROM o, c"""


@register("time_series_split", _ts_sql())
def q_ts_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return S.time_series_tiles(o, "o_orderdate", 5)


@register("severity_sort", sql_round("""WITH c AS (SELECT event_id, ts, event_type AS kind,
    CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type = 'purchase' THEN 'high'
         WHEN event_type = 'signup' THEN 'medium' ELSE 'low' END AS severity FROM events WHERE value > 200),
  n AS (SELECT severity, count(*) AS n_severity FROM c GROUP BY severity)
  SELECT c.*, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS severity_rank,
    n.n_severity FROM c JOIN n USING (severity) ORDER BY severity_rank, ts""", digits=DIGITS))
def q_severity(spark, d):
    from riskloom.operators.rules import severity_rank
    e = table(spark, d, "events").where(F.col("value") > 200)
    t = F.col("event_type")
    c = e.select("event_id", "ts", t.alias("kind"),
                 F.when(t == "error", "critical").when(t == "purchase", "high").when(t == "signup", "medium")
                  .otherwise("low").alias("severity"))
    n = c.groupBy("severity").agg(F.count(F.lit(1)).alias("n_severity"))
    return c.withColumn("severity_rank", severity_rank("severity")).join(n, "severity").orderBy("severity_rank", "ts")


# ------------------------------------------------------------------ 2.7
@register("union_all", P.with_panel_views(sql_round("""SELECT ticker, date, close, volume, NULL::DOUBLE AS sentiment_score,
  NULL::INTEGER AS news_volume, NULL::DOUBLE AS regulatory_risk_score, NULL::DOUBLE AS management_sentiment FROM prices_daily
  UNION ALL SELECT ticker, date, NULL, NULL, sentiment_score, news_volume, regulatory_risk_score, management_sentiment
  FROM news_daily""", digits=DIGITS), "prices_daily", "news_daily"))
def q_union(spark, d):
    u = P.prices_daily(spark, d).unionByName(P.news_daily(spark, d), allowMissingColumns=True)
    return round_doubles(u, DIGITS)


N_DIMS = 64


@register("horizontal_concat", sql_round("SELECT x.vec_id, " + ", ".join(
    f"CAST(x.embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(N_DIMS))
    + ", y.label FROM embeddings x JOIN (SELECT vec_id, label FROM embeddings) y USING (vec_id)", digits=DIGITS))
def q_hconcat(spark, d):
    e = table(spark, d, "embeddings")
    x = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(N_DIMS)])
    y = e.select("vec_id", "label")
    return round_doubles(x.join(y, "vec_id"), DIGITS)


@register("dedup_keys", sql_round("""SELECT user_id, date, event_id, value FROM (SELECT user_id, CAST(ts AS DATE) AS date, event_id, value,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) x WHERE rn = 1""", digits=DIGITS))
def q_dedup(spark, d):
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    # row_number() = 1 with a tie-break is deterministic (dropDuplicates is not);
    # Spark plans it with a per-partition group limit before the shuffle.
    w = Window.partitionBy("user_id", "date").orderBy("ts", "event_id")
    return round_doubles(e.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
                         .select("user_id", "date", "event_id", "value"), DIGITS)


@register("distinct_list", """WITH a AS (SELECT source AS ticker, lower(text) AS t FROM documents),
  m AS (SELECT ticker, list_filter([CASE WHEN strpos(t, 'with') > 0 THEN 'with' END, CASE WHEN strpos(t, 'from') > 0 THEN 'from' END,
    CASE WHEN strpos(t, 'this') > 0 THEN 'this' END, CASE WHEN strpos(t, 'onen') > 0 THEN 'onen' END], lambda x: x IS NOT NULL) AS kws FROM a)
  SELECT ticker, list_sort(list_distinct(flatten(list(kws)))) AS matched_keywords FROM m GROUP BY ticker""")
def q_distinct_list(spark, d):
    from riskloom.functions.text import matched_list
    doc = table(spark, d, "documents")
    kws = matched_list(F.lower("text"), ["with", "from", "this", "onen"])
    # per-key distinct set of a bounded dictionary: at most 4 values per group
    return (doc.select(F.col("source").alias("ticker"), F.explode_outer(kws).alias("kw"))
               .groupBy("ticker").agg(F.array_sort(F.collect_set("kw")).alias("matched_keywords")))


@register("set_minus", """SELECT c_custkey AS k FROM customer
  EXCEPT ALL SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def q_minus(spark, d):
    """Clients without an urgent order that is done."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    return c.exceptAll(o)


@register("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def q_intersect(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o)
