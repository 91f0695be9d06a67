"""Profiling, cleaning decisions, filters and validations (§2.2, §2.4).

Profiled frame: application LEFT JOIN the POS aggregate, with three amounts
that are filled for few, some and most clients, and a constant flag, so that
every cleaning rule has columns on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import clamp_positive, null_if_infinite, null_if_sentinel
from riskloom.operators import cleaning as CL
from riskloom.operators import profiling as PR
from riskloom.operators import ratios as RT
from riskloom.operators.aggregates import mean_of
from riskloom.plans import client_features as CF
from riskloom.plans import sqlgen
from riskloom.plans.common import register, round_doubles, sql_round, with_views, with_cte
from riskloom.sources import panel as P
from riskloom.sources.tables import days_from_ref, table

DIGITS = 6


def pf(spark: SparkSession, d: str) -> DataFrame:
    a = CF.application_features(spark, d).join(CF.pos_agg(spark, d), "SK_ID_CURR", "left")
    amount = F.col("AMT_BALANCE")
    return a.select("*", F.when(amount < 0, -amount).alias("AMT_OVERDRAFT"), F.when(amount > 5000, amount).alias("AMT_RESERVE"),
                    F.when(amount > 0, amount).alias("AMT_CREDIT_LINE"), F.lit(1).alias("FLAG_SOURCE"))


PF_SQL = f"""SELECT *, CASE WHEN AMT_BALANCE < 0 THEN -AMT_BALANCE END AS AMT_OVERDRAFT,
  CASE WHEN AMT_BALANCE > 5000 THEN AMT_BALANCE END AS AMT_RESERVE,
  CASE WHEN AMT_BALANCE > 0 THEN AMT_BALANCE END AS AMT_CREDIT_LINE, CAST(1 AS INTEGER) AS FLAG_SOURCE
  FROM ({CF._app_sql()}) a LEFT JOIN ({CF._pos_agg_sql()}) USING (SK_ID_CURR)"""
SEGS = [f"NAME_CONTRACT_TYPE_{sqlgen.clean_token(v)}" for v in sqlgen.DOMAINS["c_mktsegment"]]
POS_COLS = ([f"POS_{c}_{f.upper()}" for c, fs in CF.POS_SPEC.items() for f in fs]
            + [f"POS_NAME_CONTRACT_STATUS_{v}_MEAN" for v in sqlgen.DOMAINS["l_linestatus"]]
            + ["POS_NAME_CONTRACT_STATUS_nan_MEAN", "POS_COUNT"])
EXTRA_COLS = ["AMT_OVERDRAFT", "AMT_RESERVE", "AMT_CREDIT_LINE", "FLAG_SOURCE"]
PF_COLS = ["SK_ID_CURR", "TARGET", "NATION_KEY", "AMT_BALANCE"] + SEGS + POS_COLS + EXTRA_COLS
DTYPES = {"SK_ID_CURR": "bigint", "TARGET": "int", "NATION_KEY": "int", "AMT_BALANCE": "double",
          **{s: "int" for s in SEGS}, "POS_MONTHS_BALANCE_MAX": "int", "POS_MONTHS_BALANCE_SIZE": "bigint",
          "POS_SK_DPD_MAX": "int", "POS_SK_DPD_DEF_MAX": "int", "POS_COUNT": "bigint", "FLAG_SOURCE": "int"}


def dtype_of(c: str) -> str:
    return DTYPES.get(c, "double")


def pfsql(body: str, keep=()) -> str:
    return sql_round(with_views(with_cte(f"pf AS ({PF_SQL})", body), "application", "pos_cash"),
                     keep=list(keep), digits=DIGITS)


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{dtype_of(c)}' AS dtype, count(*) AS n_rows, count("{c}") AS non_null,
      (count(*) - count("{c}")) * 100.0 / count(*) AS pct_missing, count(DISTINCT "{c}") AS n_unique,
      CAST(min("{c}") AS DOUBLE) AS min, CAST(max("{c}") AS DOUBLE) AS max,
      sqrt({sqlgen.var_of(f'CAST("{c}" AS DOUBLE)')}) AS std FROM pf""" for c in PF_COLS)


@register("describe_columns", pfsql(PROFILE_SQL))
def q_describe(spark, d):
    return round_doubles(PR.profile(pf(spark, d), distinct=True), DIGITS)


@register("missing_share", pfsql(f"SELECT column_name, pct_missing / 100.0 AS missing_share FROM ({PROFILE_SQL}) p"))
def q_missing(spark, d):
    p = PR.profile(pf(spark, d))
    return round_doubles(p.select("column_name", (F.col("pct_missing") / 100.0).alias("missing_share")), DIGITS)


@register("fill_rate", pfsql(f"""SELECT column_name, taux, floor(taux / 7) * 7 AS bucket FROM (
  SELECT column_name, round_even(100.0 - pct_missing, 0) AS taux FROM ({PROFILE_SQL}) p) x WHERE taux < 99.99"""))
def q_fill(spark, d):
    return round_doubles(PR.fill_rate(PR.profile(pf(spark, d))), DIGITS)


DEC_SQL = f"""SELECT column_name, n_unique = 1 AS single_value, coalesce(std = 0, false) AS non_var,
  non_null * 1.0 / n_rows > {PR.SPARSE_KEEP_SHARE} AS keep_sparse_rule,
  (1.0 - non_null * 1.0 / n_rows) > {PR.MISSING_DROP_RATIO} AS drop_missing_rule,
  non_null = n_rows AS all_filled, non_null < n_rows AS has_nulls FROM ({PROFILE_SQL}) p"""
DEC_KEEP = ["single_value", "non_var", "keep_sparse_rule", "drop_missing_rule", "all_filled", "has_nulls"]


def _decision_query(flag: str):
    def q(spark, d):
        dec = PR.decisions(PR.profile(pf(spark, d), distinct=flag == "single_value"))
        return dec.where(F.col(flag)).select("column_name")
    return q


for _key, _flag in [("drop_single_value_cols", "single_value"), ("non_var_columns", "non_var"),
                    ("drop_sparse_cols", "keep_sparse_rule"), ("drop_sparse_cols_by_missing", "drop_missing_rule"),
                    ("columns_full", "all_filled"), ("columns_with_nulls", "has_nulls")]:
    register(_key, pfsql(f"SELECT column_name FROM ({DEC_SQL}) x WHERE {_flag}"))(_decision_query(_flag))


@register("share_over_threshold", pfsql(
    f"SELECT avg(CAST(pct_missing > {PR.UNFILLED_THRESHOLD_PCT} AS DOUBLE)) AS share_unfilled, count(*) AS n_columns FROM ({PROFILE_SQL}) p"))
def q_share(spark, d):
    return round_doubles(PR.share_over_threshold(PR.profile(pf(spark, d))), DIGITS)


@register("downcast_types", pfsql(f"""SELECT column_name, dtype, CASE
  WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint') AND min > -128 AND max < 127 THEN 'tinyint'
  WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint') AND min > -32768 AND max < 32767 THEN 'smallint'
  WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint') AND min > -2147483648 AND max < 2147483647 THEN 'int'
  WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint') THEN 'bigint'
  WHEN dtype IN ('float', 'double') AND min > -3.4028235e38 AND max < 3.4028235e38 THEN 'float'
  WHEN dtype IN ('float', 'double') THEN 'double' END AS target_dtype FROM ({PROFILE_SQL}) p""", keep=["target_dtype"]))
def q_downcast(spark, d):
    return PR.downcast_plan(PR.profile(pf(spark, d)))


# ------------------------------------------------------------- cleaning that rewrites the table
CLEAN_FRAME = ["SK_ID_CURR", "TARGET", "NATION_KEY", "AMT_BALANCE", *EXTRA_COLS]
# Rules of each query, and the columns that they drop whatever the size of the tables.
CLEANINGS = {
    "clean_drop_sparse": (("single_value", "sparse"), ("FLAG_SOURCE", "AMT_OVERDRAFT")),
    "clean_drop_missing": (("missing",), ("AMT_OVERDRAFT", "AMT_RESERVE")),
    "clean_downcast": ((), ()),
}


def _clean_query(rules):
    def q(spark, d):
        frame = pf(spark, d).select(*CLEAN_FRAME)
        return round_doubles(CL.clean(frame, CL.decide(frame, rules, protect=["SK_ID_CURR"])), DIGITS)
    return q


def _clean_sql(dropped):
    cols = [f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" if dtype_of(c) == "double" else c
            for c in CLEAN_FRAME if c not in dropped]
    return pfsql(f"SELECT {', '.join(cols)} FROM pf")


for _key, (_rules, _dropped) in CLEANINGS.items():
    register(_key, _clean_sql(_dropped))(_clean_query(_rules))


@register("clean_decisions", pfsql(f"""SELECT p.column_name, p.dtype,
  CASE WHEN p.column_name = 'SK_ID_CURR' THEN NULL WHEN p.n_unique = 1 THEN 'single_value' WHEN NOT x.keep_sparse_rule THEN 'sparse'
    WHEN x.drop_missing_rule THEN 'missing' END AS rule
  FROM ({PROFILE_SQL}) p JOIN ({DEC_SQL}) x USING (column_name) WHERE p.column_name IN ({", ".join(f"'{c}'" for c in CLEAN_FRAME)})""",
    keep=["rule"]))
def q_clean_decisions(spark, d):
    """The record that the rewritten tables follow, all rules at once."""
    frame = pf(spark, d).select(*CLEAN_FRAME)
    return CL.as_table(spark, CL.decide(frame, ("single_value", "sparse", "missing"), protect=["SK_ID_CURR"])).drop("target_dtype")


@register("numeric_columns_only", pfsql("SELECT SK_ID_CURR, TARGET, NATION_KEY, AMT_BALANCE FROM pf"))
def q_numeric_only(spark, d):
    a = CF.application_features(spark, d).select("SK_ID_CURR", "TARGET", "NATION_KEY", "AMT_BALANCE")
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("SK_ID_CURR"), "c_name", "c_mktsegment")
    return round_doubles(PR.numeric_columns_only(a.join(t, "SK_ID_CURR")), DIGITS)


@register("rename_clean", sql_round("""SELECT o_orderkey AS order_key, 2001 - CAST(year(o_orderdate) AS BIGINT) AS ages_93_years,
  o_orderstatus AS "NAME_CONTRACT_TYPE", CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "CREDIT_PRIORITY_1URGENT",
  CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS "CREDIT_PRIORITY_4NOT_SPECIFIED", o_totalprice AS total_price_
  FROM orders""", keep=["NAME_CONTRACT_TYPE"], digits=DIGITS))
def q_rename(spark, d):
    """A frame of all orders whose raw column names need cleaning."""
    o = table(spark, d, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("order key"), (F.lit(2001) - F.year("o_orderdate")).cast("bigint").alias("ages - (93_years)"),
        F.col("o_orderstatus").alias("NAME CONTRACT TYPE"),
        *[(F.col("o_orderpriority") == v).cast("int").alias(f"CREDIT_PRIORITY_{v}") for v in ("1-URGENT", "4-NOT SPECIFIED")],
        F.col("o_totalprice").alias("total__price ($)"))
    return round_doubles(PR.rename_clean(raw), DIGITS)


@register("infinite_counts", sql_round("""SELECT 'x_pow' AS column_name, count(*) AS inf_count FROM events
  WHERE isinf(power(10.0, value)) HAVING count(*) > 0""", digits=DIGITS))
def q_inf_counts(spark, d):
    e = table(spark, d, "events").select("event_id", F.pow(F.lit(10.0), F.col("value")).alias("x_pow"))
    return PR.infinite_counts(e, ["x_pow"])


@register("infinite_rows", "SELECT event_id FROM events WHERE isinf(power(10.0, value))")
def q_inf_rows(spark, d):
    e = table(spark, d, "events").select("event_id", F.pow(F.lit(10.0), F.col("value")).alias("x_pow"))
    return PR.infinite_rows(e, "event_id", ["x_pow"])


@register("null_if_infinite", sql_round("""SELECT event_id, CASE WHEN isinf(power(10.0, value)) THEN NULL
  ELSE log10(power(10.0, value)) END AS log_x FROM events""", digits=DIGITS))
def q_null_inf(spark, d):
    e = table(spark, d, "events").select("event_id", F.pow(F.lit(10.0), F.col("value")).alias("x"))
    return round_doubles(e.select("event_id", F.log10(null_if_infinite("x")).alias("log_x")), DIGITS)


@register("null_if_sentinel", with_views(sql_round("""SELECT SK_ID_BUREAU, nullif(DAYS_CREDIT, 365243) AS DAYS_CREDIT,
  nullif(DAYS_CREDIT + 365243 + 1185, 365243) AS DAYS_SHIFTED FROM bureau""", digits=DIGITS), "bureau"))
def q_null_sentinel(spark, d):
    from riskloom.sources.tables import bureau
    b = bureau(spark, d)
    return b.select("SK_ID_BUREAU", null_if_sentinel("DAYS_CREDIT").alias("DAYS_CREDIT"),
                    null_if_sentinel(F.col("DAYS_CREDIT") + 365243 + 1185).alias("DAYS_SHIFTED"))


@register("ratio_projection", with_views(sql_round(
    f"SELECT SK_ID_CURR, PAYMENT_PERC, PAYMENT_DIFF FROM {CF._INS_FRAME_SQL} i", digits=DIGITS), "instalments"))
def q_ratio(spark, d):
    return round_doubles(CF.instalments_frame(spark, d).select("SK_ID_CURR", "PAYMENT_PERC", "PAYMENT_DIFF"), DIGITS)


def application_amounts(spark, d):
    """Applications with the amounts and days that their ratios are made of,
    from the client's orders: days of the first order stand for birth, of the
    last urgent one for employment (the sentinel where there is none)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("SK_ID_CURR"), F.col("o_totalprice").alias("amount"),
                                         days_from_ref(F.col("o_orderdate")).alias("day"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    own = o.groupBy("SK_ID_CURR").agg(F.sum("amount").alias("AMT_CREDIT"), F.avg("amount").alias("AMT_ANNUITY"), F.min("day").alias("DAYS_BIRTH"),
                                      F.coalesce(F.max(F.when(F.col("urgent"), F.col("day"))), F.lit(365243)).alias("DAYS_EMPLOYED"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("SK_ID_CURR"), F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
                                           (F.col("c_nationkey") % 6).alias("CNT_FAM_MEMBERS"))
    return c.join(own, "SK_ID_CURR", "left")


_AMOUNTS_SQL = """SELECT c_custkey AS SK_ID_CURR, c_acctbal AS AMT_INCOME_TOTAL, c_nationkey % 6 AS CNT_FAM_MEMBERS, o.* EXCLUDE (o_custkey)
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS AMT_CREDIT, avg(o_totalprice) AS AMT_ANNUITY,
    min(datediff('day', DATE '2001-12-31', CAST(o_orderdate AS DATE))) AS DAYS_BIRTH,
    coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN datediff('day', DATE '2001-12-31', CAST(o_orderdate AS DATE)) END), 365243) AS DAYS_EMPLOYED
    FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"""


def _ratio_sql(ratios) -> str:
    value = lambda c: f"CAST(nullif({c}, 365243) AS DOUBLE)" if c in RT.SENTINEL_COLS else f"CAST({c} AS DOUBLE)"
    return ", ".join(f"CASE WHEN {value(b)} <> 0 THEN {value(a)} / {value(b)} END AS {name}" for name, (a, b) in ratios.items())


@register("ratio_projection_application", sql_round(
    f"SELECT SK_ID_CURR, {_ratio_sql(RT.APPLICATION_RATIOS)} FROM ({_AMOUNTS_SQL}) a", digits=DIGITS))
def q_ratio_application(spark, d):
    return round_doubles(RT.ratio_columns(application_amounts(spark, d), RT.APPLICATION_RATIOS).select(
        "SK_ID_CURR", *RT.APPLICATION_RATIOS), DIGITS)


@register("ratio_projection_previous", with_views(sql_round(
    f"SELECT SK_ID_PREV, {_ratio_sql(RT.PREVIOUS_RATIOS)} FROM previous_application", digits=DIGITS), "previous_application"))
def q_ratio_previous(spark, d):
    from riskloom.sources.tables import previous_application
    return round_doubles(RT.ratio_columns(previous_application(spark, d), RT.PREVIOUS_RATIOS).select(
        "SK_ID_PREV", *RT.PREVIOUS_RATIOS), DIGITS)


@register("clamp_positive_diff", with_views(sql_round(
    f"SELECT SK_ID_CURR, DPD, DBD FROM {CF._INS_FRAME_SQL} i", digits=DIGITS), "instalments"))
def q_clamp(spark, d):
    return round_doubles(CF.instalments_frame(spark, d).select("SK_ID_CURR", "DPD", "DBD"), DIGITS)


@register("drop_columns", with_views(sql_round("SELECT * EXCLUDE (SK_ID_PREV) FROM credit_card", digits=DIGITS), "credit_card"))
def q_drop(spark, d):
    from riskloom.sources.tables import credit_card
    return round_doubles(credit_card(spark, d).drop("SK_ID_PREV", "NOT_A_COLUMN"), DIGITS)


@register("filter_not_equal_keep_null", """SELECT o_orderkey, priority FROM (
  SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders) o WHERE priority IS DISTINCT FROM '5-LOW'""")
def q_ne_keep_null(spark, d):
    """Orders of no stated priority are null and stay."""
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))
    return o.where(~F.col("priority").eqNullSafe("5-LOW"))


@register("filter_point", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def q_point(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_acctbal")


@register("filter_date_range", """SELECT o_orderkey, o_orderdate FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'""")
def q_date_range(spark, d):
    o = table(spark, d, "orders")
    return o.where(F.to_date("o_orderdate").between(F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"))
                   ).select("o_orderkey", "o_orderdate")


RETENTION_DAYS = 3 * 365


@register("retention_filter", f"""SELECT o_orderkey FROM orders, (SELECT max(CAST(o_orderdate AS DATE)) AS max_date FROM orders) m
  WHERE CAST(o_orderdate AS DATE) >= max_date - INTERVAL {RETENTION_DAYS} DAY""")
def q_retention(spark, d):
    o = table(spark, d, "orders")
    asof = o.agg(F.max(F.to_date("o_orderdate")).alias("__asof"))
    j = o.crossJoin(F.broadcast(asof))  # one row
    return j.where(F.to_date("o_orderdate") >= F.date_sub(F.col("__asof"), RETENTION_DAYS)).select("o_orderkey")


# company query: name OR any alias contained in the text (dictionary is a parameter)
COMPANY_QUERY = {"onen": ["thor", "ereth"]}


@register("filter_text_query", "SELECT doc_id FROM documents WHERE " + " OR ".join(
    f"strpos(lower(text), '{w}') > 0" for n, al in COMPANY_QUERY.items() for w in [n] + al))
def q_text_query(spark, d):
    from riskloom.functions.text import any_contained
    doc = table(spark, d, "documents")
    words = [w for n, al in COMPANY_QUERY.items() for w in [n] + al]
    return doc.where(any_contained(F.lower("text"), words)).select("doc_id")


@register("coerce_numeric", "SELECT page_id, TRY_CAST(split_part(url, '/', 5) AS DOUBLE) AS page_number FROM pages")
def q_coerce(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.split_part("url", F.lit("/"), F.lit(5)).try_cast("double").alias("page_number"))


REQUIRED = {"fundamentals": ["ticker", "date", "revenue", "total_debt", "shareholders_equity", "total_assets"],
            "prices": ["ticker", "date", "close", "volume"],
            "news": ["ticker", "date", "sentiment_score", "news_volume", "earnings_sentiment"]}


def _required_sql() -> str:
    views = {"fundamentals": "fundamentals", "prices": "prices_daily", "news": "news_daily"}
    return " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{c}' AS column_name, {str(c != 'earnings_sentiment').lower()} AS present, count(*) AS n_rows, "
        f"{'count(' + c + ')' if c != 'earnings_sentiment' else 'CAST(0 AS BIGINT)'} AS n_filled FROM {views[s]}"
        for s, cs in REQUIRED.items() for c in cs)


@register("validate_required_cols", P.with_panel_views(_required_sql(), "fundamentals", "prices_daily", "news_daily"))
def q_validate_cols(spark, d):
    from riskloom.operators.validation import validate_required
    return validate_required({"fundamentals": P.fundamentals(spark, d), "prices": P.prices_daily(spark, d),
                              "news": P.news_daily(spark, d)}, REQUIRED)


@register("validate_financials", P.with_panel_views(f"""SELECT ticker, date,
  coalesce(revenue >= 0, true) AND coalesce(total_assets > 0, true)
  AND (CASE WHEN coalesce(current_assets, 0) <> 0 AND coalesce(total_assets, 0) <> 0 THEN current_assets <= total_assets * 1.1 ELSE true END)
  AND (CASE WHEN total_assets IS NOT NULL AND shareholders_equity IS NOT NULL AND current_liabilities IS NOT NULL
            THEN total_assets - shareholders_equity >= 0 ELSE true END)
  AND (revenue IS NOT NULL OR total_assets IS NOT NULL OR shareholders_equity IS NOT NULL OR net_income IS NOT NULL) AS is_valid
  FROM fundamentals""", "fundamentals"))
def q_validate_fin(spark, d):
    from riskloom.operators.validation import validate_financials
    f = P.fundamentals(spark, d)
    return f.select("ticker", "date", validate_financials().alias("is_valid"))


@register("validate_ticker", """SELECT name, regexp_full_match(name, '[\\p{L}\\p{N}]{1,10}') AS valid FROM (
  SELECT n_name AS name FROM nation UNION ALL SELECT DISTINCT c_mktsegment FROM customer
  UNION ALL SELECT s_name FROM supplier) t""")
def q_validate_ticker(spark, d):
    from riskloom.operators.rules import validate_ticker
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return n.unionByName(c).unionByName(s).select("name", validate_ticker("name").alias("valid"))


# ------------------------------------------------------------------ 2.4 rates
@register("agg_target_rate", with_views(sql_round("""SELECT coalesce(NAME_CONTRACT_TYPE, 'Unknown') AS category,
  avg(TARGET) * 100 AS target_pct, count(*) AS n FROM application GROUP BY 1""", digits=DIGITS), "application"))
def q_target_rate(spark, d):
    from riskloom.sources.tables import application
    a = application(spark, d)
    g = a.groupBy(F.coalesce("NAME_CONTRACT_TYPE", F.lit("Unknown")).alias("category")).agg(
        (F.avg("TARGET") * 100).alias("target_pct"), F.count(F.lit(1)).alias("n"))
    return round_doubles(g.orderBy("category"), DIGITS)


@register("crosstab_pct", with_views(sql_round("""SELECT NAME_CONTRACT_TYPE AS category,
  count(CASE WHEN TARGET = 0 THEN 1 END) * 100.0 / count(*) AS pct_0,
  count(CASE WHEN TARGET = 1 THEN 1 END) * 100.0 / count(*) AS pct_1 FROM application GROUP BY 1""", digits=DIGITS),
    "application"))
def q_crosstab(spark, d):
    from riskloom.sources.tables import application
    a = application(spark, d)
    t = a.groupBy(F.col("NAME_CONTRACT_TYPE").alias("category")).pivot("TARGET", [0, 1]).count().fillna(0)
    tot = F.col("0") + F.col("1")
    return round_doubles(t.select("category", (F.col("0") * 100.0 / tot).alias("pct_0"),
                                  (F.col("1") * 100.0 / tot).alias("pct_1")), DIGITS)


@register("summary_describe", sql_round("""SELECT count(c_acctbal) AS count, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std,
  min(c_acctbal) AS min, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.5) AS q50,
  quantile_cont(c_acctbal, 0.75) AS q75, max(c_acctbal) AS max FROM customer""", digits=4))
def q_summary(spark, d):
    from riskloom.operators.ranks import exact_quantiles
    from riskloom.operators.aggregates import var_of
    c = table(spark, d, "customer")
    base = c.agg(F.count("c_acctbal").alias("count"), mean_of(F.col("c_acctbal")).alias("mean"),
                 F.sqrt(var_of(F.col("c_acctbal"))).alias("std"), F.min("c_acctbal").alias("min"),
                 F.max("c_acctbal").alias("max"))
    q = exact_quantiles(c, "c_acctbal", [0.25, 0.5, 0.75], prefix="q")
    q = q.select(F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return round_doubles(base.crossJoin(q), 4)
