"""Part A: one wide feature row per client.

application LEFT JOIN five child aggregates.  Each child table is reduced to
one row per client by a single ``groupBy`` (partial aggregation, one shuffle
on the key); the left joins then meet unique-key sides, so AQE can pick a
broadcast for small aggregates at run time or a sort-merge join on the
already hash-partitioned key.  Category vocabularies are discovered with one
bounded distinct job per child table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import clamp_positive, sdiv
from riskloom.operators.aggregates import (agg_all_columns, agg_multi_stat, category_share_exprs, category_values,
                                           discover_vocabulary, integral_columns, multi_stat_exprs,
                                           one_hot_exprs)
from riskloom.plans import sqlgen
from riskloom.plans.common import register, round_doubles, sql_round, with_views
from riskloom.sources import tables as T
from riskloom.sources.tables import table

# ------------------------------------------------------------------ specs
# Statistics per column of each child table.
BB_SPEC = {"MONTHS_BALANCE": ["min", "max", "size"]}
BUREAU_SPEC = {
    "DAYS_CREDIT": ["min", "max", "mean", "var"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum"],
}
BUREAU_CATS = ["CREDIT_ACTIVE", "CREDIT_PRIORITY"]
BB_CATS = ["STATUS", "LINE_STATUS"]
# CREDIT_ACTIVE values standing for the reference's Active / Closed credits
ACTIVE_VALUE, CLOSED_VALUE = "O", "F"

PREV_SPEC = {
    "AMT_APPLICATION": ["min", "max", "mean"],
    "AMT_CREDIT": ["min", "max", "mean"],
    "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
    "DAYS_DECISION": ["min", "max", "mean"],
}
PREV_CATS = ["NAME_CONTRACT_STATUS", "NAME_PRODUCT_TYPE"]
APPROVED_VALUE, REFUSED_VALUE = "F", "P"

POS_SPEC = {"MONTHS_BALANCE": ["max", "mean", "size"], "SK_DPD": ["max", "mean"], "SK_DPD_DEF": ["max", "mean"]}
POS_CATS = ["NAME_CONTRACT_STATUS"]

INS_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": ["max", "mean", "sum"],
    "DBD": ["max", "mean", "sum"],
    "PAYMENT_PERC": ["max", "mean", "sum", "var"],
    "PAYMENT_DIFF": ["max", "mean", "sum", "var"],
    "AMT_INSTALMENT": ["max", "mean", "sum"],
    "AMT_PAYMENT": ["min", "max", "mean", "sum"],
    "DAYS_ENTRY_PAYMENT": ["max", "mean", "sum"],
}
INS_CATS = ["PAYMENT_FLAG"]
CC_COLS = ["AMT_QUANTITY", "AMT_BALANCE", "RATE_DISCOUNT", "RATE_TAX"]
CC_FNS = ["min", "max", "mean", "sum", "var"]

DIGITS = 4
# integer-typed inputs of the specs (their sums stay BIGINT)
INT_COLS = ("DAYS_CREDIT", "MONTHS_BALANCE", "MONTHS_BALANCE_MIN", "MONTHS_BALANCE_MAX",
            "MONTHS_BALANCE_SIZE", "SK_DPD", "SK_DPD_DEF", "DAYS_DECISION")


# ------------------------------------------------------------------ Spark
def application_features(spark: SparkSession, d: str, vocab: dict | None = None) -> DataFrame:
    app = T.application(spark, d)
    # CODE_GENDER != 'XNA' with NULLs kept (role: contract type)
    app = app.where(~F.col("NAME_CONTRACT_TYPE").eqNullSafe("XNA"))
    vocab = vocab or discover_vocabulary(app, ["NAME_CONTRACT_TYPE"])
    return app.select(*one_hot_exprs(vocab, nan_category=False,
                                     keep=["SK_ID_CURR", "TARGET", "NATION_KEY", "AMT_BALANCE"]))


def bureau_balance_agg(spark: SparkSession, d: str) -> DataFrame:
    bb = T.bureau_balance(spark, d)
    vocab = discover_vocabulary(bb, BB_CATS)
    return agg_multi_stat(bb, "SK_ID_BUREAU", BB_SPEC, "", vocab=vocab)


def bureau_agg(spark: SparkSession, d: str) -> DataFrame:
    """bureau_balance → bureau → client, with Active / Closed subsets."""
    bb_agg = bureau_balance_agg(spark, d)
    bb_cat_cols = [c for c in bb_agg.columns if c.endswith("_MEAN")]
    bureau = T.bureau(spark, d)
    vocab = discover_vocabulary(bureau, BUREAU_CATS)
    b = bureau.join(bb_agg, "SK_ID_BUREAU", "left").drop("SK_ID_BUREAU")
    spec = dict(BUREAU_SPEC)
    spec.update({c: ["mean"] for c in bb_cat_cols})
    active = F.col("CREDIT_ACTIVE") == F.lit(ACTIVE_VALUE)
    closed = F.col("CREDIT_ACTIVE") == F.lit(CLOSED_VALUE)
    ints = integral_columns(b)
    exprs = (multi_stat_exprs(BUREAU_SPEC, "BURO_", integral=ints) + category_share_exprs(vocab, "BURO_")
             + multi_stat_exprs({c: ["mean"] for c in bb_cat_cols}, "BURO_")
             + multi_stat_exprs(BUREAU_SPEC, "ACTIVE_", active, integral=ints)
             + multi_stat_exprs(BUREAU_SPEC, "CLOSED_", closed, integral=ints))
    return b.where(F.col("SK_ID_CURR").isNotNull()).groupBy("SK_ID_CURR").agg(*exprs)


def prev_agg(spark: SparkSession, d: str) -> DataFrame:
    prev = T.previous_application(spark, d).withColumn(
        "APP_CREDIT_PERC", sdiv("AMT_APPLICATION", "AMT_CREDIT"))
    vocab = discover_vocabulary(prev, PREV_CATS)
    return agg_multi_stat(prev, "SK_ID_CURR", PREV_SPEC, "PREV_", vocab=vocab,
                          subsets={"APPROVED_": F.col("NAME_CONTRACT_STATUS") == APPROVED_VALUE,
                                   "REFUSED_": F.col("NAME_CONTRACT_STATUS") == REFUSED_VALUE})


def pos_agg(spark: SparkSession, d: str) -> DataFrame:
    pos = T.pos_cash(spark, d)
    vocab = discover_vocabulary(pos, POS_CATS)
    return agg_multi_stat(pos, "SK_ID_CURR", POS_SPEC, "POS_", vocab=vocab, count_name="POS_COUNT")


def instalments_frame(spark: SparkSession, d: str) -> DataFrame:
    return with_instalment_ratios(T.instalments(spark, d))


def with_instalment_ratios(ins: DataFrame) -> DataFrame:
    return ins.select(
        "*",
        sdiv("AMT_PAYMENT", "AMT_INSTALMENT").alias("PAYMENT_PERC"),
        (F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT")).alias("PAYMENT_DIFF"),
        clamp_positive(F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")).alias("DPD"),
        clamp_positive(F.col("DAYS_INSTALMENT") - F.col("DAYS_ENTRY_PAYMENT")).alias("DBD"),
    )


def ins_agg(spark: SparkSession, d: str) -> DataFrame:
    ins = instalments_frame(spark, d)
    vocab = discover_vocabulary(ins, INS_CATS)
    return agg_multi_stat(ins, "SK_ID_CURR", INS_SPEC, "INSTAL_", vocab=vocab, count_name="INSTAL_COUNT")


def cc_agg(spark: SparkSession, d: str) -> DataFrame:
    cc = T.credit_card(spark, d).drop("SK_ID_PREV")
    return agg_all_columns(cc, "SK_ID_CURR", "CC_", CC_FNS, count_name="CC_COUNT")


def vocabularies(spark: SparkSession, d: str) -> dict[str, list]:
    """Values of all category columns, each read from the table that holds it,
    in one job."""
    pairs = None
    for name, cols in (("customer", ["c_mktsegment"]), ("orders", ["o_orderstatus", "o_orderpriority"]),
                       ("lineitem", ["l_returnflag", "l_linestatus"])):
        p = table(spark, d, name).select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p")).select("p.*")
        pairs = p if pairs is None else pairs.unionByName(p)
    return category_values(pairs)


def clustered(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, those of one key brought together before a wide
    aggregate.  A row is narrow and its partial aggregate some hundred columns
    wide: aggregated where it is read, a key's few rows lie in as many tasks and
    nearly every row is shuffled as a wide one.  Clustered, only narrow rows are
    shuffled.  A key's rows are added up one by one where they meet: one that
    has most of the rows takes one task longer, but no more memory."""
    return df.where(F.col(key).isNotNull()).repartition(key)


def order_level_agg(spark: SparkSession, d: str, vocab: dict) -> DataFrame:
    """Bureau and previous-application features of a client: lines to orders,
    then orders to clients, for both roles at once."""
    bb_vocab = {"STATUS": vocab.get("l_returnflag", []), "LINE_STATUS": vocab.get("l_linestatus", [])}
    li = T.order_lines(spark, d)
    # narrow lines are shuffled, for the grouping and the join alike
    per_order = clustered(li, "SK_ID_BUREAU").groupBy("SK_ID_BUREAU").agg(
        *multi_stat_exprs(BB_SPEC, integral=integral_columns(li)), *category_share_exprs(bb_vocab),
        F.sum("NET").alias("AMT_CREDIT"))
    bb_cats = [c for c in per_order.columns if c.endswith("_MEAN")]
    o = T.bureau(spark, d).join(per_order, "SK_ID_BUREAU", "left").drop("SK_ID_BUREAU")
    o = o.select("*", F.col("AMT_CREDIT_SUM").alias("AMT_APPLICATION"), F.col("DAYS_CREDIT").alias("DAYS_DECISION"),
                 sdiv("AMT_CREDIT_SUM", "AMT_CREDIT").alias("APP_CREDIT_PERC"),
                 F.col("CREDIT_ACTIVE").alias("NAME_CONTRACT_STATUS"), F.col("CREDIT_PRIORITY").alias("NAME_PRODUCT_TYPE"))
    ints = integral_columns(o)
    status, priority = vocab.get("o_orderstatus", []), vocab.get("o_orderpriority", [])
    subset = lambda v: F.col("CREDIT_ACTIVE") == F.lit(v)
    exprs = (multi_stat_exprs(BUREAU_SPEC, "BURO_", integral=ints)
             + category_share_exprs({"CREDIT_ACTIVE": status, "CREDIT_PRIORITY": priority}, "BURO_")
             + multi_stat_exprs({c: ["mean"] for c in bb_cats}, "BURO_")
             + multi_stat_exprs(BUREAU_SPEC, "ACTIVE_", subset(ACTIVE_VALUE), integral=ints)
             + multi_stat_exprs(BUREAU_SPEC, "CLOSED_", subset(CLOSED_VALUE), integral=ints)
             + multi_stat_exprs(PREV_SPEC, "PREV_", integral=ints)
             + category_share_exprs({"NAME_CONTRACT_STATUS": status, "NAME_PRODUCT_TYPE": priority}, "PREV_")
             + multi_stat_exprs(PREV_SPEC, "APPROVED_", subset(APPROVED_VALUE), integral=ints)
             + multi_stat_exprs(PREV_SPEC, "REFUSED_", subset(REFUSED_VALUE), integral=ints))
    return clustered(o, "SK_ID_CURR").groupBy("SK_ID_CURR").agg(*exprs)


def line_level_agg(spark: SparkSession, d: str, vocab: dict) -> DataFrame:
    """POS, instalment and card features of a client: one join, one grouping."""
    lines = with_instalment_ratios(T.line_roles(spark, d))
    ints = integral_columns(lines)
    exprs = (multi_stat_exprs(POS_SPEC, "POS_", integral=ints)
             + category_share_exprs({"NAME_CONTRACT_STATUS": vocab.get("l_linestatus", [])}, "POS_")
             + multi_stat_exprs(INS_SPEC, "INSTAL_", integral=ints)
             + category_share_exprs({"PAYMENT_FLAG": vocab.get("l_returnflag", [])}, "INSTAL_")
             + multi_stat_exprs({c: CC_FNS for c in CC_COLS}, "CC_", integral=ints)
             + [F.count(F.lit(1)).alias(n) for n in ("POS_COUNT", "INSTAL_COUNT", "CC_COUNT")])
    return clustered(lines, "SK_ID_CURR").groupBy("SK_ID_CURR").agg(*exprs)


def client_features(spark: SparkSession, d: str) -> DataFrame:
    """application LEFT JOIN bureau, previous, POS, instalments, card
    aggregates.  The first two are views of orders and their lines, the others
    of the same line join, so each base table is scanned at most twice."""
    vocab = vocabularies(spark, d)
    df = application_features(spark, d, {"NAME_CONTRACT_TYPE": vocab.get("c_mktsegment", [])})
    for part in (order_level_agg, line_level_agg):
        df = df.join(part(spark, d, vocab), "SK_ID_CURR", "left")
    return df


# ------------------------------------------------------------------ SQL twins
def _bb_agg_sql() -> str:
    vocab = {"STATUS": sqlgen.DOMAINS["l_returnflag"], "LINE_STATUS": sqlgen.DOMAINS["l_linestatus"]}
    cols = sqlgen.multi_stat(BB_SPEC, integral=INT_COLS) + sqlgen.category_share(vocab)
    return f"SELECT SK_ID_BUREAU, {', '.join(cols)} FROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL GROUP BY SK_ID_BUREAU"


def _bb_cat_cols() -> list[str]:
    out = []
    for col, dom in (("STATUS", "l_returnflag"), ("LINE_STATUS", "l_linestatus")):
        out += [f"{col}_{sqlgen.clean_token(v)}_MEAN" for v in sqlgen.DOMAINS[dom]] + [f"{col}_nan_MEAN"]
    return out


def _bureau_agg_sql() -> str:
    vocab = {"CREDIT_ACTIVE": sqlgen.DOMAINS["o_orderstatus"], "CREDIT_PRIORITY": sqlgen.DOMAINS["o_orderpriority"]}
    cols = (sqlgen.multi_stat(BUREAU_SPEC, "BURO_", integral=INT_COLS) + sqlgen.category_share(vocab, "BURO_")
            + sqlgen.multi_stat({c: ["mean"] for c in _bb_cat_cols()}, "BURO_", integral=INT_COLS)
            + sqlgen.multi_stat(BUREAU_SPEC, "ACTIVE_", f"CREDIT_ACTIVE = '{ACTIVE_VALUE}'", integral=INT_COLS)
            + sqlgen.multi_stat(BUREAU_SPEC, "CLOSED_", f"CREDIT_ACTIVE = '{CLOSED_VALUE}'", integral=INT_COLS))
    return (f"SELECT b.SK_ID_CURR, {', '.join(cols)} FROM bureau b LEFT JOIN ({_bb_agg_sql()}) bb "
            f"ON b.SK_ID_BUREAU = bb.SK_ID_BUREAU WHERE b.SK_ID_CURR IS NOT NULL GROUP BY b.SK_ID_CURR")


def _prev_agg_sql() -> str:
    vocab = {"NAME_CONTRACT_STATUS": sqlgen.DOMAINS["o_orderstatus"],
             "NAME_PRODUCT_TYPE": sqlgen.DOMAINS["o_orderpriority"]}
    cols = (sqlgen.multi_stat(PREV_SPEC, "PREV_", integral=INT_COLS) + sqlgen.category_share(vocab, "PREV_")
            + sqlgen.multi_stat(PREV_SPEC, "APPROVED_", f"NAME_CONTRACT_STATUS = '{APPROVED_VALUE}'", integral=INT_COLS)
            + sqlgen.multi_stat(PREV_SPEC, "REFUSED_", f"NAME_CONTRACT_STATUS = '{REFUSED_VALUE}'", integral=INT_COLS))
    return (f"SELECT SK_ID_CURR, {', '.join(cols)} FROM (SELECT *, "
            f"CASE WHEN AMT_CREDIT <> 0 THEN AMT_APPLICATION / AMT_CREDIT END AS APP_CREDIT_PERC "
            f"FROM previous_application) p WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR")


def _pos_agg_sql() -> str:
    cols = (sqlgen.multi_stat(POS_SPEC, "POS_", integral=INT_COLS)
            + sqlgen.category_share({"NAME_CONTRACT_STATUS": sqlgen.DOMAINS["l_linestatus"]}, "POS_")
            + ["count(*) AS POS_COUNT"])
    return f"SELECT SK_ID_CURR, {', '.join(cols)} FROM pos_cash WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"


_INS_FRAME_SQL = """(SELECT *,
    CASE WHEN AMT_INSTALMENT <> 0 THEN AMT_PAYMENT / AMT_INSTALMENT END AS PAYMENT_PERC,
    AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
    CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT ELSE 0.0 END AS DPD,
    CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT > 0 THEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT ELSE 0.0 END AS DBD
  FROM instalments)"""


def _ins_agg_sql() -> str:
    cols = (sqlgen.multi_stat(INS_SPEC, "INSTAL_", integral=INT_COLS)
            + sqlgen.category_share({"PAYMENT_FLAG": sqlgen.DOMAINS["l_returnflag"]}, "INSTAL_")
            + ["count(*) AS INSTAL_COUNT"])
    return f"SELECT SK_ID_CURR, {', '.join(cols)} FROM {_INS_FRAME_SQL} i WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"


def _cc_agg_sql() -> str:
    cols = sqlgen.multi_stat({c: CC_FNS for c in CC_COLS}, "CC_", integral=INT_COLS) + ["count(*) AS CC_COUNT"]
    return f"SELECT SK_ID_CURR, {', '.join(cols)} FROM credit_card WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"


def _app_sql() -> str:
    oh = sqlgen.one_hot({"NAME_CONTRACT_TYPE": sqlgen.DOMAINS["c_mktsegment"]})
    return (f"SELECT SK_ID_CURR, TARGET, NATION_KEY, AMT_BALANCE, {', '.join(oh)} FROM application "
            f"WHERE NAME_CONTRACT_TYPE IS DISTINCT FROM 'XNA'")


ALL_VIEWS = ("application", "bureau", "bureau_balance", "previous_application", "pos_cash", "instalments", "credit_card")


def _client_features_sql() -> str:
    body = (f"SELECT * FROM ({_app_sql()}) a "
            f"LEFT JOIN ({_bureau_agg_sql()}) USING (SK_ID_CURR) "
            f"LEFT JOIN ({_prev_agg_sql()}) USING (SK_ID_CURR) "
            f"LEFT JOIN ({_pos_agg_sql()}) USING (SK_ID_CURR) "
            f"LEFT JOIN ({_ins_agg_sql()}) USING (SK_ID_CURR) "
            f"LEFT JOIN ({_cc_agg_sql()}) USING (SK_ID_CURR)")
    return with_views(sql_round(body, digits=DIGITS), *ALL_VIEWS)


# ------------------------------------------------------------------ registry
@register("wide_feature_join", _client_features_sql())
def q_wide_feature_join(spark, d):
    return round_doubles(client_features(spark, d), DIGITS)


@register("agg_two_level", with_views(sql_round(
    f"SELECT SK_ID_CURR, BURO_MONTHS_BALANCE_MIN_MIN, BURO_MONTHS_BALANCE_MAX_MAX, BURO_MONTHS_BALANCE_SIZE_MEAN, "
    f"BURO_MONTHS_BALANCE_SIZE_SUM, BURO_STATUS_A_MEAN_MEAN, BURO_STATUS_nan_MEAN_MEAN, BURO_LINE_STATUS_F_MEAN_MEAN "
    f"FROM ({_bureau_agg_sql()}) x", digits=DIGITS), "bureau", "bureau_balance"))
def q_agg_two_level(spark, d):
    return round_doubles(bureau_agg(spark, d).select(
        "SK_ID_CURR", "BURO_MONTHS_BALANCE_MIN_MIN", "BURO_MONTHS_BALANCE_MAX_MAX", "BURO_MONTHS_BALANCE_SIZE_MEAN",
        "BURO_MONTHS_BALANCE_SIZE_SUM", "BURO_STATUS_A_MEAN_MEAN", "BURO_STATUS_nan_MEAN_MEAN",
        "BURO_LINE_STATUS_F_MEAN_MEAN"), DIGITS)


@register("agg_conditional_subset", with_views(sql_round(f"SELECT * FROM ({_bureau_agg_sql()}) x", digits=DIGITS),
                                               "bureau", "bureau_balance"))
def q_agg_conditional_subset(spark, d):
    return round_doubles(bureau_agg(spark, d), DIGITS)


@register("agg_multi_stat", with_views(sql_round(
    "SELECT SK_ID_CURR, " + ", ".join(sqlgen.multi_stat(BUREAU_SPEC | {"DAYS_CREDIT": ["min", "max", "mean", "sum", "var", "size", "nunique"]}, "BURO_", integral=INT_COLS))
    + " FROM (SELECT b.*, bb.* EXCLUDE (SK_ID_BUREAU) FROM bureau b LEFT JOIN (" + _bb_agg_sql() + ") bb USING (SK_ID_BUREAU)) x "
    "WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR", digits=DIGITS), "bureau", "bureau_balance"))
def q_agg_multi_stat(spark, d):
    b = T.bureau(spark, d).join(bureau_balance_agg(spark, d), "SK_ID_BUREAU", "left")
    spec = BUREAU_SPEC | {"DAYS_CREDIT": ["min", "max", "mean", "sum", "var", "size", "nunique"]}
    return round_doubles(agg_multi_stat(b, "SK_ID_CURR", spec, "BURO_"), DIGITS)


@register("agg_category_share", with_views(sql_round(
    "SELECT SK_ID_CURR, " + ", ".join(sqlgen.category_share(
        {"CREDIT_ACTIVE": sqlgen.DOMAINS["o_orderstatus"], "CREDIT_PRIORITY": sqlgen.DOMAINS["o_orderpriority"]}, "BURO_"))
    + " FROM bureau WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR", digits=DIGITS), "bureau"))
def q_agg_category_share(spark, d):
    b = T.bureau(spark, d)
    vocab = discover_vocabulary(b, BUREAU_CATS)
    return round_doubles(agg_multi_stat(b, "SK_ID_CURR", {}, "BURO_", vocab=vocab), DIGITS)


@register("agg_prev_applications", with_views(sql_round(_prev_agg_sql(), digits=DIGITS), "previous_application"))
def q_agg_prev(spark, d):
    return round_doubles(prev_agg(spark, d), DIGITS)


@register("agg_pos_cash", with_views(sql_round(_pos_agg_sql(), digits=DIGITS), "pos_cash"))
def q_agg_pos(spark, d):
    return round_doubles(pos_agg(spark, d), DIGITS)


@register("agg_instalments", with_views(sql_round(_ins_agg_sql(), digits=DIGITS), "instalments"))
def q_agg_ins(spark, d):
    return round_doubles(ins_agg(spark, d), DIGITS)


@register("agg_all_columns", with_views(sql_round(_cc_agg_sql(), digits=DIGITS), "credit_card"))
def q_agg_cc(spark, d):
    return round_doubles(cc_agg(spark, d), DIGITS)


@register("left_join_agg", with_views(sql_round(
    f"SELECT * FROM ({_app_sql()}) a LEFT JOIN ({_pos_agg_sql()}) USING (SK_ID_CURR)", digits=DIGITS),
    "application", "pos_cash"))
def q_left_join_agg(spark, d):
    return round_doubles(application_features(spark, d).join(pos_agg(spark, d), "SK_ID_CURR", "left"), DIGITS)
