"""Shared helpers for registered plans: output rounding and a registry.

Every registered query has a Spark builder ``f(spark, sf_dir) -> DataFrame``
and, where the semantics are SQL-expressible, a DuckDB oracle string over the
driver's tables.  Numeric outputs are rounded identically on both sides so
that different summation orders cannot change the value hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_half_away(c, digits: int):
    """``round(x * 10^d) / 10^d``: the same IEEE steps as DuckDB's round, so an
    identical double rounds identically on both engines (Spark's own
    ``round(x, d)`` rounds the shortest decimal text instead)."""
    m = float(10 ** digits)
    return F.round(c * F.lit(m)) / F.lit(m) + F.lit(0.0)  # + 0.0: no negative zero


# Means and variances: their last bits depend on the order of sums, so they are
# cut to single precision (seven digits) before decimals are rounded.  A binary
# grid, as means of few amounts often lie half-way between two decimal ones.
RELATIVE = "(_VAR|_STD|_MEAN)$|^ma_"


def significant(c):
    return c.cast("float").cast("double")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType) and re.search(RELATIVE, f.name):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(c.isNotNull(), round_half_away(significant(c), digits)).alias(f.name))
        elif isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            cols.append(round_half_away(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# Output columns that are never numeric (dates, timestamps, labels, flags,
# lists); everything else in an oracle result is rounded.
NON_NUMERIC = {"date", "ts", "sector", "timestamp", "window_start", "window_end", "label", "feature",
               "column_name", "dtype", "risk_category", "category", "direction", "trend", "severity",
               "message", "name", "text", "title", "url", "matched_keywords", "key_events", "impact_level",
               "source", "lang", "role", "status", "alert_type", "level", "kind", "component",
               "body_md5", "text_md5", "cache_key", "headlines", "summary", "ticker_s", "rule_id", "json",
               "iso_ts", "condition", "condition_field", "fn", "metric_name", "comparison", "section"}


def sql_round(inner: str, keep: list[str] | tuple[str, ...] = (), digits: int = 6) -> str:
    """Wrap a DuckDB query so every numeric output column is rounded.

    Columns named in ``NON_NUMERIC`` or ``keep`` pass unchanged; DuckDB's
    ``round`` keeps integer types, so integers pass unchanged too.
    """
    names = sorted(NON_NUMERIC | set(keep) | {"__keep_dummy"})
    lst = ", ".join("'" + n + "'" for n in names)
    # dummy columns keep all COLUMNS() sets non-empty; dropped at the end
    rel = f"regexp_matches(c, '{RELATIVE}')"
    cut = f"COLUMNS(lambda c: c NOT IN ({lst}) AND {rel})"
    return (f"SELECT * EXCLUDE (__keep_dummy, __num_dummy, __dummy_MEAN) FROM ("
            f"SELECT COLUMNS(lambda c: c IN ({lst})), round(COLUMNS(lambda c: c NOT IN ({lst}) AND NOT {rel}), {digits}) + 0, "
            f"round(CAST(CAST({cut} AS FLOAT) AS DOUBLE), {digits}) + 0 "
            f"FROM (SELECT *, 'x' AS __keep_dummy, 0 AS __num_dummy, 0.0::DOUBLE AS \"__dummy_MEAN\" FROM ({inner}) AS q0_) AS q_) AS q1_")


# ----------------------------------------------------------- SQL role views
# DuckDB twins of riskloom.sources.tables (same mapping, written by hand).
SQL_VIEWS = {
    "application": """
        SELECT c_custkey AS SK_ID_CURR, CAST(c_acctbal < 0 AS INTEGER) AS TARGET,
               c_mktsegment AS NAME_CONTRACT_TYPE, c_nationkey AS NATION_KEY,
               c_acctbal AS AMT_BALANCE
        FROM customer""",
    "bureau": """
        SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
               o_orderstatus AS CREDIT_ACTIVE, o_orderpriority AS CREDIT_PRIORITY,
               o_totalprice AS AMT_CREDIT_SUM,
               CAST(datediff('day', DATE '2001-12-31', CAST(o_orderdate AS DATE)) AS INTEGER) AS DAYS_CREDIT
        FROM orders""",
    "bureau_balance": """
        SELECT l_orderkey AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE,
               l_returnflag AS STATUS, l_linestatus AS LINE_STATUS
        FROM lineitem""",
    "previous_application": """
        SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV,
               o_orderstatus AS NAME_CONTRACT_STATUS, o_orderpriority AS NAME_PRODUCT_TYPE,
               o_totalprice AS AMT_APPLICATION, n.AMT_CREDIT,
               CAST(datediff('day', DATE '2001-12-31', CAST(o_orderdate AS DATE)) AS INTEGER) AS DAYS_DECISION
        FROM orders LEFT JOIN (
            SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS AMT_CREDIT
            FROM lineitem GROUP BY l_orderkey) n ON o_orderkey = n.l_orderkey""",
    "instalments": """
        SELECT o_custkey AS SK_ID_CURR,
               CAST(l_linenumber AS DOUBLE) AS NUM_INSTALMENT_VERSION,
               l_extendedprice AS AMT_INSTALMENT,
               l_extendedprice * (1 - l_discount) AS AMT_PAYMENT,
               CAST(datediff('day', DATE '2001-12-31', CAST(o_orderdate AS DATE) + INTERVAL 30 DAY) AS DOUBLE) AS DAYS_INSTALMENT,
               CAST(datediff('day', DATE '2001-12-31', CAST(l_shipdate AS DATE)) AS DOUBLE) AS DAYS_ENTRY_PAYMENT,
               l_returnflag AS PAYMENT_FLAG
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pos_cash": """
        SELECT o_custkey AS SK_ID_CURR, -l_linenumber AS MONTHS_BALANCE,
               CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS SK_DPD,
               CAST(l_quantity AS INTEGER) AS SK_DPD_DEF,
               l_linestatus AS NAME_CONTRACT_STATUS
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "credit_card": """
        SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV,
               l_quantity AS AMT_QUANTITY, l_extendedprice AS AMT_BALANCE,
               l_discount + 0.0 AS RATE_DISCOUNT, l_tax + 0.0 AS RATE_TAX
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "price_ticks": """
        SELECT user_id AS ticker, event_id, ts, CAST(ts AS DATE) AS date, value AS close,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume
        FROM events""",
    "prices_daily": """
        SELECT user_id AS ticker, CAST(ts AS DATE) AS date, avg(value) AS close,
               avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS volume,
               count(*) AS n_events
        FROM events GROUP BY 1, 2""",
}


def with_cte(ctes: str, body: str) -> str:
    """``WITH <ctes> <body>``, merging a body that has its own WITH list."""
    b = body.lstrip()
    if b[:4].upper() == "WITH":
        return f"WITH {ctes}, {b[4:]}"
    return f"WITH {ctes} {body}"


def with_views(body: str, *names: str) -> str:
    """Prefix a query with WITH-clauses for the named role views."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return with_cte(ctes, body)
