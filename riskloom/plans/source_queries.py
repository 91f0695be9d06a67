"""Sources and sinks (§2.1) on files that Spark derives from the driver tables.

Landing files (CSV, JSON article pages, filing indexes) are written by Spark
into the shared checkpoint folder first, then read back with the operator
under test; results are compared with DuckDB on the original tables.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.text import WS_CLASS
from riskloom.plans.common import register, round_doubles, sql_round
from riskloom.session import ensure_checkpoint_dir, scratch_table_path
from riskloom.sources import files as FS
from riskloom.sources import filings as FL
from riskloom.sources.panel import prices_daily, with_panel_views
from riskloom.sources.tables import table

DIGITS = 6
BASE_URL = "https://filings.example.org"


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, name)


CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
NATION_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


@register("scan_csv", "SELECT * FROM customer")
def q_scan_csv(spark, d):
    path = scratch(spark, "customer-csv")
    FS.sink_csv(table(spark, d, "customer"), path)
    return FS.scan_csv(spark, path, CUSTOMER_SCHEMA)


@register("scan_csv_encoded", "SELECT * FROM nation")
def q_scan_csv_enc(spark, d):
    path = scratch(spark, "nation-latin1")
    table(spark, d, "nation").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return FS.scan_csv(spark, path, NATION_SCHEMA, encoding="ISO-8859-1")


@register("sink_csv", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_sink_csv(spark, d):
    path = scratch(spark, "orders-csv")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    FS.sink_csv(o, path)
    FS.sink_csv(o.limit(1), path)  # exists already: skipped, as in the reference
    return FS.scan_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double")


RUN_DATE = "2024-01-31"


@register("sink_parquet_dated", with_panel_views(sql_round(
    f"SELECT *, '{RUN_DATE}' AS run_date FROM prices_daily", keep=["run_date"], digits=DIGITS), "prices_daily"))
def q_sink_parquet(spark, d):
    base = scratch(spark, "features-cache")
    FS.sink_parquet_dated(prices_daily(spark, d), base, RUN_DATE)
    back = spark.read.parquet(base).withColumn("run_date", F.date_format(F.col("run_date").cast("date"), "yyyy-MM-dd"))
    return round_doubles(back, DIGITS)


SAFE_X = "CASE WHEN isinf(power(10.0, value)) THEN NULL ELSE value END"


@register("sink_json_safe", f"SELECT event_id, to_json({{'event_id': event_id, 'x': {SAFE_X}}}) AS json FROM events")
def q_json_safe(spark, d):
    e = table(spark, d, "events")
    x = F.pow(F.lit(10.0), F.col("value"))
    frame = e.select("event_id", F.when(F.abs(x) == float("inf"), F.lit(float("inf"))).otherwise(F.col("value")).alias("x"))
    return FS.to_json_records(frame, "event_id").select("event_id", "json")


def _reuse_path(spark: SparkSession, d: str, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/reuse-{FS.input_version(spark, f'{d}/orders.parquet')}-{name}"


@register("reuse_or_compute", sql_round(
    "SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS max_price FROM orders GROUP BY o_custkey", digits=DIGITS))
def q_reuse(spark, d):
    def compute():
        return (table(spark, d, "orders").groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("max_price")))
    return round_doubles(FS.reuse_or_compute(spark, _reuse_path(spark, d, "orders-by-client"), compute), DIGITS)


# ------------------------------------------------------------------ articles
QUERY = "credit risk"


def _articles_landing(spark, d) -> str:
    path = scratch(spark, "articles")
    doc = table(spark, d, "documents")
    page = F.floor(F.col("doc_id") / 100).cast("int")
    a = doc.select(F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
                   F.split_part("text", F.lit("\n"), F.lit(2)).alias("description"), F.col("text").alias("content"),
                   F.concat(F.lit("https://news.example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
                   F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), page), "yyyy-MM-dd").alias("publishedAt"),
                   F.struct(F.col("source").alias("name")).alias("source"), page.alias("page"))
    a.write.partitionBy("page").json(path)
    return path


@register("scan_json_articles", """SELECT split_part(text, '.', 1) AS title, split_part(text, chr(10), 2) AS description,
  md5(text) AS body_md5, 'https://news.example.com/a/' || CAST(doc_id AS VARCHAR) AS url,
  strftime(DATE '2024-01-01' + CAST(floor(doc_id / 100) AS INTEGER), '%Y-%m-%d') AS publishedAt, source AS source_name,
  CAST(floor(doc_id / 100) AS INTEGER) AS page, 'credit risk' AS query_used FROM documents""")
def q_scan_articles(spark, d):
    a = FS.scan_json_articles(spark, _articles_landing(spark, d), QUERY)
    return a.select("title", "description", F.md5("content").alias("body_md5"), "url", "publishedAt",
                    F.col("source.name").alias("source_name"), "page", "query_used")


# ------------------------------------------------------------------ filings
FORM_BY_STATUS = {"F": "10-K", "O": "10-Q", "P": "8-K"}


def _submissions_landing(spark, d) -> str:
    path = scratch(spark, "submissions")
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    form = F.create_map(*[x for k, v in FORM_BY_STATUS.items() for x in (F.lit(k), F.lit(v))])
    acc = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"),
                   F.substring(F.year("o_orderdate").cast("string"), 3, 2), F.lit("-"),
                   F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    f = (o.withColumn("__pos", F.row_number().over(w))
          .select("o_custkey", "__pos", F.element_at(form, F.col("o_orderstatus")).alias("form"),
                  F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), acc.alias("accessionNumber"),
                  F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primaryDocument")))
    # a submissions file is one document of all filings of a company
    g = f.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("__pos", "form", "filingDate", "accessionNumber",
                                                                         "primaryDocument"))).alias("fs"))
    sub = g.join(c, g.o_custkey == c.c_custkey).select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("name"),
        F.struct(F.struct(F.col("fs.form").alias("form"), F.col("fs.filingDate").alias("filingDate"),
                          F.col("fs.accessionNumber").alias("accessionNumber"),
                          F.col("fs.primaryDocument").alias("primaryDocument")).alias("recent")).alias("filings"))
    sub.write.json(path)
    return path


@register("scan_filing_index", f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos
    FROM orders), f AS (SELECT * FROM o WHERE o_orderstatus = 'F'),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS k FROM f)
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, c_name AS company_name, CAST(pos - 1 AS INTEGER) AS pos, '10-K' AS form_type,
    strftime(o_orderdate, '%Y-%m-%d') AS filing_date,
    lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) || '-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accession_number,
    'doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primary_document,
    '{BASE_URL}/Archives/edgar/data/' || CAST(o_custkey AS VARCHAR) || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0')
      || substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS filing_url
  FROM r JOIN customer ON o_custkey = c_custkey WHERE k <= 4""")
def q_filing_index(spark, d):
    sub = spark.read.schema(FL.SUBMISSIONS_SCHEMA).json(_submissions_landing(spark, d))
    return FL.filing_index(sub, "10-K", 4, BASE_URL)


@register("lookup_key_map", """SELECT l_orderkey, l_linenumber, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM lineitem
  LEFT JOIN supplier ON upper(trim('  supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || ' ')) = upper(trim(s_name))""")
def q_keymap(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(
        F.lit("  supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit(" ")).alias("ticker"))
    km = table(spark, d, "supplier").select(F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("cik"))
    return FL.lookup_key_map(li, "ticker", km).select("l_orderkey", "l_linenumber", "cik")


def _xml_filings(spark, d) -> DataFrame:
    """XBRL-like documents built from the fundamentals view (negative values in
    parentheses, thousands separators)."""
    from riskloom.sources.panel import fundamentals
    f = fundamentals(spark, d)

    def num(c):
        return F.when(F.col(c) < 0, F.concat(F.lit("("), F.format_number(-F.col(c), 2), F.lit(")"))) \
                .otherwise(F.format_number(F.col(c), 2))
    tag = {"revenue": "Revenues", "total_debt": "LongTermDebt", "shareholders_equity": "StockholdersEquity",
           "total_assets": "Assets", "current_assets": "AssetsCurrent", "current_liabilities": "LiabilitiesCurrent",
           "net_income": "NetIncomeLoss"}
    parts = [F.concat(F.lit(f"<us-gaap:{t}>"), num(c), F.lit(f"</us-gaap:{t}>")) for c, t in tag.items()]
    xml = F.concat(F.lit('<xbrl xmlns:us-gaap="http://example.org/us-gaap">'), *parts, F.lit("</xbrl>"))
    return f.select("ticker", "date", xml.alias("xml"))


@register("extract_xml_metrics")
def q_xml(spark, d):
    """DuckDB has no XML functions; ``tests/test_filings.py`` compares with the
    source values, and checks malformed filings and repeated elements."""
    return FL.extract_xml_metrics(_xml_filings(spark, d), "xml").drop("xml")


def _html_metric_sql(patterns: list[str]) -> str:
    parts = [f"CASE WHEN regexp_extract(html, '{p.replace(chr(39), chr(39) * 2)}', 1) <> '' THEN "
             f"TRY_CAST(replace(regexp_extract(html, '{p.replace(chr(39), chr(39) * 2)}', 1), ',', '') AS DOUBLE) * 1000 END"
             for p in patterns]
    return f"coalesce({', '.join(parts)})"


@register("extract_html_metrics", "SELECT page_id, url, " + ", ".join(
    f"{_html_metric_sql(p)} AS {m}" for m, p in FL.HTML_PATTERNS.items()) + " FROM pages")
def q_html(spark, d):
    return FL.extract_html_metrics(table(spark, d, "pages"), "html").drop("html")


def _section_sql(patterns, key="page_id") -> str:
    def sec(s, e):
        raw = f"regexp_extract(html, '(?is){s.replace(chr(39), chr(39) * 2)}(.*?)(?:{e})', 1)"
        clean = f"trim(regexp_replace(regexp_replace({raw}, '<[^>]+>', '', 'g'), '{WS_CLASS}+', ' ', 'g'))"
        return f"CASE WHEN {raw} <> '' THEN {clean} END"
    picks = ", ".join(f"CASE WHEN length({sec(s, e)}) > {FL.MIN_SECTION_CHARS} THEN {sec(s, e)} END" for s, e in patterns)
    return f"""SELECT {key}, md5(section) AS text_md5, length(section) AS text_len FROM (
      SELECT {key}, coalesce({picks}) AS section FROM pages) x WHERE section IS NOT NULL"""


@register("extract_section_text", _section_sql(FL.SECTION_PATTERNS))
def q_section(spark, d):
    s = FL.extract_section_text(table(spark, d, "pages"), "page_id", "html")
    return s.select("page_id", F.md5("section").alias("text_md5"), F.length("section").alias("text_len"))


ARTICLE_SECTION = [("<article>", "</article>")]


@register("extract_section_article", _section_sql(ARTICLE_SECTION))
def q_section_article(spark, d):
    s = FL.extract_section_text(table(spark, d, "pages"), "page_id", "html", ARTICLE_SECTION)
    return s.select("page_id", F.md5("section").alias("text_md5"), F.length("section").alias("text_len"))
