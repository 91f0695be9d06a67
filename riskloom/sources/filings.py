"""Company filing sources: submission index, key map, XML / HTML
metric extraction and section text -- all as Spark jobs over filing tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBMISSIONS_SCHEMA = ("cik string, name string, filings struct<recent: struct<form: array<string>, "
                      "filingDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>>")

# Candidate XBRL tags per metric (first present tag wins).
XBRL_TAGS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "OperatingRevenues"],
    "total_debt": ["DebtCurrent", "DebtNoncurrent", "LongTermDebt", "ShortTermBorrowings"],
    "shareholders_equity": ["StockholdersEquity", "ShareholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "cash_flow_operations": ["NetCashProvidedByUsedInOperatingActivities"],
    "total_assets": ["Assets"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
}

# Fallback HTML patterns (amounts in thousands).
HTML_PATTERNS = {
    "revenue": [r"(?i)Total\s+revenues?\s*[\$\s]*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)",
                r"(?i)Net\s+sales\s*[\$\s]*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"],
    "total_assets": [r"(?i)Total\s+assets\s*[\$\s]*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"],
    "shareholders_equity": [r"(?i)Total\s+shareholders?'\s+equity\s*[\$\s]*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)"],
}

# MD&A section start / end markers (start, alternatives of end).
SECTION_PATTERNS = [
    (r"MANAGEMENT['S\s]+DISCUSSION\s+AND\s+ANALYSIS\s+OF\s+FINANCIAL\s+CONDITION\s+AND\s+RESULTS\s+OF\s+OPERATIONS",
     r"QUANTITATIVE\s+AND\s+QUALITATIVE\s+DISCLOSURES|CONTROLS\s+AND\s+PROCEDURES|LEGAL\s+PROCEEDINGS"),
    (r"Item\s+2\.\s*Management['s\s]+Discussion\s+and\s+Analysis", r"Item\s+3\.|Item\s+4\."),
]
MIN_SECTION_CHARS = 500


def filing_index(sub: DataFrame, form_type: str, count: int, base_url: str) -> DataFrame:
    """Parallel arrays → one row per filing; keep the first ``count`` filings
    of ``form_type`` per company in array order; derive the document URL."""
    r = sub.select("cik", F.col("name").alias("company_name"),
                   F.posexplode(F.arrays_zip("filings.recent.form", "filings.recent.filingDate",
                                             "filings.recent.accessionNumber", "filings.recent.primaryDocument")))
    r = r.select("cik", "company_name", "pos", F.col("col.form").alias("form_type"),
                 F.col("col.filingDate").alias("filing_date"), F.col("col.accessionNumber").alias("accession_number"),
                 F.col("col.primaryDocument").alias("primary_document"))
    r = r.where(F.col("form_type") == form_type)
    w = Window.partitionBy("cik").orderBy("pos")
    r = r.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= count).drop("__n")
    url = F.concat(F.lit(base_url.rstrip("/") + "/Archives/edgar/data/"), F.col("cik").cast("bigint").cast("string"), F.lit("/"),
                   F.regexp_replace("accession_number", "-", ""), F.lit("/"), F.col("primary_document"))
    return r.withColumn("filing_url", url)


def normalise_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def lookup_key_map(df: DataFrame, ticker_col: str, keymap: DataFrame) -> DataFrame:
    """ticker → zero-padded 10-digit CIK by an equi-join on the normalised
    ticker (the key map grows with the data: AQE sizes the join)."""
    km = keymap.select(normalise_ticker(F.col("ticker")).alias("__t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return df.withColumn("__t", normalise_ticker(F.col(ticker_col))).join(km, "__t", "left").drop("__t")


def _number(text: Column) -> Column:
    """'(1,234)' → -1234; anything else non-numeric → NULL."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\(", "-"), r"\)", ""), ",", "")
    return t.try_cast("double")


# An element with one of the metric tags and text only, whatever its prefix.
XBRL_ELEMENT = (r"<(?:[\w.-]+:)?(" + "|".join(t for tags in XBRL_TAGS.values() for t in tags)
                + r")(?:\s[^<>]*)?>([^<]*)</")


def xml_metric(elements: Column, tags: list[str]) -> Column:
    """First numeric value of the first tag that has one.  ``elements``: the
    filing's (tag, text) pairs in document order."""
    def numbers(tag):
        return F.filter(F.transform(F.filter(elements, lambda e: e["tag"] == tag), lambda e: _number(e["text"])),
                        lambda v: v.isNotNull())
    return F.coalesce(*[F.get(numbers(t), F.lit(0)) for t in tags])


def extract_xml_metrics(filings: DataFrame, xml_col: str) -> DataFrame:
    """The metrics of each filing; all NULL where its XML is not well-formed.
    Elements are read once per filing into (tag, text) pairs, matched on the
    local name."""
    xml, cols = F.col(f"`{xml_col}`"), filings.columns
    broken = F.from_xml(xml, "_corrupt_record string, __none string", {"mode": "PERMISSIVE"})["_corrupt_record"]
    pairs = F.arrays_zip(F.regexp_extract_all(xml, F.lit(XBRL_ELEMENT), F.lit(1)).alias("tag"),
                         F.regexp_extract_all(xml, F.lit(XBRL_ELEMENT), F.lit(2)).alias("text"))
    read = filings.select("*", F.when(broken.isNull(), pairs).alias("__elements"))
    return read.select(*[F.col(f"`{c}`") for c in cols],
                       *[xml_metric(F.col("__elements"), tags).alias(m) for m, tags in XBRL_TAGS.items()])


def html_metric(html: Column, patterns: list[str]) -> Column:
    vals = []
    for p in patterns:
        g = F.regexp_extract(html, p, 1)
        vals.append(F.when(g != "", F.regexp_replace(g, ",", "").try_cast("double") * 1000))
    return F.coalesce(*vals)


def extract_html_metrics(pages: DataFrame, html_col: str) -> DataFrame:
    return pages.select("*", *[html_metric(F.col(html_col), pats).alias(m) for m, pats in HTML_PATTERNS.items()])


def extract_section(html: Column, start: str, end: str) -> Column:
    """Lazy text between start and end markers (case-insensitive, dot matches
    newline), tags removed, whitespace squeezed."""
    from riskloom.functions.text import squeeze_ws, strip_tags
    raw = F.regexp_extract(html, f"(?is){start}(.*?)(?:{end})", 1)
    return F.when(raw != "", squeeze_ws(strip_tags(raw)))


def extract_section_text(pages: DataFrame, key: str, html_col: str, patterns=SECTION_PATTERNS,
                         min_chars: int = MIN_SECTION_CHARS) -> DataFrame:
    """First pattern whose cleaned section is longer than ``min_chars``."""
    secs = [extract_section(F.col(html_col), s, e) for s, e in patterns]
    pick = F.coalesce(*[F.when(F.length(s) > min_chars, s) for s in secs])
    return pages.select(key, pick.alias("section")).where(F.col("section").isNotNull())
