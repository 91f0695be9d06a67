"""Text annotators over the driver's documents / pages / conversations (§2.9).

Article view: ticker = source, title = first sentence, description = second
line, content = whole text.  Every query reads whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import text as TX
from riskloom.functions.text import s_any, s_count, s_matched, sql_lit
from riskloom.plans.common import register, round_doubles, sql_round, with_cte
from riskloom.functions.scalar import evaluate_once
from riskloom.sources.tables import spread, table

DIGITS = 6


def articles(spark: SparkSession, d: str) -> DataFrame:
    doc = spread(table(spark, d, "documents"))
    return doc.select("doc_id", F.col("source").alias("ticker"),
                      F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
                      F.split_part("text", F.lit("\n"), F.lit(2)).alias("description"),
                      F.col("text").alias("content"))


ART_SQL = """SELECT doc_id, source AS ticker, split_part(text, '.', 1) AS title,
  split_part(text, chr(10), 2) AS description, text AS content FROM documents"""


def asql(body: str, keep=()) -> str:
    return sql_round(with_cte(f"articles AS ({ART_SQL})", body), keep=list(keep), digits=DIGITS)


LOW_ALL = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(content, '')))"
LOW_TD = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, '')))"


def _relevance_sql(kw: dict[str, list[str]], weights: dict[str, int]) -> str:
    score = " + ".join(f"{s_count('t', ws)} * {weights[g]}" for g, ws in kw.items())
    allw = [w for ws in kw.values() for w in ws]
    return asql(f"""SELECT doc_id, ticker, relevance_score, matched_keywords FROM (
      SELECT doc_id, ticker, {score} AS relevance_score, list_sort(list_distinct({s_matched('t', allw)})) AS matched_keywords
      FROM (SELECT *, {LOW_ALL} AS t FROM articles) a) r WHERE relevance_score >= {TX.RELEVANCE_MIN}""",
                keep=["ticker"])


def relevance_frame(a: DataFrame, kw=None, weights=None) -> DataFrame:
    kw = kw or TX.RELEVANCE_KEYWORDS
    weights = weights or TX.RELEVANCE_WEIGHTS
    text = F.concat_ws(" ", TX.lower_or_empty(F.col("title")), TX.lower_or_empty(F.col("description")),
                       TX.lower_or_empty(F.col("content")))
    allw = [w for ws in kw.values() for w in ws]
    # one containment flag per keyword, shared by the score and the list
    flags = a.select("doc_id", "ticker", text.alias("__t")).select(
        "doc_id", "ticker", *[TX.contains(F.col("__t"), w).alias(f"__k{i}") for i, w in enumerate(allw)])
    weight = [weights[g] for g, ws in kw.items() for _ in ws]
    score = F.lit(0)
    for i, wt in enumerate(weight):
        score = score + F.col(f"__k{i}").cast("int") * wt
    matched = F.array_compact(F.array(*[F.when(F.col(f"__k{i}"), F.lit(w)) for i, w in enumerate(allw)]))
    out = evaluate_once(flags, ["doc_id", "ticker"], {"relevance_score": score,
                                                     "matched_keywords": F.array_sort(F.array_distinct(matched))})
    return out.where(F.col("relevance_score") >= TX.RELEVANCE_MIN)


@register("keyword_relevance", _relevance_sql(TX.RELEVANCE_KEYWORDS, TX.RELEVANCE_WEIGHTS))
def q_relevance(spark, d):
    return relevance_frame(articles(spark, d))


# Corpus dictionary: the same operator with words that occur in the driver's
# invented prose (the finance words hardly occur there).
CORPUS_KEYWORDS = {"high_impact": ["with"], "medium_impact": ["and", "from"], "financial_general": ["the", "of", "this"]}


@register("keyword_relevance_corpus", _relevance_sql(CORPUS_KEYWORDS, TX.RELEVANCE_WEIGHTS))
def q_relevance_corpus(spark, d):
    return relevance_frame(articles(spark, d), CORPUS_KEYWORDS)


@register("impact_category", asql(f"""SELECT doc_id, CASE WHEN {s_any('t', TX.IMPACT_HIGH_TERMS)} THEN 'high'
  WHEN {s_any('t', TX.IMPACT_MEDIUM_TERMS)} THEN 'medium' ELSE 'low' END AS impact_level
  FROM (SELECT doc_id, {LOW_TD} AS t FROM articles) a"""))
def q_impact(spark, d):
    a = articles(spark, d)
    return a.select("doc_id", TX.impact_category(F.col("title"), F.col("description")).alias("impact_level"))


def _events_sql(t: str, patterns: dict) -> str:
    items = ", ".join(f"CASE WHEN {s_any(t, ws)} THEN {sql_lit(n)} END" for n, ws in patterns.items())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


@register("event_types", asql(f"SELECT doc_id, {_events_sql('t', TX.EVENT_PATTERNS)} AS key_events "
                              f"FROM (SELECT doc_id, {LOW_TD} AS t FROM articles) a"))
def q_events(spark, d):
    a = articles(spark, d)
    t = F.concat_ws(" ", TX.lower_or_empty(F.col("title")), TX.lower_or_empty(F.col("description")))
    return a.select("doc_id", t.alias("__t")).select("doc_id", TX.event_types(F.col("__t")).alias("key_events"))


@register("event_types_content", asql(
    f"SELECT doc_id, {_events_sql('t', TX.CONTENT_EVENT_PATTERNS)} AS key_events "
    f"FROM (SELECT doc_id, lower(content) AS t FROM articles) a"))
def q_events_content(spark, d):
    a = articles(spark, d)
    low = a.select("doc_id", F.lower("content").alias("__low"))
    return low.select("doc_id", TX.event_types(F.col("__low"), TX.CONTENT_EVENT_PATTERNS).alias("key_events"))


def _label_sql(x: str) -> str:
    pos, neg = s_count(f"lower({x})", TX.SENTIMENT_POSITIVE), s_count(f"lower({x})", TX.SENTIMENT_NEGATIVE)
    return f"CASE WHEN {pos} > {neg} THEN 'positive' WHEN {neg} > {pos} THEN 'negative' ELSE 'neutral' END"


BLANK = f"regexp_matches(coalesce({{x}}, ''), '^{TX.WS_CLASS}*$')"


def _blank(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, {sql_lit(TX.WS_CLASS + '*')}), true)"


@register("keyword_sentiment_label", asql(f"SELECT doc_id, {_label_sql('title')} AS label FROM articles"))
def q_sent_label(spark, d):
    return articles(spark, d).select("doc_id", TX.sentiment_label(F.col("title")).alias("label"))


@register("sentiment_with_default", asql(f"""SELECT doc_id,
  CASE WHEN {_blank('title')} THEN 'neutral' ELSE {_label_sql('title')} END AS label,
  CAST(CASE WHEN {_blank('title')} THEN 0.0 ELSE {TX.FALLBACK_CONFIDENCE!r} END AS DOUBLE) AS confidence,
  CASE WHEN {_blank('title')} THEN 'default' ELSE 'fallback' END AS kind FROM articles"""))
def q_sent_default(spark, d):
    a = articles(spark, d)
    blank = TX.is_blank(F.col("title"))
    return a.select("doc_id", F.when(blank, "neutral").otherwise(TX.sentiment_label(F.col("title"))).alias("label"),
                    F.when(blank, F.lit(0.0)).otherwise(F.lit(TX.FALLBACK_CONFIDENCE)).alias("confidence"),
                    F.when(blank, "default").otherwise("fallback").alias("kind"))


def _wc_sql(x: str) -> str:
    ws = TX.WS_CLASS
    stripped = f"regexp_replace({x}, {sql_lit('^' + ws + '+|' + ws + '+$')}, '', 'g')"
    return f"(CASE WHEN {stripped} = '' THEN 0 ELSE len(regexp_split_to_array({stripped}, {sql_lit(ws + '+')})) END)"


def _score_sql(x: str) -> str:
    net = f"CAST({s_count(f'lower({x})', TX.SENTIMENT_POSITIVE)} - {s_count(f'lower({x})', TX.SENTIMENT_NEGATIVE)} AS DOUBLE)"
    return (f"CASE WHEN {_blank(x)} THEN 0.0 ELSE least(greatest({net} / CAST(greatest({_wc_sql(x)}, 10) AS DOUBLE) * 5.0, -1.0), 1.0) END")


@register("keyword_sentiment_score", asql(f"SELECT doc_id, {_wc_sql('content')} AS n_words, {_score_sql('content')} AS sentiment_score FROM articles"))
def q_sent_score(spark, d):
    a = articles(spark, d)
    return round_doubles(a.select("doc_id", TX.word_count(F.col("content")).alias("n_words"),
                                  TX.sentiment_score(F.col("content")).alias("sentiment_score")), DIGITS)


FNE_SQL = "coalesce(nullif(content, ''), nullif(description, ''), nullif(title, ''), '')"


@register("first_non_empty", asql(f"SELECT doc_id, md5({FNE_SQL}) AS body_md5, length({FNE_SQL}) AS body_len FROM articles"))
def q_fne(spark, d):
    a = articles(spark, d)
    b = TX.first_non_empty(F.col("content"), F.col("description"), F.col("title"))
    return a.select("doc_id", F.md5(b).alias("body_md5"), F.length(b).alias("body_len"))


def _risk_sql(x: str) -> str:
    pos, neg = s_count(f"lower({x})", TX.RISK_POSITIVE), s_count(f"lower({x})", TX.RISK_NEGATIVE)
    return f"""CASE WHEN {x} = '' THEN 'neutral' WHEN {pos} > {neg} THEN 'positive' WHEN {neg} > {pos} THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN {x} = '' THEN 'No content available for analysis' WHEN {pos} > {neg} THEN 'Positive financial indicators detected'
       WHEN {neg} > {pos} THEN 'Negative financial indicators detected' ELSE 'Mixed or unclear impact indicators' END AS message,
  CAST(CASE WHEN {x} = '' THEN 0.0 ELSE {TX.FALLBACK_CONFIDENCE!r} END AS DOUBLE) AS confidence"""


@register("risk_impact_label", asql(f"SELECT doc_id, {_risk_sql('b')} FROM (SELECT doc_id, {FNE_SQL} AS b FROM articles) a"))
def q_risk_impact(spark, d):
    a = articles(spark, d)
    b = TX.first_non_empty(F.col("content"), F.col("description"), F.col("title"))
    imp, reason, conf = TX.risk_impact(b)
    return a.select("doc_id", imp.alias("label"), reason.alias("message"), conf.alias("confidence"))


@register("enrich_articles", asql(f"""SELECT doc_id, ticker,
  {_label_sql('title')} AS label, {_events_sql('lower(content)', TX.CONTENT_EVENT_PATTERNS)} AS key_events,
  {_score_sql('content')} AS sentiment_score,
  CASE WHEN {s_any(LOW_TD, TX.IMPACT_HIGH_TERMS)} THEN 'high' WHEN {s_any(LOW_TD, TX.IMPACT_MEDIUM_TERMS)} THEN 'medium' ELSE 'low' END AS impact_level,
  true AS nlp_processed FROM articles""", keep=["ticker", "nlp_processed", "key_events"]))
def q_enrich(spark, d):
    from riskloom.operators.textops import enrich_articles
    return round_doubles(enrich_articles(articles(spark, d)), DIGITS)


@register("sentiment_summary", asql(f"""WITH s AS (SELECT ticker, doc_id, {_score_sql('content')} AS sc,
    row_number() OVER (PARTITION BY ticker ORDER BY doc_id DESC) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM articles)
  SELECT ticker, avg(sc) AS average_sentiment, count(*) AS total_articles,
    count(CASE WHEN sc > 0.1 THEN 1 END) AS positive_count, count(CASE WHEN sc < -0.1 THEN 1 END) AS negative_count,
    count(CASE WHEN sc >= -0.1 AND sc <= 0.1 THEN 1 END) AS neutral_count,
    CASE WHEN max(n) < 2 THEN 'neutral'
         WHEN avg(CASE WHEN rn <= 3 THEN sc END) > coalesce(avg(CASE WHEN rn > 3 THEN sc END), avg(CASE WHEN rn <= 3 THEN sc END)) + 0.1 THEN 'improving'
         WHEN avg(CASE WHEN rn <= 3 THEN sc END) < coalesce(avg(CASE WHEN rn > 3 THEN sc END), avg(CASE WHEN rn <= 3 THEN sc END)) - 0.1 THEN 'declining'
         ELSE 'stable' END AS trend
  FROM s GROUP BY ticker""", keep=["ticker"]))
def q_sent_summary(spark, d):
    from riskloom.operators.textops import sentiment_summary
    return round_doubles(sentiment_summary(articles(spark, d)), DIGITS)


@register("impact_text", asql(f"""WITH s AS (SELECT ticker, {_score_sql('content')} AS sc,
    CASE WHEN {s_any(LOW_TD, TX.IMPACT_HIGH_TERMS)} THEN 1 ELSE 0 END AS hi FROM articles)
  SELECT ticker, CASE WHEN sum(hi) > 0 THEN 'Significant credit-relevant events detected. ' || CAST(sum(hi) AS VARCHAR) || ' high-impact news items may affect creditworthiness.'
    WHEN avg(sc) > 0.2 THEN 'Positive news sentiment detected. Overall market confidence appears supportive of credit profile.'
    WHEN avg(sc) < -0.2 THEN 'Negative news sentiment detected. Market concerns may create headwinds for credit quality.'
    ELSE 'Mixed news sentiment with no clear directional impact on credit risk.' END AS message
  FROM s GROUP BY ticker""", keep=["ticker"]))
def q_impact_text(spark, d):
    from riskloom.operators.textops import impact_text
    return impact_text(articles(spark, d))


HL = "lower(coalesce(headlines, ''))"


@register("batch_summary", sql_round(f"""WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
  h AS (SELECT conv_id, string_agg(text, ' | ' ORDER BY rn) FILTER (WHERE rn <= 5 AND text <> '') AS headlines FROM c GROUP BY conv_id)
  SELECT conv_id, coalesce(headlines, '') AS headlines,
    CASE WHEN len({s_matched(HL, TX.SUMMARY_KEYWORDS)}) > 0
         THEN 'Key developments include ' || array_to_string({s_matched(HL, TX.SUMMARY_KEYWORDS)}, ', ') || ' related news.'
         ELSE {sql_lit(TX.SUMMARY_NONE)} END AS summary FROM h""", keep=["headlines", "summary"]))
def q_batch_summary(spark, d):
    from riskloom.operators.textops import batch_summary
    return batch_summary(table(spark, d, "conversations"), "conv_id", "turn", "text")


@register("digest_key", "SELECT doc_id, md5('nlp:sentiment:' || substr(md5(text), 1, 10) || ':') AS cache_key FROM documents")
def q_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", TX.digest_key("sentiment", F.col("text")).alias("cache_key"))


def _strip_sql(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), {sql_lit(TX.WS_CLASS + '+')}, ' ', 'g'))")


@register("strip_tags_squeeze", f"SELECT page_id, md5({_strip_sql('html')}) AS text_md5, length({_strip_sql('html')}) AS text_len FROM pages")
def q_strip(spark, d):
    p = table(spark, d, "pages")
    t = TX.squeeze_ws(TX.strip_tags(F.col("html")))
    return p.select("page_id", F.md5(t).alias("text_md5"), F.length(t).alias("text_len"))
