"""Keyword-based text annotators as JVM-side expressions.

Matching is *substring* containment on the lower-cased whole text (as in the
reference: 'sec' matches 'seconds'); each keyword counts once.  Dictionaries
are bounded literal lists, so every annotator is a fixed number of ``contains``
scans per row inside whole-stage codegen -- no Python UDF.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The reference's keyword dictionaries, in their original order.
RELEVANCE_KEYWORDS = {
    "high_impact": ["earnings", "merger", "acquisition", "ipo", "bankruptcy",
                    "debt restructuring", "chapter 11", "liquidation", "takeover"],
    "medium_impact": ["ceo", "cfo", "management", "leadership", "regulatory",
                      "sec", "fine", "lawsuit", "investigation", "audit"],
    "financial_general": ["revenue", "profit", "loss", "dividend", "stock", "shares",
                          "quarterly", "annual", "forecast", "guidance", "outlook"],
}
RELEVANCE_WEIGHTS = {"high_impact": 3, "medium_impact": 2, "financial_general": 1}
RELEVANCE_MIN = 2

IMPACT_HIGH_TERMS = ["earnings", "merger", "acquisition", "ipo", "bankruptcy",
                     "debt restructuring", "chapter 11", "takeover", "liquidation",
                     "major lawsuit", "sec investigation", "criminal charges"]
IMPACT_MEDIUM_TERMS = ["ceo", "cfo", "management change", "leadership", "regulatory",
                       "fine", "lawsuit", "investigation", "audit", "compliance",
                       "dividend cut", "guidance", "forecast"]

EVENT_PATTERNS = {
    "earnings_announcement": ["earnings", "quarterly results", "q1", "q2", "q3", "q4"],
    "merger_acquisition": ["merger", "acquisition", "takeover", "buyout"],
    "management_change": ["ceo", "cfo", "president", "chairman", "resign", "appoint"],
    "regulatory_action": ["sec", "fda", "regulatory", "investigation", "fine"],
    "financial_restructuring": ["debt", "restructuring", "refinancing", "bankruptcy"],
    "product_launch": ["launch", "unveil", "announce", "release"],
    "legal_issue": ["lawsuit", "litigation", "settlement", "court"],
    "dividend_action": ["dividend", "payout", "yield"],
    "guidance_update": ["guidance", "forecast", "outlook", "expects"],
}
CONTENT_EVENT_PATTERNS = {
    "earnings announcement": ["earnings", "quarterly results", "financial results"],
    "merger": ["merger", "acquisition", "takeover"],
    "management change": ["ceo", "chief executive", "president", "resigns", "appointed"],
    "regulatory action": ["sec", "investigation", "regulatory", "compliance"],
    "debt action": ["debt", "refinancing", "borrowing", "credit facility"],
    "dividend action": ["dividend", "payout", "distribution"],
    "guidance update": ["guidance", "forecast", "outlook", "expects"],
}
SENTIMENT_POSITIVE = ["growth", "profit", "success", "strong", "beat", "exceed",
                      "bullish", "optimistic", "upgrade", "outperform", "buy"]
SENTIMENT_NEGATIVE = ["loss", "decline", "weak", "miss", "disappoint", "bearish",
                      "pessimistic", "downgrade", "underperform", "sell", "crisis"]
RISK_POSITIVE = ["beat", "exceed", "strong", "growth", "profit", "cash flow", "upgrade"]
RISK_NEGATIVE = ["miss", "decline", "loss", "debt", "lawsuit", "investigation", "downgrade"]
SUMMARY_KEYWORDS = ["earnings", "debt", "growth", "loss", "merger", "regulatory"]
SUMMARY_NONE = "General financial news without significant credit risk indicators."
SUMMARY_EMPTY = "No news available for summary."
FALLBACK_CONFIDENCE = 0.6
# ---------------------------------------------------------------------------

# Whitespace as Python's str.split()/strip() see it (rule: str.isspace), so
# word counts agree with the reference on any text.
WHITESPACE_CHARS = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
WS_CLASS = "[" + WHITESPACE_CHARS.replace("\\", "\\\\").replace("]", "\\]") + "]"

# The same class for Spark's regular expressions, and its complement: Unicode's
# White_Space and the four separators.  A property is one test a character; the
# listed class tries its members in turn, about 1 µs a character.
WS = r"[\p{IsWhite_Space}\x1C-\x1F]"
NOT_WS = r"[^\p{IsWhite_Space}\x1C-\x1F]"


def contains(text: Column, kw: str) -> Column:
    return text.contains(kw)


def count_contained(text: Column, words: Sequence[str]) -> Column:
    e = F.lit(0)
    for w in words:
        e = e + contains(text, w).cast("int")
    return e


def matched_list(text: Column, words: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(contains(text, w), F.lit(w)) for w in words]))


def any_contained(text: Column, words: Sequence[str]) -> Column:
    e = F.lit(False)
    for w in words:
        e = e | contains(text, w)
    return e


def lower_or_empty(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def relevance(title: Column, desc: Column, content: Column) -> tuple[Column, Column]:
    """(relevance_score, matched_keywords sorted) over title + description + content."""
    text = F.concat_ws(" ", lower_or_empty(title), lower_or_empty(desc), lower_or_empty(content))
    score = F.lit(0)
    for grp, words in RELEVANCE_KEYWORDS.items():
        score = score + count_contained(text, words) * RELEVANCE_WEIGHTS[grp]
    allw = [w for ws in RELEVANCE_KEYWORDS.values() for w in ws]
    return score, F.array_sort(F.array_distinct(matched_list(text, allw)))


def impact_category(title: Column, desc: Column) -> Column:
    text = F.concat_ws(" ", lower_or_empty(title), lower_or_empty(desc))
    return (F.when(any_contained(text, IMPACT_HIGH_TERMS), "high")
             .when(any_contained(text, IMPACT_MEDIUM_TERMS), "medium").otherwise("low"))


def event_types(text: Column, patterns=EVENT_PATTERNS) -> Column:
    """``text``: a column worked out in a projection before, as the list is
    built by a function that would work it out for every keyword."""
    return F.array_compact(F.array(*[F.when(any_contained(text, ws), F.lit(name)) for name, ws in patterns.items()]))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(NOT_WS), F.lit(True))


def sentiment_label(text: Column) -> Column:
    t = F.lower(text)
    pos, neg = count_contained(t, SENTIMENT_POSITIVE), count_contained(t, SENTIMENT_NEGATIVE)
    return F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral")


def word_count(text: Column) -> Column:
    """len(text.split()) with Python's whitespace rule."""
    return F.regexp_count(text, F.lit(NOT_WS + "+"))


def sentiment_score(text: Column, low: Column | None = None) -> Column:
    """clip(5 · (pos - neg) / max(words, 10), -1, 1); null text → 0.  Blank text
    has no words and no keyword, so it is 0 without a branch: inside one, the
    lower-cased text would be worked out again for every keyword.  ``low``: the
    lower-cased text, where the caller has it."""
    t = F.lower(text) if low is None else low
    net = (count_contained(t, SENTIMENT_POSITIVE) - count_contained(t, SENTIMENT_NEGATIVE)).cast("double")
    s = F.coalesce(net / F.greatest(word_count(text), F.lit(10)).cast("double") * F.lit(5.0), F.lit(0.0))
    return F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def risk_impact(text: Column) -> tuple[Column, Column, Column]:
    """(impact, reasoning, confidence) of the keyword fallback classifier."""
    t = F.lower(text)
    pos, neg = count_contained(t, RISK_POSITIVE), count_contained(t, RISK_NEGATIVE)
    empty = text == ""
    impact = (F.when(empty, "neutral").when(pos > neg, "positive").when(neg > pos, "negative")
               .otherwise("neutral"))
    reason = (F.when(empty, "No content available for analysis")
               .when(pos > neg, "Positive financial indicators detected")
               .when(neg > pos, "Negative financial indicators detected")
               .otherwise("Mixed or unclear impact indicators"))
    conf = F.when(empty, F.lit(0.0)).otherwise(F.lit(FALLBACK_CONFIDENCE))
    return impact, reason, conf


def summary_sentence(joined: Column) -> Column:
    t = F.lower(joined)
    found = matched_list(t, SUMMARY_KEYWORDS)
    return F.when(F.size(found) > 0,
                  F.concat(F.lit("Key developments include "), F.array_join(found, ", "), F.lit(" related news."))
                  ).otherwise(F.lit(SUMMARY_NONE))


def squeeze_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def digest_key(method: str, text: Column) -> Column:
    """md5('nlp:{method}:{md5(text)[:10]}:') -- the cache key layout."""
    return F.md5(F.concat(F.lit(f"nlp:{method}:"), F.substring(F.md5(text), 1, 10), F.lit(":")))


# ------------------------------------------------------------- SQL twins
def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_contains(t: str, kw: str) -> str:
    return f"(strpos({t}, {sql_lit(kw)}) > 0)"


def s_count(t: str, words) -> str:
    return "(" + " + ".join(f"CAST({s_contains(t, w)} AS INTEGER)" for w in words) + ")"


def s_any(t: str, words) -> str:
    return "(" + " OR ".join(s_contains(t, w) for w in words) + ")"


def s_matched(t: str, words) -> str:
    items = ", ".join(f"CASE WHEN {s_contains(t, w)} THEN {sql_lit(w)} END" for w in words)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


SQL_WS_CLASS = WS_CLASS
