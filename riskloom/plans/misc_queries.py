"""Selection bookkeeping, remaining joins and string helpers (§2.3, §2.4, §2.5, §2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import selection as SE
from riskloom.operators import stats as ST
from riskloom.plans import stats_queries as SQ
from riskloom.plans.alerts_queries import ALERT_SQL, STREAM_SQL
from riskloom.plans.explain_queries import ct_sql
from riskloom.plans.common import register, round_doubles, sql_round, with_cte
from riskloom.plans.sets_queries import s_bucket
from riskloom.sources.tables import table

DIGITS = 6
K_VOTE = 4


def selector_scores(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    f = SQ.feats(spark, d)
    pear = ST.target_correlation(f, SQ.FEATS, "y").select("feature", F.coalesce("abs_corr", F.lit(0.0)).alias("score"))
    m = ST.scale(f, SQ.FEATS, "minmax")
    chi = ST.chi2_scores(m, SQ.FEATS, "label").select("feature", F.col("chi2").alias("score"))
    q = ST.feature_quality(f, SQ.FEATS, "y").select("feature", F.col("data_quality_score").alias("score"))
    return {"pearson": pear, "chi2": chi, "quality": q}


SCORES_SQL = f"""mm AS ({SQ.scaled_sql('minmax')}),
  sc AS (SELECT 'pearson' AS model, feature, coalesce(abs_corr, 0.0) AS score FROM ({SQ.TC_SQL}) a
         UNION ALL SELECT 'chi2', feature, chi2 FROM ({SQ.CHI_SQL}) b
         UNION ALL SELECT 'quality', feature, data_quality_score FROM ({SQ._fq_sql()}) c),
  rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC NULLS LAST, feature) AS rank FROM sc)"""


def selsql(body: str, keep=()) -> str:
    return SQ.fsql(with_cte(SCORES_SQL, body), keep=keep)


@register("vote_count", selsql(f"""SELECT feature,
  coalesce(max(CASE WHEN model = 'pearson' THEN rank <= {K_VOTE} END), false) AS pearson,
  coalesce(max(CASE WHEN model = 'chi2' THEN rank <= {K_VOTE} END), false) AS chi2,
  coalesce(max(CASE WHEN model = 'quality' THEN rank <= {K_VOTE} END), false) AS quality,
  sum(CAST(rank <= {K_VOTE} AS INTEGER)) AS total FROM rk GROUP BY feature""", keep=["pearson", "chi2", "quality"]))
def q_vote(spark, d):
    return SE.vote_table(selector_scores(spark, d), K_VOTE)


MEAN_SQL = "SELECT feature, avg(score) AS mean_importance, avg(rank) AS mean_rank FROM rk GROUP BY feature"


@register("mean_rank_by_feature", selsql(MEAN_SQL))
def q_mean_rank(spark, d):
    return round_doubles(SE.mean_rank_by_feature(selector_scores(spark, d)), DIGITS)


@register("rank_features", selsql(f"""SELECT *, row_number() OVER (ORDER BY mean_importance DESC, feature) - 1 AS position
  FROM ({MEAN_SQL}) m"""))
def q_rank_features(spark, d):
    return round_doubles(SE.rank_features(SE.mean_rank_by_feature(selector_scores(spark, d))), DIGITS)


N_FOLDS = 2


def fold_importance(spark, d) -> DataFrame:
    from riskloom.operators.sampling import kfold
    f = kfold(SQ.feats(spark, d), "vec_id", N_FOLDS, 1001)
    rows = None
    for k in range(N_FOLDS):
        tc = ST.target_correlation(f.where(F.col("fold") == k), SQ.FEATS, "y")
        t = tc.select(F.lit(k).alias("fold"), "feature", F.coalesce("abs_corr", F.lit(0.0)).alias("importance"))
        rows = t if rows is None else rows.unionByName(t)
    return rows


FOLD_SQL = "fi AS (" + " UNION ALL ".join(
    f"SELECT {k} AS fold, feature, coalesce(abs_corr, 0.0) AS importance FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({SQ.s_corr(c, 'y')}) AS abs_corr FROM fd WHERE fold = {k}" for c in SQ.FEATS)
    + f") x{k}" for k in range(N_FOLDS)) + ")"
FOLD_FEATS = f"fd AS (SELECT *, CAST(({s_bucket('vec_id', 1001)}) % {N_FOLDS} AS INTEGER) AS fold FROM feats)"


@register("correlation_mean_top40", SQ.fsql(with_cte(f"{FOLD_FEATS}, {FOLD_SQL}", """SELECT feature, avg(importance) AS mean_importance
  FROM fi GROUP BY feature ORDER BY mean_importance DESC, feature LIMIT 40""")))
def q_top40(spark, d):
    fi = fold_importance(spark, d)
    m = fi.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return round_doubles(SE.top_features(m, 40), DIGITS)


@register("semi_join_top_correlated", SQ.fsql(with_cte(f"{FOLD_FEATS}, {FOLD_SQL}", """SELECT * FROM fi WHERE feature IN (
  SELECT feature FROM (SELECT feature, avg(importance) AS m FROM fi GROUP BY feature ORDER BY m DESC, feature LIMIT 3) t)""")))
def q_semi(spark, d):
    fi = fold_importance(spark, d)
    top = SE.top_features(fi.groupBy("feature").agg(F.avg("importance").alias("mean_importance")), 3).select("feature")
    return round_doubles(fi.join(top, "feature", "left_semi"), DIGITS)


# ------------------------------------------------------------------ joins
@register("left_join_on_column", sql_round("""SELECT d.doc_id, d.source, s.n_docs, s.avg_chars FROM documents d
  LEFT JOIN (SELECT source, count(*) AS n_docs, avg(n_chars) AS avg_chars FROM documents GROUP BY source) s USING (source)""",
    digits=DIGITS))
def q_left_text(spark, d):
    doc = table(spark, d, "documents")
    s = doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_chars").alias("avg_chars"))
    return round_doubles(doc.select("doc_id", "source").join(s, "source", "left"), DIGITS)


@register("longest_substring_join", r"""WITH n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS word FROM documents),
  d AS (SELECT DISTINCT w AS entry FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM conversations) x
        WHERE length(w) >= 3),
  p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM (SELECT DISTINCT word FROM n) x),
  s AS (SELECT DISTINCT word, substr(word, i, l) AS entry FROM (SELECT word, i, unnest(range(3, least(
        length(word) - i + 1, (SELECT max(length(entry)) FROM d)) + 1)) AS l FROM p) x),
  c AS (SELECT n.doc_id, d.entry, row_number() OVER (PARTITION BY n.doc_id ORDER BY length(d.entry) DESC, d.entry) AS rn
        FROM n JOIN s USING (word) JOIN d USING (entry))
  SELECT x.doc_id, coalesce(c.entry, '_new_col') AS matched FROM documents x LEFT JOIN c ON c.doc_id = x.doc_id AND c.rn = 1""")
def q_longest(spark, d):
    """Each document → the longest word of the conversation vocabulary that
    its whole text contains (ties: alphabetical).  Entries are runs of letters,
    so one that a text contains lies inside one of its runs: runs are searched
    longest first, each distinct one once, and a document takes the best of its
    own."""
    from riskloom.operators.joins import longest_entry_of_texts
    from riskloom.sources.tables import table
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    docs = table(spark, d, "documents")
    entries = table(spark, d, "conversations").select(F.explode(runs).alias("entry")).where(F.length("entry") >= 3)
    best = longest_entry_of_texts(docs.select("doc_id", "text"), "doc_id", runs, entries, "entry")
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("matched", F.lit("_new_col")).alias("matched"))


@register("rule_metric_join", None)
def q_rule_metric(spark, d):
    from riskloom.operators.alerts import rule_matches
    from riskloom.plans.alerts_queries import conditions, rules
    r = rules(spark, d)
    c = conditions(spark, d)
    m = F.create_map(*[x for f in ("score", "volatility", "price_change", "volume") for x in (F.lit(f), F.col(f).cast("double"))])
    j = r.join(c.select("ticker", m.alias("__v")), "ticker")
    v = F.element_at(F.col("__v"), F.col("condition_field"))
    return round_doubles(j.select("ticker", "rule_id", "condition_field", "condition", "threshold", v.alias("current_value"),
                                  rule_matches(v, F.col("condition"), F.col("threshold")).alias("triggered")), DIGITS)


def _rule_metric_sql():
    from riskloom.plans.alerts_queries import COND_SQL, RULES_SQL
    from riskloom.plans.common import ORACLE
    from riskloom.sources.panel import with_panel_views
    ORACLE["rule_metric_join"] = with_panel_views(sql_round(f"""WITH c AS ({COND_SQL}), rl AS ({RULES_SQL}),
      j AS (SELECT rl.*, CASE condition_field WHEN 'score' THEN c.score WHEN 'volatility' THEN c.volatility
              WHEN 'price_change' THEN c.price_change WHEN 'volume' THEN c.volume END AS current_value FROM rl JOIN c ON rl.ticker = c.ticker)
      SELECT ticker, rule_id, condition_field, condition, threshold, current_value,
        coalesce(current_value IS NOT NULL AND ((condition = 'less_than' AND current_value < threshold)
          OR (condition = 'greater_than' AND current_value > threshold) OR (condition = 'equals' AND abs(current_value - threshold) < 0.01)), false)
        AS triggered FROM j""", keep=["triggered"], digits=DIGITS), "ticks")


_rule_metric_sql()


# ------------------------------------------------------------------ string helpers
@register("parse_dates", sql_round("""SELECT event_id, iso_ts, CAST(iso_ts AS TIMESTAMP) AS ts_back FROM (SELECT event_id, CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso_ts FROM events) x""", keep=["iso_ts", "ts_back"], digits=DIGITS))
def q_parse_dates(spark, d):
    from riskloom.functions.dates import iso_format, parse_iso
    e = table(spark, d, "events").select("event_id", iso_format(F.col("ts")).alias("iso_ts"))
    return e.withColumn("ts_back", parse_iso(F.col("iso_ts")))


@register("frame_to_records", sql_round(f"""SELECT SK_ID_CURR, ['balance_k', 'n_orders', 'price_ratio', 'nation_scaled'] AS feature_names,
  [1, 4] AS shape, balance_k, n_orders, price_ratio, nation_scaled FROM ({ct_sql()}) ct""",
    keep=["feature_names", "shape"], digits=DIGITS))
def q_records(spark, d):
    from riskloom.functions.records import from_split_json, to_split_json
    from riskloom.plans.explain_queries import client_table
    feats = ["balance_k", "n_orders", "price_ratio", "nation_scaled"]
    ct = client_table(spark, d)
    j = to_split_json(ct, "SK_ID_CURR", feats)
    back = from_split_json(j, "SK_ID_CURR", "json", feats)
    return round_doubles(back, DIGITS)


@register("flag_from_text", """SELECT doc_id, CAST(quality AS VARCHAR) AS text, coalesce(lower(trim(CAST(quality AS VARCHAR)))
  IN ('true', '1', 't', 'y'), false) AS flag FROM labels""")
def q_flag(spark, d):
    from riskloom.operators.rules import flag_from_text
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("text"))
    return lab.withColumn("flag", flag_from_text("text"))


@register("template_message", sql_round(f"""WITH s AS ({STREAM_SQL}),
  t AS ({ALERT_SQL.replace('FROM stream', 'FROM s')})
  SELECT id, event_id, 'ID ' || CAST(id AS VARCHAR) || ': ' || direction || ' by ' || printf('%+.3f', round(delta * 1000) / 1000 + 0.0)
    || ' at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS message FROM t""", digits=DIGITS))
def q_template(spark, d):
    from riskloom.operators.alerts import change_alerts, score_trend
    from riskloom.plans.alerts_queries import ORDER, stream
    from riskloom.plans.common import round_half_away
    a = change_alerts(score_trend(stream(spark, d), "id", ORDER, "score"))
    msg = F.concat(F.lit("ID "), F.col("id").cast("string"), F.lit(": "), F.col("direction"), F.lit(" by "),
                   F.format_string("%+.3f", round_half_away(F.col("delta"), 3)), F.lit(" at "),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return a.select("id", "event_id", msg.alias("message"))
