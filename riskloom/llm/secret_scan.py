r"""Secret scan with corpus-wide ownership of candidates.

Everything is DataFrame functions.  Base spans are the leftmost
non-overlapping matches of three kinds: assignments (``token = "..."``), access
keys (``AKIA...``) and long hex strings.  Offsets come from the lengths of the
matches and of the texts between them.

Every base value, and every other long mixed string of letters and digits, is
a candidate.  Candidates are hashed and counted over the corpus by distinct
repositories and owners.  One boundary parts them: a value of ``EXAMPLE_OWNERS``
owners, or of ``EXAMPLE_REPOS`` repositories (also of one owner), is a copied
example; any other looks like a live credential of its owner.  Live strings
outside of base spans become spans of kind ``live``.

A value copied into a third of all rows is counted by partial sums; joining
the counts back is a sort-merge join that Spark splits where it is skewed.

Results for special cases: null or empty text has no spans; a null owner or
repository counts as one of its own; repeated rows give repeated rows, and rows
that share an id but not the text are told apart by a hash of the text; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed, packed_rows, register, table, unpacked

# Kind, pattern, group that holds the value, least length of value.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
]
LIVE = "live"
ORDER = [k for k, *_ in KINDS] + [LIVE]
# Other candidates: long runs of letters, digits and the signs of base64 that
# hold a capital, a small letter and a digit, and at least ten characters that
# differ (a repeated filler is no secret).
OTHER = r"([A-Za-z0-9+/_=-]{20,})"
DISTINCT_CHARS = 10
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 4
MASK = "<secret>"

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, rank, end, kind, value) of a pattern in code points."""
    rank = ORDER.index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    # (length before, length of match, value) in turn; starts are running sums
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(gaps) - 1).alias("gap"), whole.alias("whole"),
                         value.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), _empty().alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
                        x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(steps, zero, step)["out"]).otherwise(_empty())


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document: key columns, ``base`` spans and ``other``
    candidates outside of them."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"),
                    F.to_json(F.struct(F.col(f"`{owner_col}`").alias("o"))).alias("owner"),
                    F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(repo_cols)])).alias("repo"))
    found = [matches(F.col("text"), *k) for k in KINDS]
    other = F.filter(matches(F.col("text"), LIVE, OTHER, 1, 20), lambda s:
                     s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
                     & (F.size(F.array_distinct(F.split(s["value"], ""))) >= DISTINCT_CHARS))
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"), "owner", "repo",
                 F.concat(*found).alias("base"), other.alias("other"))
    return d.withColumn("other", F.filter("other", lambda s: ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a candidate value: documents, distinct repositories and
    distinct owners that hold it."""
    each = found.select("owner", "repo", F.explode(F.concat("base", "other")).alias("s")).select(
        F.sha2(F.col("s.value"), 256).alias("value_hash"), "owner", "repo")
    per_repo = each.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    per_owner = per_repo.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return per_owner.groupBy("value_hash").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"),
                                               F.count("*").alias("n_owners"))


def secret_spans(docs: DataFrame, live_owners: int = EXAMPLE_OWNERS - 1, live_repos: int = EXAMPLE_REPOS - 1,
                 **cols) -> DataFrame:
    """One row per document: ``base`` and ``live`` spans in order, and how many
    of its candidates are ``n_live`` or ``n_example`` by ownership."""
    found = checkpointed(candidates(docs, **cols))
    some = found.where(F.size("base") + F.size("other") > 0).select("doc_id", "text_hash", "base", "other").distinct()
    each = some.select("doc_id", "text_hash", F.explode(F.concat("base", "other")).alias("s")).withColumn(
        "value_hash", F.sha2(F.col("s.value"), 256))
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos)
    judged = each.join(ownership(found), "value_hash").groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_list(F.when((F.col("s.kind") != LIVE) | live, F.col("s")))).alias("spans"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"))
    judged = judged.withColumnsRenamed({"doc_id": "j_id", "text_hash": "j_hash"})
    return found.select("doc_id", "text_hash").join(
        judged, F.col("doc_id").eqNullSafe(F.col("j_id")) & (F.col("text_hash") == F.col("j_hash")), "left").select(
        "doc_id", "text_hash", F.coalesce("spans", _empty()).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with every stretch that spans cover replaced by ``mask``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(
            s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))
    done = F.aggregate(spans, zero, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """``docs`` with the spans of every text masked; other columns unchanged."""
    spans = secret_spans(docs, id_col=id_col, text_col=text_col, **cols).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "spans").distinct()
    text = F.col(f"`{text_col}`")
    found = packed_rows(docs, text=text, id=F.col(f"`{id_col}`").cast("long"), hash=F.xxhash64(text)).join(
        spans, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("spans")))
    return found.select(*unpacked(docs.columns, {text_col: clean}))


def oracle() -> str:
    """The same result in DuckDB SQL."""
    q = lambda s: s.replace("'", "''")
    word = "|".join(["".join(f"[{c.upper()}{c}]" for c in w) for w in ("password","passwd","secret","token")] + ["[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
    kinds = [("assign", 0, rf"""(?:{word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
             ("access", 1, r"AKIA[A-Z0-9]+", 0, 20), ("hex", 2, r"[0-9a-f]+", 0, 24), ("live", 3, r"[A-Za-z0-9+/_=-]{20,}", 0, 20)]
    parts = []
    for kind, rank, pat, grp, least in kinds:
        parts.append(f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, i,
      coalesce(list_sum(list_transform(gaps[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[:i - 1], lambda x: length(x))), 0) AS s,
      length(whole[i]) AS n, val[i] AS val FROM (
      SELECT rid, gaps, whole, val, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT rid, regexp_split_to_array(t, '{q(pat)}') AS gaps, regexp_extract_all(t, '{q(pat)}', 0) AS whole,
          regexp_extract_all(t, '{q(pat)}', {grp}) AS val FROM d WHERE regexp_matches(t, '{q(pat)}'))) WHERE length(val[i]) >= {least}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
  f AS ({" UNION ALL ".join(parts)}),
  b AS (SELECT rid, kind, rank, s, s + n AS e, val FROM f WHERE kind <> 'live'),
  o AS (SELECT rid, kind, rank, s, s + n AS e, val FROM f WHERE kind = 'live' AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]')
    AND regexp_matches(val, '[A-Z]') AND len(list_distinct(string_split(val, ''))) >= 10
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = f.rid AND b.s < f.s + f.n AND f.s < b.e)),
  c AS (SELECT * FROM b UNION ALL SELECT * FROM o),
  w AS (SELECT val, count(DISTINCT coalesce('s' || source, 'n')) < {EXAMPLE_OWNERS}
      AND count(DISTINCT {{'s': coalesce('s' || source, 'n'), 'l': coalesce('l' || lang, 'n')}}) < {EXAMPLE_REPOS} AS live
    FROM c JOIN d USING (rid) GROUP BY val),
  j AS (SELECT c.*, live FROM c JOIN w USING (val)),
  g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'live') AS base,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'live' OR live) AS spans,
      count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY rid)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (rid)"""


@register("op9_secret_scan", oracle())
def q_secret_scan(spark, sf_dir):
    out = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != LIVE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k, *_ in KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
                      listed(F.col("spans")).alias("spans"), "n_live", "n_example")
