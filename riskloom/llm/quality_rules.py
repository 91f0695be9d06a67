r"""Quality rules: base counts, then robust multivariate outliers.

Everything is DataFrame functions.  Base counts follow words ``[^\x20\x09-\x0D]+``:
characters in words, symbols ``[#*$%&|<>]``, repeated lines, and words inside
8-word windows that occur twice or more.  A document fails the base rules with
fewer than 20 words, or when more than 30 % of its words are in repeated
windows.

The others are judged by a minimum-covariance-determinant estimate per
language and source.  Each document is a vector of transformed statistics;
each group starts from medians and absolute deviations, then takes C-steps:
keep the three quarters nearest to the centre, estimate mean and covariance on
them, measure all again.  A last estimate on the rows inside the 97.5 % region
gives the Mahalanobis distance on which a document is rejected.  A floor on
each statistic's spread keeps groups in which it never varies from rejecting
its first small change.  Groups below ``MIN_GROUP`` documents are judged
together with the other small ones of their language, then of all languages;
what is still too small is kept.

Floors are set so that each statistic alone can reject: in a group that has
none, 28 % of words in repeated windows (the base rules end at 30 %) or 70 % of
repeated lines lie beyond ``REJECT``, and a few repeated lines do not.

A group's rows never meet in one task: medians and cut-offs are mergeable
approximate quantiles, moments are partial sums, and only one row per group is
written between the steps.  That row is brought to the group's documents by a
broadcast where the counted groups are at most ``BROADCAST_GROUPS``, and by a
join on group and salt beyond.

Results for special cases: null or empty text has no words and fails the base
rules; null language or source are groups of their own; repeated rows give
repeated rows; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE, checkpointed, packed_rows, register, table, unpacked

MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 20, 8, 30
MIN_GROUP = 50
KEEP = 0.75          # share of a group's rows on which a C-step estimates
STEPS = 3
CONSISTENCY = 1.49   # makes the covariance of the nearest three quarters that of all, 4 normal statistics
INSIDE = 11.143      # 97.5 % of chi-square, 4 degrees of freedom
REJECT = 30.0        # squared distance; beyond 99.999 % of chi-square
QUANTILE_ACCURACY = 10_000
BROADCAST_GROUPS = 100_000  # rows of at most 15 numbers
SALTS = 64

# Statistic and floor of its spread.
STATS = {
    "s_symbols": ("sqrt(n_symbols / word_chars)", 0.05),
    "s_length": ("ln(word_chars / n_words)", 0.05),
    "s_lines": ("sqrt(n_dup_lines / n_lines)", 0.15),
    "s_repeat": ("sqrt(n_repeat_words / n_words)", 0.095),
}


def let(value, body):
    """``body(value)`` with ``value`` worked out once, also where the body uses
    it inside lambdas (a column named there would be inlined by the optimizer
    and worked out again for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words):
    """Number of words in windows of ``WINDOW`` words that occur twice."""
    def places(words, n):
        return F.sequence(F.lit(1), n - (WINDOW - 1))

    def covered(at):
        # starts in order: each covers up to the next one, at most a window
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))),
                           F.lit(0), lambda a, x: a + x)

    def exact(words):
        windows = F.array_sort(F.transform(places(words, F.size(words)), lambda i: F.struct(
            F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i"))))
        same = lambda all_, x, k: F.coalesce(F.get(all_, k)["w"] == x["w"], F.lit(False))
        return let(windows, lambda all_: let(F.array_sort(F.transform(F.filter(
            all_, lambda x, k: same(all_, x, k - 1) | same(all_, x, k + 1)), lambda x: x["i"])), covered))

    # Most texts have no window twice: equal windows have equal hashes, so a
    # text without an equal pair of hashes needs no comparison of words.
    def hashes(words):
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda codes: F.transform(
            places(words, F.size(words)), lambda i: F.xxhash64(F.slice(codes, i, WINDOW))))
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(words, lambda w: F.when(
        let(hashes(w), lambda h: F.size(h) > F.size(F.array_distinct(h))), exact(w)).otherwise(0)))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the base counts to rows of (doc_id, text, ...) and drops the text."""
    keep = [c for c in docs.columns if c != "text"]

    def of_words(words):
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        repeat_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    words = F.array_remove(F.split("text", f"{SPACE}+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    d = docs.select(*keep, F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    let(words, of_words).alias("w"), let(lines, of_lines).alias("l"))
    d = d.select(*keep, "n_symbols", "w.*", "l.*")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def with_group(rows: DataFrame, side: DataFrame, key: str, n_groups: int, how: str = "inner") -> DataFrame:
    """``rows`` with the one row per group of ``side``, without bringing a
    group's rows together."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(side), key, how)
    spread = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(
        spread, [key, "salt"], how).drop("salt")


def grouped(rows: DataFrame, group_cols: list[str], min_group: int) -> DataFrame:
    """Rows with ``g``, the group each is judged in: its own, or the pool of
    small groups of its first group column, or the pool of all small ones;
    null where even that is too small."""
    key = lambda cols: F.to_json(F.struct(F.lit(len(cols)).alias("level"), *cols))
    out = rows.withColumn("g", F.lit(None).cast("string"))
    for cols in (group_cols, group_cols[:1], []):
        name = F.when(F.col("g").isNull(), key(cols))
        sizes = checkpointed(out.select(name.alias("k")).where("k IS NOT NULL").groupBy("k").count()
                             .where(F.col("count") >= min_group).select("k", F.lit(True).alias("big")))
        out = with_group(out.withColumn("k", name), sizes, "k", sizes.count(), "left").withColumn(
            "g", F.when(F.col("big"), F.col("k")).otherwise(F.col("g"))).drop("k", "big")
    return out


def _distance(stats: list[str]):
    """Squared Mahalanobis distance by forward substitution: columns m_i hold
    the centre, l_i_j the Cholesky factor of the covariance."""
    z = []
    for i, s in enumerate(stats):
        rest = reduce(lambda a, j: a - F.col(f"l_{i}_{j}") * z[j], range(i), F.col(s) - F.col(f"m_{i}"))
        z.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _estimate(rows: DataFrame, stats: dict, factor: float) -> DataFrame:
    """Centre and Cholesky factor per group of ``rows``."""
    names, floors = list(stats), [f for _, f in stats.values()]
    p = len(names)
    out = rows.groupBy("g").agg(
        *[F.avg(s).alias(f"m_{i}") for i, s in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)])
    for i in range(p):
        for j in range(i + 1):
            c = F.col(f"c_{i}_{j}") * factor + (floors[i] ** 2 if i == j else 0.0)
            c = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), c)
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(floors[i] ** 2 * 1e-6))) if i == j
                                 else c / F.col(f"l_{j}_{j}"))
    return checkpointed(out.select("g", *[f"m_{i}" for i in range(p)],
                                   *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)]))


def robust_distance(rows: DataFrame, stats: dict, steps: int = STEPS) -> DataFrame:
    """``rows`` (with group ``g`` and the statistics) with ``d2``."""
    names, p = list(stats), len(stats)
    judged = rows.where("g IS NOT NULL").select("g", *names)
    q = lambda c, at: F.percentile_approx(c, at, QUANTILE_ACCURACY)
    mid = checkpointed(judged.groupBy("g").agg(*[q(s, 0.5).alias(f"m_{i}") for i, s in enumerate(names)]))
    n = mid.count()
    mad = with_group(judged, mid, "g", n).groupBy("g").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)],
        *[(q(F.abs(F.col(s) - F.col(f"m_{i}")), 0.5) * 1.4826).alias(f"d_{i}") for i, s in enumerate(names)])
    now = checkpointed(mad.select("g", *[f"m_{i}" for i in range(p)], *[
        (F.greatest(f"d_{i}", F.lit(stats[names[i]][1])) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}")
        for i in range(p) for j in range(i + 1)]))
    for _ in range(steps):
        far = with_group(judged, now, "g", n).select("g", *names, _distance(names).alias("d2"))
        cut = far.groupBy("g").agg(q("d2", KEEP).alias("cut"))
        now = _estimate(with_group(far, cut, "g", n).where("d2 <= cut"), stats, CONSISTENCY)
    near = with_group(judged, now, "g", n).select("g", *names, _distance(names).alias("d2")).where(F.col("d2") <= INSIDE)
    now = _estimate(near, stats, 1.0)
    return with_group(rows, now, "g", n, "left").withColumn("d2", _distance(names)).drop(*[c for c in now.columns if c != "g"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", min_group: int = MIN_GROUP, reject: float = REJECT) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``d2`` (null where
    not judged) and ``kept``."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"))
    counts = checkpointed(base_counts(rows))
    good = counts.where(~F.col("base_failed")).select("*", *[F.expr(e).alias(n) for n, (e, _) in STATS.items()])
    judged = robust_distance(checkpointed(grouped(good, ["lang", "source"], min_group)), STATS)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = counts.where("base_failed").select(*out, F.lit(None).cast("double").alias("d2"))
    return judged.select(*out, "d2").unionByName(failed).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= reject))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that the rules keep.  Rejected rows are named by id
    and text, so a row that shares an id with one of them stays."""
    name = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    gone = quality_rules(docs.withColumn(id_col, name), id_col, text_col, **kw).where(~F.col("kept")).select(
        F.col("doc_id").alias("gone")).distinct()
    kept = packed_rows(docs, name=name).join(gone, F.col("name") == F.col("gone"), "left_anti")
    return kept.select(*unpacked(docs.columns))


@register("op6_quality_rules")
def q_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))
