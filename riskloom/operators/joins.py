"""Joins the reference uses beyond plain equi-joins.

* ``asof_nearest_join`` -- per key, nearest right row by date within a
  tolerance; ties go to the earlier (backward) row (§2.15-A).
* ``longest_substring_join`` -- each name → the longest dictionary entry
  contained in it (an equi-join on the names' substrings).
* ``longest_entry_of_texts`` -- each key → the longest dictionary entry
  contained in a word of its texts, the longest words searched first.
* ``broadcast_small`` -- explicit broadcast only for sides whose size is
  bounded by construction (literal dictionaries, per-column statistics,
  one-row aggregates); everything else is left to AQE's runtime sizing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broadcast_small(df: DataFrame) -> DataFrame:
    """Mark a side whose row count is bounded by construction for broadcast."""
    return F.broadcast(df)


def _day_number(c):
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def asof_nearest_join(left: DataFrame, right: DataFrame, key: str, on: str, tolerance_days: int,
                      right_cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Left rows + the nearest right row of the same ``key`` by ``on`` (a date).

    Candidate B = greatest right date <= left date, F = smallest right date
    >= left date; B wins ties; the match is dropped (NULLs) if its distance
    exceeds ``tolerance_days``.  Right rows must be unique per (key, on).

    Plan: time is cut into buckets of ``tolerance_days``; each right row is
    copied to its bucket and both neighbours, so every candidate within the
    tolerance of a left row is inside the left row's (key, bucket) window
    partition.  One exchange on (key, bucket); a hot key is spread over many
    buckets instead of one task.  Candidates beyond the tolerance may be
    missing from the bucket, but such matches are dropped anyway, and a
    missing far backward candidate can only hide a row that would have lost.
    """
    tol = int(tolerance_days)
    if tol < 1:
        raise ValueError("tolerance_days must be >= 1")
    rcols = list(right_cols)
    lcols = left.columns
    day = "__day"
    L = (left.withColumn(day, _day_number(F.col(on)))
             .withColumn("__bucket", F.floor(F.col(day) / tol))
             .select(F.col(key).alias("__k"), F.col(day), "__bucket", F.lit(1).alias("__side"),
                     F.struct(*[F.col(c) for c in lcols]).alias("__l"),
                     F.lit(None).cast(_struct_type(right, rcols, on)).alias("__r")))
    R = (right.withColumn(day, _day_number(F.col(on)))
              .withColumn("__b0", F.floor(F.col(day) / tol))
              .withColumn("__bucket", F.explode(F.array(F.col("__b0") - 1, F.col("__b0"), F.col("__b0") + 1)))
              .select(F.col(key).alias("__k"), F.col(day), "__bucket", F.lit(0).alias("__side"),
                      F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in lcols])).schema[0].dataType).alias("__l"),
                      F.struct(F.col(day).alias("__rday"), *[F.col(c) for c in rcols]).alias("__r")))
    u = L.unionByName(R)
    part = Window.partitionBy("__k", "__bucket")
    back = part.orderBy(F.col(day).asc(), F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    fwd = part.orderBy(F.col(day).desc(), F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    u = (u.withColumn("__B", F.last("__r", ignorenulls=True).over(back))
          .withColumn("__F", F.last("__r", ignorenulls=True).over(fwd))
          .where(F.col("__side") == 1))
    db = F.col(day) - F.col("__B.__rday")
    df_ = F.col("__F.__rday") - F.col(day)
    pick = (F.when(F.col("__B").isNotNull() & (F.col("__F").isNull() | (db <= df_)), F.col("__B"))
             .otherwise(F.col("__F")))
    u = u.withColumn("__P", pick)
    dist = F.abs(F.col("__P.__rday") - F.col(day))
    keep = F.col("__P").isNotNull() & (dist <= tol)
    out = [F.col(f"__l.{c}").alias(c) for c in lcols]
    out += [F.when(keep, F.col(f"__P.{c}")).alias(f"{prefix}{c}") for c in rcols]
    return u.select(*out)


def _struct_type(right: DataFrame, rcols: Sequence[str], on: str):
    return right.select(F.struct(F.lit(0).alias("__rday"), *[F.col(c) for c in rcols])).schema[0].dataType


_CHUNK = 256
# Names searched by one task; words of a text in the first round;
# keys up to which the second round finds its texts by a broadcast.
NAMES = 25_000
LONGEST = 8
BROADCAST_KEYS = 2_000_000


def longest_substring_join(names: DataFrame, name_col: str, dictionary: DataFrame, entry_col: str,
                           order_col: str, default: str = "_new_col", least_col: str | None = None) -> DataFrame:
    """Each ``name`` → the longest dictionary entry contained in it.

    Ties on length go to the entry first in dictionary order (``order_col``);
    names without a match get ``default``.  ``names`` holds distinct names.
    With ``least_col``, a name's matches have at least that many characters.

    Plan: an equi-join, not a theta join.  Every substring of a name between
    the shortest and the longest entry's length (a one-row aggregate) is
    generated and joined on equality with the entries, so neither side is
    compared with every row of the other; AQE picks broadcast or shuffle by
    measured size.  Substrings are few bytes of input each, so tasks are cut by
    the number of names; they are distinct within a name before the shuffle.
    """
    from riskloom.session import cut_lineage
    d = dictionary.select(F.col(entry_col).alias("__entry"), F.col(order_col).alias("__ord"))
    ends = d.agg(F.max(F.length("__entry")).alias("__maxlen"), F.min(F.length("__entry")).alias("__minlen"))
    # substrings carry a name id, not the name: a long name is not copied
    # into each of its substrings.  Ids are fixed by a reliable checkpoint.
    least = F.lit(1) if least_col is None else F.max(F.col(least_col))
    ids = cut_lineage(names.groupBy(name_col).agg(least.alias("__least")).withColumn("__nid", F.monotonically_increasing_id()))
    n = F.length(F.col(name_col))
    m = F.col("__maxlen")
    low = F.col("__low")
    # All substrings up to the longest entry, built as one array per name so
    # the generator emits (id, substring) rows only.  The name is first cut
    # into chunks starting every _CHUNK characters and _CHUNK + maxlen - 1
    # long: each substring lies in the chunk of its start position, and each
    # substring call walks one chunk, not the whole name.
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(n / F.lit(_CHUNK)).cast("int") - 1),
                         lambda c: F.substring(F.col(name_col), c * _CHUNK + 1, F.lit(_CHUNK) + m - 1))

    def in_chunk(ch):
        k = F.length(ch)
        starts = F.when(k >= low, F.sequence(F.lit(1), F.least(F.lit(_CHUNK), k - low + 1))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(
            starts, lambda st: F.transform(F.sequence(low, F.least(k - st + 1, m)), lambda ln: F.substring(ch, st, ln))))

    every = F.array_distinct(F.flatten(F.transform(chunks, in_chunk)))
    tasks = max(ids.sparkSession.sparkContext.defaultParallelism, -(-ids.count() // NAMES))
    subs = (ids.repartition(tasks).crossJoin(F.broadcast(ends))  # one row
               .withColumn("__low", F.greatest(F.col("__least"), F.col("__minlen"), F.lit(1)))
               .where((n >= low) & (m >= low))
               .select("__nid", F.explode(every).alias("__entry")))
    cand = subs.join(d, "__entry")
    w = Window.partitionBy("__nid").orderBy(F.length("__entry").desc(), F.col("__ord").asc())
    best = (cand.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
                .select("__nid", F.col("__entry").alias("matched")))
    named = ids.join(best, "__nid", "left").select(name_col, "matched")
    return (names.join(named, name_col, "left")
                 .withColumn("matched", F.coalesce(F.col("matched"), F.lit(default))))


def longest_entry_of_texts(texts: DataFrame, key: str, words_of: Column, dictionary: DataFrame, entry_col: str) -> DataFrame:
    """(key, matched): the longest entry contained in a word of the key's texts
    (ties: alphabetical); keys without a match have no row.  ``words_of`` gives
    the words of a row of ``texts``.

    An entry is no longer than the word it lies in, so words are searched
    longest first: of every text those as long as its ``LONGEST``-th longest
    word, then, only where the match so far is shorter than that, the others
    that are at least as long as the match.  What is shuffled are these words;
    each distinct one is searched once.
    """
    from riskloom.session import cut_lineage
    d = cut_lineage(dictionary.select(F.col(entry_col).alias("entry")).distinct())
    size = F.transform("__words", lambda x: F.length(x))
    held = texts.where(F.col(key).isNotNull())

    def split(df: DataFrame) -> DataFrame:
        """The words of every row and the length down to which the first round takes them."""
        df = df.withColumn("__words", F.array_distinct(words_of))
        return df.withColumn("__from", F.coalesce(F.get(F.sort_array(size, asc=False), F.lit(LONGEST - 1)), F.lit(0)))

    def best(own: DataFrame, names: DataFrame, *more, least: str | None = None) -> DataFrame:
        found = longest_substring_join(names, "word", d.withColumn("ord", F.col("entry")), "entry", "ord", default="", least_col=least)
        n = F.when(F.col("matched") != "", -F.length("matched"))
        return own.join(found.select("word", "matched"), "word").groupBy(key).agg(
            F.min(F.when(n.isNotNull(), F.struct(n.alias("shorter"), "matched"))).alias("best"), *more)

    first = split(held).select(key, "__from", F.explode(F.filter("__words", lambda x: F.length(x) >= F.col("__from"))).alias("word"))
    first = cut_lineage(first)
    one = cut_lineage(best(first, first.select("word").distinct(), F.max("__from").alias("__from")))
    so_far = F.coalesce(-F.col("best.shorter"), F.lit(1))
    open_ = cut_lineage(one.where(so_far < F.col("__from")).select(key, so_far.alias("__least")))
    again = held.join(F.broadcast(open_) if open_.count() <= BROADCAST_KEYS else open_, key)
    rest = split(again).select(key, "__least", F.explode(F.filter("__words", lambda x: (F.length(x) < F.col("__from")) & (
        F.length(x) >= F.col("__least")))).alias("word"))
    rest = cut_lineage(rest)
    two = best(rest, rest.groupBy("word").agg(F.min("__least").alias("__least")), least="__least")
    both = one.select(key, "best").unionByName(two).groupBy(key).agg(F.min("best").alias("best"))
    return both.where(F.col("best").isNotNull()).select(key, F.col("best.matched").alias("matched"))
