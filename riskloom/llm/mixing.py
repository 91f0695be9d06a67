"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put in a fixed random order and cut into blocks; a slot
takes one block.  The target is a fluid: at "level" v source s has had
min(blocks, weight v) blocks, and their sum is the slot.  While no source has
ended that is weight times slot; later the others share its slots in proportion.
Block ``i`` is released at the floor of the slot at which the fluid begins it and
due at the ceiling of the one at which it ends, and each slot takes the
released block that is due first.  At no slot is a source a block or more ahead
of or behind the fluid.  Weights are whole shares of 2^32 and windows are worked
out in whole numbers, so nothing drifts; the rounding of a weight moves a target
by at most slots / 2^33 blocks.

The schedule is worked out in parts of about ``PART`` slots, side by side.  What
is pending at a part's start needs no earlier part: with U(t) the blocks
released before slot t less t, exactly U(t) are pending, at least U(t) - U(a) of
them released at a or later, and beyond that those due last.  So a part needs
its own blocks and one candidate per source.  One task sees the table of
sources (a row each) and that of parts (a count each), and no more.

Rows are numbered without a task that sees a whole source: a hash splits each
source into buckets, buckets are counted, and a row's number is its bucket's
offset plus its place in the bucket.  Everything is DataFrame functions.

Results for special cases: a null source is a source of its own; sources
without a given weight, or with one that is not above zero, get the smallest
share, so that no row is lost; null ids, repeated rows and ties keep one place
each; texts are not read; extra columns, whatever their names, are kept by
``mix`` (``out_col`` names the one that it adds, which must be a new name); an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed, packed_rows, register, shuffle_partitions, table, unpacked

PART = 256           # slots of a part, at least; the number of sources if that is more
SHARES = 1 << 32     # whole shares of all weights
BLOCK_ROWS = 16
BROADCAST_SOURCES = 100_000  # rows of the table of sources that are broadcast; joined by shuffle beyond
RUN = 1 << 14        # blocks that one row of the list of blocks stands for
BUCKET_ROWS = 50_000  # rows of a source that are numbered in one group, about
SEED = 17


def target_weights(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> DataFrame:
    """Weights by size to a power below 1: small sources are raised."""
    return docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.pow(F.count("*"), F.lit(power)).alias("weight"))


def shares(docs: DataFrame, weights: DataFrame, source_col: str, block_rows: int) -> DataFrame:
    """One row per source: number, rows, blocks, whole share ``w``."""
    n = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n_rows"))
    given = weights.groupBy(F.col("source").alias("w_source")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
    n = checkpointed(n.join(given, F.col("source").eqNullSafe(F.col("w_source")), "left").select(
        "source", "n_rows", F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(0.0).alias("weight")))
    total = n.agg(F.sum("weight")).first()[0] or 1.0
    return n.select((F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("sid"), "source", "n_rows",
                    F.ceil(F.col("n_rows") / block_rows).cast("long").alias("blocks"),
                    F.greatest(F.lit(1), F.round(F.col("weight") / total * SHARES)).cast("long").alias("w"))


def _div(a, b):
    return F.call_function("div", a, b)


def windows(sources: DataFrame) -> DataFrame:
    """One row per block (sid, i): ``release`` and ``due``.  With ``ended``
    blocks of the sources that ended before and ``left`` shares of the others,
    the fluid has given a source ``i`` blocks at slot ended + i left / w."""
    by_end = Window.orderBy("end", "sid")
    ends = sources.select("sid", "blocks", "w", (F.col("blocks") / F.col("w")).alias("end")).select(
        "end", F.sum("blocks").over(by_end).alias("ended"),
        (F.sum("w").over(Window.partitionBy()) - F.sum("w").over(by_end)).alias("left"), "w")
    one_row = ends.agg(F.array_sort(F.collect_list(F.struct("end", "ended", "left"))).alias("ends"), F.sum("w").alias("all_w"))
    runs = sources.select("sid", "blocks", "w", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(RUN).cast("long"))).alias("from")).repartition("sid", "from")
    b = runs.crossJoin(F.broadcast(one_row)).select("sid", "w", "ends", "all_w", F.explode(F.sequence(
        F.col("from"), F.least(F.col("from") + RUN, F.col("blocks")) - 1)).alias("i"))
    over = lambda i: F.size(F.filter("ends", lambda x: x["end"] * F.col("w") < i))
    b = b.select("*", over(F.col("i")).alias("n0"), over(F.col("i") + 1).alias("n1"))

    def slot(i, n, more):
        last = F.get("ends", F.col(n) - 1)
        left = F.coalesce(last["left"], F.col("all_w"))
        return F.coalesce(last["ended"], F.lit(0)) + _div(i * left + more, F.col("w"))
    return b.select("sid", "i", slot(F.col("i"), "n0", F.lit(0)).alias("release"),
                    slot(F.col("i") + 1, "n1", F.col("w") - 1).alias("due"))


def schedule(sources: DataFrame) -> DataFrame:
    """The slot of every block: (sid, i, slot, release, due)."""
    spark = sources.sparkSession
    n, n_sources = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    part = max(PART, n_sources)
    tasks = shuffle_partitions(spark)   # few bytes, much work: not to be merged into few tasks
    blocks = checkpointed(windows(sources).withColumn("k", F.expr(f"release div {part}")))
    # U at every release and at the start of every part
    at = blocks.groupBy("k", "release").agg(F.count("*").alias("n"))
    past = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = spark.range(-(-n // part)).withColumnRenamed("id", "k").join(at.groupBy("k").agg(F.sum("n").alias("n")), "k", "left")
    parts = checkpointed(parts.select("k", past(Window.orderBy("k")).alias("before")))
    at = at.withColumn("own", past(Window.partitionBy("k").orderBy("release"))).join(parts, "k").select(
        "release", (F.col("before") + F.col("own") - F.col("release")).alias("u"))
    # candidates for what is pending: blocks whose window spans the start of a part
    job = F.struct("due", "sid", "i", "release")
    spans = blocks.where(f"(due - 1) div {part} > k").select(job.alias("job"), "release", F.explode(
        F.sequence(F.col("k") + 1, F.expr(f"(due - 1) div {part}"))).alias("k"))
    like = spans.groupBy("k", "release").agg(F.collect_list("job").alias("jobs")).join(at, "release")
    like = like.groupBy("k").agg(F.reverse(F.array_sort(F.collect_list(F.struct("release", "u", "jobs")))).alias("like"))
    like = like.join(parts, "k").withColumn("all", F.col("before") - F.col("k") * part).repartition(tasks, "k")

    def drop(acc, more, need):
        seen = F.array_sort(F.concat(acc["seen"], more))
        short = F.greatest(F.lit(0).cast("long"), need - F.size(acc["out"])).cast("int")
        kept = F.size(seen) - short
        return F.struct(F.slice(seen, F.lit(1), kept).alias("seen"),
                        F.concat(acc["out"], F.slice(seen, kept + 1, short)).alias("out"))
    kind = "array<struct<due:bigint,sid:bigint,i:bigint,release:bigint>>"
    none = F.array().cast(kind)
    pending = like.select("k", F.aggregate(
        "like", F.struct(none.alias("seen"), none.alias("out")), lambda acc, x: drop(acc, x["jobs"], F.col("all") - x["u"]),
        lambda acc: drop(acc, none, F.col("all"))["out"]).alias("jobs"))
    own = blocks.groupBy("k").agg(F.collect_list(job).alias("jobs"))
    jobs = checkpointed(parts.select("k").join(own, "k", "left").join(pending.withColumnRenamed("jobs", "old"), "k", "left").select(
        "k", F.concat(F.coalesce("jobs", none), F.coalesce("old", none)).cast(kind).alias("jobs")).repartition(tasks, "k"))

    def slot(acc, x):
        pick = F.array_min(F.filter(acc["jobs"], lambda j: j["release"] <= F.col("k") * part + x))
        return F.transform(F.array(pick), lambda p: F.struct(
            F.filter(acc["jobs"], lambda j: (j["sid"] != p["sid"]) | (j["i"] != p["i"])).alias("jobs"),
            F.concat(acc["out"], F.array(p)).alias("out")))[0]
    order = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(F.lit(part), F.lit(n) - F.col("k") * part) - 1),
                        F.struct(F.col("jobs").alias("jobs"), none.alias("out")), slot)["out"]
    return jobs.select("k", F.posexplode(order).alias("x", "job")).select(
        "job.sid", "job.i", (F.col("k") * part + F.col("x")).alias("slot"), "job.release", "job.due")


def mix(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id",
        block_rows: int = BLOCK_ROWS, seed: int = SEED, out_col: str = "mix_place") -> DataFrame:
    """``docs`` with a struct column ``out_col``: ``rank`` (row of its source),
    ``block``, ``slot``, ``place`` (row of the block), ``release`` and ``due`` in
    slots.  Sorting by slot and place gives the mixture."""
    if out_col in docs.columns:
        raise ValueError(f"the rows have a column {out_col}; give another name for the place")
    src = F.col(f"`{source_col}`")
    weights = target_weights(docs, source_col) if weights is None else weights
    sources = checkpointed(shares(docs, weights, source_col, block_rows))
    n_sources, most = sources.agg(F.count("*"), F.max("n_rows")).first()
    if not n_sources:
        return docs.withColumn(out_col, F.lit(None).cast("struct<rank:bigint,block:bigint,slot:bigint,place:bigint,release:bigint,due:bigint>"))
    buckets = max(64, -(-most // BUCKET_ROWS))
    names = sources.select("sid", F.col("source").alias("own"))
    slots = schedule(sources).join(F.broadcast(names) if n_sources <= BROADCAST_SOURCES else names, "sid")
    hashed = packed_rows(docs, s=src, id=F.col(f"`{id_col}`"), h=F.xxhash64(F.lit(seed), src, F.col(f"`{id_col}`"))).withColumn(
        "b", F.pmod(F.col("h"), F.lit(buckets)))
    before = Window.partitionBy("cs").orderBy("cb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(F.col("s").alias("cs"), F.col("b").alias("cb")).agg(F.count("*").alias("n")).select(
        "cs", "cb", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = hashed.withColumn("r", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "id")) - 1)
    ranked = ranked.join(offsets, F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb")))
    ranked = ranked.withColumn("r", F.col("r") + F.col("offset"))
    ranked = ranked.withColumn("block", F.expr(f"r div {block_rows}"))
    out = ranked.join(slots, F.col("s").eqNullSafe(F.col("own")) & (F.col("block") == F.col("i")))
    place = F.struct(F.col("r").alias("rank"), "block", "slot", F.expr(f"r % {block_rows}").alias("place"), "release", "due")
    return out.select(*unpacked(docs.columns), place.alias(out_col))


@register("op1_mixing")
def q_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_place.*")
