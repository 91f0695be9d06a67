"""Exact range join of embeddings by pivots and the triangle inequality.

Vectors are compared only inside a group (equal label, equal length), as unit
vectors: cosine >= c is a distance of at most r = sqrt(2 - 2c).  Equal vectors
are one representative with a count.  A group of n takes about sqrt(n) / 8 of
its vectors (by hash order) as pivots.  A vector's home is the cell of its
nearest pivot p; it is copied to the cell of q only where a vector of that
cell can be in range: by the triangle inequality its distance from the
bisector of p and q, (d(x,q)^2 - d(x,p)^2) / 2 d(p,q), is at most r.  Cells then
join on their own: each home vector against all of its cell.  Large cells are
cut into blocks, and pairs of blocks join in tasks of bounded size.

A task counts links and returns, for each vector, its number of links and one
link towards the smallest id it is connected to inside the task, so no pairs
are written: a group of copies costs one row per vector.  Components are then
found over these links.

Results for special cases: vectors that are null, zero, or hold null or
non-finite parts, and vectors without a label, link with nothing; null ids are
kept as rows that link with nothing; repeated rows of one id and vector count
as one vector; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import checkpointed, register, table
from riskloom.llm.components import components

COSINE = 0.98
ASSIGN_ROWS = 8_192   # vectors of a group whose cells one task works out, about
BLOCK_ROWS = 4_096    # vectors of a cell on either side of one task, about
SLACK = 1e-6          # widens replication against rounding; links are not affected


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    n = len(arr)
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def usable(rows: DataFrame) -> DataFrame:
    """Rows that can link: id, label and vector there, all parts finite, not
    all zero."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
                      & F.forall("vec", lambda x: F.coalesce(ok(x), F.lit(False)))
                      & F.exists("vec", lambda x: x != 0))


def cells(reps: DataFrame, radius: float) -> DataFrame:
    """(g, cell, home, id, copies, vec): every vector in its home cell and in
    those that its range may reach."""
    sizes = reps.groupBy("g").agg(F.count("*").alias("n"))
    sizes = sizes.select("g", F.ceil(F.sqrt("n") / 8).cast("int").alias("p"),
                         F.ceil(F.col("n") / ASSIGN_ROWS).cast("int").alias("parts"), "n")
    # pivots: the vectors with the smallest hashes; a cheap cut by hash keeps
    # four times as many as needed before they are ordered
    # the hash is of id and length, so it is blind to the values
    hashed = reps.withColumn("h", F.xxhash64("id", F.lit(5)))
    share = F.least(F.lit(1.0), (F.col("p") * 4 + 20) / F.col("n"))
    some = hashed.join(sizes, "g").where((F.col("h") / float(2 ** 64) + 0.5) <= share)
    picked = some.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "id", "vec"))), F.lit(1), F.first("p")).alias("top"))
    pivots = checkpointed(picked.join(sizes, "g").select("g", "parts", F.explode("top").alias("t")).select(
        "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("t.id").alias("id"), F.col("t.vec").alias("vec")))
    dealt = hashed.join(sizes.select("g", "parts"), "g").select(
        "g", F.pmod("h", F.col("parts")).cast("int").alias("part"), "id", "copies", "vec")
    types = pa.schema([("g", pa.string()), ("cell", pa.int64()), ("home", pa.bool_()), ("id", pa.int64()),
                       ("copies", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def assign(rows: pa.Table, piv: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return types.empty_table()
        piv = piv.sort_by("id")
        x, p = _unit(_matrix(rows["vec"])), _unit(_matrix(piv["vec"]))
        if len(p) == 0:
            raise ValueError("a group without pivots")
        d2 = np.maximum(2 - 2 * (x @ p.T), 0)
        home = d2.argmin(axis=1)
        between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[home]
        margin = d2 - d2[np.arange(len(x)), home][:, None]
        near = margin <= 2 * (radius + SLACK) * between + SLACK
        near[np.arange(len(x)), home] = True
        at, cell = np.nonzero(near)
        at_arr = pa.array(at)
        pid = piv["id"].to_numpy()
        return pa.table([rows["g"].take(at_arr), pa.array(pid[cell]), pa.array(home[at] == cell), rows["id"].take(at_arr),
                         rows["copies"].take(at_arr), rows["vec"].take(at_arr)], schema=types)
    pivots = pivots.select(F.col("g").alias("of"), F.col("part").alias("of_part"), F.col("id").alias("id"),
                           F.col("vec").alias("vec"))
    return dealt.groupBy("g", "part").cogroup(pivots.groupBy("of", "of_part")).applyInArrow(
        assign, "g string, cell long, home boolean, id long, copies long, vec array<double>")


def _links(a: pa.Table, b: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of a among b (copies counted), and for all nodes of
    both the smallest id connected inside the task."""
    ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
    near = (_unit(_matrix(a["vec"])) @ _unit(_matrix(b["vec"])).T) >= cosine
    near &= ia[:, None] != ib[None, :]
    n = near @ b["copies"].to_numpy().astype(np.float64)
    left, right = np.nonzero(near)
    ids, place = np.unique(np.concatenate([ia, ib]), return_inverse=True)
    u, v = place[left], place[len(ia) + right]
    low = np.arange(len(ids))
    while len(u):
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return n.astype(np.int64), ids, ids[low]


def range_links(placed: DataFrame, cosine: float) -> DataFrame:
    """(id, links, low) rows of all tasks: links to count, and a smaller id to
    which a vector is connected."""
    sizes = placed.groupBy("g", "cell").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home"))
    sizes = sizes.select("g", "cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("cols"),
                         F.ceil(F.col("n_home") / BLOCK_ROWS).cast("int").alias("rows")).where("rows > 0")
    x = placed.join(sizes, ["g", "cell"]).withColumn("h", F.xxhash64("id"))
    key = ["g", "cell", "r", "c"]
    a = x.where("home").withColumn("r", F.pmod("h", "rows").cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).select(*key, "id", "copies", "vec")
    b = x.withColumn("c", F.pmod("h", "cols").cast("int")).withColumn(
        "r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(
        *[F.col(k).alias(f"{k}2") for k in key], *[F.col(k).alias(k) for k in ("id", "copies", "vec")])
    types = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        n, ids, low = _links(left, right, cosine)
        ia = left["id"].to_numpy()
        moved = ids != low
        return pa.table([pa.array(np.concatenate([ia, ids[moved]])),
                         pa.array(np.concatenate([n, np.zeros(moved.sum(), np.int64)])),
                         pa.array(np.concatenate([ia, low[moved]]))], schema=types)
    return a.groupBy(*key).cogroup(b.groupBy(*[f"{k}2" for k in key])).applyInArrow(join, "id long, links long, low long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """One row per id: ``n_links``, ``component_id``, ``kept``."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("vec"),
                          F.col(f"`{label_col}`").cast("string").alias("label"))
    good = usable(rows).select("vec_id", "vec", F.to_json(F.struct("label", F.size("vec").alias("n"))).alias("g")).distinct()
    same = good.groupBy("g", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    same = checkpointed(same)
    member = checkpointed(good.join(same, ["g", "vec"]).select("vec_id", "id", "copies"))
    found = checkpointed(range_links(checkpointed(cells(same, float(np.sqrt(2 - 2 * cosine)))), cosine))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).union(
        member.select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    each = member.join(links, "id", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    each = each.groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    ids = rows.select("vec_id").distinct()
    out = ids.join(each, "vec_id", "left").join(comp, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


COMPONENTS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
      WHERE list_sum(list_transform(e, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach(vec_id, low) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, reach.low FROM reach JOIN l ON l.a = reach.vec_id WHERE reach.low < l.b),
c AS (SELECT vec_id, min(low) AS component_id FROM reach GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN k ON k.a = c.vec_id"""


@register("op7_metric_join", COMPONENTS_SQL)
def q_metric_join(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
