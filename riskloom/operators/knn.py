"""k-nearest-neighbour imputation within groups.

Semantics (nan-euclidean KNN imputation, uniform weights):

* distance between rows x, y = sqrt(p / m * sum over the m features present in
  both of (x_i - y_i)^2), p = number of features; undefined when m = 0;
* a NULL in column c of row r is replaced by the mean of c over the k rows of
  the same group that have c and the smallest defined distance to r (ties by
  the row id); if no such row exists, by the group mean of c;
* groups with ``min_rows`` rows or fewer are left as they are.

Plan: no group is ever gathered into one task, and block pairs that cannot hold
a neighbour are never scored.

1. Rows are written once, in blocks of at most ``block_rows`` rows of a group
   that are near each other on the column with the most values.  Every block has
   a box: least and largest value, and numbers of values, per column.
2. Each block scores its own rows, which gives each missing value a kth distance
   that its neighbours cannot exceed.
3. Two blocks have a lower bound on the distance of any of their rows: columns
   present in all rows of both add the squared gap of their intervals, over the
   largest number of columns that two rows can share.  A pair is scored only if
   the bound is within the largest kth distance of a column that one block needs
   and the other has.
4. Partial top-k lists (at most k per block pair and missing value) are merged
   by rank.

Work per task is bounded by ``block_rows``^2 whatever the group size; the pair
table holds boxes, not rows.  Where columns are null in every block nothing is
pruned and all pairs of a group are scored, as the definition asks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.session import cut_lineage, scratch_table_path

# recipients scored per numpy step inside a task (bounds the r x d x p array)
_CHUNK = 128


def _best_donors(key_name: str, id_name: str, cols: list[str], k: int):
    p = len(cols)

    def fn(rec: pd.DataFrame, don: pd.DataFrame) -> pd.DataFrame:
        out_cols = [key_name, id_name, "__col", "__dist", "__donor", "__val"]
        tmpl = (rec if not rec.empty else don)
        empty = pd.DataFrame({key_name: tmpl[key_name].iloc[:0], id_name: tmpl[id_name].iloc[:0],
                              "__col": pd.Series([], dtype=object), "__dist": pd.Series([], dtype="float64"),
                              "__donor": tmpl[id_name].iloc[:0].to_numpy(), "__val": pd.Series([], dtype="float64")})
        if rec.empty or don.empty:
            return empty
        key = rec[key_name].iloc[0]
        don = don.sort_values(id_name, kind="stable")  # ties in distance go to the smaller id
        Y = don[cols].to_numpy(dtype="float64")
        my = ~np.isnan(Y)
        dids = don[id_name].to_numpy()
        pieces = []
        for s in range(0, len(rec), _CHUNK):
            part = rec.iloc[s:s + _CHUNK]
            X = part[cols].to_numpy(dtype="float64")
            mx = ~np.isnan(X)
            both = mx[:, None, :] & my[None, :, :]
            diff = np.where(both, X[:, None, :] - Y[None, :, :], 0.0)
            common = both.sum(axis=2)
            with np.errstate(invalid="ignore", divide="ignore"):
                dist = np.sqrt(p / common * (diff * diff).sum(axis=2))
            dist[common == 0] = np.nan
            rids = part[id_name].to_numpy()
            for j, c in enumerate(cols):
                need = np.flatnonzero(~mx[:, j])
                has = np.flatnonzero(my[:, j])
                if need.size == 0 or has.size == 0:
                    continue
                sub = dist[np.ix_(need, has)]
                # stable sort: NaN (no common feature) last, equal distances by id
                top = np.argsort(sub, axis=1, kind="stable")[:, :k]
                td = np.take_along_axis(sub, top, axis=1)
                keep = ~np.isnan(td)
                if not keep.any():
                    continue
                ri, _ = np.nonzero(keep)
                donor = has[top[keep]]
                pieces.append(pd.DataFrame({
                    key_name: key, id_name: rids[need[ri]], "__col": c, "__dist": td[keep],
                    "__donor": dids[donor], "__val": Y[donor, j]}))
        if not pieces:
            return empty
        return pd.concat(pieces, ignore_index=True)[out_cols]

    return fn


def _blocks(base: DataFrame, key: str, id_col: str, cols: list[str], block_rows: int) -> DataFrame:
    """``base`` with ``__blk``, written once: runs of at most ``block_rows``
    neighbouring rows of a group."""
    spark = base.sparkSession
    stats = base.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.coalesce(F.var_pop(c), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    lead = cols[max(range(len(cols)), key=lambda i: (stats[f"n{i}"], stats[f"v{i}"]))]
    ordered = base.repartitionByRange(key, lead, id_col).sortWithinPartitions(key, lead, id_col).withColumn("__k", F.xxhash64(key))
    schema = StructType(list(base.schema.fields)).add("__blk", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, last = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for b in batches:
            blocks = []
            for v in b.column(b.num_columns - 1).to_pylist():
                if v != last or place >= block_rows:
                    block, place, last = block + 1, 0, v
                blocks.append(block)
                place += 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(blocks, pa.int64())], names=schema.names)
    path = scratch_table_path(spark, "knn_blocks")
    ordered.mapInArrow(number, schema).write.parquet(path)
    return spark.read.parquet(path)


def _boxes(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per block: rows, and least, largest and number of values per column."""
    return cut_lineage(rows.groupBy(key, "__blk").agg(F.count(F.lit(1)).alias("n"), *[
        f(c).alias(f"{name}{i}") for i, c in enumerate(cols) for name, f in (("lo", F.min), ("hi", F.max), ("has", F.count))]))


def near_pairs(boxes: DataFrame, reach: DataFrame, key: str, n_cols: int) -> DataFrame:
    """(__rb, __db): recipient and donor blocks of a group that can be within
    reach; ``reach`` holds per block and column the largest kth distance
    (``tau``), infinite where some row has no k donors yet."""
    r, d = boxes.join(reach, "__blk", "left").alias("r"), boxes.alias("d")
    gap2, common = F.lit(0.0), F.lit(0)
    for i in range(n_cols):
        gap = F.greatest(F.col(f"d.lo{i}") - F.col(f"r.hi{i}"), F.col(f"r.lo{i}") - F.col(f"d.hi{i}"), F.lit(0.0))
        sure = (F.col(f"r.has{i}") == F.col("r.n")) & (F.col(f"d.has{i}") == F.col("d.n"))
        gap2 = gap2 + F.when(sure, gap * gap).otherwise(0.0)
        common = common + ((F.col(f"r.has{i}") > 0) & (F.col(f"d.has{i}") > 0)).cast("int")
    # a hair below the bound, as distances are rounded
    bound = F.sqrt(F.lit(float(n_cols)) / common * gap2) * (1 - 1e-9)
    wanted = F.lit(False)
    for i in range(n_cols):
        wanted = wanted | ((F.col(f"r.has{i}") < F.col("r.n")) & (F.col(f"d.has{i}") > 0)
                           & (bound <= F.coalesce(F.col(f"r.tau{i}"), F.lit(float("inf")))))
    same = r.join(d, F.col(f"r.{key}").eqNullSafe(F.col(f"d.{key}")) & (F.col("r.__blk") != F.col("d.__blk")))
    return same.where((common > 0) & wanted).select(F.col("r.__blk").alias("__rb"), F.col("d.__blk").alias("__db"))


def impute_knn(df: DataFrame, key: str, id_col: str, cols: Sequence[str], k: int = 5,
               min_rows: int = 10, block_rows: int = 1024, seen: list | None = None) -> DataFrame:
    """Replace NULLs of ``cols`` by their k-NN mean within each ``key`` group.

    ``id_col`` identifies a row within its group (e.g. the date of a panel
    row).  Returns ``df`` with ``cols`` imputed as double.  ``seen`` takes the
    number of block pairs scored and of all block pairs.
    """
    cols = list(cols)
    full = df.withColumns({c: F.col(c).cast("double") for c in cols})
    base = full.select(key, id_col, *cols)
    rows = _blocks(base, key, id_col, cols, block_rows)
    boxes = _boxes(rows, key, cols)
    # one row per group: size and column means (the fallback)
    sizes = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"__mean_{c}") for c in cols]))
    big = cut_lineage(boxes.join(sizes.where(F.col("__n") > min_rows).select(F.col(key).alias("__gk")),
                                 F.col(key).eqNullSafe(F.col("__gk")), "left_semi"))
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    rows = rows.join(big.select("__blk"), "__blk", "left_semi")
    id_type = base.schema[id_col].dataType.simpleString()
    key_type = base.schema[key].dataType.simpleString()
    schema = (f"`{key}` {key_type}, `{id_col}` {id_type}, __col string, __dist double, "
              f"__donor {id_type}, __val double")
    best = _best_donors(key, id_col, cols, k)

    def own(block: pd.DataFrame) -> pd.DataFrame:
        out = best(block[block[cols].isna().any(axis=1)], block)
        return out.assign(__blk=block["__blk"].iloc[0])
    first = cut_lineage(rows.groupBy("__blk").applyInPandas(own, schema + ", __blk long"))
    kth = (first.groupBy("__blk", "__col", id_col, key).agg(F.count(F.lit(1)).alias("n_found"), F.max("__dist").alias("far"))
           .where(F.col("n_found") == k).groupBy("__blk", "__col").agg(F.count(F.lit(1)).alias("n_full"), F.max("far").alias("far"))
           .groupBy("__blk").pivot("__col", cols).agg(F.first("n_full").alias("n"), F.first("far").alias("far")))
    missing = big.select("__blk", *[(F.col("n") - F.col(f"has{i}")).alias(f"m{i}") for i in range(len(cols))])
    reach = missing.join(kth, "__blk", "left").select("__blk", *[
        F.when(F.coalesce(F.col(f"`{c}_n`"), F.lit(0)) == F.col(f"m{i}"), F.col(f"`{c}_far`")).otherwise(F.lit(float("inf"))).alias(f"tau{i}")
        for i, c in enumerate(cols)])
    pairs = cut_lineage(near_pairs(big, cut_lineage(reach), key, len(cols)))
    if seen is not None:
        n = big.groupBy(key).count()
        seen += [pairs.count(), n.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] or 0]
    # fresh aliases on both sides: the two cogroup inputs share one lineage
    fresh = [F.col(c).alias(c) for c in (key, id_col, *cols)]
    rec = rows.where(any_null).join(pairs, F.col("__blk") == F.col("__rb")).select(*fresh, F.col("__rb").alias("__rb"), F.col("__db").alias("__db"))
    don = rows.join(pairs, F.col("__blk") == F.col("__db")).select(*fresh, F.col("__rb").alias("__rb"), F.col("__db").alias("__db"))
    cand = cut_lineage(rec.groupBy("__rb", "__db").cogroup(don.groupBy("__rb", "__db")).applyInPandas(best, schema))
    # merge the per-pair top-k lists: each (row, column) holds <= k * pairs rows
    w = Window.partitionBy(key, id_col, "__col").orderBy("__dist", "__donor")
    knn = (first.drop("__blk").unionByName(cand).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k)
               .groupBy(key, id_col).pivot("__col", cols).agg(F.avg("__val")))
    knn = knn.select(F.col(key).alias("__kk"), F.col(id_col).alias("__ki"), *[F.col(c).alias(f"__knn_{c}") for c in cols])
    sizes = sizes.withColumnRenamed(key, "__sk")
    out = (full.join(knn, F.col(key).eqNullSafe(F.col("__kk")) & F.col(id_col).eqNullSafe(F.col("__ki")), "left")
             .join(sizes, F.col(key).eqNullSafe(F.col("__sk")), "left"))
    eligible = F.col("__n") > min_rows
    filled = [F.when(eligible, F.coalesce(F.col(c), F.col(f"__knn_{c}"), F.col(f"__mean_{c}")))
               .otherwise(F.col(c)).alias(c) for c in cols]
    keep = [c for c in df.columns if c not in cols]
    return out.select(*keep, *filled).select(*df.columns)
