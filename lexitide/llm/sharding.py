"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are dealt by range,
overfull ranges (one text that repeats) are subdivided by a second key, and shard cuts are placed exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import holding, named, prepare, stage, uniform, unstage


def splitters(keys: np.ndarray, subkeys: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 boundaries (key, subkey) at the weighted quantiles of a sample. A key that is a boundary once
    or twice stays whole (its subkey is the least number); one that is more often fills ranges and is subdivided."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort((subkeys, keys))
    keys, subkeys, cum = keys[order], subkeys[order], np.cumsum(weights[order])
    at = np.unique(np.searchsorted(cum, cum[-1] * np.arange(1, n) / n).clip(0, len(keys) - 1))
    k, s = keys[at], subkeys[at]
    _, inverse, counts = np.unique(k, return_inverse=True, return_counts=True)
    s = np.where(counts[inverse] <= 2, np.iinfo(np.int64).min, s)
    pairs = np.unique(np.stack([k, s], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def range_of(key: np.ndarray, subkey: np.ndarray, bk: np.ndarray, bs: np.ndarray) -> np.ndarray:
    """The number of boundaries (bk, bs) at or below each (key, subkey)."""
    lo, hi = np.searchsorted(bk, key, "left"), np.searchsorted(bk, key, "right")
    out = lo.copy()
    inside = np.flatnonzero(hi > lo)
    for a in np.unique(lo[inside]):
        rows = inside[lo[inside] == a]
        out[rows] = a + np.searchsorted(bs[a : hi[rows[0]]], subkey[rows], "right")
    return out


def shard(records: DataFrame, n_shards: int = 24, size: str = "size", group: str = "group_key", order: str = "order_key", ranges_per_shard: int = 32, rows_per_range: int = 200_000, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """records with shard int and slot long added (in place of columns of these names): shards of near equal total size,
    slots gapless from 0.

    group and order are long hash columns: records of one group lie together in one shard as far as the group is
    smaller than a hundredth of a shard or the largest record; a larger group may be cut between two records.
    Each shard's size differs from the mean by no more than that bound. Nulls in size count as 0, nulls in group or
    order sort first as one value; an empty table gives no rows. Records that agree in group and order are told apart by
    a hash of their other columns, and those that agree in all columns by a number of their own; they are exchangeable.
    No record is collected but a sample of about `sample` keys, or 8 for each range where there are more ranges; ranges
    grow with the data (rows_per_range), and one line a range reaches the driver.
    """
    spark = prepare(records.sparkSession)
    records = named(records, "shard", "slot", needs=(size, group, order))
    key = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    plain = [f.name for f in records.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # The input stays in one column of its own, so none of its names can clash.
    base = records.select(F.struct(*records.columns).alias("doc"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("z"), key(group).alias("g"), key(order).alias("o"), F.xxhash64(*plain).alias("h"), F.monotonically_increasing_id().alias("row"))
    base = stage(base, "shard-base")
    rows, total, largest = base.agg(F.count("*"), F.coalesce(F.sum("z"), F.lit(0)), F.coalesce(F.max("z"), F.lit(0))).first()
    n = max(n_shards * ranges_per_shard, rows // rows_per_range)
    share = F.least(F.lit(1.0), (F.col("z") + F.lit(max(1.0, total / max(rows, 1) / 8))) * F.lit(max(sample, 8 * n) / max(total, 1)))
    got = base.withColumn("p", share).where(uniform("g", "o", "h", "row", seed=seed) < F.col("p")).select("g", "o", (F.col("z") / F.col("p")).alias("w")).toPandas()
    bk, bs = splitters(got["g"].to_numpy(np.int64), got["o"].to_numpy(np.int64), got["w"].to_numpy(float), n)

    @F.pandas_udf(T.IntegerType())
    def dealt(key: pd.Series, subkey: pd.Series) -> pd.Series:
        return pd.Series(range_of(key.to_numpy(np.int64), subkey.to_numpy(np.int64), bk, bs).astype(np.int32))

    # Rows of one group and one order can't be parted by keys: where they would fill ranges, they are cut by a hash of the rest.
    pairs, inverse = np.unique(got[["g", "o"]].to_numpy(np.int64), axis=0, return_inverse=True)
    parts = np.ceil(np.bincount(inverse.ravel(), weights=got["w"].to_numpy(float), minlength=len(pairs)) * n / max(total, 1)).astype(int)
    hot = spark.createDataFrame([(*map(int, p), int(k)) for p, k in zip(pairs, parts) if k > 2], "g long, o long, parts int")  # at most n / 2 rows
    ranged = base.withColumn("r", dealt("g", "o")).join(F.broadcast(hot), ["g", "o"], "left")
    ranged = stage(ranged.withColumn("cut", F.pmod(F.xxhash64("h", "row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"), "shard-ranged")
    unstage(base)
    within = Window.partitionBy("r", "cut").orderBy("g", "o", "h", "row")
    sums = sorted(ranged.groupBy("r", "cut").agg(F.count("*").alias("n"), F.sum("z").alias("z")).collect())
    rows_before = np.concatenate([[0], np.cumsum([x[2] for x in sums], dtype=np.int64)])
    size_before = np.concatenate([[0], np.cumsum([x[3] for x in sums], dtype=np.int64)])
    whole = max(total / n_shards / 100, largest)
    cuts = []  # position of the first row of shards 1, 2, ...
    aims = [(k, total * k / n_shards) for k in range(1, n_shards)] if sums else []
    at = {k: int(np.clip(np.searchsorted(size_before, aim, "right") - 1, 0, len(sums) - 1)) for k, aim in aims}
    if aims:
        wanted = spark.createDataFrame([(int(sums[at[k]][0]), int(sums[at[k]][1]), k, float(aim - size_before[at[k]])) for k, aim in aims], "r int, cut int, k int, aim double")
        inner = ranged.select("r", "cut", "z", "g", "o", "h", "row").join(F.broadcast(wanted.select("r", "cut").distinct()), ["r", "cut"], "left_semi")
        inner = inner.withColumns({"rn": F.row_number().over(within), "cum": F.sum("z").over(within.rowsBetween(Window.unboundedPreceding, 0)), "last": F.coalesce(F.lead("g").over(within) != F.col("g"), F.lit(True)), "gz": F.sum("z").over(Window.partitionBy("r", "cut", "g"))})
        ends = inner.where(F.col("last") | (F.col("gz") > F.lit(whole)) | (F.col("cut") > 0)).select("r", "cut", "rn", "cum")
        best = ends.join(F.broadcast(wanted), ["r", "cut"]).groupBy("k").agg(F.min(F.struct(F.abs(F.col("cum") - F.col("aim")).alias("off"), "rn")).alias("b")).select("k", "b.off", "b.rn").collect()
        best = {r.k: (r.off, r.rn) for r in best}
        for k, aim in aims:
            before = aim - float(size_before[at[k]])
            off, rn = best.get(k, (float("inf"), 0))
            cuts.append(int(rows_before[at[k]]) + (rn if off < before else 0))
    cuts = np.maximum.accumulate(np.array(cuts, dtype=np.int64)) if cuts else np.zeros(0, dtype=np.int64)
    starts = spark.createDataFrame([(int(x[0]), int(x[1]), int(b)) for x, b in zip(sums, rows_before)], "r int, cut int, before long")
    placed = ranged.join(starts, ["r", "cut"], "inner").withColumn("at", F.col("before") + F.row_number().over(within) - 1)
    edges = F.array(*[F.lit(int(c)) for c in (0, *cuts)])
    shard_no = F.size(F.filter(edges, lambda c: c <= F.col("at"))) - 1
    placed = placed.withColumn("shard", shard_no.cast("int")).withColumn("slot", (F.col("at") - F.element_at(edges, F.col("shard") + 1)).cast("long"))
    return holding(placed.select("doc.*", "shard", "slot"), ranged)
