"""Connected components of link tables, and the links inside a gathered group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holding, stage, unstage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, label): each end of an edge (a long, b long) with the smallest id that edges reach from it.

    Large-star and small-star steps in turn: every step joins edges with the least neighbour of one end. Least neighbours
    are aggregated before the shuffle; those of nodes with over a thousandth of all edges, fewer than two thousand, are
    broadcast, so the edges of such a node stay where they are. Each round is written to the shared folder; it ends when
    a round changes nothing. Nulls and edges from a node to itself are left out.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))
    was = now.select(mark.alias("m")).first()["m"]
    for _ in range(most_rounds):
        # One scan each: every scan and every stage of a round costs the driver a broadcast. a is above b in all rounds.
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))).select("col.u", "col.v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        often = F.col("k") > max(100, was[0] // 1000)
        hot = stage(least.where(often).select("u", F.col("m").alias("hot")), "cc-hot")
        up = now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(F.broadcast(hot), "u", "left")
        light = up.where("hot is null").join(least.where(~often), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = light.unionByName(up.where("hot is not null").select(F.col("v").alias("a"), F.col("hot").alias("b"))).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(root.select("a", F.col("m").alias("b"))).distinct()
        new = stage(small, "cc-edges")
        unstage(now, hot)
        now, (mine, was) = new, (new.select(mark.alias("m")).first()["m"], was)
        if mine == was:
            break
        was = mine
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
    return holding(out, now)


def blocked(members: DataFrame, keys: list[str], row: str, weight: str, most_weight: int, most_rows: int) -> DataFrame:
    """members with block int, lo int and hi int added: groups (equal keys) beyond most_weight or most_rows are cut into
    blocks by a hash of row, and each member goes to every pair (lo, hi) of blocks that has its own; small groups stay
    one block. So no task needs more than two blocks, and every pair of members meets."""
    totals = members.groupBy(*keys).agg(F.greatest(F.ceil(F.sum(weight) / most_weight), F.ceil(F.count("*") / most_rows)).cast("int").alias("_nb"))
    # Staged, so that the planner knows its size and may split the members of a large group.
    totals = stage(totals.where("_nb > 1"), "block-counts")
    placed = members.join(totals, keys, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(row), F.col("_nb")).cast("int"))
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return other.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_nb", "_other")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first `keys` (integer, non-null) columns of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(cols[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def gathered(linked: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a symmetric matrix of links: members that have any, the weight of their partners, and the least id of
    their component."""
    some = np.flatnonzero(linked.any(axis=1))
    near = linked[np.ix_(some, some)]
    total = near @ weight[some].astype(np.float64)
    root = np.full(len(some), -1, dtype=np.int64)
    for i in np.argsort(ids[some], kind="stable").tolist():
        if root[i] >= 0:
            continue
        inside = np.zeros(len(some), dtype=bool)
        inside[i] = True
        front = inside.copy()
        while front.any():
            front = near[front].any(axis=0) & ~inside
            inside |= front
        root[inside] = i
    return some, np.rint(total).astype(np.int64), ids[some][root] if len(some) else np.zeros(0, dtype=np.int64)
