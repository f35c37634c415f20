"""Near-duplicate vectors by a pivot-permutation index: each vector is described by its nearest pivots in order, inverted
lists of pivots retrieve vectors that share two, of which one stands at the head of both orders, and cosines verify."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, offsets_of, prepare, settle, stage, task, uniform, unstage
from .graph import blocked, components, gathered, grouped
from .ngram_join import shared

#: Rows of one block of an inverted list.
BLOCK_ROWS = 2000
#: Places at the head of a vector's order of pivots; a list needs one of them.
HEAD = 4
#: Cosines with pivots that a task holds at a time.
_HELD = 2_000_000


def pivots_for(vectors: DataFrame, vector_col: str, least: int = 64, most: int = 16_384, per_root: float = 4.0, seed: int = 13) -> list[list[float]]:
    """Reference points: about per_root times the square root of the number of vectors, from least to most, drawn by
    the hash of the vector, so a vector that repeats is drawn once. One that is near another is left out: near copies of
    one vector would order many pivots among themselves by chance."""
    total = vectors.count()
    want = int(min(most, max(least, per_root * total**0.5)))
    drawn = vectors.where(uniform(F.col(vector_col), seed=seed) < F.lit(min(1.0, 1.3 * want / max(total, 1)))).groupBy(vector_col).agg(F.lit(1)).select(vector_col).limit(2 * most).collect()
    rows = sorted(([float(x) if x is not None else 0.0 for x in r[0]] for r in drawn if r[0]), key=lambda v: (hash(tuple(v)), v))
    return spread(rows)[:want]


def spread(rows: list[list[float]], near: float = 0.9) -> list[list[float]]:
    """The rows without those whose cosine with an earlier one that stays is near or more; zero rows stay."""
    out = set(range(len(rows)))
    for dim in {len(v) for v in rows}:
        mine = [i for i, v in enumerate(rows) if len(v) == dim]
        x = _fit([rows[i] for i in mine], dim).astype(np.float32)
        open_ = np.ones(len(x), dtype=bool)
        for k in range(len(x)):
            if open_[k]:
                open_[k + 1 :] &= x[k + 1 :] @ x[k] < near
        out.difference_update(i for i, o in zip(mine, open_.tolist()) if not o)
    return [rows[i] for i in sorted(out)]


def _fit(pivots: list[list[float]], dim: int) -> np.ndarray:
    """Pivots cut or repeated to a number of components, as unit vectors."""
    p = np.array([(v * (dim // len(v) + 1))[:dim] for v in pivots], dtype=np.float64).reshape(-1, dim)
    p[~np.isfinite(p)] = 0.0
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)


def nearest(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the m nearest pivots of each unit vector, nearest first."""
    m = min(m, len(pivots))
    out = np.zeros((len(x), m), np.int64)
    step = max(1, _HELD // max(1, len(pivots)))
    for a in range(0, len(x) if m else 0, step):
        near = x[a : a + step] @ pivots.T
        top = np.argpartition(-near, m - 1, axis=1)[:, :m]
        out[a : a + step] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


def near_pivots_for(pivots: int) -> int:
    """How many nearest pivots describe a vector: seven up to 256 pivots, one more for each doubling, eleven at 4096, and two
    more for each doubling from there, as two vectors share fewer of their nearest pivots the more there are."""
    doublings = lambda n: max(0, ceil(log2(max(1, pivots) / n)))
    return 7 + doublings(256) + doublings(4096)


def lists_of(order: np.ndarray, dim: int, head: int = HEAD) -> np.ndarray:
    """The numbers of the lists that vectors with these orders of pivots are in, ascending: one for each two pivots of the
    order of which one is among its first `head`. Without two pivots all vectors of a length are in one list."""
    if order.shape[1] < 2:
        return np.full((len(order), 1), dim << 32)
    i, j = np.array([(i, j) for i in range(min(head, order.shape[1])) for j in range(i + 1, order.shape[1])]).T
    a, b = order[:, i], order[:, j]
    return np.sort((dim << 32) | (np.minimum(a, b) << 16) | np.maximum(a, b), axis=1)


def link(vectors: DataFrame, threshold: float = 0.9, near_pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: id, n_links long (other vectors linked directly), component_id long (least id that links reach, its
    own included) and kept boolean (id = component_id).

    Two vectors are linked if at least two of their near_pivots nearest pivots (by the number of pivots, if not given)
    are the same, one of them among the HEAD nearest of both, and their cosine in double precision is at least threshold.
    Lists are kept by pairs of pivots; vectors that share several lists are counted in the least one only. Equal vectors
    are one entry that counts as often as it occurs; long lists are compared in blocks. Vectors that are null, zero,
    empty or hold null or non-finite components link with nothing; vectors of different lengths don't link. Every id,
    equal or null, is a row of its own; the component of a null id without links is null. An empty table gives no rows.
    Other columns are not returned.
    """
    spark = prepare(vectors.sparkSession)
    base = stage(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("row", F.monotonically_increasing_id()).withColumn("v", F.when(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0), None).otherwise(F.col("v"))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")
    good = base.where("v is not null and size(v) > 0")
    classes = stage(good.groupBy("h1", "h2").agg(F.min(F.struct("row", "v")).alias("r"), F.count("*").alias("m"), F.min("id").alias("least")).select("h1", "h2", "m", "least", F.col("r.row").alias("c"), F.col("r.v").alias("v")), "vector-classes")
    drawn = pivots_for(classes, "v")
    near_pivots = near_pivots_for(len(drawn)) if near_pivots is None else near_pivots
    pivots = spark.sparkContext.broadcast(drawn)  # at most 16,384 vectors
    schema = "c long, m long, v binary, lists array<long>"

    def describe(batches: Batches) -> Batches:
        fitted: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, off = batch.column(2), offsets_of(batch.column(2))
            values, size = flat.values.to_numpy(zero_copy_only=False), np.diff(off)
            for dim in np.unique(size).tolist():
                if dim not in fitted:
                    fitted[dim] = _fit(pivots.value, dim)
                mine = np.flatnonzero(size == dim)
                x = values[off[mine][:, None] + np.arange(dim)]
                single = x.astype(np.float32)
                exact = (single == x).all(axis=1).tolist()
                raw = [s.tobytes() if e else v.tobytes() for s, v, e in zip(single, x, exact)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                lists = lists_of(nearest(x, fitted[dim], near_pivots), dim)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1]), pa.array(lists.ravel()))
                take = pa.array(mine)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(raw, pa.binary()), listed], names=["c", "m", "v", "lists"])

    described = stage(classes.select("c", "m", "v").mapInArrow(task("vectors", describe), schema), "pivot-orders")
    lists = described.select("c", F.explode("lists").alias("list"), F.lit(1).alias("w"))
    more = lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").select("list")
    tasks = blocked(lists.join(more, "list"), ["list"], "c", "w", BLOCK_ROWS, BLOCK_ROWS).join(described, "c")
    tasks = tasks.select("list", "lo", "hi", "c", "block", "m", "lists", "v").repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")

    def verify(batches: Batches) -> Batches:
        got = [[], [], []]
        held = 0
        for table in grouped(batches, 3):
            if table.num_rows < 2:
                continue
            here = table.column("list")[0].as_py()
            dim = here >> 32
            x = np.stack([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dim else np.float64) for v in table.column("v").to_pylist()]).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
                block = table.column("block").to_numpy()
                near &= block[:, None] != block[None, :]
            if not near.any():
                continue
            few = np.flatnonzero(near.any(axis=1))
            all_lists = table.column("lists").take(pa.array(few)).combine_chunks()
            values, off = all_lists.values.to_numpy(), offsets_of(all_lists)
            before = [values[a:b][values[a:b] < here] for a, b in zip(off, off[1:])]
            if any(map(len, before)):
                near[np.ix_(few, few)] &= shared(before) == 0
            some, links, root = gathered(near, table.column("c").to_numpy(), table.column("m").to_numpy())
            for store, value in zip(got, (table.column("c").to_numpy()[some], links, root)):
                store.append(value)
            held += len(some)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)) for g in got], names=["v", "links", "root"])
                got, held = [[], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)) for g in got], names=["v", "links", "root"])

    links = stage(tasks.mapInArrow(task("vectors", verify), "v long, links long, root long"), "vector-links")
    pivots.destroy()
    unstage(described)
    joined = components(links.select(F.col("v").alias("a"), F.col("root").alias("b")))
    entries = classes.select("h1", "h2", "m", "least", "c")
    label = stage(joined.join(entries, F.col("v") == F.col("c")).groupBy("label").agg(F.min("least").alias("component")), "vector-labels")
    per = links.groupBy("v").agg(F.sum("links").alias("links")).join(joined.join(label, "label").select("v", "component"), "v")
    named = entries.join(per, F.col("c") == F.col("v"), "left").select("h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    plain = base.where("v is null or size(v) = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = base.where("v is not null and size(v) > 0").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id").unionByName(plain)
    out = out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return settle(out, "vectors-linked", base, classes, links, label, joined)
