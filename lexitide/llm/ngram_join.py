"""Similarity join of texts by the Jaccard index of their word n-grams: MinHash banding with band and row counts for a
target recall, a shuffle on band hashes, and verification on full n-gram sets."""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, bytes_of, mix64, prepare, runs, settle, sift, stage, task, unstage
from .graph import blocked, components, gathered, grouped

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Weight (n-grams) and rows of one block of a candidate group.
BLOCK_NGRAMS, BLOCK_ROWS = 1_500_000, 2500
#: Rows of a block that are compared at a time.
HELD_ROWS = 128
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        base, k = 0xD1342543DE82EF95, max(n, 1 << 18)
        table = [np.full(k, np.uint64(b), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        for t in table:
            t[0] = 1
        _powers[:] = [np.multiply.accumulate(t) for t in table]
    return _powers[0][:n], _powers[1][:n]


def forget_powers() -> None:
    _powers.clear()


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct runs of n words of each text, sorted, and the offsets of each text's in them. A
    word is a run of bytes other than ASCII white space; a text of fewer than n words has one n-gram, all its words;
    one without words has none."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    black = (data != 32) & ((data < 9) | (data > 13))
    first = black.copy()
    first[1:] &= ~black[:-1]
    begins = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    first[begins] = black[begins]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1] * black, out=sums[1:])
    bound = np.append(start, len(data))
    word = mix64((sums[bound[1:]] - sums[bound[:-1]]) * down[start])
    owner = np.searchsorted(offsets, start, "right") - 1
    counts = np.bincount(owner, minlength=docs)
    after = np.concatenate([[0], np.cumsum(counts)])
    if len(word) >= n:
        whole = np.zeros(len(word) - n + 1, np.uint64)
        for i in range(n):
            whole = mix64(whole * _ODD + word[i : len(word) - n + 1 + i])
        inside = owner[: len(whole)] == owner[n - 1 :]
        grams, own = whole[inside], owner[: len(whole)][inside]
    else:
        grams, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for i in range(n - 1):
            has = counts[few] > i
            short[has] = mix64(short[has] * _ODD + word[after[few[has]] + i] + np.uint64(n))
        grams, own = np.concatenate([grams, short]), np.concatenate([own, few])
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=docs))]).astype(np.int64)


def bands_for(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold meets in some band with probability recall."""
    fits = [(b, r) for r in range(1, 17) if (b := math.ceil(math.log(1 - recall) / math.log1p(-(threshold**r)))) * r <= most_hashes]
    return fits[-1] if fits else (most_hashes, 1)


def band_hashes(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int = 17) -> np.ndarray:
    """One hash for each text with n-grams and each band: of the least values of the band's hash functions."""
    rng = np.random.default_rng(seed)
    mul = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    x, starts = (grams >> np.uint64(32)).astype(np.uint32), offsets[:-1][some]
    out = np.empty((len(some), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(some), mix64(np.array([b + 1], np.uint64))[0])
        for j in range(b * rows, b * rows + rows):
            h = mix64(h * _ODD + np.minimum.reduceat(x * mul[j] + add[j], starts).astype(np.uint64)) if len(some) else h
        out[:, b] = h
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets (sorted distinct values) share."""
    n = len(sets)
    if n == 2:
        return np.array([[0, 1], [1, 0]], dtype=np.float32) * len(np.intersect1d(*sets, assume_unique=True))
    out = np.zeros(n * n, dtype=np.float32)
    every, own = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, own = every[order], own[order]
    edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    many = np.diff(np.append(edge, len(every)))
    often = many > max(4, n // 32)
    rare = np.repeat((many > 1) & ~often, many)
    value, who = np.repeat(np.arange(len(edge)), many)[rare], own[rare]
    for s in range(1, int(many[(many > 1) & ~often].max(initial=1))):
        same = value[s:] == value[:-s]
        np.add.at(out, who[:-s][same] * n + who[s:][same], np.float32(1))  # a bincount takes two more tables of n * n
    out = out.reshape(n, n)
    out += out.T
    wide = np.flatnonzero(often)
    step = max(1, 4_000_000 // n)
    for a in range(0, len(wide), step):
        m = np.zeros((n, min(step, len(wide) - a)), dtype=np.float32)
        for j, e in enumerate(wide[a : a + step].tolist()):
            m[own[edge[e] : edge[e] + many[e]], j] = 1
        out += m @ m.T
    np.fill_diagonal(out, 0)
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two of the sets have a Jaccard index of at least threshold."""
    counts = shared(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    near = np.empty(counts.shape, dtype=bool)
    for a in range(0, len(sets), HELD_ROWS):
        both = counts[a : a + HELD_ROWS].astype(np.float64)
        near[a : a + HELD_ROWS] = both / np.maximum(1.0, sizes[a : a + HELD_ROWS, None] + sizes[None, :] - both) >= threshold
    np.fill_diagonal(near, False)
    return near


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, class_id (smallest id that links reach, its own included), n_links long (other documents whose
    n-gram sets have a Jaccard index of at least threshold with its own), copy_of (smallest id with the very same set)
    and n_copies long (how many have it).

    Documents with equal sets are one class and linked; classes, not documents, are compared, so copies are never
    expanded into pairs. Band hashes link each class to the least one of its bucket. What these links connect is compared
    at once where it fits into one block; larger ones (which grow together where many texts share a passage) are compared
    bucket by bucket, in blocks, each pair in the first bucket that it shares. So no bucket is capped, no pair that shares
    one is missed, and no work goes into pairs that share none but those inside a block. Null and blank texts have the
    empty set and are one class, linked to nothing else. Rows with equal or null ids are rows of their own; class_id is
    null only if all ids of a group are. An empty table gives no rows. Other columns are not returned.
    """
    spark = prepare(docs.sparkSession)
    bands, rows = bands_for(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    fields = [("id", docs.schema[id_col].dataType), ("t", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("n", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def describe(batches: Batches) -> Batches:
        for batch in batches:
            for a, b in runs(batch.column(2), 250_000):
                part = batch.slice(a, b - a)
                grams, off = ngrams(*bytes_of(part.column(2)), n)
                size = np.diff(off)
                some = size > 0
                d1, d2 = np.zeros((2, len(size)), np.uint64)
                if some.any():
                    d1[some] = np.add.reduceat(mix64(grams ^ _ODD), off[:-1][some])
                    d2[some] = np.add.reduceat(mix64(grams + _ODD), off[:-1][some])
                hashes = band_hashes(grams, off, bands, rows)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(size, pa.int64()), listed], names=schema.names)

    base = stage(source.mapInArrow(task("ngrams", describe, forget_powers), schema).withColumn("row", F.monotonically_increasing_id()), "ngram-base")
    classes = base.groupBy("d1", "d2", "n").agg(F.min(F.struct("row", "id", "t", "bands")).alias("r"), F.count("*").alias("m"), F.min("id").alias("least"))
    classes = stage(classes.select("d1", "d2", "n", "m", "least", F.col("r.row").alias("c"), F.col("r.id").alias("rep"), F.col("r.t").alias("t"), F.col("r.bands").alias("bands")), "ngram-classes")
    hashed = classes.select("c", F.explode("bands").alias("h"))
    least = hashed.groupBy("h").agg(F.min("c").alias("b"), F.count("*").alias("k")).where("k > 1").select("h", "b")
    groups = components(hashed.join(least, "h").where("c != b").select(F.col("c").alias("a"), "b"))
    sizes = groups.join(classes.select(F.col("c").alias("v"), "n"), "v").groupBy("label").agg(F.count("*").alias("k"), F.sum("n").alias("grams"))
    large = stage(sizes.where((F.col("k") > BLOCK_ROWS) | (F.col("grams") > BLOCK_NGRAMS)).select("label", F.lit(True).alias("large")), "ngram-large")
    known = groups.join(large, "label", "left").join(classes.select(F.col("c").alias("v"), "n", "m", "rep", "t", "bands"), "v")
    none = F.lit(None).cast("array<long>")
    whole = known.where("large is null").select(F.lit(0).alias("kind"), F.col("label").alias("key"), "v", "n", "m", "rep", "t", none.alias("bands"))
    shared_buckets = known.where("large").select("v", "n", "m", "rep", "t", "bands", F.explode("bands").alias("key")).join(least.select(F.col("h").alias("key")), "key")
    parts = whole.unionByName(shared_buckets.select(F.lit(1).alias("kind"), "key", "v", "n", "m", "rep", "t", "bands"))
    placed = stage(blocked(parts, ["kind", "key"], "v", "n", BLOCK_NGRAMS, BLOCK_ROWS), "ngram-candidates")
    # Most texts are no candidates; they go before the shuffle.
    fetched, _ = sift(source, source["t"], placed, placed["t"])
    found = (fetched["t"] == placed["t"]) & fetched["id"].eqNullSafe(placed["rep"])
    tasks = fetched.join(placed, found).select("kind", "key", "lo", "hi", "v", "block", "m", "bands", "text").repartition("kind", "key", "lo", "hi").sortWithinPartitions("kind", "key", "lo", "hi", "v")

    def verify(batches: Batches) -> Batches:
        for table in grouped(batches, 4):
            v = table.column("v").to_numpy()
            take = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            v, block, m = v[take], table.column("block").to_numpy()[take], table.column("m").to_numpy()[take]
            if len(v) < 2:
                continue
            grams, off = ngrams(*bytes_of(table.column("text").take(pa.array(take)).combine_chunks()), n)
            near = similar([grams[a:b] for a, b in zip(off, off[1:])], threshold)
            if table.column("lo")[0].as_py() != table.column("hi")[0].as_py():
                near &= block[:, None] != block[None, :]
            if table.column("kind")[0].as_py():
                of = np.array(table.column("bands").take(pa.array(take)).to_pylist(), np.int64)
                for b in range(int((of == table.column("key")[0].as_py()).all(axis=0).argmax())):  # the bands before this one
                    near &= of[:, b][:, None] != of[:, b][None, :]
            some, links, root = gathered(near, v, m)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(links), pa.array(root)], names=["v", "links", "root"])

    links = stage(tasks.mapInArrow(task("ngrams", verify, forget_powers), "v long, links long, root long"), "ngram-links")
    unstage(placed, groups, large)
    joined = components(links.select(F.col("v").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("d1", "d2", "n", "m", "least", "c")
    label = stage(joined.join(of_class, joined["v"] == of_class["c"]).groupBy("label").agg(F.min("least").alias("class_id")), "ngram-labels")
    per = links.groupBy("v").agg(F.sum("links").alias("links"))
    named = of_class.join(joined.join(label, "label").select("v", "class_id"), F.col("c") == F.col("v"), "left").drop("v").join(per, F.col("c") == F.col("v"), "left")
    named = named.select("d1", "d2", "n", F.coalesce("class_id", "least").alias("class_id"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least").alias("copy_of"), F.col("m").alias("n_copies"))
    out = base.select("id", "d1", "d2", "n").join(named, ["d1", "d2", "n"])
    out = out.select(F.col("id").alias(id_col), "class_id", "n_links", "copy_of", "n_copies")
    return settle(out, "ngram-joined", base, classes, links, label, joined)
