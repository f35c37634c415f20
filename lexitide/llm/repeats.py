"""Repeated passages by a sparse enhanced suffix array: suffixes start at content-chosen anchors, those with a common
beginning are sorted with their common-prefix lengths, a stack scan yields the tree of common-prefix intervals, and the
left contexts in each interval tell which maximal repeats are long enough, with all their occurrences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, bytes_of, holding, mix64, prepare, runs, stage, task, unstage
from .graph import grouped
from .ngram_join import forget_powers, powers

#: Bytes that an anchor is chosen by; every string of the least length holds one.
GRAM = 32
#: Occurrences of one anchor that a task gathers: some 50 MB, as the context of each has 368 bytes at most. Those of an
#: anchor that occurs more often are cut into blocks of half as many, and every two blocks meet in a task.
MOST_GATHERED = 40_000
#: Occurrences whose bytes are laid out side by side at a time.
_LAID = 1024
_PIECE = 1 << 21
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(raw: np.ndarray, least: int, piece: int = _PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, key): each string of `least` bytes is given to the leftmost of its GRAM-byte pieces with the
    least scrambled hash; an anchor is such a piece, with the first and last start of the strings given to it. Equal
    strings choose the same piece. Long texts go in overlapping pieces, so memory stays bounded."""
    out = [[], [], [], []]
    w, mask = least - GRAM + 1, np.uint64((1 << 22) - 1)
    for base in range(0, max(0, len(raw) - least + 1), piece):
        part = raw[base : base + piece + least - 1]
        n = len(part) - GRAM + 1
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
        key = mix64((sums[GRAM:] - sums[:-GRAM]) * down[:n])
        rank = (mix64(key) & ~mask) | np.arange(n, dtype=np.uint64)
        blocks = -(-n // w) + 1
        wide = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        wide[:n] = rank
        wide = wide.reshape(blocks, w)
        pre = np.minimum.accumulate(wide, axis=1).ravel()
        suf = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - w + 1
        chosen = (np.minimum(suf[:count], pre[w - 1 : w - 1 + count]) & mask).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        at = chosen[edge]
        for store, x in zip(out, (at + base, edge + base, np.append(edge[1:], count) - 1 + base, key[at])):
            store.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64 if i == 3 else np.int64) for i, x in enumerate(out))


def _laid(data: np.ndarray, first: np.ndarray, lengths: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of width bytes: of row i those at first[i], first[i] + step, ..., lengths[i] of them, and zeros behind."""
    out = np.zeros((len(first), width), np.uint8)
    column = np.arange(width)
    for a in range(0, len(first), _LAID):
        src = first[a : a + _LAID, None] + step * column
        out[a : a + _LAID] = np.where(column < lengths[a : a + _LAID, None], data[np.clip(src, 0, len(data) - 1)], 0)
    return out


def _sorted(rows: np.ndarray, lengths: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """Order of rows as byte strings of their lengths, by the key within first. numpy pads by zeros, so strings that
    differ in zeros at their ends only are told apart by length."""
    order = np.argsort(lengths, kind="stable")
    order = order[np.argsort(rows.view(f"S{rows.shape[1]}").ravel()[order], kind="stable")]
    return order if within is None else order[np.argsort(within[order], kind="stable")]


def _common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of neighbouring rows."""
    out = np.zeros(max(0, len(rows) - 1), np.int64)
    for a in range(0, len(out), 8 * _LAID):
        same = rows[a + 1 : a + 8 * _LAID + 1] == rows[a : a + 8 * _LAID][: len(rows) - 1 - a]
        out[a : a + len(same)] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return np.minimum(out, np.minimum(lengths[1:], lengths[:-1]))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval of a suffix array, by a stack scan; lcp[i] is that of entries
    i and i + 1."""
    stack = [(0, 0)]
    for i, h in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > h:
            depth, first = stack.pop()
            yield depth, first, i
        if not stack or stack[-1][0] < h:
            stack.append((h, first))


def maximal_repeats(key: np.ndarray, data: np.ndarray, offsets: np.ndarray, at: np.ndarray, least: int, named: bool = True) -> tuple[np.ndarray, ...]:
    """(entry, left, right, group): for every interval of suffixes with one key, each entry whose longest left extension
    shared with another one makes a repeat of at least `least` bytes: it covers left bytes before the anchor and right
    bytes from it on. data[offsets[i]:offsets[i + 1]] is the context of entry i, its anchor at byte at[i]. The members
    of a group share `least` bytes, right of them from the anchor on; if named, the group is a hash of those."""
    n = len(key)
    lengths = np.diff(offsets)
    width, back = least, least - GRAM
    after = np.minimum(lengths - at, width)
    right = _laid(data, offsets[:-1] + at, after, width, 1)
    left = _laid(data, offsets[:-1] + at - 1, np.minimum(at, back), back, -1)
    order = _sorted(right, after, key)
    by_left = np.empty(n, np.int64)
    by_left[_sorted(left, at)] = np.arange(n)
    skey = key[order]
    edge = np.flatnonzero(np.concatenate([[True], skey[1:] != skey[:-1]]))
    sizes = np.diff(np.append(edge, n))
    lcp = _common(right[order], after[order])
    out = [[], [], [], []]

    def name(entry: int, depth: int) -> int:
        shared = left[entry, : max(0, least - depth)].tobytes() + right[entry, :depth].tobytes()
        return int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=depth.to_bytes(4, "little")).digest(), "little", signed=True)

    two = edge[sizes == 2]
    if len(two):
        a, b, r = order[two], order[two + 1], lcp[two]
        same = left[a] == left[b]
        l = np.minimum(np.where(same.all(axis=1), back, same.argmin(axis=1)), np.minimum(at[a], at[b]))
        good = l + r >= least
        group = np.array([name(x, d) for x, d in zip(a[good].tolist(), r[good].tolist())], np.int64) if named else a[good]
        for x in (a, b):
            for store, y in zip(out, (x[good], l[good], r[good], group)):
                store.append(y)
    for e, size in zip(edge[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        for depth, i, j in intervals(lcp[e : e + size - 1].tolist()):
            if depth + back < least:
                continue
            members = order[e + i : e + j + 1]
            members = members[np.argsort(by_left[members], kind="stable")]
            near = _common(left[members], at[members])
            if not len(near) or near.max() + depth < least:
                continue
            l = np.maximum(np.append(near, 0), np.concatenate([[0], near]))
            good = l + depth >= least
            # Repeats that share their last left bytes are extended in one way and so are one group.
            cut = np.concatenate([[0], np.cumsum(near + depth < least)])[good]
            group = cut
            if named:
                _, some, where = np.unique(cut, return_index=True, return_inverse=True)
                group = np.array([name(x, depth) for x in members[good][some].tolist()], np.int64)[where]
            for store, y in zip(out, (members[good], l[good], np.full(int(good.sum()), depth), group)):
                store.append(y)
    return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)


_ANCHOR = "t1 long, t2 int, place long, first long, last long, key long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), text.alias("text"))


def contexts(source: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(text classes, contexts of anchors that occur more than once, with how often: n), both staged: each text counts
    once however often it is copied."""
    whole = stage(source.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("id").alias("rep")), "repeat-texts")

    def choose(batches: Batches) -> Batches:
        for batch in batches:
            data, off = bytes_of(batch.column(2))
            for a in range(0, batch.num_rows, 250):
                got = [(i, *anchors(data[off[i] : off[i + 1]], least, _PIECE)) for i in range(a, min(a + 250, batch.num_rows)) if off[i + 1] - off[i] >= least]
                if got:
                    owner = pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]))
                    rest = [np.concatenate([g[k] for g in got]) for k in (1, 2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *[pa.array(x.view(np.int64)) for x in rest]], names=["t1", "t2", "place", "first", "last", "key"])

    found = stage(source.select("t1", "t2", "text").mapInArrow(task("repeats", choose, forget_powers), _ANCHOR), "repeat-anchors")
    place = F.xxhash64("t1", "t2", "place")
    again = found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a < b").select("key", "n")
    # Keys with over a thousandth of all rows, fewer than a thousand, are dealt over many tasks by a second key.
    often = stage(again.join(found.agg((F.count("*") / 1000).alias("most")), F.col("n") > F.col("most")).select("key", F.ceil(8 * F.col("n") / F.col("most")).cast("int").alias("parts")), "repeat-often")
    parts = lambda df: df.join(F.broadcast(often), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = parts(found).withColumn("part", F.pmod(place, F.col("parts")).cast("int"))
    copied = parts(again).select("key", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    per_text = dealt.join(copied, ["key", "part"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("place", "first", "last", "key", "n")).alias("found"))
    per_text = stage(per_text.join(whole.select("t1", "t2", "rep"), ["t1", "t2"]), "repeat-found")
    unstage(found, often)
    mine = (source["t1"] == per_text["t1"]) & (source["t2"] == per_text["t2"]) & source["id"].eqNullSafe(per_text["rep"])

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            data, off = bytes_of(batch.column(2))
            lists = batch.column(3)
            start = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4)
            flat = lists.values
            for i in range(batch.num_rows):
                for a in range(int(start[i]), int(start[i + 1]), 2000):
                    some = flat.slice(a, min(2000, int(start[i + 1]) - a))
                    place, first, last = (some.field(k).to_numpy() for k in (0, 1, 2))
                    pieces = [data[off[i] + f : off[i] + l + least].tobytes() for f, l in zip(first.tolist(), last.tolist())]
                    n = len(pieces)
                    yield pa.RecordBatch.from_arrays([some.field(3), batch.column(0).take(pa.array([i] * n)), batch.column(1).take(pa.array([i] * n)), some.field(0), pa.array(place - first), pa.array(pieces, pa.binary()), some.field(4)], names=["key", "t1", "t2", "place", "at", "context", "n"])

    joined = source.join(per_text, mine).select(source["t1"], source["t2"], "text", "found")
    found = stage(joined.mapInArrow(task("repeats", cut, forget_powers), "key long, t1 long, t2 int, place long, at long, context binary, n long"), "repeat-contexts")
    unstage(per_text)
    return whole, found


def repeat_groups(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", context: DataFrame | None = None, hulls: bool = False) -> DataFrame:
    """(t1, t2, start, length, group): the occurrences of maximal repeats of at least `least` bytes around each anchor,
    start in bytes of the text whose hashes are t1 and t2; occurrences of one repeat have one group, which is a hash of
    `least` bytes that they share. A repeat longer than what surrounds an anchor comes as overlapping groups. With hulls
    the repeats around one anchor, which all hold it, come as one range, the group saying nothing.

    An anchor's occurrences meet in one task up to MOST_GATHERED; those of a more frequent one are cut into blocks of
    half as many, and each two blocks make a tree: any two occurrences meet in one, so every repeat is found at any
    frequency. Of occurrences with the very same context only the least enters the blocks; all of them are repeats whole.
    """
    source = _texts(docs, id_col, text_col)
    context = context if context is not None else contexts(source, least)[1]
    spot = ["t1", "t2", "place", "at"]
    near = context.where(F.col("n") <= MOST_GATHERED).select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), *spot, "context")
    far = context.where(F.col("n") > MOST_GATHERED).withColumns({"h1": F.xxhash64("context"), "h2": F.xxhash64(F.lit(1), "context")})
    same = far.groupBy("key", "at", "h1", "h2").agg(F.min(F.struct("t1", "t2", "place")).alias("rep"), (F.min(F.struct("t1", "t2", "place")) < F.max(F.struct("t1", "t2", "place"))).alias("more"))
    same = stage(same, "repeat-same")
    known = far.join(same, ["key", "at", "h1", "h2"])
    whole = known.where("more").select("t1", "t2", (F.col("place") - F.col("at")).alias("start"), F.octet_length("context").cast("long").alias("length"), F.xxhash64("key", "at", "h1").alias("group"))
    totals = same.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max(1, MOST_GATHERED // 2))).cast("int").alias("nb"))
    alone = known.where(F.struct("t1", "t2", "place") == F.col("rep")).join(totals, "key")
    alone = alone.withColumn("block", F.pmod(F.xxhash64(*spot), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    near = near.unionByName(alone.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *spot, "context"))

    def solve(tables: list[pa.Table]) -> pa.RecordBatch | None:
        table = pa.concat_tables(tables).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        at = column("at")
        # Trees of one anchor's pairs of blocks are apart.
        key = mix64(column("key").view(np.uint64) + (column("lo").astype(np.uint64) << np.uint64(32)) + column("hi").astype(np.uint64)).view(np.int64)
        # An anchor at the border of two pieces of a long text has two rows, of the strings on either side: they differ in at.
        where = np.stack([column("t1"), column("t2").astype(np.int64), column("place"), at])
        order = np.lexsort((*where, key))
        new = np.ones(len(order), dtype=bool)  # a row that repeats is one occurrence
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(where[:, order], axis=1) != 0).any(axis=0)
        take = order[new]
        data, off = bytes_of(table.column("context").take(pa.array(take)).combine_chunks())
        entry, left, right, group = maximal_repeats(key[take], data, off, at[take], least, not hulls)
        if not len(entry):
            return None
        if hulls:
            order = np.argsort(entry, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(entry[order]) != 0]))
            left, right = np.maximum.reduceat(left[order], first), np.maximum.reduceat(right[order], first)
            entry, group = entry[order][first], group[order][first]
        rows = take[entry]
        return pa.RecordBatch.from_arrays([pa.array(where[0][rows]), pa.array(where[1][rows].astype(np.int32)), *[pa.array(x) for x in (where[2][rows], where[3][rows], where[2][rows] - left, left + right, group)]], names=["t1", "t2", "place", "at", "start", "length", "group"])

    def scan(batches: Batches) -> Batches:
        held, rows = [], 0
        for table in grouped(batches, 3):
            if table.num_rows < 2:
                continue
            if rows and rows + table.num_rows > 8000:
                if (got := solve(held)) is not None:
                    yield got
                held, rows = [], 0
            held.append(table)
            rows += table.num_rows
        if held and (got := solve(held)) is not None:
            yield got

    dealt = near.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = dealt.mapInArrow(task("repeats", scan, forget_powers), "t1 long, t2 int, place long, at long, start long, length long, group long")
    out = found.drop("place", "at").unionByName(whole)
    if hulls:
        return holding(out, same)
    # What the blocks say of the least occurrence of a context holds for all others of that context.
    others = known.where(F.struct("t1", "t2", "place") != F.col("rep")).select("rep.*", "at", F.col("t1").alias("u1"), F.col("t2").alias("u2"), F.col("place").alias("there"))
    echoes = found.join(others, spot).select(F.col("u1").alias("t1"), F.col("u2").alias("t2"), (F.col("start") + F.col("there") - F.col("place")).alias("start"), "length", "group")
    # A repeat's length may be seen shorter in one pair of blocks than in another.
    end = F.col("start") + F.col("length")
    out = out.unionByName(echoes).groupBy("t1", "t2", "group", end.alias("end")).agg(F.min("start").alias("start"))
    return holding(out.select("t1", "t2", "start", (F.col("end") - F.col("start")).alias("length"), "group"), same, context)


def merged(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes inside [start, end) ranges of a text of n bytes."""
    order = np.argsort(starts, kind="stable")
    s, e = np.maximum(starts[order], 0), np.minimum(ends[order], n)
    top = np.maximum.accumulate(e)
    new = np.concatenate([[True], s[1:] > top[:-1]])
    edge = np.flatnonzero(new)
    return s[edge], top[np.append(edge[1:], len(s)) - 1]


def removed(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), kept_text: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans array of (start, end), the columns named in keep
    and, if asked for, kept_text: every byte goes that is inside a string of `least` bytes starting anywhere else too.

    A text that another document equals goes whole if it has `least` bytes. A null text is an empty one; shorter texts
    lose nothing; rows with equal or null ids are rows of their own. kept_text leaves out the rest of a character
    that a cut goes through. An empty table gives no rows. Columns that aren't named in keep are not returned; the id and
    those in keep may not be named like one of the result.
    """
    prepare(docs.sparkSession)
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")
    if clash := [c for c in (id_col, *keep) if c.lower() in made]:
        raise ValueError(f"the columns {clash} have names of the result; rename them")
    source = _texts(docs, id_col, text_col)
    whole, context = contexts(source, least)
    groups = repeat_groups(docs, least, id_col, text_col, context, hulls=True)
    covers = stage(groups.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "repeat-covers")
    unstage(context, groups)
    full = whole.where("copies > 1").select("t1", "t2", F.lit(True).alias("full"))
    known = stage(covers.join(full, ["t1", "t2"], "full"), "repeat-known")
    unstage(covers, whole)
    extra = [c for c in keep if c != id_col]
    base = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(extra)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumns({"t1": F.xxhash64("_text"), "t2": F.hash("_text")})
    joined = base.join(known, ["t1", "t2"], "left").select("_text", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"), F.coalesce("full", F.lit(False)).alias("full"), "_id", *[f"_k{i}" for i in range(len(extra))])
    made = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("starts", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType()))]
    made += [("kept_text", T.StringType())] * kept_text
    schema = T.StructType([*joined.schema.fields[4:], *[T.StructField(*f) for f in made]])

    def finish(batches: Batches) -> Batches:
        for batch in batches:
            starts, lengths, full = (batch.column(i) for i in (1, 2, 3))
            for a, b in runs(batch.column(0), 8_000_000):
                rows = []
                for i in range(a, b):
                    text = batch.column(0)[i].as_py()
                    raw = text.encode("utf-8", "surrogatepass")
                    n = len(raw)
                    s = e = np.zeros(0, np.int64)
                    if full[i].as_py() and n >= least:
                        s, e = np.array([0]), np.array([n])
                    elif starts[i].is_valid:
                        s = starts[i].values.to_numpy()
                        s, e = merged(s, s + lengths[i].values.to_numpy(), n)
                    left = b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), n])) if len(s) else raw
                    rows.append([n, n - len(left), len(s), hashlib.sha256(left).hexdigest(), s.tolist(), e.tolist(), *([left.decode("utf-8", "ignore") if len(s) else text] * kept_text)])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[4:]], *[pa.array([r[k] for r in rows], kinds[k]) for k in range(len(made))]], names=schema.names)

    out = joined.mapInArrow(task("repeats", finish, forget_powers), schema)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    out = out.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(extra)], "n_bytes", "n_removed", "n_spans", "kept_sha256", spans.alias("spans"), *["kept_text"] * kept_text)
    return holding(out, known)
