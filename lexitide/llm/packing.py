"""Best-fit packing by a configuration linear program over the length histogram: multiplicative weights price the
lengths, a knapsack dynamic program finds the best configurations, the solution is rounded down and the rest is
filled best fit first. Everything on the driver is bounded by the sequence length, not by the data."""

from __future__ import annotations

import gc
import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterable
from functools import cached_property
from itertools import compress
from operator import not_
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, apart, bytes_of, holding, named, prepare, settle, small, stage, task, trim, unstage

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first

#: Bytes, about, that each of a worker's caches takes before it turns old and the older one is let go, and what a piece
#: takes beside two bytes a character, as measured.
CACHE_BYTES, PIECE_BYTES = 16 << 20, 115
#: Bytes of Arrow batches that are cut at a time: the more, the fewer distinct pieces.
HELD_BYTES = 3 << 20
#: What the tokenizer takes as pieces. Arrow sets the pieces that are no letters apart, by classes that agree with those of
#: the tokenizer for PLAIN characters; lower case is all that normalizing makes of these, whatever stands beside them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
APART = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\v\x{85}\p{Z}\p{L}\p{N}]+"
PLAIN = ((0x0, 0x1B), (0x20, 0x12F), (0x131, 0x2FF), (0x388, 0x38A), (0x38C, 0x38C), (0x38E, 0x3A1), (0x3A3, 0x482), (0x48A, 0x52F), (0x531, 0x556), (0x5D0, 0x5EA), (0x600, 0x60F), (0x61B, 0x64A), (0x660, 0x66F), (0x671, 0x6D5), (0x10D0, 0x10FF), (0x1E00, 0x1EFF), (0x2000, 0x2064), (0x20A0, 0x20C0), (0x2100, 0x218B), (0x2190, 0x2328), (0x2460, 0x2ADB), (0x3000, 0x3029), (0x3030, 0x303F), (0x3041, 0x3096), (0x309B, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFFBE))
#: Texts that Arrow does not cut: other characters, or what may be a special token.
ODD = r"<\||[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in PLAIN) + "]"
_encoders: dict[str, "Encoder"] = {}


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each capacity the best value, and the index of the length to take there (-1: leave one token empty)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = value[:k] + best[c - lengths[:k]]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], take[c] = got[i], i
    return best, take


def solve(counts: dict[int, int], capacity: int, rounds: int = 80, at_once: int = 48, eps: float = 0.25) -> list[tuple[Config, int]]:
    """Configurations and how often each is used; together they hold exactly the counted lengths."""
    counts = {l: n for l, n in counts.items() if n > 0}
    if any(l < 1 or l > capacity for l in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    left = dict(counts)
    plan: list[tuple[Config, int]] = []
    if n := left.pop(capacity, 0):
        plan.append((((capacity, 1),), n))
    lengths = np.array(sorted(left), dtype=np.int64)
    n = np.array([left[l] for l in lengths.tolist()], dtype=float)
    x: dict[Config, float] = {}
    if len(lengths) > 1:
        covered = np.zeros(len(lengths))
        for _ in range(rounds):
            share = covered / n
            value = lengths / capacity * np.exp(-(share - share.min()) / eps)
            _, take = price(lengths, value, capacity)
            for i in np.argsort(share, kind="stable")[:at_once].tolist():
                used = {i: 1}
                c = capacity - int(lengths[i])
                while c > 0:
                    j = int(take[c])
                    if j < 0:
                        c -= 1
                        continue
                    used[j] = used.get(j, 0) + 1
                    c -= int(lengths[j])
                ids = np.fromiter(used, dtype=np.int64)
                many = np.fromiter(used.values(), dtype=float)
                step = eps * float((n[ids] / many).min())
                covered[ids] += step * many
                key = tuple(sorted(((int(lengths[j]), k) for j, k in used.items()), reverse=True))
                x[key] = x.get(key, 0.0) + step
            if (covered >= n).all():
                break
        scale = 1.0 / max(1e-9, float((covered * lengths).sum() / (n * lengths).sum()))
        for key, v in sorted(x.items(), key=lambda kv: (-sum(l * k for l, k in kv[0]), -kv[1], kv[0])):
            times = min(int(v * min(scale, 1.0)), min(left[l] // k for l, k in key))
            if times > 0:
                plan.append((key, times))
                for l, k in key:
                    left[l] -= k * times
    rest = [l for l in lengths.tolist() if left[l] > 0]
    while rest:
        used: dict[int, int] = {}
        room, at = capacity, len(rest) - 1
        while at >= 0 and room > 0:
            l = rest[at]
            if l > room:
                at = bisect_right(rest, room, 0, at) - 1
                continue
            k = min(left[l], room // l)
            used[l] = k
            room -= k * l
            at -= 1
        times = max(1, min(left[l] // k for l, k in used.items()))
        plan.append((tuple(sorted(used.items(), reverse=True)), times))
        for l, k in used.items():
            left[l] -= k * times
        rest = [l for l in rest if left[l] > 0] if any(left[l] == 0 for l in used) else rest
    return plan


class Placement:
    """Where the r-th piece of each length goes."""

    def __init__(self, plan: list[tuple[Config, int]]):
        used: dict[int, int] = {}
        rows, first = [], 0
        for config, times in plan:
            at = 0
            for l, k in config:
                rows.append((l, used.get(l, 0), k, first, at))
                used[l] = used.get(l, 0) + k * times
                at += l * k
            first += times
        rows.sort()
        self.sequences = first
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 48) + table[:, 1]
        self.table = table

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        l, r0, k, first, at = self.table[np.searchsorted(self.key, (length << 48) + rank, "right") - 1].T
        copy, i = np.divmod(rank - r0, k)
        return first + copy, at + i * length


class Cache:
    """Values by piece or word, those of late: a young table and the one that was young before it."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def missing(self, pieces: list[str]) -> list[str]:
        """Those of the pieces, which are distinct, that neither table has; those of the old one become young again."""
        new = list(compress(pieces, map(not_, map(self.young.__contains__, pieces))))
        if self.old and new:
            back = [p for p in new if p in self.old]
            self.put(back, map(self.old.__getitem__, back))
            new = [p for p in new if p not in self.young]
        return new

    def put(self, pieces: list[str], values: Iterable[bytes]) -> None:
        self.young.update(zip(pieces, values))
        self.held += PIECE_BYTES * len(pieces) + 2 * sum(map(len, pieces))

    def turn(self) -> None:
        """To be called when no value is needed any more."""
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0


class Encoder:
    """Ids of texts by a tokenizer of the `tokenizers` library that lower-cases, cuts texts into pieces by the pattern
    PATTERN and ends pieces by </w>. Arrow cuts a whole batch at once and leaves each distinct piece to Python, which
    has those of late in a cache. Texts with characters beyond PLAIN are cut at white space, and their words are normalized
    and cut by the tokenizer's own rules; those have a cache of their own."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.path = path
        self.parts = Tokenizer.from_file(path)
        self.normalizer = self.parts.normalizer
        spec = json.loads(Path(path).read_text())
        cut = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.rule = pre_tokenizers.Split(Regex(cut[0]), "removed", invert=True)
        kinds = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        self.odd = ODD if (kinds, cut) == (["NFC", "Replace", "Lowercase"], [PATTERN]) else ""  # by other rules every text is odd
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        vocab = self.parts.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.pieces = Cache(), Cache()

    @cached_property
    def whole(self):
        """The tokenizer as it is, for what can't be cut into words."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def rest(self) -> None:
        """Between tasks only the younger caches stay."""
        self.words.old, self.pieces.old = {}, {}

    def ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 512):
            some = new[i : i + 512]
            got = np.array(self.parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[got]) + 1).tolist()
            if len(cuts) == len(some):
                raw = got.tobytes()
                self.pieces.put(some, [raw[4 * a : 4 * b] for a, b in zip([0, *cuts], cuts)])
            else:
                self.pieces.put(some, [np.array(self.parts.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in some])

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, of which one may be empty."""
        self.learn([p for p in self.pieces.missing(pieces) if p])
        have = self.pieces.young
        return [have[p] if p else b"" for p in pieces]

    def cut_by_arrow(self, texts: pa.Array) -> list[bytes]:
        words = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \0 "))
        coded = words.values.dictionary_encode()
        data, at = bytes_of(pa.array(self.known(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices))
        at = at[words.offsets.to_numpy()].tolist()
        return [data[a:b].tobytes() for a, b in zip(at, at[1:])]

    def learn_words(self, new: list[str]) -> None:
        plain = [w for w in new if "<|" not in w]
        normal = self.normalizer.normalize_str(" ".join(plain)).split(" ")
        if len(normal) != len(plain):
            plain, normal = [], []
        found = self.rule.pre_tokenize_str(" ".join(normal))
        split: list[list[str]] = [[] for _ in normal]
        ends = np.cumsum([len(w) + 1 for w in normal])
        for i, (p, _) in zip(np.searchsorted(ends, [a for _, (a, _) in found], "right").tolist(), found):
            split[i].append(p)
        pieces = list({p for ps in split for p in ps})
        have = dict(zip(pieces, self.known(pieces)))
        self.words.put(plain, [have[ps[0]] if len(ps) == 1 else b"".join([have[p] for p in ps]) for ps in split])
        if len(plain) < len(new):
            rest = [w for w in new if w not in self.words.young]
            self.words.put(rest, map(self.ids, rest))

    def cut_by_rule(self, texts: list[str]) -> list[bytes]:
        split = [None if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        self.learn_words(self.words.missing(list({w for words in split for w in words or ()})))
        known = self.words.young.__getitem__
        return [self.ids(t) if words is None else b"".join(map(known, words)) for t, words in zip(texts, split)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers, as the tokenizer gives them for the whole text."""
        texts = texts.cast(pa.large_string())  # what is made of a text may be longer than 2 GB
        odd = pc.match_substring_regex(texts, self.odd)
        plain = iter(self.cut_by_arrow(texts.filter(pc.invert(odd))))
        rest = iter(self.cut_by_rule(texts.filter(odd).to_pylist()))
        self.words.turn()
        self.pieces.turn()
        return [next(rest if x else plain) for x in odd.to_pylist()]


def token_bytes(path: str, texts: pa.Array) -> list[bytes]:
    """The ids of each text; encoders stay with their worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        trim()  # else what it was read from takes room until the task ends
    return _encoders[path].encode(texts)


def gathered(batches: Batches) -> Batches:
    """The rows of batches in order, in batches of HELD_BYTES at least, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens of each document's ids and the end id: the id, _row, piece, start, length and
    ids_crc32. A null text is an empty one, of one piece with the end id alone; _row tells rows apart whose ids are equal.
    Only the id and the text are used; the id may not be named like one of the others."""
    prepare(docs.sparkSession)
    named(docs, "_row", *T._parse_datatype_string(PIECES).names, needs=(id_col,))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("_row", T.LongType()), *T._parse_datatype_string(PIECES).fields])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Batches) -> Batches:
        for batch in gathered(batches):
            gc.disable()  # caches of words hold no cycles, and walking them again and again is a third of the time
            owner, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(token_bytes(tokenizer_path, batch.column(2))):
                raw += end
                for j, a in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[a : a + 4 * capacity]
                    owner.append(i), piece.append(j), start.append(a // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
            take = pa.array(owner, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)
        if tokenizer_path in _encoders:
            _encoders[tokenizer_path].rest()

    return docs.select(id_col, F.monotonically_increasing_id().alias("_row"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(task("packing", run, _encoders.clear), schema)


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", order: tuple[str, ...] = ("_row", "piece"), rounds: int = 80) -> DataFrame:
    """pieces with sequence_id long and offset long added (in place of columns of these names): as few sequences of
    capacity tokens as the rounded program finds, each filled without gaps from 0.

    Only the histogram (at most capacity rows) reaches the driver. Pieces of one length are numbered in salted groups,
    so a length that many copies share is split over tasks; those that agree in all columns of order are exchangeable.
    Lengths must be from 1 to capacity, null is an error. No rows give no rows.
    """
    spark = prepare(pieces.sparkSession)
    pieces = named(pieces, "sequence_id", "offset", needs=(length_col, *order))
    l, salts, salt, rn, before, at = apart(pieces, "_l", "_salts", "_salt", "_rn", "_before", "_at")
    kept = stage(pieces, "pack-pieces")
    hist = {r[0]: int(r[1]) for r in kept.groupBy(length_col).count().collect()}
    if None in hist:
        raise ValueError("a length is null")
    where = Placement(solve(hist, capacity, rounds))
    group = min(100_000, max(64, sum(hist.values()) // 1000))
    table = small(spark, [(int(x), -(-n // group)) for x, n in hist.items()], f"{l} long, {salts} int")  # at most capacity rows
    dealt = kept.join(F.broadcast(table), kept[length_col] == F.col(l)).withColumn(salt, F.pmod(F.xxhash64(*order), F.col(salts)).cast("int")).drop(l, salts)
    numbered = stage(dealt.withColumn(rn, F.row_number().over(Window.partitionBy(length_col, salt).orderBy(*order)) - 1), "pack-numbered")
    unstage(kept)
    sums = numbered.groupBy(length_col, salt).agg(F.count("*").alias(rn))
    sums = sums.withColumn(before, F.sum(rn).over(Window.partitionBy(length_col).orderBy(salt)) - F.col(rn)).select(length_col, salt, before)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, o = where.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": s, "offset": o})

    ranked = numbered.join(sums, [length_col, salt])
    out = ranked.withColumn(at, place(F.col(length_col), F.col(rn) + F.col(before))).select(*pieces.columns, f"{at}.sequence_id", f"{at}.offset")
    return settle(out, "packed", numbered)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, sequence_id and offset. A null text is an empty one, of one
    piece with the end id alone; rows with equal or null ids are documents of their own; an empty table gives no rows."""
    out = pack(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
    return holding(out.drop("_row"), out)
