"""Language of words and documents: a linear-chain conditional random field with affix, n-gram and lexicon features
labels every word of a text, code-switched or not, by forward-backward; a document's language has most of its words' mass."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import Batches, held_out, mix64, named, prepare, runs, task, trim, uniform

BITS = 16
#: Bytes, about, of words and their emissions that one Python worker keeps before it starts anew.
CACHE_BYTES = 16 << 20
#: Characters of a word that is one observation; a longer word is several.
LONG = 64
#: Words whose features are held at a time.
HELD_WORDS = 4_000
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LETTER = re.compile(r"[^\W\d_]")
_caches: dict[str, tuple[dict, list, list]] = {}


def bare(word: str) -> str:
    """The word in lower case without marks and digits at its ends; empty if it has no letter. A piece stays as it is."""
    if "\n" in word:
        return word if _LETTER.search(word) else ""
    return word.lower() if word.isalpha() else _EDGES.sub("", word).lower()


def pieces(word: str) -> list[str]:
    """A long word, bare, in pieces of at most LONG characters that share two with the next, so that no run of bytes is
    lost; a line feed, which no word holds, marks a side that is not the word's own end."""
    first = _LETTER.search(word)
    if first is None:
        return ["-"]
    word = word[first.start() : len(word) - _LETTER.search(word[::-1]).start()].lower()
    if len(word) <= LONG:
        return [word]
    return ["\n" * (a > 0) + word[a : a + LONG] + "\n" * (a + LONG < len(word)) for a in range(0, len(word) - 2, LONG - 2)]


def words_of(text: str) -> list[str]:
    """The words of a text between white space; long ones in pieces."""
    words = text.split()
    if words and max(map(len, words)) > LONG:
        return [x for w in words for x in (pieces(w) if len(w) > LONG else (w,))]
    return words


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, owner): hashed features of bare words, none for empty ones: runs of two and three bytes, beginnings of three
    to five, ends of three to six (the word's two edges count as bytes), and, behind the hashed ones, its place in the
    lexicon. A piece of a longer word has beginnings or ends only where the word has."""
    heard = np.array([k for k, w in enumerate(words) if w], dtype=np.int64)
    if not len(heard):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = [b"^" + w.encode() + b"$" if "\n" not in w else (b"^" * (w[0] != "\n") + w.strip("\n").encode() + b"$" * (w[-1] != "\n")) for w in words if w]
    opens = np.array([w[0] != "\n" for w in words if w], dtype=bool)
    closes = np.array([w[-1] != "\n" for w in words if w], dtype=bool)
    size = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(raw)), size)
    left = end[owner] - np.arange(len(data))  # bytes from here to the word's end

    def hashed(values: np.ndarray, kind: int) -> np.ndarray:
        return ((mix64(values + np.uint64((kind + 1) << 52))) >> np.uint64(64 - BITS)).astype(np.int64)

    ids, own = [], []
    wide = data
    for n in (2, 3):
        wide = wide[: len(data) - n + 1] | (data[n - 1 :] << np.uint64(8 * (n - 1)))
        inside = left[: len(wide)] >= n
        ids.append(hashed(wide[inside], n))
        own.append(owner[: len(wide)][inside])
    for n, kind, at in [(3, 11, start), (4, 12, start), (5, 13, start), *[(n, 20 + n, end - n) for n in (3, 4, 5, 6)]]:
        some = np.flatnonzero((size >= n) & (opens if kind < 20 else closes))
        value = np.zeros(len(some), np.uint64)
        for k in range(n):
            value |= data[at[some] + k] << np.uint64(8 * k)
        ids.append(hashed(value, kind))
        own.append(some)
    known = [(k, lexicon[words[h]]) for k, h in enumerate(heard.tolist()) if words[h] in lexicon]
    if known:
        ids.append(np.array([(1 << BITS) + x for _, x in known], dtype=np.int64))
        own.append(np.array([k for k, _ in known], dtype=np.int64))
    return np.concatenate(ids), heard[np.concatenate(own)]


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    chain: crf.Chain
    key: str


def fit(samples: list[tuple[str, str]], chains: int = 4000, length: int = 48, lexicon_size: int = 20_000, seed: int = 5) -> Model:
    """samples: (text, language). The lexicon is made of all words of the texts; `chains` runs of up to `length` words,
    drawn from anywhere in them, are what the field is fitted on. Chains mix runs of different languages, so that moves
    are learned."""
    rng = random.Random(seed)
    by: dict[str, list[list[str]]] = {}
    once: dict[str, str] = {}  # texts share one string for each word
    for text, lang in samples:
        words = [once.setdefault(w, w) for w in words_of(text)]
        if any(_LETTER.search(w) for w in words):
            by.setdefault(lang, []).append(words)
    languages = sorted(by)
    counts = Counter(bare(w) for texts in by.values() for words in texts for w in words)
    lexicon = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]) if n > 1 and w}
    seen: dict[str, int] = {}
    ids, labels = np.full((chains, length), -1), np.zeros((chains, length), dtype=np.int64)
    for c in range(chains if languages else 0):
        k = rng.randrange(len(languages))
        at, switch = 0, rng.random() < 0.35
        while at < length:
            words = rng.choice(by[languages[k]])
            run = min(length - at, rng.randint(4, 16) if switch else length)
            start = rng.randrange(max(1, len(words) - run + 1))
            for w in words[start : start + run]:
                ids[c, at], labels[c, at] = seen.setdefault(w, len(seen)), k
                at += 1
            if switch:
                k = rng.randrange(len(languages))
            elif rng.random() < 0.5:
                break
    by.clear(), once.clear(), counts.clear()
    n = (1 << BITS) + len(lexicon) + 1
    plain, parts, per_word = [bare(w) for w in seen], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(plain), HELD_WORDS):
        held = plain[a : a + HELD_WORDS]
        own_ids, owner = features(held, lexicon)
        mute = np.setdiff1d(np.arange(len(held)), owner)
        own_ids, owner = np.append(own_ids, np.full(len(mute), n - 1)), np.append(owner, mute)
        parts.append(own_ids[np.argsort(owner, kind="stable")])
        per_word.append(np.bincount(owner, minlength=len(held)))
    flat, starts = np.concatenate(parts), np.cumsum(np.concatenate([[0], *per_word])).astype(np.int64)
    del plain, parts
    seen.clear()
    chain = crf.train(flat, starts, ids, labels, n, max(1, len(languages))) if languages else crf.Chain(np.zeros((n, 1)), np.zeros((1, 1)), np.zeros(1))
    chain.weights[-1] = 0  # a word without letters says nothing
    del flat, starts, ids, labels
    trim()  # the driver would keep what fitting took
    return Model(languages, lexicon, chain, f"{zlib.crc32(chain.weights.tobytes()):08x}{len(lexicon)}")


def score_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, shares of each language and number of switches of each text, from marginals of every word."""
    K = len(model.languages)
    n = len(texts)
    if not K:
        return ["und"] * n, np.zeros(n), np.zeros((n, 0)), np.zeros(n, dtype=np.int64)
    if model.key not in _caches:
        _caches.clear()
        _caches[model.key] = ({}, [np.zeros((1, K))], [0])
    cache, tables, held = _caches[model.key]
    split = [words_of(t) for t in texts]
    seen: set[str] = set()
    for words in split:
        seen.update(words)
    new = list(seen.difference(cache))
    cost = lambda words: (200 + 8 * K) * len(words) + sum(map(len, words))
    if cache and held[0] + cost(new) > CACHE_BYTES:
        cache.clear()
        tables[:], held[0] = [np.zeros((1, K))], 0
        new = list(seen)
    held[0] += cost(new)
    base = sum(map(len, tables))
    cache.update(zip(new, range(base, base + len(new))))
    plain = [bare(w) for w in new]
    made = np.zeros((len(new), K))
    for a in range(0, len(new), HELD_WORDS):
        ids, own = features(plain[a : a + HELD_WORDS], model.lexicon)
        n_held = len(plain[a : a + HELD_WORDS])
        made[a : a + n_held] = np.stack([np.bincount(own, weights=model.chain.weights[ids, k], minlength=n_held) for k in range(K)], axis=1)
    made[np.array([not w for w in plain], dtype=bool)] = np.nan  # marks words without letters
    table = np.concatenate([*tables, made]) if len(new) else tables[0]
    tables[:] = [table]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    at = np.fromiter((i for words in split for i in map(cache.__getitem__, words)), dtype=np.int64, count=int(lengths.sum()))
    e = table[at]
    heard = ~np.isnan(e[:, 0]) if len(e) else np.zeros(0, dtype=bool)
    e = np.where(heard[:, None], e, 0.0)
    p = crf.marginals(np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e, lengths, model.chain.moves, model.chain.first)
    owner = np.repeat(np.arange(n), lengths)
    mass = np.stack([np.bincount(owner, weights=p[:, k] * heard, minlength=n) for k in range(K)], axis=1)
    words = np.bincount(owner, weights=heard, minlength=n)
    share = mass / np.maximum(words, 1)[:, None]
    best = share.argmax(axis=1)
    if len(p):
        tag, who = p.argmax(axis=1)[heard], owner[heard]
        switches = np.bincount(who[1:][(tag[1:] != tag[:-1]) & (who[1:] == who[:-1])], minlength=n)
    else:
        switches = np.zeros(n, dtype=np.int64)
    return [model.languages[b] if w else "und" for b, w in zip(best.tolist(), words.tolist())], np.where(words > 0, share.max(axis=1), 0.0).clip(0, 1), share, switches


def sample(docs: DataFrame, learn: Column, per_language: int = 400, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """About per_language (text, language) rows of each language, whole texts, by the hash of the id: the bound on what
    is fitted. One row a language is broadcast."""
    known = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"))
    share = F.broadcast(known.groupBy("lang").agg((F.lit(per_language) / F.count("*")).alias("share")))
    rows = known.join(share, "lang").where(uniform("id", seed=3) < F.col("share")).select("text", "lang", "id").collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[1], str(r[2]), r[0]))]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred string, score double, shares array<double> (by model.languages), switches long added; they
    take the place of columns of these names.

    A text that is null or has no letter is `und` with score 0; so is every text if nothing was learned. Each row is
    judged alone by its whole text, words of over LONG characters in pieces that each count as a word; no shuffle. Of
    languages with equal shares the first by name counts. Equal rows get equal results; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = named(docs, "lang_pred", "score", "shares", "switches", needs=(text_col,))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("switches", T.LongType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the features' number

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for a, b in runs(column, 250_000):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                lang, score, shares, switches = score_texts(shipped.value, texts)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns], pa.array(lang), pa.array(score), pa.array(shares.tolist(), pa.list_(pa.float64())), pa.array(switches, pa.int64())], names=schema.names)

    return docs.mapInArrow(task("langid", run, _caches.clear), schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id with lang_pred, score, shares and switches: learned from rows of documents with a text, a lang and an id
    whose crc32(doc_id) mod 5 is not 0; only the text is an input. Null and empty texts are `und`; rows with equal or
    null ids are rows of their own; an empty table, or one without a lang, teaches nothing, and all it has is `und`."""
    model = fit(sample(docs, ~held_out()))
    return identify(docs.select("doc_id", "text"), model)
