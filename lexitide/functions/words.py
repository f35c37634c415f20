"""The words of texts and their counts, in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa

#: The schema of postings with the range that they are stored in.
RANGED = "docid int, type int, word string, payload binary, range int"
_ARROW = pa.schema([("docid", pa.int32()), ("type", pa.int32()), ("word", pa.string()), ("payload", pa.binary()), ("range", pa.int32())])
_WORD = re.compile("[a-z0-9]+")
#: Rows of a batch that is given back.
_ROWS = 50_000


def posting_maker(cuts: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (docid, text in small letters, word of type 1, word of type 2, ...) to RANGED: each word of a text once,
    with its count as 8 digits, then the other words, without a payload. range: how many of the cuts (type, word, docid) a
    posting isn't before. A task holds a batch of texts and _ROWS postings, whatever its share of the documents."""
    heads = [c[:2] for c in cuts]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in _ARROW]
        docids, kinds, words, payloads, at = columns
        known: dict[tuple, int] = {}  # the ranges of words that no cut divides, emptied with each batch

        def range_of(kind: int, word: str, docid: int | None) -> int:
            n = known.get((kind, word))
            if n is None:
                n = bisect_right(heads, (kind, word))
                if n and heads[n - 1] == (kind, word):
                    return bisect_right(cuts, (kind, word, -(1 << 31) if docid is None else docid))
                known[kind, word] = n
            return n

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            known.clear()
            others = [c.to_pylist() for c in batch.columns[2:]]
            for i, (docid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                found = Counter(_WORD.findall(text.as_py() or ""))
                words.extend(found)
                kinds.extend(repeat(0, len(found)))
                payloads.extend(b"%08d" % n for n in found.values())
                at.extend(range_of(0, w, docid) for w in found)
                for kind, column in enumerate(others, 1):
                    if column[i] is not None:
                        words.append(column[i])
                        kinds.append(kind)
                        payloads.append(None)
                        at.append(range_of(kind, column[i], docid))
                docids.extend(repeat(docid, len(words) - len(docids)))
                if len(words) >= _ROWS:
                    yield made()
        if words:
            yield made()

    return make
