"""The encoder of op7 against the whole tokenizer, and what it keeps."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lexitide.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def whole(encoder, texts):
    return [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.whole.encode_batch_fast(texts, add_special_tokens=False)]


def agree(encoder, texts):
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        assert [x for x, got, want in zip(some, encoder.encode(pa.array(some, pa.string())), whole(encoder, some)) if got != want] == []


def test_every_plain_character_is_cut_as_by_the_tokenizer(encoder):
    agree(encoder, [f"Za{c}b1{c}.{c} 's{c}s '{c}{c.upper()}" for a, b in packing.PLAIN for c in map(chr, range(a, b + 1))])


def test_newer_letters_are_cut_as_by_the_tokenizer(encoder):
    agree(encoder, [f"Za{chr(c)}b1{chr(c)}.{chr(c)} '" for c in [0x558, 0x208F, 0xA7E2, 0x10944, 0x1C89, 0x105C0, 0x130, 0x301, 0x1161]])


def test_awkward_texts_are_cut_as_by_the_tokenizer(encoder):
    some = "aAbB'sStTrReEvVmMlLdD019.,!?-#|< >\n\t\r\x0b\x0c\x85\xa0 　éÉßñıİſΣςσ́̈각ᆨ中あ"
    rnd = random.Random(5)
    agree(encoder, ["".join(rnd.choices(some[: rnd.choice((30, len(some)))], k=rnd.randrange(60))) for _ in range(4000)])
    agree(encoder, ["", " ", "\n", "<|endoftext|>", "a<|endoftext|>b", "<|x", "\x1c", "a\x1cb", "''s", "'S'", "a" * 5000, "1" * 5000, "." * 5000, "\x00a", "\xa0a "])
    assert encoder.encode(pa.array([], pa.string())) == []
    assert encoder.encode(pa.array(["x a", "Hello"]).slice(1)) == whole(encoder, ["Hello"])


def test_forms_of_a_word_share_what_is_cached():
    own = packing.Encoder(PATH)
    marks = ("", ".", ",", "!", "?", ";", ":", "...", "'s", "|")
    own.encode(pa.array([f"{w}{m}" for i in range(50) for m in marks for w in (f"word{'x' * i}", f"Word{'x' * i}", f"WORD{'X' * i}")]))
    assert sum(len(c.young) + len(c.old) for c in vars(own).values() if isinstance(c, packing.Cache)) <= 50 + len(marks)


def test_batches_are_gathered_in_order_and_whole():
    parts = [pa.record_batch([pa.array(range(a, a + n), pa.int64())], ["i"]) for a, n in ((0, 5), (5, 0), (5, 300_000), (300_005, 200_000), (500_005, 400_000), (900_005, 1))]
    got = list(packing.gathered(iter(parts)))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(900_006))
    assert len(got) == 3 and all(b.nbytes >= packing.HELD_BYTES for b in got[:-1])
    assert list(packing.gathered(iter([]))) == []
