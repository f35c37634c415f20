"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexitide.llm import embedding_dedup, html_extract, langid, media, mixing, ngram_join, packing, queries, quality, repeats, sharding

DATA = "/root/testdata/sf0.001"
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v long, label string, t1 long"
LONG = "a long text of words that goes on, " * 20
ROWS = [(1, None, None, None, None, 1, None, 0), (2, "", "en", "s", 0, 1, "x", 0), (3, LONG, "en", "s", 0, 1, "x", 0), (3, LONG, "en", "s", 0, 1, "x", 0), (None, LONG + "more", "de", None, 0, 1, "x", 0), (5, "w " * 100_000, "de", "t", 0, 1, "x", 0), (6, " \n\t", "en", "t", 0, 1, "x", 0), (7, "short", "en", "t", 0, 1, "x", 0)]


def links_by_force(texts, threshold=0.8):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    near = {i: {j for j in sets if j != i and (sets[i] == sets[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= threshold)} for i in sets}
    return near, classes(near)


def classes(near):
    label = {i: i for i in near}
    for i in sorted(near):
        todo = [i]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if label[y] > label[i]:
                    label[y] = label[i]
                    todo.append(y)
    return label


def cuts_by_force(texts, least):
    seen = Counter(t[p : p + least] for _, t in texts for p in range(len(t) - least + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - least + 1):
            if seen[t[p : p + least]] > 1:
                gone[p : p + least] = True
        out.append((i, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_ngram_join(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    near, label = links_by_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op9_ngram_join(spark, DATA).collect()}
    assert got == {i: (label[i], len(near[i])) for i in near}


@pytest.mark.parametrize("most", [40_000, 2])
def test_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_GATHERED", most)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = cuts_by_force([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 200)
    got = [tuple(r) for r in queries.op6_repeats(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("piece", [300, 411])
def test_repeats_at_borders_of_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(repeats, "_PIECE", piece)
    rng = np.random.default_rng(8)
    make = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    docs = []
    for i in range(24):
        passage = make(200 + 7 * i)
        docs += [(2 * i, make(40 + 11 * i) + passage + make(300)), (2 * i + 1, make(250 + 23 * i) + passage + make(90))]
    got = [tuple(r) for r in repeats.removed(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted(cuts_by_force([(i, t.encode()) for i, t in docs], 200))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 32))
    rows = [(i, [float(x) for x in base[i % 300] + (i >= 300) * 0.2 * rng.normal(size=32)]) for i in range(500)]
    rows += [(900, rows[0][1]), (901, None), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, []), (None, rows[0][1])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows[:501]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    ids = [i for i, _ in rows[:501]]
    found = sum(got[i][0] - (i in (0, 900)) for i in ids)  # the row without an id is one more copy of the first
    assert 0.9 * true.sum() <= found <= true.sum() + 20
    assert [got[i][0] for i in (901, 902, 903, 904)] == [0] * 4 and got[None] == got[0] and got[900][1] == 0


@pytest.mark.parametrize("pivots", [800, 4096])
def test_embeddings_recall_at_many_pivots(spark, monkeypatch, pivots):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    drawn = rng.normal(size=(pivots, 64)).tolist()
    monkeypatch.setattr(embedding_dedup, "pivots_for", lambda *a, **k: drawn)
    x, z = unit(rng.normal(size=(1500, 64))), rng.normal(size=(1500, 64))
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(0.9, 0.92, (1500, 1))
    rows = [(i, v) for i, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]).tolist())]
    got = {r.vec_id: r.component_id for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[i + 1500] == i for i in range(1500)]) > 0.95


def test_mixing_quota(spark):
    assert mixing.quotas([10, 100], [3.0, 1.0], 60, 2.0) == [20.0, 40.0]
    out = queries.op1_mix(spark, "/root/testdata/sf0.01").toPandas()  # the smaller table has ten documents a source: too coarse
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.02 * by.target).all() and (out.taken <= 2 * out["size"]).all()


def test_mixing_passes_over_what_overshoots(spark):
    names = [f"s{k:02d}" for k in range(12)]
    rows = [(10_000 * k + i, 100 if i else 100_000, [s]) for k, s in enumerate(names) for i in range(2001)]
    out, plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, size long, sources array<string>"), dict.fromkeys(names, 1.0), share=1.25)
    taken = {r[0]: r[1] for r in out.groupBy(out.sources[0]).sum("taken").collect()}
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in zip(plan["sources"], plan["targets"]))


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = queries.op7_pack(spark, DATA).collect()
    by, full = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for p in by[r.doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in by[r.doc_id]) == len(ids)
    for parts in full.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 4096
    assert len(full) <= sum(r.length for r in rows) / 4096 * 1.02 + 2


def test_media_round_trip(spark):
    for kind in media.FORMATS:
        x = np.random.default_rng(2).integers(0, 256, (5, 64) if kind == "pgm" else (5, 64, 3)).astype(np.uint8)
        assert (media.decode(media.encode(x, kind)) == x).all()
    got = {r.doc_id: r for r in queries.op8_media(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        assert got[r.doc_id].payload_sha256 == hashlib.sha256(media.payload_of(r.text.encode())).hexdigest()


def test_sharding(spark):
    out = queries.op10_shard(spark, DATA).toPandas()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 2 * out["size"].max()


def test_quality_and_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    x = queries.op5_langid(spark, d).toPandas().merge(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (x[x.held_out].lang_pred == x[x.held_out].lang).mean() > 0.97
    x = queries.op2_quality(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    assert (x[x.held_out].predicted == x[x.held_out].quality).mean() > 0.95


@pytest.mark.parametrize("mark", ["-", "/", "_", ""])
def test_language_of_a_whole_long_word(mark):
    rng = np.random.default_rng(6)
    kinds = {"a": "abcdefg", "b": "tuvwxyz"}
    word = lambda lang: "".join(rng.choice(list(kinds[lang]), 6))
    model = langid.fit([(" ".join(word(lang) for _ in range(100)), lang) for lang in "ab" for _ in range(10)], chains=200)
    text = mark.join([word("a") for _ in range(9)] + [word("b") for _ in range(60)])
    got, _, share, _ = langid.score_texts(model, [text])
    assert got == ["b"] and 0.05 < share[0][0] < 0.25
    ids = [set(langid.features([w], {})[0].tolist()) for w in ("x" * 45 + "ung", "x" * 45 + "ing")]
    assert ids[0] != ids[1]
    whole = "".join(rng.choice(list("abcdef"), 300))
    runs = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    assert set.union(*(runs(p.strip("\n")) for p in langid.pieces(whole))) == runs(whole)


def test_html_names_behind_many_others():
    assert "c:sidebar" in html_extract.element_features("div", ' class="flex grid wide tall soft hard round dark sidebar"')


def test_html():
    m = html_extract.default_model(400)
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>One &amp; two\n three.</p></article><footer>&copy; us</footer><script>x()</script></body></html>"
    assert "\n".join(html_extract.main_blocks(m, page)) == "Title\nOne & two three."
    assert html_extract.main_blocks(m, "") == []


def test_awkward_tables(spark):
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        n = len(rows)
        assert ngram_join.join(docs).count() == n
        assert repeats.removed(docs).count() == n
        assert sorted({r.doc_id for r in packing.pack_documents(docs, PATH).collect()}, key=str) == sorted({r[0] for r in rows}, key=str)
        assert media.text_as_media(docs).count() == n
        assert langid.identify_documents(docs).count() == n
        assert quality.score(docs, quality.fit(np.zeros((0, 21)), np.zeros((0, 21)))).count() == n
        sized = queries.sized(docs)
        assert mixing.mix(sized.selectExpr("*", "array(source) as sources"), queries.weights_by_code_point(docs))[0].count() == n
        keyed = docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 8L as size", "xxhash64(text) as group_key", "xxhash64(doc_id) as order_key")
        assert sharding.shard(keyed).count() == n
    got = {r.doc_id: r for r in ngram_join.join(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[3].n_links == 2 and got[7].n_links == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = cp.near_copies(spark, docs, DATA)
    _, label = links_by_force([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))
    assert cp.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_near_copies_of_rows_without_ids_of_their_own(spark):
    import corpus_pipeline as cp

    texts = [" ".join(f"{k}{w}" for w in range(100)) for k in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (0, texts[0] + " more"), (None, texts[2]), (None, texts[2] + " more"), (5, texts[3]), (None, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text[:1]) for r in cp.near_copies(spark, docs, DATA).collect()]
    assert sorted(kept, key=str) == sorted([(0, "a"), (1, "b"), (None, "c"), (5, "d")], key=str)
