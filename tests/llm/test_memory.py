"""What the pipeline's operators take of an executor and of the driver."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lexitide.llm import crf, graph, langid, mixing, ngram_join, packing
from lexitide.llm.common import small


def test_small_tables_need_no_python_workers(spark):
    rows = [("a", 1, [{"gap": 5, "edge": 2}]), (None, None, []), ("Ä", 1 << 40, None)]
    got = small(spark, rows, "m string, gap long, steps array<struct<gap: long, edge: int>>")
    assert [(r.m, r.gap, r.steps and [x.asDict() for x in r.steps]) for r in got.collect()] == rows
    assert got.schema.simpleString() == "struct<m:string,gap:bigint,steps:array<struct<gap:bigint,edge:int>>>"
    assert small(spark, [], "m string, gap long").collect() == []


def test_mix_and_pack_make_no_rows_of_python_objects(spark, monkeypatch):
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: made.append(out := create(self, *a, **b)) or out)
    docs = spark.range(60).select("id", (F.col("id") % 7 + 1).alias("size"), F.array(F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("sources"))
    taken, _ = mixing.mix(docs, {"s0": 3.0, "s1": 1.0, "s2": 2.0}, id_col="id")
    assert taken.count() == 60
    pieces = spark.range(60).select(F.col("id").alias("_row"), F.lit(0).alias("piece"), (F.col("id") % 9 + 1).alias("length"))
    assert packing.pack(pieces, 16).agg(F.sum("length")).first()[0] == sum(i % 9 + 1 for i in range(60))
    assert len(made) >= 3
    for df in made:
        assert "RDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_block_is_compared_in_a_few_bytes_a_pair():
    n = 1500
    rng = np.random.default_rng(3)
    sets = [np.unique(np.append(rng.integers(0, 1 << 62, 30), np.arange(10) + 10 * (i // 3)).astype(np.uint64)) for i in range(n)]
    for i in range(0, n, 100):
        sets[i + 1] = sets[i]
    tracemalloc.start()
    near = ngram_join.similar(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {tuple(x) for x in np.argwhere(near).tolist()} == {x for i in range(0, n, 100) for x in ((i, i + 1), (i + 1, i))}
    assert peak < 20 * n * n


def test_fitting_the_language_takes_little_of_the_driver():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnoprstuv", k=r.randint(4, 14))) for _ in range(30_000)]
    samples = [(" ".join(r.choices(words[k * 5000 : k * 5000 + 15_000], k=500)), f"l{k}") for k in range(4) for _ in range(300)]
    tracemalloc.start()
    model = langid.fit(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["l0", "l1", "l2", "l3"]
    assert peak < 120e6


def test_sums_of_weights_don_t_depend_on_how_many_are_held(monkeypatch):
    rng = np.random.default_rng(2)
    weights, counts = rng.normal(size=(50, 3)), rng.integers(1, 9, 40)
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = rng.integers(0, 50, starts[-1])
    want = np.array([weights[flat[a:b]].sum(axis=0) for a, b in zip(starts, starts[1:])])
    whole = crf.emissions(weights, flat, starts)
    assert np.allclose(whole, want)
    for held in (1, 5, 16):
        monkeypatch.setattr(crf, "HELD_FEATURES", held)
        assert (crf.emissions(weights, flat, starts) == whole).all()
    assert crf.emissions(weights, flat[:0], starts[:1]).shape == (0, 3)


def test_a_round_of_components_reads_its_links_once_for_each_use(spark, monkeypatch):
    scans = []
    stage = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [a#")) or stage(df, name))
    edges = spark.createDataFrame([(5, 3), (3, 1), (9, 5), (7, 8), (2, 2), (1, 9)], "a long, b long")
    got = {r.v: r.label for r in graph.components(edges).collect()}
    assert got == {1: 1, 3: 1, 5: 1, 9: 1, 7: 7, 8: 7}
    assert max(scans) <= 9  # what a round joins is used three times, each with three scans
