"""Queries on tables larger, or dealt otherwise, than the test tables."""

import duckdb

from lexitide import catalog_queries as cq


def test_upsert_where_parts_pass_a_million(spark, tmp_path):
    d = f"{tmp_path}"
    duckdb.sql(f"COPY (SELECT (i * 500000)::BIGINT + j AS p_partkey, 'a b' AS p_name, 'Brand#' || (i + 1) AS p_brand, 't' AS p_type, 9::INT AS p_size, 1.5 AS p_retailprice FROM range(5) x(i), range(8) y(j)) TO '{d}/part.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    got = cq.queries()["fwd_upsert"](spark, d)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(cq.oracle_sql()["fwd_upsert"]).fetchall())
    assert got.schema.simpleString() == "struct<oid:int,docid:int,brand_id:int,size:int>"


def odd_documents(folder):
    """Texts with ids that repeat, without words, words that repeat, and a word in each of 300 texts."""
    duckdb.sql(f"""COPY (SELECT i::BIGINT AS doc_id, 'The the for w' || i || ' ' || repeat('und-', i % 4) AS text, 'en' AS lang, 'src' || i % 2 AS source, 1 AS n_chars FROM range(300) t(i)
        UNION ALL VALUES (7, 'THE w7 x', 'en', 'src0', 1), (301, NULL, 'de', NULL, 1), (302, '--', NULL, 'src1', 1), (303, 'Ä the', NULL, NULL, 1)) TO '{folder}/documents.parquet'""")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return con


def test_words_are_counted_where_the_text_is(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = cq.words_of_texts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_an_index_of_many_ranges(spark, tmp_path, monkeypatch):
    from lexitide.sources import store

    monkeypatch.setattr(store, "RANGE_ROWS", 60)
    con, d = odd_documents(tmp_path), str(tmp_path)
    stored = store.load_inv(spark, cq.DOC, cq.doc_index(spark, d))
    assert stored.selectExpr("count(distinct _metadata.file_path)").first()[0] > 10  # the word `the` alone fills five
    of = stored.where("type = 0").selectExpr("word", "docid", "_metadata.file_path f").collect()
    files = sorted((min(x), max(x)) for x in [[(r.word, r.docid) for r in of if r.f == f] for f in {r.f for r in of}])
    assert all(a[1] < b[0] for a, b in zip(files, files[1:]))
    sql = cq.oracle_sql()
    for name in ("q_nested", "q_missing_and", "q_missing_term", "and2", "words_of_doc", "strategy_or", "type_stats"):
        want = con.sql(sql[name])
        assert sorted(tuple(r) for r in cq.queries()[name](spark, d).select(*want.columns).collect()) == sorted(want.fetchall()), name


def test_a_log_is_written_by_many_tasks_and_listed_once(spark, tmp_path):
    from pathlib import Path

    from lexitide.sources.mutation_log import read_log

    d, con = str(tmp_path), duckdb.connect()
    con.sql(f"COPY (SELECT i::BIGINT AS event_id, (i % 7)::BIGINT AS user_id, 'view' AS event_type, 1.5 AS value, '{{\"k\": 1}}' AS props FROM range(40000) t(i) WHERE i // 400 <> 50) TO '{d}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    tracker, sql = spark.sparkContext.statusTracker(), cq.oracle_sql()
    log = cq.log_files(spark, d)
    folder = Path(log.removeprefix("file://")).parent
    assert len(list(folder.glob("event.*"))) == 99 and not Path(f"{folder}-parts").exists()
    spark.sparkContext.setJobGroup("listed", "")
    lines = read_log(spark, log)
    assert not tracker.getJobIdsForGroup("listed")  # a glob of over 32 files was listed by a job
    spark.sparkContext.setJobGroup("other", "")
    (folder / "below").mkdir()
    (folder / "below" / "event.9999").write_text("not of this folder\n")
    assert read_log(spark, log).count() == lines.count() == 39600
    for name in ("log_source", "log_resume", "log_collect", "log_partition"):
        want = con.sql(sql[name])
        assert sorted(tuple(r) for r in cq.queries()[name](spark, d).select(*want.columns).collect()) == sorted(want.fetchall()), name


def test_sets_of_words_are_made_after_the_shuffle(spark):
    from lexitide.operators.tables import words_of_doc

    postings = spark.createDataFrame([(i % 3, 0, f"w{i % 5}", None) for i in range(30)] + [(1, 1, "w9", None), (None, 0, "a", None)], "docid int, type int, word string, payload binary")
    got = words_of_doc(postings)
    plan = got._jdf.queryExecution().executedPlan().toString()  # from the last step to the first
    assert plan.rindex("Aggregate") < plan.index("Exchange") and plan.count("Exchange") == 1
    assert {r.docid: r.words for r in got.collect()} == {0: ["w0", "w1", "w2", "w3", "w4"], 1: ["w0", "w1", "w2", "w3", "w4", "w9"], 2: ["w0", "w1", "w2", "w3", "w4"], None: ["a"]}
