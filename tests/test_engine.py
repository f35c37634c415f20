"""Parsing, replay, store and streaming, by small cases and by chance."""

import random

import pytest

from lexitide.catalog import Field, Inverted, Level
from lexitide.operators.replay import apply, empty, replay
from lexitide.plans.lowering import Term, explain, lower_joins, lower_masks
from lexitide.plans.query import Node, QueryError, flatten, parse, parse_rpn
from lexitide.sources.store import dump, load, pointer
from lexitide.streaming.ingest import ingest

GOODS = Level(2, "goods", (Field("brand_id", "int"), Field("price", "float", 2.5), Field("raw", "binary")), (Inverted(0, "term::"), Inverted(1, "cate::")))


@pytest.mark.parametrize("text,want", [("0-1|2", "(0-(1|2))"), ("0|1-2", "((0|1)-2)"), ("0|1&2", "(0|(1&2))"), ("0&1*2", "(0&(1*2))"), ("0-1-2", "((0-1)-2)"), ("0&1&2", "(0&1&2)"), ("1 2", "12"), ("(0)", "0"), ("", "")])
def test_precedence(text, want):
    assert explain(text, 20) == want


@pytest.mark.parametrize("text", ["()", "0(1)", "&0", "0&", "(0", "0)", "0&&1", "a", "0+1", "5", "0" * 4096, "-0"])
def test_bad_queries(text):
    with pytest.raises(QueryError):
        parse(text, 3)


def test_optional_and_postfix():
    assert parse_rpn("(0|1)&2-3") == ["0", "1", "|", "2", "&", "3", "-"]
    with pytest.raises(QueryError):
        parse("0*1", 2, optional=False)


def by_sets(node, lists):
    if node.op == "T":
        return lists[node.pos]
    first, *rest = (by_sets(c, lists) for c in node.children)
    for x in rest:
        first = first & x if node.op == "&" else first | x if node.op == "|" else first - x if node.op == "-" else first
    return first


def test_lowerings_agree(spark):
    r = random.Random(3)
    terms = [Term(f"w{i}", i % 2) for i in range(70)]
    lists = [{d for d in range(40) if r.random() < 0.4} for _ in terms]
    rows = [(d, t.type, t.word, None) for t, s in zip(terms, lists) for d in s]
    postings = spark.createDataFrame(rows, "docid int, type int, word string, payload binary").cache()

    def tree(depth):
        if not depth or r.random() < 0.2:
            return Node("T", pos=r.randrange(70))
        return Node(r.choice("&|-*"), (tree(depth - 1), tree(depth - 1)))

    for _ in range(6):
        node = flatten(tree(3))
        want = by_sets(node, lists)
        for lower in (lower_masks, lower_joins):
            got = [x.docid for x in lower(postings, terms, node).collect()]
            assert sorted(got) == sorted(want)


LINES = [
    '2\t0\t1\t{"brand_id": 5.7, "price": 1.5}\t{"0": ["a", "b"], "1": {"c": 0}, "7": ["x"]}',
    '2\t2\t1\t{"brand_id": "no", "price": null}',
    '2\t2\t2\t{"brand_id": 3}\t{"0": ["a", 5]}',
    '2\t2\t3\t{"raw": "%%"}\t{"0": ["a"]}',
    '2\t2\t4\t{"raw": "YWJj"}\t{"0": ["a"]}',
    "2\t1\t4\tignored\tignored\tignored",
    '2\t2\t4\t{"brand_id": 9}',
    '2\t2\t5\t{"brand_id": [1]}', '2\t9\t6\t{}', '9\t0\t6\t{}', '2\t0\t2147483648\t{}', '2\t0\t6', '2\t0\t6\t{bad', '2\t0\t6\t{"": 1}', '2\t0\t6\t{}\t{"0": ["z"]}\textra',
    '2\t0\t8\t{}\t{"0": ["' + "w" * 250 + '", "ok"]}',
]


def lines_of(spark, lines, file_no=0):
    return spark.createDataFrame([(file_no, i, x) for i, x in enumerate(lines)], "file_no int, line_no int, line string")


def content(state):
    forward = sorted((x.oid, x.brand_id, x.price, bytes(x.raw) if x.raw else None) for x in state.forward.collect())
    return forward, sorted((x.docid, x.type, x.word) for x in state.postings.collect())


WANT = ([(1, 5, 1.5, None), (4, 9, 2.5, None), (8, 0, 2.5, None)], [(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (8, 0, "ok")])


def test_replay(spark):
    assert content(replay(lines_of(spark, LINES), GOODS)) == WANT


def test_batches_agree_with_replay(spark):
    state = empty(spark, GOODS)
    for at in range(0, len(LINES), 5):
        state = apply(state, lines_of(spark, LINES[at : at + 5], at), GOODS)
    assert content(state) == WANT


def test_store_and_new_fields(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    dump(replay(lines_of(spark, LINES), GOODS), GOODS, root, (0, 15))
    assert content(load(spark, GOODS, root)) == WANT
    more = Level(2, "goods", (*GOODS.fields, Field("weight", "float", 0.5)), GOODS.inverted)
    assert {x.weight for x in load(spark, more, root).forward.collect()} == {0.5}
    with pytest.raises(ValueError):
        load(spark, Level(2, "goods", GOODS.fields[:1], GOODS.inverted), root)


def test_ingest(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for n, part in enumerate((LINES[:5], LINES[5:])):
        (log / f"event.{n}").write_text("\n".join(part) + "\n")
    root = f"file://{tmp_path}/state"
    ingest(spark, f"file://{log}", [GOODS], root).awaitTermination()
    assert content(load(spark, GOODS, root)) == WANT
    assert pointer(spark, root)["position"] == [1, 10]


def values_by_model(node, has, value):
    """(matches, value, matched terms) of a node for one document, from the leaves up."""
    if node.op == "T":
        return node.pos in has, value.get(node.pos, 0), {node.pos}
    parts = [values_by_model(c, has, value) for c in node.children]
    if node.op == "-":
        return parts[0][0] and not parts[1][0], *parts[0][1:]
    hit = any(p[0] for p in parts) if node.op == "|" else parts[0][0] if node.op == "*" else all(p[0] for p in parts)
    mine = [p for i, p in enumerate(parts) if p[0] or node.op == "&" or (node.op == "*" and i == 0)]
    return hit, sum(p[1] for p in mine), set().union(*(p[2] for p in mine)) if mine else set()


def test_scores_of_nested_queries(spark):
    from pyspark.sql import functions as F

    from lexitide.operators.sets import Strategy, scored

    r = random.Random(5)
    terms = [Term(f"w{i}", 0) for i in range(70)]
    docs = {d: {i: r.randint(1, 9) for i in range(70) if r.random() < 0.5} for d in range(30)}
    postings = spark.createDataFrame([(d, 0, f"w{i}", v) for d, m in docs.items() for i, v in m.items()], "docid int, type int, word string, payload int").cache()
    texts = ["(0&1)|2", "(0-1)|2", "0*1|2-3", "(0|1)&(2|3*4)-5", "(65|0)&(1-66)*69", "0&(1-(2|3))|4"]
    for text in texts:
        node = flatten(parse(text, 70))
        want = {}
        for d, m in docs.items():
            hit, value, bits = values_by_model(node, set(m), m)
            if hit:
                want[d] = (value, sum(1 << p for p in bits if p < 62), sum(1 << p - 62 for p in bits if p >= 62))
        got = scored(postings, text, terms, Strategy(lambda c: c.cast("long"))).collect()
        assert {x.docid: (x.score, x.matched, x.matched1 if "matched1" in x else 0) for x in got} == want, text


def write_log(folder, n, lines):
    (folder / f"event.{n}").write_text("\n".join(lines) + "\n")


def test_ingest_goes_on_after_compaction_and_ids_of_words_stay(spark, tmp_path):
    from lexitide.sources.store import load_dict
    from lexitide.streaming.ingest import compact

    log = tmp_path / "log"
    log.mkdir()
    root = f"file://{tmp_path}/state"
    batches = [['2\t0\t1\t{}\t{"0": ["a", "b"]}'], ['2\t0\t2\t{}\t{"0": ["c", "b"]}', "2\t1\t1"], ['2\t0\t3\t{}\t{"0": ["a", "d"]}']]
    ids = []
    for n, lines in enumerate(batches):
        write_log(log, n, lines)
        ingest(spark, f"file://{log}", [GOODS], root, base=False).awaitTermination()
        ids.append({r.word: r.id for r in load_dict(spark, GOODS, root).collect()})
        if n == 0:
            compact(spark, GOODS, root)
    assert [x.oid for x in load(spark, GOODS, root).forward.orderBy("oid").collect()] == [2, 3]
    assert content(load(spark, GOODS, root))[1] == [(2, 0, "b"), (2, 0, "c"), (3, 0, "a"), (3, 0, "d")]
    assert ids == [{"a": 1, "b": 2}, {"a": 1, "b": 2, "c": 3}, {"a": 1, "b": 2, "c": 3, "d": 4}]
    assert pointer(spark, root)["batch"] == 2


def test_one_pointer_for_all_levels(spark, tmp_path):
    from lexitide.sources.store import dump_all, recycle

    other = Level(9, "other", (Field("x", "int"),))
    root = f"file://{tmp_path}/both"
    lines = lines_of(spark, ['2\t0\t1\t{"brand_id": 1}', '9\t0\t7\t{"x": 2}'])
    states = {level: replay(lines, level) for level in (GOODS, other)}
    dump_all(states, root, (0, 1), 0)
    dump_all({GOODS: states[GOODS]}, root)
    now = pointer(spark, root)
    assert now["levels"] == {"L2_goods": 2, "L9_other": 1} and (now["position"], now["batch"]) == ([0, 1], 0)
    assert [(x.oid, x.x) for x in load(spark, other, root).forward.collect()] == [(7, 2)]
    dump_all({GOODS: states[GOODS]}, root)
    assert recycle(spark, root, keep=2) == ["L2_goods/v1"] and load(spark, GOODS, root).forward.count() == 1


def test_upkeep(spark, tmp_path):
    import time

    from lexitide.streaming.ingest import lag, lag_alarm, maintain, merge_due

    root = f"file://{tmp_path}/kept"
    assert lag(spark, root) is None and not lag_alarm(spark, root) and not merge_due(spark, root)
    dump(replay(lines_of(spark, LINES), GOODS), GOODS, root)
    assert maintain(spark, [GOODS], root) == {"merged": False, "recycled": []}
    assert maintain(spark, [GOODS], root, merge_interval=0)["merged"] and content(load(spark, GOODS, root)) == WANT
    assert pointer(spark, root)["version"] == 2 and not merge_due(spark, root)
    assert merge_due(spark, root, at=time.time() + 1801) and not lag_alarm(spark, root) and lag_alarm(spark, root, at=time.time() + 4 * 24 * 3600)


def test_base_log_drops_the_first_column(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    write_log(log, 0, ['1\t1\t0\t1\t{"id":1,"weight":0.9}', '2\t2\t0\t1000\t{"brand_id":100,"price":1899.9}\t{"0":{"phone":"","apple":""},"1":{"999":""}}', '3\t2\t2\t1000\t{"brand_id":100}\t{"0":["phone","apple"],"1":["999"]}'])
    merchant = Level(1, "merchant", (Field("id", "int"), Field("weight", "float", 2.7)))
    root = f"file://{tmp_path}/base"
    ingest(spark, f"file://{log}", [merchant, GOODS], root, base=True).awaitTermination()
    assert [(x.oid, x.id) for x in load(spark, merchant, root).forward.collect()] == [(1, 1)]
    state = load(spark, GOODS, root)
    assert content(state)[1] == [(1000, 0, "apple"), (1000, 0, "phone"), (1000, 1, "999")] and state.forward.first().brand_id == 100


def test_last_of_keys_that_repeat_and_messages(spark):
    level = Level(4, "m", (Field("k", "int"), Field("msg", "proto", message="struct<a:int,b:string>")), (Inverted(0, "t::"),))
    lines = ['4\t0\t1\t{"k": 1, "k": 2, "msg": {"a": 3, "b": "x", "c": 1}}', '4\t0\t2\t{"msg": "{\\"a\\": 4}"}', '4\t0\t3\t{"msg": 5}', '4\t0\t4\t{"msg": "no"}', '4\t0\t5\t{"k": "5"}', '4\t0\t6\t[1]', '4\t0\t7\t{}\t{"0": {"w": {"n": 1}}, "256": ["x"]}', '4\t0\t8\t{}\t{"0": ["a", null]}', '4\t0\t9\t{}\t{"0": []}']
    got = {x.oid: (x.k, tuple(x.msg) if x.msg else None) for x in replay(lines_of(spark, lines), level).forward.collect()}
    assert got == {1: (2, (3, "x")), 2: (0, (4, None)), 5: (0, None), 9: (0, None)}


def test_a_word_is_looked_up_without_reading_all(spark):
    from lexitide import catalog_queries as cq

    plan = cq.queries()["q_nested"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert plan.count("FileScan parquet") == 1 and "PartitionFilters: [" in plan and "In(word" in plan.replace("`", "") and "documents.parquet" not in plan


def test_bad_commands(spark):
    from lexitide.operators.tables import command

    postings = spark.createDataFrame([(1, 0, "a", None)], "docid int, type int, word string, payload binary")
    for line in ("", "print_list a", "print_list a 255", "drop a 0", "print_list a -1"):
        with pytest.raises(ValueError):
            command(postings, line)
    assert command(postings, "print_list_len b 0").first().length == 0
