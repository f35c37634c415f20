"""Set operators on lists of documents (docid, each once), the parts of an index that is kept as base, inserts and deletes,
and scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.plans.lowering import MASK_BITS, Term, has_bit, hits, masks, matches
from lexitide.plans.query import Node, flatten, parse


def array_source(spark: SparkSession, docids: list[int]) -> DataFrame:
    """A list given in the program."""
    return spark.createDataFrame([(int(d),) for d in docids], "docid int").distinct()


def and2(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("docid").join(right.select("docid"), "docid", "left_semi")


def or2(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("docid").unionByName(right.select("docid")).distinct()


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """left without the documents of right; what left says of a document stays."""
    return left.join(right.select("docid"), "docid", "left_anti")


def and_n(lists: list[DataFrame]) -> DataFrame:
    """Documents in all lists: one aggregation, not a chain of joins."""
    each = [x.select("docid") for x in lists]
    return reduce(DataFrame.unionByName, each).groupBy("docid").agg(F.count("*").alias("n")).where(F.col("n") == len(lists)).select("docid")


def or_n(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select("docid") for x in lists]).distinct()


def req_opt(required: DataFrame, optional: DataFrame) -> DataFrame:
    """All of required, with opt_hit: whether optional has the document too."""
    return required.select("docid").join(optional.select("docid").withColumn("opt_hit", F.lit(True)), "docid", "left").withColumn("opt_hit", F.coalesce("opt_hit", F.lit(False)))


def add_scan(added: DataFrame) -> DataFrame:
    """Inserts that aren't merged yet: the last one of a document counts. added: docid, seq and a payload."""
    return added.groupBy("docid").agg(F.max_by("payload", "seq").alias("payload"))


def del_scan(deleted: DataFrame) -> DataFrame:
    """Deletes that aren't merged yet; they carry no data."""
    return deleted.select("docid").distinct()


def lsm_merge(base: DataFrame, added: DataFrame, deleted: DataFrame, keys: tuple[str, ...] = ("docid",)) -> DataFrame:
    """(base - deleted) with added; of a key in both, the added row counts."""
    rest = base.join(deleted.select(*keys).distinct(), list(keys), "left_anti").join(added.select(*keys).distinct(), list(keys), "left_anti")
    return rest.unionByName(added)


def lsm_merge_ts(base: DataFrame | None, added: DataFrame | None, deleted: DataFrame | None) -> DataFrame:
    """The same by the parts that there are: base or added, with the added row first, without deleted. It agrees with
    lsm_merge() where an insert takes back the delete before it and a delete the insert."""
    if base is None and added is None:
        raise ValueError("neither a base nor inserts")
    out = added if base is None else base if added is None else base.join(added.select("docid"), "docid", "left_anti").unionByName(added)
    return out if deleted is None else diff(out, deleted)


def _sum(values: list[Column]) -> Column:
    return reduce(Column.__add__, values)


@dataclass(frozen=True)
class Strategy:
    """How a hit is scored. work: from the payload of a list's hit to its value; and_work and or_work: from the values of
    the children that match to that of the node, in the order of the query text; a child that doesn't match is null to
    or_work, as is the optional side of `*` to and_work. weight: from the value of the whole to the score."""

    work: Callable[[Column], Column]
    and_work: Callable[[list[Column]], Column] = lambda values: _sum([F.coalesce(v, F.lit(0)) for v in values])
    or_work: Callable[[list[Column]], Column] = lambda values: _sum([F.coalesce(v, F.lit(0)) for v in values])
    weight: Callable[[Column], Column] = lambda value: value


#: Every hit weighs nothing.
DUMMY = Strategy(lambda payload: F.lit(0).cast("long"))


def evaluated(node: Node, strategy: Strategy, term: Callable[[int], Column]) -> Column:
    """The value of a node for a document that it matches: children that don't match take no part, nor does the right side
    of a difference."""
    if node.op == "T":
        return term(node.pos)
    first = evaluated(node.children[0], strategy, term)
    if node.op == "-":
        return first
    maybe = lambda c: F.when(matches(c, has_bit), evaluated(c, strategy, term))
    if node.op == "|":
        return strategy.or_work([maybe(c) for c in node.children])
    rest = [maybe(c) if node.op == "*" else evaluated(c, strategy, term) for c in node.children[1:]]
    return strategy.and_work([first, *rest])


def took_part(node: Node, mask: int) -> Column:
    """The bits of one mask: the terms whose values reached the document's."""
    if node.op == "T":
        return F.lit(1 << node.pos % MASK_BITS if node.pos // MASK_BITS == mask else 0).cast("long")
    if node.op == "-":
        return took_part(node.children[0], mask)
    none = F.lit(0).cast("long")
    sure = 0 if node.op == "|" else 1 if node.op == "*" else len(node.children)
    return reduce(Column.bitwiseOR, [took_part(c, mask) if i < sure else F.when(matches(c, has_bit), took_part(c, mask)).otherwise(none) for i, c in enumerate(node.children)])


def scored(postings: DataFrame, text: str, terms: list[Term], strategy: Strategy) -> DataFrame:
    """(docid, matched, score) of the documents that a query finds: matched has bit k for term k if its value took part;
    terms behind the first 62 have theirs in matched1, matched2, ... One aggregation gives each document a row with its
    terms and their values; the tree is evaluated on that row from the leaves up."""
    node = parse(text, len(terms))
    if node is None:
        return postings.select("docid", F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score")).limit(0)
    node = flatten(node)
    used = node.terms()
    found = hits(postings, terms, used).groupBy("docid").agg(*masks(used), F.map_from_entries(F.collect_list(F.struct("pos", strategy.work(F.col("payload")).alias("v")))).alias("_v"))
    score = strategy.weight(evaluated(node, strategy, lambda p: F.col("_v")[p]))
    bits = [took_part(node, i).alias(f"matched{i or ''}") for i in range(max(used) // MASK_BITS + 1)]
    return found.where(matches(node, has_bit)).select("docid", *bits, score.alias("score"))
