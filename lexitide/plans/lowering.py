"""From query trees to DataFrames over postings (docid, type, word, payload)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .query import Node, flatten, parse

#: Terms that one mask holds.
MASK_BITS = 62


@dataclass(frozen=True)
class Term:
    word: str | None
    type: int


def _term_table(spark: SparkSession, terms: list[Term], used: set[int]) -> DataFrame:
    rows = [(t.type, t.word, i) for i, t in enumerate(terms) if i in used and t.word is not None]
    return spark.createDataFrame(rows, "type int, word string, pos int")


def term_lookup(postings: DataFrame, word: str | None, kind: int) -> DataFrame:
    """docid of every document with the word; none for a null or unknown word or type. A document has a word once. Over
    stored postings the filter reaches the scan: it prunes folders by type, and row groups and pages by word."""
    return postings.where((F.col("type") == kind) & (F.col("word") == F.lit(word))).select("docid")


def hits(postings: DataFrame, terms: list[Term], used: set[int]) -> DataFrame:
    """(docid, pos, payload) of the used terms: one filtered scan, joined with the few terms of the query."""
    wanted = sorted({(t.type, t.word) for i, t in enumerate(terms) if i in used and t.word is not None})
    keep = F.lit(False)
    for kind in sorted({k for k, _ in wanted}):
        keep = keep | ((F.col("type") == kind) & F.col("word").isin([w for k, w in wanted if k == kind]))
    table = F.broadcast(_term_table(postings.sparkSession, terms, used))  # as many rows as the query has terms
    return postings.where(keep).join(table, ["type", "word"]).select("docid", "pos", "payload")


def mask_of(pos: Column) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), pos % MASK_BITS) if isinstance(pos, int) else F.expr(f"shiftleft(1L, pos % {MASK_BITS})")


def masks(used: set[int]) -> list[Column]:
    """Aggregates m0, m1, ...: which of the terms (column pos) a document has, 62 to a mask."""
    return [F.coalesce(F.bit_or(F.when(F.floor(F.col("pos") / MASK_BITS) == i, mask_of(F.col("pos")))), F.lit(0).cast("long")).alias(f"m{i}") for i in range(max(used) // MASK_BITS + 1)]


def has_bit(pos: int) -> Column:
    return F.col(f"m{pos // MASK_BITS}").bitwiseAND(F.lit(1 << (pos % MASK_BITS)).cast("long")) != 0


def matches(node: Node, has) -> Column:
    """Whether a document is in the result, has(pos) telling whether it has a term."""
    if node.op == "T":
        return has(node.pos)
    parts = [matches(c, has) for c in node.children]
    if node.op == "*":
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.op == "&" else out | p if node.op == "|" else out & ~p
    return out


def lower_masks(postings: DataFrame, terms: list[Term], node: Node) -> DataFrame:
    """(docid, m0, m1, ...): one aggregation collects which terms each document has in bit masks of 62 terms, and the
    tree becomes one Boolean expression over bits: one shuffle for any query, partial sums before it."""
    used = node.terms()
    found = hits(postings, terms, used)
    return found.groupBy("docid").agg(*masks(used)).where(matches(node, has_bit))


def lower_joins(postings: DataFrame, terms: list[Term], node: Node) -> DataFrame:
    """docid by semi joins, unions and anti joins: for few terms of which one is rare, whose list can then be broadcast
    by the adaptive planner. `*` keeps its left side."""
    if node.op == "T":
        return term_lookup(postings, terms[node.pos].word, terms[node.pos].type)
    parts = [lower_joins(postings, terms, c) for c in node.children]
    out = parts[0]
    for p in parts[1:] if node.op != "*" else ():
        out = out.join(p, "docid", "left_semi") if node.op == "&" else out.unionByName(p) if node.op == "|" else out.join(p, "docid", "left_anti")
    return out.distinct() if node.op == "|" else out


def search(postings: DataFrame, text: str, terms: list[Term], optional: bool = True, how: str = "masks") -> DataFrame:
    """docid of the documents that a query finds, in no order; an empty query finds none."""
    node = parse(text, len(terms), optional)
    if node is None:
        return postings.select("docid").limit(0)
    node = flatten(node)
    return (lower_masks if how == "masks" else lower_joins)(postings, terms, node).select("docid")


def explain(text: str, n_terms: int) -> str:
    """The query as it is evaluated, fully parenthesised."""
    node = parse(text, n_terms)
    return flatten(node).to_text() if node else ""
