"""Direct changes to a level's tables, lookups, and inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.catalog import Level
from lexitide.functions.signs import prefix_concat, sign64
from lexitide.sources.shared import stage

KEYS = ["docid", "type", "word"]


# Changes of the forward table


def fwd_upsert(forward: DataFrame, updates: DataFrame, level: Level) -> DataFrame:
    """updates: oid and some or all fields, null where a field isn't given, one row an oid. New records start with defaults."""
    old = forward.select(F.col("oid").alias("_o"), F.col("docid").alias("_d"), *[F.col(f.name).alias(f"_{f.name}") for f in level.fields])
    both = old.join(updates, F.col("_o") == F.col("oid"), "full")
    docid = (level.id_mapper(F.col("oid")) if level.id_mapper else F.col("oid")).cast("int")
    fields = []
    for f in level.fields:
        start = F.when(F.col("_o").isNull(), F.lit(f.start).cast(f.type)) if f.kind in ("int", "float") else F.lit(None).cast(f.type)
        fields.append(F.coalesce(F.col(f.name).cast(f.type) if f.name in updates.columns else F.lit(None).cast(f.type), F.col(f"_{f.name}"), start).alias(f.name))
    return both.select(F.coalesce("oid", "_o").alias("oid"), F.when(F.col("oid").isNull(), F.col("_d")).otherwise(docid).alias("docid"), *fields)


def fwd_delete(forward: DataFrame, oids: DataFrame) -> DataFrame:
    return forward.join(oids.select("oid"), "oid", "left_anti")


# Changes of the postings


def inv_insert(postings: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: docid, type, word, payload; a payload takes the place of an older one."""
    return postings.join(rows.select(*KEYS), KEYS, "left_anti").unionByName(rows.select(*KEYS, "payload").dropDuplicates(KEYS))


def inv_remove_term(postings: DataFrame, rows: DataFrame) -> DataFrame:
    return postings.join(rows.select(*KEYS), KEYS, "left_anti")


def inv_remove_doc(postings: DataFrame, docids: DataFrame) -> DataFrame:
    return postings.join(docids.select("docid"), "docid", "left_anti")


def inv_rename(postings: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: docid, new_docid; the keywords of docid become those of new_docid, besides what it has."""
    moved = postings.join(moves, "docid").select(F.col("new_docid").alias("docid"), "type", "word", "payload")
    rest = postings.join(moves.select("docid"), "docid", "left_anti")
    return rest.join(moved.select(*KEYS), KEYS, "left_anti").unionByName(moved)


# Lookups


def get_by_docid(found: DataFrame, forward: DataFrame) -> DataFrame:
    """The records of found documents."""
    return found.select("docid").join(forward, "docid")


def get_by_oid(forward: DataFrame, oids: DataFrame) -> DataFrame:
    """oid and its docid, -1 if there is no record."""
    return oids.select("oid").join(forward.select("oid", "docid"), "oid", "left").select("oid", F.coalesce("docid", F.lit(-1)).alias("docid"))


def field_iter(forward: DataFrame, level: Level) -> DataFrame:
    """(oid, at, name, value as text) of every field, in the order of the schema."""
    entries = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(f.name).alias("name"), (F.base64(f.name) if f.kind == "binary" else F.to_json(f.name) if f.kind == "proto" else F.col(f.name).cast("string")).alias("value")) for i, f in enumerate(level.fields)])
    return forward.select("oid", F.explode(entries).alias("e")).select("oid", "e.*")


def doc_count(forward: DataFrame, postings: DataFrame | None) -> DataFrame:
    """Documents with a keyword; of a level without keywords, all records."""
    return forward.agg(F.count("*").alias("docs")) if postings is None else postings.agg(F.count_distinct("docid").alias("docs"))


def words_of_doc(postings: DataFrame, value: str = "word") -> DataFrame:
    """The sorted words (or sign ids) of each document. Postings are stored by word, so sets made before the shuffle would
    have a word each: rows are dealt by document first, and each set is made once."""
    return postings.select("docid", value).repartition("docid").groupBy("docid").agg(F.sort_array(F.collect_set(value)).alias("words"))


# The dictionary of words


def prefix_of(level: Level, kind: Column | str = "type") -> Column:
    """The prefix of a type's words, null for types that aren't declared."""
    out = F.lit(None).cast("string")
    for i in level.inverted:
        out = F.when((F.col(kind) if isinstance(kind, str) else kind) == i.type, F.lit(i.prefix)).otherwise(out)
    return out


def dictionary(postings: DataFrame, level: Level, first: Column | str = "docid", known: DataFrame | None = None) -> DataFrame:
    """(id, type, word, whole, sign_hi, sign_lo): words of declared types numbered from 1 in the order in which they are
    first seen. Words of known keep their ids, used or not, and new ones come behind the largest; no id is given twice.
    The numbering sorts the new words by range and adds each range's start, so no task has them all."""
    kinds = postings.where(F.col("type").isin([i.type for i in level.inverted]))
    words = kinds.groupBy("type", "word").agg(F.min(first).alias("_first"))
    if known is not None:
        words = words.join(known.select("type", "word"), ["type", "word"], "left_anti")
    words = words.withColumn("whole", prefix_concat(prefix_of(level), F.col("word"))).where("whole is not null")
    start = 0 if known is None else known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]
    words = numbered(words, ["_first", "type", "word"], "id")
    hi, lo = sign64(F.col("whole"))
    new = words.select((F.col("id") + start).alias("id"), "type", "word", "whole", hi.alias("sign_hi"), lo.alias("sign_lo"))
    return new if known is None else known.select(*new.columns).unionByName(new)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a gapless number from 1 in the order of columns of which no two rows agree in all: ranges are numbered in
    themselves, and the counts of the ranges before are added. The ranges are written first, as they may be cut elsewhere
    when they are made again. The counts, one row a range, are broadcast."""
    ranged = stage(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), "_p").withColumn(name, F.col("_n") + F.col("_before")).drop("_p", "_n", "_before")


def sign_lookup(words: DataFrame, known: DataFrame) -> DataFrame:
    """words (type, word) with sign_id, 0 if unknown."""
    return words.join(known.select("type", "word", F.col("id").alias("sign_id")), ["type", "word"], "left").withColumn("sign_id", F.coalesce("sign_id", F.lit(0)))


def sign_word(ids: DataFrame, known: DataFrame) -> DataFrame:
    """The word, with its prefix, of each id."""
    return ids.join(known.select(F.col("id").alias("sign_id"), "whole"), "sign_id")


# Inspection


def list_lengths(postings: DataFrame) -> DataFrame:
    """Documents of each word; a document has a word once. Sort by n descending, then type and word, where the order is
    shown."""
    return postings.groupBy("type", "word").agg(F.count("*").alias("n"))


def list_totals(postings: DataFrame) -> DataFrame:
    return list_lengths(postings).agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_len"))


def list_meta(postings: DataFrame, level: Level) -> DataFrame:
    """`prefix word : documents` lines of a dump."""
    return list_lengths(postings).select(F.concat(F.coalesce(prefix_of(level), F.lit("")), F.col("word"), F.lit(" : "), F.col("n").cast("string")).alias("line"))


def type_stats(postings: DataFrame) -> DataFrame:
    """Postings, words and documents of each type: from the lengths of lists, and from the distinct documents of a type."""
    lists = list_lengths(postings).groupBy("type").agg(F.sum("n").alias("postings"), F.count("*").alias("words"))
    docs = postings.select("type", "docid").distinct().groupBy("type").agg(F.count("*").alias("docs"))
    return lists.join(docs, "type")


def command(postings: DataFrame, line: str) -> DataFrame:
    """`print_list word type` gives the docids in order, `print_list_len word type` how many there are."""
    parts = line.split()
    if len(parts) != 3 or parts[0] not in ("print_list", "print_list_len") or not parts[2].isdigit() or int(parts[2]) > 254:
        raise ValueError(f"not a command: {line!r}")
    found = postings.where((F.col("type") == int(parts[2])) & (F.col("word") == F.lit(parts[1]))).select("docid")
    return found.orderBy("docid") if parts[0] == "print_list" else found.agg(F.count("*").alias("length"))
