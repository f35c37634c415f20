"""Levels as versioned Parquet folders, with one pointer to the versions that count."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.catalog import POSTINGS, Level
from lexitide.operators.replay import State, empty
from lexitide.operators.tables import doc_count

from .shared import filesystem

SIGNS = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("type", T.IntegerType()), ("word", T.StringType()), ("whole", T.StringType()), ("sign_hi", T.LongType()), ("sign_lo", T.LongType()))])


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = filesystem(spark, path)
    _, new = filesystem(spark, path + ".new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"{path} could not be written")


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What the pointer says: version, the version of each level, where the log was, the last batch, and when it was
    written and last merged; None if nothing was dumped."""
    for name in ("current", "current.new"):  # .new: the run ended between removing and renaming
        fs, p = filesystem(spark, f"{root}/{name}")
        if fs.exists(p):
            stream = fs.open(p)
            try:
                return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
    return None


def _folder(level: Level) -> str:
    return f"L{level.level}_{level.name}"


#: Rows of a range of postings, so few that a task sorts them in memory.
RANGE_ROWS = 500_000
_ORDER = ("type", "word", "docid")


def range_cuts(shown: DataFrame, every: int) -> list[tuple]:
    """Where postings are cut into ranges of about RANGE_ROWS, in order: (type, word, docid) of the first row of each range
    but the first. shown: one in `every` of the postings."""
    shown = shown.select(*_ORDER).persist()
    try:
        ranges = max(1, -(-shown.count() * every // RANGE_ROWS))
        first = shown.repartitionByRange(ranges, *_ORDER).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*_ORDER)).alias("first"))
        return sorted(tuple(r["first"]) for r in first.where("first.docid is not null").collect())[1:]  # one row a range
    finally:
        shown.unpersist()


def write_postings(postings: DataFrame, path: str, partitions: int | None = None, ranges: int | None = None) -> None:
    """Postings by type in files of ranges of words, sorted: a query prunes folders, files, row groups and pages, and the
    postings of a frequent word are spread over as many ranges of documents as they fill. ranges: how many there are, of
    postings that say in a column `range` which is theirs (range_cuts()): they are made once then. Otherwise a first run
    over all of them finds the ranges."""
    if ranges:
        ranged = postings.repartitionById(ranges, "range").drop("range")
    else:
        ranged = postings.repartitionByRange(*[partitions] * (partitions is not None), *_ORDER)
    ranged.sortWithinPartitions(*_ORDER).write.mode("overwrite").partitionBy("type").parquet(path)


def dump_all(states: dict[Level, State], root: str, position: tuple[int, int] | None = None, batch: int | None = None, signs: dict[Level, DataFrame] | None = None, merged: bool = False, ranges: dict[Level, int] | None = None) -> int:
    """Write the tables of several levels, and their dictionaries if given, under a new version, then point to it: a
    reader sees all levels before or all after, never a mixture. Levels that aren't given keep their version, and so do
    position and batch. ranges: of levels whose postings say their range, how many. Returns the version."""
    spark = next(iter(states.values())).forward.sparkSession
    now = pointer(spark, root) or {"version": 0, "levels": {}, "position": None, "batch": None, "merged_at": time.time()}
    version = now["version"] + 1
    for level, state in states.items():
        at = f"{root}/{_folder(level)}/v{version}"
        state.forward.write.mode("overwrite").parquet(f"{at}/forward")
        write_postings(state.postings, f"{at}/postings", ranges=(ranges or {}).get(level))
        known = (signs or {}).get(level)
        if known is None:
            known = load_dict(spark, level, root)
        if known is not None:
            known.select(*SIGNS.names).write.mode("overwrite").parquet(f"{at}/signs")
    now["levels"] |= {_folder(level): version for level in states}
    now |= {"version": version, "position": position or now["position"], "batch": now["batch"] if batch is None else batch, "written_at": time.time()}
    _write_text(spark, f"{root}/current", json.dumps(now | ({"merged_at": now["written_at"]} if merged else {})))
    return version


def dump(state: State, level: Level, root: str, position: tuple[int, int] | None = None) -> int:
    """Write one level; the others stay as they are."""
    return dump_all({level: state}, root, position)


def _at(spark: SparkSession, level: Level, root: str) -> str | None:
    version = (pointer(spark, root) or {"levels": {}})["levels"].get(_folder(level))
    return None if version is None else f"{root}/{_folder(level)}/v{version}"


def load_fwd(spark: SparkSession, level: Level, root: str) -> DataFrame | None:
    """The forward table. Fields that the dump lacks get their defaults; a dump with fields that the level doesn't declare
    is an error."""
    at = _at(spark, level, root)
    if at is None:
        return None
    forward = spark.read.parquet(f"{at}/forward")
    extra = set(forward.columns) - set(level.forward_schema().names)
    if extra:
        raise ValueError(f"the dump has fields that the level lacks: {sorted(extra)}")
    fields = []
    for f in level.fields:
        start = F.lit(f.start).cast(f.type) if f.kind in ("int", "float") else F.lit(None).cast(f.type)
        fields.append(F.col(f.name).cast(f.type).alias(f.name) if f.name in forward.columns else start.alias(f.name))
    return forward.select("oid", "docid", *fields)


def load_inv(spark: SparkSession, level: Level, root: str) -> DataFrame | None:
    """The postings; a filter by type and word prunes what is read."""
    at = _at(spark, level, root)
    return None if at is None else spark.read.schema(POSTINGS).parquet(f"{at}/postings").select(*POSTINGS.names)


def load_dict(spark: SparkSession, level: Level, root: str) -> DataFrame | None:
    """The dictionary of words, None if there is none."""
    at = _at(spark, level, root)
    if at is None:
        return None
    fs, p = filesystem(spark, f"{at}/signs")
    return spark.read.schema(SIGNS).parquet(f"{at}/signs") if fs.exists(p) else None


def load(spark: SparkSession, level: Level, root: str) -> State:
    """The state that the pointer names, an empty one if there is none; one whose tables are missing is an error."""
    forward = load_fwd(spark, level, root)
    return empty(spark, level) if forward is None else State(forward, load_inv(spark, level, root))


def recycle(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders of versions that the pointer doesn't name, but for the youngest ones that readers may still be
    at; returns what was deleted."""
    now = pointer(spark, root)
    gone = []
    for folder, version in (now or {"levels": {}})["levels"].items():
        fs, p = filesystem(spark, f"{root}/{folder}")
        have = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v")
        for v in [v for v in have if v < version][: -(keep - 1) or None]:
            fs.delete(filesystem(spark, f"{root}/{folder}/v{v}")[1], True)
            gone.append(f"{folder}/v{v}")
    return gone


def level_counts(tables: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """(name, docs) of each level, given its forward table and its postings, if it has any."""
    return reduce(DataFrame.unionByName, [doc_count(*t).select(F.lit(name).alias("name"), "docs") for name, t in sorted(tables.items())])
