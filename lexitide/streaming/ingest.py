"""Ingest of the mutation log as a stream of micro-batches onto stored levels, and their upkeep."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexitide.catalog import Level
from lexitide.operators.replay import apply
from lexitide.operators.tables import dictionary
from lexitide.sources.mutation_log import log_position, stream_log
from lexitide.sources.store import dump_all, load, load_dict, pointer, recycle

#: Seconds between two merges, and seconds without a new batch that raise the alarm.
MERGE_INTERVAL, LAG_ALARM = 1800, 3 * 24 * 3600
_processors: dict[str, Callable[..., None]] = {}


def processor(name: str) -> Callable[[Callable], Callable]:
    """Register a function (lines, batch_id, levels, root, base) under a name."""

    def put(f: Callable) -> Callable:
        _processors[name] = f
        return f

    return put


@processor("levels")
def apply_batch(lines: DataFrame, batch_id: int, levels: list[Level], root: str, base: bool) -> None:
    """The state of all levels with the batch applied becomes the next version, at once. A batch whose lines the stored
    position of the log has passed is left out, so a restart applies every line once; files must come in the order of
    their numbers. New words get the next ids of their level's dictionary; ids stay when words go."""
    spark = lines.sparkSession
    now = pointer(spark, root)
    held = lines.persist()
    try:
        position = log_position(held)
        if position is None or now is not None and now["position"] and list(position) <= now["position"]:
            return
        first = held.selectExpr("min(file_no)").first()[0]
        if now is not None and now["position"] and first <= now["position"][0]:
            raise ValueError(f"log file {first} comes after file {now['position'][0]}")
        states = {level: apply(load(spark, level, root), held, level, base) for level in levels}
        signs = {level: dictionary(s.postings, level, known=load_dict(spark, level, root)) for level, s in states.items() if level.inverted}
        dump_all(states, root, position, batch_id, signs)
    finally:
        held.unpersist()


def ingest(spark: SparkSession, log: str, levels: list[Level], root: str, base: bool = False, name: str = "levels", files_per_batch: int = 16, once: bool = True, seconds: float = 10.0, merge_interval: float = MERGE_INTERVAL) -> StreamingQuery:
    """Start the ingest of closed log files; once: end when all files that are there are read, as for a base build.
    After each batch the levels are merged if that is due, and old versions are deleted."""
    if name not in _processors:
        raise KeyError(f"no processor {name!r}")
    run = _processors[name]

    def step(df: DataFrame, i: int) -> None:
        run(df, i, levels, root, base)
        maintain(spark, levels, root, merge_interval)

    writer = stream_log(spark, log, files_per_batch).writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def compact(spark: SparkSession, level: Level, root: str) -> None:
    """Rewrite a level into files of even size under the next version; batch and position of the log stay."""
    compact_all(spark, [level], root)


def compact_all(spark: SparkSession, levels: list[Level], root: str) -> None:
    """Rewrite all levels that were dumped, under one version."""
    if pointer(spark, root) is not None:
        dump_all({level: load(spark, level, root) for level in levels}, root, merged=True)


def merge_due(spark: SparkSession, root: str, interval: float = MERGE_INTERVAL, at: float | None = None) -> bool:
    now = pointer(spark, root)
    return now is not None and (time.time() if at is None else at) - now["merged_at"] >= interval


def maintain(spark: SparkSession, levels: list[Level], root: str, merge_interval: float = MERGE_INTERVAL, keep: int = 2) -> dict[str, bool | list[str]]:
    """Upkeep between batches: merge all levels if that is due, and delete versions that nobody reads."""
    due = merge_due(spark, root, merge_interval)
    if due:
        compact_all(spark, levels, root)
    return {"merged": due, "recycled": recycle(spark, root, keep)}


def lag(spark: SparkSession, root: str, at: float | None = None) -> float | None:
    """Seconds since the stored state was last written, None if it never was."""
    now = pointer(spark, root)
    return None if now is None else (time.time() if at is None else at) - now["written_at"]


def lag_alarm(spark: SparkSession, root: str, limit: float = LAG_ALARM, at: float | None = None) -> bool:
    seconds = lag(spark, root, at)
    return seconds is not None and seconds > limit


