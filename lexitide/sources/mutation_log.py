"""The ordered mutation log: numbered files `prefix.N` of tab-separated lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem

#: Fixed value: longest line.
MOST_LINE = 10 * 1024 * 1024


def _lines(files: DataFrame) -> DataFrame:
    file_no = F.regexp_extract(F.col("_metadata.file_path"), r"\.(\d+)$", 1).cast("int")
    out = files.select(file_no.alias("file_no"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return out.where((F.col("line") != "") & (F.octet_length("line") <= MOST_LINE) & F.col("file_no").isNotNull())


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files that a glob names. If only its last part has wildcards, the folder is listed once; else, and for a glob that
    is read as it is, each file would be listed by itself, by up to 10,000 tasks."""
    folder, _, name = path.rpartition("/")
    if not folder or re.search(r"[*?\[{\\]", folder) or not re.search(r"[*?\[{]", name):
        return spark.read.text(path, wholetext=True)
    fs, p = filesystem(spark, folder)
    bare = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"
    depth = re.sub(bare, "", fs.makeQualified(p).toString()).count("/") + 1
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=name, recursiveFileLookup=True)
    mine = F.regexp_replace(F.col("_metadata.file_path"), bare, "")
    return files.where(F.length(mine) - F.length(F.replace(mine, F.lit("/"))) == depth)  # not those of folders below


def read_log(spark: SparkSession, path: str, after: tuple[int, int] | None = None) -> DataFrame:
    """(file_no, line_no, line) of all files that path (a glob) names; files have a bounded number of lines, so each is
    read whole by one task. after: the place that was dealt with last."""
    out = _lines(_files(spark, path))
    return out.where(F.struct("file_no", "line_no") > F.struct(F.lit(after[0]).alias("file_no"), F.lit(after[1]).alias("line_no"))) if after else out


def stream_log(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The same as a stream; only closed files may be in the folder, named in the order of their numbers."""
    return _lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True))


def log_collect(lines: DataFrame, most: int) -> DataFrame:
    """The first lines of a log, as many as one batch takes; how long a stream gathers them is its trigger's matter."""
    return lines.orderBy("file_no", "line_no").limit(most)


def log_split(line: Column | str = "line", base: bool = False) -> Column:
    """The columns of a line; in base mode the first one, an event id, is dropped."""
    parts = F.split(F.col(line) if isinstance(line, str) else line, "\t")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))) if base else parts


def log_partition(lines: DataFrame, partition: int, of: int) -> DataFrame:
    """The lines of one of several readers, dealt out by file."""
    if not 0 <= partition < of:
        raise ValueError("the partition is out of range")
    return lines.where(F.col("file_no") % of == partition)


def log_position(lines: DataFrame) -> tuple[int, int] | None:
    """The last place of a log, to be saved and given to read_log as `after`."""
    last = lines.agg(F.max(F.struct("file_no", "line_no")).alias("p")).first()["p"]
    return (last["file_no"], last["line_no"]) if last else None
