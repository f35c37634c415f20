"""Declared schemas: fields of the forward table, types of the inverted table, levels, and their configuration files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T

KINDS = ("int", "float", "binary", "proto")
#: Largest binary value, longest word with its prefix, largest type, longest prefix, largest payload.
MOST_BINARY, MOST_WORD, MOST_TYPE, MOST_PREFIX, MOST_PAYLOAD = 1_048_568, 255, 254, 31, 65_535


@dataclass(frozen=True)
class Field:
    """A forward field. proto fields name the message's fields as a DDL string."""

    name: str
    kind: str
    default: float | None = None
    message: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS or not self.name or (self.kind == "proto") != (self.message is not None):
            raise ValueError(f"bad field {self.name!r} of type {self.kind!r}")

    @property
    def type(self) -> T.DataType:
        return T._parse_datatype_string(self.message) if self.message else {"int": T.IntegerType(), "float": T.FloatType(), "binary": T.BinaryType()}[self.kind]

    @property
    def start(self) -> int | float | None:
        """The value of a new record; defaults under 1e-6 count as 0."""
        value = self.default if self.default is not None and abs(self.default) >= 1e-6 else 0
        return {"int": int, "float": float}[self.kind](value) if self.kind in ("int", "float") else None


@dataclass(frozen=True)
class Inverted:
    """A type of keywords. parser turns the JSON text of a payload into a binary column and is needed if payloads have bytes."""

    type: int
    prefix: str
    payload_len: int = 0
    parser: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.type <= MOST_TYPE or not 1 <= len(self.prefix) <= MOST_PREFIX or not 0 <= self.payload_len <= MOST_PAYLOAD or (self.payload_len and self.parser is None):
            raise ValueError(f"bad inverted type {self.type}")


@dataclass(frozen=True)
class Level:
    """A table: a forward schema, perhaps keyword types, perhaps a rule from outer ids to document ids."""

    level: int
    name: str
    fields: tuple[Field, ...]
    inverted: tuple[Inverted, ...] = ()
    id_mapper: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        if len({f.name for f in self.fields}) < len(self.fields) or len({i.type for i in self.inverted}) < len(self.inverted):
            raise ValueError("a field or type is declared twice")
        if self.id_mapper and not self.inverted:
            raise ValueError("a level without keywords has no use for an id mapper")

    def forward_schema(self) -> T.StructType:
        return T.StructType([T.StructField("oid", T.IntegerType()), T.StructField("docid", T.IntegerType()), *[T.StructField(f.name, f.type) for f in self.fields]])

    def type_valid(self, kind: int) -> bool:
        return any(i.type == kind for i in self.inverted)

    def field_offset(self, name: str) -> int:
        """Place of a field among the columns of the forward table, -1 if there is none."""
        return next((i + 2 for i, f in enumerate(self.fields) if f.name == name), -1)


POSTINGS = T.StructType([T.StructField(n, t) for n, t in (("docid", T.IntegerType()), ("type", T.IntegerType()), ("word", T.StringType()), ("payload", T.BinaryType()))])


@dataclass
class Catalog:
    """Levels by number; numbers need not follow each other."""

    levels: dict[int, Level] = field(default_factory=dict)

    def add(self, level: Level) -> Level:
        if level.level in self.levels:
            raise ValueError(f"level {level.level} is declared twice")
        self.levels[level.level] = level
        return level

    def get(self, number: int) -> Level | None:
        return self.levels.get(number)


def read_settings(path: str, spark: SparkSession | None = None) -> dict[str, str]:
    """`key: value` lines; blank lines and lines that start with # say nothing. With a session, any store is read."""
    lines = [r[0] for r in spark.read.text(path).collect()] if spark else Path(path).read_text().splitlines()  # a file of settings
    pairs = (x.split(":", 1) for x in lines if ":" in x and not x.lstrip().startswith("#"))
    return {k.strip(): v.strip() for k, v in pairs}


def level_from_settings(level: int, name: str, forward: dict[str, str], inverted: dict[str, str] | None = None, parsers: dict[str, Callable] | None = None, messages: dict[str, str] | None = None) -> Level:
    fields = []
    for i in range(int(forward["field_size"])):
        at = f"field_{i}_"
        default = forward.get(at + "default")
        fields.append(Field(forward[at + "name"], forward[at + "type"], float(default) if default else None, (messages or {}).get(forward.get(at + "pb_name", ""))))
    types = []
    for i in range(int((inverted or {}).get("invert_num", 0))):
        at = f"invert_{i}_"
        types.append(Inverted(int(inverted[at + "type"]), inverted[at + "prefix"], int(inverted.get(at + "payload_len") or 0), (parsers or {}).get(inverted.get(at + "parser", ""))))
    return Level(level, name, tuple(fields), tuple(types))
