"""Replay of a mutation log into the forward table and the postings of a level.

One aggregation by outer id folds a batch: for every field the last value given since the last delete wins, and so does
the last full row's set of keywords. The same fold serves a whole log and a batch on top of a saved state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.catalog import MOST_BINARY, MOST_TYPE, MOST_WORD, POSTINGS, Level
from lexitide.functions.signs import b64_decode, is_kind, json_fields, json_object, num_to_float, num_to_int
from lexitide.sources.mutation_log import log_split

INSERT, DELETE, UPDATE = 0, 1, 2
_ENTRIES = "array<struct<type:int,word:string,payload:string>>"


def parse_forward(text: Column) -> Column:
    """map<string, variant> of a forward object; null if it isn't an object, a value is an array or a key is empty."""
    return F.try_element_at(F.filter(F.array(json_object(text)), lambda m: ~F.exists(F.map_entries(m), lambda e: (e["key"] == "") | is_kind(e["value"], "ARRAY*"))), F.lit(1))


def parse_inverted(text: Column) -> Column:
    """array<struct<type, word, payload>> of {"type": {"word": payload}} or {"type": ["word"]}; null if any part of it
    has another shape. payload is the JSON text of the value, null in the second form."""

    def of(e: Column) -> Column:
        number = F.when(e["key"].rlike(r"^\d{1,3}$"), e["key"].cast("int"))
        return F.struct(F.when(number <= 255, number).alias("type"), F.schema_of_variant(e["value"]).alias("kind"), F.to_json(e["value"]).alias("json"))

    def words(e: Column) -> Column:
        listed = F.transform(F.from_json(e["json"], "array<string>"), lambda w: F.struct(e["type"].alias("type"), w.alias("word"), F.lit(None).cast("string").alias("payload")))
        pairs = F.transform(F.map_entries(json_object(e["json"])), lambda p: F.struct(e["type"].alias("type"), p["key"].alias("word"), F.to_json(p["value"]).alias("payload")))
        return F.when(e["kind"].startswith("OBJECT"), pairs).otherwise(listed)

    # A null among strings hides in ARRAY<STRING>.
    good = lambda e: e["type"].isNotNull() & (e["kind"].startswith("OBJECT") | e["kind"].isin("ARRAY<STRING>", "ARRAY<VOID>") & ~e["json"].rlike(r"[\[,]null[\],]"))
    entries = F.transform(F.map_entries(json_object(text)), of)
    whole = F.try_element_at(F.filter(F.array(entries), lambda es: F.forall(es, lambda e: F.coalesce(good(e), F.lit(False)))), F.lit(1))
    return F.flatten(F.transform(whole, words)).cast(_ENTRIES)


def _field(level_field, values: Column) -> tuple[Column, Column]:
    """(value or null if it isn't given, whether the row fails by it); values: json_fields() of the row."""
    v = values[level_field.name]
    if level_field.kind == "int":
        return num_to_int(v), F.lit(False)
    if level_field.kind == "float":
        return num_to_float(v), F.lit(False)
    text = F.when(is_kind(v, "STRING"), F.try_variant_get(v, "$", "string"))
    if level_field.kind == "binary":
        raw = b64_decode(text)
        return raw, v.isNotNull() & (raw.isNull() | (F.octet_length(raw) > MOST_BINARY))
    message = json_to_proto(F.coalesce(text, F.when(is_kind(v, "OBJECT*"), F.to_json(v))), level_field.type)
    return message, v.isNotNull() & message.isNull()


def json_to_proto(text: Column, kind) -> Column:
    """A message of a struct type from the JSON text of an object, null if it is none."""
    return F.when(json_object(text).isNotNull(), F.from_json(text, kind, {"mode": "PERMISSIVE"}))


def once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """df with the columns of keep and those made, each evaluated once a row: the optimiser would else write what they are
    made from into every place, filters among them, that they are used in."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def read_rows(lines: DataFrame, level: Level, base: bool = False) -> DataFrame:
    """(seq, op, oid, fields, inv) of the lines of a level; op is null for rows that don't count: those of another shape,
    with unknown operations, bad JSON or a bad binary or message field. Lines of other levels or with ids beyond 31 bits
    are left out. inv is null for forward-only rows. What JSON decides is no filter, as a filter would parse it twice."""
    rows = once(lines.select("line", F.struct("file_no", "line_no").alias("seq")), ["seq"], c=log_split("line", base)).where(F.size("c") >= 3)
    number = lambda i: F.when(F.col("c")[i].rlike(r"^\d{1,10}$"), F.col("c")[i].cast("long"))
    rows = once(rows, ["seq", "c"], n=F.size("c"), level=number(0), op=number(1), oid=number(2), fwd=F.try_element_at("c", F.lit(4)), inv=F.try_element_at("c", F.lit(5))).drop("c")
    rows = rows.where((F.col("level") == level.level) & (F.col("oid") < 1 << 31) & ((F.col("op") == DELETE) | (F.col("op").isin(INSERT, UPDATE) & F.col("n").isin(4, 5))))
    gone = F.col("op") == DELETE
    rows = once(rows, ["seq", "op", "oid", "n"], m=F.when(~gone, parse_forward(F.col("fwd")).isNotNull()), s=F.when(~gone, json_fields(F.col("fwd"), [f.name for f in level.fields])), k=F.when(~gone & (F.col("n") == 5), parse_inverted(F.col("inv"))))
    fields = [_field(f, F.col("s")) for f in level.fields]
    fails = F.lit(False)
    for _, bad in fields:
        fails = fails | bad
    good = gone | (F.col("m") & ((F.col("n") == 4) | F.col("k").isNotNull()) & ~fails)
    rows = once(rows, ["seq", "oid", "k"], op=F.when(good, F.col("op")).cast("int"), **{f"f{i}": v for i, (v, _) in enumerate(fields)})
    kept = F.col("op").isNotNull() & (F.col("op") != DELETE)
    return rows.select("seq", "op", F.col("oid").cast("int").alias("oid"), *[F.when(kept, F.col(f"f{i}")).alias(f"f{i}") for i in range(len(fields))], F.when(kept, F.col("k")).alias("inv"))


def valid_rows(lines: DataFrame, level: Level, base: bool = False) -> DataFrame:
    """The rows of read_rows() that count."""
    return read_rows(lines, level, base).where("op is not null")


def fold(rows: DataFrame, level: Level) -> DataFrame:
    """One row for each outer id that has a row that counts: reset (a delete is among the rows), live, the fields given
    since, and the keywords of the last full row since (null if there is none). One shuffle, with partial results before it."""
    gone = F.coalesce(F.col("op") == DELETE, F.lit(False))
    seq = F.when(F.col("op").isNotNull(), F.col("seq"))
    last = lambda v, given: F.max_by(F.when(gone | given, F.struct(gone.alias("gone"), v.alias("v"))), F.when(gone | given, F.col("seq")))
    aggs = [last(F.col(f"f{i}"), F.col(f"f{i}").isNotNull()).alias(f"f{i}") for i in range(len(level.fields))]
    out = rows.groupBy("oid").agg(F.max(gone).alias("reset"), (~F.max_by(gone, seq)).alias("live"), *aggs, last(F.col("inv"), F.col("inv").isNotNull()).alias("inv"))
    since = lambda c: F.when(~F.col(c)["gone"], F.col(c)["v"]).alias(c)
    return out.where("live is not null").select("oid", "reset", "live", *[since(f"f{i}") for i in range(len(level.fields))], since("inv"))


def keywords(entries: DataFrame, level: Level) -> DataFrame:
    """docid, type, word, payload of (docid, inv): words of types that aren't declared and words too long with their
    prefix are dropped one by one; of a word that repeats, the last entry counts."""
    prefixes = {i.type: i for i in level.inverted}
    if not prefixes:
        return entries.sparkSession.createDataFrame([], POSTINGS)
    flat = entries.select("docid", F.posexplode("inv").alias("at", "e")).select("docid", "at", "e.type", "e.word", "e.payload").where(F.col("type").isin(sorted(prefixes)) & (F.col("type") <= MOST_TYPE))
    length, payload = F.lit(0), F.lit(None).cast("binary")
    for kind, inverted in prefixes.items():
        length = F.when(F.col("type") == kind, F.lit(len(inverted.prefix.encode()))).otherwise(length)
        if inverted.payload_len and inverted.parser:
            payload = F.when(F.col("type") == kind, inverted.parser(F.col("payload"))).otherwise(payload)
    short = flat.where(F.octet_length("word") + length <= MOST_WORD).withColumn("payload", payload)
    needs = [k for k, i in prefixes.items() if i.payload_len]
    if needs:
        sizes = F.lit(0)
        for k in needs:
            sizes = F.when(F.col("type") == k, prefixes[k].payload_len).otherwise(sizes)
        short = short.where(~F.col("type").isin(needs) | (F.octet_length("payload") == sizes))
    return short.groupBy("docid", "type", "word").agg(F.max_by("payload", "at").alias("payload"))


@dataclass
class State:
    forward: DataFrame
    postings: DataFrame


def empty(spark, level: Level) -> State:
    return State(spark.createDataFrame([], level.forward_schema()), spark.createDataFrame([], POSTINGS))


def apply(state: State, lines: DataFrame, level: Level, base: bool = False) -> State:
    """The state after a batch of lines. Full rows replace all keywords of their document, forward-only rows keep them."""
    change = fold(read_rows(lines, level, base), level)
    return _apply(state, change, level)


def _apply(state: State, change: DataFrame, level: Level) -> State:
    old = state.forward.select(F.col("oid").alias("o"), "docid", *[F.col(f.name).alias(f"old{i}") for i, f in enumerate(level.fields)])
    both = old.join(change, F.col("o") == F.col("oid"), "full")
    docid = (level.id_mapper(F.col("oid")) if level.id_mapper else F.col("oid")).cast("int")
    keeps = F.col("o").isNotNull() & ~F.coalesce("reset", F.lit(False))
    fields = []
    for i, f in enumerate(level.fields):
        start = F.lit(f.start).cast(f.type) if f.kind in ("int", "float") else F.lit(None).cast(f.type)
        fields.append(F.when(F.col("oid").isNull(), F.col(f"old{i}")).otherwise(F.coalesce(F.col(f"f{i}"), F.when(keeps, F.col(f"old{i}")).otherwise(start))).alias(f.name))
    forward = both.where(F.col("oid").isNull() | F.col("live")).select(F.coalesce("oid", "o").alias("oid"), F.when(F.col("oid").isNull(), F.col("docid")).otherwise(docid).alias("docid"), *fields)
    cleared = both.where(F.col("oid").isNotNull() & F.col("docid").isNotNull() & (F.col("reset") | ~F.col("live") | F.col("inv").isNotNull())).select("docid")
    fresh = keywords(change.where("live and inv is not null").select(docid.alias("docid"), "inv"), level)
    return State(forward, state.postings.join(cleared, "docid", "left_anti").unionByName(fresh))


def replay(lines: DataFrame, level: Level, base: bool = False) -> State:
    """The state after a whole log; nothing is joined, as there is no state before."""
    return state_of(fold(read_rows(lines, level, base), level).where("live"), level)


def state_of(change: DataFrame, level: Level) -> State:
    """The state that live rows of fold() make where there was none before."""
    docid = (level.id_mapper(F.col("oid")) if level.id_mapper else F.col("oid")).cast("int")
    fields = [(F.coalesce(F.col(f"f{i}"), F.lit(f.start).cast(f.type)) if f.kind in ("int", "float") else F.col(f"f{i}")).alias(f.name) for i, f in enumerate(level.fields)]
    return State(change.select("oid", docid.alias("docid"), *fields), keywords(change.where("inv is not null").select(docid.alias("docid"), "inv"), level))
