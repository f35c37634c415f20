"""The queries of the training-data operators, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_extract, langid, media, mixing, ngram_join, oracles, packing, quality, repeats, sharding
from .common import prepare


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size"))


def weights_by_code_point(docs: DataFrame) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 3, 1, 2, repeating. As many sources as mix() takes patterns, else an error."""
    names = [r[0] for r in docs.select("source").distinct().limit(20_001).collect()]
    if len(names) > 20_000:
        raise ValueError("more than 20000 sources")
    names = sorted(x for x in names if x is not None) + [None] * (None in names)
    return {s: float((3, 1, 2)[i % 3]) for i, s in enumerate(names)}


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out, plan = mixing.mix(sized(docs).withColumn("sources", F.array("source")), weights_by_code_point(docs))
    table = spark.createDataFrame([(s, int(n), float(t)) for s, n, t in zip(plan["sources"], plan["sizes"], plan["targets"])], "s string, source_size long, target double")
    return out.join(table, out["source"].eqNullSafe(table["s"])).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), html_extract.default_model())


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(read(spark, sf_dir, "documents")).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "switches")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_as_media(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group_key"), F.xxhash64("doc_id").alias("order_key"))
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(prepare(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_quality, op3_embeddings, op4_html, op5_langid, op6_repeats, op7_pack, op8_media, op9_ngram_join, op10_shard, pipeline)}


def oracle_sql() -> dict[str, str]:
    """The others are learned, seeded, or need a checksum or a tokenizer that SQL lacks."""
    return {"op3_embeddings": oracles.OP3, "op6_repeats": oracles.OP6, "op9_ngram_join": oracles.OP9}
