"""The registered queries of the training-data operators: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import jaccard, langid, licenses, neardup, ogg, oracles, packing, sharding, tokens, toxicity, warc
from gneiss.llm.base import durable, id_remainder


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 5) == 0
    model = langid.fit(docs.filter(~held_out & F.col("lang").isNotNull()))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests, 2048)


def op3_prefix_sum_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.shard(table(spark, sf_dir, "documents"), 24, 8)
    return assigned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_lsh_forest_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), decode=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_block_max_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 4) == 2
    index = toxicity.fit(docs, labels.filter(~held_out))
    out = toxicity.score(docs, index)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.to_json("evidence").alias("evidence"))


def op7_collision_counting_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ogg.text_media(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = durable(warc.archives(table(spark, sf_dir, "pages")))
    return warc.read(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    containment = F.array_max(F.transform(F.filter("matches", lambda m: m["told"]), lambda m: m["containment"]))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(containment, F.lit(0.0))).alias("score"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ecoc_language_id, op2_best_fit_packing, op3_prefix_sum_sharding, op4_lsh_forest_jaccard, op5_bpe_round_trip, op6_block_max_toxicity, op7_collision_counting_near_duplicates, op8_ogg_media, op9_dictionary_warc, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_lsh_forest_jaccard": oracles.JACCARD,
        "op7_collision_counting_near_duplicates": oracles.VECTORS,
        "op9_dictionary_warc": oracles.WARC,
        "op10_license_scan": oracles.license_sql(),
    }
