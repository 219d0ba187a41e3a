"""The corpus pipeline: language, toxicity, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back for the next one; all but the last keep the columns of documents.  Language and toxicity judge
texts: rows go by their text, whatever their ids, so an id that occurs twice or is null changes
nothing.  Of near copies the row with the smallest id stays (null ids last; then the smallest name
of the text, and one row of those that agree in both).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import jaccard, langid, packing, toxicity
from gneiss.llm.base import durable, id_remainder, if_small
from gneiss.llm.queries import tokenizer

ORACLE_SQL = None
#: A language prediction less certain than this many times chance rejects the document.
LEAST_OVER_CHANCE = 1.2
#: Toxicity scores from here on reject the document.
TOXIC = 0.3


def text_name() -> Column:
    """A 128-bit name of the text, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_name().alias("name"), "text")


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose text is among the rejected names."""
    names = durable(rejected.select(F.col("doc_id").alias("rejected_name")).distinct())
    return docs.join(if_small(names), text_name() == F.col("rejected_name"), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or no language likelier than by chance."""
    model = langid.fit(docs.filter(docs["lang"].isNotNull() & (id_remainder("doc_id", 5) != 0)))
    told = langid.predict(texts(docs), model, id_column="name")
    least = min(0.5, LEAST_OVER_CHANCE / max(1, len(model.languages)))
    return without(docs, told.filter((F.col("lang_pred") == langid.UNDETERMINED) | (F.col("score") < least)))


def toxic_neighbours(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose nearest labelled examples make them likely to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_remainder("doc_id", 4) != 2)
    told = toxicity.score(texts(docs), toxicity.fit(docs, labels), id_column="name", evidence=False)
    return without(docs, told.filter(F.col("score") >= TOXIC))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    told = jaccard.join(texts(docs), id_column="name", words=5, threshold=0.8)
    of = durable(told.groupBy(F.col("doc_id").alias("name")).agg(F.min("class_id").alias("group")))
    rows = docs.select("doc_id", text_name().alias("name")).join(of, "name")
    best = rows.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("lacks"), "doc_id", "name")).alias("best"))
    best = durable(best.select(F.col("best.doc_id").alias("best_id"), F.col("best.name").alias("best_name")))
    left = durable(docs.join(if_small(best), (text_name() == F.col("best_name")) & docs["doc_id"].eqNullSafe(F.col("best_id")), "left_semi"))
    again = durable(left.groupBy("doc_id", text_name().alias("name")).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again_id"), F.col("name").alias("again_name")))
    if again.isEmpty():
        return left
    on = (text_name() == F.col("again_name")) & left["doc_id"].eqNullSafe(F.col("again_id"))
    repeated = left.join(if_small(again), on, "left_semi").withColumn("name", text_name()).dropDuplicates(["doc_id", "name"]).drop("name")
    return left.join(if_small(again), on, "left_anti").unionByName(repeated)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed training sequences."""
    pieces = packing.pieces(docs, tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_neighbours),
    ("jaccard_join", jaccard_join),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
