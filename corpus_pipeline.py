"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. language ID: documents whose language isn't known go (no letters, or a score under
   ``LEAST_SCORE``); lang becomes the predicted language.
2. line dedup: recurring lines go; a document that loses all its words goes.
3. n-gram Jaccard join: of each component the document with the smallest doc_id stays.
4. mixing: a source's documents keep the blocks that the mix takes, a block taken twice comes
   twice, in a second row of the document.
5. SentencePiece encoding: ids of every text that is left.

Cases: documents without a doc_id pass through as any other, and of a component with others one of the others
stays; of repeated rows one stays from stage 3 on; null and empty texts go with stage 1; texts are taken whole,
whatever their length; columns beside those of documents are dropped, whatever their names; an empty
table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import language_id, line_templates, mixing, ngram_join, piece_lattice, queries
from vellum.llm.common import fresh_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model, keep=("doc_id", "text", "source"))
    return _documents(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumnRenamed("lang_pred", "lang"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_templates.drop_lines(docs, keep=("lang", "source")).withColumnRenamed("key", "doc_id")
    return _documents(out.where("n_dropped = 0 or text != ''"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets, not ids, tell what stays, so that rows may share a doc_id: of the rows with the
    smallest doc_id of a component, the first text stays. A null doc_id comes after all others."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"))
    named = ngram_join.join_components(docs.select(row.alias("row"), "text"), key="row")
    keep = written(named.where(F.col("key").eqNullSafe(F.col("component")) | (F.col("n_shingles") == 0)).select("key.doc_id", "key.h").distinct(), "stays")
    stays = docs.withColumn("h", F.xxhash64("text"))
    stays = stays.join(keep.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    if not named.groupBy("key").count().where("count > 1").isEmpty():
        stays = stays.dropDuplicates(["doc_id", "h"])
    return _documents(stays)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(mixing.materialise(docs, mixing.mix(docs), keep=("lang", "source")).withColumnRenamed("key", "doc_id"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = piece_lattice.load(queries.public_tokenizer(queries.PIECES))
    return piece_lattice.encode(docs, model, keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixed), ("sentencepiece", encoded)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
