"""A cleaning pipeline over ``documents``: language, near-duplicates, repeated passages, mixing, encoding.

Each stage works on what the one before kept. Null languages, texts and sources are handled by the operators. Rows
with a null doc_id go through every stage as documents of their own; rows that repeat a doc_id are one document for
near-duplicates and passages, and are mixed and encoded row by row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebill.llm import language, minhash, mixing, piece, substring
from rebill.llm.common import read, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
MAX_RATE = 0.6  # phrases a symbol above which a text is no prose of a learnt language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; ``und`` texts (null, no letter) and unparsable ones go."""
    model = language.fit(docs.select("text", "lang"))
    told = language.identify(docs, model, COLUMNS)
    return told.where((F.col("lang_pred") != "und") & (F.col("rate") <= MAX_RATE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five words, 0.8), and rows without an id."""
    gone = minhash.group(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; documents of which nothing is left go."""
    out = substring.dedup(docs.select(*COLUMNS))
    left = out.where((F.col("removed") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows equal in every column are taken together."""
    docs = docs.select(*COLUMNS)
    ident = F.coalesce("doc_id", F.lit(0)).alias("_id")  # the hash tells a null id from 0
    times = mixing.mix(docs).where("times > 0").groupBy(ident, F.col("h").alias("_h")).agg(F.sum("times").alias("_times"))
    rows = docs.select("*", ident, mixing.row_hash(docs).alias("_h")).join(times, ["_id", "_h"])
    first = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("_h")) == 1
    rows = rows.withColumn("_first", first).where("_first")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text of every row; null texts have no ids."""
    return piece.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    root = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
