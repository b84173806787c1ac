"""The last analysis of each account: a Parquet table of one row an account, in folders by a hash of the account.

Saving reads and rewrites only the folders of the accounts that are saved, so that a table neither grows with its history
nor costs more to read; saving the same states again changes nothing. A cleared account keeps a row without payload.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rebill.sources.store import dropped, kept

SCHEMA = "account_id long, analyzed_at timestamp, payload string"
FOLDERS = 64


def _newest(states: DataFrame) -> DataFrame:
    order = Window.partitionBy("account_id").orderBy(F.desc("analyzed_at"), F.desc_nulls_first("payload"))
    return states.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def latest_state(states: DataFrame) -> DataFrame:
    """The newest row of each account (the larger payload of equally new ones); accounts whose newest payload is null were cleared."""
    return _newest(states).where("payload is not null")


def save(states: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Upsert: of an account's stored and new states the newest stays. ``folders`` is that of the first save."""
    spark = states.sparkSession
    new = _newest(states.select("account_id", "analyzed_at", "payload")).withColumn("folder", F.pmod(F.xxhash64("account_id"), F.lit(folders)).cast("int"))
    new = kept(new)
    try:
        old = spark.read.schema(SCHEMA + ", folder int").parquet(path)
        touched = [r[0] for r in new.select("folder").distinct().collect()]  # as many as there are folders at most
        both = old.where(F.col("folder").isin(touched)).unionByName(new)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        both = new
    whole = kept(_newest(both))  # written apart first: a folder is never read and replaced at once
    whole.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)
    dropped(new, whole)


def clear(accounts: DataFrame, at: str, path: str, folders: int = FOLDERS) -> None:
    """Forget the analyses of ``accounts`` (account_id) up to ``at``."""
    save(accounts.select("account_id", F.lit(at).cast("timestamp").alias("analyzed_at"), F.lit(None).cast("string").alias("payload")), path, folders)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select("account_id", "analyzed_at", "payload").where("payload is not null")
