"""What the operators share: the cluster's shared folder, saved tables, word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where all of Spark is one process (a local master) and the session names no shared folder, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A cluster has to name it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: executors have no folder in common")
    return OWN_FOLDER


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/orbweave/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a written table in the shared folder. It cuts the lineage, and lost executors lose none of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str | Column) -> Column:
    """Words of a text as a long; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
