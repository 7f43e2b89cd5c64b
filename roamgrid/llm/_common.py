"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing of these letters only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one in local mode. A cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later uses neither recompute
    it nor depend on the executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_with_hot(left: DataFrame, right: DataFrame, key: str, rows: str, bound: int = 4096) -> DataFrame:
    """Left join on one key, safe for hot keys.

    right has one row per key and, in column `rows`, the number of left rows of that key. Keys with
    more than total/bound rows (so fewer than `bound` of them, whatever the size of the input) are
    broadcast; the left rows of all other keys are shuffled, and none of those keys is large.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n")).first()["n"]
    limit = max(64, total // bound)
    names = [c for c in right.columns if c not in (key, rows)]
    hot = right.filter(F.col(rows) > limit).select(F.col(key), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in names])
    cold = right.filter(F.col(rows) <= limit).select(key, *names)
    marked = left.join(F.broadcast(hot), key, "left")
    a = marked.filter(F.col("_hot")).select(*left.columns, *[F.col(f"_h_{c}").alias(c) for c in names])
    b = marked.filter(F.col("_hot").isNull()).select(*left.columns).join(cold, key, "left").select(*left.columns, *names)
    return a.unionByName(b)
