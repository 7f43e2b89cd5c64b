"""Exact dedup by content sort.

The range key of a text is the first 16 characters of its normalised form and a 64-bit hash of the
whole: Spark samples splitters from these short keys (never from whole texts, so that what the
driver gathers stays small), deals the rows into ranges and sorts each range externally by
(key, whole normalised text, id). Equal texts are then adjacent, and the window operator compares
whole neighbouring texts. Texts with a great many copies are found beforehand by a count of hashes
(pre-aggregated before its shuffle) and split over salts; their few representatives meet afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, cut, documents, partitions

#: Hot texts: at most this many for each partition, because a hot text has more than
#: rows / (HOT_PER_PARTITION * partitions) copies. That bounds the broadcast.
HOT_PER_PARTITION = 32


def _ranged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (_row, _id, norm, k_head, k_hash, salt, parts), dealt by range; parts is null for texts that aren't hot."""
    n = partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # lower() maps texts that are equal after lower-casing A-Z to equal texts, and is cheaper; it only deals and counts.
    keyed = docs.select(
        F.struct("*").alias("_row"),
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.translate(F.substring(text, 1, 16), UPPER, LOWER).alias("k_head"),
        F.xxhash64(F.lower(text)).alias("k_hash"),
    )
    most = max(64, docs.count() // (HOT_PER_PARTITION * n))
    hot = keyed.groupBy("k_hash").count().filter(F.col("count") > most).select("k_hash", F.ceil(F.col("count") / most).alias("parts"))
    dealt = keyed.join(F.broadcast(hot), "k_hash", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("_id"), "parts"), F.lit(0)))
    return dealt.repartitionByRange(n, "k_head", "k_hash", "salt").withColumn("norm", F.translate("_text", UPPER, LOWER)).drop("_text")


def _ordered(*keys):
    return Window.partitionBy(*keys).orderBy(F.col("_id").desc_nulls_last())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest
    id stays. A null text counts as empty. Rows that repeat an id and its text count as copies, one
    of which stays. A null id is smaller than any other. No rows in: no rows out. Other columns are
    ignored, whatever their names.
    """
    rows = _ranged(docs.select(id_col, text_col), id_col, text_col)
    w = _ordered("k_head", "k_hash", "salt", "norm")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = rows.select(
        "_id", "k_hash", "salt", "parts", "norm",
        F.max("_id").over(every).alias("sub_keep"),
        F.count(F.lit(1)).over(every).alias("sub_size"),
        F.row_number().over(w).alias("rn"),
    )
    local = cut(
        local.select(
            "_id", "k_hash", "salt", "sub_keep", "sub_size", "rn",
            F.sha2("norm", 256).alias("text_sha256"),
            F.when((F.col("rn") == 1) & F.col("parts").isNotNull(), F.col("norm")).alias("hot_norm"),
        )
    )
    # The salts of a hot text meet: one row for each, so few rows for each text and in all.
    g = Window.partitionBy("hot_norm")
    met = local.filter(F.col("hot_norm").isNotNull()).select(
        F.col("k_hash").alias("m_hash"), F.col("salt").alias("m_salt"), F.col("sub_keep").alias("m_sub"),
        F.max("sub_keep").over(g).alias("m_keep"), F.sum("sub_size").over(g).alias("m_size"),
    )
    on = (F.col("k_hash") == F.col("m_hash")) & (F.col("salt") == F.col("m_salt")) & F.col("sub_keep").eqNullSafe(F.col("m_sub"))
    out = local.drop("hot_norm").join(F.broadcast(met), on, "left")
    keep = F.when(F.col("m_hash").isNotNull(), F.col("m_keep")).otherwise(F.col("sub_keep"))
    return out.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("m_size", "sub_size").cast("long").alias("group_size"),
        ((F.col("rn") == 1) & F.col("_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; same rules."""
    rows = _ranged(docs, id_col, text_col)
    first = rows.withColumn("_rn", F.row_number().over(_ordered("k_head", "k_hash", "salt", "norm"))).filter("_rn = 1")
    cold = first.filter(F.col("parts").isNull())
    hot = first.filter(F.col("parts").isNotNull()).withColumn("_rn", F.row_number().over(_ordered("norm"))).filter("_rn = 1")
    return cold.select("_row.*").unionByName(hot.select("_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
