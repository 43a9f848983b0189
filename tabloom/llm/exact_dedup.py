"""Exact dedup: 128-bit content hash, bytes compared inside groups, the smallest stable id stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import BLANKS, identified, text_or_empty


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks. Grouping is by the 128-bit hash and the bytes themselves, so a
    collision of hashes makes two groups; copies are merged before the shuffle, so one huge group costs a row per task.
    A class is then named by its hash and SHA-256, and rows find their class by that name.

    Of equal texts the one with the most code points in the original stays, then the smallest id; a null id comes
    last. A null text counts as empty, and empty texts are equal. Rows that repeat both id and text cannot be told
    apart and are all ``kept`` if that id stays (``drop_copies`` leaves one of them). Other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text_or_empty(text_col)).alias("chars"),
        F.regexp_replace(text_or_empty(text_col), f"[{BLANKS}]+", "").alias("plain"),
    ).withColumn("hash", F.unhex(F.md5("plain")))
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id")).alias("best")
    classes = texts.groupBy("hash", "plain").agg(F.count("*").alias("group_size"), best)
    classes = classes.select(
        "hash", F.sha2("plain", 256).alias("text_sha256"), "group_size", F.col("best.doc_id").alias("keep_id")
    )
    rows = texts.select("doc_id", "hash", F.sha2("plain", 256).alias("text_sha256"))
    return rows.join(classes, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of equal texts, with all its columns.

    Rows are chosen, not ids: of equal texts the one with the most code points stays, then the smallest id (null last),
    then the row read first. Rows that share an id or have none are told apart by a stored row number.
    """
    rows, key = identified(docs, id_col)
    if key == id_col:
        kept = exact_groups(rows, id_col, text_col).filter("kept").select(F.col("doc_id").alias(key))
    else:
        name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("row"))
        named = rows.select(name.alias("name"), F.col(text_col).alias("text"))
        kept = exact_groups(named, "name", "text").filter("kept").select(F.col("doc_id.row").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
