"""One query per operator over its whole table; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.conversation_repair import repair, repair_report
from tabloom.llm.decontamination import contamination
from tabloom.llm.exact_dedup import exact_groups
from tabloom.llm.hard_negatives import hard_negatives, prepared
from tabloom.llm.html_text import extract
from tabloom.llm.language_id import identify
from tabloom.llm.mixing import mix_sources
from tabloom.llm.near_dedup import near_groups
from tabloom.llm.pii import personal_data
from tabloom.llm.quality import classify
from tabloom.llm.reply_trees import format_conversations, read_back
from tabloom.llm.substring_dedup import remove_repeats
from tabloom.llm.warc_audit import audit


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a replica damaged where page_id % 97 = 13: payloads in turn overwritten at equal
    length, truncated, lengthened, and their records lost. The SQL counterpart has rows of the first replica only, so
    none are added here."""
    pages = _table(spark, sf_dir, "pages")
    wrong, kind = "page_id % 97 = 13", "page_id div 97 % 4"
    payload = f"""CASE WHEN NOT coalesce({wrong}, false) THEN html
        WHEN {kind} = 0 THEN repeat('x', cast(octet_length(html) as int))
        WHEN {kind} = 1 THEN substring(html, 1, length(html) div 2)
        ELSE concat(html, 'x') END"""
    second = pages.filter(~F.expr(f"coalesce({wrong} AND {kind} = 3, false)")).withColumn("html", F.expr(payload))
    return audit(pages, second).drop("state")


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th id is an anchor; every 7th row carries a wrong label."""
    table = _table(spark, sf_dir, "embeddings")
    wrong = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    rows = prepared(table.withColumn("label", wrong))
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like marks, formatted and read back."""
    marks = "</s>[INST] ok [/INST]"
    odd = spark.range(2).selectExpr(
        "CAST(-7 AS BIGINT) conv_id", "id turn", "IF(id = 0, 'user', 'assistant') role", f"'{marks}' text"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return read_back(format_conversations(rows)).drop("path").withColumnRenamed("tree", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one turn in twenty each lost, emptied, cut, repeated, or given to the user."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(F.encode(key, "UTF-8")) % 20).alias("kind"),
    ).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int")))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired; those that lost every turn have an empty repair."""
    table = _table(spark, sf_dir, "conversations")
    found = repair_report(repair(damaged(table))).withColumnRenamed("conv", "_conv")
    all_ids = table.select("conv_id").distinct()
    out = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.fillna(0, counts).fillna({"audit": ""}).withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": languages,
    "op2_html_text": page_texts,
    "op3_quality": quality,
    "op4_decontamination": decontaminate,
    "op5_mixing": mix,
    "op6_near_dedup": near,
    "op7_pii": pii,
    "op8_exact_dedup": exact,
    "op9_substring_dedup": repeats,
    "op10_warc_audit": fixity,
    "op11_hard_negatives": negatives,
    "op12_chat_format": chats,
    "op13_structure_repair": repaired,
}
