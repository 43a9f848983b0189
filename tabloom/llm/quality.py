"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import running_sums, slices, unit_interval
from tabloom.llm.ngrams import BUCKETS, byte_trigrams, count_rows, totals, word_pairs
from tabloom.session import materialize

#: Labelled documents that the target model and the cut are fitted on, chosen by hash of the id. Raw text is all text.
LABELLED = 20_000
#: Length, in n-grams, that log weights are scaled to, so that long texts are not all or nothing against the noise.
LENGTH = 100.0
#: N-grams added to every mean, which keeps short texts near 0.
PRIOR = 10.0
#: Pseudo-counts of each bucket.
SMOOTH = 0.5

ADDED = ("log_weight", "gumbel_key")


@dataclass
class Model:
    """log(p_target / p_raw) of each bucket, and the least key that is kept."""

    ratios: np.ndarray
    cut: float


def _kinds(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    return [byte_trigrams(texts), word_pairs(texts)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for piece in slices(batches, "text"):
        kinds = _kinds(piece.column("text"))
        raw += totals(kinds)
        good = piece.column("good").fill_null(0).to_numpy(zero_copy_only=False) == 1
        if good.any():
            target += totals(kinds, good)
    yield count_rows("raw", raw)
    yield count_rows("target", target)


def _ratios(counts: DataFrame) -> np.ndarray:
    """From (label, bucket, n) summed over tasks: 4 * BUCKETS rows at most."""
    table = {"raw": np.zeros(2 * BUCKETS), "target": np.zeros(2 * BUCKETS)}
    for label, bucket, n in counts.groupBy("label", "bucket").agg(F.sum("n")).collect():
        table[label][bucket] = n
    logs = {}
    for label, x in table.items():
        x = x.reshape(2, BUCKETS) + SMOOTH
        logs[label] = np.log(x / x.sum(axis=1, keepdims=True)).ravel()
    return logs["target"] - logs["raw"]


def _weights(batches: Iterator[pa.RecordBatch], text: str, ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, text):
        score, seen = np.zeros(piece.num_rows), np.zeros(piece.num_rows, np.int64)
        for kind, (rows, buckets) in enumerate(_kinds(piece.column(text))):
            n = np.bincount(rows, minlength=piece.num_rows)
            score += np.bincount(rows, ratios[kind * BUCKETS + buckets], piece.num_rows) / (n + PRIOR)
            seen += n
        weight = pa.array(np.where(seen > 0, LENGTH * score, -1e9))
        yield pa.RecordBatch.from_arrays([*piece.columns, weight], [*piece.schema.names, "_log_weight"])


def _weighed(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, seed: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([*docs.schema.fields, T.StructField("_log_weight", T.DoubleType())])
    scored = docs.mapInArrow(lambda it: _weights(it, text_col, shared.value), schema)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    gumbel = -F.log(-F.log(unit_interval(F.lit(str(seed)), name)))
    return scored.withColumn("_gumbel_key", F.col("_log_weight") + gumbel)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    labelled: int = LABELLED,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
) -> Model:
    """Bucket ratios from all of ``docs`` (raw) and the sampled documents of quality 1 (target).

    The number of documents to keep is set by the sample too: the cut of the Gumbel keys that tells its good and bad
    documents apart best (true positive less false positive rate). Without labels of both kinds all texts are kept.
    Repeated labels count once, by the lower; null ids and labels do not count.
    """
    sample = labels.select(F.col(id_col).cast("long").alias("labelled"), F.col(quality_col).cast("int").alias("good"))
    sample = sample.dropna().groupBy("labelled").agg(F.min("good").alias("good"))
    sample = sample.orderBy(F.xxhash64("labelled"), "labelled").limit(labelled)
    sample = F.broadcast(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    flagged = texts.join(sample, F.col("doc_id") == F.col("labelled"), "left").select("text", "good")
    ratios = _ratios(flagged.mapInArrow(_counts, "label string, bucket int, n long"))
    known = texts.join(sample, F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "good")
    keys = _weighed(known, ratios, "doc_id", "text", seed).select("_gumbel_key", "good").collect()
    keys = sorted((float(k), int(g == 1)) for k, g in keys)
    n_good = sum(g for _, g in keys)
    n_bad = len(keys) - n_good
    best, cut, good, bad = 0.0, float("-inf"), n_good, n_bad
    for i, (key, g) in enumerate(keys):
        gain = good / max(1, n_good) - bad / max(1, n_bad)
        if n_good and n_bad and gain > best and (i == 0 or keys[i - 1][0] < key):
            best, cut = gain, key if i == 0 else (key + keys[i - 1][0]) / 2
        good, bad = good - g, bad - (1 - g)
    return Model(ratios, cut)


def weigh(docs: DataFrame, model: Model, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_log_weight`` and ``_gumbel_key``; nothing is shuffled.

    A text without n-grams (null, empty, or under three bytes and two words) has weight -1e9 and ranks last. Equal
    texts differ by the noise of their ids. All columns of ``docs`` are carried along.
    """
    return _weighed(docs, model.ratios, id_col, text_col, seed)


def _ranked(keys: DataFrame) -> DataFrame:
    """``keys`` with ``before_one``: how many rows have a larger Gumbel key (ties by id)."""
    ranked = keys.select("*", (-F.col("gumbel_key")).alias("rank_key"), F.lit(1).cast("long").alias("one"))
    return running_sums(ranked, [], ["rank_key", "doc_id"], ["one"], "quality-ranks")


def top_k_key(keys: DataFrame, k: int) -> float:
    """The least of the ``k`` largest Gumbel keys (above all keys if k is 0)."""
    least = _ranked(keys).filter(F.col("before_one") < k).agg(F.min("gumbel_key")).first()[0]
    return float("inf") if least is None else least


def keep_best(docs: DataFrame, labels: DataFrame, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that Gumbel top-k draws; k is how many ``fit`` wants of them.

    Keys are ranked on their own; texts are filtered where they are read, so no text is shuffled. Rows with the same
    id and text have the same key and stay or go together. Nulls as in ``weigh``; without documents, none.
    """
    model = fit(docs, labels, seed=seed, id_col=id_col, text_col=text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = weigh(narrow, model, seed).select("doc_id", F.col("_gumbel_key").alias("gumbel_key"))
    keys = materialize(weighed, "quality-keys")
    least = top_k_key(keys, keys.filter(F.col("gumbel_key") >= F.lit(model.cut)).count())
    # The document itself travels as one struct, whatever its columns are called.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = weigh(whole, model, seed).filter(F.col("_gumbel_key") >= F.lit(least))
    return kept.select("document.*")


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, gumbel_key, kept.

    Kept are the ``k`` largest Gumbel keys (ties by id); k defaults to the number of keys above the cut that ``fit``
    finds on the labelled sample.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(docs, labels, seed=seed, id_col=id_col, text_col=text_col)
    keys = weigh(narrow, model, seed).select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_gumbel_key").alias("gumbel_key"))
    keys = materialize(keys, "quality-keys")
    if k is None:
        k = keys.filter(F.col("gumbel_key") >= F.lit(model.cut)).count()
    return _ranked(keys).select("doc_id", "log_weight", "gumbel_key", (F.col("before_one") < k).alias("kept"))
