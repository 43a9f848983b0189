"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import running_sums, text_or_empty, unit_interval, word_count
from tabloom.session import materialize


def letter_share(text: Column) -> Column:
    """Quality weight of a text: its share of lower-case letters, 0.05 to 1; shouting and symbols weigh little."""
    letters = F.length(F.regexp_replace(text, r"[^\p{Ll}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, F.length(text)), F.lit(0.0)))


def source_targets(
    sources: DataFrame, weights: Sequence[float], share: float, cap: float
) -> DataFrame:
    """Add ``target`` to (no_source, source_key, source_size): words the mix takes from each source.

    Weights repeat along the sources by code point, null last. Targets share ``share`` times all words by weight and
    stop at ``cap`` times the source; the excess is shared anew by weight until none is above. That ends at one level
    of words per weight below the caps, found from running sums over the sources by (cap / weight).
    """
    ranked = running_sums(sources.withColumn("one", F.lit(1)), [], ["no_source", "source_key"], ["one"], "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("before_one") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    ranked = ranked.select("no_source", "source_key", "source_size", "weight", "most", (F.col("most") / F.col("weight")).alias("full_at"))
    level = running_sums(ranked, [], ["full_at", "no_source", "source_key"], ["most", "weight"], "mix-level")
    total, all_weights = level.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return ranked.withColumn("target", F.lit(0.0)).drop("weight", "most", "full_at")
    level = level.withColumn("level", (F.lit(share * total) - F.col("before_most")) / (F.lit(all_weights) - F.col("before_weight")))
    found = level.filter("level <= full_at").agg(F.min_by("level", F.struct("full_at", "no_source", "source_key"))).first()[0]
    target = F.col("most") if found is None else F.least("most", F.col("weight") * F.lit(found))
    return level.select("no_source", "source_key", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    A source's target is first served by complete epochs of all its documents. What is left is filled in order of the
    keys -ln(u) / quality (u from the id and seed, so reruns agree): documents are taken whole while they fit, and the
    one at the border is cut to the words left. ``quality`` defaults to ``letter_share``; nulls and values of 0 or less
    weigh 1e-9. Null text has size 0, a null source is a source of its own, a null id is drawn like any other;
    repeated rows are drawn one after the other. Other columns are not read.
    """
    text = text_or_empty(text_col)
    weighed = F.greatest(F.lit(1e-9), F.coalesce(quality if quality is not None else letter_share(text), F.lit(0.0)))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    sized = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("no_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source_key"),
            word_count(text).alias("size"),
            (-F.log(unit_interval(F.lit(str(seed)), name)) / weighed).alias("key"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, cap)
    keyed = running_sums(sized, ["no_source", "source_key"], ["key", "doc_id"], ["size"], "mix-keys")
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before_size")))
    return (
        keyed.join(targets, ["no_source", "source_key"])
        .withColumn("epochs", epochs)
        .select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )
