"""Column-by-column likeness of two tables, and rank-based AUC.

Both tables are stacked with a side mark and unpivoted, then grouped by
(column, value): partial aggregation absorbs hot values, each distinct value is
shuffled once, and every later step works on distinct values only.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, common_columns, is_text, key_text, literals
from ..functions.numeric import num
from ..session import materialize
from .ranking import prefix_sums

_DETAIL = "column string, type string, distance double"


def _value_counts(real: DataFrame, synthetic: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``column, t, v, r, s``: occurrences of each value, text or number, on either side; stored.

    Each table is read once for all columns; columns are called v0, v1... in the given order.
    """

    def side(df: DataFrame, mark: int) -> DataFrame:
        schema = df.schema
        cells = [f"struct({key_text(schema, n)} AS t, CAST(NULL AS DOUBLE) AS v)" for n in texts]
        cells += [f"struct(CAST(NULL AS STRING) AS t, CAST({num(schema, n)} AS DOUBLE) AS v)" for n in numbers]
        return df.selectExpr(f"{mark} AS side", *[f"{x} AS v{i}" for i, x in enumerate(cells)])

    stacked = side(real, 1).unionByName(side(synthetic, 0))
    long = stacked.unpivot(["side"], stacked.columns[1:], "column", "value").select("side", "column", "value.t", "value.v")
    counts = long.groupBy("column", "t", "v").agg(F.expr("sum(side) AS r"), F.expr("sum(1 - side) AS s"))
    return materialize(counts, "value-counts")


def _at(columns: Sequence[str]) -> Column:
    """Translate the positional names v0, v1... back."""
    return F.expr(f"element_at(array({literals(columns)}), CAST(substring(column, 2) AS INT) + 1)").alias("column")


def _total_variation(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    totals = counts.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    joined = counts.join(F.broadcast(totals), "column")  # one row per column
    gap = "abs(coalesce(try_divide(r, nr), 0.0D) - coalesce(try_divide(s, ns), 0.0D))"
    return joined.groupBy("column").agg(F.expr(f"0.5D * sum({gap}) AS distance")).select(_at(names), "distance")


def _kolmogorov_smirnov(counts: DataFrame, names: Sequence[str], first: int) -> DataFrame:
    counts = counts.filter("v IS NOT NULL")
    totals = counts.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"))
    cumulated = prefix_sums(counts, "v", ["r", "s"], by="column").join(F.broadcast(totals), "column")
    gap = F.expr("abs(try_divide(cum_r, nr) - try_divide(cum_s, ns))")
    found = cumulated.groupBy("column").agg(F.max(gap).alias("distance"))
    every = counts.sparkSession.createDataFrame([(f"v{i}",) for i in range(first, len(names))], "column string")
    return every.join(found, "column", "left").select(_at(names), F.coalesce("distance", F.lit(1.0)).alias("distance"))


def total_variation(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, distance``: half the summed frequency differences; missing is a value of its own."""
    return _total_variation(_value_counts(real, synthetic, columns, []), columns)


def kolmogorov_smirnov(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, distance``: exact two-sample statistic over numeric cells; 1 if a side has none."""
    return _kolmogorov_smirnov(_value_counts(real, synthetic, [], columns), columns, 0)


def column_similarity(
    real: DataFrame, synthetic: DataFrame, categorical: Collection[str] = (), ignore: Collection[str] = ()
) -> DataFrame:
    """``column, type, distance, similarity`` for every column of ``real``.

    Text and declared categorical columns use total variation, the others
    Kolmogorov-Smirnov; the kind follows the real table's type.
    """
    names = [n for n in real.columns if n not in ignore]
    shared = [n for n in common_columns(real, synthetic) if n not in ignore]
    by_value = [n for n in shared if n in set(categorical) or is_text(real.schema[n].dataType)]
    by_order = [n for n in shared if n not in by_value]
    parts = []
    both = [*by_value, *by_order]
    counts = _value_counts(real, synthetic, by_value, by_order) if both else None
    is_text_column = F.expr(f"CAST(substring(column, 2) AS INT) < {len(by_value)}")
    if by_value:
        found = _total_variation(counts.filter(is_text_column), both)
        parts.append(found.select("column", F.lit("categorical_tvd").alias("type"), "distance"))
    if by_order:
        found = _kolmogorov_smirnov(counts.filter(~is_text_column), both, len(by_value))
        parts.append(found.select("column", F.lit("numeric_ks").alias("type"), "distance"))
    absent = [(n, "missing", 1.0) for n in names if n not in shared]
    if absent or not parts:
        parts.append(real.sparkSession.createDataFrame(absent, _DETAIL))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("similarity", F.greatest(F.lit(0.0), 1.0 - F.col("distance")))


def similarity_mean(similarity: DataFrame) -> DataFrame:
    """One row with the mean similarity; NaN for an empty table."""
    return similarity.agg(F.coalesce(F.avg("similarity"), F.lit(float("nan"))).alias("column_similarity_mean"))


def auc_binary(scored: DataFrame, label: str, score: str, by: str | None = None) -> DataFrame:
    """Mann-Whitney AUC with tied ranks averaged: ``[by,] auc, n_pos, n_neg``.

    Labels are 0/1. Grouping by score first leaves one row per distinct score;
    the running count of negatives is a two-level prefix sum. NaN if a class is
    absent.
    """
    group = [c(by)] if by else []
    counted = (
        scored.filter(c(score).isNotNull() & c(label).isin(0, 1))
        .groupBy(*group, c(score).cast("double").alias("_score"))
        .agg(F.count_if(c(label) == 1).alias("_p"), F.count_if(c(label) == 0).alias("_n"))
    )
    ranked = prefix_sums(counted, "_score", ["_n"], by=by)
    below = F.col("cum__n") - F.col("_n") / 2
    totals = ranked.groupBy(*group).agg(
        F.sum(F.col("_p") * below).alias("u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return totals.select(
        *group,
        F.coalesce(F.try_divide("u", F.nullif(pairs, F.lit(0.0))), F.lit(float("nan"))).alias("auc"),
        F.coalesce("n_pos", F.lit(0).cast("long")).alias("n_pos"),
        F.coalesce("n_neg", F.lit(0).cast("long")).alias("n_neg"),
    )
