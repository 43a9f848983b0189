"""Exact global order at scale: ranks, prefix sums and order cutoffs.

A window over a whole table is one task. Everything here works on two levels
instead: rows fall into buckets by a fixed function of their value, the window
runs inside each bucket, and per-bucket offsets (a small table, one row per
bucket) are joined back. Buckets depend on values only, so recomputed tasks
agree with the first run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, quoted
from ..functions.hashing import hash_hex
from ..session import BROADCAST_ROW_BOUND, materialize

#: Hex digits that pick a hash bucket; 16**4 buckets bound every offsets table.
BUCKET_DIGITS = 4
#: Rows in each value range of prefix sums, about; and ranges at least.
RANGE_ROWS, RANGES = 1_000_000, 16


def hash_order(key: str, seed: int) -> Column:
    """Sort key of the seeded random order: (md5 of key and seed, key)."""
    return F.expr(f"struct({hash_hex(quoted(key), seed)} AS h, {quoted(key)} AS k)")


def bucket_of(order: str) -> str:
    """Hash bucket of a sort key column."""
    return f"substring({order}.h, 1, {BUCKET_DIGITS})"


def first_in_hash_order(df: DataFrame, key: str, seed: int, wanted: Callable[[Column], Column]) -> Column:
    """Condition selecting exactly the first ``wanted(total)`` rows in hash order of a unique ``key``.

    The cutoff is found from the key column alone - bucket counts, then the
    order inside the one bucket that holds the boundary - and enters the query
    as a scalar subquery, so the wide rows are filtered in place: no shuffle.
    """
    keyed = df.select(hash_order(key, seed).alias("o")).selectExpr("o", f"{bucket_of('o')} AS b")
    # At most 16**BUCKET_DIGITS rows from here on, so one task for the running total is fine.
    counts = keyed.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    running = counts.select(
        "b",
        "n",
        F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("b")).alias("upto"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    ).withColumn("want", wanted(F.col("total")))
    boundary = running.filter("upto >= want AND upto - n < want").select(
        "b", (F.col("want") - F.col("upto") + F.col("n")).alias("inside")
    )
    cutoff = (
        keyed.join(F.broadcast(boundary), "b")
        .withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("o")))
        .filter("rank = inside")
        .agg(F.max("o").alias("o"))
    )
    return F.coalesce(hash_order(key, seed) <= cutoff.scalar(), F.lit(False))


def dense_index(df: DataFrame, key: str, seed: int, by: str | None = None, name: str = "_index") -> DataFrame:
    """Add the 0-based position in hash order (within ``by``, if given) as ``name``.

    One shuffle, on (by, hash bucket); a dominating ``by`` value is spread over
    all its buckets. ``by`` is meant for few values such as class labels.
    """
    group = [c(by)] if by else []
    rows = df.withColumn("_o", hash_order(key, seed)).withColumn("_b", F.expr(bucket_of("_o")))
    offsets = bucket_offsets(rows, [by] if by else [], {"_n": F.count(F.lit(1))})
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_o")))
    match = local["_b"] == offsets["_bucket"]
    if by:
        match = match & local[quoted(by)].eqNullSafe(offsets["_by0"])
    joined = local.join(F.broadcast(offsets), match)
    return joined.select(*[local[quoted(n)] for n in df.columns], (F.col("_r") - 1 + F.col("_n")).alias(name))


def bucket_offsets(rows: DataFrame, by: Sequence[str], sums: dict[str, Column], bucket: str = "_b") -> DataFrame:
    """Per (by, bucket), the totals of all earlier buckets: ``_by0.., _bucket`` and the named sums."""
    keys = [c(n).alias(f"_by{i}") for i, n in enumerate(by)]
    names = [f"_by{i}" for i in range(len(by))]
    totals = rows.groupBy(*keys, c(bucket).alias("_bucket")).agg(*[e.alias(n) for n, e in sums.items()])
    earlier = (
        Window.partitionBy(*names, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *names, "_bucket", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums]
    )


def prefix_sums(df: DataFrame, value: str, sums: Sequence[str], by: str | None = None, window_rows: int = 2 * BROADCAST_ROW_BOUND) -> DataFrame:
    """Add ``cum_<s>``: inclusive running total of each column in ``sums`` over ascending ``value``.

    ``df`` holds one row per (by, value) - group first, which also absorbs hot
    values. It is written once, as it is needed several times. Up to a checked
    size one window will do; beyond it rows are cut into ranges of (by, value)
    at sampled splitters. Only speed, not the result, depends on them.
    """
    df = materialize(df, "value-counts")
    group = [c(by)] if by else []
    n = df.count()
    if n <= window_rows:
        whole = Window.partitionBy(*(group or [F.lit(0)])).orderBy(c(value))
        whole = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c(s)).over(whole).alias(f"cum_{s}") for s in sums])
    return _ranged_prefix_sums(df, value, sums, by, max(RANGES, n // RANGE_ROWS))


def _ranged_prefix_sums(df: DataFrame, value: str, sums: Sequence[str], by: str | None, ranges: int) -> DataFrame:
    """Runs sorted by (by, value), each with the totals of the runs before it.

    Spark deals rows to ranges by sampled splitters. Ranges are numbered and stored, since they would be drawn anew in
    another job. Each range sums up its own rows and needs one number more per group: the total of that group in earlier
    ranges, from a table of one row per range and group.
    """
    group = [c(by)] if by else []
    order = [*group, c(value)]
    ranged = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "value-ranges")
    inside = Window.partitionBy("_range", *group).orderBy(c(value))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({f"_cum_{s}": F.sum(c(s)).over(inside) for s in sums})
    offsets = bucket_offsets(ranged, [by] if by else [], {f"_off_{s}": F.sum(c(s)) for s in sums}, "_range")
    match = local["_range"] == offsets["_bucket"]
    if by:
        match = match & local[quoted(by)].eqNullSafe(offsets["_by0"])
    if ranges <= BROADCAST_ROW_BOUND and not by:
        offsets = F.broadcast(offsets)  # one row per range
    return local.join(offsets, match).select(
        *[local[quoted(n)] for n in df.columns],
        *[(F.col(f"_cum_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
    )
