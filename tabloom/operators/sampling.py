"""Splits, samples, quotas and bootstraps, reproducible from (row id, seed) alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import c, is_numeric, named, pick, quoted
from ..functions.hashing import hash_hex, hex_wide, hex_word, normals
from ..session import materialize
from ..sources import specs as S
from .ranking import dense_index, first_in_hash_order
from .schema import columns_with_few_values

#: Name of the row id column the operators look for by default; it must be unique.
ROW_ID = "_row_id"
#: A numeric column gets noise in the generic bootstrap only above this many distinct values.
FEW_VALUES = 16


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Give a table without a key a unique row id, fixed by writing the table once."""
    return materialize(df.select(F.monotonically_increasing_id().alias(name), "*"), "rows")


def split_train_test(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = ROW_ID
) -> tuple[DataFrame, DataFrame]:
    """Disjoint (train, test) with exactly ``round(n * test_size)`` test rows."""
    in_test = first_in_hash_order(df, key, seed, lambda n: F.rint(n * F.lit(test_size)).cast("long"))
    return df.filter(~in_test), df.filter(in_test)


def capped_sample(df: DataFrame, at_most: int, seed: int = 42, key: str = ROW_ID) -> DataFrame:
    """A uniform sample of ``at_most`` rows without replacement; everything when there are fewer."""
    return df.filter(
        first_in_hash_order(df, key, seed, lambda n: F.least(n, F.lit(at_most).cast("long")))
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per non-null class: ``_class, _size, _text``; labels are few by nature."""
    return (
        df.filter(c(label).isNotNull())
        .groupBy(c(label).alias("_class"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_text", F.col("_class").cast("string"))
    )


def class_quota(df: DataFrame, label: str, n: int) -> DataFrame:
    """Split ``n`` over classes by their frequency: ``class, quota``.

    Shares are rounded half-even; the last class in label order takes what is
    left, never below zero.
    """
    # One row per class from here on, so the unpartitioned windows are tiny.
    classes = class_counts(df, label)
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy("_class")
    share = F.rint(F.lit(float(n)) * (F.col("_size") / F.sum("_size").over(everything))).cast("long")
    sized = classes.withColumn("_share", share).withColumns(
        {
            "_last": F.lead("_class").over(ordered).isNull(),
            "_before": F.coalesce(
                F.sum("_share").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")
            ),
        }
    )
    rest = F.greatest(F.lit(n).cast("long") - F.col("_before"), F.lit(0).cast("long"))
    return sized.select(F.col("_class").alias("class"), F.when(F.col("_last"), rest).otherwise(F.col("_share")).alias("quota"))


def balanced_draws(
    df: DataFrame,
    label: str,
    per_class: int,
    sets: int,
    rounds: tuple[int, int] = (0, 1),
    seed: int = 42,
    key: str = ROW_ID,
) -> DataFrame:
    """Row ids for every (round, set, class): ``round, set, class, draw`` and the key.

    A class with enough rows gives ``per_class`` different ones, any subset of
    them as likely as any other, whatever other sets have drawn: the i-th draw
    is a position below ``size - per_class + i + 1``, or the last of these if it
    is taken already (Floyd's sampling). A smaller class is drawn with
    replacement. The table is ranked once, on key and label only, however many
    rounds are asked for.
    """
    first, end = rounds
    sizes = class_counts(df, label).agg(F.sort_array(F.collect_list(F.struct("_text", "_class", "_size"))))
    slots = df.sparkSession.range((end - first) * sets).selectExpr(f"id % {sets} AS set", f"id div {sets} + {first} AS round")
    slots = slots.withColumn("_sizes", sizes.scalar()).withColumn("_s", F.explode("_sizes"))
    last = f"(_s._size - {per_class} + i)"
    spot = f"pmod({hex_wide(hash_hex('round', 'set', '_s._text', 'i', seed))}, {last} + 1)"
    different = f"array_append(taken, CASE WHEN array_contains(taken, {spot}) THEN {last} ELSE {spot} END)"
    places = f"sequence(0L, {per_class - 1}L)"
    subset = f"aggregate({places}, CAST(array() AS ARRAY<BIGINT>), (taken, i) -> {different})"
    again = f"transform({places}, i -> pmod({hex_word(hash_hex('round', 'set', '_s._text', 'i', seed))}, _s._size))"
    picked = F.expr(f"CASE WHEN _s._size >= {per_class} THEN {subset} ELSE {again} END")
    slots = slots.select("round", "set", F.col("_s._class").alias("class"), F.posexplode(picked).alias("draw", "_index"))
    slots = slots.withColumn("draw", F.col("draw").cast("long"))
    ranked = dense_index(
        df.filter(c(label).isNotNull()).select(c(key), c(label).alias("class")), key, seed, by="class"
    )
    return slots.join(ranked, ["class", "_index"]).select("round", "set", "class", "draw", c(key))


def bootstrap(df: DataFrame, n: int | None = None, seed: int = 123, key: str = ROW_ID, row: str = "_draw") -> DataFrame:
    """``n`` rows drawn with replacement (default: as many as there are); ``row`` numbers the draws.

    Draws are uniform positions joined to the table's hash order by index, so
    no key is hotter than another.
    """
    size = df.count()
    if size == 0:
        return df.withColumn(row, F.lit(0).cast("long"))
    indexed = dense_index(df, key, seed)
    draws = df.sparkSession.range(size if n is None else n).selectExpr(
        f"id AS {row}", f"pmod({hex_wide(hash_hex('id', seed))}, {size}L) AS _index"
    )
    return draws.join(indexed, "_index").select(*pick(df.columns), row)


def _noisy(drawn: DataFrame, count: int, seed: int) -> tuple[DataFrame, list[str]]:
    """Add hash columns ``_h0..`` per draw; the texts are ``count`` standard normals over them."""
    words = (count + 3) // 4
    tagged = drawn.selectExpr("*", *[f"{hash_hex('_draw', seed, repr(f'noise{i}'))} AS _h{i}" for i in range(words)])
    return tagged, [z for i in range(words) for z in normals(f"_h{i}")][:count]


def bootstrap_credit(df: DataFrame, n: int | None = None, seed: int = 123, key: str = ROW_ID) -> DataFrame:
    """Bootstrap of the credit table with jittered ages, bills and payments.

    The draw number becomes the row id of the result.
    """
    bills, payments = S.CREDIT_BILLS, S.CREDIT_PAYMENTS
    drawn, noise = _noisy(bootstrap(df, n, seed, key), len(bills) + len(payments), seed)
    low, high = S.CREDIT_AGE
    step = f"pmod({hex_word(hash_hex('_draw', seed, repr('age')))}, 5) - 2"
    fixes = {"AGE": f"CAST(least(greatest(AGE + {step}, {low}), {high}) AS BIGINT)"}
    for name, z in zip(bills, noise):
        moved = f"{name} + {z} * 0.035D * LIMIT_BAL"
        fixes[name] = f"CAST(rint(least(greatest({moved}, LIMIT_BAL * -0.15D), LIMIT_BAL * 1.75D)) AS BIGINT)"
    for name, z in zip(payments, noise[len(bills) :]):
        fixes[name] = f"CAST(rint(greatest({name} + {z} * 0.02D * LIMIT_BAL, 0.0D)) AS BIGINT)"
    return _renumbered(drawn, df, key, fixes)


def bootstrap_generic(df: DataFrame, n: int | None = None, seed: int = 123, key: str = ROW_ID) -> DataFrame:
    """Bootstrap that adds N(0, 2 % of the deviation) to numeric columns with more than 16 values."""
    drawn = bootstrap(df, n, seed, key)
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name != key]
    few = columns_with_few_values(drawn, numeric, FEW_VALUES)
    jittered = [x for x in numeric if x not in few]
    if not jittered:
        return _renumbered(drawn, df, key, {})
    spread = drawn.agg(F.struct(*[F.stddev_samp(c(x)).alias(f"s{i}") for i, x in enumerate(jittered)]))
    tagged, noise = _noisy(drawn.withColumn("_spread", spread.scalar()), len(jittered), seed)
    fixes = {
        x: f"CASE WHEN _spread.s{i} > 0 THEN {quoted(x)} + {z} * 0.02D * _spread.s{i} ELSE CAST({quoted(x)} AS DOUBLE) END"
        for i, (x, z) in enumerate(zip(jittered, noise))
    }
    return _renumbered(tagged, df, key, fixes)


def _renumbered(drawn: DataFrame, like: DataFrame, key: str, fixes: dict[str, str]) -> DataFrame:
    cells = [named(fixes.get(x, quoted(x)), x) for x in like.columns if x != key]
    return drawn.selectExpr(named("_draw", key), *cells)


def mutated(df: DataFrame, mutator: Callable[[DataFrame, int], DataFrame] | None, seed: int) -> DataFrame:
    """Apply a caller's row mutator, keeping the columns of ``df``."""
    return df if mutator is None else mutator(df, seed).select(*pick(df.columns))

