"""Lookup joins that stay balanced when a few keys dominate the big side."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pick
from ..session import BROADCAST_ROW_BOUND

#: A key is heavy if it may have one in so many rows; there are no more heavy keys than that.
HEAVY_SHARE = 1000
#: Counters of the frequent-items sketch; its error is a small part of one in HEAVY_SHARE.
TRACKED = 16 * HEAVY_SHARE


def heavy_keys(rows: DataFrame, keys: Mapping[str, Sequence[str]]) -> dict[str, dict[int, int]]:
    """For each named list of SQL key parts: hash of a heavy key -> parts to deal its rows to, each a small share of all.

    Each task keeps frequent-items sketches of its rows, which are merged: one pass for all keys, and nothing is
    shuffled but sketches of a fixed size. All keys of one in ``HEAVY_SHARE`` rows or more are found, and few others.
    """
    if not keys:
        return {}
    hashes = rows.selectExpr(*[f"xxhash64({', '.join(parts)}) AS h{i}" for i, parts in enumerate(keys.values())])
    found = hashes.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"approx_top_k(h{i}, {HEAVY_SHARE}, {TRACKED})").alias(f"t{i}") for i in range(len(keys))],
    ).first()
    # The sketch may count a little too much or too little.
    share = lambda x: x["count"] * HEAVY_SHARE * 2 / max(1, found["n"])
    return {name: {x["item"]: math.ceil(share(x)) for x in found[f"t{i}"] or [] if share(x) >= 1} for i, name in enumerate(keys)}


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Column,
    rows_in_table: int,
    how: str = "inner",
    broadcast_rows: int | None = None,
    heavy: Mapping[int, int] | None = None,
) -> DataFrame:
    """Join ``rows`` to a ``table`` that is unique in ``on``.

    A table of checked size is broadcast. A larger one is shuffled: rows of heavy keys are dealt by ``spread`` (any well
    mixed column) to as many parts as their number asks for, and only the entries of heavy keys are repeated, once per
    part. ``heavy`` comes from ``heavy_keys``; without it, it is found by a pass over ``rows``.
    """
    if rows_in_table <= (BROADCAST_ROW_BOUND if broadcast_rows is None else broadcast_rows):
        return rows.join(F.broadcast(table), list(on), how)
    if heavy is None:
        heavy = heavy_keys(rows, {"key": pick(on)})["key"]
    if not heavy:
        return rows.join(table, list(on), how)
    known = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
    parts = F.coalesce(F.try_element_at(known, F.xxhash64(*pick(on))), F.lit(1))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
