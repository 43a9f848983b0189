"""Connected components by alternating star operations; links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Hang the larger neighbours of each node under its least neighbour (or itself)."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours under the least of these."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b); component is the least node reachable.

    The rounds needed grow with the logarithm of the longest path; each is stored, so lineage stays short.
    """
    links = materialize(links.select("a", "b").filter("a != b").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct()
            )
        seen = state
        links = materialize(_small_star(_large_star(links).distinct()).distinct(), "links")
