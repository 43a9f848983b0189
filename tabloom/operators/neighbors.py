"""Distance of every synthetic row to its closest real record, exactly.

The distance is the root of the mean, over columns, of the squared difference:
numbers scaled by the real range, categories 0 or 1. Comparing all pairs in one
join would emit them; instead Spark searches a tree of boxes:

1. real rows are reduced to distinct ones; a synthetic row equal to one of them
   is at distance 0 and found by an equi join;
2. distinct rows are cut at numbers or category texts, level by level, until
   cells can be held by a task; each cell keeps the least and greatest number
   and text of every column, its box;
3. a synthetic row visits the cell whose box is nearest, which gives a bound,
   then the next few that are nearer than the bound, then what the tighter
   bound still leaves;
4. a task that holds a cell and its visitors cuts the cell further, into tiles,
   and compares a visitor with the tiles whose boxes are nearer than its bound.

Rows travel once per cell, not per tile, packed by column and compressed in
blocks, and cells have bounded size, so no group grows with the data. Nothing is dropped: pruning only skips boxes that
cannot hold a closer row.
"""

from __future__ import annotations

from collections.abc import Collection

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, common_columns, is_text, key_text, literal, quoted
from ..functions.numeric import num
from ..functions.tiles import Cuts, cell_facts, cell_minima, cells_to_visit, merged_facts, open_probes, probe_blocks, real_blocks, to_children
from ..session import materialize
from .ranking import prefix_sums
from .sampling import ROW_ID, capped_sample

#: Real rows per tile, and children of a node of the tree that a task builds.
TILE_ROWS = 1024
FANOUT = 16
#: Real and synthetic rows that meet in a task, at most; tasks that a search is cut into, if there is work for them.
NODE_ROWS = 262144
PROBE_ROWS = 262144
TASKS, TASK_PROBES, MOST_TASKS = 48, 8192, 2048
#: Children of a node above the cells; levels of nodes, after which cells that are still too large are cut by hash.
CELLS = 256
LEVELS = 7
#: Rows of the sample that tells where a node is cut, for each of its children.
SEEN_ROWS = 64
#: Cells that a synthetic row visits after its nearest one before its bound is looked at again.
NEAREST_CELLS = 4
_FACTS = "cell long, n long, low array<double>, high array<double>, first array<string>, last array<string>"
_FEATURES = "x array<double>, k array<string>"


def _encoded(
    schema: T.StructType, numeric: list[str], scale: dict[str, tuple[float, float]], texts: list[str]
) -> list[str]:
    """``x``: scaled numbers (missing as 0); ``k``: category texts (missing equals missing)."""
    numbers = []
    for name in numeric:
        low, width = (literal(v) for v in scale[name])
        numbers.append(f"(coalesce(CAST({num(schema, name)} AS DOUBLE), {low}) - {low}) / {width}")
    words = [f"coalesce({key_text(schema, name)}, {literal(chr(0))})" for name in texts]
    return [
        f"CAST(array({', '.join(numbers)}) AS ARRAY<DOUBLE>) AS x",
        f"CAST(array({', '.join(words)}) AS ARRAY<STRING>) AS k",
    ]


def _real_blocks(placed: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``cell, a, block``: the real rows of each cell, in parts of ``NODE_ROWS`` at most, packed and stored for all passes."""
    parts = {cell: n_real for cell, n in sizes.items() if (n_real := -(-n // NODE_ROWS)) > 1}
    rows = placed.select("x", "k", "cell", F.xxhash64("x", "k").alias("h"))
    return materialize(rows.mapInArrow(real_blocks(parts), "cell long, a int, block binary"), "real-blocks")


def _cell_minima(
    probes: DataFrame, cells: pa.Table | None, places: tuple[int, int | None], asked: dict[int, int], sizes: dict[int, int],
    blocks: DataFrame, tile_rows: int, fanout: int,
) -> DataFrame:
    """``id, d, compared`` per visit: smallest squared distance of each visitor (id, x, k, d) to a cell's real rows.

    ``asked`` and ``sizes``: probes and real rows of each cell. Few visits are dealt to enough tasks, many to groups of
    bounded size.
    """
    key = probes.schema["id"].dataType.simpleString()
    group = min(PROBE_ROWS, max(TASK_PROBES, sum(asked.values()) // TASKS))
    parts = {cell: (max(1, -(-sizes[cell] // NODE_ROWS)), max(1, -(-n // group))) for cell, n in asked.items()}
    spark = probes.sparkSession
    left = probes.withColumn("h", F.xxhash64("id", "x", "k")).mapInArrow(
        probe_blocks(cells, places, parts), "cell long, a int, b int, block binary"
    )
    counts = spark.createDataFrame([(cell, n) for cell, (_, n) in parts.items()], "cell long, n_probe int")
    right = blocks.join(F.broadcast(counts), "cell")  # one row per cell
    right = right.select("cell", "a", F.explode(F.sequence(F.lit(0), F.col("n_probe") - 1)).alias("b"), "block")
    # Blocks are small for the work in them, so tasks are counted by groups and not by bytes.
    tasks = min(MOST_TASKS, max(TASKS, 2 * sum(a * b for a, b in parts.values())))
    left, right = (side.repartition(tasks, "cell", "a", "b").groupBy("cell", "a", "b") for side in (left, right))
    kind = probes.select("id").limit(0).toArrow().schema.field("id").type
    return left.cogroup(right).applyInArrow(cell_minima(tile_rows, fanout, kind), f"id {key}, d double, compared long")


class _Tree:
    """Distinct real rows in a tree of cells: ``placed`` (x, k, cell of the leaf), ``leaves`` (cell, n and its box), and per
    level the nodes (parent, cell, n, leaf, box)."""

    def __init__(self, distinct: DataFrame, n_real: int, tile_rows: int, fanout: int):
        self.levels: list[DataFrame] = []
        rows = distinct.withColumn("cell", F.lit(0).cast("long"))
        sizes, placed, leaves = {0: n_real}, [], []
        for level in range(LEVELS):
            # Half as many rows as a cell may have, so that most children are below it.
            wanted = {cell: min(fanout, -(-2 * n // tile_rows)) for cell, n in sizes.items()}
            apart = max(1, sum(sizes.values()) // (SEEN_ROWS * sum(wanted.values())))
            seen = rows.filter(F.pmod(F.xxhash64("x", "k"), F.lit(apart)) == 0)
            moved = rows.mapInArrow(to_children(Cuts(seen.toArrow(), wanted, fanout)), f"{_FEATURES}, cell long")
            moved = materialize(moved, "cells")
            facts = moved.mapInArrow(cell_facts, _FACTS).groupBy("cell").applyInArrow(merged_facts, _FACTS)
            parent = F.floor((F.col("cell") - 1) / (fanout + 1)).cast("long").alias("parent")
            leaf = (F.col("n") <= tile_rows) if level + 1 < LEVELS else F.lit(True)
            nodes = materialize(facts.select(parent, "*", leaf.alias("leaf")), "nodes")
            self.levels.append(nodes)
            leaves.append(nodes.filter("leaf").drop("parent", "leaf"))
            sizes = {node.cell: node.n for node in nodes.filter("NOT leaf").select("cell", "n").toLocalIterator()}
            if not sizes:
                placed.append(moved)
                break
            marked = moved.join(nodes.select("cell", "leaf"), "cell")
            placed.append(marked.filter("leaf").select("x", "k", "cell"))
            rows = materialize(marked.filter("NOT leaf").select("x", "k", "cell"), "large-cells")
        self.placed, self.leaves = _union(placed), _union(leaves)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search(tree: _Tree, probes: DataFrame, tile_rows: int, fanout: int) -> DataFrame:
    """``id, d, compared``: the nearest cell first, then the next ones, then what the bound leaves."""
    boxes = tree.leaves.toArrow()
    sizes = dict(zip(boxes["cell"].to_pylist(), boxes["n"].to_pylist()))
    blocks = _real_blocks(tree.placed, sizes)
    bounded = probes.withColumn("d", F.lit(float("inf")))
    found = [bounded.select("id", "d", F.lit(0).cast("long").alias("compared")).filter(F.lit(False))]
    for places in ((0, 1), (1, 1 + NEAREST_CELLS), (1 + NEAREST_CELLS, None)):
        if places[0] >= boxes.num_rows:
            break
        if places[0]:
            # Only rows that may still come closer go on.
            nearest = found[-1].select("id", "d")
            bounded = bounded.withColumnRenamed("d", "before").join(nearest, "id", "left")
            bounded = bounded.withColumn("d", F.least("d", "before")).select(*probes.columns, "d")
            bounded = materialize(bounded.mapInArrow(open_probes(boxes, places[0]), bounded.schema), "bounded")
        asked = bounded.select("x", "k", "d").mapInArrow(cells_to_visit(boxes, places), "cell long, asked long")
        asked = {row.cell: row.n for row in asked.groupBy("cell").agg(F.sum("asked").alias("n")).collect()}
        if not asked:
            break
        minima = _cell_minima(bounded, boxes, places, asked, sizes, blocks, tile_rows, fanout).groupBy("id")
        found.append(materialize(minima.agg(F.min("d").alias("d"), F.sum("compared").alias("compared")), "minima"))
    return _union(found)


def distance_to_closest_record(
    real: DataFrame,
    synthetic: DataFrame,
    categorical: Collection[str] = (),
    max_real: int | None = None,
    max_synthetic: int | None = None,
    seed: int = 42,
    ignore: Collection[str] = (),
    key: str = ROW_ID,
    tile_rows: int = TILE_ROWS,
    fanout: int = FANOUT,
    compared: bool = False,
) -> DataFrame:
    """``key, dcr`` for every synthetic row (or for a capped sample, if asked for).

    A row with an infinite number is infinitely far from all others. Results do
    not depend on ``tile_rows``, the real rows that are compared with one by one,
    nor on ``fanout``, the children of a node. Real columns without any number are
    left out of the distance. The caps are the caller's choice; without them all
    rows on both sides count. ``compared`` adds the number of real rows that the
    row was compared with.
    """
    if max_real is not None:
        real = capped_sample(real, max_real, seed, key)
    if max_synthetic is not None:
        synthetic = capped_sample(synthetic, max_synthetic, seed, key)
    names = [n for n in common_columns(real, synthetic) if n != key and n not in ignore]
    texts = [n for n in names if n in set(categorical) or is_text(real.schema[n].dataType)]
    numeric = [n for n in names if n not in texts]
    id_type = synthetic.schema[key].dataType.simpleString()
    empty = real.sparkSession.createDataFrame([], f"`{key}` {id_type}, dcr double" + ", compared long" * compared)
    scale = {}
    if numeric:
        limits = real.selectExpr(
            *[f"CAST({f}({num(real.schema, n)}) AS DOUBLE) AS {tag}{i}" for i, n in enumerate(numeric) for f, tag in (("min", "lo"), ("max", "hi"))]
        ).first()
        for i, n in enumerate(numeric):
            low, high = limits[f"lo{i}"], limits[f"hi{i}"]
            if low is not None:
                scale[n] = (low, high - low if high > low else 1.0)
        numeric = [n for n in numeric if n in scale]
    if not numeric and not texts:
        return empty

    if real.isEmpty():
        return empty
    # A row with an infinite number is nearest to nothing, on either side.
    finite = "NOT exists(x, v -> isnan(v) OR abs(v) = double('infinity'))"
    distinct = real.selectExpr(*_encoded(real.schema, numeric, scale, texts)).filter(finite).distinct()
    distinct = materialize(distinct, "real-rows")
    n_real = distinct.count()
    probes = materialize(synthetic.selectExpr(f"{quoted(key)} AS id", *_encoded(synthetic.schema, numeric, scale, texts)), "probes")
    width = len(numeric) + len(texts)

    # Equal rows are at distance 0, which nothing can beat.
    # Rows meet by hash, a key that sorts fast, and are compared when they do.
    met = distinct.selectExpr("xxhash64(x, k) AS h", "x AS rx", "k AS rk", "true AS same")
    same = " AND ".join(f"forall(zip_with({n}, r{n}, (a, b) -> a = b), v -> v)" for n in "xk")
    hashed = probes.filter(finite).withColumn("_h", F.xxhash64("x", "k"))
    marked = hashed.join(met, F.expr(f"_h = h AND {same}"), "left").select(*probes.columns, "same")
    marked = materialize(marked, "equal-rows")
    equal = marked.filter("same").select("id", F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("compared"))
    others = marked.filter("same IS NULL").drop("same")
    cell_rows = max(tile_rows, NODE_ROWS)
    if n_real <= cell_rows:
        sizes, asked = {0: n_real}, {0: others.count()}
        blocks = _real_blocks(distinct.withColumn("cell", F.lit(0).cast("long")), sizes)
        unbounded = others.withColumn("d", F.lit(float("inf")))
        found = _cell_minima(unbounded, None, (0, None), asked, sizes, blocks, tile_rows, fanout)
    else:
        found = _search(_Tree(distinct, n_real, cell_rows, CELLS), others, tile_rows, fanout)
    nearest = found.unionByName(equal).groupBy("id").agg(F.min("d").alias("d"), F.sum("compared").alias("compared"))
    nearest = probes.select("id").join(nearest, "id", "left")
    dcr = F.when(F.col("d").isNull() | F.isnan("d"), F.lit(float("inf"))).otherwise(F.sqrt(F.col("d") / width))
    count = [F.coalesce("compared", F.lit(0).cast("long")).alias("compared")] if compared else []
    return nearest.select(F.col("id").alias(key), dcr.alias("dcr"), *count)


def describe(df: DataFrame, column: str = "dcr") -> DataFrame:
    """One row: count, mean, sample deviation, minimum, linear quartiles, maximum.

    All of it follows from the counts of distinct values, stored once, so the
    input is computed once and no task holds the whole column.
    """
    value = c(column)
    counted = df.filter(value.isNotNull()).groupBy(value.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "distance-counts")
    basics = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("count"),
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    gap = F.col("v") - basics.select("mean").scalar()
    std = F.sqrt(F.try_divide(F.sum(F.col("n") * gap * gap), (F.sum("n") - 1).cast("double")))
    ranked = prefix_sums(counted, "v", ["n"]).withColumn("last", basics.select(F.col("count") - 1).scalar())
    spots = {f"q{i}": F.col("last") * (i / 4) for i in (1, 2, 3)}
    around = ranked.agg(
        *[F.min(F.when(F.col("cum_n") > F.floor(at), F.col("v"))).alias(f"{q}_lo") for q, at in spots.items()],
        *[F.min(F.when(F.col("cum_n") > F.ceil(at), F.col("v"))).alias(f"{q}_hi") for q, at in spots.items()],
        *[F.max(at - F.floor(at)).alias(f"{q}_w") for q, at in spots.items()],
    )
    quartiles = around.select(
        F.struct(*[(F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * F.col(f"{q}_w")).alias(q) for q in spots])
    )
    return basics.withColumn("std", counted.agg(std).scalar()).withColumn("q", quartiles.scalar()).select(
        "count", "mean", "std", "min",
        F.col("q.q1").alias("25%"), F.col("q.q2").alias("50%"), F.col("q.q3").alias("75%"), "max",
    )
