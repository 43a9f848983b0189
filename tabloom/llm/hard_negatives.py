"""Hard-negative mining: exact inner-product search over lists that anchors of one cluster share (MAXIMUS).

Anchors are clustered by angle. A candidate x at angle t to a cluster's centre cannot score more than
``|u| |x| cos(t - r)`` with any member u, r being the cluster's widest angle. Each task sorts its candidates by that
bound once per cluster, and all members walk the sorted list together until the next bound is below what they still
need. Scores are integers, so results are exact. Anchors pass in blocks of bounded size, each read against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import materialize

#: Bytes of anchor vectors that go to the tasks at once; candidates that one list holds, and that one step of a walk scores.
BLOCK_BYTES, LIST_ROWS, STEP_ROWS = 16 << 20, 1 << 16, 2048
#: Cluster centres, drawn from the anchors by hash; anchors of one cluster that walk together.
CENTRES, MEMBERS = 256, 4096
#: Sums of products below this are exact in floating point.
EXACT = float(1 << 53)
NEVER = np.iinfo(np.int64).max


def prepared(df: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Store row, vec_id, label, q (components as integers) of the rows that take part.

    Left out are null labels and vectors, and vectors with a null or non-finite component. Vectors of unequal length are
    compared as if the shorter one ended in zeros; an empty one scores 0 with all others. Scores must fit 64 bits.
    """
    finite = f"NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    rows = df.filter(f"`{label}` IS NOT NULL AND `{vector}` IS NOT NULL AND {finite}").select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.expr(f"transform(`{vector}`, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))").alias("q"),
    )
    return materialize(rows, "embedding-rows")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """List column as a matrix, short rows filled with zeros, long ones cut (nothing meets their further parts)."""
    column = column.cast(pa.large_list(pa.int64())) if not pa.types.is_large_list(column.type) else column
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), dims), np.int64)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    inside = place < dims
    out[rows[inside], place[inside]] = flat[offsets[0] : offsets[-1]][inside]
    return out


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    return x / np.where(norms > 0, norms, 1.0)[:, None], norms


@dataclass
class Cluster:
    """Anchors that share lists, and the score range that each still asks for."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norms: np.ndarray
    #: Score ranges by member: ``low`` to ``high``, one per column; an empty range has low > high.
    low: np.ndarray
    high: np.ndarray


def clusters_of(rows: np.ndarray, labels: np.ndarray, q: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[Cluster]:
    """Deal anchors to the centre of least angle, and cut clusters to ``MEMBERS``."""
    units, norms = _units(q)
    nearest = np.argmax(units @ centres.T, axis=1) if len(centres) else np.zeros(len(q), int)
    out = []
    for k in np.unique(nearest):
        own = np.flatnonzero(nearest == k)
        for part in np.array_split(own, -(-len(own) // MEMBERS)):
            turned = part[norms[part] > 0]  # a zero vector scores 0 with all, whatever the angle
            cosines = units[turned] @ centres[k]
            radius = float(np.arccos(np.clip(cosines.min(), -1, 1))) if len(turned) else 0.0
            out.append(Cluster(centres[k], radius, rows[part], labels[part], q[part], norms[part], low[part], high[part]))
    return out


def _products(u: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    if largest < EXACT:
        return np.rint(u.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return u @ x.T


class Walk:
    """The best ``k`` candidates in each range of each member of one cluster, over any number of lists."""

    def __init__(self, cluster: Cluster, k: int, same_label: bool, step_rows: int):
        self.cluster, self.k, self.same, self.step_rows = cluster, k, same_label, step_rows
        self.ranges = cluster.low.shape[1]
        # Kept candidates: slot (member x range), score, vec_id, its row.
        self.slots = np.zeros(0, np.int64)
        self.scores, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(3))
        self.no_id = np.zeros(0, bool)
        self.need = np.where(cluster.low <= cluster.high, cluster.low, NEVER)

    def list_of(self, x: np.ndarray, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        """Walk one list: candidates by falling bound, until no member needs what is left."""
        c = self.cluster
        units, norms = _units(x)
        angles = np.arccos(np.clip(units @ c.centre, -1, 1))
        bounds = norms * np.cos(np.maximum(0.0, angles - c.radius - 1e-7)) if c.centre.any() else norms
        order = np.argsort(-bounds, kind="stable")
        largest = float(norms.max(initial=0.0)) * float(c.norms.max(initial=0.0))
        for start in range(0, len(order), self.step_rows):
            step = order[start : start + self.step_rows]
            reach = c.norms * bounds[step[0]]
            # Half a point of slack: scores are whole numbers, bounds have rounding errors.
            active = np.flatnonzero(self.need.min(axis=1) - 0.5 <= reach * (1 + 1e-9))
            if not len(active):
                return
            scores = _products(c.q[active], x[step], largest)
            alike = c.labels[active][:, None] == labels[step][None, :]
            fit = alike & (c.rows[active][:, None] != rows[step][None, :]) if self.same else ~alike
            fit &= (scores >= self.need[active].min(axis=1)[:, None]) & (scores <= c.high[active].max(axis=1)[:, None])
            self._take(active, step, scores, fit, ids, no_id, rows)

    def _take(self, active, step, scores, fit, ids, no_id, rows) -> None:
        i, j = np.nonzero(fit)
        if not len(i):
            return
        found, member, candidate = scores[i, j], active[i], step[j]
        wanted = (found[:, None] >= self.need[member]) & (found[:, None] <= self.cluster.high[member])
        at, which = np.nonzero(wanted)
        slots = np.concatenate([self.slots, member[at] * self.ranges + which])
        values = np.concatenate([self.scores, found[at]])
        new = candidate[at]
        ids, no_id, rows = (np.concatenate([a, b[new]]) for a, b in ((self.ids, ids), (self.no_id, no_id), (self.rows, rows)))
        order = np.lexsort((rows, ids, no_id, -values, slots))
        slots = slots[order]
        first = np.searchsorted(slots, slots)
        keep = np.arange(len(slots)) - first < self.k
        order = order[keep]
        self.slots, self.scores, self.ids, self.no_id, self.rows = slots[keep], values[order], ids[order], no_id[order], rows[order]
        counts = np.bincount(self.slots, minlength=self.need.size)
        full = np.flatnonzero(counts == self.k)
        last = np.cumsum(counts)[full] - 1
        # Equal scores can still win by a smaller id.
        np.maximum.at(self.need.reshape(-1), full, self.scores[last])

    def batch(self) -> pa.RecordBatch:
        member, which = np.divmod(self.slots, self.ranges)
        arrays = [
            pa.array(self.cluster.rows[member]), pa.array(self.cluster.high[member, which]),
            pa.array(self.ids, mask=self.no_id), pa.array(self.scores), pa.array(self.rows),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["anchor_row", "high", "vec_id", "score", "row"])


_FOUND = "anchor_row long, high long, vec_id long, score long, row long"


@dataclass(frozen=True)
class Sizes:
    """Bounds of what one task or one pass holds; results do not depend on them."""

    block_bytes: int = BLOCK_BYTES
    list_rows: int = LIST_ROWS
    step_rows: int = STEP_ROWS


def _search(candidates: DataFrame, clusters: list[Cluster], dims: int, k: int, same_label: bool, sizes: Sizes) -> DataFrame:
    """Each task's best ``k`` of its own candidates for every range; a task's lists have ``list_rows``, needs carry over."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(c, k, same_label, sizes.step_rows) for c in clusters]

        def one_list(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(table.column("q").combine_chunks(), dims)
            ids = table.column("vec_id")
            columns = [np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(table.column("row")), np.asarray(table.column("label"))]
            for w in walks:
                w.list_of(x, *columns)

        held, count = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, sizes.list_rows):
                piece = batch.slice(start, sizes.list_rows)
                held, count = [*held, piece], count + piece.num_rows
                if count >= sizes.list_rows:
                    one_list(held)
                    held, count = [], 0
        if held:
            one_list(held)
        for w in walks:
            yield w.batch()

    return candidates.mapInArrow(walk, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all tasks: higher scores first, then smaller ids (null last)."""
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_row", "high").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def _dims(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("q"))).first()[0] or 0


def _blocks(anchors: DataFrame, dims: int, sizes: Sizes) -> Iterator[DataFrame]:
    """Anchors in blocks of ``block_bytes`` on average, by hash of the row: every cluster may have members in every block."""
    per_block = max(1, sizes.block_bytes // (8 * max(1, dims)))
    blocks = -(-anchors.count() // per_block)
    number = F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))
    for k in range(blocks):
        yield anchors.filter(number == k)


def _collected(anchors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = anchors.select("row", "label", "q").toArrow().combine_chunks()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims), np.int64)
    return np.asarray(table.column("row")), np.asarray(table.column("label")), _matrix(table.column("q").combine_chunks(), dims)


def nearest_positives(rows: DataFrame, anchors: DataFrame, k: int, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008
    """anchor_row, vec_id, score: the first ``k`` other rows of each anchor's label."""
    dims = _dims(rows)
    centres = _centres(anchors, dims)
    out = None
    for block in _blocks(anchors, dims, sizes):
        number, labels, q = _collected(block, dims)
        edges = np.full((len(number), 1), np.iinfo(np.int64).min // 2), np.full((len(number), 1), NEVER)
        found = _search(rows, clusters_of(number, labels, q, centres, *edges), dims, k, True, sizes)
        part = materialize(_best(found, k).select("anchor_row", "vec_id", "score"), "positives")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _nothing(rows.sparkSession, "anchor_row long, vec_id long, score long")


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _centres(anchors: DataFrame, dims: int) -> np.ndarray:
    """Directions of up to CENTRES anchors, those of least hash; results do not depend on them, only the work does."""
    _, _, q = _collected(anchors.orderBy(F.xxhash64("row"), "row").limit(CENTRES), dims)
    units, norms = _units(q)
    units = np.unique(units[norms > 0], axis=0)
    return units if len(units) else np.zeros((1, dims))


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    sizes: Sizes = Sizes(),  # noqa: B008
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` come from ``prepared``, ``anchors`` are some of them. For each anchor and each of its first ``positives``
    rows of the same label: the first ``negatives`` rows of another label whose score is at most the positive's and at
    least ``share`` of it (so none where that is negative). Higher scores come first, ties by smaller id, null last.
    Rows that repeat an id are rows of their own. Anchors without a positive or negative give no row.
    """
    dims = _dims(rows)
    centres = _centres(anchors, dims)
    near = nearest_positives(rows, anchors, positives, sizes)
    part, whole = share
    found = None
    for block in _blocks(anchors, dims, sizes):
        number, labels, q = _collected(block, dims)
        # One range per different positive score; at most ``positives`` of them for each anchor.
        tops = near.join(F.broadcast(block.select(F.col("row").alias("anchor_row"))), "anchor_row", "left_semi")
        tops = tops.select("anchor_row", "score").distinct().toArrow().combine_chunks()
        high = np.full((len(number), positives), -1, np.int64)
        low = np.full((len(number), positives), NEVER, np.int64)
        order = np.argsort(number)
        place = order[np.searchsorted(number[order], np.asarray(tops.column("anchor_row")))] if tops.num_rows else np.zeros(0, int)
        scores = np.asarray(tops.column("score"), dtype=np.int64) if tops.num_rows else np.zeros(0, np.int64)
        by = np.argsort(place, kind="stable")
        place, scores = place[by], scores[by]
        column = np.arange(len(place)) - np.searchsorted(place, place)
        usable = scores >= 0
        high[place[usable], column[usable]] = scores[usable]
        low[place[usable], column[usable]] = -(-part * scores[usable] // whole)
        some = (low <= high).any(axis=1)
        groups = clusters_of(number[some], labels[some], q[some], centres, low[some], high[some])
        best = materialize(_best(_search(rows, groups, dims, negatives, False, sizes), negatives), "negatives")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = _nothing(rows.sparkSession, _FOUND + ", rank int")
    taken = found.select(
        F.col("anchor_row"), F.col("high").alias("score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    names = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return near.join(taken, ["anchor_row", "score"]).join(names, "anchor_row").select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("score").alias("positive_score"), "negative_score",
    )
