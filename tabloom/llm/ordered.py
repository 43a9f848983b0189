"""Rows in order over any number of tasks, and folds over ordered rows that hold one row at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import materialize

#: Bits of ``_id`` that count rows inside one range; the rest number the ranges.
RANGE_BITS = 33


def ordered_rows(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Store ``df`` with ``_id``, which rises in the order of ``order`` and counts on inside each range of rows.

    Ranges are dealt to tasks, so no group meets in one of them: rows that tie in all of ``order`` are cut apart by the
    place where they were read. Nulls come first.
    """
    placed = df.withColumn("_read", F.monotonically_increasing_id())
    ranges = placed.repartitionByRange(*order, "_read").sortWithinPartitions(*order, "_read")
    return materialize(ranges.drop("_read").withColumn("_id", F.monotonically_increasing_id()), label)


def with_previous(rows: DataFrame, group: str) -> DataFrame:
    """Add ``_previous``: the ``_id`` before in the same group, null for its first row. ``rows`` come from ordered_rows.

    Windows span one range each; across ranges only the last row of each is looked at.
    """
    number = F.shiftright("_id", RANGE_BITS)
    rows = rows.withColumn("_range", number)
    inside = Window.partitionBy("_range").orderBy("_id")
    last = rows.groupBy("_range").agg(F.max(F.struct("_id", F.struct(group).alias("key"))).alias("last"))
    carried = last.select(
        F.lead("_range").over(Window.orderBy("_range")).alias("_range"), F.col("last").alias("_carried")
    ).filter("_range is not null")
    before = F.lag(F.struct("_id", F.struct(group).alias("key"))).over(inside)
    before = F.coalesce(before, F.col("_carried"))
    joined = rows.join(F.broadcast(carried), "_range", "left").withColumn("_before", before)
    same = F.col("_before.key").eqNullSafe(F.struct(group))
    return joined.select(*[c for c in rows.columns if c != "_range"], F.when(same, F.col("_before._id")).alias("_previous"))


def fold_sorted(
    df: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[dict]], Iterable[dict]], schema: str
) -> DataFrame:
    """Pass the rows of each key, sorted by ``order``, through ``fold``, which gets one row after the other.

    A task holds one batch of Arrow rows, not a group: the sort spills. Rows of one key are read by one task one after
    the other, which is what a digest of all of them asks for.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = wanted

        def rows() -> Iterator[dict]:
            for batch in batches:
                lists = [c.to_pylist() for c in batch.columns]
                for values in zip(*lists, strict=True):
                    yield dict(zip(columns, values, strict=True))

        source, ahead = rows(), []

        def group(first: dict) -> Iterator[dict]:
            yield first
            for row in source:
                if row[key] != first[key]:
                    ahead.append(row)
                    return
                yield row

        pending, found = next(source, None), []
        while pending is not None:
            members = group(pending)
            found.extend(fold(members))
            for _ in members:  # what the fold has left unread
                pass
            pending = ahead.pop() if ahead else None
            if len(found) >= 1000:
                yield pa.RecordBatch.from_pylist(found, target)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
