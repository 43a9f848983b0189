"""Shared pieces of the training-data operators: distributed running sums, byte-level words, hashes."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import materialize

#: Blank characters of the word patterns, for Java and RE2 character classes.
BLANKS = r"\x20\x09-\x0D"

#: Text bytes that one numpy step works on; a single longer text makes a step of its own.
SLICE_BYTES = 1 << 20


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{BLANKS}]+")).cast("long")


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the values alone: 52 bits of their md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def running_sums(df: DataFrame, group: list[str], order: list[str], values: list[str], label: str) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over the earlier rows of the same group.

    Ranges of (group, order) are dealt to tasks, so one group may span any number of them. Only one row per range
    and group is needed to carry the sums on. Group columns must not be null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id())
    # Stored, because a range border drawn anew for a second job might differ.
    ranges = materialize(ranges, label)
    sums = ranges.groupBy("_range", *group).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_range", *group, *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values]
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranges.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    joined = local.join(offsets, ["_range", *group])
    return joined.select(*df.columns, *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}") for v in values])


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver notice that finished steps are unreachable, upon which Spark deletes their shuffle files.

    Spark does so whenever the driver's heaps are collected, which may be long after the disk is full. Python goes
    first, since its objects hold on to the JVM's; what the JVM then lets go of is found in a second round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(row_id, text) of each row with a unique row_id, and (row_id, doc_id) where that is another number.

    Ids that are unique serve as they are. Otherwise rows are numbered, and stored so that the numbers last.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if ids.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return ids.withColumnRenamed("doc_id", "row_id"), None
    rows = materialize(ids.withColumn("row_id", F.monotonically_increasing_id()), "numbered-rows")
    return rows.select("row_id", "text"), rows.select("row_id", "doc_id")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and its name.

    Ids that are unique and not null serve as they are. Otherwise rows are numbered, and stored so that numbers last.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    if ids.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        return docs, id_col
    name = free_name(docs, "_row")
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "identified-rows"), name


#: Parts that a key held by all rows is dealt to; the number of heavy keys is bounded by it too.
HEAVY_PARTS = 1000


def join_heavy(rows: DataFrame, keys: DataFrame, on: list[str], n: str, spread: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, a stored table with one row per key and its count of rows in ``n``.

    Keys with at least 1 / HEAVY_PARTS of all counted rows are heavy, so there are HEAVY_PARTS of them at most, which is
    what is broadcast. Their rows are dealt, by the columns ``spread``, to as many parts as their share asks for, and
    only their entries are repeated. Key columns must not be null.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    parts = F.ceil(F.col(n) * HEAVY_PARTS / F.lit(max(1, total))).cast("int")
    sized = keys.withColumn("_parts", F.when(F.col(n) * HEAVY_PARTS >= total, parts).otherwise(1))
    heavy = sized.filter("_parts > 1").select(*on, F.col("_parts").alias("_deal"))
    dealt = rows.join(F.broadcast(heavy), on, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_deal")), F.lit(0)).cast("int")).drop("_deal")
    entries = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", n)
    return dealt.join(entries, [*on, "_part"]).drop("_part")


# --- numpy side -----------------------------------------------------------------------------------------------------

_BYTES = np.arange(256)
#: Bytes of words between blanks, and of words of letters and digits (all bytes of non-ASCII characters belong).
NON_BLANK = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
SAME = _BYTES.astype(np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER_BASE, *_WINDOW_BASES = (int(x) | 1 for x in _RANDOM.integers(1 << 61, 1 << 62, 3, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of several texts on end: byte range, text number and hash of each, and each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> list[bytes]:
        """The words numbered i to j-1."""
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and len + 1 offsets; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, inside: np.ndarray = NON_BLANK, fold: np.ndarray = SAME) -> Words:
    """Cut texts into maximal runs of ``inside`` bytes after mapping bytes by ``fold``."""
    data, offsets = text_bytes(texts)
    data = fold[data]
    keep = inside[data]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    begin[heads] = keep[heads]
    final = keep.copy()
    final[:-1] &= ~keep[1:]
    final[heads[1:] - 1] = keep[heads[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(final) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(rows, np.arange(len(offsets)))
    lengths = ends - starts
    if len(starts):
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        codes = _BYTE_CODES[data[keep]] * _powers(_LETTER_BASE, int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(codes, at) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, starts, ends, rows, hashes, first)


def window_hashes(words: Words, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they lie in one text."""
    n = max(0, len(words.hashes) - width + 1)
    base = _WINDOW_BASES[which]
    powers, back = _powers(base, len(words.hashes)), _powers(pow(base, -1, 1 << 64), n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * powers[:-1], dtype=np.uint64)])
    hashes = mix((sums[width : width + n] - sums[:n]) * back[:n] + np.uint64(width))
    return hashes, words.rows[:n] == words.rows[width - 1 : width - 1 + n]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece have about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def as_long(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the signed numbers that Spark has."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
