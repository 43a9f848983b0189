"""Near-duplicate detection: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, NON_BLANK, as_long, free_shuffles, identified, keyed_rows, mix, slices, window_hashes, words_of
from tabloom.llm.components import components
from tabloom.session import materialize

#: Buckets up to this size are compared pair by pair; larger ones by their first member, then cluster by cluster.
SMALL = 16
#: Rows of either side that one task of the cluster comparison holds.
BLOCK = 256

#: 64 bands of 6 coordinates: texts of similarity 0.8 share no band with a chance of 4e-9.
BANDS, ROWS = 64, 6
SIZE = BANDS * ROWS

_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 2 * SIZE, dtype=np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = _SEEDS[:ROWS] | np.uint64(1)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of distinct 64-bit elements.

    In round r each element goes to one hashed bin, and each bin keeps the least (r, hash). After SIZE rounds a bin
    that is still empty gets the least of all elements in a round of its own, so every coordinate is filled. Two
    sketches agree in a coordinate with a chance of the Jaccard similarity, concentrated as if bins were independent.
    """
    out = np.full(SIZE, _EMPTY, np.uint64)
    done = 0
    while done < SIZE and out.max() == _EMPTY:
        # Later rounds never change filled bins, so several can be thrown at once.
        some = min(SIZE - done, max(1, -(-2 * SIZE // len(elements))))
        x = mix((elements[None, :] ^ _SEEDS[done : done + some, None]).ravel())
        bins = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(SIZE)) >> np.uint64(32)
        rounds = np.repeat(np.arange(done, done + some, dtype=np.uint64), len(elements))
        np.minimum.at(out, bins.astype(np.int64), (rounds << np.uint64(54)) | (x >> np.uint64(10)))
        done += some
    for b in np.flatnonzero(out == _EMPTY):
        own = mix(elements ^ _SEEDS[SIZE + b]).min()
        out[b] = (np.uint64(SIZE + b) << np.uint64(54)) | (own >> np.uint64(10))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = mix(coordinates).reshape(BANDS, ROWS) * _ODD
    return mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct 2-word shingles; one word is a shingle by itself."""
    words = words_of(texts, NON_BLANK, LOWER)
    pairs, _ = window_hashes(words, 2)
    for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(pairs[i : j - 1]) if j - i > 1 else mix(words.hashes[i:j])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        sizes, keys, bands = [], [], []
        for elements in shingle_sets(piece.column("text")):
            sizes.append(len(elements))
            keys.append(hashlib.md5(elements.tobytes()).digest())
            bands.append(as_long(band_keys(sketch(elements))) if len(elements) else None)
        yield pa.RecordBatch.from_arrays(
            [piece.column("row_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["row_id", "n", "set_key", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        sets = [as_long(x) for x in shingle_sets(piece.column("text"))]
        yield pa.RecordBatch.from_arrays([piece.column("row_id"), pa.array(sets, pa.list_(pa.int64()))], ["row_id", "elements"])


def _linked(a: np.ndarray, owners: np.ndarray, elements: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of several sets (sorted ``elements`` with ``owners``, and ``sizes``) are as similar to ``a`` as asked."""
    low, high = np.searchsorted(elements, a, "left"), np.searchsorted(elements, a, "right")
    counts = high - low
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    common = np.bincount(owners[at], minlength=len(sizes))
    return np.flatnonzero(100 * common >= percent * (len(a) + sizes - common))


def _compare(rows: pa.Table, percent: int) -> pa.Table:
    """Links between the attached texts and the members of one block; both are at most about BLOCK rows."""
    members, attached = (rows.filter(pc.equal(rows.column("attached"), x)) for x in (False, True))
    if not members.num_rows or not attached.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    ids = members.column("row_id").to_numpy()
    lists = members.column("elements").combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    elements, owners = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owners = elements[order], owners[order]
    a, b = [], []
    for row_id, own in zip(attached.column("row_id").to_pylist(), attached.column("elements"), strict=True):
        found = ids[_linked(own.values.to_numpy(), owners, elements, sizes, percent)]
        found = found[found != row_id]
        a.append(np.full(len(found), row_id))
        b.append(found)
    return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) to verify: all of a small bucket, and first member with each other one of a large bucket."""
    row = F.struct("row_id", "n")
    small = members.filter(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def with_later(x):
        return F.transform(F.filter("rows", lambda y: y["row_id"] > x["row_id"]), lambda y: F.struct(x.alias("x"), y.alias("y")))

    small = small.select(F.explode(F.flatten(F.transform("rows", with_later))).alias("p")).select(
        F.col("p.x.row_id").alias("a"), F.col("p.y.row_id").alias("b"), F.col("p.x.n").alias("n_a"), F.col("p.y.n").alias("n_b")
    )
    large = members.filter((F.col("size") > SMALL) & (F.col("row_id") != F.col("first.row_id"))).select(
        F.col("first.row_id").alias("a"), F.col("row_id").alias("b"), F.col("first.n").alias("n_a"), F.col("n").alias("n_b")
    )
    near_size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return small.union(large).filter(near_size).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    right = pairs.join(sets.select(F.col("row_id").alias("b"), F.col("elements").alias("of_b")), "b")
    both = right.join(sets.select(F.col("row_id").alias("a"), F.col("elements").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _cluster_links(members: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links that the first members of large buckets have not shown.

    In each large bucket of more than one component, texts outside the most frequent component are attached to it; an
    attached text is compared on full sets with that whole component and with all that is attached to it. Components
    are dealt out in blocks, so a task holds two blocks of sets and gives back links only.
    """
    large = members.filter(F.col("size") > SMALL).select("key", "row_id")
    large = large.join(parts.select(F.col("node").alias("row_id"), "component"), "row_id", "left")
    large = large.withColumn("component", F.coalesce("component", "row_id"))
    counts = large.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.count("*").alias("k"), F.max_by("component", F.struct("c", "component")).alias("main"))
    open_buckets = main.filter("k > 1").select("key", "main")
    attached = large.join(open_buckets, "key").filter("component != main").select("main", "row_id").distinct()
    attached = materialize(attached, "near-attached")
    if attached.isEmpty():
        return None
    mains = attached.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    own = parts.select(F.col("component").alias("main"), F.col("node").alias("row_id")).join(mains.select("main"), "main")
    alone = mains.select("main", F.col("main").alias("row_id"))  # a component of one text has no links yet
    own = materialize(own.union(alone).union(attached).distinct(), "near-clusters")
    sizes = own.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(mains, "main")

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        rows = rows.join(sizes, "main").join(sets, "row_id")
        place = F.pmod(F.xxhash64("row_id"), F.col(f"{mine}s")).alias(mine)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)).alias(other)
        return rows.select("main", "row_id", "elements", place, every)

    left = dealt(own, "block", "chunk").select("main", "block", "chunk", "row_id", "elements", F.lit(False).alias("attached"))
    right = dealt(attached, "chunk", "block").select("main", "block", "chunk", "row_id", "elements", F.lit(True).alias("attached"))
    return left.union(right).groupBy("main", "block", "chunk").applyInArrow(lambda x: _compare(x, percent), "a long, b long")


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts of equal shingle sets are one class, and only a class's first row is banded. Pairs that share a band are
    verified on full sets; components are those of the verified links (see ``_pairs`` and ``_cluster_links``: no link
    between components is left unchecked). The smallest id of a component names it and is ``kept``.

    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an id are rows of their own
    in the same component, which all carry ``kept`` if it is their id; a null id is smallest only among nulls. Other
    columns are not read.
    """
    texts, names = keyed_rows(docs, id_col, text_col)
    sketches = materialize(texts.mapInArrow(_sketches, "row_id long, n long, set_key binary, bands array<long>"), "near-sketches")
    classes = sketches.filter("n > 0").groupBy("set_key").agg(F.min("row_id").alias("class"))
    firsts = sketches.join(classes.select(F.col("class").alias("row_id")), "row_id", "left_semi")
    firsts = materialize(firsts.select("row_id", "n", "bands"), "near-firsts")
    banded = firsts.select("row_id", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("row_id", "n")).alias("first")).filter("size > 1")
    members = materialize(banded.join(buckets, "key"), "near-members")
    needed = members.select("row_id").distinct()
    sets = texts.join(needed, "row_id", "left_semi").mapInArrow(_sets, "row_id long, elements array<long>")
    sets = materialize(sets, "near-sets")
    free_shuffles(docs.sparkSession)
    links = materialize(_verified(_pairs(members, percent), sets, percent), "near-links")
    parts = components(links)
    more = _cluster_links(members, parts, sets, percent)
    if more is not None:
        parts = components(parts.toDF("a", "b").union(more))
    rows = sketches.select("row_id", F.col("n").alias("n_shingles"), "set_key").join(classes, "set_key", "left")
    rows = rows.join(parts.withColumnRenamed("node", "class"), "class", "left")
    # Texts without shingles have no class of their own: all share the empty set's key.
    own = F.when(F.col("n_shingles") == 0, F.col("row_id")).otherwise(F.coalesce("component", "class"))
    rows = rows.select("row_id", "n_shingles", own.alias("component"))
    if names is None:
        rows = rows.select(F.col("row_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    else:
        rows = rows.join(names, "row_id")
        least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        rows = rows.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of near copies, with all its columns: the smallest id's.

    Rows that share an id or have none are told apart by a stored row number, and the smallest of these stays. Texts
    without words are near nothing and all stay.
    """
    rows, key = identified(docs, id_col)
    # Read from the stored rows under plain names, so other columns cannot clash.
    narrow = rows.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    kept = near_groups(narrow, percent).filter("kept").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
