"""Benchmark decontamination: an FM-index per training shard, searched backward for every benchmark window.

Shard: the texts of one Arrow piece, as a sequence of word numbers. Its Burrows-Wheeler transform is kept in a wavelet
tree, whose ranks narrow the suffix range of a window word by word from the end. Occurrences are located by walking
back to a sampled suffix position, and the words they cover are merged per document.

Only words that occur in the benchmark can take part in a match. Other words, and runs of benchmark words shorter than
the shortest window, become separators before the index is built; this loses no match and keeps indexes small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ALNUM, LOWER, Words, slices, text_or_empty, words_of

#: Every so many-th suffix position is kept.
SAMPLE_EVERY = 8
#: Text bytes of a shard, which has an index of its own.
SHARD_BYTES = 4 << 20
#: Benchmark rows that one pass over the documents searches for; a longer benchmark takes more passes.
BLOCK_ROWS = 20_000

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>"


class BitRanks:
    """Wavelet tree (one bit vector with running counts per binary digit) over small non-negative numbers."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.digits, self.ones, self.zeros = digits, [], []
        for d in range(digits - 1, -1, -1):
            bit = (symbols >> d) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before position ``at``."""
        low = np.zeros_like(at)
        for level, d in enumerate(range(self.digits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbol >> d) & 1) == 1
            low, at = (np.where(one, zeros + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at + 1] - ones[at]
            symbol = symbol * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Positions by suffix. Prefixes double each round, and only suffixes that still tie are sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    fresh = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])
    # A rank is the first place of its group, so places of settled suffixes stay as they are.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = 1
    while True:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            return order
        at = order[open_places]
        follow = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        again = np.lexsort((follow, rank[at]))
        at, follow = at[again], follow[again]
        old = rank[at]
        order[open_places] = at
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])])
        fresh[open_places] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_places, 0))
        width *= 2


class FmIndex:
    """FM-index of a sequence that ends with its only 0; patterns contain neither 0 nor 1, the separator."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        order = suffix_order(seq)
        self.tree = BitRanks(seq[order - 1], max(1, int(n_symbols - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.sampled = order % SAMPLE_EVERY == 0
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]
        self.size = len(seq)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns, given as rows of numbers and padded with -1 on the left."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column]
            live = np.flatnonzero((symbol >= 0) & (low < high))
            if len(live):
                first = self.before[symbol[live]]
                low[live], high[live] = (first + self.tree.rank(symbol[live], x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back until a sampled one is met."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            symbol = self.tree.access(rows[todo])
            rows[todo] = self.before[symbol] + self.tree.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.positions[self.place[rows]] + steps


class Phrases:
    """The distinct windows of benchmark items as rows of word numbers (2 and up), and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM, LOWER)
        self.width = width
        self.vocabulary, numbers = np.unique(words.hashes, return_inverse=True)
        numbers = numbers + 2
        found: dict[tuple[int, ...], set[str]] = {}
        for (item, _), i, j in zip(items, words.first[:-1], words.first[1:], strict=True):
            for k in range(i, max(i + 1, j - width + 1) if j > i else i):
                found.setdefault(tuple(numbers[k : min(j, k + width)].tolist()), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.rows = np.full((len(found), width), -1, np.int64)
        for r, window in enumerate(found):
            self.rows[r, width - len(window) :] = window
        self.shortest = int(self.lengths.min()) if len(found) else 0

    def numbered(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The shard's sequence (1 separates, 0 ends) and the word that each place of it stands for."""
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words.hashes
        begin, end = known.copy(), known.copy()
        begin[1:] &= ~known[:-1] | (words.rows[1:] != words.rows[:-1])
        end[:-1] &= ~known[1:] | (words.rows[1:] != words.rows[:-1])
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = ends - starts >= self.shortest
        starts, lengths = starts[long], (ends - starts)[long]
        # Each run is followed by a separator.
        total = int((lengths + 1).sum())
        offsets = np.cumsum(lengths + 1) - (lengths + 1)
        source = np.arange(total) - np.repeat(offsets, lengths + 1) + np.repeat(starts, lengths + 1)
        separator = np.zeros(total, bool)
        separator[offsets + lengths] = True
        source = np.minimum(source, max(0, len(at) - 1))
        return np.append(np.where(separator, 1, at[source] + 2), 0), source

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window number of every occurrence of a window in the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.items) or not len(words.hashes):
            return none, none
        seq, source = self.numbered(words)
        if len(seq) == 1:
            return none, none
        index = FmIndex(seq, len(self.vocabulary) + 2)
        low, high = index.search(self.rows)
        counts = np.maximum(0, high - low)
        window = np.repeat(np.arange(len(counts)), counts)
        rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        return source[index.locate(rows)], window


def _hits(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text", SHARD_BYTES):
        words = words_of(piece.column("text"), ALNUM, LOWER)
        at, window = phrases.occurrences(words)
        # Merge the spans: +1 where a span starts, -1 after its end; occurrences never cross texts.
        edges = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + phrases.lengths[window], -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
        items: list[set[str]] = [set() for _ in range(piece.num_rows)]
        for row, w in np.unique(np.stack([words.rows[at], window], 1), axis=0).tolist():
            items[row].update(phrases.items[w])
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                pa.array(np.diff(words.first)),
                pa.array(np.diff(covered[words.first])),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "n_hit", "items"],
        )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids of items with occurring windows).

    Windows of ``width`` words; an item of fewer words is one window. Null and empty texts have no words, a null item
    id is the empty string, repeated rows are answered each. The benchmark is searched in blocks of ``block_rows``
    items, each a broadcast of bounded size. Hits of several blocks are merged by the number of the row.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_or_empty(item_text_col).alias("text")
    ).distinct()
    n = items.count()
    if n > block_rows:
        return _many_blocks(docs, items, n, width, id_col, text_col, block_rows)
    phrases = Phrases([tuple(x) for x in items.collect()], width)
    return _search(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), phrases)


def clean(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts hold no window; filtered where they are read."""
    items = benchmark.select(F.lit("").alias("item"), text_or_empty("text").alias("text")).distinct()
    n = items.count()
    blocks = 1 if n <= block_rows else -(-n // block_rows) * 2
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    for block in range(blocks):
        phrases = Phrases([tuple(x) for x in items.filter(F.col("block") == block).select("item", "text").collect()], width)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        docs = docs.mapInArrow(lambda batches, shared=shared: _unhit(batches, text_col, shared.value), docs.schema)
    return docs


def _unhit(batches: Iterator[pa.RecordBatch], text: str, phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, text, SHARD_BYTES):
        words = words_of(piece.column(text), ALNUM, LOWER)
        at, _ = phrases.occurrences(words)
        keep = np.ones(piece.num_rows, bool)
        keep[words.rows[at]] = False
        yield piece.filter(pa.array(keep))


def _search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    return docs.mapInArrow(lambda batches: _hits(batches, shared.value), SCHEMA)


def _many_blocks(docs: DataFrame, items: DataFrame, n: int, width: int, id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """As ``contamination``, for a benchmark of several blocks: each block says which words it hits, as word ranges."""
    blocks = -(-n // block_rows) * 2  # hashed blocks differ in size; half full on average
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, text_key string, n_words long, ranges array<struct<low:long,high:long>>, items array<string>"
    parts = []
    for block in range(blocks):
        phrases = Phrases([tuple(x) for x in items.filter(F.col("block") == block).select("item", "text").collect()], width)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        parts.append(docs.mapInArrow(lambda batches, shared=shared: _ranges(batches, shared.value), schema))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("doc_id", "text_key").agg(
        (F.count("*") / blocks).cast("int").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("ranges"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Words covered by the sorted ranges: each adds what reaches beyond all before it.
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))

    def grow(state, r):
        return F.struct(
            F.greatest(state["end"], r["high"]).alias("end"),
            (state["hit"] + F.greatest(F.lit(0).cast("long"), r["high"] - F.greatest(state["end"], r["low"]))).alias("hit"),
        )

    hit = F.aggregate("ranges", zero, grow, lambda s: s["hit"])
    merged = merged.select("doc_id", "n_words", hit.alias("n_hit"), "items", "copies")
    return merged.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def _ranges(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text", SHARD_BYTES):
        words = words_of(piece.column("text"), ALNUM, LOWER)
        at, window = phrases.occurrences(words)
        ranges: list[set[tuple[int, int]]] = [set() for _ in range(piece.num_rows)]
        items: list[set[str]] = [set() for _ in range(piece.num_rows)]
        for place, w in zip(at.tolist(), window.tolist(), strict=True):
            row = int(words.rows[place])
            low = place - int(words.first[row])
            ranges[row].add((low, low + int(phrases.lengths[w])))
            items[row].update(phrases.items[w])
        keys = [hashlib.md5((t.as_py() or "").encode()).hexdigest() for t in piece.column("text")]
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                pa.array(keys),
                pa.array(np.diff(words.first)),
                pa.array([[{"low": a, "high": b} for a, b in sorted(x)] for x in ranges], kind),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ],
            ["doc_id", "text_key", "n_words", "ranges", "items"],
        )
