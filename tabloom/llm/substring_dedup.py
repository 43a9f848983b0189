"""Substring dedup over a sparse De Bruijn graph of token k-mers.

Vertices are the k-mers that are least by hash in some window of 35 words (so equal windows hold equal vertices at equal
places), edges run from one to the next in a text and are labelled with all words they span; the ends of a text count
as vertices too. Spark groups vertices, joins the repeated ones back to their places, and tells where every occurrence
goes on by the same edge: there the path does not branch and is compacted. A compacted path of a repeated vertex is a
repeated span. Windows that hang over the end of a path (21 words at most on either side) are verified one by one at
their source coordinates, by a 128-bit hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import Words, as_long, free_shuffles, join_heavy, keyed_rows, mix, slices, window_hashes, words_of
from tabloom.session import materialize

#: Words of a k-mer. Windows of 35 words then hold 22 k-mers, and about one place in 11 becomes a vertex. Shorter k-mers
#: make fewer vertices, but repeat more often in windows that do not, and leave more words at the ends of paths.
K = 14

ANCHORS = "row_id long, pos int, vertex long, ahead long, back long"
VERDICTS = "row_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>, text string, start int, h1 long, h2 long"
RESULT = "row_id long, n_words long, n_removed long, kept_sha256 string"


def _least_places(hashes: np.ndarray, whole: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` k-mers in one text, the place of the (leftmost) least hash; -1 elsewhere."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Least value by doubling, then its leftmost place the same way.
    best, at, span = hashes, np.arange(len(hashes)), 1
    while span < width:
        step = min(span, width - span)
        left, right = slice(0, len(best) - step), slice(step, len(best))
        take = best[right] < best[left]
        best, at = np.where(take, best[right], best[left]), np.where(take, at[right], at[left])
        span += step
    return np.where(whole[:n], at[:n], -1)


class _Graph:
    """Vertices of one piece of texts: their words, and labels of the edges on both sides."""

    def __init__(self, words: Words, width: int):
        self.words, self.width = words, width
        kmers, _ = window_hashes(words, K)
        n = max(0, len(words.hashes) - width + 1)
        whole = words.rows[:n] == words.rows[width - 1 : width - 1 + n]
        self.owner = _least_places(kmers, whole, width - K + 1)
        self.at = np.unique(self.owner[self.owner >= 0])
        self.vertex = kmers[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the words from each vertex to the end of the next one (or of the text), and likewise backward."""
        words, at = self.words, self.at
        rows = words.rows[at]
        first, stop = words.first[rows], words.first[rows + 1]
        follow = np.append(at[1:] + K, 0)
        same = np.append(rows[1:] == rows[:-1], False)[: len(at)]
        end = np.where(same, follow[: len(at)], stop)
        before = np.append(0, at[:-1])[: len(at)]
        start = np.where(np.append(False, same[:-1])[: len(at)], before, first)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hashes ^ np.uint64(0x5BD1E995)) * self.scale(), dtype=np.uint64)])

        def label(low: np.ndarray, high: np.ndarray, inner: np.ndarray) -> np.ndarray:
            turned = (prefix[high] - prefix[low]) * self.unscale()[low]
            return mix(turned + mix((high - low).astype(np.uint64) * np.uint64(2) + inner.astype(np.uint64)))

        return label(at, end, same), label(start, at + K, np.append(False, same[:-1])[: len(at)])

    _BASE = 0x9E3779B97F4A7C15

    def scale(self) -> np.ndarray:
        out = np.full(len(self.words.hashes), self._BASE, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def unscale(self) -> np.ndarray:
        out = np.full(len(self.words.hashes) + 1, pow(self._BASE, -1, 1 << 64), np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        words = words_of(piece.column("text"))
        graph = _Graph(words, width)
        if not len(graph.at):
            continue
        ahead, back = graph.labels()
        rows = words.rows[graph.at]
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("row_id").take(pa.array(rows)),
                pa.array((graph.at - words.first[rows]).astype(np.int32)),
                as_long(graph.vertex),
                as_long(ahead),
                as_long(back),
            ],
            ["row_id", "pos", "vertex", "ahead", "back"],
        )


def _paths(places: list[dict], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's repeated vertices, and how far their compacted paths reach to the left and right."""
    places = sorted(places, key=lambda p: p["pos"])
    pos = np.array([p["pos"] for p in places], np.int64)
    left, right = pos.copy(), pos + K
    for i, p in enumerate(places):
        if p["one_back"]:
            left[i] = left[i - 1] if i else 0
    for i in range(len(places) - 1, -1, -1):
        if places[i]["one_ahead"]:
            right[i] = right[i + 1] if i + 1 < len(places) else n_words
    return pos, left, right


def _digest(words: Words, row: int, removed: np.ndarray) -> str:
    i, j = int(words.first[row]), int(words.first[row + 1])
    kept = np.flatnonzero(~removed) + i
    if len(kept) == j - i:
        text = words.text(i, j)
    else:
        text = [words.data[words.starts[k] : words.ends[k]].tobytes() for k in kept.tolist()]
    return hashlib.sha256(b" ".join(text)).hexdigest()


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def _verdicts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per text a row with its digest, if compacted paths tell what to remove. Otherwise a row with the text and the
    spans that paths remove, and one for each window that is still to be verified."""
    for piece in slices(batches, "text"):
        words = words_of(piece.column("text"))
        graph = _Graph(words, width)
        h1, _ = window_hashes(words, width, 0)
        h2, _ = window_hashes(words, width, 1)
        done, open_texts = [], []
        windows: list[np.ndarray] = []  # places of windows to verify, in the piece
        row_ids, texts = piece.column("row_id"), piece.column("text")
        for row, places in enumerate(piece.column("places").to_pylist()):
            first, stop = int(words.first[row]), int(words.first[row + 1])
            n = stop - first
            removed, unproven = np.zeros(n, bool), None
            if places:
                pos, left, right = _paths(places, n)
                starts = np.arange(n - width + 1)
                owner = graph.owner[first : first + len(starts)] - first
                at = np.minimum(np.searchsorted(pos, owner), len(pos) - 1)
                repeated = pos[at] == owner
                proven = repeated & (left[at] <= starts) & (right[at] >= starts + width)
                removed = _covered(starts[proven], starts[proven] + width, n)
                unproven = starts[repeated & ~proven]
            row_id = row_ids[row].as_py()
            if unproven is None or not len(unproven):
                done.append((row_id, n, int(removed.sum()), _digest(words, row, removed)))
            else:
                turns = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))).tolist()
                open_texts.append((row_id, n, turns, texts[row].as_py()))
                windows.append(first + unproven)
        at = np.concatenate(windows) if windows else np.zeros(0, np.int64)
        rows = words.rows[at]
        yield _batch(["row_id", "n_words", "n_removed", "kept_sha256"], done)
        yield _batch(["row_id", "n_words", "spans", "text"], open_texts)
        yield _batch(
            ["row_id", "start", "h1", "h2"],
            columns=[row_ids.take(pa.array(rows)), pa.array((at - words.first[rows]).astype(np.int32)), as_long(h1[at]), as_long(h2[at])],
            n=len(at),
        )


def _batch(names: list[str], rows: list[tuple] = (), columns: list[pa.Array] | None = None, n: int = 0) -> pa.RecordBatch:
    """A batch of VERDICTS with the named columns, and nulls in all others."""
    kinds = {
        "row_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
        "spans": pa.list_(pa.int32()), "text": pa.string(), "start": pa.int32(), "h1": pa.int64(), "h2": pa.int64(),
    }
    if columns is None:
        n = len(rows)
        columns = [pa.array(c, kinds[x]) for x, c in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)]
    given = dict(zip(names, columns, strict=True))
    return pa.RecordBatch.from_arrays([given.get(x, pa.nulls(n, t)) for x, t in kinds.items()], list(kinds))


def _finish(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Digest of each text from the spans of its paths and the windows found repeated."""
    for piece in slices(batches, "text"):
        words = words_of(piece.column("text"))
        out = []
        columns = (piece.column(c).to_pylist() for c in ("row_id", "spans", "starts"))
        for row, (row_id, spans, starts) in enumerate(zip(*columns, strict=True)):
            n = int(words.first[row + 1] - words.first[row])
            spans, starts = spans or [], np.array(starts or [], np.int64)
            removed = _covered(np.array(spans[::2], np.int64), np.array(spans[1::2], np.int64), n)
            removed |= _covered(starts, starts + width, n)
            out.append((row_id, n, int(removed.sum()), _digest(words, row, removed)))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in range(4)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row_id", "n_words", "n_removed", "kept_sha256"]
        )


def repeated_vertices(anchors: DataFrame) -> DataFrame:
    """Vertices that occur ``n`` times, twice or more, and whether all their occurrences go on, or come, by one edge."""
    one = {side: (F.min(side) == F.max(side)).alias(f"one_{side}") for side in ("ahead", "back")}
    return anchors.groupBy("vertex").agg(F.count("*").alias("n"), one["ahead"], one["back"]).filter("n > 1")


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (SHA-256 of the kept words, blank-joined).

    Removed is every word in a window of ``width`` (at least 2 * K) words that starts anywhere else too, same text
    included. Null and empty texts have no words; texts shorter than the window lose none. Rows that repeat an
    id, or have none, are rows of their own. Other columns are not read.
    """
    if width < 2 * K:
        raise ValueError(f"windows need {2 * K} words at least")
    texts, names = keyed_rows(docs, id_col, text_col)
    anchors = texts.mapInArrow(lambda it: _anchors(it, width), ANCHORS)
    vertices = materialize(repeated_vertices(anchors), "repeats-vertices")
    marked = join_heavy(anchors.select("vertex", "row_id", "pos"), vertices, ["vertex"], "n", ["row_id", "pos"])
    places = marked.groupBy("row_id").agg(F.collect_list(F.struct("pos", "one_ahead", "one_back")).alias("places"))
    verdicts = texts.join(places, "row_id", "left").mapInArrow(lambda it: _verdicts(it, width), VERDICTS)
    verdicts = materialize(verdicts, "repeats-verdicts")
    free_shuffles(docs.sparkSession)
    done = verdicts.filter("kept_sha256 is not null").select("row_id", "n_words", "n_removed", "kept_sha256")
    windows = verdicts.filter("start is not null")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    same = join_heavy(windows.select("h1", "h2", "row_id", "start"), materialize(twice, "repeats-windows"), ["h1", "h2"], "n", ["row_id", "start"])
    found = same.groupBy("row_id").agg(F.collect_list("start").alias("starts"))
    rest = verdicts.filter("spans is not null").select("row_id", "spans", "text").join(found, "row_id", "left")
    rest = rest.mapInArrow(lambda it: _finish(it, width), RESULT)
    out = done.unionByName(rest)
    if names is None:
        return out.withColumnRenamed("row_id", "doc_id")
    return names.join(out, "row_id").drop("row_id")
