"""Hashed n-grams of texts, counted and scored in numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tabloom.llm.common import NON_BLANK, SAME, text_bytes, window_hashes, words_of

#: Buckets of each kind of n-gram.
BUCKETS = 1 << 14


def byte_trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every run of three bytes within a text."""
    data, offsets = text_bytes(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    code = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = rows[:-2] == rows[2:]
    return rows[:-2][inside], bucket[inside]


def word_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every two words on end; a word said twice on end is one bucket for all words."""
    words = words_of(texts, NON_BLANK, SAME)
    hashes, inside = window_hashes(words, 2)
    n = len(hashes)
    bucket = (hashes >> np.uint64(50)).astype(np.int64)
    bucket[words.hashes[:n] == words.hashes[1 : n + 1]] = 0
    return words.rows[:n][inside], bucket[inside]


def totals(kinds: list[tuple[np.ndarray, np.ndarray]], chosen: np.ndarray | None = None) -> np.ndarray:
    """Counts of all buckets, one kind after the other, over the chosen texts."""
    return np.concatenate(
        [np.bincount(b if chosen is None else b[chosen[r]], minlength=BUCKETS) for r, b in kinds]
    )


def count_rows(label: str, counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["label", "bucket", "n"]
    )


def label_counts(pieces: Iterator[pa.RecordBatch], text: str, label: str) -> Iterator[pa.RecordBatch]:
    """Trigram counts by label, one set of rows per task; texts without a label do not count."""
    sums: dict[str, np.ndarray] = {}
    for piece in pieces:
        kinds = [byte_trigrams(piece.column(text))]
        labels = np.array(piece.column(label).fill_null("").to_pylist(), object)
        for name in set(labels) - {""}:
            sums[name] = sums.get(name, 0) + totals(kinds, labels == name)
    for name, counts in sums.items():
        yield count_rows(name, counts)
