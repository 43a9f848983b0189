"""Language ID of pages by Bayesian evidence fusion.

Four kinds of evidence are put together per page: likelihoods of all visible text under n-gram models trained on labelled
documents, the language its markup declares, the language its address names, and a prior of its host. Reliabilities of
declared and named languages, and the priors, are learned from the pages themselves by grouped aggregation of text
posteriors; host priors are smoothed by those of the domain, of its suffix, and of all pages, in turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import slices
from tabloom.llm.html_text import page_attributes, page_text
from tabloom.llm.ngrams import BUCKETS, byte_trigrams, label_counts
from tabloom.operators.lookups import lookup_join
from tabloom.session import materialize

#: Languages whose models are sent to tasks at once (8 MB); more languages take one pass over the pages for each block.
LANGUAGES_AT_ONCE = 64
#: Numbers in a table that is broadcast.
BROADCAST_NUMBERS = 1_000_000
#: Trigrams that the text's evidence is scaled down to, since n-grams of a text are not independent.
LENGTH = 60.0
#: Pseudo-pages that each level of the hierarchy lends to the one below, and that a declared language counts for.
SMOOTH = 5.0
#: Chance that a language is declared or named rightly, before any page is seen.
HONEST = 0.8

_CODE = re.compile(r"([a-z]{2,3})(?:[-_][a-z]{2,4})?", re.I)
_DECLARED = re.compile(r"\s*([a-z]{2,3})(?![a-z])", re.I)

EVIDENCE = "row_id long, page_id long, host string, domain string, suffix string, declared string, named string, text array<double>"


def address_parts(url: str | None) -> tuple[str, str, str, list[str]]:
    """Host, domain (its last two labels), suffix (its last label) and candidates for a language in an address."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return "", "", "", []
    labels = host.split(".")
    found = [labels[0]] if len(labels) > 2 and len(labels[0]) in (2, 3) else []
    codes = (_CODE.fullmatch(x) for x in parts.path.split("/"))
    return host, ".".join(labels[-2:]), labels[-1], found + [x[1].lower() for x in codes if x]


def _scores(piece: pa.RecordBatch, logs: np.ndarray) -> pa.Array:
    """Log likelihoods of the visible texts of pages in each language of ``logs``."""
    rows, buckets = byte_trigrams(pa.array([page_text(x) for x in piece.column("html").to_pylist()], pa.large_string()))
    n = np.bincount(rows, minlength=piece.num_rows)
    scores = np.stack([np.bincount(rows, x[buckets], piece.num_rows) for x in logs], 1).astype(float)
    return pa.array(list(scores * np.minimum(1.0, LENGTH / np.maximum(1, n))[:, None]), pa.list_(pa.float64()))


def _likelihoods(batches: Iterator[pa.RecordBatch], logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([piece.column("row_id"), _scores(piece, logs)], ["row_id", "text"])


def _evidence(batches: Iterator[pa.RecordBatch], known: frozenset[str], logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "html"):
        out = []
        for row_id, page_id, url, page in zip(*(piece.column(c).to_pylist() for c in ("row_id", "page_id", "url", "html")), strict=True):
            host, domain, suffix, candidates = address_parts(url)
            declared = _DECLARED.match(page_attributes(page or "").get("lang", ""))
            named = next((x for x in candidates if x in known), "")
            out.append((row_id, page_id, host, domain, suffix, declared[1].lower() if declared else "", named))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 2 + [pa.string()] * 5, strict=True)]
        names = ["row_id", "page_id", "host", "domain", "suffix", "declared", "named", "text"]
        yield pa.RecordBatch.from_arrays([*columns, _scores(piece, logs)], names)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """Languages, and counts of trigram buckets in each (label, bucket, n), from all labelled documents."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.lower(F.col(lang_col).cast("string")).alias("label"))
    texts = texts.filter("label is not null and label != ''")
    counts = texts.mapInArrow(lambda it: label_counts(slices(it, "text"), "text", "label"), "label string, bucket int, n long")
    counts = materialize(counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    return sorted(r[0] for r in counts.select("label").distinct().collect()), counts


def _model(counts: DataFrame, languages: list[str]) -> np.ndarray:
    """Log frequencies of the buckets in a block of languages."""
    found = counts.filter(F.col("label").isin(languages)).toArrow()
    place = {x: i for i, x in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), 0.5)
    labels = np.array([place[x] for x in found["label"].to_pylist()], np.int64)
    table[labels, found["bucket"].to_numpy()] += found["n"].to_numpy()
    return np.log(table / table.sum(axis=1, keepdims=True))


def _gathered(pages: DataFrame, languages: list[str], counts: DataFrame, at_once: int) -> DataFrame:
    """Stored evidence of each page: address, declared language, and likelihoods of its text in all languages."""
    known = frozenset(languages)
    first, *others = [languages[i : i + at_once] for i in range(0, len(languages), at_once)]
    if others:
        # Row numbers must be the same in all passes.
        pages = materialize(pages, "language-pages")
    shared = pages.sparkSession.sparkContext.broadcast(_model(counts, first))
    rows = materialize(pages.mapInArrow(lambda it, x=shared: _evidence(it, known, x.value), EVIDENCE), "language-evidence")
    for block in others:
        shared.unpersist()
        shared = pages.sparkSession.sparkContext.broadcast(_model(counts, block))
        more = pages.mapInArrow(lambda it, x=shared: _likelihoods(it, x.value), "row_id long, more array<double>")
        rows = materialize(rows.join(more, "row_id").withColumn("text", F.concat("text", "more")).drop("more"), "language-evidence")
    return rows


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas over arrays refer to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _softmax(logs: Column) -> Column:
    def raised(array: Column) -> Column:
        return _bound(F.array_max(array), lambda top: F.transform(array, lambda x: F.exp(x - top)))

    def scaled(array: Column) -> Column:
        return _bound(_total(array), lambda total: F.transform(array, lambda x: x / total))

    return _bound(_bound(logs, raised), scaled)


def _sums(rows: DataFrame, keys: list[str], chances: str, name: str) -> DataFrame:
    """Sums of an array column by place, for each key."""
    long = rows.select(*keys, F.posexplode(chances).alias("place", "chance")).groupBy(*keys, "place").agg(F.sum("chance").alias("chance"))
    places = F.array_sort(F.collect_list(F.struct("place", "chance")))
    return long.groupBy(*keys).agg(places["chance"].alias(name))


def _smoothed(own: Column, above: Column) -> Column:
    return _bound(
        own, lambda array: _bound(_total(array), lambda total: F.zip_with(array, above, lambda x, y: (x + SMOOTH * y) / (total + SMOOTH)))
    )


def _told(rows: DataFrame, column: str, names: Column, n: int) -> DataFrame:
    """Log chance, by language, that a page of it has this value of ``column``; nothing told says nothing."""
    told = materialize(_sums(rows.filter(F.col(column) != ""), [column], "q", "sums"), "language-told")
    totals = (_sums(told, [], "sums", "totals").first() or [None])[0] or [0.0] * n
    right = F.transform(names, lambda x: F.when(F.col(column) == x, HONEST).otherwise((1 - HONEST) / max(1, n - 1)))
    chance = F.zip_with(F.zip_with("sums", right, lambda s, r: s + SMOOTH * r), F.lit(totals), lambda s, t: F.log(s / (t + SMOOTH)))
    return told.select(column, chance.alias(f"log_{column}"))


def identify(
    pages: DataFrame,
    docs: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    text_col: str = "text",
    lang_col: str = "lang",
    at_once: int = LANGUAGES_AT_ONCE,
) -> DataFrame:
    """One row per row of ``pages``: page_id, lang, probability, text_lang, declared, named, host.

    A page without text, host, declared or named language is judged by the evidence left, down to the prior of all
    pages; ties go to the first language by name. Nulls count as empty, repeated rows are judged each, and without
    labelled documents there is no language (null). Other columns are not read. Any number of languages is taken,
    ``at_once`` per pass; a row holds one number for each.
    """
    languages, counts = train(docs, text_col, lang_col)
    n = len(languages)
    narrow = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    if not n:
        nothing = F.lit(None).cast("string")
        return narrow.select("page_id", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), *[nothing.alias(x) for x in ("text_lang", "declared", "named", "host")])
    rows = _gathered(narrow, languages, counts, at_once).withColumn("q", _softmax(F.col("text")))
    names = F.lit(languages)

    hosts = materialize(_sums(rows, ["host", "domain", "suffix"], "q", "own"), "language-hosts")
    overall = (_sums(hosts, [], "own", "sums").first() or [None])[0] or [0.0] * n
    level = F.lit([(x + 1.0) / (sum(overall) + n) for x in overall])
    suffixes = _sums(hosts, ["suffix"], "own", "s").select("suffix", _smoothed(F.col("s"), level).alias("above"))
    domains = _sums(hosts, ["domain", "suffix"], "own", "s").join(suffixes, "suffix")
    domains = domains.select("domain", _smoothed(F.col("s"), F.col("above")).alias("above"))
    priors = materialize(hosts.join(domains, "domain").select("host", "own", "above"), "language-priors")

    joined = rows
    tables = [("host", priors)] + [(x, _told(rows, x, names, n)) for x in ("declared", "named")]
    for column, table in tables:
        joined = lookup_join(joined, table, [column], F.col("row_id"), table.count(), "left", BROADCAST_NUMBERS // n)
    # A page does not vouch for itself: its own text posterior is taken out of its host's sums.
    others = F.zip_with("own", "q", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    evidence = F.zip_with("text", _smoothed(others, F.col("above")), lambda t, p: t + F.log(p))
    for column in ("declared", "named"):
        told = F.coalesce(f"log_{column}", F.array_repeat(F.lit(0.0), n))
        evidence = F.zip_with(evidence, told, lambda a, b: a + b)
    joined = joined.withColumn("posterior", _softmax(evidence))

    def best(chances: Column) -> Column:
        return F.get(names, F.array_position(chances, F.array_max(chances)).cast("int") - 1)

    return joined.select(
        "page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), best(F.col("q")).alias("text_lang"), "declared", "named", "host"
    )
