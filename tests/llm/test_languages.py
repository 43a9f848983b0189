"""Language ID against a brute-force fusion, on pages with awkward markup, and with models in blocks."""

import math
import re
from collections import Counter, defaultdict

import pytest

from tabloom.llm import language_id
from tabloom.llm.html_text import page_text
from tabloom.llm.language_id import HONEST, LENGTH, SMOOTH, address_parts, identify
from tabloom.llm.ngrams import BUCKETS

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def buckets(text):
    data = text.encode()
    return [((int.from_bytes(data[i : i + 3], "little") * 0x9E3779B1) & 0xFFFFFFFF) >> 18 for i in range(len(data) - 2)]


def softmax(logs):
    raised = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(raised) for x in raised]


def brute(pages, docs):
    """Language and probability per page, by plain loops."""
    counts = defaultdict(Counter)
    for text, lang in docs:
        if lang:
            counts[lang.lower()].update(buckets(text or ""))
    names = sorted(counts)
    total = {x: sum(c.values()) + 0.5 * BUCKETS for x, c in counts.items()}
    rows = []
    for _, url, page in pages:
        grams = buckets(page_text(page))
        scale = min(1.0, LENGTH / max(1, len(grams)))
        logs = [scale * sum(math.log((counts[x][g] + 0.5) / total[x]) for g in grams) for x in names]
        host, domain, suffix, candidates = address_parts(url)
        tag = re.search(r"<html\s[^>]*?\blang=[\"']?([A-Za-z]{2,3})(?![A-Za-z])", page or "")
        named = next((x for x in candidates if x in names), "")
        rows.append((host, domain, suffix, tag[1].lower() if tag else "", named, logs, softmax(logs)))
    n = len(names)

    def sums(key):
        out = defaultdict(lambda: [0.0] * n)
        for r in rows:
            out[key(r)] = [a + b for a, b in zip(out[key(r)], r[6], strict=True)]
        return out

    smooth = lambda own, above: [(a + SMOOTH * b) / (sum(own) + SMOOTH) for a, b in zip(own, above, strict=True)]
    overall = sums(lambda r: 0)[0]
    level = [(x + 1) / (sum(overall) + n) for x in overall]
    by_host, by_domain, by_suffix = (sums(lambda r, i=i: r[i]) for i in range(3))
    told = []
    for i in (3, 4):
        by = {k: v for k, v in sums(lambda r, i=i: r[i]).items() if k}
        totals = [sum(v[j] for v in by.values()) for j in range(n)]
        right = lambda k, x: HONEST if k == x else (1 - HONEST) / max(1, n - 1)
        told.append({k: [math.log((v[j] + SMOOTH * right(k, names[j])) / (totals[j] + SMOOTH)) for j in range(n)] for k, v in by.items()})
    out = []
    for host, domain, suffix, declared, named, logs, q in rows:
        above = smooth(by_domain[domain], smooth(by_suffix[suffix], level))
        prior = smooth([max(0.0, a - b) for a, b in zip(by_host[host], q, strict=True)], above)
        extra = [told[0].get(declared, [0.0] * n), told[1].get(named, [0.0] * n)]
        chance = softmax([t + math.log(p) + a + b for t, p, a, b in zip(logs, prior, *extra, strict=True)])
        out.append((names[chance.index(max(chance))], max(chance)))
    return out


@pytest.mark.parametrize("at_once", [language_id.LANGUAGES_AT_ONCE, 3])
def test_fusion_against_brute_force(spark, at_once, monkeypatch):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(-1, None, None), (-2, "http://x.de/fr/a", "<html lang=es>"), (-3, "http://x.de/fr/a", "<html lang=xx>und der die")]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    if at_once == 3:
        # Shuffled joins instead of broadcast ones.
        monkeypatch.setattr(language_id, "BROADCAST_NUMBERS", 0)
    found = identify(spark.createDataFrame(pages, SCHEMA), spark.createDataFrame(docs, "text string, lang string"), at_once=at_once).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == len(pages)
    for (page_id, *_), (lang, chance) in zip(pages, brute(pages, docs), strict=True):
        assert got[page_id].lang == lang and got[page_id].probability == pytest.approx(chance, abs=1e-6)


def test_whole_pages_and_paths(spark):
    """Markup that looks like navigation, or is never closed, hides no text; every segment of a path counts."""
    german = "der und die von das ist ein nicht mit auf"
    pages = [
        (1, None, f"<nav-bar>x</nav-bar><p>{german}"), (2, None, f"<nav>x<p>{german}"), (3, None, f"<p>{german}"),
        (4, "http://h.example/us/de/page", ""), (5, "http://h.example/" + "a/" * 3000 + "es", ""), (6, None, "<script>" + german),
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    got = {r.page_id: r for r in identify(spark.createDataFrame(pages, SCHEMA), docs).collect()}
    assert [got[i].text_lang for i in (1, 2, 3)] == ["de"] * 3 and min(got[i].probability for i in (1, 2, 3)) > 0.9
    assert (got[4].named, got[5].named) == ("de", "es") and got[6].probability < 0.9


def test_many_languages(spark):
    """Hundreds of labels are all languages."""
    docs = spark.range(500).selectExpr("concat('word', id, ' only', id) AS text", "concat('l', id) AS lang")
    pages = spark.createDataFrame([(1, None, "word77 only77 word77 only77"), (2, None, None)], SCHEMA)
    got = {r.page_id: r for r in identify(pages, docs, at_once=200).collect()}
    assert got[1].lang == "l77" and len(got) == 2
