"""Training-data operators against brute force, SQL, and awkward inputs."""

import hashlib
import os
import re

import numpy as np
import pytest

from tabloom.llm import common, decontamination, exact_dedup, mixing, near_dedup, pii, quality, substring_dedup, warc_audit
from tabloom.llm.html_text import page_text
from tabloom.llm.language_id import identify
from tabloom.llm.ngrams import BUCKETS
from tabloom.llm.oracles import ORACLES
from tabloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, hash int, vertex int, size int"
AWKWARD = [
    (1, None, None, None), (2, "", "en", ""), (3, " \t\n", "en", "a"), (4, "word", "en", "a"), (5, "word", "en", "a"),
    (5, "word", "en", "a"), (None, "word two", None, None), (6, "x" * 70_000, "en", "b"), (7, "ab cd " * 9_000, "en", "b"),
    (8, "é Ü ß " * 40, "de", "b"), (9, "a\x0bb\x00c   d", "en", "b"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 0, "clash", 1, 2, 3) for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def benchmark(spark, rows=(("i1", "ab cd " * 5), (None, "é ü ß " * 2), ("i3", None), ("i4", ""), ("i5", "word"))):
    return spark.createDataFrame(list(rows), "item_id string, text string")


@pytest.mark.parametrize("name", ["op4_decontamination", "op5_mixing", "op6_near_dedup", "op8_exact_dedup", "op9_substring_dedup", "op10_warc_audit"])
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)

    def rows(frame):
        return sorted(tuple(round(float(v), 6) if isinstance(v, (int, float, np.number)) else v for v in r) for r in frame[columns].itertuples(index=False))

    assert rows(got) == rows(want)


def test_exact_groups_awkward(awkward, empty):
    got = exact_dedup.exact_groups(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[1].keep_id == by[2].keep_id == by[3].keep_id == 3 and by[1].group_size == 3  # the most code points stay
    assert by[4].keep_id == by[5].keep_id == 4 and by[4].group_size == 3
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 6, 7, 8, 9]  # 0: null


def test_decontamination_awkward_and_blocks(spark, awkward, empty):
    items = benchmark(spark)
    one = decontamination.contamination(awkward, items).collect()
    many = decontamination.contamination(awkward, items, block_rows=1).collect()
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]))
    assert sorted(map(key, one)) == sorted(map(key, many)) and len(one) == len(AWKWARD)
    by = {r.doc_id: r for r in one}
    assert by[7].n_hit == by[7].n_words == 18_000 and by[7]["items"] == ["i1"]
    assert by[4]["items"] == ["i5"] and by[1].n_words == 0 and by[6].n_hit == 0
    assert decontamination.contamination(empty, items).count() == 0
    assert {r.n_hit for r in decontamination.contamination(awkward, items.limit(0)).collect()} == {0}
    clean = decontamination.clean(awkward, items)
    assert clean.columns == awkward.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one if not r.n_hit}


def test_fm_index_finds_all():
    rng = np.random.default_rng(3)
    for n in (2, 7, 300):
        seq = np.append(rng.integers(1, 5, n), 0)
        order = decontamination.suffix_order(seq)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: seq[i:].tolist())
        index = decontamination.FmIndex(seq, 5)
        patterns = rng.integers(2, 5, (40, 3))
        patterns[:10, 0] = -1
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            p = p[p >= 0]
            want = [i for i in range(n + 1 - len(p)) if (seq[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_mixing_awkward(awkward, empty):
    got = mixing.mix_sources(awkward).collect()
    again = mixing.mix_sources(awkward.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(AWKWARD)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by_target = {}
    for r in got:
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by_target.items())
    assert mixing.mix_sources(empty).count() == 0


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    for n in (1, 5, 50, 2000):
        a, b = pool[:n], np.concatenate([pool[: n - n // 5], pool[n : n + n // 5]])
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        shared = n - n // 5
        assert x.max() < np.uint64(0xFFFFFFFFFFFFFFFF) and abs((x == y).mean() - shared / (n + n // 5)) < 0.12


def test_near_groups_large_bucket(spark, awkward, empty, monkeypatch):
    """Links that no first member shows are found: copies of one text with different words changed."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        copy = list(words)
        for j in rng.choice(120, int(rng.integers(2, 9)), replace=False):
            copy[j] = f"x{i}_{j}"
        texts.append((i, " ".join(copy)))
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for _, t in texts]
    parent = list(range(90))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(90)}
    rows = near_dedup.near_groups(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert all(r.component_id == 4 for r in rows if r.doc_id in (4, 5)) and near_dedup.near_groups(empty).count() == 0


def test_repeats_against_brute_force(spark, awkward, empty):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[a : a + n]) for a, n in ((0, 200), (100, 60), (130, 34), (130, 35), (0, 200))]
    texts += [" ".join(rng.choice(base, 80)) + " " + " ".join(base[300:340]), " ".join(base[295:345]), "a b " * 60, "a b " * 17]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    counts = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - 34):
            counts[tuple(w[i : i + 35])] = counts.get(tuple(w[i : i + 35]), 0) + 1
    for k, t in enumerate(texts):
        w, gone = t.split(), set()
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    rows = substring_dedup.remove_repeats(awkward).collect()
    assert len(rows) == len(AWKWARD) and {r.n_removed for r in rows if r.doc_id == 7} == {18_000}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_personal_data(spark, awkward, empty):
    ids = ["4111111111111111", "5500005555555559", "4012888888881881", "340000000000009"]
    rows = [(i, f"note my account number {x} thanks") for i, x in enumerate(ids)]
    rows += [(10, "note my account number QX-99817 thanks"), (11, "mail a.b@c.d.e@x.y.z and .@q.w, 1.2.3.4.5.6.7.8 300.1.1.1 +1 (555) 123-4567."), (12, "1" * 5000)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10].spans == "card:23:31" and got[10].n_found == 1 and got[10].n_card == 0 and got[0].n_card == 1
    text = rows[5][1]
    email = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [s for s in got[11].spans.split(",") if s.startswith("email")] == email and (got[11].n_ip, got[11].n_phone) == (2, 1)
    assert got[12].spans == "" and pii.personal_data(empty).count() == 0 and pii.personal_data(awkward).count() == len(AWKWARD)


def test_quality_rejects_held_out_junk(spark, awkward, empty):
    rows = QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97
    labels = spark.createDataFrame([(4, 1, None), (4, 1, 0), (7, 0, None), (None, 1, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(awkward, labels).count() == len(AWKWARD)
    assert {r.kept for r in quality.classify(awkward, labels.limit(0)).collect()} == {True}
    assert quality.classify(empty, labels).count() == 0
    assert sum(r.kept for r in quality.classify(awkward, labels, k=4).collect()) == 4


def test_languages(spark, empty):
    pages = spark.createDataFrame(
        [(1, "http://a.example.com/de/1", "<html lang=de><p>der und die von das ist ein nicht</p>", 0), (2, None, None, 0), (3, "::bad[", "", 0), (3, "::bad[", "", 0)],
        "page_id long, url string, html string, host int",
    )
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(pages, docs).collect()
    assert len(got) == 4 and {r.lang for r in got if r.page_id == 1} == {"de"} and all(r.lang for r in got)
    assert {r.lang for r in identify(pages, empty).collect()} == {None} and identify(pages.limit(0), docs).count() == 0
    real = QUERIES["op1_language_id"](spark, SF).collect()
    assert np.mean([r.lang == r.named for r in real if r.named]) > 0.95


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n  1. z"), ("<script>no</script><style>no</style>yes<!-- no -->", "yes"),
        ("<p hidden>no</p><b style='display: none'>no</b>yes &amp; so", "yes & so"),
        ("<table><tr><td>a<td>long cell<tr><td>bb<td>c</table>", "a   long cell\nbb  c"), ("<title>t</title><body>x", "x"),
        ("<pre>a\n  b</pre>", "a\n  b"), ("<div>" * 3000 + "deep", "deep"), ("<p>a < b", "a < b"),
    ],
)
def test_page_text(page, text):
    assert page_text(page) == text


def test_audit_locates_damage(spark):
    rows = [(i % 5000, f"u{i}", "p" * (i % 7)) for i in range(5200)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc_audit.audit(pages, pages).filter("damaged").count() == 0
    damaged = pages.selectExpr("page_id", "url", "if(url = 'u4999', repeat('x', length(html)), html) AS html")
    bad = warc_audit.audit(pages, damaged).filter("damaged").collect()
    assert [r.page_id for r in bad] == [4999]
    assert warc_audit.audit(pages.limit(0), pages.limit(0)).count() == 0


def test_audit_of_shorter_lost_and_added_records(spark):
    """Records after a shorter, lost or added one stay intact, and records of the second replica alone are returned."""
    rows = [(i, f"u{i}", "p" * (i % 7 + 2)) for i in range(5000)] + [(7, "again", "q"), (8, "u8", "ppp"), (None, "n", "n")]
    second = [(i, u, h[:-1] if i == 20 else h + "x" if i == 30 else h) for i, u, h in rows if i != 40 and u != "again"]
    second += [(-1, "new", "new"), (50, "second", "second"), (None, "m", "m"), (20, "other", "other")]
    left, right = (spark.createDataFrame(x, "page_id long, url string, html string") for x in (rows, second))
    got = warc_audit.audit(left, right).collect()
    bad = sorted((r.page_id is None, r.page_id, r.state) for r in got if r.damaged)
    want = [(-1, "added"), (7, "missing"), (20, "added"), (20, "changed"), (30, "changed"), (40, "missing"), (50, "added"), (None, "added")]
    assert bad == [(i is None, i, state) for i, state in want] and len(got) == len(rows) + 4
    copies = spark.createDataFrame([(1, "u", "x")] * 3, "page_id long, url string, html string")
    assert sorted(r.state for r in warc_audit.audit(copies, copies.limit(2)).collect()) == ["intact", "intact", "missing"]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 50
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([labels.get(r.doc_id, 1) for r in rows]) > 0.97
    assert decontamination.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("n_hit > 0").count() == 0
    final = corpus_pipeline.run(spark, SF)
    assert 0 < final.count() <= sizes[-1] and os.path.isdir(SF)


def plain_base(text):
    """The base rules of personal data by Python's own patterns."""
    luhn = lambda ds: sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(ds))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, ds: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, ds: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, ds: 14 <= len(ds) <= 19 and luhn(ds)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, ds: 10 <= len(ds) <= 15),
    }
    found = []
    for rank, (kind, (pattern, valid)) in enumerate(rules.items()):
        for m in re.finditer(pattern, text):
            if valid(m[0], re.sub("[^0-9]", "", m[0])):
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [name for *_, name in sorted(found)]


def test_base_rules_against_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    alphabets = ("0123456789", "0123456789 -", "+0123456789 ().-", "012.", "ab1.@%_+-", "é0129 .-+@a\n")
    for alphabet in alphabets:
        texts += ["".join(rng.choice(list(alphabet), int(rng.integers(1, 90)))) for _ in range(60)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1111-4111", "256.1.1.1 255.255.255.255", "é😀 +1 555 123 4567 x@y.z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        want = plain_base(texts[r.doc_id])
        kinds = [x.split(":")[0] for x in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(kinds.count, pii.BASE_KINDS)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_found == r.n_spans


def plain_buckets(text):
    """Trigram and word-pair buckets of a text, one at a time."""
    data, full = text.encode(), (1 << 64) - 1

    def spread(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    def word_hash(w):
        codes = (int(common._BYTE_CODES[b]) * pow(common._LETTER_BASE, i, 1 << 64) for i, b in enumerate(w))
        return spread((sum(codes) + len(w)) & full)

    trigrams = [((int.from_bytes(data[i : i + 3], "little") * 0x9E3779B1) & 0xFFFFFFFF) >> 18 for i in range(len(data) - 2)]
    words = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    pairs = [0 if a == b else spread((a + b * common._WINDOW_BASES[0] + 2) & full) >> 50 for a, b in zip(words, words[1:], strict=False)]
    return trigrams, pairs


def test_quality_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs}
    grams = {k: plain_buckets(t) for k, t in docs.items()}
    logs = []
    for ids in (list(docs), [k for k, q in labels.items() if q == 1]):
        table = np.full((2, BUCKETS), 0.5)
        for k in ids:
            for kind in (0, 1):
                np.add.at(table[kind], grams[k][kind], 1)
        logs.append(np.log(table / table.sum(axis=1, keepdims=True)))
    ratios = logs[1] - logs[0]
    keys = {}
    for k, kinds in grams.items():
        weight = sum(100.0 * ratios[i][g].sum() / (len(g) + 10.0) for i, g in enumerate(kinds)) if any(kinds) else -1e9
        u = (int(hashlib.md5(f"29:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        keys[k] = (weight, weight - np.log(-np.log(u)))
    rate = lambda q, cut: np.mean([keys[k][1] >= cut for k, x in labels.items() if (x == 1) == q])
    best = max(rate(True, keys[k][1]) - rate(False, keys[k][1]) for k in labels)
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, (weight, key) in keys.items():
        assert got[k].log_weight == pytest.approx(weight, abs=1e-6) and got[k].gumbel_key == pytest.approx(key, abs=1e-6)
    cut = min(r.gumbel_key for r in got.values() if r.kept)
    assert all(r.kept == (r.gumbel_key >= cut) for r in got.values())
    assert rate(True, cut - 1e-6) - rate(False, cut - 1e-6) == pytest.approx(best)


def test_pipeline_stages_against_sql(spark, tmp_path):
    """Each stage after the classifier keeps what SQL keeps of that stage's own input."""
    duckdb = pytest.importorskip("duckdb")
    import corpus_pipeline

    kept = {
        "exact_dedup": f"SELECT doc_id FROM ({ORACLES['op8_exact_dedup']}) WHERE kept",
        "near_dedup": f"SELECT doc_id FROM ({ORACLES['op6_near_dedup']}) WHERE kept",
        "decontamination": f"SELECT doc_id FROM ({ORACLES['op4_decontamination']}) WHERE NOT contaminated",
        "mixing": f"SELECT doc_id, size, taken FROM ({ORACLES['op5_mixing']}) WHERE taken > 0",
    }
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    classified = {r.doc_id for r in QUERIES["op3_quality"](spark, SF).filter("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            assert {r.doc_id for r in out.collect()} == classified
        else:
            want = con.execute(kept[name]).fetchall()
            got = out.select("doc_id", "size", "taken") if name == "mixing" else out.select("doc_id")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path / name}/*.parquet'")
        docs = out
    final = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, final)) == sorted(map(tuple, docs.collect()))


def test_join_heavy_deals_rows_of_a_hot_key(spark):
    """Half of the rows share a key: the join is the plain one, and that key's entry is repeated for its parts alone."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).selectExpr("id", "IF(id % 2 = 0, 7, id) key")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = common.join_heavy(rows, keys, ["key"], "n", ["id"])
    want = rows.join(keys.drop("n"), "key")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    none = common.join_heavy(rows, keys.limit(0), ["key"], "n", ["id"])
    assert none.count() == 0
