"""Hard negatives, chat formatting and structure repair against brute force, SQL, and awkward inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import conversation_repair as repairs
from tabloom.llm import hard_negatives as mining
from tabloom.llm import reply_trees as trees
from tabloom.llm.oracles import ORACLES
from tabloom.llm.ordered import ordered_rows, with_previous
from tabloom.llm.queries import QUERIES, damaged

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, conv string, tree int, _id int, node string, kind int, edit int"
CLASH = ("c", 1, 2, "n", 3, 4)
BLANK = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_chat_format", "op13_structure_repair"])
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = lambda frame: sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_previous_across_ranges(spark):
    """One group spans all ranges, another is cut in the middle."""
    rows = spark.range(0, 4000, 1, 7).selectExpr("IF(id < 3000, 1, IF(id < 3500, 2, NULL)) g", "id % 1000 t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_previous(ordered_rows(rows, ["g", "t"], "test"), "g").orderBy("_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 4000 and len({r._id >> 33 for r in got}) > 2
    for before, row in zip([None, *got], got, strict=False):
        assert row._previous == (before._id if before and before.g == row.g else None)
        assert not before or (before.g != row.g) or before.t <= row.t


# --- hard negatives ---------------------------------------------------------------------------------------------------


def best_by_hand(data, every):
    usable = lambda e: e is not None and all(x is not None and np.isfinite(x) for x in e)
    rows = [(v, l, [int(np.floor(256 * x)) for x in e]) for v, l, e in data if l is not None and usable(e)]
    dims = max([len(r[2]) for r in rows] or [0])
    q = np.array([r[2] + [0] * (dims - len(r[2])) for r in rows], dtype=np.int64).reshape(len(rows), dims)
    out = []
    for i, (v, label, _) in enumerate(rows):
        if v is None or v % every:
            continue
        scores = q @ q[i]
        order = sorted(range(len(rows)), key=lambda j: (-scores[j], rows[j][0] is None, rows[j][0] or 0))
        for p in [j for j in order if j != i and rows[j][1] == label][:5]:
            fit = [j for j in order if rows[j][1] != label and 80 * scores[p] <= 100 * scores[j] <= 100 * scores[p]][:5]
            out += [(v, rows[p][0], r, rows[j][0], int(scores[p]), int(scores[j])) for r, j in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [mining.Sizes(), mining.Sizes(6000, 64, 16)])
def test_negatives_against_brute_force(spark, sizes):
    """Ties, repeated ids, zero and unequal vectors, nulls, NaN; also in many blocks, short lists and short steps."""
    rng = np.random.default_rng(1)
    data = []
    for i in range(900):
        v = [float(x) for x in np.float32(np.round(rng.normal(size=rng.choice([8, 8, 8, 5, 0])) * rng.choice([0.02, 1, 3]), 1))]
        v = v[:1] + [float("nan")] if i % 50 == 7 else v[:1] + [None] if i % 50 == 8 else v + [float("-inf")] if i % 50 == 9 else v
        data.append((int(rng.integers(0, 500)) if i % 97 else None, int(rng.integers(0, 4)) if i % 31 else None, v if i % 41 else None))
    df = spark.createDataFrame([(*d, 5, 6, "x") for d in data], "vec_id long, label int, embedding array<float>, row int, q int, score string")
    rows = mining.prepared(df.repartition(3))
    got = mining.hard_negatives(rows, rows.filter("vec_id % 50 = 0"), sizes=sizes).collect()
    assert sorted(map(tuple, got), key=str) == best_by_hand(data, 50) and len(got) > 100


def test_negatives_stop_early_and_stay_exact():
    """Anchors of one tight cluster read a part of a list whose bounds fall, and miss nothing."""
    rng = np.random.default_rng(4)
    far = rng.normal(size=(20_000, 16))
    far -= np.outer(far @ np.eye(16)[0], np.eye(16)[0]) * 0.9
    x = np.floor(256 * np.vstack([far, np.eye(16)[0] * 9 + rng.normal(size=(300, 16)) * 0.1])).astype(np.int64)
    anchors = x[-20:]
    rows, labels = np.arange(len(x)), np.zeros(len(x), np.int64)
    edges = np.full((20, 1), -mining.NEVER // 2), np.full((20, 1), mining.NEVER)
    (cluster,) = mining.clusters_of(rows[-20:], labels[-20:], anchors, np.eye(16)[:1], *edges)
    seen, products = [], mining._products
    try:
        mining._products = lambda u, v, largest: seen.append(len(v)) or products(u, v, largest)
        walk = mining.Walk(cluster, 5, True, 256)
        walk.list_of(x, rows, np.zeros(len(x), bool), rows, labels)
    finally:
        mining._products = products
    assert sum(seen) < 2000
    scores = anchors @ x.T
    scores[np.arange(20), np.arange(len(x) - 20, len(x))] = -mining.NEVER // 2
    assert (walk.scores.reshape(20, 5) == -np.sort(-scores, axis=1)[:, :5]).all()


def test_negatives_of_nothing(spark):
    empty = mining.prepared(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert mining.hard_negatives(empty, empty).count() == 0
    alone = mining.prepared(spark.createDataFrame([(0, 1, [1.0]), (100, 2, [1.0])], "vec_id long, label int, embedding array<float>"))
    assert mining.hard_negatives(alone, alone).count() == 0


# --- reply trees ------------------------------------------------------------------------------------------------------

TEXTS = ["a </s> b", "[INST]", "[\\INST]", "<\\\\/s> x", "", None, "é [/ANS] [ROLE 41] <s><s>", "plain", "[SYS", "x\ny", "</s>[INST] ok [/INST]"]


def test_segments_read_back(spark):
    roles = ["system", "user", "assistant", "to]ol é", ""]
    rows = [(r, t or "") for r in roles for t in TEXTS]
    df = spark.createDataFrame(rows, "role string, text string")
    got = df.select("role", "text", trees.segment(F.col("role"), F.col("text")).alias("s")).collect()
    assert all(trees.read_segment(r.s) == (r.role, r.text) for r in got)
    # Whole conversations can be cut at the marks: no text holds one.
    assert all(len(trees.SEGMENT.findall(r.s)) == 1 and r.s.count("</s>") == (r.role == "assistant") for r in got)


def test_conversations_read_back(spark):
    random.seed(5)
    rows = []
    for c in [*range(12), None]:
        for t in range(random.choice([1, 2, 3, 9, 33])):
            rows.append((c, t if t else None, random.choice(["system", "user", "assistant", "tool", None]), random.choice(TEXTS)))
    got = {r.tree: r for r in trees.read_back(trees.format_conversations(spark.createDataFrame([(*r, *CLASH) for r in rows], TURNS))).collect()}
    assert len(got) == 13
    for c, g in got.items():
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        learned = "".join(t for r, t in mine if r == "assistant")
        assert g.n_turns == len(mine) and g.loss_chars == len(learned)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    empty = spark.createDataFrame([], TURNS)
    assert trees.read_back(trees.format_conversations(empty)).count() == 0
    # Turns that share a number are all said, repeated rows included.
    twice = [(1, 0, "user", "q"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "assistant", "w"), (1, None, "system", "s")]
    (row,) = trees.read_back(trees.format_conversations(spark.createDataFrame([(*r, *CLASH) for r in twice], TURNS))).collect()
    assert row.n_turns == 5 and row.loss_sha256 == hashlib.sha256(b"wxx").hexdigest()


def test_best_branches(spark):
    """Paths, depths and ranks of random trees equal those of a walk by hand; circles and strange parents make roots."""
    random.seed(8)
    nodes = []
    for t in (1, 2, None):
        for n in range(60):
            nodes.append((t, n, random.randrange(max(0, n - 3), n) if n else None, random.choice([None, 0.25, 0.5, 1.0])))
    nodes += [(3, 1, 2, 1.0), (3, 2, 1, 1.0), (3, 3, 3, 0.5), (3, 4, 99, 0.5)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    paths = {}
    for r in trees.chosen_paths(df, best=3).collect():
        paths.setdefault((r.tree, r.rank), {})[r.place] = r.node
    got = {k: [v[i] for i in range(len(v))] for k, v in paths.items()}
    want = {}
    for t in {n[0] for n in nodes}:
        mine = {n: (p if p is not None and p < n and any(x[0] == t and x[1] == p for x in nodes) else None, s or 0.0) for k, n, p, s in nodes if k == t}
        leaves = set(mine) - {p for p, _ in mine.values()}
        ways = []
        for leaf in leaves:
            way = [leaf]
            while mine[way[-1]][0] is not None:
                way.append(mine[way[-1]][0])
            ways.append((-sum(mine[n][1] for n in way) / len(way), leaf, way[::-1]))
        for rank, (_, _, way) in enumerate(sorted(ways)[:3], 1):
            want[t, rank] = way
    assert got == want
    said = spark.createDataFrame([(t, n, "user", f"{n}") for t, n, _, _ in nodes], "tree long, node long, role string, text string")
    out = trees.read_back(trees.format_trees(said, df)).collect()
    assert {(r.tree, r.n_turns) for r in out} == {(t, len(w)) for (t, rank), w in want.items() if rank == 1}


# --- structure repair -------------------------------------------------------------------------------------------------


def repaired_by_hand(turns):
    """Cheapest edits by a forward search over (cost, audit), and the counts."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in turns:
        cut = text.strip(BLANK)[-1:] not in (".", "!", "?")
        faults.append("blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if cut else "")
        seen.add((role, text))

    def put(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    def insert(ways):
        for _ in range(3):
            for state, to, role in (("0", "u", "user"), ("s", "u", "user"), ("a", "u", "user"), ("u", "a", "assistant")):
                if state in ways:
                    cost, audit, out = ways[state]
                    put(ways, to, (cost + 3, audit + "I", (*out, role + ":")))

    ways = {"0": (0, "", ())}
    insert(ways)
    for (_, role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for state, (cost, audit, out) in ways.items():
            put(after, state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            letter = role[:1]
            if (letter, state) in (("s", "0"), ("u", "0"), ("u", "s"), ("u", "a"), ("a", "u")):
                put(after, letter, (cost + extra, audit + "K", (*out, f"{role}:{text}")))
            to, name = ("a", "assistant") if state == "u" else ("u", "user")
            put(after, to, (cost + 3 + extra, audit + "R", (*out, f"{name}:{text}")))
        ways = after
        insert(ways)
    cost, audit, out = min(ways[q] for q in ("0", "a") if q in ways)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    counts = (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal)
    return (gaps, *counts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def broken():
    random.seed(5)
    texts = ["a.", "b", "", " \t", "c!", "d?x", "e. \n", None, "f.", "g.", "h.", "i."]
    rows = []
    for c in [*range(40), None]:
        for t in range(random.randrange(1, 14)):
            role = random.choice(["system", "user", "assistant", "tool", None, "user", "assistant", "user", "assistant", ""])
            rows.append((c, random.choice([None, t, t, t]), role, random.choice(texts)))
    rows += [(100, t, "user", f"{t}.") for t in range(60)]  # costs that never converge
    rows += [(101, t, "user", "same.") for t in range(60)]  # nothing but one turn stays
    rows += [(102, t, ("assistant", "user")[t % 2], f"{t}.") for t in range(61)]
    return rows


@pytest.mark.parametrize("bits", [0, 2, 10])
def test_repair_against_brute_force(spark, broken, bits):
    by = {}
    for c, t, role, text in broken:
        by.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    df = spark.createDataFrame([(*r, *CLASH) for r in broken], TURNS)
    got = {r.conv: tuple(r)[1:] for r in repairs.repair_report(repairs.repair(df, chunk_bits=bits)).collect()}
    assert got == {c: repaired_by_hand(turns) for c, turns in by.items()}


def test_repair_of_nothing(spark):
    found = repairs.repair(spark.createDataFrame([], TURNS))
    assert repairs.repair_report(found).count() == 0 and found.turns.count() == 0


def test_damage(spark):
    rows = spark.createDataFrame([(k, None, None, "a. b!") for k in range(200)], "conv_id long, turn long, role string, text string")
    import zlib

    kinds = {k: zlib.crc32(f"{k}: ".encode()) % 20 for k in range(200)}
    got = {}
    for r in damaged(rows).collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {0: None, 1: [(" ", "")], 2: [(" ", "a b")], 3: [(" ", "a. b!")] * 2, 4: [("user", "a. b!")]}
    assert all(got.get(k) == want.get(kind, [(" ", "a. b!")]) for k, kind in kinds.items()) and set(kinds.values()) >= set(range(5))
