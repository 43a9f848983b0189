import io
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from tabloom.functions import tiles
from tabloom.operators import neighbors, ridge, utility
from tabloom.operators.fidelity import auc_binary, column_similarity, similarity_mean
from tabloom.operators.neighbors import describe, distance_to_closest_record
from tabloom.operators.revision import revision_by_position, revision_in_place, revision_report, with_position
from tabloom.operators.ridge import Ridge
from tabloom.operators.sampling import ROW_ID
from tabloom.operators.schema import coerce_to_schema
from tabloom.operators.utility import tstr_report
from tabloom.plans import views
from tabloom.sources.tables import HELOC


def test_revision(spark):
    before = spark.createDataFrame([(1, 1, "a"), (2, 2, None), (3, 3, "c")], "_row_id int, x int, y string")
    after = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (3, 4.0, "d")], "_row_id int, x double, y string")
    r = revision_report(before, after).first()
    assert (r.compared_cells, r.revised_cells, r.revised_rows) == (6, 2, 1)
    r = revision_report(before, after.filter("_row_id < 3"), ["x"]).first()
    assert (r.n_columns_compared, r.dropped_row_rate, r.added_row_rate) == (1, pytest.approx(1 / 3), 0.0)
    assert revision_report(before.limit(0), after).first().added_row_rate == 1.0


def test_likeness(spark):
    real = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 3, 1), (None, 4, 1)], "c string, n long, gone int")
    synth = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("b", 3.0), ("c", 9.0)], "c string, n double")
    found = {r["column"]: (r["type"], r["distance"]) for r in column_similarity(real, synth).collect()}
    assert found == {"c": ("categorical_tvd", 0.5), "n": ("numeric_ks", 0.25), "gone": ("missing", 1.0)}
    same = column_similarity(real, real, ["gone"])
    assert similarity_mean(same).first()[0] == 1.0
    assert math.isnan(similarity_mean(same.limit(0)).first()[0])
    empty = synth.selectExpr("c", "CAST(NULL AS DOUBLE) AS n")
    assert column_similarity(real.select("n"), empty.select("n")).first()["distance"] == 1.0


def test_auc(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8), (0, 0.8)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert auc_binary(df, "y", "s").first().auc == pytest.approx(2 / 3)
    assert auc_binary(df.selectExpr("y", "-s AS s"), "y", "s").first().auc == pytest.approx(1 / 3)
    assert math.isnan(auc_binary(df.filter("y = 0"), "y", "s").first().auc)


def test_small_distances_and_summary(spark):
    real = spark.createDataFrame([(1, 0.0, "x"), (2, 10.0, "y")], "_row_id long, a double, b string")
    synth = spark.createDataFrame(
        [(1, 5.0, "x"), (2, 10.0, "y"), (3, None, "x"), (4, 20.0, "y")], "_row_id long, a double, b string"
    )
    got = [r.dcr for r in distance_to_closest_record(real, synth).orderBy("_row_id").collect()]
    assert got == pytest.approx([math.sqrt(0.125), 0.0, 0.0, math.sqrt(0.5)])
    assert distance_to_closest_record(real, synth, max_synthetic=2).count() == 2
    assert distance_to_closest_record(real.limit(0), synth).count() == 0
    r = describe(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "dcr double")).first()
    assert (r["count"], r["mean"], r["25%"], r["50%"], r["75%"]) == (4, 2.5, 1.75, 2.5, 3.25)


def _clusters(rng, n):
    spot = rng.integers(0, 6, n)
    return pd.DataFrame(
        {
            "_row_id": np.arange(n),
            "a": spot * 10 + rng.normal(size=n),
            "b": spot * 5 + rng.integers(0, 4, n),
            "c": [f"k{x}" for x in (spot + rng.integers(0, 2, n)) % 6],
        }
    )


@pytest.mark.parametrize(("tile_rows", "fanout"), [(100, 256), (20, 4), (1, 2)])
def test_pruned_tiles_match_brute_force(spark, monkeypatch, tile_rows, fanout):
    """One level, several levels, and more levels than the tree may have."""
    rng = np.random.default_rng(0)
    real, synth = _clusters(rng, 900), _clusters(rng, 300)
    synth.loc[5, ["a", "b", "c"]] = real.loc[7, ["a", "b", "c"]]
    synth.loc[100:199, ["a", "b", "c"]] = synth.loc[100, ["a", "b", "c"]].tolist()  # a third are copies
    total = (synth["c"].to_numpy()[:, None] != real["c"].to_numpy()[None]).astype(float)
    for name in "ab":
        low, width = real[name].min(), real[name].max() - real[name].min()
        total += ((synth[name].to_numpy(float)[:, None] - real[name].to_numpy(float)[None]) / width) ** 2
    expected = np.sqrt(total.min(axis=1) / 3)
    monkeypatch.setattr(neighbors, "PROBE_ROWS", 60)
    monkeypatch.setattr(neighbors, "NODE_ROWS", 150)
    monkeypatch.setattr(neighbors, "LEVELS", 4)
    found = distance_to_closest_record(
        spark.createDataFrame(real), spark.createDataFrame(synth), tile_rows=tile_rows, fanout=fanout, compared=True
    )
    found = found.orderBy("_row_id").toPandas()
    assert np.allclose(found["dcr"], expected, atol=1e-9) and found["dcr"][5] == 0.0 and found["compared"][5] == 0
    assert found["compared"].sum() < 0.6 * len(real) * len(synth)


def test_cells_stay_below_a_tile(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([([float(a), float(b)], ["k"]) for a, b in rng.normal(size=(3000, 2))], "x array<double>, k array<string>")
    tree = neighbors._Tree(rows, 3000, tile_rows=50, fanout=8)
    assert len(tree.levels) > 2
    sizes = {r.cell: r.n for r in tree.leaves.collect()}
    assert max(sizes.values()) <= 50 and sum(sizes.values()) == 3000
    assert {r.cell: r["count"] for r in tree.placed.groupBy("cell").count().collect()} == sizes
    levels = [[(r.cell, r.parent, r.leaf) for r in nodes.collect()] for nodes in tree.levels]
    for above, nodes in zip(levels, levels[1:], strict=False):
        assert {p for _, p, _ in nodes} == {c for c, _, leaf in above if not leaf}


def test_cuts_go_where_the_sides_are_apart():
    """Columns in two clumps exclude more rows than even ones, although these vary more."""
    rng = np.random.default_rng(4)
    some = lambda n: np.column_stack([rng.random((n, 3)), rng.choice([0.25, 0.75], (n, 6)) + 0.01 * rng.random((n, 6))])
    real, probes = some(4000), some(300)
    codes = [rng.integers(0, 3, (n, 1)).astype(np.int16) for n in (4000, 300)]
    best = np.full(300, np.inf)
    compared = tiles.Cell(real, codes[0], 16, 4).nearest(probes, codes[1], best)
    exact = ((probes[:, None] - real[None]) ** 2).sum(2) + (codes[1] != codes[0].T)
    assert np.allclose(best, exact.min(axis=1), atol=1e-12)
    assert compared.mean() < 35


def test_only_open_probes_go_on():
    """Passes share out the near cells, each once, ties included; a probe without any from a place on is left out there."""
    rng = np.random.default_rng(5)
    low = np.round(rng.random((40, 2)), 1)
    high = low + 0.1
    words = pa.array([["k"]] * 40)
    cells = pa.table({"cell": np.arange(40), "low": pa.array(low.tolist()), "high": pa.array(high.tolist()), "first": words, "last": words})
    x, d = np.round(rng.random((200, 2)), 1), rng.random(200) * 0.05
    probes = pa.RecordBatch.from_pydict({"id": np.arange(200), "x": pa.array(x.tolist()), "k": pa.array([["k"]] * 200), "d": d})
    gap = np.maximum(0, np.maximum(low[None] - x[:, None], x[:, None] - high[None]))
    near = (gap**2).sum(2) < d[:, None]
    visits = [sorted(zip(*tiles._visits(cells, p, probes))) for p in ((0, 1), (1, 5), (5, None))]
    assert sorted(sum(visits, [])) == sorted(zip(*np.nonzero(near)))
    for place in (1, 5):
        left = pa.Table.from_batches(tiles.open_probes(cells, place)([probes]))
        assert left["id"].to_pylist() == np.flatnonzero(near.sum(axis=1) > place).tolist() and 0 < len(left) < 200


def test_tstr(spark):
    rng = np.random.default_rng(1)
    rows = _clusters(rng, 600)
    rows["y"] = np.where(rows["a"] + rng.normal(size=600) * 5 > 25, "yes", "no")
    df = spark.createDataFrame(rows)
    train, test = df.filter("_row_id < 400"), df.filter("_row_id >= 400")
    r = tstr_report(train, train, test, "y", max_iter=20).first()
    assert r.synthetic_auc == pytest.approx(r.real_auc) and 0.9 < r.real_auc <= 1.0
    assert (r.n_train_real, r.n_test_real) == (400, 200)
    with pytest.raises(ValueError):
        tstr_report(train.filter("y = 'no'"), train, test.filter("y = 'no'"), "y")


def test_labels_come_from_the_distinct_values(spark):
    rows = [(1, "b", None, 0, "x"), (2, "a", None, 1, "y"), (3, None, None, 1, "x"), (4, "b", None, 0, "x"), (5, "c", "d", 2, None)]
    df = spark.createDataFrame(rows, "_row_id int, t string, u string, f int, y string")
    design = utility.Design.fit(df.filter("y IS NOT NULL"), "y", ROW_ID)
    assert sorted(tuple(map(str, r)) for r in design.levels.collect()) == [
        ("v0", "None"), ("v0", "a"), ("v0", "b"), ("v1", "None"), ("v2", "0"), ("v2", "1"),
    ]
    assert [list(x) for x in design.pipeline(1e-4, 5).getStages()[0].labelsArray] == [["a", "b"], [], ["0", "1"]]


def test_describe_of_few_values(spark):
    got = describe(spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "dcr double")).first()
    assert (got["count"], got["mean"], got["min"], got["max"], got["50%"], got["75%"]) == (3, 2.0, 1.0, 4.0, 1.0, 2.5)
    assert abs(got["std"] - 3**0.5) < 1e-12
    one = describe(spark.createDataFrame([(2.0,)], "dcr double")).first()
    none = describe(spark.createDataFrame([], "dcr double")).first()
    assert (one["count"], one["std"], none["count"], none["mean"], none["std"]) == (1, None, 0, None, None)


def test_revision_in_place_equals_the_join(spark, small):
    before = views.typed(spark, small, "heloc")
    fix = lambda df: coerce_to_schema(HELOC.repaired(df), HELOC.schema, [ROW_ID, *([] if "_before" not in df.columns else ["_before"])])
    narrow = revision_in_place(before, fix)
    assert narrow.first() == revision_report(before, fix(before)).first()
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    with pytest.raises(ValueError, match="loses"):
        revision_in_place(before, lambda df: df.drop("MaxDelqEver"))


def test_revision_by_position(spark, tmp_path):
    """Files and pieces in stored order, whatever tasks read them; later rows of a shortened table meet other rows."""
    rows = pd.DataFrame({"x": np.arange(5000), "t": [f"t{i % 7}" for i in range(5000)]})
    for k in range(4):
        rows[k * 1250 : (k + 1) * 1250].to_csv(tmp_path / f"part-{k}.csv", index=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        before = spark.read.csv(str(tmp_path), header=True, schema="x long, t string")
        placed = with_position(before).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r._position, r.x) for r in placed) == [(i, i) for i in range(5000)]
    after = before.filter("x < 3000 OR x > 3001").selectExpr("x + IF(x % 10 = 0, 1000, 0) AS x", "IF(x = 4, NULL, t) AS t")
    r = revision_by_position(before, after).first()
    x, t = rows["x"].to_numpy(), rows["t"].to_numpy()
    kept = (x < 3000) | (x > 3001)
    moved, texts = (x + np.where(x % 10 == 0, 1000, 0))[kept], np.where(x == 4, None, t)[kept]
    cells = ~np.isclose(x[:4998], moved)
    words = t[:4998] != texts
    assert (r.n_rows_before, r.n_rows_after, r.compared_cells) == (5000, 4998, 4998 * 2)
    assert (r.revised_cells, r.revised_rows) == (cells.sum() + words.sum(), (cells | words).sum())
    plain = revision_by_position(spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,), (4,)], "x int")).first()
    assert (plain.revised_rows, plain.added_row_rate) == (1, pytest.approx(1 / 3))
    assert revision_by_position(before.limit(0), before.limit(0)).first().n_rows_before == 0


def test_table_solver_finds_the_minimum(spark):
    """Coefficients in a table, with categories that only the test has, missing cells and a hot value: the scores are
    those of Newton's method, and the dense solver's to its own tolerance."""
    rng = np.random.default_rng(7)
    n = 400
    kind = np.where(rng.random(n) < 0.5, "hot", np.char.add("k", rng.integers(0, 25, n).astype(str)))
    number = rng.normal(size=n)
    signal = number + (kind == "hot") * 1.5 - np.char.str_len(kind) * 0.3 + rng.normal(size=n)
    rows = pd.DataFrame({"_row_id": np.arange(n), "k": kind, "x": number, "y": np.where(signal > 0, "q", "p")})
    rows.loc[::17, "k"] = None
    rows.loc[350:370, "k"] = "never seen"
    df = spark.createDataFrame(rows)
    train, test = df.filter("_row_id < 300"), df.filter("_row_id >= 300")
    by_bound = {}
    for bound in (100_000, 0):
        scored, model = utility.fit_scores(train, test, "y", l2=1e-2, max_iter=60, driver_categories=bound)
        by_bound[bound] = np.sort([r.score for r in scored.collect()])
    assert isinstance(model, Ridge) and model.passes < 60

    old, new = rows[:300], rows[300:]
    levels = sorted(old["k"].dropna().unique())
    mean, std = old["x"].mean(), old["x"].std()
    features = lambda t: np.column_stack([(t["x"] - mean) / std, *[(t["k"] == k) for k in levels], np.ones(len(t))]).astype(float)
    x, y, w = features(old), (old["y"] == "q").to_numpy(float), np.zeros(len(levels) + 2)
    ridge_part = np.diag([1e-2] * (len(w) - 1) + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x / 300 + ridge_part, x.T @ (p - y) / 300 + ridge_part @ w)
    exact = np.sort(1 / (1 + np.exp(-features(new) @ w)))
    assert np.abs(by_bound[0] - exact).max() < 2e-3 and np.abs(by_bound[100_000] - exact).max() < 2e-2


def test_direction_is_that_of_two_loops():
    rng = np.random.default_rng(2)
    k, n = 3, 10
    s, g = rng.normal(size=(k, n)), rng.normal(size=n)
    a = rng.normal(size=(n, n))
    y = s @ (a @ a.T + np.eye(n))
    basis = np.vstack([s, y, g])
    got = ridge._direction(basis @ basis.T, k) @ basis
    q, alpha = -g.copy(), np.zeros(k)
    for i in reversed(range(k)):
        alpha[i] = s[i] @ q / (s[i] @ y[i])
        q -= alpha[i] * y[i]
    q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1])
    for i in range(k):
        q += s[i] * (alpha[i] - y[i] @ q / (s[i] @ y[i]))
    assert np.allclose(got, q)


def test_boxes_leave_few_rows_to_compare(spark, monkeypatch):
    """Columns that all differ: several cells, and a search that looks at a small share of them."""
    rng = np.random.default_rng(5)
    make = lambda n: pd.DataFrame(
        {"_row_id": np.arange(n), "a": rng.random(n), "b": rng.random(n)}
        | {f"k{i}": [f"v{x}" for x in rng.integers(0, 9, n)] for i in range(3)}
    )
    real, synth = make(6000), make(400)
    total = sum((synth[f"k{i}"].to_numpy()[:, None] != real[f"k{i}"].to_numpy()[None]).astype(float) for i in range(3))
    for name in "ab":
        low, width = real[name].min(), real[name].max() - real[name].min()
        total += ((synth[name].to_numpy()[:, None] - real[name].to_numpy()[None]) / width) ** 2
    monkeypatch.setattr(neighbors, "NODE_ROWS", 1000)
    found = distance_to_closest_record(
        spark.createDataFrame(real), spark.createDataFrame(synth), tile_rows=20, fanout=4, compared=True
    )
    found = found.orderBy("_row_id").toPandas()
    assert np.allclose(found["dcr"], np.sqrt(total.min(axis=1) / 5), atol=1e-9)
    assert found["compared"].mean() < 0.1 * len(real)


def test_tile_functions_travel_by_value():
    """Executors need no installed package for the search."""
    table = pa.table({"x": [[0.1], [0.2]], "k": [["a"], ["b"]], "cell": [0, 0]})
    steps = [tiles.to_children(tiles.Cuts(table, {0: 2}, 2)), tiles.cell_facts, tiles.merged_facts, tiles.cell_minima(5, 4)]
    steps.append(tiles.cells_to_visit(table, (0, 1)))
    assert not any(_by_reference(step) for step in steps)


def _by_reference(step) -> list[str]:
    found = []

    class Reader(pickle.Unpickler):
        def find_class(self, module, name):
            found.extend([module] * module.startswith("tabloom"))
            return super().find_class(module, name)

    Reader(io.BytesIO(cloudpickle.dumps(step))).load()
    return found


def test_rows_travel_packed():
    """A block is a fraction of its rows, and gives them back exactly."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 80, (4000, 20)) / 79
    k = rng.integers(0, 9, (4000, 3))
    rows = pa.table({"id": [f"i{i}" for i in range(4000)], "x": x.tolist(), "k": [[f"word{w}" for w in row] for row in k], "d": [np.inf] * 4000})
    block = tiles._packed(rows)
    back = tiles._unpacked(pa.chunked_array([pa.array([block], pa.binary())]))
    assert len(block) < rows.nbytes / 3
    assert back["id"].to_pylist() == rows["id"].to_pylist() and back["d"].to_pylist() == rows["d"].to_pylist()
    assert (tiles._numbers(back) == x).all() and (tiles._ranks(back, back)[1] == k).all()
    cells = pa.table({"cell": [7], "low": [[0.0] * 20], "high": [[1.0] * 20], "first": [["word0"] * 3], "last": [["word8"] * 3]})
    dealt = tiles.probe_blocks(cells, (0, 1), {7: (2, 3)})(iter(rows.append_column("h", pa.array(range(4000))).to_batches()))
    dealt = pa.Table.from_batches(dealt)
    assert sorted(zip(*(dealt[n].to_pylist() for n in ("cell", "a", "b")))) == [(7, a, b) for a in range(2) for b in range(3)]
    assert tiles._unpacked(dealt.filter(pa.array(a == 0 for a in dealt["a"].to_pylist()))["block"]).num_rows == 4000
