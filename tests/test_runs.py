"""Whole runs, and parity with DuckDB for a cross-section of the registered queries."""

import os
import threading

import pandas as pd
import pytest

import __spark_entry__ as entry_points
from tabloom.plans import evaluation, views
from tabloom.plans.evaluation import evaluate_run, generate_synthetic, run_experiment, seed_statistics
from tabloom.session import METHOD_LIMIT, compiled_methods, materialize
from tabloom.sources.sinks import flatten
from tabloom.sources.tables import HELOC

CHECKED = [
    "constraint_summary_lineitem", "constraint_violations_heloc", "repair_adult", "revision_report_credit",
    "split_test", "class_balanced_sample", "bootstrap_jitter_credit", "auc_lineitem", "dcr_rows_adult",
    "encode_rows_text", "balanced_prompts", "postprocess_rows", "condition_slots", "encode_float_text",
    "reject_invalid_lineitem", "column_similarity_lineitem", "column_similarity_adult", "dcr_summary", "reject_invalid_credit",
]


def test_experiment(spark, small, tmp_path):
    rows = views.real(spark, small, "heloc")
    reports = run_experiment(HELOC, rows, [7, 11], outdir=str(tmp_path), max_real=200, max_synthetic=100)
    flat = flatten(reports)
    first, second = flat.orderBy("seed").collect()
    assert (first["seed"], second["seed"]) == (7, 11) and first["n_real_train"] == first["n_synthetic_raw"]
    assert first["repaired_constraints.cvr"] <= first["raw_constraints.cvr"] and first["dcr.count"] == 100
    stats = seed_statistics(flat).first()
    assert stats["n_seeds"] == 2 and 0 <= stats["column_similarity.column_similarity_mean.mean"] <= 1
    written = {p.name for p in tmp_path.iterdir()}
    assert {"summary_all", "summary_by_seed", "heloc_bootstrap_seed7"} <= written


def test_a_failing_model_costs_only_its_own_part(spark, small):
    rows = materialize(views.real(spark, small, "heloc").limit(60), "few")
    one_class = rows.filter("RiskPerformance = 'Good'")
    report = flatten(evaluate_run(one_class, one_class, rows, rows, HELOC.label, HELOC.categorical, HELOC.constraints(), 1, "x")).first()
    assert report["tstr_auc.error"] and report["dcr.count"] == 60 and report["raw_constraints.n_rows"] == 60


def test_texts_need_a_responder(spark, small):
    with pytest.raises(ValueError, match="responder"):
        generate_synthetic(HELOC, views.real(spark, small, "heloc"), "prompts", 5, 7)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def _rows(table):
    show = lambda v: "" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(show(v) for v in row) for row in table[sorted(table.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_parity(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    expected = con.execute(entry_points.oracle_sql()[name]).df()
    found = entry_points.queries()[name](spark, small).toPandas()
    assert _rows(found) == _rows(expected)


def test_seeds_run_together(spark, monkeypatch):
    """Two seeds meet at a barrier, which runs one after the other would never pass; reports stay in order."""
    both = threading.Barrier(2, timeout=20)

    def run(spec, df, seed, **_):
        both.wait()
        return df.selectExpr(f"{seed}L AS seed")

    monkeypatch.setattr(evaluation, "run_seed", run)
    reports = evaluation.run_experiment(None, spark.range(1), [7, 11])
    assert [r.seed for r in reports.collect()] == [7, 11]


def test_runs_keep_generated_methods_short(spark, small, monkeypatch):
    """Jobs of a run, and only they, fuse no operators into methods that stay interpreted; its report is stored."""
    name, limit = METHOD_LIMIT
    own, seen, run = spark.conf.get(name), [], evaluation.evaluate_run

    def evaluate(*args, **options):
        with compiled_methods(spark):
            pass
        seen.append(int(spark.conf.get(name)))  # still held by the run
        return run(*args, **options)

    monkeypatch.setattr(evaluation, "evaluate_run", evaluate)
    reports = evaluation.run_experiment(HELOC, views.real(spark, small, "heloc"), [7], max_real=50, max_synthetic=50)
    assert seen == [limit] and spark.conf.get(name) == own
    assert reports.inputFiles() and all("/report-" in f for f in reports.inputFiles())
