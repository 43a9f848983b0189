"""One report per run, runs over several seeds, and statistics over them."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import partial

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, is_numeric, quoted
from ..operators.codec import TextCodec, TextConfig
from ..operators.constraints import Constraint, constraint_summary
from ..operators.fidelity import column_similarity, similarity_mean
from ..operators.generation import Responder, generate, rounds_needed, sample_texts
from ..operators.neighbors import describe, distance_to_closest_record
from ..operators.prompts import PromptBuilder, PromptConfig
from ..operators.revision import revision_report
from ..operators.sampling import ROW_ID, bootstrap_credit, bootstrap_generic, split_train_test
from ..operators.schema import coerce_to_schema
from ..operators.utility import tstr_report
from ..session import compiled_methods, materialize, together
from ..sources.sinks import flatten, write_csv, write_json, write_text
from ..sources.specs import TableSpec
from ..sources.tables import CREDIT

METHODS = ("prompts", "texts", "bootstrap")


def _struct(report: DataFrame) -> Column:
    """A one-row report as a struct-valued scalar subquery."""
    return report.select(F.struct(*[c(n) for n in report.columns]).alias("r")).scalar()


def evaluate_run(
    train: DataFrame,
    test: DataFrame,
    raw: DataFrame,
    fixed: DataFrame,
    target: str,
    categorical: Collection[str],
    rules: Sequence[Constraint],
    seed: int,
    method: str,
    max_real: int | None = None,
    max_synthetic: int | None = None,
    key: str = ROW_ID,
    similarity: DataFrame | None = None,
) -> DataFrame:
    """One row of nested reports: rules before and after repair, revision, likeness, AUC, distances.

    A failing model (say, a single class) is reported in ``tstr_auc.error``
    instead of failing the run.
    """
    likeness = column_similarity(train, fixed, categorical, ignore=[key]) if similarity is None else similarity
    no_error = F.lit(None).cast("string").alias("error")
    parts = [
        lambda: describe(distance_to_closest_record(train, fixed, categorical, max_real, max_synthetic, seed, ignore=[target], key=key)),
        # Stored here, so that a failure of its jobs is met here too.
        lambda: materialize(tstr_report(train, fixed, test, target, key=key).select("*", no_error), "utility"),
    ]
    # The solver's many short jobs leave cores idle, which the distances use meanwhile.
    distances, utility = together(parts)
    try:
        utility = utility.result()
    except (ValueError, AnalysisException, IllegalArgumentException) as failure:  # of the model, not of the cluster
        utility = train.sparkSession.createDataFrame(
            [(None, None, None, None, None, None, str(failure))],
            "synthetic_auc double, real_auc double, n_train_synthetic bigint, n_train_real bigint, "
            "n_test_real bigint, solver string, error string",
        )
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return train.sparkSession.range(1).select(
        F.lit(seed).cast("long").alias("seed"),
        F.lit(method).alias("method"),
        size(train).alias("n_real_train"),
        size(test).alias("n_real_test"),
        size(raw).alias("n_synthetic_raw"),
        size(fixed).alias("n_synthetic_repaired"),
        _struct(constraint_summary(raw, rules)).alias("raw_constraints"),
        _struct(constraint_summary(fixed, rules)).alias("repaired_constraints"),
        _struct(revision_report(raw, fixed, key=key)).alias("revision"),
        _struct(similarity_mean(likeness)).alias("column_similarity"),
        _struct(utility).alias("tstr_auc"),
        _struct(distances.result()).alias("dcr"),
    )


def generate_synthetic(
    spec: TableSpec,
    train: DataFrame,
    method: str,
    n: int,
    seed: int,
    responder: Responder | None = None,
    prompt_config: PromptConfig | None = None,
    max_rounds: int | None = None,
    condition_on_target: bool = True,
) -> DataFrame:
    """Raw synthetic rows with a row id, by one of three methods.

    ``prompts`` asks for CSV rows, ``texts`` for sentences, both from the given
    responder; ``bootstrap`` draws rows with jitter.
    """
    if method == "bootstrap":
        draw = bootstrap_credit if spec.name == CREDIT.name else bootstrap_generic
        return draw(train, n, seed)
    if method in ("prompts", "texts") and responder is None:
        raise ValueError(f"method {method!r} needs a responder")
    if method == "prompts":
        config = prompt_config or PromptConfig(spec.label, generated_rows_per_prompt=40, seed=seed)
        builder = PromptBuilder.fit(train, config, spec.categorical)
        rounds = max_rounds or rounds_needed(n, config.generated_rows_per_prompt)
        rows = generate(builder, train, responder, n, max_rounds=rounds)
        numbered = F.col("round") * F.lit(1 << 32) + F.col("line_no")
        return rows.select(numbered.alias(ROW_ID), *[c(x) for x in builder.columns])
    if method == "texts":
        codec = TextCodec.fit(train, TextConfig(float_precision=0))
        return sample_texts(codec, train, responder, n, spec.label if condition_on_target else None, seed)
    raise ValueError(f"Unknown method {method!r}; known: {METHODS}")


def run_seed(
    spec: TableSpec,
    df: DataFrame,
    seed: int,
    method: str = "bootstrap",
    n_synthetic: int | None = None,
    test_size: float = 0.2,
    responder: Responder | None = None,
    max_real: int | None = None,
    max_synthetic: int | None = None,
    outdir: str | None = None,
    **options: object,
) -> DataFrame:
    """Split, generate, coerce, repair, coerce and evaluate once; optionally write every artefact."""
    rules = spec.constraints()
    train, test = (materialize(part, "split") for part in split_train_test(df, test_size, seed))
    n = n_synthetic or train.count()
    raw = generate_synthetic(spec, train, method, n, seed, responder, **options)
    raw = materialize(coerce_to_schema(raw, train, [ROW_ID]), "raw")
    fixed = materialize(coerce_to_schema(spec.repaired(raw), train, [ROW_ID]), "repaired")
    likeness = column_similarity(train, fixed, spec.categorical, ignore=[ROW_ID])
    report = evaluate_run(
        train, test, raw, fixed, spec.label, spec.categorical, rules, seed, method, max_real, max_synthetic,
        similarity=likeness,
    ).withColumn("dataset", F.lit(spec.name))
    report = materialize(report, "report")
    if outdir:
        folder = f"{outdir}/{spec.name}_{method}_seed{seed}"
        parts = {"real_train": train, "real_test": test, "synthetic_raw": raw, "synthetic_repaired": fixed}
        for name, part in parts.items():
            write_csv(part.drop(ROW_ID), f"{folder}/{name}")
        write_csv(likeness, f"{folder}/column_similarity")
        write_json(report, f"{folder}/summary")
        if method == "prompts":
            config = options.get("prompt_config") or PromptConfig(spec.label, generated_rows_per_prompt=40, seed=seed)
            builder = PromptBuilder.fit(train, config, spec.categorical)
            write_text(builder.prompts(train), "prompt", f"{folder}/prompt_preview")
    return report


def run_experiment(
    spec: TableSpec, df: DataFrame, seeds: Sequence[int], outdir: str | None = None, **options: object
) -> DataFrame:
    """One nested report row per seed, stored; with ``outdir``, also all artefacts and the flat table by seed."""
    reports = None
    with compiled_methods(df.sparkSession):
        runs = together([partial(run_seed, spec, df, seed, outdir=outdir, **options) for seed in seeds])
    for run in runs:
        report = run.result()
        reports = report if reports is None else reports.unionByName(report)
    if outdir:
        write_json(reports, f"{outdir}/summary_all")
        write_csv(flatten(reports), f"{outdir}/summary_by_seed")
    return reports


def seed_statistics(by_seed: DataFrame, groups: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """Mean and sample deviation over seeds of every number in a flat by-seed table."""
    numbers = [
        n for n in by_seed.columns if n not in (*groups, "seed") and is_numeric(by_seed.schema[n].dataType)
    ]
    return by_seed.groupBy(*[F.col(quoted(g)) for g in groups]).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        *[f(c(n)).alias(f"{n}.{name}") for n in numbers for name, f in (("mean", F.avg), ("std", F.stddev_samp))],
    )
