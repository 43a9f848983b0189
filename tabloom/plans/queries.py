"""The registered queries: every operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import c, label_text, named, quoted, replaced
from ..operators import repairs
from ..operators.codebook import CodeBook, csv_line, csv_text
from ..operators.codec import TextCodec, TextConfig
from ..operators.constraints import constraint_detail, constraint_summary, reject_invalid, violated_rules, violation_matrix
from ..operators.fidelity import auc_binary, column_similarity, kolmogorov_smirnov, similarity_mean, total_variation
from ..operators.generation import condition_slots
from ..operators.neighbors import FANOUT, TILE_ROWS, describe, distance_to_closest_record
from ..operators.prompts import PromptBuilder, PromptConfig
from ..operators.ranking import prefix_sums
from ..operators.revision import revision_by_position, revision_in_place
from ..operators.sampling import (
    ROW_ID,
    balanced_draws,
    bootstrap_credit,
    bootstrap_generic,
    capped_sample,
    class_quota,
    split_train_test,
)
from ..operators.schema import coerce_to_schema, infer_categorical
from ..operators.utility import tstr_report
from ..session import materialize
from ..sources import specs as S
from ..sources.readers import combine, normalize_adult, normalize_default_credit, normalize_heloc
from ..sources.sinks import flatten, manifest
from .evaluation import run_experiment, seed_statistics
from .views import lineitem_rules, raw_synthetic, real, repaired, spec, table, typed, view

Query = Callable[[SparkSession, str], DataFrame]
#: Reported doubles are rounded, so that summation order cannot show.
DIGITS = 6
LINES_PER_REPLY = 40


def rounded(df: DataFrame) -> DataFrame:
    doubles = {f.name: f"round({quoted(f.name)}, {DIGITS})" for f in df.schema.fields if f.dataType.typeName() == "double"}
    return replaced(df, doubles)


def fixed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return repaired(raw_synthetic(spark, sf, name), name)


def stored_real(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The real table written once for operators that pass over it several times."""
    return materialize(real(spark, sf, name), "real")


def stored_fixed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return materialize(fixed(spark, sf, name), "fixed")


# --- rules and repairs ----------------------------------------------------------------------


def summary(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return rounded(constraint_summary(view(spark, sf, name), spec(name).constraints()))


def detail(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return rounded(constraint_detail(view(spark, sf, name), spec(name).constraints()))


def violations(name: str, spark: SparkSession, sf: str) -> DataFrame:
    marked = violated_rules(view(spark, sf, name), spec(name).constraints())
    return marked.select(
        ROW_ID, F.array_join("violated", ",").alias("violated"), F.size("violated").cast("long").alias("n_violated")
    )


def rules(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return violation_matrix(view(spark, sf, name), spec(name).constraints(), [ROW_ID])


def rejected(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return reject_invalid(view(spark, sf, name), spec(name).constraints())


def repair(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return spec(name).repaired(view(spark, sf, name))


def summary_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(constraint_summary(table(spark, sf, "lineitem"), lineitem_rules()))


def detail_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(constraint_detail(table(spark, sf, "lineitem"), lineitem_rules()))


def rejected_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    kept = reject_invalid(table(spark, sf, "lineitem"), lineitem_rules())
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")


# --- schema and sources ---------------------------------------------------------------------


def categorical_columns(name: str, spark: SparkSession, sf: str) -> DataFrame:
    found = infer_categorical(typed(spark, sf, name).drop(ROW_ID))
    return spark.createDataFrame([(n,) for n in found], "column string")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    label = repairs.relabel(label_text(quoted(S.HELOC_LABEL)), S.HELOC_LOAD_LABELS, None)
    return view(spark, sf, "heloc").selectExpr(ROW_ID, f"{label} AS label")


def heloc_from_aliases(spark: SparkSession, sf: str) -> DataFrame:
    other = {known: alias for alias, known in S.HELOC_ALIASES.items()}
    rows = view(spark, sf, "heloc")
    renamed = rows.selectExpr(f"{ROW_ID} AS ID", *[named(quoted(n), f" {other[n]} ") for n in S.HELOC_COLUMNS])
    return normalize_heloc(renamed)


def credit_from_aliases(spark: SparkSession, sf: str) -> DataFrame:
    other = {known: alias for alias, known in S.CREDIT_ALIASES.items()}
    rows = view(spark, sf, "credit")
    return normalize_default_credit(rows.selectExpr(f"{ROW_ID} AS ID", *[named(quoted(n), other[n]) for n in S.CREDIT_COLUMNS]))


def adult_as_read(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "adult")
    return normalize_adult(rows.selectExpr(*[named(f"CAST({quoted(n)} AS STRING)", n) for n in S.ADULT_COLUMNS]))


def combined(spark: SparkSession, sf: str) -> DataFrame:
    return combine(real(spark, sf, "adult"), fixed(spark, sf, "adult"))


def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    facts = manifest(real(spark, sf, "heloc").drop(ROW_ID), "heloc", "orders")
    return facts.withColumn("columns", F.array_join("columns", ","))


def flat_report(spark: SparkSession, sf: str) -> DataFrame:
    rules_ = spec("credit").constraints()
    one = lambda df: F.struct(*[c(n) for n in df.columns]).alias("r")
    before = rounded(constraint_summary(raw_synthetic(spark, sf, "credit"), rules_))
    after = rounded(constraint_summary(fixed(spark, sf, "credit"), rules_))
    return flatten(
        spark.range(1).select(
            before.select(one(before)).scalar().alias("raw_constraints"),
            after.select(one(after)).scalar().alias("repaired_constraints"),
        )
    )


# --- splits and samples ---------------------------------------------------------------------


def split_part(part: int, spark: SparkSession, sf: str) -> DataFrame:
    return split_train_test(real(spark, sf, "credit"))[part]


def balanced(spark: SparkSession, sf: str) -> DataFrame:
    return balanced_draws(stored_real(spark, sf, "credit"), S.CREDIT_LABEL, per_class=8, sets=3, rounds=(0, 4))


def quota(spark: SparkSession, sf: str) -> DataFrame:
    return class_quota(real(spark, sf, "credit"), S.CREDIT_LABEL, 24000)


def capped(spark: SparkSession, sf: str) -> DataFrame:
    return capped_sample(real(spark, sf, "credit"), 5000)


def jitter_credit(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap_credit(stored_real(spark, sf, "credit"))


def jitter_generic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bootstrap_generic(stored_real(spark, sf, "adult")))


# --- metrics --------------------------------------------------------------------------------


def revision(name: str, spark: SparkSession, sf: str) -> DataFrame:
    known = spec(name)
    fix = lambda df: coerce_to_schema(known.repaired(df), known.schema, [ROW_ID, "_before"])
    return rounded(revision_in_place(typed(spark, sf, name), fix))


def revision_placed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders before and after a change that also loses rows, compared without an id: later rows meet other rows."""
    before = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderkey")
    after = before.filter("o_orderkey % 5001 <> 5000").selectExpr(
        "o_custkey",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "o_totalprice * 1.0000001D AS o_totalprice",
        "CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE o_orderpriority END AS o_orderpriority",
    )
    return rounded(revision_by_position(before, after))


def tvd(spark: SparkSession, sf: str) -> DataFrame:
    names = list(S.CREDIT_CATEGORICAL)
    return rounded(total_variation(stored_real(spark, sf, "credit"), stored_fixed(spark, sf, "credit"), names))


def ks(spark: SparkSession, sf: str) -> DataFrame:
    numeric = [n for n in S.CREDIT_COLUMNS if n not in S.CREDIT_CATEGORICAL]
    return rounded(kolmogorov_smirnov(stored_real(spark, sf, "credit"), stored_fixed(spark, sf, "credit"), numeric))


def similarity(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return column_similarity(
        stored_real(spark, sf, name), stored_fixed(spark, sf, name), spec(name).categorical, ignore=[ROW_ID]
    )


def similarity_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of returned and other lines, over columns of doubles and text."""
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    back = F.col("l_returnflag") == "R"
    rows = table(spark, sf, "lineitem")
    return rounded(column_similarity(rows.filter(~back).select(*names), rows.filter(back).select(*names)))


def auc_ties(spark: SparkSession, sf: str) -> DataFrame:
    scored = real(spark, sf, "credit").select(c(S.CREDIT_LABEL).alias("y"), c("AGE").alias("score"))
    return rounded(auc_binary(scored, "y", "score"))


def auc_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    scored = rows.select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice", "l_linestatus")
    return rounded(auc_binary(scored, "y", "l_extendedprice", by="l_linestatus"))


def distances(name: str, spark: SparkSession, sf: str, tile_rows: int = TILE_ROWS, fanout: int = FANOUT) -> DataFrame:
    target = spec(name).label
    return distance_to_closest_record(
        stored_real(spark, sf, name), stored_fixed(spark, sf, name), spec(name).categorical, ignore=[target],
        tile_rows=tile_rows, fanout=fanout,
    )


def ranged_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums by ranges at any size, with a null group."""
    rows = table(spark, sf, "lineitem").selectExpr("nullif(l_returnflag, 'A') AS g", "l_extendedprice AS v")
    return prefix_sums(rows.groupBy("g", "v").agg(F.count("*").alias("n")), "v", ["n"], "g", window_rows=0)


def utility(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split_train_test(stored_real(spark, sf, "credit"))
    return rounded(tstr_report(train, stored_fixed(spark, sf, "credit"), test, S.CREDIT_LABEL))


# --- texts, codes, prompts ------------------------------------------------------------------


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = real(spark, sf, "credit")
    return TextCodec.fit(rows).encode(rows)


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    rows = real(spark, sf, "credit")
    codec = TextCodec.fit(rows)
    return codec.decode(codec.encode(rows), keep=[ROW_ID])


def condition_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = real(spark, sf, "adult")
    return rows.select(ROW_ID, TextCodec.fit(rows).condition_prompt(rows, ["income", "sex", "age"]).alias("prompt"))


def partial_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = typed(spark, sf, "credit")
    return rows.select(ROW_ID, TextCodec.fit(rows).partial_prompt(rows).alias("prompt"))


def code_map(spark: SparkSession, sf: str) -> DataFrame:
    return CodeBook.fit(stored_real(spark, sf, "adult"), S.ADULT_CATEGORICAL).table


def code_support(spark: SparkSession, sf: str) -> DataFrame:
    support = CodeBook.fit(stored_real(spark, sf, "adult"), S.ADULT_CATEGORICAL).support()
    return support.select("column", F.array_join("codes", ",").alias("codes"))


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    return CodeBook.fit(stored_real(spark, sf, "adult"), S.ADULT_CATEGORICAL).encode(typed(spark, sf, "adult"))


def joined_book(spark: SparkSession, sf: str) -> CodeBook:
    """A code book whose columns are replaced by shuffled joins, and whose values are numbered by ranges."""
    return CodeBook.fit(stored_real(spark, sf, "adult"), S.ADULT_CATEGORICAL, literal_bound=0, broadcast_rows=0, window_rows=0)


def code_rows(spark: SparkSession, sf: str) -> DataFrame:
    return joined_book(spark, sf).support_rows()


def mapped_by_join(spark: SparkSession, sf: str) -> DataFrame:
    return joined_book(spark, sf).encode(materialize(typed(spark, sf, "adult"), "typed"))


def unmapped_by_join(spark: SparkSession, sf: str) -> DataFrame:
    book = joined_book(spark, sf)
    return book.decode(materialize(book.encode(materialize(typed(spark, sf, "adult"), "typed")), "mapped"))


def unmapped(spark: SparkSession, sf: str) -> DataFrame:
    book = CodeBook.fit(stored_real(spark, sf, "adult"), S.ADULT_CATEGORICAL)
    return book.decode(book.encode(typed(spark, sf, "adult")))


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = typed(spark, sf, "adult")
    return rows.selectExpr(ROW_ID, f"{csv_line(rows.schema, S.ADULT_COLUMNS)} AS line")


def _builder(rows: DataFrame) -> PromptBuilder:
    return PromptBuilder.fit(
        rows, PromptConfig(S.CREDIT_LABEL, n_samples_per_class=8, n_sets=3, generated_rows_per_prompt=40),
        S.CREDIT_CATEGORICAL, {"LIMIT_BAL": "amount of given credit", "AGE": "age in years"},
    )


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_real(spark, sf, "credit")
    return _builder(rows).prompts(rows, (0, 8))


def replies(spark: SparkSession, sf: str, builder: PromptBuilder) -> DataFrame:
    """Every row of the credit table inside some reply: fences, chatter, short rows, unknown codes."""
    rows = builder.coded(typed(spark, sf, "credit")).withColumn("round", F.floor(F.col(ROW_ID) / LINES_PER_REPLY))
    header = ",".join(builder.columns)
    body = csv_text(rows, builder.columns, ROW_ID, by=["round"])
    wide = ",".join(["ZZZZ"] + ["0"] * (len(builder.columns) - 1))
    return body.select(
        "round",
        F.concat_ws(
            "\n", F.lit("Here are rows:"), F.lit("```csv"), F.lit(header), "text", F.lit("1,2,3"), F.lit(wide),
            F.lit("```"), F.lit("Sure, " + "," * (len(builder.columns) - 2)),
        ).alias("reply"),
    )


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    builder = _builder(stored_real(spark, sf, "credit"))
    return builder.parse(replies(spark, sf, builder))


def postprocessed(spark: SparkSession, sf: str) -> DataFrame:
    builder = _builder(stored_real(spark, sf, "credit"))
    return builder.postprocess(builder.parse(replies(spark, sf, builder)), spec("credit").constraints())


def slots(spark: SparkSession, sf: str) -> DataFrame:
    """Which class each text to sample is asked for, and the prompt that asks."""
    rows = real(spark, sf, "credit")
    asked = condition_slots(rows, S.CREDIT_LABEL, 24000).withColumnRenamed("class", S.CREDIT_LABEL)
    return asked.select(ROW_ID, TextCodec.fit(rows).condition_prompt(asked, [S.CREDIT_LABEL]).alias("prompt"))


def float_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    codec = TextCodec(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), TextConfig(random_order=False, float_precision=2))
    return rows.select("l_orderkey", "l_linenumber", codec.sentence(rows, key="l_orderkey").alias("text"))


# --- whole runs -----------------------------------------------------------------------------


def experiment(name: str, seeds: Sequence[int], spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_real(spark, sf, name)
    return rounded(flatten(run_experiment(spec(name), rows, seeds)))


def statistics(name: str, seeds: Sequence[int], spark: SparkSession, sf: str) -> DataFrame:
    return rounded(seed_statistics(experiment(name, seeds, spark, sf)))


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "constraint_summary_lineitem": summary_lineitem,
        "constraint_detail_lineitem": detail_lineitem,
    }
    for name in ("credit", "adult", "heloc"):
        found[f"constraint_summary_{name}"] = partial(summary, name)
        found[f"constraint_detail_{name}"] = partial(detail, name)
        found[f"constraint_violations_{name}"] = partial(violations, name)
        found[f"{name}_rules"] = partial(rules, name)
        found[f"reject_invalid_{name}"] = partial(rejected, name)
        found[f"repair_{name}"] = partial(repair, name)
        found[f"revision_report_{name}"] = partial(revision, name)
        found[f"coerce_schema_{name}"] = lambda spark, sf, name=name: typed(spark, sf, name)
        found[f"infer_categorical_{name}"] = partial(categorical_columns, name)
        found[f"column_similarity_{name}"] = lambda spark, sf, name=name: rounded(similarity(name, spark, sf))
        found[f"dcr_rows_{name}"] = lambda spark, sf, name=name: rounded(distances(name, spark, sf))
    found |= {
        "normalize_labels": labels,
        "normalize_heloc": heloc_from_aliases,
        "normalize_credit": credit_from_aliases,
        "normalize_adult": adult_as_read,
        "combine_tables": combined,
        "dataset_manifest": dataset_manifest,
        "flatten_report": flat_report,
        "split_train": partial(split_part, 0),
        "split_test": partial(split_part, 1),
        "class_balanced_sample": balanced,
        "class_quota": quota,
        "capped_sample": capped,
        "bootstrap_jitter_credit": jitter_credit,
        "bootstrap_jitter_generic": jitter_generic,
        "column_tvd": tvd,
        "column_ks": ks,
        "similarity_mean": lambda spark, sf: rounded(similarity_mean(similarity("credit", spark, sf))),
        "auc_binary": auc_ties,
        "auc_lineitem": auc_lineitem,
        "dcr_rows_cells_credit": lambda spark, sf: rounded(distances("credit", spark, sf, tile_rows=1000)),
        "dcr_rows_levels_heloc": lambda spark, sf: rounded(distances("heloc", spark, sf, tile_rows=1000, fanout=6)),
        "prefix_sums_ranged": ranged_sums,
        "dcr_summary": lambda spark, sf: rounded(describe(distances("credit", spark, sf))),
        "tstr_report": utility,
        "encode_rows_text": encoded,
        "decode_rows_text": decoded,
        "condition_prompts": condition_prompts,
        "partial_row_prompts": partial_prompts,
        "code_map": code_map,
        "code_support": code_support,
        "code_support_rows": code_rows,
        "map_values": mapped,
        "map_values_joined": mapped_by_join,
        "unmap_values_joined": unmapped_by_join,
        "revision_by_position": revision_placed,
        "unmap_values": unmapped,
        "csv_rows": csv_rows,
        "balanced_prompts": prompts,
        "parse_replies": parsed,
        "postprocess_rows": postprocessed,
        "condition_slots": slots,
        "encode_float_text": float_texts,
        "reject_invalid_lineitem": rejected_lineitem,
        "column_similarity_lineitem": similarity_lineitem,
        "experiment_by_seed": partial(experiment, "heloc", (7, 11)),
        "seed_statistics": partial(statistics, "credit", (7, 11)),
    }
    return found
