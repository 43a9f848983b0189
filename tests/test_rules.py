from pyspark.sql import functions as F

from tabloom.functions.columns import c
from tabloom.functions.numeric import integerish, num
from tabloom.operators import presets, repairs
from tabloom.operators.constraints import (
    Constraint,
    constraint_detail,
    constraint_summary,
    in_numeric_set,
    less_equal_unless_code,
    numeric_at_least,
    reject_invalid,
    violated_rules,
    violation_matrix,
)
from tabloom.plans import views
from tabloom.sources import specs as S
from tabloom.sources.tables import TABLES


def column(df, expression):
    return [r[0] for r in df.selectExpr(expression).collect()]


def test_number_parsing(spark):
    texts = ["1", " 2 ", "1e3", "+5", "1d", "1_000", "nan", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert column(df, num(df.schema, "x")) == [1.0, 2.0, 1000.0, 5.0, None, None, None, None, None]
    df = spark.createDataFrame([(3.0,), (1.0005,), (100000.4,), (None,), (float("nan"),)], "x double")
    assert column(df, integerish(df.schema, "x")) == [True, False, True, False, False]


def test_round_and_clip(spark):
    df = spark.createDataFrame([("2.5",), ("99.5",), ("100.6",), ("x",)], "x string")
    assert column(df, repairs.round_clip(num(df.schema, "x"), 18, 100)) == [18, 100, 100, 18]
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (float("inf"),)], "x double")
    assert column(df, repairs.round_clip(num(df.schema, "x"), 0)) == [0, 2, 2, 0]
    df = spark.createDataFrame([(-9.0,), (-8.4,), (-5.0,), (130.0,)], "x double")
    assert column(df, repairs.round_clip_keep_codes("x", 0, 100, S.HELOC_CODES)) == [-9, -8, 0, 100]
    df = spark.createDataFrame([(7,), (0,), (None,)], "x int")
    assert column(df, repairs.nearest_allowed("x", (0, 1, 2))) == [2, 0, 0]
    assert column(df, repairs.nearest_allowed("x", (1, 2))) == [2, 1, 1]


def test_pairs_are_clipped_in_order(spark):
    df = spark.createDataFrame([(10, 5, 3), (10, -9, 3)], "c90 long, c60 long, tot long")
    pairs = [("c90", "c60"), ("c60", "tot"), ("c90", "tot"), ("c90", "absent")]
    assert [tuple(r) for r in repairs.clip_pairs(df, pairs, S.HELOC_CODES).collect()] == [(3, 3, 3), (3, -9, 3)]


def test_less_equal_waives_codes(spark):
    df = spark.createDataFrame([(5, -9), (5, 4), (None, 4)], "a long, b long")
    rule = less_equal_unless_code("a", "b", S.HELOC_CODES, "HELOC")
    assert [r[0] for r in violation_matrix(df, [rule]).collect()] == [False, True, True]


def test_summary_numbers(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 1)], "a int, b int")
    rules = [in_numeric_set("a", [1]), in_numeric_set("b", [1])]
    assert tuple(constraint_summary(df, rules).first()) == (4, 2, 0.25, 0.5, 0.25, 0.5)
    assert [r.violation_rate for r in constraint_detail(df, rules).collect()] == [0.5, 0.0]
    assert tuple(constraint_summary(df, []).first()) == (4, 0, 0.0, 0.0, 0.0, 0.0)
    nothing = df.limit(0)
    assert tuple(constraint_summary(nothing, rules).first()) == (0, 2, 0.0, 0.0, 0.0, 0.0)
    assert constraint_detail(nothing, rules).first().violation_rate is None
    assert constraint_detail(df, []).count() == 0 and reject_invalid(df, rules).count() == 2
    assert violated_rules(df, rules).first().violated == ["a_domain"]


def test_odd_predicates_count_as_violations(spark):
    df = spark.createDataFrame([(1, float("nan")), (None, 2.0)], "a int, x double")
    rules = [
        Constraint("absent", ("zzz",), "", lambda d: True),
        Constraint("raises", ("a",), "", lambda d: 1 / 0),
        Constraint("unknown", ("a",), "", lambda d: c("nope") > 1),
        Constraint("unparsable", ("a",), "", lambda d: "a >>> > 1"),
        Constraint("text", ("a",), "", lambda d: F.lit("x")),
        Constraint("scalar", ("a",), "", lambda d: True),
        Constraint("number", ("a",), "", lambda d: c("a")),
        numeric_at_least("x", 1),
    ]
    first, second = (list(r) for r in violation_matrix(df, rules).collect())
    assert first == [True] * 5 + [False, False, True]
    assert second == [True] * 5 + [False, True, False]


def test_presets_and_idempotent_repairs(spark, small):
    sizes = {"credit": 18, "adult": 7, "heloc": 31}
    for name, size in sizes.items():
        spec = views.spec(name)
        assert len(spec.constraints()) == size
        raw = views.view(spark, small, name)
        once = spec.repaired(raw)
        assert once.exceptAll(spec.repaired(once)).isEmpty()
        if name == "credit":
            assert constraint_summary(once, spec.constraints()).first().cvr == 0.0
    assert len(presets.credit_constraints("")) == 17 and set(TABLES) == {"default-credit", "adult", "heloc"}


def test_strict_repair_respects_count_bound(spark):
    df = spark.createDataFrame([("yes", 800)], "RiskPerformance string, NumTotalTrades long")
    assert tuple(repairs.repair_heloc(df).first()) == ("Bad", 800)
    assert tuple(repairs.repair_heloc(df, strict=True).first()) == ("Bad", 500)


def test_rules_on_a_stream(spark, small, tmp_path):
    rows = views.view(spark, small, "credit")
    rows.write.parquet(str(tmp_path / "in"))
    rules = views.spec("credit").constraints()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (
        repairs.repair_credit(violated_rules(stream, rules))
        .writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.processAllAvailable()
    query.stop()
    batch = repairs.repair_credit(violated_rules(rows, rules))
    assert spark.table("checked").exceptAll(batch).isEmpty() and spark.table("checked").count() == rows.count()
