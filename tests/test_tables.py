import pytest
from pyspark.sql import functions as F

from tabloom.operators.constraints import numeric_at_least, reject_invalid
from tabloom.operators.ranking import _ranged_prefix_sums, dense_index
from tabloom.operators.sampling import (
    ROW_ID,
    balanced_draws,
    bootstrap,
    capped_sample,
    class_quota,
    split_train_test,
    with_row_id,
)
from tabloom.operators.schema import coerce_to_schema, infer_categorical
from tabloom.plans import views
from tabloom.sources import readers, sinks
from tabloom.sources import specs as S
from tabloom.sources.tables import ADULT, HELOC


def ids(df, name=ROW_ID):
    return sorted(r[0] for r in df.select(name).collect())


def test_tables_by_name(spark, small, tmp_path):
    rows = views.view(spark, small, "heloc").filter("RiskPerformance IN ('Good', 'Bad')").limit(10)
    rows.select(*S.HELOC_COLUMNS).toPandas().astype(str).to_csv(tmp_path / "heloc.csv", index=False)
    loaded, spec = readers.load_table(spark, "heloc", str(tmp_path / "heloc.csv"))
    assert spec is HELOC and loaded.columns == list(S.HELOC_COLUMNS)
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, readers.load_heloc(spark, str(tmp_path)).collect()))
    with pytest.raises(ValueError, match="nope"):
        readers.load_table(spark, "nope", "")


def test_spec_with_doubles(spark):
    own = S.TableSpec("own", ("k", "n", "x"), "k", ("k",), ("n",), lambda key: [], lambda df, key: df, doubles=("x",))
    assert [f.dataType.simpleString() for f in own.schema] == ["string", "bigint", "double"]
    row = coerce_to_schema(spark.createDataFrame([("a", "2.0", "2.5"), ("b", "x", None)], "k string, n string, x string"), own.schema)
    assert sorted(map(tuple, row.collect())) == [("a", 2, 2.5), ("b", None, None)]


def test_heloc_layouts(spark, small, tmp_path):
    rows = views.view(spark, small, "heloc").filter("RiskPerformance IN ('Good', 'Bad')").limit(10)
    table = rows.select(*S.HELOC_COLUMNS).toPandas().astype(str)
    table.to_csv(tmp_path / "plain.csv", index=False)
    table.to_csv(tmp_path / "bare.csv", index=False, header=False)
    other = {known: alias for alias, known in S.HELOC_ALIASES.items()}
    yes_no = table.assign(RiskPerformance=table.RiskPerformance.map({"Bad": "yes", "Good": "no"}))
    yes_no.rename(columns=other).to_csv(tmp_path / "alias.csv", index=False)
    loaded = [readers.load_heloc(spark, str(tmp_path / f"{n}.csv")) for n in ("plain", "bare", "alias")]
    assert all(tuple(df.columns) == S.HELOC_COLUMNS for df in loaded)
    expected = sorted(map(str, loaded[0].collect()))
    assert len(expected) == 10 and all(sorted(map(str, df.collect())) == expected for df in loaded)
    readers.require_exact_columns(loaded[0], HELOC)
    with pytest.raises(ValueError):
        readers.require_exact_columns(loaded[0].limit(0), HELOC)


def test_adult_file(spark, tmp_path):
    lines = [
        "age,workclass,fnlwgt,education,education-num,marital-status,occupation,relationship,race,sex,"
        "capital-gain,capital-loss,hours-per-week,native-country,income",
        "39, State-gov, 77516, Bachelors, 13, Never-married, ?, Husband, White, Male, 2174, 0, 40, Cuba, <=50K.",
        "|1x3 Cross validator",
        "50, Private, ?, Masters, 14, Divorced, Sales, Wife, Black, Female, 0, 0, 13, Peru, >50K",
        "28, Private, 1, Masters, 14, Divorced, Sales, Wife, Black, Female, 0, 0, 13, Peru, >50K | note",
    ]
    (tmp_path / "adult.data").write_text("\n".join(lines))
    rows = readers.load_adult(spark, str(tmp_path / "adult.data")).orderBy("age").collect()
    assert [(r["age"], r["occupation"], r["income"]) for r in rows] == [(28, "Sales", ">50K"), (39, "nan", "<=50K")]


def test_credit_headers_and_missing(spark, small):
    raw = views.view(spark, small, "credit").limit(5)
    spaced = raw.withColumnRenamed(S.CREDIT_LABEL, " default payment next month ").withColumnRenamed(ROW_ID, "Unnamed: 0")
    assert tuple(readers.normalize_default_credit(spaced).columns) == S.CREDIT_COLUMNS
    with pytest.raises(ValueError, match="AGE"):
        readers.normalize_default_credit(raw.drop("AGE"))


def test_coercion_and_inference(spark):
    df = spark.createDataFrame([("2.5", "x", 1), ("3.5", None, 2), ("bad", "y", 3)], "n string, t string, extra int")
    out = coerce_to_schema(df, spark.createDataFrame([], "t string, n long, absent long"))
    assert [tuple(r) for r in out.collect()] == [("x", 2), (None, 4), ("y", None)]
    wide = spark.range(30).selectExpr("id", "id % 20 AS twenty", "id % 21 AS more", "id > 3 AS flag", "'a' AS text", "0.5D AS d")
    assert infer_categorical(wide) == ["twenty", "flag", "text"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([('a"b,c', None, 1)], "`x.y` string, z string, n int")
    sinks.write_csv(df, str(tmp_path / "csv"))
    parts = {p.read_text() for p in (tmp_path / "csv").glob("part-*")}  # an empty partition may leave a header
    assert parts - {"x.y,z,n\n"} == {'x.y,z,n\n"a""b,c",,1\n'}
    nested = df.select(F.struct("n", F.struct("z").alias("deep")).alias("r"))
    assert sinks.flatten(nested).columns == ["r.n", "r.deep.z"]
    sinks.write_text(df, "x.y", str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == 'a"b,c'
    sinks.write_json(sinks.manifest(df, "d", "s", note="x"), str(tmp_path / "json"))
    found = spark.read.json(str(tmp_path / "json")).first()
    assert (found.dataset, found.n_rows, found.columns, found.note) == ("d", 1, ["x.y", "z", "n"], "x")


def test_split_is_exact_and_partition_proof(spark):
    df = spark.range(12).withColumnRenamed("id", ROW_ID)
    train, test = split_train_test(df, 0.2)
    assert len(ids(train)) == 10 and len(ids(test)) == 2 and ids(train.union(test)) == list(range(12))
    assert ids(split_train_test(df.repartition(7), 0.2)[1]) == ids(test)
    assert split_train_test(df, 0.0)[1].count() == 0 and split_train_test(df, 1.0)[0].count() == 0
    assert len(ids(capped_sample(df, 5))) == 5 and len(ids(capped_sample(df, 50))) == 12


def test_draws(spark):
    df = spark.range(40).selectExpr("id AS _row_id", "CASE WHEN id < 2 THEN 'rare' ELSE 'often' END AS y")
    rows = balanced_draws(df, "y", per_class=5, sets=2, rounds=(3, 5)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["round"], r["set"], r["class"]), []).append(r[ROW_ID])
    assert len(groups) == 8 and all(len(g) == 5 for g in groups.values())
    assert all(len(set(g)) == 5 for (_, _, k), g in groups.items() if k == "often")
    assert all(set(g) <= {0, 1} for (_, _, k), g in groups.items() if k == "rare")
    assert ids(dense_index(df, ROW_ID, 1, by="y").filter("y = 'often'"), "_index") == list(range(38))
    drawn = bootstrap(df, 100)
    assert drawn.count() == 100 and set(ids(drawn)) <= set(range(40))


def test_draws_are_independent(spark):
    """Every pair of rows meets as often as in uniform draws, neighbours of one order no more than others."""
    df = spark.range(10).selectExpr("id AS _row_id", "'c' AS y")
    rows = balanced_draws(df, "y", per_class=3, sets=1, rounds=(0, 3000)).collect()
    drawn = {}
    for r in rows:
        drawn.setdefault(r["round"], set()).add(r[ROW_ID])
    assert len(drawn) == 3000 and all(len(x) == 3 for x in drawn.values())
    pairs = [sum(a in x and b in x for x in drawn.values()) for a in range(10) for b in range(a)]
    # 3000 draws of 3 of 10: each of the 45 pairs in 200 of them, with a deviation of 13.7.
    assert max(abs(n - 200) for n in pairs) < 60 and sum((n - 200) ** 2 / 200 for n in pairs) < 80
    singles = [sum(a in x for x in drawn.values()) for a in range(10)]
    assert max(abs(n - 900) for n in singles) < 110


def test_quota(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert [tuple(r) for r in class_quota(df, "k", 10).orderBy("class").collect()] == [("a", 3), ("b", 3), ("c", 4)]


def test_row_ids_are_fixed(spark):
    df = with_row_id(spark.range(20).repartition(3))
    assert len(set(ids(df))) == 20 and sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect()))


def test_ranged_prefix_sums_match_a_plain_window(spark):
    df = spark.range(3000).selectExpr("nullif(id % 3, 2) AS g", "CAST((id * 7919) % 3001 AS DOUBLE) AS v", "id % 5 AS n")
    got = {(r.g, r.v): r.cum_n for r in _ranged_prefix_sums(df, "v", ["n"], "g", 16).collect()}
    expected = df.selectExpr("g", "v", "sum(n) OVER (PARTITION BY g ORDER BY v) AS cum").collect()
    assert len(got) == 3000 and all(got[(r.g, r.v)] == r.cum for r in expected)
    assert ADULT.schema["age"].dataType.simpleString() == "bigint"


def test_csv_types(spark, tmp_path):
    text = "whole,number,text,none,mixed\n1,1.5,a,,1\n NA,2,b,NA,x\n3,nan,1d,,2\n-4,1e3,,null,3\n"
    (tmp_path / "t.csv").write_text(text.replace(" NA", "NA"))
    df = readers.load_csv(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string", "double", "string"]
    assert [r.whole for r in df.collect()] == [1, None, 3, -4] and [r.number for r in df.collect()] == [1.5, 2.0, None, 1000.0]
    assert {f.dataType.simpleString() for f in readers.load_csv(spark, str(tmp_path / "t.csv"), typed=False).schema.fields} == {"string"}


def test_bounds_reach_the_scan(spark, small):
    kept = reject_invalid(views.table(spark, small, "lineitem"), views.lineitem_rules())
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(l_extendedprice" in pushed and "LessThanOrEqual(l_quantity" in pushed
    odd = spark.createDataFrame([(float("nan"), 1), (5.0, 2), (None, 3), (1.0, 4)], "x double, i int")
    assert [r.i for r in reject_invalid(odd, [numeric_at_least("x", 2)]).collect()] == [2]
