import re

import pytest
from pyspark.sql import functions as F

from tabloom.operators import codebook, lookups
from tabloom.operators.codebook import CodeBook, code_capacity, code_text, csv_line
from tabloom.operators.codec import TextCodec, TextConfig, format_value
from tabloom.operators.constraints import constraint_summary
from tabloom.operators.generation import generate, python_responder, sample_texts
from tabloom.operators.prompts import PromptBuilder, PromptConfig, parse_replies
from tabloom.plans import views
from tabloom.sources import specs as S
from tabloom.sources.tables import CREDIT
from stand_ins import table_responder, table_text_responder


def test_sentences(spark):
    df = spark.createDataFrame([(1, 39, None, 1)], "_row_id int, AGE int, EDUCATION int, Y int")
    codec = TextCodec.fit(df)
    assert codec.encode(df, random_order=False).first().text == "AGE is 39, Y is 1"
    assert df.select(codec.partial_prompt(df)).first()[0].endswith(", EDUCATION is")
    assert codec.condition_text({"AGE": 3, "Y": "b"}) == "AGE is 3, Y is b"
    with pytest.raises(ValueError):
        codec.condition_text({"nope": 1})
    text = 'AGE is 39; EDUCATION is "2", AGE is 40, junk, Z is 1, Y is'
    assert tuple(codec.decode(spark.createDataFrame([(text,)], "text string")).first()) == ("39", "2", None)


def test_round_trip(spark, small):
    rows = views.real(spark, small, "credit")
    codec = TextCodec.fit(rows)
    back = codec.decode(codec.encode(rows), keep=["_row_id"])
    texts = rows.selectExpr(*[f"CAST(`{n}` AS STRING) AS `{n}`" for n in rows.columns])
    assert texts.exceptAll(back.selectExpr("CAST(_row_id AS STRING) AS _row_id", *[f"`{n}`" for n in codec.columns])).isEmpty()
    assert codec.encode(rows.repartition(5)).exceptAll(codec.encode(rows)).isEmpty()


def test_float_precision(spark):
    df = spark.createDataFrame([(2.5,), (1.250,), (10.0,), (float("nan"),)], "x double")
    show = lambda p: [r[0] for r in df.selectExpr(format_value("x", df.schema["x"].dataType, p)).collect()]
    assert show(0) == ["2", "1", "10", None]
    assert show(2) == ["2.5", "1.25", "10", None]
    assert show(None) == ["2.5", "1.25", "10.0", None]
    assert TextConfig().delimiter == ", "


def test_codes(spark, monkeypatch):
    numbers = spark.range(5000)
    codes = [r[0] for r in numbers.selectExpr(code_text("id", 4, 42)).collect()]
    assert len(set(codes)) == 5000 and all(re.fullmatch("[A-Z][A-Z0-9]{3}", x) for x in codes)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", None), (None, 2)], "t string, n int")
    book = CodeBook.fit(df, ["t", "n"])
    assert book.sizes == {"t": 2, "n": 2} and book.table.select("code").distinct().count() == 4
    expected = sorted(map(str, df.selectExpr("t", "CAST(n AS STRING) AS n").collect()))
    assert sorted(map(str, book.decode(book.encode(df)).collect())) == expected
    assert book.known_only(df).count() == 2
    # The same through joins, broadcast and dealt out by key.
    monkeypatch.setattr(codebook, "LITERAL_BOUND", 0)
    joined = CodeBook.fit(df, ["t", "n"])
    assert not joined.literal and joined.encode(df).exceptAll(book.encode(df)).isEmpty()
    monkeypatch.setattr("tabloom.operators.lookups.BROADCAST_ROW_BOUND", 0)
    assert joined.encode(df).exceptAll(book.encode(df)).isEmpty() and joined.known_only(df).count() == 2
    with pytest.raises(ValueError):
        CodeBook.fit(spark.range(code_capacity(1) + 1).selectExpr("id"), ["id"], code_length=1)


def test_generation_resumes(spark, tmp_path):
    """A run that is cut between rounds asks only for the rest when it is started again, and gives the same rows."""
    rows = views.real(spark, "/root/testdata/sf0.001", "credit")
    builder = PromptBuilder.fit(rows, PromptConfig(S.CREDIT_LABEL, n_samples_per_class=2, n_sets=1, generated_rows_per_prompt=10), S.CREDIT_CATEGORICAL)
    answer, asked = table_responder(rows, builder, 4, seed=3), []

    def cut(prompts, rounds):
        if asked:
            raise RuntimeError("cut")
        asked.append(rounds)
        return answer(prompts, rounds)

    def whole(prompts, rounds):
        asked.append(rounds)
        return answer(prompts, rounds)

    ledger = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError):
        generate(builder, rows, cut, 20, ledger=ledger)
    first = list(asked)
    made = generate(builder, rows, whole, 20, ledger=ledger)
    assert len(asked) > 1 and first[0] not in asked[1:] and made.count() == 20
    again = len(asked)
    assert generate(builder, rows, whole, 20, ledger=ledger).exceptAll(made).isEmpty() and len(asked) == again
    assert generate(builder, rows, answer, 20).exceptAll(made).isEmpty()


def test_heavy_keys_are_dealt_out(spark):
    """One key in half of the rows: all its rows find their entry, from many tasks, and light keys take one part."""
    rows = spark.range(20_000).selectExpr("id", "IF(id % 2 = 0, 'hot', IF(id % 7 = 0, NULL, CAST(id % 3000 AS STRING))) AS k")
    heavy = lookups.heavy_keys(rows, {"k": ["k"], "none": ["id"]})
    assert len(heavy["k"]) == 2 and max(heavy["k"].values()) >= 500 and not heavy["none"]
    table = rows.filter("k IS NOT NULL").select("k").distinct().withColumn("v", F.concat(F.lit("v"), "k"))
    spread = F.col("id")
    for how in ("inner", "left"):
        joined = lookups.lookup_join(rows, table, ["k"], spread, 10, how, broadcast_rows=0)
        assert joined.exceptAll(rows.join(table, "k", how).select(*joined.columns)).isEmpty()
        assert joined.count() == rows.count() - (rows.filter("k IS NULL").count() if how == "inner" else 0)


def test_csv_line(spark):
    df = spark.createDataFrame([("x,y", None, 'q"r')], "a string, b string, c string")
    assert df.selectExpr(csv_line(df.schema, df.columns)).first()[0] == '"x,y",,"q""r"'
    assert df.selectExpr(csv_line(df.schema, ["b"])).first()[0] == '""'


def test_replies(spark):
    reply = 'Here are rows:\r\n```\nY,A\n1,2\n1,2,3\n 0 , 5 \nhere,in\n```\nsure,1\n"a","b""c"\n"x,y"\n\n9,"open'
    rows = parse_replies(spark.createDataFrame([(4, reply), (5, "")], "round int, reply string"), ["Y", "A"]).collect()
    assert [(r.Y, r.A) for r in rows] == [("1", "2"), ("0", "5"), ("here", "in"), ("a", 'b"c'), ("9", "open")]


def test_prompts_and_generation(spark, small):
    rows = views.real(spark, small, "credit")
    rules = CREDIT.constraints()
    config = PromptConfig(S.CREDIT_LABEL, n_samples_per_class=2, n_sets=2, generated_rows_per_prompt=10, seed=2)
    builder = PromptBuilder.fit(rows, config, S.CREDIT_CATEGORICAL, {"AGE": "years"})
    prompt = builder.prompts(rows).first().prompt
    lines = prompt.split("\n")
    assert lines[:2] == ["Column descriptions:", "AGE: years"] and "Set B:" in lines
    assert lines[-2].startswith("Generate 10 new rows") and lines[-1] == ",".join(builder.columns)
    assert sum(line.count(",") == 23 for line in lines) == 2 * 4 + 3
    made = generate(builder, rows, table_responder(rows, builder, 10, seed=3), 25, rules)
    assert made.columns == ["round", "line_no", *builder.columns] and made.count() == 25
    assert constraint_summary(made, rules).first().cvr == 0.0
    assert generate(builder, rows, table_responder(rows, builder, 10), 25, max_rounds=1).count() == 10
    with pytest.raises(ValueError):
        PromptBuilder.fit(rows, PromptConfig("absent"), [])


def test_python_responder_retries(spark):
    def make():
        calls = []

        def ask(prompt):
            calls.append(prompt)
            if len(calls) == 1:
                raise OSError("busy")
            return prompt.upper()

        return ask

    prompts = spark.createDataFrame([(0, "a"), (1, "b")], "round int, prompt string").coalesce(1)
    answered = python_responder(make, partitions=1, pause=0.0)(prompts, (0, 2))
    assert sorted(r.reply for r in answered.collect()) == ["A", "B"]


def test_conditional_texts(spark, small):
    rows = views.real(spark, small, "adult")
    codec = TextCodec.fit(rows)
    made = sample_texts(codec, rows, table_text_responder(codec, rows, "income"), 50, "income")
    shares = {r["income"]: r["count"] for r in made.groupBy("income").count().collect()}
    sizes = {r["income"]: r["count"] for r in rows.groupBy("income").count().collect()}
    assert sum(shares.values()) == 50
    assert shares["<=50K"] == round(50 * sizes["<=50K"] / sum(sizes.values()))


def test_plain_lines_are_not_taken_apart_twice(spark):
    """Quotes and blanks are looked for in whole lines; cells read the same as one by one."""
    text = 'a,b\n1,2\n 3 ,\t4\n"5","6 ""x"""\n"7,8\n9,"0\n" , "\n,\n5"x,"y"z'
    got = parse_replies(spark.createDataFrame([(1, text)], "round long, reply string"), ["a", "b"])
    rows = [(r.line_no, r.a, r.b) for r in got.orderBy("line_no").collect()]
    assert rows == [(1, "1", "2"), (2, "3", "4"), (3, "5", '6 "x"'), (5, "9", "0"), (7, "", ""), (8, '5"x', "yz")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" in plan and plan.count("instr(_line") >= plan.count("exists(")
