"""The driver tables seen as the three known tables, with injected faults.

Each field is one SQL expression that Spark and DuckDB read the same way. The
faults give the checks something to find: the clean rows (those that violate no
rule) play the real table, the others play the raw synthetic one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import named
from ..operators.constraints import Constraint, in_numeric_set, numeric_at_least, numeric_between, only_invalid, reject_invalid, text_domain
from ..operators.sampling import ROW_ID
from ..operators.schema import coerce_to_schema
from ..sources.specs import TableSpec
from ..sources.tables import ADULT, CREDIT, HELOC

#: Base columns: order key k, customer key u, whole price b, nation n.
CREDIT_BASE = {
    "k": "o_orderkey",
    "u": "o_custkey",
    "b": "CAST(floor(o_totalprice) AS BIGINT)",
    "n": "CAST(c_nationkey AS BIGINT)",
}
CREDIT_FIELDS = {
    ROW_ID: "k",
    "LIMIT_BAL": "CASE WHEN k%65=0 THEN NULL ELSE CAST(10000*(1+k%50) AS STRING) END",
    "SEX": "CASE WHEN k%40=0 THEN '9' ELSE CAST(1+u%2 AS STRING) END",
    "EDUCATION": "CASE WHEN k%45=0 THEN '2.5' ELSE CAST(n%7 AS STRING) END",
    "MARRIAGE": "CASE WHEN k%75=0 THEN '1d' ELSE CAST(k%4 AS STRING) END",
    "AGE": "CASE WHEN k%35=0 THEN '-3' WHEN k%55=0 THEN 'abc' WHEN k%85=0 THEN 'nan' ELSE CAST(18+u%63 AS STRING) END",
    "PAY_0": "k%12-2",
    "PAY_2": "(k+2*u)%12-2",
    "PAY_3": "(k+3*u)%12-2",
    "PAY_4": "(k+4*u)%12-2",
    "PAY_5": "(k+5*u)%12-2",
    "PAY_6": "(k+6*u)%12-2",
    **{f"BILL_AMT{i}": f"b-{i}000" for i in range(1, 7)},
    "PAY_AMT1": "CASE WHEN k%25=0 THEN '-10' ELSE CAST(u%5000 AS STRING) END",
    **{f"PAY_AMT{i}": f"(u*{i})%5000" for i in range(2, 7)},
    CREDIT.label: "CASE WHEN k%95=0 THEN '2' WHEN k%12+u%7>9 THEN '1' ELSE '0' END",
}
CREDIT_TEXT = ("LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", "PAY_AMT1", CREDIT.label)

ADULT_BASE = {
    "k": "o_orderkey",
    "u": "o_custkey",
    "n": "CAST(c_nationkey AS BIGINT)",
    "seg": "c_mktsegment",
    "pr": "o_orderpriority",
    "st": "o_orderstatus",
}
ADULT_FIELDS = {
    ROW_ID: "k",
    "age": "16+u%85",
    "workclass": "CASE WHEN k%115=0 THEN NULL ELSE seg END",
    "fnlwgt": "10000+k",
    "education": (
        "CASE k%16 WHEN 0 THEN 'Preschool' WHEN 1 THEN '1st-4th' WHEN 2 THEN '5th-6th' WHEN 3 THEN '7th-8th' "
        "WHEN 4 THEN '9th' WHEN 5 THEN '10th' WHEN 6 THEN '11th' WHEN 7 THEN '12th' WHEN 8 THEN 'HS-grad' "
        "WHEN 9 THEN 'Some-college' WHEN 10 THEN 'Assoc-voc' WHEN 11 THEN 'Assoc-acdm' WHEN 12 THEN 'Bachelors' "
        "WHEN 13 THEN 'Masters' WHEN 14 THEN 'Prof-school' "
        "ELSE CASE WHEN k%95=0 THEN 'Unknown' ELSE 'Doctorate' END END"
    ),
    "education-num": "CASE WHEN k%35=0 THEN k%16+2 ELSE k%16+1 END",
    "marital-status": "pr",
    "occupation": "st",
    "relationship": "concat('R',CAST(n%6 AS STRING))",
    "race": "concat('N',CAST(n%5 AS STRING))",
    "sex": "CASE WHEN u%2=0 THEN 'Male' ELSE 'Female' END",
    "capital-gain": "CASE WHEN k%85=0 THEN -1 ELSE (k*7)%3000 END",
    "capital-loss": "(u*3)%500",
    "hours-per-week": "CASE WHEN k%45=0 THEN '120' ELSE CAST(1+k%99 AS STRING) END",
    "native-country": "concat('C',CAST(n AS STRING))",
    "income": "CASE WHEN k%55=0 THEN 'maybe' WHEN k%25=0 THEN ' >50K.' WHEN k%16>9 THEN '>50K' ELSE '<=50K' END",
}
ADULT_TEXT = ("hours-per-week",)

HELOC_BASE = {"k": "o_orderkey", "u": "o_custkey", "t": "3+o_orderkey%77"}
HELOC_FIELDS = {
    ROW_ID: "k",
    "RiskPerformance": (
        "CASE WHEN k%35=0 THEN 'Maybe' WHEN k%55=0 THEN 'no' WHEN k%65=0 THEN ' good.' "
        "WHEN k%41+u%23>31 THEN 'Bad' ELSE 'Good' END"
    ),
    "ExternalRiskEstimate": "CASE WHEN k%50=0 THEN -9 ELSE 20+k%81 END",
    "MSinceOldestTradeOpen": "1+(k*3)%519",
    "MSinceMostRecentTradeOpen": "u%80",
    "AverageMInFile": "4+(k+u)%246",
    "NumSatisfactoryTrades": "least(k%60,t)",
    "NumTrades60Ever2DerogPubRec": "CASE WHEN k%40=0 THEN 2 ELSE least(u%4,t) END",
    "NumTrades90Ever2DerogPubRec": "CASE WHEN k%40=0 THEN 10 ELSE least(u%3,least(u%4,t)) END",
    "PercentTradesNeverDelq": (
        "CASE WHEN k%45=0 THEN '130' WHEN k%115=0 THEN '50.5' ELSE CAST((k*7)%101 AS STRING) END"
    ),
    "MSinceMostRecentDelq": "CASE WHEN u%3=0 THEN -7 ELSE u%85 END",
    "MaxDelq2PublicRecLast12M": "k%10",
    "MaxDelqEver": "u%10",
    "NumTotalTrades": "CASE WHEN k%85=0 THEN 800 WHEN k%50=0 THEN -9 WHEN k%40=0 THEN 3 ELSE t END",
    "NumTradesOpeninLast12M": "least(u%6,t)",
    "PercentInstallTrades": "(u*3)%101",
    "MSinceMostRecentInqexcl7days": "CASE WHEN k%4=0 THEN -7 ELSE k%25 END",
    "NumInqLast6M": "u%9",
    "NumInqLast6Mexcl7days": "u%8",
    "NetFractionRevolvingBurden": "(k+u)%201",
    "NetFractionInstallBurden": "CASE WHEN u%5=0 THEN -8 ELSE k%201 END",
    "NumRevolvingTradesWBalance": "least(u%12,t)",
    "NumInstallTradesWBalance": "least(k%7,t)",
    "NumBank2NatlTradesWHighUtilization": "least(u%5,least(u%12,t))",
    "PercentTradesWBalance": "(k*5)%101",
}
HELOC_TEXT = ("RiskPerformance", "PercentTradesNeverDelq")

VIEWS = {
    "credit": (CREDIT, CREDIT_BASE, CREDIT_FIELDS, CREDIT_TEXT),
    "adult": (ADULT, ADULT_BASE, ADULT_FIELDS, ADULT_TEXT),
    "heloc": (HELOC, HELOC_BASE, HELOC_FIELDS, HELOC_TEXT),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole view, faults included."""
    _, base, fields, _ = VIEWS[name]
    rows = table(spark, sf_dir, "orders")
    if any("c_" in e for e in base.values()):
        rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.selectExpr(*[named(e, n) for n, e in base.items()])
    return rows.selectExpr(*[named(e, n) for n, e in fields.items()])


def spec(name: str) -> TableSpec:
    return VIEWS[name][0]


def typed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole view in the schema of its table."""
    return coerce_to_schema(view(spark, sf_dir, name), spec(name).schema, [ROW_ID])


def real(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows without any violation, typed: the real table."""
    clean = reject_invalid(view(spark, sf_dir, name), spec(name).constraints())
    return coerce_to_schema(clean, spec(name).schema, [ROW_ID])


def raw_synthetic(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows with a violation, typed: the raw synthetic table."""
    faulty = only_invalid(view(spark, sf_dir, name), spec(name).constraints())
    return coerce_to_schema(faulty, spec(name).schema, [ROW_ID])


def repaired(df: DataFrame, name: str) -> DataFrame:
    """Repair, then coerce again, as a run does."""
    return coerce_to_schema(spec(name).repaired(df), spec(name).schema, [ROW_ID])


def lineitem_rules() -> list[Constraint]:
    """Rules over the largest table, strict enough for some of them to break."""
    return [
        numeric_between("l_quantity", 1, 45),
        numeric_at_least("l_extendedprice", 2000),
        numeric_between("l_discount", 0, 0.08),
        numeric_between("l_tax", 0, 0.07),
        in_numeric_set("l_linenumber", [1, 2, 3, 4, 5, 6]),
        text_domain("l_returnflag", ["A", "N"], "A or N"),
        text_domain("l_linestatus", ["F", "O"], "F or O"),
    ]
