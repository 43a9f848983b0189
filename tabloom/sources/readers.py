"""CSV readers for the known tables, and normalising of their header and label variants.

Cells of known tables are read as text and coerced explicitly, so no pass is
spent on inference and a bad cell never fails the job. Other files are typed by
one pass over their cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, label_text, literals, named, pick, quoted, replaced, require_columns, strip
from ..functions.numeric import parse_number, round_to_long
from ..operators.repairs import relabel
from ..operators.schema import clean_names, coerce_to_schema, drop_present, rename_known
from . import specs as S
from .tables import ADULT, CREDIT, HELOC, TABLES

_QUOTING = {"quote": '"', "escape": '"'}


def _missing(cell: str, *extra: str) -> str:
    return f"CASE WHEN {cell} NOT IN ({literals((*S.NA_TOKENS, *extra))}) THEN {cell} END"


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, typed: bool = True) -> DataFrame:
    """A CSV file (or directory) with a header; columns are typed by their cells unless a schema is given.

    Columns of whole numbers become BIGINT, of other numbers (or without any
    cell) DOUBLE; the rest, and all columns if not ``typed``, are text.
    """
    reader = spark.read.options(header=True, **_QUOTING)
    if schema is not None:
        return reader.schema(schema).csv(path)
    raw = reader.csv(path)
    cells = raw.selectExpr(*[named(_missing(quoted(n)), n) for n in raw.columns])
    return with_number_types(cells) if typed else cells


def with_number_types(cells: DataFrame) -> DataFrame:
    """Text columns whose every cell is a number as numbers, found by one aggregation."""
    if not cells.columns:
        return cells
    readings = {n: (f"try_cast({quoted(n)} AS BIGINT)", parse_number(quoted(n))) for n in cells.columns}
    tallies = [
        f"count({x}) AS {tag}{i}" for i, (n, (whole, number)) in enumerate(readings.items()) for tag, x in (("n", quoted(n)), ("w", whole), ("d", number))
    ]
    counts = cells.agg(*map(F.expr, tallies)).first()
    formulas = {}
    for i, (n, (whole, number)) in enumerate(readings.items()):
        if 0 < counts[f"n{i}"] == counts[f"w{i}"]:
            formulas[n] = whole
        elif counts[f"n{i}"] == counts[f"d{i}"]:
            formulas[n] = number
    return replaced(cells, formulas)


def load_headerless(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
    raw = spark.read.options(header=False, **_QUOTING).schema(schema).csv(path)
    return raw.selectExpr(*[named(_missing(quoted(n)), n) for n in columns])


def load_default_credit(spark: SparkSession, path: str) -> DataFrame:
    return normalize_default_credit(load_csv(spark, path, typed=False))


def normalize_default_credit(raw: DataFrame) -> DataFrame:
    """Any known header spelling to the 24 canonical columns, all BIGINT."""
    df = rename_known(clean_names(raw), S.CREDIT_ALIASES)
    df = df.toDF(*[name.replace(" ", ".") for name in df.columns])
    df = drop_present(df, [name.replace(" ", ".") for name in S.INDEX_COLUMNS] + list(S.INDEX_COLUMNS))
    require_columns(df, CREDIT.columns, "Default Credit data")
    return coerce_to_schema(df, CREDIT.schema)


def load_adult(spark: SparkSession, path: str) -> DataFrame:
    """Headerless census file: a bar starts a comment, ``?`` is missing.

    Missing text becomes the category "nan"; rows with a missing number are dropped.
    """
    lines = spark.read.text(path).selectExpr(r"regexp_replace(value, r'\|.*$', '') AS line")
    cells = ", ".join(f"v{i} STRING" for i in range(len(S.ADULT_COLUMNS)))
    parsed = lines.filter(f"{strip('line')} != ''").select(F.from_csv("line", cells, _QUOTING).alias("cell"))
    # Blanks in front of a cell do not count, also not for the missing mark.
    bare = parsed.selectExpr(*[named(rf"regexp_replace(cell.v{i}, r'^\s+', '')", n) for i, n in enumerate(S.ADULT_COLUMNS)])
    return normalize_adult(bare.selectExpr(*[named(_missing(quoted(n), "?"), n) for n in bare.columns]))


def normalize_adult(raw: DataFrame) -> DataFrame:
    require_columns(raw, ADULT.columns, "Adult data")
    whole = set(S.ADULT_INTEGERS)
    formulas = {
        n: round_to_long(parse_number(f"CAST({quoted(n)} AS STRING)"))
        if n in whole
        else f"coalesce({strip(quoted(n))}, 'nan')"
        for n in ADULT.columns
    }
    formulas[ADULT.label] = f"trim(TRAILING '.' FROM {formulas[ADULT.label]})"
    # A repeated header line has no numbers, so dropping incomplete rows drops it too.
    return replaced(raw, formulas).select(*pick(ADULT.columns)).na.drop("any")


def load_heloc(spark: SparkSession, path: str) -> DataFrame:
    """Canonical header, alternative header, or no header with exactly 24 columns."""
    first = spark.read.text(path).first()
    header = [name.strip().strip('"') for name in first["value"].split(",")] if first else []
    known = S.HELOC_LABEL in header or any(name in S.HELOC_ALIASES for name in header)
    if not known and len(header) == len(S.HELOC_COLUMNS):
        return normalize_heloc(load_headerless(spark, path, S.HELOC_COLUMNS))
    return normalize_heloc(load_csv(spark, path, typed=False))


def normalize_heloc(raw: DataFrame) -> DataFrame:
    """Canonical columns, labels Good/Bad only, numbers rounded half-even, complete rows only."""
    df = drop_present(rename_known(clean_names(raw), S.HELOC_ALIASES), S.INDEX_COLUMNS)
    require_columns(df, HELOC.columns, "HELOC data")
    label = relabel(label_text(quoted(HELOC.label)), S.HELOC_LOAD_LABELS, None)
    known = replaced(df, {HELOC.label: label}).filter(c(HELOC.label).isin(*S.HELOC_LABELS))
    return coerce_to_schema(known, HELOC.schema).na.drop("any")


_LOADERS = {CREDIT.name: load_default_credit, ADULT.name: load_adult, HELOC.name: load_heloc}


def load_table(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, S.TableSpec]:
    """A known table by name, with its spec (label, categoricals, rules, repair)."""
    if name not in TABLES:
        raise ValueError(f"Unknown table {name!r}; known: {sorted(TABLES)}")
    return _LOADERS[name](spark, path), TABLES[name]


def combine(train: DataFrame, test: DataFrame) -> DataFrame:
    """All rows of both tables."""
    return train.unionByName(test)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    return df


def require_exact_columns(df: DataFrame, spec: S.TableSpec) -> DataFrame:
    """Gate: at least one row and exactly the columns of the spec, in order."""
    if tuple(df.columns) != spec.columns:
        raise ValueError(f"Unexpected {spec.name} columns: {df.columns}")
    return require_rows(df, spec.name)
