"""Column naming and text helpers shared by every operator.

Per-column formulas are written as Spark SQL text and handed over in one
``selectExpr``: tables here have dozens of columns, and building each formula
from column objects would cost more time on the driver than small jobs take.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks that count as surrounding space in cells, names and labels.
WHITESPACE = " \t\n\r\f\v"


def quoted(name: str) -> str:
    """Back-ticked column name, safe for dots, hyphens and back-ticks."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Reference a column whatever characters its name holds."""
    return F.col(quoted(name))


def literal(value: object) -> str:
    """A Python value as SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    for char, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        text = text.replace(char, escaped)
    return f"'{text}'"


def literals(values: Iterable[object]) -> str:
    return ", ".join(literal(v) for v in values)


_BLANKS = f"decode(X'{WHITESPACE.encode().hex()}', 'UTF-8')"


def named(expression: str, name: str) -> str:
    return f"{expression} AS {quoted(name)}"


def pick(names: Iterable[str]) -> list[str]:
    return [quoted(n) for n in names]


def replaced(df: DataFrame, formulas: Mapping[str, str]) -> DataFrame:
    """``df`` with some columns replaced, or new ones appended, in one projection."""
    old = [named(formulas[n], n) if n in formulas else quoted(n) for n in df.columns]
    return df.selectExpr(*old, *[named(e, n) for n, e in formulas.items() if n not in set(df.columns)])


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of ``left`` that ``right`` has too, in the order of ``left``."""
    other = set(right.columns)
    return [name for name in left.columns if name in other]


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [name for name in names if name not in set(df.columns)]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def strip(x: str) -> str:
    return f"btrim({x}, {_BLANKS})"


def label_text(x: str) -> str:
    """Cell as a label: text, without surrounding blanks or trailing dots."""
    return f"trim(TRAILING '.' FROM {strip(f'CAST({x} AS STRING)')})"


def key_text(schema: T.StructType, name: str) -> str:
    """Typed value as category text; NaN counts as missing, missing stays NULL."""
    x = quoted(name)
    if isinstance(schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"CAST(CASE WHEN NOT isnan({x}) THEN {x} END AS STRING)"
    return x if is_text(schema[name].dataType) else f"CAST({x} AS STRING)"
