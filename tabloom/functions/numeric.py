"""Lenient number parsing and rounding with the tolerance rules the checks need (as SQL text)."""

from __future__ import annotations

from pyspark.sql import types as T

from .columns import is_integral, is_text, quoted

#: What counts as a number in text. Casting alone would also accept Java forms such as "1d".
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"

#: Closeness tolerances: absolute and relative to the second operand.
ABS_TOL = "1e-8D"
REL_TOL = "1e-5D"


def parse_number(x: str) -> str:
    """Text to double; anything that is not a plain number becomes NULL."""
    return f"(CASE WHEN {x} RLIKE r'{NUMBER_PATTERN}' THEN try_cast({x} AS DOUBLE) END)"


def num(schema: T.StructType, name: str) -> str:
    """Numeric reading of a column: BIGINT for integral types, DOUBLE otherwise, never NaN.

    Integral columns stay integral so that range predicates keep their pushdown.
    """
    dtype, x = schema[name].dataType, quoted(name)
    if isinstance(dtype, T.LongType):
        return x
    if is_integral(dtype):
        return f"CAST({x} AS BIGINT)"
    if is_text(dtype):
        return parse_number(x)
    if isinstance(dtype, T.BooleanType):
        return f"CAST(CAST({x} AS INT) AS BIGINT)"
    if isinstance(dtype, T.NumericType):
        return f"(CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN CAST({x} AS DOUBLE) END)"
    return "CAST(NULL AS DOUBLE)"


def isclose(a: str, b: str) -> str:
    """Closeness relative to ``b``; equal infinities are close."""
    return f"({a} = {b} OR abs({a} - {b}) <= {ABS_TOL} + {REL_TOL} * abs({b}))"


def integerish(schema: T.StructType, name: str) -> str:
    """True where the cell holds a number that is an integer within tolerance."""
    value = num(schema, name)
    if is_integral(schema[name].dataType):
        return f"({value} IS NOT NULL)"
    return f"coalesce({isclose(value, f'rint({value})')}, false)"


def round_to_long(x: str) -> str:
    """Round half-even to BIGINT; values beyond BIGINT become NULL."""
    return f"try_cast(rint({x}) AS BIGINT)"
