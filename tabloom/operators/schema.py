"""Schema-level steps: coercion to a reference, renaming, categorical inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_integral, is_numeric, is_text, named, pick, quoted
from ..functions.numeric import num, round_to_long

#: Width of the hashed presence bitmap used to rule out high-cardinality columns.
_BITMAP_BITS = 32768


def coerce_to_schema(df: DataFrame, reference: T.StructType | DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Reference columns that ``df`` has, in reference order, numeric ones parsed.

    Integral columns are rounded half-even to BIGINT, other numerics become
    DOUBLE, the rest is untouched. ``keep`` names extra columns (such as a row
    id) carried along in front.
    """
    schema = reference.schema if isinstance(reference, DataFrame) else reference
    have, present = df.schema, set(df.columns)
    out = pick(keep)
    for fld in schema.fields:
        if fld.name not in present or fld.name in keep:
            continue
        if is_integral(fld.dataType):
            value = num(have, fld.name)
            same = is_integral(have[fld.name].dataType)
            out.append(named(value if same else round_to_long(value), fld.name))
        elif is_numeric(fld.dataType):
            out.append(named(f"CAST({num(have, fld.name)} AS DOUBLE)", fld.name))
        else:
            out.append(quoted(fld.name))
    return df.selectExpr(*out)


def clean_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[name.strip() for name in df.columns])


def rename_known(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Apply an alias map; names it does not know pass through."""
    return df.toDF(*[aliases.get(name, name) for name in df.columns])


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop those of ``names`` that exist."""
    gone = set(names)
    return df.selectExpr(*pick(name for name in df.columns if name not in gone))


def presence_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a lower bound of each column's distinct non-null values.

    Every value sets one bit of a 4 KiB bitmap, so the aggregation state is the
    same size whatever the data; the count of set bits can only be too low.
    """
    spot = "CASE WHEN {x} IS NOT NULL THEN pmod(xxhash64({x}), {n}) END"
    bits = [f"bitmap_count(bitmap_construct_agg({spot.format(x=quoted(n), n=_BITMAP_BITS)}))" for n in columns]
    return df.agg(*[F.expr(named(b, n)) for b, n in zip(bits, columns)])


def columns_with_few_values(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Exact distinct counts of those ``columns`` that hold at most ``limit`` non-null values.

    A first pass rules out columns by the bitmap bound; only the remaining few
    are counted exactly, and there map-side grouping leaves next to nothing to
    shuffle.
    """
    if not columns:
        return {}
    bound = presence_counts(df, columns).first()
    small = [n for n in columns if bound[n] <= limit]
    if not small:
        return {}
    values = df.selectExpr(*[f"CAST({quoted(n)} AS STRING) AS v{i}" for i, n in enumerate(small)]).unpivot(
        [], [f"v{i}" for i in range(len(small))], "col", "value"
    )
    counted = values.filter("value IS NOT NULL").distinct().groupBy("col").count().collect()
    found = {small[int(row["col"][1:])]: row["count"] for row in counted}
    return {n: found.get(n, 0) for n in small if found.get(n, 0) <= limit}


def infer_categorical(df: DataFrame, max_unique_for_int: int = 20) -> list[str]:
    """Text and boolean columns, and integral ones with few distinct values, in table order."""
    integral = [f.name for f in df.schema.fields if is_integral(f.dataType)]
    few = columns_with_few_values(df, integral, max_unique_for_int)
    return [
        f.name
        for f in df.schema.fields
        if is_text(f.dataType) or isinstance(f.dataType, T.BooleanType) or f.name in few
    ]
