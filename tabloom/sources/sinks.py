"""Sinks: CSV tables, JSON reports, text artefacts, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV directory with a header in every file; quotes are doubled, missing cells empty."""
    df.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; nested reports keep their structure."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One text per line of the given column."""
    df.select(F.col(quoted(column)).alias("value")).write.mode(mode).text(path)


def manifest(df: DataFrame, dataset: str, source: str, **facts: str) -> DataFrame:
    """One row describing a table: name, source, row count, columns and further facts."""
    extra = [F.lit(value).alias(key) for key, value in facts.items()]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(dataset).alias("dataset"),
        F.lit(source).alias("source"),
        "n_rows",
        F.array(*[F.lit(n) for n in df.columns]).alias("columns"),
        *extra,
    )


def flatten(df: DataFrame) -> DataFrame:
    """Nested struct columns as flat columns with dotted names."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        found: list[tuple[str, ...]] = []
        for fld in schema.fields:
            here = (*path, fld.name)
            found += leaves(fld.dataType, here) if isinstance(fld.dataType, T.StructType) else [here]
        return found

    return df.select(
        *[F.col(".".join(quoted(p) for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())]
    )
