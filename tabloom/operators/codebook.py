"""Unique short codes for categorical values, and CSV lines."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, is_numeric, key_text, literal, literals, pick, quoted, replaced
from ..session import BROADCAST_ROW_BOUND, materialize
from . import lookups
from .lookups import heavy_keys, lookup_join
from .ranking import prefix_sums

_LETTERS = string.ascii_uppercase
_ALPHABET = string.ascii_uppercase + string.digits
#: Odd and prime to 3 and 13, so it permutes the code space of every length.
_STEP = 709301
#: Aggregate over structs ``x`` whose last field is a ``line``: the lines joined in struct order.
JOINED_LINES = "array_join(transform(sort_array(collect_list(x)), x -> x.line), '\\n')"
#: Columns with no more values than this are looked up in a literal map instead of a join.
LITERAL_BOUND = 256


def code_capacity(length: int) -> int:
    return len(_LETTERS) * len(_ALPHABET) ** (length - 1)


def code_text(number: str, length: int, seed: int) -> str:
    """The code of a row number: a letter, then letters or digits; different numbers never collide."""
    spot = f"pmod({number} * {_STEP}L + {seed}, {code_capacity(length)}L)"
    digits = [f"{spot} div {36**place}L % 36" for place in range(length - 1, -1, -1)]
    return f"concat({', '.join(f'substring({literal(_ALPHABET)}, CAST({d} AS INT) + 1, 1)' for d in digits)})"


@dataclass(frozen=True)
class CodeBook:
    """``table`` holds ``column, value, code``; ``sizes`` the number of values per column.

    ``literal`` keeps the entries of small columns for map lookups.
    """

    table: DataFrame
    sizes: dict[str, int]
    literal: dict[str, dict[str, str]]
    broadcast_rows: int = BROADCAST_ROW_BOUND

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: Sequence[str],
        code_length: int = 4,
        seed: int = 42,
        literal_bound: int | None = None,
        broadcast_rows: int = BROADCAST_ROW_BOUND,
        window_rows: int = 2 * BROADCAST_ROW_BOUND,
    ) -> CodeBook:
        """Give every distinct non-null value of each column its own code.

        Values are numbered in text order within a column, columns in the given
        order: by one window up to ``window_rows`` values, beyond that by ranges
        of values. The number of values is checked against the code space first.
        Columns with more than ``literal_bound`` values are replaced by joins,
        with more than ``broadcast_rows`` by shuffled ones.
        """
        if not 1 <= code_length <= 6:
            raise ValueError("code_length must be between 1 and 6")
        names = list(dict.fromkeys(n for n in columns if n in df.columns))
        cells = df.selectExpr(*[f"{key_text(df.schema, n)} AS v{i}" for i, n in enumerate(names)])
        values = (
            cells.unpivot([], [f"v{i}" for i in range(len(names))], "v", "value")
            .filter("value IS NOT NULL")
            .distinct()
            .selectExpr("CAST(substring(v, 2) AS INT) AS position", "value")
        )
        values = materialize(values, "category-values")
        counts = {row["position"]: row["count"] for row in values.groupBy("position").count().collect()}
        if sum(counts.values()) > code_capacity(code_length):
            raise ValueError(f"More than {code_capacity(code_length)} values for codes of length {code_length}")
        starts = [sum(counts.get(j, 0) for j in range(i)) for i in range(len(names))]
        # The number of a value is a running count over its column, summed over ranges of values at any size.
        numbered = prefix_sums(values.withColumn("one", F.lit(1).cast("long")), "value", ["one"], by="position", window_rows=window_rows)
        number = f"element_at(array({', '.join(f'{x}L' for x in starts)}), position + 1) + cum_one - 1"
        table = materialize(
            numbered.selectExpr(
                f"element_at(array({literals(names)}), position + 1) AS column",
                "value",
                f"{code_text(f'({number})', code_length, seed)} AS code",
            ),
            "code-table",
        )
        sizes = {n: counts.get(i, 0) for i, n in enumerate(names)}
        bound = LITERAL_BOUND if literal_bound is None else literal_bound
        small = [n for n in names if 0 < sizes[n] <= bound]
        literal: dict[str, dict[str, str]] = {n: {} for n in small}
        for row in table.filter(F.col("column").isin(*small)).collect() if small else []:
            literal[row["column"]][row["value"]] = row["code"]
        return cls(table, sizes, literal, broadcast_rows)

    def encode(self, df: DataFrame) -> DataFrame:
        """Values replaced by their codes; unknown values and missing cells pass through (as text)."""
        return self._replace(df, "value", "code")

    def decode(self, df: DataFrame) -> DataFrame:
        """Codes replaced by their values; unknown texts pass through."""
        return self._replace(df, "code", "value")

    def support(self) -> DataFrame:
        """``column, codes``: the sorted codes of each column in one cell; for few codes, see ``support_rows``."""
        return self.table.groupBy("column").agg(F.sort_array(F.collect_set("code")).alias("codes"))

    def support_rows(self) -> DataFrame:
        """``column, code``: one row per code, for columns of any number of values."""
        return self.table.select("column", "code")

    def known_only(self, df: DataFrame) -> DataFrame:
        """Rows whose cells all hold a known value; a missing cell is not known."""
        present = [n for n in self.sizes if n in set(df.columns)]
        small = [n for n in present if n in self.literal or not self.sizes[n]]
        tests = []
        for name in small:
            known = literals(self.literal.get(name, {}))
            tests.append(f"coalesce({key_text(df.schema, name)} IN ({known}), false)" if known else "false")
        if tests:
            df = df.filter(" AND ".join(tests))
        heavy = self._heavy(df, [n for n in present if n not in small])
        for name in (n for n in present if n not in small):
            kept = df.columns
            rows = df.selectExpr("*", f"{key_text(df.schema, name)} AS _key")
            known = self.table.filter(F.col("column") == name).select(F.col("value").alias("_key"))
            df = lookup_join(
                rows, known, ["_key"], self._spread(df), self.sizes[name], broadcast_rows=self._bound(), heavy=heavy.get(name)
            ).select(*pick(kept))
        return df

    def _replace(self, df: DataFrame, source: str, target: str) -> DataFrame:
        order, texts = df.columns, {}
        names = [n for n in self.sizes if n in set(order)]
        for name in names:
            text = key_text(df.schema, name)
            pairs = self.literal.get(name, {}).items()
            if pairs:
                entries = ", ".join(f"{literal(v)}, {literal(k)}" if source == "value" else f"{literal(k)}, {literal(v)}" for v, k in pairs)
                text = f"coalesce(try_element_at(map({entries}), {text}), {text})"
            texts[name] = text
        heavy = self._heavy(df, [n for n in names if n not in self.literal and self.sizes[n]])
        df = replaced(df, texts)
        for name in (n for n in names if n not in self.literal and self.sizes[n]):
            entry = self.table.filter(F.col("column") == name).select(
                F.col(source).alias("_key"), F.col(target).alias("_new")
            )
            joined = lookup_join(
                df.selectExpr("*", f"{quoted(name)} AS _key"), entry, ["_key"], self._spread(df), self.sizes[name], "left",
                self._bound(), heavy.get(name),
            )
            df = replaced(joined, {name: f"coalesce(_new, {quoted(name)})"}).select(*pick(order))
        return df

    def _bound(self) -> int:
        return min(self.broadcast_rows, lookups.BROADCAST_ROW_BOUND)

    def _heavy(self, df: DataFrame, names: Sequence[str]) -> dict[str, dict[int, int]]:
        """Heavy values of the columns that take a shuffled join, found in one pass over the rows."""
        return heavy_keys(df, {n: [key_text(df.schema, n)] for n in names if self.sizes[n] > self._bound()})

    @staticmethod
    def _spread(df: DataFrame) -> Column:
        return F.struct(*[c(n) for n in df.columns])


def csv_cell(x: str) -> str:
    """Quote a cell only if it holds a comma, quote or line break; missing becomes empty."""
    escaped = f"""concat('"', replace({x}, '"', '""'), '"')"""
    return f"""coalesce(CASE WHEN {x} RLIKE '[,"\\r\\n]' THEN {escaped} ELSE {x} END, '')"""


def csv_line(schema: T.StructType, columns: Sequence[str]) -> str:
    """The row as one CSV line."""
    # The text of a number needs no quotes.
    cells = [f"coalesce({text}, '')" if is_numeric(schema[n].dataType) else csv_cell(text) for n in columns for text in [key_text(schema, n)]]
    line = f"concat_ws(',', {', '.join(cells)})"
    return line if len(columns) > 1 else f"""coalesce(nullif({line}, ''), '""')"""


def csv_header(columns: Sequence[str]) -> str:
    """The header line, quoted like any other."""
    special = set(',"\r\n')
    return ",".join('"' + n.replace('"', '""') + '"' if special & set(n) else n for n in columns)


def csv_text(df: DataFrame, columns: Sequence[str], order: str, by: Sequence[str]) -> DataFrame:
    """One CSV text (without header) per group, lines in ``order``; meant for small groups such as prompts."""
    lines = df.selectExpr(*pick(by), f"struct({quoted(order)} AS o, {csv_line(df.schema, columns)} AS line) AS x")
    return lines.groupBy(*pick(by)).agg(F.expr(f"{JOINED_LINES} AS text"))
