"""Class-balanced CSV prompts, parsing of CSV replies, and typed post-processing.

One prompt is one row; rounds are rows too, so any number of prompts is built
in one job.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import c, literal, literals, named, pick, strip
from ..session import BROADCAST_ROW_BOUND, at_most
from .codebook import JOINED_LINES, CodeBook, csv_header, csv_line
from .constraints import Constraint, reject_invalid
from .lookups import lookup_join
from .sampling import ROW_ID, balanced_draws
from .schema import coerce_to_schema

# --- Fixed values: prompt wording and reply conventions. ----------------------------------
DESCRIPTIONS_LINE = "Column descriptions:"
INSTRUCTIONS = (
    "Generate synthetic tabular rows in CSV format.",
    "Use the same columns, value ranges, categorical supports, and class-wise patterns as the examples.",
    "Return only CSV rows after the final header. Do not add prose.",
)
CHATTY_PREFIXES = ("here", "sure", "note:", "rows:")
FENCE = "```"
SET_NAMES = string.ascii_uppercase
# --- end of fixed values ------------------------------------------------------------------

_FENCE_LINE = r"(?m)^[ \t\f]*```[^\n]*$"
_LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

_BLANK = r"[ \t\n\r\f\x0b]"


@dataclass(frozen=True)
class PromptConfig:
    target: str
    n_samples_per_class: int = 8
    n_sets: int = 3
    generated_rows_per_prompt: int = 32
    use_codes: bool = True
    seed: int = 42


@dataclass(frozen=True)
class PromptBuilder:
    """What fitting a reference table yields: column order, types, known values and codes."""

    config: PromptConfig
    columns: tuple[str, ...]
    schema: T.StructType
    book: CodeBook
    descriptions: Mapping[str, str]
    key: str = ROW_ID

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        config: PromptConfig,
        categorical: Sequence[str],
        descriptions: Mapping[str, str] | None = None,
        key: str = ROW_ID,
    ) -> PromptBuilder:
        if config.target not in df.columns:
            raise ValueError(f"target {config.target!r} is not a column")
        if not 1 <= config.n_sets <= len(SET_NAMES):
            raise ValueError(f"n_sets must be between 1 and {len(SET_NAMES)}")
        names = list(dict.fromkeys([*categorical, config.target]))
        columns = (config.target, *(n for n in df.columns if n not in (config.target, key)))
        book = CodeBook.fit(df, names, seed=config.seed)
        schema = T.StructType([df.schema[n] for n in columns])
        return cls(config, columns, schema, book, dict(descriptions or {}), key)

    def coded(self, df: DataFrame) -> DataFrame:
        return self.book.encode(df) if self.config.use_codes else df

    def prompts(self, df: DataFrame, rounds: tuple[int, int] = (0, 1), seed: int | None = None) -> DataFrame:
        """``round, prompt`` for every round in the half-open range."""
        cfg = self.config
        if not self.book.sizes.get(cfg.target):
            raise ValueError(f"{cfg.target} has no values to draw examples of")
        draws = balanced_draws(
            df, cfg.target, cfg.n_samples_per_class, cfg.n_sets, rounds, cfg.seed if seed is None else seed, self.key
        )
        lines = self.csv_lines(df, draws).selectExpr(
            "round", "set", "struct(CAST(class AS STRING) AS c, draw, line) AS x"
        )
        header = csv_header(self.columns)
        blocks = lines.groupBy("round", "set").agg(F.expr(f"{JOINED_LINES} AS rows"))
        title = f"concat('Set ', substring({literal(SET_NAMES)}, CAST(set AS INT) + 1, 1), ':')"
        block = f"struct(set, concat_ws('\\n', {title}, {literal(header)}, rows, '') AS line) AS x"
        closing = (
            f"Generate {cfg.generated_rows_per_prompt} new rows, balanced across {cfg.target} classes.\n{header}"
        )
        text = f"concat_ws('\\n', {literal(self._opening())}, {JOINED_LINES}, {literal(closing)}) AS prompt"
        return blocks.selectExpr("round", block).groupBy("round").agg(F.expr(text))

    def csv_lines(self, df: DataFrame, draws: DataFrame) -> DataFrame:
        """``draws`` plus the coded CSV line of each drawn row."""
        picked, size = self._picked(df, draws)
        lines = self.coded(picked)
        lines = lines.selectExpr(*pick([self.key]), f"{csv_line(lines.schema, self.columns)} AS line")
        return lookup_join(draws, lines, [self.key], F.col("round"), size)

    def drawn_rows(self, df: DataFrame, draws: DataFrame) -> DataFrame:
        """``draws`` plus the cells of each drawn row."""
        picked, size = self._picked(df, draws)
        return lookup_join(draws, picked, [self.key], F.col("round"), size)

    def _picked(self, df: DataFrame, draws: DataFrame) -> tuple[DataFrame, int]:
        drawn = draws.select(self.key).distinct()
        size = BROADCAST_ROW_BOUND if at_most(drawn, BROADCAST_ROW_BOUND) else BROADCAST_ROW_BOUND + 1
        return df.join(drawn, self.key, "left_semi").select(*pick([self.key, *self.columns])), size

    def _opening(self) -> str:
        described = [f"{n}: {self.descriptions[n]}" for n in self.columns if n in self.descriptions]
        intro = [DESCRIPTIONS_LINE, *described, ""] if self.descriptions else []
        return "\n".join([*intro, *INSTRUCTIONS, ""])

    def parse(self, replies: DataFrame, reply: str = "reply", keep: Sequence[str] = ("round",)) -> DataFrame:
        return parse_replies(replies, self.columns, reply, keep)

    def postprocess(
        self,
        parsed: DataFrame,
        constraints: Sequence[Constraint] = (),
        drop_unknown: bool = True,
        keep: Sequence[str] = ("round", "line_no"),
    ) -> DataFrame:
        """Codes back to values, reference types, then rows of known categories and valid rules only."""
        restored = self.book.decode(parsed) if self.config.use_codes else parsed
        typed = coerce_to_schema(restored, self.schema, keep)
        known = self.book.known_only(typed) if drop_unknown else typed
        return reject_invalid(known, constraints)


def kept_lines(reply: str, n_columns: int) -> str:
    """Lines of a reply that look like data: the array of stripped lines with the right comma count.

    Cutting the text at its fence lines leaves pieces that are outside and
    inside a fence by turns; chatty lines are dropped outside only.
    """
    pieces = f"split(regexp_replace({reply}, r'{_LINE_BREAKS}', '\\n'), r'{_FENCE_LINE}', -1)"
    chatty = f"(i % 2 = 0 AND x RLIKE '(?i)^({'|'.join(CHATTY_PREFIXES)})')"
    wanted = (
        f"x != '' AND NOT startswith(x, '{FENCE}') AND NOT {chatty} "
        f"AND length(x) - length(replace(x, ',', '')) = {n_columns - 1}"
    )
    lines = f"filter(transform(split(piece, '\\n'), x -> {strip('x')}), x -> {wanted})"
    return f"flatten(transform({pieces}, (piece, i) -> {lines}))"


def parse_replies(
    replies: DataFrame, columns: Sequence[str], reply: str = "reply", keep: Sequence[str] = ("round",)
) -> DataFrame:
    """Data rows of all replies as text columns, with ``line_no`` counting kept lines per reply.

    Each line is parsed alone. A quoted comma makes a row too short, so such
    rows and repeated headers are dropped.
    """
    lines = replies.selectExpr(
        *pick(keep), f"posexplode({kept_lines(*pick([reply]), len(columns))}) AS (line_no, _line)"
    )
    closed = r"""(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$"""
    unescaped = lambda x: f"""replace({x}, '""', '"')"""
    whole = f"concat({unescaped(f"regexp_extract(x, r'{closed}', 1)")}, regexp_extract(x, r'{closed}', 2))"
    cut = unescaped("substring(x, 2)")
    value = strip(
        f"""CASE WHEN NOT startswith(x, '"') THEN x WHEN x RLIKE r'{closed}' THEN {whole} ELSE {cut} END"""
    )
    # Most lines hold neither quotes nor blanks: their pieces are the cells. Lines are looked at as a whole first.
    quotes = """instr(_line, '"') > 0"""
    bare = f"transform(_raw, x -> {strip('x')})"
    cells = f"""CASE WHEN {quotes} THEN transform(_raw, x -> {value}) WHEN _line RLIKE r'{_BLANK}' THEN {bare} ELSE _raw END"""
    spills = f"""{quotes} AND exists(slice(_raw, 1, {len(columns) - 1}), x -> startswith(x, '"') AND NOT x RLIKE r'{closed}')"""
    return (
        lines.selectExpr(*pick(keep), "line_no", "_line", "split(_line, ',') AS _raw")
        .filter(f"NOT ({spills})")
        .selectExpr(*pick(keep), "CAST(line_no AS BIGINT) AS line_no", f"{cells} AS _cells")
        .filter(f"_cells != array({literals(columns)})")
        .selectExpr(*pick(keep), "line_no", *[named(f"_cells[{i}]", n) for i, n in enumerate(columns)])
    )
