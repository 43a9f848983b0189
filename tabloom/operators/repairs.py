"""Deterministic repairs: narrow projections that move cells into their allowed domain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.columns import label_text, literal, literals, quoted, replaced
from ..functions.numeric import num
from ..sources import specs as S
from .constraints import literal_lookup
from .presets import heloc_ceiling


def round_clip(x: str, low: int, high: int | None = None) -> str:
    """Round half-even and clip; missing becomes ``low``."""
    rounded = f"greatest(rint(coalesce(CAST({x} AS DOUBLE), {low}.0D)), {low}.0D)"
    if high is not None:
        return f"CAST(least({rounded}, {high}.0D) AS BIGINT)"
    return f"coalesce(try_cast({rounded} AS BIGINT), {low}L)"


def round_clip_keep_codes(x: str, low: int, high: int | None, codes: Sequence[int]) -> str:
    """Like ``round_clip``, but a value that rounds to a special code stays that code."""
    rounded = f"rint(CAST({x} AS DOUBLE))"
    return (
        f"(CASE WHEN {rounded} IN ({literals(codes)}) THEN try_cast({rounded} AS BIGINT) "
        f"ELSE {round_clip(x, low, high)} END)"
    )


def nearest_allowed(x: str, allowed: Sequence[int]) -> str:
    """Closest allowed integer to the rounded value; the first wins ties, missing gives the first."""
    rounded = f"rint(coalesce(CAST({x} AS DOUBLE), {allowed[0]}.0D))"
    options = f"array({', '.join(f'{a}L' for a in allowed)})"
    # Structs compare field by field: smallest gap first, then position.
    return f"array_min(transform({options}, (a, i) -> struct(abs({rounded} - a) AS gap, i, a))).a"


def relabel(text: str, spellings: Mapping[str, Sequence[str]], default: str | None) -> str:
    """Map label spellings (case-blind) to their canonical form.

    Without a default an unknown spelling keeps its cleaned text.
    """
    cases = " ".join(
        f"WHEN lower({text}) IN ({literals(known)}) THEN {literal(canonical)}" for canonical, known in spellings.items()
    )
    return f"(CASE {cases} ELSE {text if default is None else literal(default)} END)"


def overwrite_mapped(df: DataFrame, source: str, target: str, mapping: Mapping[str, int]) -> DataFrame:
    """Set ``target`` to the mapped value of ``source`` where the mapping knows it."""
    found = literal_lookup(mapping, quoted(source))
    return replaced(df, {target: f"coalesce(CAST({found} AS BIGINT), {quoted(target)})"})


def clip_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], codes: Sequence[int]) -> DataFrame:
    """For each pair in order, lower the left cell to the right one when neither is a special code.

    Consecutive pairs share a projection as long as none reads or rewrites a
    cell that an earlier one of the same projection changed.
    """
    present, changed = set(df.columns), {}
    for left, right in pairs:
        if left not in present or right not in present:
            continue
        if left in changed or right in changed:
            df, changed = replaced(df, changed), {}
        lhs, rhs = num(df.schema, left), num(df.schema, right)
        free = " AND ".join(f"{side} NOT IN ({literals(codes)})" for side in (lhs, rhs))
        changed[left] = (
            f"CASE WHEN {free} AND {lhs} > {rhs} THEN try_cast({rhs} AS BIGINT) ELSE {quoted(left)} END"
        )
    return replaced(df, changed) if changed else df


def repair_credit(df: DataFrame, label: str = S.CREDIT_LABEL) -> DataFrame:
    """Repair the credit table; absent columns are skipped and bills are left as they are."""
    schema, present = df.schema, set(df.columns)
    domains = {**S.CREDIT_DOMAINS, label: S.CREDIT_LABEL_DOMAIN}
    bounds: dict[str, tuple[int, int | None]] = {"LIMIT_BAL": (1, None), "AGE": S.CREDIT_AGE}
    bounds.update({name: S.CREDIT_STATUS_RANGE for name in S.CREDIT_STATUS})
    bounds.update({name: (0, None) for name in S.CREDIT_PAYMENTS})
    fixes = {n: nearest_allowed(num(schema, n), allowed) for n, allowed in domains.items() if n in present}
    fixes |= {n: round_clip(num(schema, n), *limits) for n, limits in bounds.items() if n in present}
    return replaced(df, fixes)


def repair_adult(df: DataFrame, label: str = S.ADULT_LABEL) -> DataFrame:
    """Repair the census table. An unknown education keeps its number, so that rule may stay broken."""
    schema, present = df.schema, set(df.columns)
    fixes = {n: round_clip(num(schema, n), *b) for n, b in S.ADULT_BOUNDS.items() if n in present}
    if label in present:
        text = label_text(quoted(label))
        fixes[label] = f"CASE WHEN {text} IN ({literals(S.ADULT_LABELS)}) THEN {text} ELSE {literal(S.ADULT_LABELS[0])} END"
    fixed = replaced(df, fixes)
    if {"education", "education-num"} <= present:
        fixed = overwrite_mapped(fixed, "education", "education-num", S.ADULT_EDUCATION_NUM)
    return fixed


def repair_heloc(df: DataFrame, label: str = S.HELOC_LABEL, strict: bool = False) -> DataFrame:
    """Repair the credit-line table.

    By default counts are clipped to 1000 although the rules stop at 500, and a
    label spelt yes/no becomes "Bad"; ``strict`` clips counts to the rule bound.
    """

    def ceiling(name: str) -> int:
        return 1000 if name in S.HELOC_COUNTS and not strict else heloc_ceiling(name)

    schema, present = df.schema, set(df.columns)
    fixes = {
        n: round_clip_keep_codes(num(schema, n), 0, ceiling(n), S.HELOC_CODES) for n in S.HELOC_NUMERIC if n in present
    }
    if label in present:
        fixes[label] = relabel(label_text(quoted(label)), S.HELOC_REPAIR_LABELS, "Bad")
    return clip_pairs(replaced(df, fixes), S.HELOC_PAIRS, S.HELOC_CODES)
