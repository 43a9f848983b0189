"""The registry of known tables."""

from __future__ import annotations

from ..operators import presets, repairs
from . import specs as S

CREDIT = S.TableSpec(
    "default-credit", S.CREDIT_COLUMNS, S.CREDIT_LABEL, S.CREDIT_CATEGORICAL, S.CREDIT_COLUMNS,
    presets.credit_constraints, repairs.repair_credit, S.CREDIT_ALIASES,
)
ADULT = S.TableSpec(
    "adult", S.ADULT_COLUMNS, S.ADULT_LABEL, S.ADULT_CATEGORICAL, S.ADULT_INTEGERS,
    presets.adult_constraints, repairs.repair_adult,
)
HELOC = S.TableSpec(
    "heloc", S.HELOC_COLUMNS, S.HELOC_LABEL, (S.HELOC_LABEL,), S.HELOC_NUMERIC,
    presets.heloc_constraints, repairs.repair_heloc, S.HELOC_ALIASES,
)
TABLES = {spec.name: spec for spec in (CREDIT, ADULT, HELOC)}
