"""Rule sets for the known tables."""

from __future__ import annotations

from ..sources import specs as S
from .constraints import (
    Constraint,
    in_numeric_set,
    integer_or_code,
    integer_status,
    less_equal_unless_code,
    mapped_value,
    numeric_at_least,
    numeric_between,
    text_domain,
)


def credit_constraints(label: str = S.CREDIT_LABEL) -> list[Constraint]:
    """18 rules of the credit-card default table (17 without a label)."""
    rules = [numeric_at_least("LIMIT_BAL", 1)]
    rules += [in_numeric_set(name, domain) for name, domain in S.CREDIT_DOMAINS.items()]
    rules += [numeric_between("AGE", *S.CREDIT_AGE)]
    rules += [integer_status(name, *S.CREDIT_STATUS_RANGE, "repayment status") for name in S.CREDIT_STATUS]
    rules += [numeric_at_least(name, 0) for name in S.CREDIT_PAYMENTS]
    return rules + ([in_numeric_set(label, S.CREDIT_LABEL_DOMAIN)] if label else [])


def adult_constraints(label: str = S.ADULT_LABEL) -> list[Constraint]:
    """7 rules of the census income table (6 without a label)."""
    rules = [
        numeric_at_least(name, low) if high is None else numeric_between(name, low, high)
        for name, (low, high) in S.ADULT_BOUNDS.items()
    ]
    rules.append(
        mapped_value(
            "education_num_consistency", "education", "education-num", S.ADULT_EDUCATION_NUM,
            "education-num is the number that the census gives to education.",
        )
    )
    if label:
        spellings = [*S.ADULT_LABELS, *(f"{x}." for x in S.ADULT_LABELS)]
        rules.append(text_domain(label, spellings, "one of " + ", ".join(S.ADULT_LABELS)))
    return rules


def heloc_ceiling(column: str) -> int:
    if column in S.HELOC_FRACTIONS:
        return 300
    if column in S.HELOC_DELINQUENCY:
        return 9
    if column in S.HELOC_COUNTS:
        return 500
    return 100 if column in (*S.HELOC_PERCENTS, "ExternalRiskEstimate") else 1000


def heloc_constraints(label: str = S.HELOC_LABEL) -> list[Constraint]:
    """31 rules of the home-equity credit line table (30 without a label)."""
    rules = [text_domain(label, S.HELOC_LABELS, " or ".join(S.HELOC_LABELS))] if label else []
    special = ("ExternalRiskEstimate", *S.HELOC_PERCENTS, *S.HELOC_FRACTIONS, *S.HELOC_DELINQUENCY)
    ordered = [*special, *(name for name in S.HELOC_NUMERIC if name not in special)]
    rules += [integer_or_code(n, S.HELOC_CODES, 0, heloc_ceiling(n), "heloc") for n in ordered]
    return rules + [less_equal_unless_code(a, b, S.HELOC_CODES, "HELOC") for a, b in S.HELOC_PAIRS]
