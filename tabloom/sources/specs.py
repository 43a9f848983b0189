"""Declared schemas of the three known tables, with their rules and repairs.

A ``TableSpec`` is all a caller needs to load, check, repair and score a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.constraints import Constraint

# --- Fixed values: column names, labels, codes and bounds of the public data sets. -------

CREDIT_LABEL = "default.payment.next.month"
CREDIT_STATUS = ("PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6")
CREDIT_BILLS = tuple(f"BILL_AMT{i}" for i in range(1, 7))
CREDIT_PAYMENTS = tuple(f"PAY_AMT{i}" for i in range(1, 7))
CREDIT_COLUMNS = (
    "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE",
    *CREDIT_STATUS, *CREDIT_BILLS, *CREDIT_PAYMENTS, CREDIT_LABEL,
)
CREDIT_CATEGORICAL = ("SEX", "EDUCATION", "MARRIAGE", *CREDIT_STATUS, CREDIT_LABEL)
#: Other header spellings: X1..X23 in column order, Y and the spaced label.
CREDIT_ALIASES = {
    **{f"X{i}": name for i, name in enumerate(CREDIT_COLUMNS[:-1], start=1)},
    "Y": CREDIT_LABEL,
    "default payment next month": CREDIT_LABEL,
}
CREDIT_DOMAINS = {"SEX": (1, 2), "EDUCATION": (0, 1, 2, 3, 4, 5, 6), "MARRIAGE": (0, 1, 2, 3)}
CREDIT_LABEL_DOMAIN = (0, 1)
CREDIT_AGE = (18, 100)
CREDIT_STATUS_RANGE = (-2, 9)

ADULT_LABEL = "income"
ADULT_COLUMNS = (
    "age", "workclass", "fnlwgt", "education", "education-num", "marital-status", "occupation",
    "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week",
    "native-country", ADULT_LABEL,
)
ADULT_INTEGERS = ("age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week")
ADULT_CATEGORICAL = (
    "workclass", "education", "marital-status", "occupation", "relationship", "race", "sex",
    "native-country", ADULT_LABEL,
)
ADULT_LABELS = ("<=50K", ">50K")
ADULT_EDUCATION_NUM = {
    "Preschool": 1, "1st-4th": 2, "5th-6th": 3, "7th-8th": 4, "9th": 5, "10th": 6, "11th": 7,
    "12th": 8, "HS-grad": 9, "Some-college": 10, "Assoc-voc": 11, "Assoc-acdm": 12,
    "Bachelors": 13, "Masters": 14, "Prof-school": 15, "Doctorate": 16,
}
ADULT_BOUNDS = {
    "age": (16, 100), "education-num": (1, 16), "hours-per-week": (1, 99),
    "capital-gain": (0, None), "capital-loss": (0, None),
}

HELOC_LABEL = "RiskPerformance"
HELOC_LABELS = ("Good", "Bad")
HELOC_CODES = (-9, -8, -7)
HELOC_NUMERIC = (
    "ExternalRiskEstimate", "MSinceOldestTradeOpen", "MSinceMostRecentTradeOpen", "AverageMInFile",
    "NumSatisfactoryTrades", "NumTrades60Ever2DerogPubRec", "NumTrades90Ever2DerogPubRec",
    "PercentTradesNeverDelq", "MSinceMostRecentDelq", "MaxDelq2PublicRecLast12M", "MaxDelqEver",
    "NumTotalTrades", "NumTradesOpeninLast12M", "PercentInstallTrades",
    "MSinceMostRecentInqexcl7days", "NumInqLast6M", "NumInqLast6Mexcl7days",
    "NetFractionRevolvingBurden", "NetFractionInstallBurden", "NumRevolvingTradesWBalance",
    "NumInstallTradesWBalance", "NumBank2NatlTradesWHighUtilization", "PercentTradesWBalance",
)
HELOC_COLUMNS = (HELOC_LABEL, *HELOC_NUMERIC)
HELOC_PERCENTS = ("PercentTradesNeverDelq", "PercentInstallTrades", "PercentTradesWBalance")
HELOC_FRACTIONS = ("NetFractionRevolvingBurden", "NetFractionInstallBurden")
HELOC_DELINQUENCY = ("MaxDelq2PublicRecLast12M", "MaxDelqEver")
HELOC_COUNTS = (
    "NumSatisfactoryTrades", "NumTrades60Ever2DerogPubRec", "NumTrades90Ever2DerogPubRec",
    "NumTotalTrades", "NumTradesOpeninLast12M", "NumInqLast6M", "NumInqLast6Mexcl7days",
    "NumRevolvingTradesWBalance", "NumInstallTradesWBalance", "NumBank2NatlTradesWHighUtilization",
)
#: Pairs (smaller, larger); repairs go through them in this order.
HELOC_PAIRS = (
    ("NumTrades90Ever2DerogPubRec", "NumTrades60Ever2DerogPubRec"),
    ("NumTrades60Ever2DerogPubRec", "NumTotalTrades"),
    ("NumTrades90Ever2DerogPubRec", "NumTotalTrades"),
    ("NumTradesOpeninLast12M", "NumTotalTrades"),
    ("NumSatisfactoryTrades", "NumTotalTrades"),
    ("NumRevolvingTradesWBalance", "NumTotalTrades"),
    ("NumInstallTradesWBalance", "NumTotalTrades"),
)
HELOC_ALIASES = {
    "estimate_of_risk": "ExternalRiskEstimate",
    "months_since_first_trade": "MSinceOldestTradeOpen",
    "months_since_last_trade": "MSinceMostRecentTradeOpen",
    "average_duration_of_resolution": "AverageMInFile",
    "number_of_satisfactory_trades": "NumSatisfactoryTrades",
    "nr_trades_insolvent_for_over_60_days": "NumTrades60Ever2DerogPubRec",
    "nr_trades_insolvent_for_over_90_days": "NumTrades90Ever2DerogPubRec",
    "percentage_of_legal_trades": "PercentTradesNeverDelq",
    "months_since_last_illegal_trade": "MSinceMostRecentDelq",
    "maximum_illegal_trades_over_last_year": "MaxDelq2PublicRecLast12M",
    "maximum_illegal_trades": "MaxDelqEver",
    "nr_total_trades": "NumTotalTrades",
    "nr_trades_initiated_in_last_year": "NumTradesOpeninLast12M",
    "percentage_of_installment_trades": "PercentInstallTrades",
    "months_since_last_inquiry_not_recent": "MSinceMostRecentInqexcl7days",
    "nr_inquiries_in_last_6_months": "NumInqLast6M",
    "nr_inquiries_in_last_6_months_not_recent": "NumInqLast6Mexcl7days",
    "net_fraction_of_revolving_burden": "NetFractionRevolvingBurden",
    "net_fraction_of_installment_burden": "NetFractionInstallBurden",
    "nr_revolving_trades_with_balance": "NumRevolvingTradesWBalance",
    "nr_installment_trades_with_balance": "NumInstallTradesWBalance",
    "nr_banks_with_high_ratio": "NumBank2NatlTradesWHighUtilization",
    "percentage_trades_with_balance": "PercentTradesWBalance",
    "is_at_risk": HELOC_LABEL,
}
#: Label spellings; the loader knows more of them than the repair does.
HELOC_LOAD_LABELS = {"Bad": ("bad", "1", "true", "yes"), "Good": ("good", "0", "false", "no")}
HELOC_REPAIR_LABELS = {"Bad": ("bad", "1", "true"), "Good": ("good", "0", "false")}

INDEX_COLUMNS = ("ID", "Unnamed: 0")
#: Cell texts that CSV input treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# --- end of fixed values ------------------------------------------------------------------


@dataclass(frozen=True)
class TableSpec:
    """A known table: schema, label, categorical columns, rules and repair."""

    name: str
    columns: tuple[str, ...]
    label: str
    categorical: tuple[str, ...]
    integers: tuple[str, ...]
    rules: Callable[[str], list[Constraint]]
    repair: Callable[[DataFrame, str], DataFrame]
    aliases: Mapping[str, str] = field(default_factory=dict)
    #: Columns of numbers with fractions.
    doubles: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        kinds = {n: T.LongType() for n in self.integers} | {n: T.DoubleType() for n in self.doubles}
        return T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in self.columns])

    def constraints(self) -> list[Constraint]:
        return self.rules(self.label)

    def repaired(self, df: DataFrame) -> DataFrame:
        return self.repair(df, self.label)
