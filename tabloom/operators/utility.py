"""Usefulness of synthetic rows: train on them, test on real ones, compare AUC."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c, is_text, key_text, literal
from ..functions.numeric import num
from ..session import materialize
from .fidelity import auc_binary
from .ridge import Ridge, fit_ridge
from .sampling import FEW_VALUES, ROW_ID
from .schema import columns_with_few_values

#: Up to so many categories their coefficients are kept on the driver; beyond that they are a table.
DRIVER_CATEGORIES = 100_000
#: Training rows per partition, at least.
ROWS_PER_PARTITION = 25_000


def target_classes(train: DataFrame, test: DataFrame, target: str) -> list[str]:
    """The two class texts in text order; an error if there are not exactly two."""
    both = train.selectExpr(f"{key_text(train.schema, target)} AS y").union(test.selectExpr(f"{key_text(test.schema, target)} AS y"))
    found = sorted(row["y"] for row in both.filter("y IS NOT NULL").distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"{target} must have two classes, not {len(found)} or more: {found}")
    return found


@dataclass(frozen=True)
class Design:
    """How columns become features, learnt from the training rows only."""

    categorical: list[str]
    numeric: list[str]
    centre: dict[str, tuple[float, float]]
    #: Whether the number of categories is within the bound of the driver.
    few: bool = True
    #: The distinct ``column, value`` pairs of the categorical columns v0, v1.., at most one above that bound.
    levels: DataFrame | None = None

    @classmethod
    def fit(cls, train: DataFrame, target: str, key: str, driver_categories: int = DRIVER_CATEGORIES) -> Design:
        names = [n for n in train.columns if n not in (target, key)]
        numbers = [n for n in names if not is_text(train.schema[n].dataType)]
        few = columns_with_few_values(train, numbers, FEW_VALUES)
        categorical = [n for n in names if n not in numbers or n in few]
        numeric = [n for n in names if n not in categorical]
        bounded, levels = True, None
        if categorical:
            cells = train.selectExpr(*[f"{key_text(train.schema, n)} AS v{i}" for i, n in enumerate(categorical)])
            levels = cells.unpivot([], cells.columns, "column", "value").distinct().limit(driver_categories + 1)
            levels = materialize(levels, "levels")
            bounded = levels.count() <= driver_categories
        centre = {}
        if numeric:
            stats = train.selectExpr(
                *[f"avg({num(train.schema, n)}) AS m{i}" for i, n in enumerate(numeric)],
                *[f"stddev_samp({num(train.schema, n)}) AS s{i}" for i, n in enumerate(numeric)],
            ).first()
            for i, n in enumerate(numeric):
                mean, std = stats[f"m{i}"], stats[f"s{i}"]
                centre[n] = (mean or 0.0, std if std and std > 0 else 1.0)
        return cls(categorical, numeric, centre, bounded, levels)

    def columns(self, df: DataFrame, target: str, positive: str) -> DataFrame:
        """Label 0/1 in ``y``, categories as text, numbers standardised with missing as the mean."""
        cells = [f"{key_text(df.schema, n)} AS c{i}" for i, n in enumerate(self.categorical)]
        for i, n in enumerate(self.numeric):
            mean, std = (literal(v) for v in self.centre[n])
            cells.append(f"(coalesce(CAST({num(df.schema, n)} AS DOUBLE), {mean}) - {mean}) / {std} AS n{i}")
        truth = f"CAST({key_text(df.schema, target)} = {literal(positive)} AS DOUBLE) AS y"
        return df.filter(c(target).isNotNull()).selectExpr(truth, *cells)

    def pipeline(self, l2: float, max_iter: int) -> Pipeline:
        stages, inputs = [], [f"n{i}" for i in range(len(self.numeric))]
        if self.categorical:
            names = [f"c{i}" for i in range(len(self.categorical))]
            coded, hot = [f"{n}_index" for n in names], [f"{n}_hot" for n in names]
            # The slot that "keep" adds for unseen and missing is the one dropLast removes. Labels are in text order, so
            # the distinct values tell as much as all rows.
            indexer = StringIndexer(inputCols=names, outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc")
            stages.append(indexer.fit(self.levels.select(*[F.expr(f"CASE WHEN column = 'v{i}' THEN value END AS {n}") for i, n in enumerate(names)])))
            stages.append(OneHotEncoder(inputCols=coded, outputCols=hot, dropLast=True))
            inputs += hot
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
        stages.append(
            LogisticRegression(
                labelCol="y", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6
            )
        )
        return Pipeline(stages=stages)


def fit_scores(
    train: DataFrame,
    test: DataFrame,
    target: str,
    l2: float = 1e-4,
    max_iter: int = 200,
    key: str = ROW_ID,
    driver_categories: int = DRIVER_CATEGORIES,
) -> tuple[DataFrame, PipelineModel | Ridge]:
    """``y, score`` of the test rows under a ridge logistic model of the training rows.

    Both solvers minimise the same function by L-BFGS; which one runs depends on the number of categories alone.
    """
    positive = target_classes(train, test, target)[1]
    design = Design.fit(train.filter(c(target).isNotNull()), target, key, driver_categories)
    rows = design.columns(train, target, positive)
    if not design.few:
        categories, numbers = ([f"{tag}{i}" for i in range(len(n))] for tag, n in (("c", design.categorical), ("n", design.numeric)))
        wide = fit_ridge(rows, "y", categories, numbers, l2, max_iter)
        scored = wide.scores(design.columns(test, target, positive), categories, numbers, ["y"])
        return scored.select(F.col("y").cast("int").alias("y"), "score"), wide
    # Every solver step is a job over all partitions, so small tables get few of them.
    rows = rows.coalesce(max(1, math.ceil(train.count() / ROWS_PER_PARTITION)))
    model = design.pipeline(l2, max_iter).fit(rows)
    scored = model.transform(design.columns(test, target, positive))
    return scored.select(F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score")), model


def tstr_report(
    real_train: DataFrame,
    synthetic_train: DataFrame,
    real_test: DataFrame,
    target: str,
    l2: float = 1e-4,
    max_iter: int = 200,
    key: str = ROW_ID,
    driver_categories: int = DRIVER_CATEGORIES,
) -> DataFrame:
    """One row: AUC on real test rows of models trained on synthetic and on real rows.

    The solver is L-BFGS on the same ridge objective as plain gradient descent.
    """
    scored = None
    for name, train in (("synthetic", synthetic_train), ("real", real_train)):
        part, _ = fit_scores(train, real_test, target, l2, max_iter, key, driver_categories)
        part = part.withColumn("model", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    aucs = auc_binary(scored, "y", "score", by="model")
    found = aucs.agg(
        F.max(F.when(F.col("model") == "synthetic", F.col("auc"))).alias("synthetic_auc"),
        F.max(F.when(F.col("model") == "real", F.col("auc"))).alias("real_auc"),
    )
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return found.select(
        "synthetic_auc",
        "real_auc",
        size(synthetic_train).alias("n_train_synthetic"),
        size(real_train).alias("n_train_real"),
        size(real_test).alias("n_test_real"),
        F.lit("l-bfgs").alias("solver"),
    )
