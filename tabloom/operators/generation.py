"""Running a generator over prompts, and the loops that turn replies into tables.

A *responder* maps a DataFrame with a ``prompt`` column, and the range of rounds
it covers, to one with a ``reply`` column, keeping the rest. ``python_responder`` wraps a plain ``str -> str``
callable; replies are always written to the shared folder before they are
parsed, because asking again would give other rows.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import pick
from ..session import materialize
from .codec import TextCodec
from .constraints import Constraint
from .prompts import PromptBuilder
from .sampling import ROW_ID, class_quota

Responder = Callable[[DataFrame, tuple[int, int]], DataFrame]
#: Rounds asked for at once; bounds the small per-round tables of one batch.
MAX_ROUNDS_PER_BATCH = 100_000


def python_responder(
    make: Callable[[], Callable[[str], str]],
    partitions: int | None = None,
    attempts: int = 3,
    pause: float = 1.0,
) -> Responder:
    """Responder over a callable built once per partition, with bounded retries and doubling pauses."""

    def respond(prompts: DataFrame, rounds: tuple[int, int]) -> DataFrame:
        schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = make()

            def patient(prompt: str) -> str:
                for attempt in range(attempts):
                    try:
                        return ask(prompt)
                    except Exception:
                        if attempt + 1 == attempts:
                            raise
                        time.sleep(pause * 2**attempt)
                raise RuntimeError("attempts must be at least 1")

            for batch in batches:
                yield batch.assign(reply=[patient(p) for p in batch["prompt"]])

        spread = prompts if partitions is None else prompts.repartition(partitions)
        return spread.mapInPandas(run, schema)

    return respond


def rounds_needed(n: int, rows_per_prompt: int) -> int:
    """Default limit on rounds: twice what a perfect generator would need."""
    return math.ceil(n / max(rows_per_prompt, 1) * 2)


def _answered(spark: SparkSession, ledger: str, rounds: tuple[int, int], answer: Callable[[], DataFrame]) -> DataFrame:
    """Replies of a batch of rounds: those in the ledger, or new ones that are entered there.

    A batch counts as answered once its line is in the ledger's list, which is written after the replies: what a cut
    run has left behind is not read, and the next attempt writes to a folder of its own.
    """
    try:
        lines = spark.read.schema("first long, end long, path string").parquet(f"{ledger}/answered")
        known = lines.filter((F.col("first") == rounds[0]) & (F.col("end") == rounds[1])).agg(F.min("path")).first()[0]
    except AnalysisException:  # no ledger yet
        known = None
    if known is None:
        known = f"{ledger}/replies-{rounds[0]}-{rounds[1]}-{uuid.uuid4().hex}"
        answer().write.parquet(known)
        line = spark.range(1).select(F.lit(rounds[0]).alias("first"), F.lit(rounds[1]).alias("end"), F.lit(known).alias("path"))
        line.select(F.col("first").cast("long"), F.col("end").cast("long"), "path").write.mode("append").parquet(f"{ledger}/answered")
    return spark.read.parquet(known)


def generate(
    builder: PromptBuilder,
    df: DataFrame,
    responder: Responder,
    n_samples: int,
    constraints: Sequence[Constraint] = (),
    drop_unknown: bool = True,
    max_rounds: int = 50,
    ledger: str | None = None,
) -> DataFrame:
    """Prompt, parse and filter until ``n_samples`` rows exist or the rounds run out.

    With a ``ledger`` (a folder that driver and executors share), replies are kept there, and a run that is started
    again with the same arguments reads the rounds that were answered instead of asking for them once more.

    Rounds go out in batches sized for what is still missing. The result has
    ``round, line_no`` and the typed columns: the first ``n_samples`` valid rows
    in generation order.
    """
    per_round = max(1, builder.config.generated_rows_per_prompt)
    chunks: list[DataFrame] = []
    have, done = 0, 0
    while have < n_samples and done < max_rounds:
        size = min(math.ceil((n_samples - have) / per_round), max_rounds - done, MAX_ROUNDS_PER_BATCH)
        asked = builder.prompts(df, (done, done + size))
        answer = lambda rounds=(done, done + size), asked=asked: responder(asked, rounds).select("round", "reply")
        replies = materialize(answer(), "replies") if ledger is None else _answered(df.sparkSession, ledger, (done, done + size), answer)
        rows = materialize(
            builder.postprocess(builder.parse(replies), constraints, drop_unknown), "generated"
        )
        found = rows.count()
        if have + found > n_samples:
            rows = _first_of_batch(rows, n_samples - have)
        chunks.append(rows)
        have, done = have + found, done + size
    if not chunks:
        empty = T.StructType(
            [T.StructField("round", T.LongType()), T.StructField("line_no", T.LongType()), *builder.schema.fields]
        )
        return df.sparkSession.createDataFrame([], empty)
    result = chunks[0]
    for chunk in chunks[1:]:
        result = result.unionByName(chunk)
    return result


def _first_of_batch(rows: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows in (round, line) order, cutting only inside the round that holds the boundary."""
    # One row per round of a batch, so MAX_ROUNDS_PER_BATCH bounds this window.
    running = rows.groupBy("round").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "_before",
        F.coalesce(
            F.sum("n").over(
                Window.partitionBy(F.lit(0)).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    placed = rows.join(F.broadcast(running.select("round", "_before")), "round")
    rank = F.row_number().over(Window.partitionBy("round").orderBy("line_no"))
    return (
        placed.withColumn("_rank", rank)
        .filter(F.col("_before") + F.col("_rank") <= n)
        .select(*pick(rows.columns))
    )


def condition_slots(df: DataFrame, label: str, n: int) -> DataFrame:
    """``_row_id, class`` for ``n`` texts to sample, classes in proportion to their frequency."""
    quotas = class_quota(df, label, n).agg(F.sort_array(F.collect_list(F.struct("class", "quota"))).alias("q"))
    slots = df.sparkSession.range(n).select(F.col("id").alias(ROW_ID)).withColumn("_q", quotas.scalar())
    upto = F.aggregate(
        "_q",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast(df.schema[label].dataType).alias("class")),
        lambda acc, q: F.when(acc["sum"] > F.col(ROW_ID), acc).otherwise(
            F.struct((acc["sum"] + q["quota"]).alias("sum"), q["class"].alias("class"))
        ),
    )
    return slots.select(ROW_ID, upto["class"].alias("class"))


def sample_texts(
    codec: TextCodec, df: DataFrame, responder: Responder, n: int, label: str | None = None, seed: int = 42
) -> DataFrame:
    """``n`` rows decoded from generated texts, conditioned on the label's frequencies if one is given.

    Without a label every prompt opens with the first column.
    """
    if label is None:
        slots = df.sparkSession.range(n).select(
            F.col("id").alias(ROW_ID), F.lit(f"{codec.columns[0]} is").alias("prompt")
        )
    else:
        slots = condition_slots(df, label, n).withColumnRenamed("class", label)
        slots = slots.withColumn("prompt", codec.condition_prompt(slots, [label]))
    replies = materialize(responder(slots, (0, n)).select(ROW_ID, "reply"), "texts")
    return codec.decode(replies, "reply", keep=[ROW_ID])
