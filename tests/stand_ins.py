"""Deterministic stand-ins for a generator, for tests of the loops around it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import c, pick, quoted
from tabloom.functions.hashing import hash_hex, hex_wide
from tabloom.operators.codec import TextCodec
from tabloom.operators.generation import Responder
from tabloom.operators.prompts import PromptBuilder
from tabloom.operators.ranking import dense_index
from tabloom.operators.sampling import ROW_ID, balanced_draws, class_counts


def table_responder(df: DataFrame, builder: PromptBuilder, n_rows: int = 32, seed: int = 123) -> Responder:
    """Class-balanced rows of ``df`` as coded CSV."""
    label, key = builder.config.target, builder.key
    per_class = max(1, n_rows // max(builder.book.sizes.get(label, 0), 1))

    def respond(prompts: DataFrame, rounds: tuple[int, int]) -> DataFrame:
        draws = balanced_draws(df, label, per_class, 1, rounds, seed, key)
        lines = builder.csv_lines(df, draws).selectExpr("round", "struct(CAST(class AS STRING) AS c, draw) AS place", "line")
        ordered = f"slice(sort_array(collect_list(struct(place, line))), 1, {n_rows})"
        replies = lines.groupBy("round").agg(F.expr(f"array_join(transform({ordered}, x -> x.line), '\\n') AS reply"))
        return prompts.join(replies, "round")

    return respond


def table_text_responder(codec: TextCodec, df: DataFrame, label: str, seed: int = 123, key: str = ROW_ID) -> Responder:
    """A random row of the asked class, as a sentence."""

    def respond(prompts: DataFrame, rounds: tuple[int, int]) -> DataFrame:
        source = df.filter(c(label).isNotNull())
        indexed = dense_index(source, key, seed, by=label)
        texts = indexed.select(
            c(label).alias("_class"), "_index", codec.sentence(indexed, seed, key=key).alias("reply")
        )
        sizes = class_counts(df, label).select("_class", "_size")
        asked = prompts.join(F.broadcast(sizes), c(label) == F.col("_class"))
        asked = asked.selectExpr("*", f"pmod({hex_wide(hash_hex(quoted(ROW_ID), seed))}, _size) AS _index")
        return asked.join(texts, ["_class", "_index"]).select(*pick(prompts.columns), "reply")

    return respond
