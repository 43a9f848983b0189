"""Conversation structure repair: rank-convergence parallel Viterbi over chunks of turns.

A conversation is repaired by the cheapest edits that make its roles read ``(s?(ua)+)?``. Costs to go form one vector of
four states per row. A conversation of any length is cut into chunks, which start from a speculative vector; passes
rerun a chunk from the vector that its successor came to until the two differ by a constant only. Decisions depend on
differences alone, so constants are summed afterwards and the edits are traced chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import BLANKS
from tabloom.llm.ordered import fold_sorted, ordered_rows
from tabloom.session import materialize

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 10

# States are start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
#: The state that an inserted or reroled turn leads to, and the role it has.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "u", ASSISTANT: "a"}
#: Costs to go behind the last row: nothing to add, a pair, an assistant, nothing.
END = (0, 2 * INSERT, INSERT, 0)
GUESS = (0, 0, 0, 0)
#: Row codes: kind of role (system, user, assistant, other) plus 4 x fault (none, truncated, must go).
OTHER, GONE = 3, 8
FAR = 1 << 40


@lru_cache(maxsize=1 << 16)
def step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """One row back: the vector before it (least value 0), what was taken off, and (edits, next state) of each state."""
    if code >= GONE:
        return after, DELETE, tuple(("D", q) for q in range(4))
    kind, extra = code % 4, TRUNCATED * (code // 4)
    keep = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}}.get(kind, {})
    costs = [
        min(DELETE + after[q], REROLE + extra + after[NEXT[q]], extra + after[keep[q]] if q in keep else FAR) for q in range(4)
    ]
    for _ in range(2):  # at most two turns are worth inserting at one place
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
    moves = []
    for q in range(4):
        edits, at = "", q
        while True:  # the ASCII-least of the cheapest edits: D, I, K, R
            if DELETE + after[at] == costs[at]:
                moves.append((edits + "D", at))
            elif INSERT + costs[NEXT[at]] == costs[at]:
                at = NEXT[at]
                edits += "I" + ROLE[at]
                continue
            elif at in keep and extra + after[keep[at]] == costs[at]:
                moves.append((edits + "K", keep[at]))
            else:
                moves.append((edits + "R" + ROLE[NEXT[at]], NEXT[at]))
            break
    least = min(costs)
    return tuple(c - least for c in costs), least, tuple(moves)


def backward(codes: bytes, tail: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector before a chunk, and the constant taken off it."""
    total = 0
    for code in reversed(codes):
        tail, off, _ = step(tail, code)
        total += off
    return tail, total


def rerun(codes: bytes, old: tuple[int, ...], head: tuple[int, ...], total: int, new: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """``backward`` from another vector, ended where the run from ``old`` differs by a constant only."""
    done = gone = 0
    for code in reversed(codes):
        if old == new:
            return head, done + total - gone
        old, off, _ = step(old, code)
        gone += off
        new, off, _ = step(new, code)
        done += off
    return new, done


def trace(codes: bytes, tail: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """The edits of each row from ``state`` on, and the state behind the chunk."""
    moves = []
    for code in reversed(codes):
        tail, _, choice = step(tail, code)
        moves.append(choice)
    edits = []
    for choice in reversed(moves):
        move, state = choice[state]
        edits.append(move)
    return edits, state


@dataclass
class Repair:
    """Result tables of ``repair``.

    ``turns``: every row, in the order of ``_id``: conv, turn, ``edit`` (K, R or D), ``role`` (after the edit), text and
    ``inserted`` (roles of the empty turns put before it). ``endings``: conv and the roles inserted behind its last row.
    ``report``: conv, gaps, blank, duplicate, truncated, illegal, cost; one row per conversation of the input.
    """

    turns: DataFrame
    endings: DataFrame
    report: DataFrame


def _vectors(batch: pa.RecordBatch, name: str) -> list[tuple[int, ...]]:
    return [tuple(v) for v in batch.column(name).to_pylist()]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tails = [END if last else GUESS for last in batch.column("last").to_pylist()]
        runs = [backward(codes, tail) for codes, tail in zip(batch.column("codes").to_pylist(), tails, strict=True)]
        yield _state(batch, tails, runs)


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tails = [END if n is None else tuple(n) for n in batch.column("next_head").to_pylist()]
        stored = zip(
            batch.column("codes").to_pylist(), _vectors(batch, "tail"), _vectors(batch, "head"), batch.column("total").to_pylist(),
            strict=True,
        )
        yield _state(batch, tails, [rerun(*old, new) for old, new in zip(stored, tails, strict=True)])


def _state(batch: pa.RecordBatch, tails: list, runs: list) -> pa.RecordBatch:
    vector = pa.list_(pa.int64())
    arrays = [batch.column(n) for n in ("conv", "chunk", "first_id", "codes")]
    arrays += [pa.array([list(t) for t in tails], vector), pa.array([list(h) for h, _ in runs], vector)]
    arrays.append(pa.array([t for _, t in runs], pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, ["conv", "chunk", "first_id", "codes", "tail", "head", "total"])


_STATE = "chunk long, first_id long, codes binary, tail array<long>, head array<long>, total long"


def converge(chunks: DataFrame, conv_type: str) -> DataFrame:
    """Chunks with the vectors of a run over the whole conversation, up to a constant each.

    The first pass runs all chunks at once from guesses. Later passes touch only chunks whose successor's vector is not
    the one they started from. Real turns converge within a few rows; rows that keep an offset for ever (for example all
    to be reroled) need as many passes as such chunks follow each other.
    """
    schema = f"conv {conv_type}, {_STATE}"
    along = Window.partitionBy("conv").orderBy("chunk")
    # Behind the chunk there is nothing but rows that must go, which leave vectors as they are.
    marked = chunks.withColumn("last", F.lead("chunk").over(along).isNull())
    state = materialize(marked.mapInArrow(_first_pass, schema), "repair-pass")
    while True:
        linked = state.withColumn("next_head", F.lead("head").over(along))
        stale = linked.filter("next_head is not null and next_head != tail")
        if stale.isEmpty():
            return state
        kept = linked.filter("next_head is null or next_head = tail").drop("next_head")
        state = materialize(kept.unionByName(stale.mapInArrow(_fix_up, schema)), "repair-pass")


def _entries(rows: Iterator[dict]) -> Iterator[dict]:
    """The state before each chunk of one conversation, its predecessors' exits in turn, and the last one without a chunk."""
    state = START
    for row in rows:
        yield {"conv": row["conv"], "first_id": row["first_id"], "state": state}
        state = row["exits"][state]
    yield {"conv": row["conv"], "first_id": None, "state": state}


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("codes").to_pylist(), _vectors(batch, "tail"), strict=True)
        exits = [[trace(codes, tail, q)[1] for q in range(4)] for codes, tail in pairs]
        arrays = [batch.column("conv"), batch.column("first_id"), pa.array(exits, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "first_id", "exits"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts, edits = batch.column("first_id").to_pylist(), []
        for codes, tail, state in zip(
            batch.column("codes").to_pylist(), _vectors(batch, "tail"), batch.column("state").to_pylist(), strict=True
        ):
            edits.append(trace(codes, tail, state)[0])
        ids = [first + i for first, moves in zip(firsts, edits, strict=True) for i in range(len(moves))]
        flat = [move for moves in edits for move in moves]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat, pa.string())], ["_id", "edits"])


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, _id, kind, fault) of ordered rows; fault: the first of blank, duplicate, truncated, or none.

    A row is a duplicate if its role and text were seen earlier in the conversation: the first of each (conversation,
    role, text hash) is found by a grouped minimum, and rows find themselves among these by their own number, so a text
    said over and over meets nowhere.
    """
    firsts = rows.groupBy("conv", "role", "text_hash").agg(F.min("_id").alias("_id")).select("_id", F.lit(True).alias("first"))
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    )
    return rows.select("conv", "turn", "_id", "kind", "blank", "cut").join(firsts, "_id", "left").select(
        "conv", "turn", "_id", "kind", fault.alias("fault")
    )


def repair(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_bits: int = CHUNK_BITS
) -> Repair:
    """Find faulty turns and the cheapest edits of each conversation.

    Rows are taken by turn, nulls first, then by role and text hash; rows that tie in all of them are alike. A null role
    or text reads as one space; a null conversation is one of its own, and other columns are not read. Keeping a turn
    costs 0, another role 3, deletion 4, an inserted empty turn 3, and a truncated turn that stays 3 more; blank turns and
    duplicates are deleted. Of equally cheap edits those with the ASCII-least initials (D, I, K, R) are taken. An empty
    table gives empty tables.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    last = F.right(F.rtrim(F.translate(said, "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    plain = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        said.alias("text"),
        F.unhex(F.sha2(said, 256)).alias("text_hash"),
        (~said.rlike(f"[^{BLANKS}]")).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
    ).withColumn("kind", kind)
    rows = ordered_rows(plain, ["conv", "turn", "role", "text_hash"], "repair-rows")
    conv_type = dict(rows.dtypes)["conv"]

    checked = materialize(faults(rows), "repair-faults")
    code = F.col("kind") + F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", 4).otherwise(0)
    coded = checked.withColumn("chunk", F.shiftright("_id", chunk_bits)).withColumn("code", code)
    members = F.sort_array(F.collect_list(F.struct("_id", "code")))
    # At most 2 ** chunk_bits rows of one conversation; they follow each other, so the first id gives the others.
    chunks = coded.groupBy("conv", "chunk").agg(members.alias("m"), F.min("_id").alias("first_id"), F.min("code").alias("least"))
    chunks = chunks.withColumn("letters", F.expr("transform(m, x -> lpad(hex(x.code), 2, '0'))"))
    chunks = materialize(chunks.withColumn("codes", F.unhex(F.array_join("letters", ""))).drop("letters"), "repair-chunks")

    state = converge(chunks.filter(F.col("least") < GONE).select("conv", "chunk", "first_id", "codes"), conv_type)
    exits = state.mapInArrow(_exits, f"conv {conv_type}, first_id long, exits array<int>")
    entries = materialize(
        fold_sorted(exits, "conv", ["first_id"], _entries, f"conv {conv_type}, first_id long, state int"), "repair-entries"
    )
    entered = state.join(entries.filter("first_id is not null").select("first_id", "state"), "first_id")
    edits = entered.select("first_id", "codes", "tail", "state").mapInArrow(_edits, "_id long, edits string")
    behind = F.when(F.col("state") == USER, F.array(F.lit("assistant"))).when(
        F.col("state") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))
    )
    endings = entries.filter("first_id is null").select("conv", behind.alias("inserted")).filter("inserted is not null")

    names = "transform(regexp_extract_all(edits, 'I([ua])', 1), x -> if(x = 'u', 'user', 'assistant'))"
    renamed = F.when(F.col("edits").endswith("Ru"), "user").when(F.col("edits").endswith("Ra"), "assistant").otherwise(F.col("role"))
    edit = F.regexp_extract("edits", "([DKR])[ua]?$", 1)
    turns = rows.select("conv", "turn", "role", "text", "_id").join(edits, "_id", "left").fillna({"edits": "D"})
    turns = turns.select(
        "conv", "turn", "_id", edit.alias("edit"), renamed.alias("role"), "text", F.expr(names).alias("inserted")
    )
    return Repair(turns, endings, _report(df, conv, checked, chunks, state))


def _illegal(chunks: DataFrame) -> DataFrame:
    """Per conversation: pairs of turns in a row whose roles' initials are not su, ua or au."""
    kinds = chunks.select("conv", "chunk", F.expr("transform(m, x -> x.code % 4)").alias("k"))
    following = F.lead(F.element_at("k", 1)).over(Window.partitionBy("conv").orderBy("chunk"))
    # The next chunk's first turn ends the row of pairs.
    chained = kinds.select("conv", F.when(following.isNull(), F.col("k")).otherwise(F.concat("k", F.array(following))).alias("k"))
    pairs = "size(filter(transform(k, (x, i) -> i > 0 AND (k[i - 1], x) NOT IN ((0, 1), (1, 2), (2, 1))), x -> x))"
    return chained.groupBy("conv").agg(F.sum(F.expr(pairs)).cast("long").alias("illegal"))


def _report(df: DataFrame, conv: str, checked: DataFrame, chunks: DataFrame, state: DataFrame) -> DataFrame:
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = checked.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    # The constants of all chunks, what rows in chunks without a choice cost, and the first chunk's cost from the start.
    fixed = chunks.filter(F.col("least") >= GONE).groupBy("conv").agg((F.sum(F.size("m")) * DELETE).alias("fixed"))
    start = F.min(F.struct("chunk", F.element_at("head", START + 1).alias("cost")))["cost"]
    chosen = state.groupBy("conv").agg((F.sum("total") + start).alias("chosen"))
    out = df.select(F.col(conv).alias("conv")).distinct()
    for part in (counts, _illegal(chunks), fixed, chosen):
        part = part.withColumnRenamed("conv", "_conv")
        out = out.join(part, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counted = [c for c in out.columns if c != "conv"]
    return out.fillna(0, counted).withColumn("cost", F.col("fixed") + F.col("chosen")).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digest(rows: Iterator[dict]) -> Iterator[dict]:
    digest, audit, row, begun = hashlib.sha256(), [], None, False
    for row in rows:
        audit.append(row["audit"])
        if row["lines"] is not None:
            digest.update(("\n" if begun else "").encode() + row["lines"].encode())
            begun = True
    yield {"conv": row["conv"], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def repaired_lines(found: Repair) -> DataFrame:
    """conv, place, audit (initials of the row's edits), lines (``role:text`` of the turns it gives, null for none)."""
    empty = "transform(inserted, x -> concat(x, ':'))"
    said = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    lines = F.concat_ws("\n", F.expr(empty), said)
    given = (F.size("inserted") > 0) | said.isNotNull()
    turns = found.turns.select(
        "conv", F.col("_id").alias("place"), F.concat(F.expr("repeat('I', size(inserted))"), "edit").alias("audit"),
        F.when(given, lines).alias("lines"),
    )
    behind = found.endings.select(
        "conv", F.lit((1 << 63) - 1).alias("place"), F.expr("repeat('I', size(inserted))").alias("audit"),
        F.array_join(F.expr(empty), "\n").alias("lines"),
    )
    return turns.unionByName(behind)


def repair_report(found: Repair) -> DataFrame:
    """``report`` with audit (all edits' initials in order) and repaired_sha256 (all repaired ``role:text``, newline-joined)."""
    conv_type = dict(found.report.dtypes)["conv"]
    digests = fold_sorted(
        repaired_lines(found), "conv", ["place"], _digest, f"conv {conv_type}, audit string, repaired_sha256 string"
    ).withColumnRenamed("conv", "_conv")
    out = found.report.join(digests, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    nothing: Column = F.sha2(F.lit(""), 256)
    return out.withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing))
