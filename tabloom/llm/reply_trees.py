"""Chat formatting: reply trees, their best branches, and a template that can be read back.

Messages reply to messages. Iterative self-joins by doubling (each join looks twice as far up) give every message its
root, depth and score sum, and then list the path of each chosen leaf; a path of n messages takes log2(n) joins. Branches
are ranked by mean score, and each chosen path is formatted as one conversation, one segment per message, so that no
conversation has to fit into a cell.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.ordered import fold_sorted, ordered_rows, with_previous
from tabloom.session import materialize

# The template's marks. A segment is its opening mark, a space, the escaped text, a space, its closing mark.
HEAD = "<s>"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
OTHER_MARKS = ("[ROLE ", "]", "[/ROLE]")
#: The role whose text a model is trained on.
LEARNED = "assistant"
#: What could be read as a mark inside a text; one more backslash goes behind its bracket, and comes off when read back.
CONTROL = r"([<\[])(\\*/?(?:s>|SYS|INST|ANS|ROLE))"
ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|SYS|INST|ANS|ROLE))")
SEGMENT = re.compile(
    r"(?:\[SYS\] (?P<system>.*) \[/SYS\]|\[INST\] (?P<user>.*) \[/INST\]|\[ANS\] (?P<assistant>.*) </s>"
    r"|\[ROLE (?P<role>[0-9A-F]*)\] (?P<text>.*) \[/ROLE\])",
    re.DOTALL,
)

#: Parts that the branches of one tree are dealt to before they are ranked.
RANK_PARTS = 32


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def segment(role: Column, text: Column) -> Column:
    """The formatted message."""
    plain = escape(text)
    known = F.lit(None).cast("string")
    for name, (before, after) in MARKS.items():
        known = F.when(role == name, F.concat(F.lit(f"{before} "), plain, F.lit(f" {after}"))).otherwise(known)
    before, closed, after = OTHER_MARKS
    other = F.concat(F.lit(before), F.hex(F.encode(role, "UTF-8")), F.lit(f"{closed} "), plain, F.lit(f" {after}"))
    return F.coalesce(known, other)


def read_segment(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted message."""
    found = SEGMENT.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted message")
    for name in MARKS:
        if found[name] is not None:
            return name, unescape(found[name])
    return bytes.fromhex(found["role"]).decode(), unescape(found["text"])


def linear_nodes(rows: DataFrame, tree: str, turn: str) -> DataFrame:
    """tree, node, parent of plain conversations: the turn number names the message, the number before it its parent."""
    turns = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("node")).distinct()
    placed = ordered_rows(turns, ["tree", "node"], "reply-turns")
    chained = with_previous(placed, "tree")
    parents = placed.select(F.col("_id").alias("_previous"), F.struct("node").alias("parent"))
    return chained.join(parents, "_previous", "left").select("tree", F.struct("node").alias("node"), "parent")


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """Store tree, node, _id, up (``_id`` of the message it replies to, or null), score: one row per (tree, node).

    A message comes after the one that it replies to, in the order of ``node`` inside its tree. A parent that is
    missing, in another tree, or not earlier (so also any circle of replies) makes the message a root: no message is lost.
    """
    whole = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    placed = ordered_rows(whole, ["tree", "node"], "reply-nodes")
    parents = placed.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("_id").alias("up"))
    match = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_node")) & (F.col("up") < F.col("_id"))
    linked = placed.join(parents, match, "left")
    return materialize(linked.select("tree", "node", "_id", "up", F.coalesce("score", F.lit(0.0)).alias("score")), "reply-links")


def doubled(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(_id, hops, total) of each message's whole way to its root, and tables (_id, up): 1, 2, 4 ... messages further up.

    Messages whose way has reached the root are done and join no more.
    """
    ways = links.select("_id", "up", F.lit(1).cast("long").alias("hops"), F.col("score").alias("total"))
    levels, done = [], []
    while True:
        open_ways = ways.filter("up is not null")
        if open_ways.isEmpty():
            break
        levels.append(open_ways.select("_id", "up"))
        done.append(ways.filter("up is null").drop("up"))
        # A way that is looked up may be a finished one, so all levels' finished ways take part.
        known = ways
        for part in done[:-1]:
            known = known.unionByName(part.withColumn("up", F.lit(None).cast("long")))
        further = known.select(
            F.col("_id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("total").alias("_total")
        )
        further = open_ways.join(further, "up").select(
            "_id", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("total") + F.col("_total")).alias("total")
        )
        ways = materialize(further, "reply-ways")
    out = ways.drop("up")
    for part in done:
        out = out.unionByName(part)
    return out, levels


def chosen_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """tree, node, path (``_id`` of the leaf), rank, place (from 0): the messages of the ``best`` branches of each tree.

    ``nodes``: tree, node, parent, score. A branch's score is the mean of its messages' (null: 0); ties go to the leaf
    that comes first. Branches are ranked in parts of each tree first, so one huge tree does not meet in one task.
    """
    links = numbered_nodes(nodes)
    ways, levels = doubled(links)
    parents = links.filter("up is not null").select(F.col("up").alias("_id")).distinct()
    leaves = links.join(parents, "_id", "left_anti").join(ways, "_id")
    leaves = leaves.select("tree", F.col("_id").alias("path"), "hops", (F.col("total") / F.col("hops")).alias("mean"))
    order = [F.col("mean").desc(), F.col("path")]
    part = Window.partitionBy("tree", F.pmod(F.xxhash64("path"), F.lit(RANK_PARTS))).orderBy(*order)
    leaves = leaves.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= best)
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    leaves = materialize(leaves.filter(F.col("rank") <= best).select("path", "hops", "rank"), "reply-leaves")

    pairs = leaves.select("path", F.col("path").alias("_id"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(levels))):
        above = pairs.join(levels[k], "_id").select("path", F.col("up").alias("_id"), (F.col("back") + (1 << k)).alias("back"))
        pairs = materialize(pairs.unionByName(above), "reply-paths")
    placed = pairs.join(leaves, "path").select("path", "rank", "_id", (F.col("hops") - 1 - F.col("back")).alias("place"))
    return placed.join(links.select("_id", "tree", "node"), "_id").select("tree", "node", "path", "rank", "place")


def format_trees(messages: DataFrame, nodes: DataFrame, best: int = 1) -> DataFrame:
    """tree, path, rank, place, role, segment, loss_start, loss_chars: the formatted messages of the best branches.

    ``messages``: tree, node, role, text; ``nodes``: tree, node, parent, score (null score: 0). The conversation of a
    path is its segments on end, in the order of place, role and segment; its first one (place -1) is the head mark.
    Under the loss mask are ``loss_chars`` code points from ``loss_start`` on of an assistant's segment, null elsewhere.
    Rows that share tree and node are all said, one after the other. A null role or text is empty, a null
    tree or node is one of its own, and other columns are not read. No messages give no segments.
    """
    paths = materialize(chosen_paths(nodes, best), "reply-chosen")
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.select("tree", "node", "role", segment(F.col("role"), F.col("text")).alias("segment"))
    # Every message finds its places by (tree, node): a huge tree is spread over all tasks here.
    at = paths.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "path", "rank", "place")
    joined = said.join(at, F.col("tree").eqNullSafe(F.col("_tree")) & F.col("node").eqNullSafe(F.col("_node")))
    before, after = MARKS[LEARNED]
    start = F.when(F.col("role") == LEARNED, F.lit(len(before) + 1))
    chars = F.when(F.col("role") == LEARNED, F.length("segment") - len(before) - len(after) - 2)
    body = joined.select("tree", "path", "rank", "place", "role", "segment", start.alias("loss_start"), chars.alias("loss_chars"))
    head = paths.filter("place = 0").select(
        "tree", "path", "rank", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.lit(HEAD).alias("segment"),
        F.lit(None).cast("int").alias("loss_start"), F.lit(None).cast("int").alias("loss_chars"),
    )
    return body.unionByName(head)


def _read_back(rows: Iterator[dict]) -> Iterator[dict]:
    turns, loss, row = hashlib.sha256(), hashlib.sha256(), None
    n = learned = total = 0
    for row in rows:
        total += len(row["segment"])
        if row["place"] < 0:
            continue
        role, text = read_segment(row["segment"])
        turns.update(f"{role}\n{text}\n".encode())
        n += 1
        if row["loss_start"] is not None:
            masked = unescape(row["segment"][row["loss_start"] : row["loss_start"] + row["loss_chars"]])
            loss.update(masked.encode())
            learned += len(masked)
    yield {
        "tree": row["tree"], "path": row["path"], "n_turns": n, "turns_sha256": turns.hexdigest(),
        "loss_chars": learned, "loss_sha256": loss.hexdigest(), "formatted_chars": total,
    }


def read_back(segments: DataFrame) -> DataFrame:
    """One row per formatted conversation, read back from its segments: tree, path, n_turns, turns_sha256 (role, newline,
    text, newline per turn), loss_chars, loss_sha256 (text under the loss mask), formatted_chars."""
    kind = dict(segments.dtypes)["tree"]
    return fold_sorted(
        segments, "path", ["place", "role", "segment"], _read_back,
        f"tree {kind}, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``format_trees`` of plain conversations: one branch each, turns in order (nulls first)."""
    messages = rows.select(
        F.col(conv).alias("tree"), F.struct(F.col(turn).alias("node")).alias("node"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    nodes = linear_nodes(rows, conv, turn).withColumn("score", F.lit(0.0))
    return format_trees(messages, nodes)
