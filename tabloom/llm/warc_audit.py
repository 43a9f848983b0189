"""WARC fixity audit: Merkle trees over records, placed by hash of id and bytes, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import running_sums, text_or_empty
from tabloom.session import materialize

#: Records in a shard, and leaves of a tree: FANOUT to the power LEVELS, so every tree has one root.
FANOUT, LEVELS = 16, 3


def warc_record(page_id: Column, url: Column, payload: Column) -> Column:
    """The text of one WARC resource record."""
    fields = (
        ("WARC-Type", F.lit("resource")),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Target-URI", F.coalesce(url, F.lit(""))),
        ("Content-Type", F.lit("text/html")),
        ("Content-Length", F.octet_length(payload).cast("string")),
    )
    head = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("\r\n"), payload, F.lit("\r\n\r\n"))


def ledger(pages: DataFrame, label: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per record: page_id, shard, seq (in the shard), offset, length, digest (SHA-256 of its bytes).

    Records are ordered by id, then digest, and cut into shards of equal count, whatever ids repeat; nulls come first
    and count as empty text.
    """
    record = warc_record(F.col(id_col), F.col(url_col).cast("string"), text_or_empty(html_col))
    records = pages.select(F.col(id_col).alias("page_id"), record.alias("record")).select(
        "page_id",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = running_sums(records, [], ["page_id", "digest"], ["one", "length"], f"warc-{label}")
    size = FANOUT**LEVELS
    placed = placed.withColumn("shard", F.floor(F.col("before_one") / size)).withColumn("seq", F.col("before_one") % size)
    # Offsets count from the shard's first record, which is the one with the least running sum.
    starts = placed.groupBy("shard").agg(F.min("before_length").alias("start"))
    return placed.join(starts, "shard").select(
        "page_id", "shard", "seq", (F.col("before_length") - F.col("start")).alias("offset"), "length", "digest"
    )


def _entries(records: DataFrame, shards: int) -> DataFrame:
    """(shard, node, page_id, digest, n): different records with their copies counted, dealt over ``shards`` trees by hash.

    The place depends on a record's id and bytes alone, so a lost, added or longer record moves no other one, and
    records that share an id are spread.
    """
    size = FANOUT**LEVELS
    slot = F.pmod(F.xxhash64(F.col("page_id").cast("string"), "digest"), F.lit(shards * size))
    entries = records.groupBy("page_id", "digest").agg(F.count("*").alias("n"))
    return entries.select(F.floor(slot / size).alias("shard"), (slot % size).alias("node"), "page_id", "digest", "n")


def tree_levels(entries: DataFrame) -> list[DataFrame]:
    """Nodes (shard, node, digest) of each level, the leaves first and the roots last; a leaf has one record on average."""
    own = F.array_sort(F.collect_list(F.concat_ws(":", "digest", "n", F.concat(F.lit("="), F.col("page_id").cast("string")))))
    level = entries.groupBy("shard", "node").agg(F.sha2(F.concat_ws(",", own), 256).alias("digest"))
    levels = [level]
    for _ in range(LEVELS):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FANOUT at most
        told = F.concat_ws(",", F.transform(children, lambda x: F.concat_ws(":", x["node"], x["digest"])))
        level = level.groupBy("shard", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sha2(told, 256).alias("digest"))
        levels.append(level)
    return levels


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(page_id, digest, n_left, n_right) of the records that two ledgers do not hold equally often.

    Roots are compared first; each level below is compared under the mismatching nodes of the level above alone, and
    records under the mismatching leaves.
    """
    most = max(left.count(), right.count())
    shards = 1 << max(0, most // FANOUT**LEVELS).bit_length()
    entries = [materialize(_entries(x, shards), "warc-entries") for x in (left, right)]
    bad = None
    for mine, other in list(zip(*map(tree_levels, entries), strict=True))[::-1]:
        if bad is not None:
            parents = bad.select("shard", F.col("node").alias("parent"))
            mine, other = (
                x.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(parents, ["shard", "parent"], "left_semi").drop("parent")
                for x in (mine, other)
            )
        other = other.withColumnRenamed("digest", "other_digest")
        bad = mine.join(other, ["shard", "node"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("other_digest"))).select("shard", "node")
    bad = materialize(bad, "warc-leaves")
    sides = [
        x.join(bad, ["shard", "node"], "left_semi").select("page_id", "digest", *[(F.col("n") if i == j else F.lit(0).cast("long")).alias(c) for j, c in enumerate(("n_left", "n_right"))])
        for i, x in enumerate(entries)
    ]
    sums = sides[0].union(sides[1]).groupBy("page_id", "digest").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return sums.filter("n_left != n_right")


def _surplus(records: DataFrame, wrong: DataFrame, mine: str, other: str) -> DataFrame:
    """The records of one replica that the other does not have; of equal ones, the last. ``place`` counts those of an id."""
    wrong = wrong.filter(F.col(mine) > F.col(other)).select(F.col("page_id").alias("id"), F.col("digest").alias("bytes"), F.col(other).alias("matched"))
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("bytes"))
    over = records.join(wrong, same).drop("id", "bytes").withColumn("one", F.lit(1).cast("long")).withColumn("null_id", F.col("page_id").isNull())
    over = over.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    over = running_sums(over, ["null_id", "key", "digest"], ["shard", "seq"], ["one"], "warc-copies").filter("before_one >= matched").drop("before_one", "matched")
    over = running_sums(over, ["null_id", "key"], ["shard", "seq"], ["one"], "warc-surplus").withColumnRenamed("before_one", "place")
    return materialize(over.drop("one"), "warc-surplus")


def audit(left: DataFrame, right: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of both replicas: page_id, shard, seq, offset, length, digest, damaged, state.

    Each record of the first replica comes with its place there; its state is ``intact``, ``changed`` (the second
    replica has other bytes of that id) or ``missing``. Records that only the second replica has, beyond those that
    stand against a changed one, come with their place there and the state ``added``. All but intact ones are
    ``damaged``. The place of a record does not count as damage: what follows a lost, added, shorter or longer record
    stays intact.
    """
    mine = materialize(ledger(left, "left", id_col, url_col, html_col), "warc-ledger")
    other = materialize(ledger(right, "right", id_col, url_col, html_col), "warc-ledger")
    wrong = materialize(mismatches(mine, other), "warc-mismatches")
    lost, gained = _surplus(mine, wrong, "n_left", "n_right"), _surplus(other, wrong, "n_right", "n_left")
    pair = ["null_id", "key", "place"]
    changed = lost.join(gained.select(*pair, F.lit("changed").alias("state")), pair, "left")
    bad = changed.select("shard", "seq", F.coalesce("state", F.lit("missing")).alias("state"))
    place = ["page_id", "shard", "seq", "offset", "length", "digest"]
    kept = mine.join(bad, ["shard", "seq"], "left").select(*place, F.coalesce("state", F.lit("intact")).alias("state"))
    added = gained.join(lost.select(*pair), pair, "left_anti").select(*place, F.lit("added").alias("state"))
    return kept.union(added).select(*place, (F.col("state") != "intact").alias("damaged"), "state")
