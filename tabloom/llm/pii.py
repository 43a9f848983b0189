"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the entities that the base rules find, and secrets: access keys of a known format, tokens assigned to a
credential's name, and tokens of the shape of one (a long mix of digits and letters).
What stands before a seed is a lexical pattern: the two words there with their marks, or one word with an assignment
mark. Tokens with digits or @ in the same place are instances of it. Scores run to and fro over the pattern-instance
graph until they settle, and instances of trusted patterns become further spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import keyed_rows
from tabloom.session import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: Characters of a token, and of a word of a pattern.
_TOKEN, _WORD = r"\p{L}\p{N}_@+./-", r"\p{L}\p{N}_"

#: The base rules. Repeats are possessive and starts are pinned to the start of a run (or the end of the last match),
#: which finds the same matches without going back, so long runs cost linear time and no stack.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Any token with a digit or @: what patterns may discover.
    "token": rf"(?<![{_TOKEN}])(?=[{_TOKEN}]*[0-9@])[{_TOKEN}]++",
}
#: What a text must contain for its rule to be tried.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "token": "[0-9@]"}

#: Shape of a secret: hex digits or mixed letters and digits, 32 at least.
SECRET = r"^(?=.*[0-9])(?:(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}|(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_/+-]{32,})$"
#: The format of access key ids, and names whose assigned values of SECRET_LENGTH or more are secrets.
ACCESS_KEY = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"
CREDENTIAL = r"(?:^|[ _])(?:password|passwd|pwd|passphrase|secret|token|apikey|api_key|access_key)[=:]+$"
SECRET_LENGTH = 8

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What stands before a match, read backwards: marks, a word, marks, a word.
_BEFORE = rf"^([^{_WORD}]*+)([{_WORD}]++)(?:([^{_WORD}]++)([{_WORD}]++))?"

#: Change of a pattern's score below which scores have settled; what a pattern needs: score, different seeds, and the
#: share of its occurrences that are seeds.
SETTLED, TRUST, SUPPORT, SHARE = 0.01, 0.7, 3, 0.1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(F.lit(True))
    )


def _contexts(before: Column) -> Column:
    """Patterns that end where ``before`` (turned around) begins; of marks, only assignments count."""
    part = [F.regexp_extract(before, _BEFORE, i) for i in range(5)]
    marks = [F.reverse(F.regexp_replace(part[i], "[^=:#]+", "")) for i in (1, 3)]
    words = [F.lower(F.reverse(part[i])) for i in (2, 4)]
    one = F.concat(words[0], marks[0])
    two = F.concat(words[1], marks[1], F.lit(" "), one)
    return F.array_compact(F.array(F.when(words[1] != "", two), F.when((words[0] != "") & (marks[0] != ""), one)))


def _matches(kind: str, rank: int) -> Column:
    """Of one rule, per match: length of the text between it and the match before, its patterns, and its value."""
    text = F.col("text")
    between = F.split(text, RULES[kind], -1)
    values = F.regexp_extract_all(text, F.lit(RULES[kind]), F.lit(0))

    def row(value, i):
        # Matches have a word each, so two of them hold the two words before, however short the gaps are.
        pieces = [F.get(x, i - k) for k, x in ((2, between), (2, values), (1, between), (1, values), (0, between))]
        before = F.concat(*[F.coalesce(x, F.lit("")) for x in pieces])
        return F.struct(
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(F.get(between, i)).alias("gap"),
            _contexts(F.reverse(before)).alias("contexts"),
            value.alias("value"),
        )

    kind_type = "array<struct<rank:int,kind:string,i:int,gap:int,contexts:array<string>,value:string>>"
    return F.when(text.rlike(NEEDS[kind]), F.transform(values, row)).otherwise(F.array()).cast(kind_type)


def found_spans(texts: DataFrame) -> DataFrame:
    """Valid base spans, and tokens that overlap none: row_id, rank, kind, start, end, contexts, value, sure, secret.

    ``secret`` tokens are seeds; the ``sure`` ones among them (known format or name) need no pattern.
    """
    rules = F.concat(*[_matches(kind, rank) for rank, kind in enumerate(RULES)])
    spans = texts.filter(F.col("text").rlike("[0-9@]")).select("row_id", F.explode(rules).alias("m")).select("row_id", "m.*")
    before = Window.partitionBy("row_id", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    spans = spans.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    spans = spans.filter(_valid(F.col("kind"), F.col("value"))).drop("gap", "i")
    # Marks around a token are not of it.
    is_base = F.col("kind") != "token"
    lead, trail = (F.when(is_base, 0).otherwise(F.length(F.regexp_extract("value", x, 0))) for x in ("^[@+./_-]+", "[@+./_-]+$"))
    spans = spans.withColumns({"start": F.col("start") + lead, "end": F.col("end") - trail})
    spans = spans.withColumn("value", F.when(is_base, F.col("value")).otherwise(F.regexp_replace("value", "^[@+./_-]+|[@+./_-]+$", "")))
    spans = spans.filter("start < end")
    named = (F.length("value") >= SECRET_LENGTH) & F.exists("contexts", lambda x: x.rlike(CREDENTIAL))
    spans = spans.withColumn("sure", ~is_base & (F.col("value").rlike(ACCESS_KEY) | named))
    spans = spans.withColumn("secret", ~is_base & (F.col("sure") | F.col("value").rlike(SECRET)))
    columns = ("start", "end", "rank")
    onward = Window.partitionBy("row_id").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("row_id").orderBy(*[F.desc(x) for x in columns]).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("last_end", F.max(F.when(is_base, F.col("end"))).over(onward))
    spans = spans.withColumn("next_start", F.min(F.when(is_base, F.col("start"))).over(backward))
    free = (F.coalesce("last_end", F.lit(0)) <= F.col("start")) & (F.coalesce("next_start", F.col("end")) >= F.col("end"))
    return spans.filter(is_base | free).drop("last_end", "next_start")


def trusted_patterns(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns that passed (context, pattern_kind, pattern_score), and scores (value, score) of tokens that are no seeds.

    A seed scores 1. A pattern scores the mean of its occurrences' instances, with one more that scores 0; any other
    instance scores as if each of its patterns were right by chance of its score, independently. Scores start from the
    seeds and only rise, so the rounds end.
    """
    seed = F.when(F.col("kind") != "token", F.col("kind")).when(F.col("secret"), "secret")
    occurrences = spans.select(F.explode("contexts").alias("context"), "value", seed.alias("seed"))
    edges = occurrences.groupBy("context", "value", "seed").agg(F.count("*").alias("n"))
    seeded = F.col("seed").isNotNull()
    values = edges.groupBy("value").agg(F.max(seeded).alias("seeded"), F.count("*").alias("degree"))
    edges = materialize(edges.join(values, "value"), "pii-edges")
    # Tokens with one pattern score as it does, which is solved for at once; the rounds need those with several.
    alone = ~F.col("seeded") & (F.col("degree") == 1)
    totals = edges.groupBy("context").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("alone"),
        F.sum(F.when(F.col("seeded"), F.col("n")).otherwise(0)).alias("sure"),
        F.sum(seeded.cast("long")).alias("support"),
        (F.sum(F.when(seeded, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"),
        *[F.sum(F.when(F.col("seed") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS],
    )
    totals = materialize(totals, "pii-totals")
    links = materialize(edges.filter(~F.col("seeded") & (F.col("degree") > 1)).select("context", "value", "n"), "pii-links")

    def scored(patterns: DataFrame, pairs: DataFrame) -> DataFrame:
        wrong = F.sum(F.log1p(-F.least(F.col("pattern_score"), F.lit(0.999))))
        return pairs.join(patterns, "context").groupBy("value").agg((1 - F.exp(wrong)).alias("score"))

    def score(added: Column) -> Column:
        return ((F.col("sure") + added) / (F.col("n") + 1 - F.col("alone"))).alias("pattern_score")

    first = totals.join(links.select("context").distinct(), "context").select("context", "n", "sure", "alone")
    linked = materialize(first.select("*", score(F.lit(0.0))), "pii-patterns")
    change = 1.0
    while change > SETTLED:
        scores = scored(linked.select("context", "pattern_score"), links)
        sums = links.withColumnRenamed("n", "times").join(scores, "value").groupBy("context").agg(F.sum(F.col("times") * F.col("score")).alias("added"))
        both = linked.withColumnRenamed("pattern_score", "last_score").join(sums, "context")
        both = materialize(both.select("context", "n", "sure", "alone", score(F.col("added")), "last_score"), "pii-patterns")
        change = both.agg(F.max(F.col("pattern_score") - F.col("last_score"))).first()[0] or 0.0
        linked = both.drop("last_score")
    settled = linked.select("context", F.col("pattern_score").alias("linked_score"))
    patterns = totals.join(settled, "context", "left").withColumn("own_score", score(F.lit(0.0)))
    patterns = patterns.withColumn("pattern_score", F.coalesce("linked_score", "own_score")).drop("linked_score", "own_score")
    patterns = materialize(patterns, "pii-patterns")
    scores = scored(patterns.select("context", "pattern_score"), edges.filter(~F.col("seeded")))
    most = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i")) for i, k in enumerate(KINDS)]))
    kind = F.get(F.array(*map(F.lit, KINDS)), -most["i"])
    passed = (F.col("pattern_score") >= TRUST) & (F.col("support") >= SUPPORT) & (F.col("share") >= SHARE)
    return patterns.filter(passed).select("context", kind.alias("pattern_kind"), "pattern_score"), scores


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans.

    Counts and the digest are of the base rules; ``spans`` has the ``n_found`` further ones too, as kind:start:end in
    code points, ``n_spans`` in all. A further one is of the kind of most seeds of its best pattern, or a secret by its
    shape, format or name. Null and empty texts have none; rows that repeat an id, or have none, are rows of their own. Other
    columns are not read.
    """
    texts, names = keyed_rows(docs, id_col, text_col)
    spans = materialize(found_spans(texts), "pii-spans")
    patterns, scores = trusted_patterns(spans)
    base = spans.filter("kind != 'token'").select("row_id", "rank", "kind", "start", "end", F.lit(True).alias("base"))
    tokens = spans.filter("kind = 'token'").select("row_id", "start", "end", "secret", "value", F.explode("contexts").alias("context"))
    # Values without a score are seeds.
    tokens = tokens.join(patterns, "context").join(scores, "value", "left").filter(F.coalesce("score", F.lit(1.0)) >= TRUST)
    best = F.struct("pattern_score", "context", "pattern_kind").alias("best")
    sure = spans.filter("sure").select("row_id", "start", "end", "secret").withColumn("best", F.lit(None))
    tokens = tokens.select("row_id", "start", "end", "secret", best).union(sure)
    kind = F.when(F.max("secret"), "secret").otherwise(F.max("best")["pattern_kind"])
    found = tokens.groupBy("row_id", "start", "end").agg(kind.alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    more = found.select("row_id", rank.alias("rank"), "kind", "start", "end", F.lit(False).alias("base"))
    every = base.union(more).withColumn("name", F.concat_ws(":", "kind", "start", "end"))
    entry = F.struct("start", "rank", "end", "name")
    sorted_names = [F.concat_ws(",", F.array_sort(F.collect_list(x))["name"]) for x in (F.when(F.col("base"), entry), entry)]
    grouped = every.groupBy("row_id").agg(
        *[F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in BASE_KINDS],
        sorted_names[0].alias("base_names"),
        sorted_names[1].alias("spans"),
        F.sum((~F.col("base")).cast("long")).alias("n_found"),
        F.count("*").alias("n_spans"),
    )
    ids = texts.select("row_id") if names is None else names
    out = ids.join(grouped, "row_id", "left").select(
        *ids.columns,
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.coalesce("base_names", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_found", "n_spans")],
    )
    return out.withColumnRenamed("row_id", "doc_id") if names is None else out.drop("row_id")
