"""The registered queries as plain DuckDB SQL over the same tables.

Written from the operators' definitions, not from their Spark plans: windows
over whole tables, cross joins and correlated sums are fine here because the
checks run on small data.
"""

from __future__ import annotations

from ..operators.prompts import DESCRIPTIONS_LINE, INSTRUCTIONS
from ..sources import specs as S
from .queries import LINES_PER_REPLY
from .views import VIEWS

NUMBER = r"(?i)\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*"
BLANKS = "E' \\t\\n\\r\\f\\v'"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABET = LETTERS + "0123456789"


def q(name: str) -> str:
    return '"' + name + '"'


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(ctes: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + body


def text_columns(name: str) -> set[str]:
    """Columns that the view holds as text."""
    declared = set(VIEWS[name][3])
    if name == "adult":
        declared |= set(S.ADULT_CATEGORICAL)
    return declared


def number(name: str, column: str) -> str:
    if column in text_columns(name):
        return f"(CASE WHEN regexp_full_match({q(column)}, '{NUMBER}') THEN TRY_CAST(trim({q(column)}) AS DOUBLE) END)"
    return f"CAST({q(column)} AS DOUBLE)"


def view_cte(name: str) -> tuple[str, str]:
    _, base, fields, _ = VIEWS[name]
    source = "orders JOIN customer ON o_custkey = c_custkey" if name != "heloc" else "orders"
    inner = ", ".join(f"{e} AS {n}" for n, e in base.items())
    outer = ", ".join(f"{e} AS {q(n)}" for n, e in fields.items())
    return f"{name}_view", f"SELECT {outer} FROM (SELECT {inner} FROM {source}) s"


def num_cte(name: str) -> tuple[str, str]:
    """Numeric reading of every integer column; text columns as they are."""
    spec = VIEWS[name][0]
    cells = [
        f"{number(name, n)} AS {q(n)}" if n in spec.integers else q(n) for n in spec.columns
    ]
    return f"{name}_num", f"SELECT _row_id, {', '.join(cells)} FROM {name}_view"


# --- rules ------------------------------------------------------------------------------------


def whole(x: str) -> str:
    return f"(abs({x} - round_even({x}, 0)) <= 1e-8 + 1e-5 * abs(round_even({x}, 0)))"


def credit_rule_list() -> list[tuple[str, str, str]]:
    out = [("LIMIT_BAL_min", '"LIMIT_BAL" >= 1', "LIMIT_BAL takes numbers of 1 and up.")]
    for n, values in S.CREDIT_DOMAINS.items():
        out.append((f"{n}_domain", f"{whole(q(n))} AND {q(n)} IN {values}", f"{n} takes whole numbers out of {values} only."))
    out.append(("AGE_range", '"AGE" BETWEEN 18 AND 100', "AGE takes numbers from 18 to 100."))
    for n in S.CREDIT_STATUS:
        out.append(
            (f"{n}_status_domain", f"{whole(q(n))} AND {q(n)} BETWEEN -2 AND 9",
             f"{n} holds a repayment status, whole, -2 to 9.")
        )
    for n in S.CREDIT_PAYMENTS:
        out.append((f"{n}_min", f"{q(n)} >= 0", f"{n} takes numbers of 0 and up."))
    n = S.CREDIT_LABEL
    out.append((f"{n}_domain", f"{whole(q(n))} AND {q(n)} IN (0, 1)", f"{n} takes whole numbers out of (0, 1) only."))
    return out


def education_number(source: str = "education") -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.ADULT_EDUCATION_NUM.items())
    return f"(CASE {source} {cases} END)"


def adult_rule_list() -> list[tuple[str, str, str]]:
    return [
        ("age_range", "age BETWEEN 16 AND 100", "age takes numbers from 16 to 100."),
        ("education-num_range", '"education-num" BETWEEN 1 AND 16', "education-num takes numbers from 1 to 16."),
        ("hours-per-week_range", '"hours-per-week" BETWEEN 1 AND 99', "hours-per-week takes numbers from 1 to 99."),
        ("capital-gain_min", '"capital-gain" >= 0', "capital-gain takes numbers of 0 and up."),
        ("capital-loss_min", '"capital-loss" >= 0', "capital-loss takes numbers of 0 and up."),
        ("education_num_consistency", f'{education_number()} = "education-num"',
         "education-num is the number that the census gives to education."),
        ("income_domain", f"trim(income, {BLANKS}) IN ('<=50K', '>50K', '<=50K.', '>50K.')",
         "income is written as one of <=50K, >50K."),
    ]


HELOC_CEILINGS = {
    "ExternalRiskEstimate": 100, "PercentTradesNeverDelq": 100, "PercentInstallTrades": 100,
    "PercentTradesWBalance": 100, "NetFractionRevolvingBurden": 300, "NetFractionInstallBurden": 300,
    "MaxDelq2PublicRecLast12M": 9, "MaxDelqEver": 9,
    "MSinceOldestTradeOpen": 1000, "MSinceMostRecentTradeOpen": 1000, "AverageMInFile": 1000,
    "NumSatisfactoryTrades": 500, "NumTrades60Ever2DerogPubRec": 500, "NumTrades90Ever2DerogPubRec": 500,
    "MSinceMostRecentDelq": 1000, "NumTotalTrades": 500, "NumTradesOpeninLast12M": 500,
    "MSinceMostRecentInqexcl7days": 1000, "NumInqLast6M": 500, "NumInqLast6Mexcl7days": 500,
    "NumRevolvingTradesWBalance": 500, "NumInstallTradesWBalance": 500,
    "NumBank2NatlTradesWHighUtilization": 500,
}


def heloc_rule_list() -> list[tuple[str, str, str]]:
    out = [("RiskPerformance_domain", f"trim(\"RiskPerformance\", {BLANKS}) IN ('Good', 'Bad')",
            "RiskPerformance is written as Good or Bad.")]
    for n, high in HELOC_CEILINGS.items():
        out.append(
            (f"{n}_heloc_domain", f"{whole(q(n))} AND ({q(n)} IN (-9, -8, -7) OR {q(n)} BETWEEN 0 AND {high})",
             f"{n} holds one of the special codes (-9, -8, -7) or a whole number from 0 to {high}.")
        )
    for a, b in S.HELOC_PAIRS:
        free = " OR ".join(f"coalesce({q(x)} IN (-9, -8, -7), false)" for x in (a, b))
        out.append((f"{a}_le_{b}", f"{free} OR {q(a)} <= {q(b)}",
                    f"{a} does not exceed {b}, special codes of HELOC aside."))
    return out


def lineitem_rule_list() -> list[tuple[str, str, str]]:
    return [
        ("l_quantity_range", "l_quantity BETWEEN 1 AND 45", "l_quantity takes numbers from 1 to 45."),
        ("l_extendedprice_min", "l_extendedprice >= 2000", "l_extendedprice takes numbers of 2000 and up."),
        ("l_discount_range", "l_discount BETWEEN 0 AND 0.08::DOUBLE", "l_discount takes numbers from 0 to 0.08."),
        ("l_tax_range", "l_tax BETWEEN 0 AND 0.07::DOUBLE", "l_tax takes numbers from 0 to 0.07."),
        ("l_linenumber_domain", "l_linenumber IN (1, 2, 3, 4, 5, 6)", "l_linenumber takes whole numbers out of (1, 2, 3, 4, 5, 6) only."),
        ("l_returnflag_domain", "l_returnflag IN ('A', 'N')", "l_returnflag is written as A or N."),
        ("l_linestatus_domain", "l_linestatus IN ('F', 'O')", "l_linestatus is written as F or O."),
    ]


RULES = {"credit": credit_rule_list, "adult": adult_rule_list, "heloc": heloc_rule_list, "lineitem": lineitem_rule_list}


def flags_cte(name: str) -> tuple[str, str]:
    source, key = ("lineitem", "") if name == "lineitem" else (f"{name}_num", "_row_id, ")
    cells = ", ".join(f"NOT coalesce({e}, false) AS {q(n)}" for n, e, _ in RULES[name]())
    return f"{name}_flags", f"SELECT {key}{cells} FROM {source}"


def checked(name: str) -> list[tuple[str, str]]:
    return [flags_cte(name)] if name == "lineitem" else [view_cte(name), num_cte(name), flags_cte(name)]


def summary_body(name: str, flags: str) -> str:
    names = [n for n, _, _ in RULES[name]()]
    k = len(names)
    per_row = " + ".join(f"{q(n)}::INT" for n in names)
    broken = " + ".join(f"(count(*) FILTER ({q(n)}) > 0)::INT" for n in names)
    return (
        f"SELECT count(*)::BIGINT AS n_rows, {k}::BIGINT AS n_constraints, "
        f"round(sum({per_row})::DOUBLE / (count(*) * {k}), 6) AS cvr, "
        f"round(({broken})::DOUBLE / {k}, 6) AS cvc, "
        f"round(avg(({per_row})::DOUBLE / {k}), 6) AS scvc, "
        f"round(avg((({per_row}) > 0)::INT), 6) AS row_violation_coverage FROM {flags}"
    )


def summary(name: str) -> str:
    return with_(checked(name), summary_body(name, f"{name}_flags"))


def detail(name: str) -> str:
    parts = [
        f"SELECT {lit(n)} AS \"constraint\", count(*) FILTER ({q(n)})::BIGINT AS violations, "
        f"round(count(*) FILTER ({q(n)})::DOUBLE / count(*), 6) AS violation_rate, {lit(d)} AS description "
        f"FROM {name}_flags"
        for n, _, d in RULES[name]()
    ]
    return with_(checked(name), " UNION ALL ".join(parts))


def violations(name: str) -> str:
    names = [n for n, _, _ in RULES[name]()]
    texts = ", ".join(f"CASE WHEN {q(n)} THEN {lit(n)} END" for n in names)
    total = " + ".join(f"{q(n)}::BIGINT" for n in names)
    return with_(
        checked(name),
        f"SELECT _row_id, concat_ws(',', {texts}) AS violated, ({total})::BIGINT AS n_violated FROM {name}_flags",
    )


def any_flag(name: str) -> str:
    return "(" + " OR ".join(q(n) for n, _, _ in RULES[name]()) + ")"


def rejected(name: str) -> str:
    return with_(
        checked(name), f"SELECT v.* FROM {name}_view v JOIN {name}_flags f USING (_row_id) WHERE NOT {any_flag(name)}"
    )


# --- typed tables and repairs -----------------------------------------------------------------


def typed_cte(name: str) -> tuple[str, str]:
    spec = VIEWS[name][0]
    cells = [
        f"TRY_CAST(round_even({q(n)}, 0) AS BIGINT) AS {q(n)}" if n in spec.integers else q(n) for n in spec.columns
    ]
    return f"{name}_typed", f"SELECT _row_id, {', '.join(cells)} FROM {name}_num"


def clip(x: str, low: int, high: int | None) -> str:
    inner = f"greatest(round_even(coalesce({x}, {low})::DOUBLE, 0), {low})"
    return f"CAST({inner if high is None else f'least({inner}, {high})'} AS BIGINT)"


def cleaned(x: str) -> str:
    return f"rtrim(trim({x}, {BLANKS}), '.')"


def repair_ctes(name: str, source: str, target: str) -> list[tuple[str, str]]:
    """CTEs that repair ``source`` (numeric reading per column) into ``target``."""
    if name == "credit":
        limits: dict[str, tuple[int, int | None]] = {"LIMIT_BAL": (1, None), "AGE": (18, 100), S.CREDIT_LABEL: (0, 1)}
        limits |= {n: (min(v), max(v)) for n, v in S.CREDIT_DOMAINS.items()}
        limits |= {n: (-2, 9) for n in S.CREDIT_STATUS} | {n: (0, None) for n in S.CREDIT_PAYMENTS}
        cells = ", ".join(f"{clip(q(n), *b)} AS {q(n)}" for n, b in limits.items())
        bills = ", ".join(f"{q(n)}::BIGINT AS {q(n)}" for n in S.CREDIT_BILLS)
        return [(target, f"SELECT * REPLACE ({cells}, {bills}) FROM {source}")]
    if name == "adult":
        limits = {"age": (16, 100), "hours-per-week": (1, 99), "capital-gain": (0, None), "capital-loss": (0, None)}
        cells = ", ".join(f"{clip(q(n), *b)} AS {q(n)}" for n, b in limits.items())
        known = f"coalesce({education_number()}::BIGINT, {clip(q('education-num'), 1, 16)})"
        label = cleaned("income")
        return [(
            target,
            f"SELECT * REPLACE ({cells}, {known} AS \"education-num\", fnlwgt::BIGINT AS fnlwgt, "
            f"CASE WHEN {label} IN ('<=50K', '>50K') THEN {label} ELSE '<=50K' END AS income) FROM {source}",
        )]
    cells = []
    for n, high in HELOC_CEILINGS.items():
        top = 1000 if high == 500 else high
        cells.append(
            f"CASE WHEN round_even({q(n)}::DOUBLE, 0) IN (-9, -8, -7) THEN round_even({q(n)}::DOUBLE, 0)::BIGINT "
            f"ELSE {clip(q(n), 0, top)} END AS {q(n)}"
        )
    label = f"lower({cleaned(q('RiskPerformance'))})"
    cells.append(f"CASE WHEN {label} IN ('good', '0', 'false') THEN 'Good' ELSE 'Bad' END AS \"RiskPerformance\"")
    ctes = [(f"{target}_0", f"SELECT * REPLACE ({', '.join(cells)}) FROM {source}")]
    for i, (a, b) in enumerate(S.HELOC_PAIRS, start=1):
        step = (
            f"SELECT * REPLACE (CASE WHEN {q(a)} NOT IN (-9, -8, -7) AND {q(b)} NOT IN (-9, -8, -7) AND {q(a)} > {q(b)} "
            f"THEN {q(b)} ELSE {q(a)} END AS {q(a)}) FROM {target}_{i - 1}"
        )
        ctes.append((target if i == len(S.HELOC_PAIRS) else f"{target}_{i}", step))
    return ctes


def repaired_view(name: str) -> str:
    return with_([view_cte(name), num_cte(name), *repair_ctes(name, f"{name}_num", "done")], "SELECT * FROM done")


def roles(name: str) -> list[tuple[str, str]]:
    """CTEs up to ``<name>_real``, ``<name>_raw`` and ``<name>_fixed``."""
    both = f"SELECT t.* FROM {name}_typed t JOIN {name}_flags f USING (_row_id) WHERE "
    return [
        *checked(name),
        typed_cte(name),
        (f"{name}_real", f"{both} NOT {any_flag(name)}"),
        (f"{name}_raw", f"{both} {any_flag(name)}"),
        *repair_ctes(name, f"{name}_raw", f"{name}_fixed"),
    ]


def revision(name: str) -> str:
    spec = VIEWS[name][0]
    changed = []
    for n in spec.columns:
        a, b = f"b.{q(n)}", f"a.{q(n)}"
        if n in spec.integers:
            same = f"abs({a} - {b}) <= 1e-8 + 1e-5 * abs({b})"
        else:
            same = f"{a} = {b}"
        changed.append(f"(NOT (coalesce({same}, false) OR ({a} IS NULL AND {b} IS NULL)))::BIGINT")
    k = len(changed)
    body = (
        f"SELECT n::BIGINT AS n_rows_before, n::BIGINT AS n_rows_after, {k}::BIGINT AS n_columns_compared, "
        f"(n * {k})::BIGINT AS compared_cells, cells::BIGINT AS revised_cells, touched::BIGINT AS revised_rows, "
        f"round(cells::DOUBLE / (n * {k}), 6) AS cell_revision_rate, round(touched::DOUBLE / n, 6) AS row_revision_rate, "
        "0.0::DOUBLE AS dropped_row_rate, 0.0::DOUBLE AS added_row_rate FROM "
        "(SELECT count(*) AS n, sum(c) AS cells, count(*) FILTER (c > 0) AS touched FROM "
        f"(SELECT {' + '.join(changed)} AS c FROM {name}_typed b JOIN done a USING (_row_id)) x) y"
    )
    return with_([view_cte(name), num_cte(name), typed_cte(name), *repair_ctes(name, f"{name}_typed", "done")], body)


def infer(name: str) -> str:
    spec = VIEWS[name][0]
    parts = []
    for n in spec.columns:
        where = f" WHERE (SELECT count(DISTINCT {q(n)}) FROM {name}_typed) <= 20" if n in spec.integers else ""
        parts.append(f"SELECT {lit(n)} AS \"column\"{where}")
    return with_([view_cte(name), num_cte(name), typed_cte(name)], " UNION ALL ".join(parts))


# --- likeness ---------------------------------------------------------------------------------


def tvd_of(column: str, real: str, synth: str) -> str:
    share = "SELECT {c}::VARCHAR AS v, count(*)::DOUBLE / (SELECT count(*) FROM {t}) AS p FROM {t} GROUP BY 1"
    r, s = share.format(c=q(column), t=real), share.format(c=q(column), t=synth)
    return (
        f"(SELECT 0.5 * sum(abs(coalesce(r.p, 0) - coalesce(s.p, 0))) FROM ({r}) r FULL JOIN ({s}) s "
        "ON r.v IS NOT DISTINCT FROM s.v)"
    )


def ks_of(column: str, real: str, synth: str) -> str:
    n = q(column)
    return (
        "(SELECT coalesce(max(abs(cr / nullif(nr, 0) - cs / nullif(ns, 0))), 1.0) FROM ("
        "SELECT sum(r) OVER (ORDER BY v) AS cr, sum(s) OVER (ORDER BY v) AS cs, sum(r) OVER () AS nr, sum(s) OVER () AS ns "
        f"FROM (SELECT v, sum(r)::DOUBLE AS r, sum(s)::DOUBLE AS s FROM (SELECT {n}::DOUBLE AS v, 1 AS r, 0 AS s FROM {real} "
        f"UNION ALL SELECT {n}::DOUBLE, 0, 1 FROM {synth}) u WHERE v IS NOT NULL GROUP BY v) g) w)"
    )


def similarity_rows(name: str) -> str:
    spec = VIEWS[name][0]
    parts = []
    for n in spec.columns:
        by_value = n in spec.categorical or n not in spec.integers
        kind, f = ("categorical_tvd", tvd_of) if by_value else ("numeric_ks", ks_of)
        parts.append(f"SELECT {lit(n)} AS \"column\", '{kind}' AS type, {f(n, f'{name}_real', f'{name}_fixed')} AS d")
    return " UNION ALL ".join(parts)


def similarity(name: str) -> str:
    return with_(
        [*roles(name), ("sim", similarity_rows(name))],
        'SELECT "column", type, round(d, 6) AS distance, round(greatest(0.0, 1.0 - d), 6) AS similarity FROM sim',
    )


def auc(counted: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {group}round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc, "
        f"sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM (SELECT *, sum(n) OVER ({part}ORDER BY s) - n AS below "
        f"FROM ({counted}) c) r{tail}"
    )


def distance_rows(name: str) -> list[tuple[str, str]]:
    spec = VIEWS[name][0]
    terms, limits = [], []
    names = [n for n in spec.columns if n != spec.label]
    for i, n in enumerate(names):
        if n in spec.categorical or n not in spec.integers:
            terms.append(f"(s.{q(n)} IS DISTINCT FROM r.{q(n)})::INT::DOUBLE")
        else:
            limits.append(f"min({q(n)})::DOUBLE AS lo{i}, max({q(n)})::DOUBLE AS hi{i}")
            width = f"(CASE WHEN hi{i} > lo{i} THEN hi{i} - lo{i} ELSE 1.0 END)"
            gap = f"(coalesce(s.{q(n)}, lo{i}) - coalesce(r.{q(n)}, lo{i})) / {width}"
            terms.append(f"({gap}) * ({gap})")
    return [
        *roles(name),
        ("lim", f"SELECT {', '.join(limits)} FROM {name}_real"),
        (
            "dcr",
            f"SELECT s._row_id, sqrt(min({' + '.join(terms)}) / {len(names)}) AS dcr "
            f"FROM {name}_fixed s, {name}_real r, lim GROUP BY s._row_id",
        ),
    ]


# --- random order, draws and noise ------------------------------------------------------------


def hashed(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def word(h: str, i: int = 0) -> str:
    return f"('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT"


def unit(h: str, i: int) -> str:
    return f"(({word(h, i)} + 0.5) / 4294967296.0::DOUBLE)"


def normal(h: str, i: int) -> str:
    first = 0 if i < 2 else 2
    radius = f"sqrt(-2.0::DOUBLE * ln({unit(h, first)}))"
    angle = f"6.283185307179586::DOUBLE * {unit(h, first + 1)}"
    return f"({radius} * {'cos' if i % 2 == 0 else 'sin'}({angle}))"


def ranked_cte(source: str, seed: int, by: str = "") -> tuple[str, str]:
    part = f"PARTITION BY {by} " if by else ""
    return "ranked", (
        f"SELECT *, row_number() OVER ({part}ORDER BY {hashed('_row_id', str(seed))}, _row_id) - 1 AS _index FROM {source}"
    )


def split(test: bool) -> str:
    compare = "<" if test else ">="
    body = (
        "SELECT * EXCLUDE (_index) FROM ranked WHERE _index "
        f"{compare} (SELECT round_even(count(*) * 0.2::DOUBLE, 0) FROM credit_real)"
    )
    return with_([*roles("credit"), ranked_cte("credit_real", 42)], body)


def drawn(label: str, rounds: int, sets: int, k: int, seed: int) -> list[tuple[str, str]]:
    """CTE ``draws`` over ``ranked``: class-balanced row ids."""
    wide = "('0x' || substr(" + hashed('"r"', '"s"', "class", "x[1]", str(seed)) + ", 1, 15))::BIGINT"
    again = word(hashed('"r"', '"s"', "class", "d", str(seed)))
    last = f"(size - {k} + x[1])"
    spot = f"({wide} % ({last} + 1))"
    subset = (
        f"list_reduce(list_prepend([]::BIGINT[], list_transform(range({k}), lambda d: [d])), "
        f"lambda taken, x: list_append(taken, CASE WHEN list_contains(taken, {spot}) THEN {last} ELSE {spot} END))"
    )
    return [
        ("sizes", f"SELECT {label} AS class, count(*) AS size FROM ranked WHERE {label} IS NOT NULL GROUP BY 1"),
        (
            "slots",
            f'SELECT r AS "round", s AS "set", class, CASE WHEN size >= {k} THEN {subset} '
            f"ELSE list_transform(range({k}), lambda d: {again} % size) END AS spots "
            f"FROM range({rounds}) a(r), range({sets}) b(s), sizes",
        ),
        (
            "draws",
            f'SELECT "round", "set", p.class, draw, k._row_id FROM (SELECT * EXCLUDE (spots), unnest(range({k})) AS draw, '
            f"unnest(spots) AS i FROM slots) p JOIN ranked k ON k.{label} = p.class AND k._index = p.i",
        ),
    ]


def bootstrap_ctes(source: str, seed: int) -> list[tuple[str, str]]:
    pick = f"('0x' || substr({hashed('id', str(seed))}, 1, 15))::BIGINT"
    return [
        ranked_cte(source, seed),
        (
            "drawn",
            f"SELECT p.id AS _draw, r.* FROM (SELECT id, {pick} % (SELECT count(*) FROM {source}) AS i "
            f"FROM range((SELECT count(*) FROM {source})) t(id)) p JOIN ranked r ON r._index = p.i",
        ),
    ]


def jitter_credit(seed: int = 123) -> str:
    h = [hashed("_draw", str(seed), f"'noise{i}'") for i in range(3)]
    noise = [normal(h[i // 4], i % 4) for i in range(12)]
    step = f"({word(hashed('_draw', str(seed), chr(39) + 'age' + chr(39)))} % 5) - 2"
    cells = [f"least(greatest(\"AGE\" + {step}, 18), 100)::BIGINT AS \"AGE\"", "_draw AS _row_id"]
    for i, n in enumerate(S.CREDIT_BILLS):
        moved = f"{q(n)} + {noise[i]} * 0.035::DOUBLE * \"LIMIT_BAL\""
        cells.append(
            f"round_even(least(greatest({moved}, \"LIMIT_BAL\" * -0.15::DOUBLE), \"LIMIT_BAL\" * 1.75::DOUBLE), 0)::BIGINT AS {q(n)}"
        )
    for i, n in enumerate(S.CREDIT_PAYMENTS, start=6):
        cells.append(f"round_even(greatest({q(n)} + {noise[i]} * 0.02::DOUBLE * \"LIMIT_BAL\", 0.0), 0)::BIGINT AS {q(n)}")
    return with_(
        [*roles("credit"), *bootstrap_ctes("credit_real", seed)],
        f"SELECT * EXCLUDE (_draw, _index) REPLACE ({', '.join(cells)}) FROM drawn",
    )


def jitter_generic(seed: int = 123) -> str:
    noisy = [n for n in S.ADULT_COLUMNS if n in S.ADULT_INTEGERS and n != "education-num"]
    stats = ", ".join(f"stddev_samp({q(n)}) AS s{i}" for i, n in enumerate(noisy))
    cells = ["_draw AS _row_id"]
    for i, n in enumerate(noisy):
        h = hashed("_draw", str(seed), f"'noise{i // 4}'")
        cells.append(f"round({q(n)} + {normal(h, i % 4)} * 0.02::DOUBLE * s{i}, 6) AS {q(n)}")
    spread = ", ".join(f"s{i}" for i in range(len(noisy)))
    return with_(
        [*roles("adult"), *bootstrap_ctes("adult_real", seed), ("stats", f"SELECT {stats} FROM drawn")],
        f"SELECT * EXCLUDE (_draw, _index, {spread}) REPLACE ({', '.join(cells)}) FROM drawn, stats",
    )


# --- texts and codes --------------------------------------------------------------------------


def sentence(columns: tuple[str, ...], seed: int) -> str:
    tagged = []
    for i, n in enumerate(columns):
        h = hashed("_row_id", str(i // 4), str(seed))
        tagged.append(f"substr({h}, {8 * (i % 4) + 1}, 8) || {lit(n + ' is ')} || {q(n)}::VARCHAR")
    ordered = f"list_sort(list_filter([{', '.join(tagged)}], lambda x: x IS NOT NULL))"
    return f"array_to_string(list_transform({ordered}, lambda x: substr(x, 9)), ', ')"


def codes_ctes(source: str, columns: tuple[str, ...], seed: int = 42) -> list[tuple[str, str]]:
    values = " UNION ".join(
        f"SELECT {i} AS position, {lit(n)} AS \"column\", {q(n)}::VARCHAR AS value FROM {source} WHERE {q(n)} IS NOT NULL"
        for i, n in enumerate(columns)
    )
    spot = f"((row_number() OVER (ORDER BY position, value) - 1) * 709301 + {seed}) % 1213056"
    pick = [f"substr('{ALPHABET}', ((spot // {36 ** p}) % {36 if p < 3 else 26} + 1)::INT, 1)" for p in (3, 2, 1, 0)]
    return [
        ("spots", f"SELECT \"column\", value, {spot} AS spot FROM ({values}) v"),
        ("codes", f"SELECT \"column\", value, {' || '.join(pick)} AS code FROM spots"),
    ]


def coded(columns: tuple[str, ...], categorical: tuple[str, ...], table: str, key: str = "_row_id") -> str:
    cells = []
    for n in columns:
        if n in categorical:
            found = f"(SELECT code FROM codes WHERE \"column\" = {lit(n)} AND value = t.{q(n)}::VARCHAR)"
            cells.append(f"coalesce({found}, t.{q(n)}::VARCHAR) AS {q(n)}")
        else:
            cells.append(f"t.{q(n)}")
    return f"SELECT t.{key}, {', '.join(cells)} FROM {table} t"


def csv_line(columns: tuple[str, ...]) -> str:
    cells = []
    for n in columns:
        text = f"{q(n)}::VARCHAR"
        cells.append(
            f"coalesce(CASE WHEN regexp_matches({text}, '[,\"\\r\\n]') THEN '\"' || replace({text}, '\"', '\"\"') || '\"' "
            f"ELSE {text} END, '')"
        )
    return f"concat_ws(',', {', '.join(cells)})"


PROMPT_COLUMNS = (S.CREDIT_LABEL, *S.CREDIT_COLUMNS[:-1])


def fitted() -> list[tuple[str, str]]:
    """Roles of the credit view, code table (in prompt order) and nothing else."""
    return [*roles("credit"), *codes_ctes("credit_real", tuple(S.CREDIT_CATEGORICAL))]


def prompts(rounds: int = 8) -> str:
    header = ",".join(PROMPT_COLUMNS)
    opening = "\n".join(
        [DESCRIPTIONS_LINE, "LIMIT_BAL: amount of given credit", "AGE: age in years", "", *INSTRUCTIONS, "", ""]
    )
    closing = f"\nGenerate 40 new rows, balanced across {S.CREDIT_LABEL} classes.\n{header}"
    lines = (
        f'SELECT d."round", d."set", d.class, d.draw, l.line FROM draws d JOIN '
        f"(SELECT _row_id, {csv_line(PROMPT_COLUMNS)} AS line FROM coded) l USING (_row_id)"
    )
    blocks = (
        f"SELECT \"round\", \"set\", 'Set ' || substr('{LETTERS}', (\"set\" + 1)::INT, 1) || ':' || chr(10) || {lit(header)} || "
        'chr(10) || string_agg(line, chr(10) ORDER BY class, draw) || chr(10) AS block FROM lines GROUP BY 1, 2'
    )
    return with_(
        [
            *fitted(),
            ranked_cte("credit_real", 42, q(S.CREDIT_LABEL)),
            *drawn(q(S.CREDIT_LABEL), rounds, 3, 8, 42),
            ("coded", coded(PROMPT_COLUMNS, S.CREDIT_CATEGORICAL, "credit_real")),
            ("lines", lines),
            ("blocks", blocks),
        ],
        f"SELECT \"round\", {lit(opening)} || string_agg(block, chr(10) ORDER BY \"set\") || {lit(closing)} AS prompt "
        'FROM blocks GROUP BY "round"',
    )


def reply_rows() -> list[tuple[str, str]]:
    """CTE ``parsed``: the data lines that the replies hold, by round and line."""
    junk = ", ".join([f"'ZZZZ' AS {q(PROMPT_COLUMNS[0])}"] + [f"'0' AS {q(n)}" for n in PROMPT_COLUMNS[1:]])
    texts = ", ".join(f"coalesce({q(n)}::VARCHAR, '') AS {q(n)}" for n in PROMPT_COLUMNS)
    # Line 0 is the repeated header, so data lines start at 1.
    return [
        *fitted(),
        ("coded", coded(PROMPT_COLUMNS, S.CREDIT_CATEGORICAL, "credit_typed")),
        (
            "body",
            f"SELECT _row_id // {LINES_PER_REPLY} AS \"round\", row_number() OVER (PARTITION BY _row_id // {LINES_PER_REPLY} "
            f"ORDER BY _row_id) AS line_no, {texts} FROM coded",
        ),
        (
            "parsed",
            f'SELECT * FROM body UNION ALL SELECT "round", max(line_no) + 1 AS line_no, {junk} FROM body GROUP BY "round"',
        ),
    ]


def parsed() -> str:
    return with_(reply_rows(), "SELECT * FROM parsed")


def postprocessed() -> str:
    cells, known = [], []
    for n in PROMPT_COLUMNS:
        if n in S.CREDIT_CATEGORICAL:
            back = f"(SELECT value FROM codes WHERE \"column\" = {lit(n)} AND code = t.{q(n)})"
            cells.append(f"TRY_CAST(coalesce({back}, t.{q(n)}) AS BIGINT) AS {q(n)}")
            known.append(f"{q(n)}::VARCHAR IN (SELECT value FROM codes WHERE \"column\" = {lit(n)})")
        else:
            cells.append(f"TRY_CAST(t.{q(n)} AS BIGINT) AS {q(n)}")
    rules = " AND ".join(f"coalesce({e}, false)" for _, e, _ in credit_rule_list())
    return with_(
        [*reply_rows(), ("typed", f'SELECT t."round", t.line_no, {", ".join(cells)} FROM parsed t')],
        f"SELECT * FROM typed WHERE {' AND '.join(known)} AND {rules}",
    )


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in ("lineitem", "credit", "adult", "heloc"):
        found[f"constraint_summary_{name}"] = summary(name)
        found[f"constraint_detail_{name}"] = detail(name)
    for name in ("credit", "adult", "heloc"):
        found[f"constraint_violations_{name}"] = violations(name)
        found[f"{name}_rules"] = with_(checked(name), f"SELECT * FROM {name}_flags")
        found[f"reject_invalid_{name}"] = rejected(name)
        found[f"repair_{name}"] = repaired_view(name)
        found[f"revision_report_{name}"] = revision(name)
        found[f"coerce_schema_{name}"] = with_(
            [view_cte(name), num_cte(name), typed_cte(name)], f"SELECT * FROM {name}_typed"
        )
        found[f"infer_categorical_{name}"] = infer(name)
        found[f"column_similarity_{name}"] = similarity(name)
        found[f"dcr_rows_{name}"] = with_(distance_rows(name), "SELECT _row_id, round(dcr, 6) AS dcr FROM dcr")
    found["dcr_rows_cells_credit"] = found["dcr_rows_credit"]
    found["dcr_rows_levels_heloc"] = found["dcr_rows_heloc"]
    found["prefix_sums_ranged"] = """
        SELECT g, v, n, (sum(n) OVER (PARTITION BY g ORDER BY v))::BIGINT AS cum_n
        FROM (SELECT nullif(l_returnflag, 'A') AS g, l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY ALL)
    """

    text = cleaned('"RiskPerformance"')
    relabel = (
        f"CASE WHEN lower({text}) IN ('bad', '1', 'true', 'yes') THEN 'Bad' "
        f"WHEN lower({text}) IN ('good', '0', 'false', 'no') THEN 'Good' ELSE {text} END"
    )
    found["normalize_labels"] = with_([view_cte("heloc")], f"SELECT _row_id, {relabel} AS label FROM heloc_view")
    complete = " AND ".join(f"{q(n)} IS NOT NULL" for n in S.HELOC_NUMERIC)
    found["normalize_heloc"] = with_(
        [view_cte("heloc"), num_cte("heloc"), typed_cte("heloc")],
        f"SELECT * EXCLUDE (_row_id) FROM (SELECT * REPLACE ({relabel} AS \"RiskPerformance\") FROM heloc_typed) x "
        f"WHERE \"RiskPerformance\" IN ('Good', 'Bad') AND {complete}",
    )
    found["normalize_credit"] = with_(
        [view_cte("credit"), num_cte("credit"), typed_cte("credit")], "SELECT * EXCLUDE (_row_id) FROM credit_typed"
    )
    words = [n for n in S.ADULT_CATEGORICAL if n != S.ADULT_LABEL]
    cells = ", ".join(f"coalesce(trim({q(n)}, {BLANKS}), 'nan') AS {q(n)}" for n in words)
    complete = " AND ".join(f"{q(n)} IS NOT NULL" for n in S.ADULT_INTEGERS)
    found["normalize_adult"] = with_(
        [view_cte("adult"), num_cte("adult"), typed_cte("adult")],
        f"SELECT * EXCLUDE (_row_id) REPLACE ({cells}, {cleaned('income')} AS income) FROM adult_typed WHERE {complete}",
    )
    found["combine_tables"] = with_(roles("adult"), "SELECT * FROM adult_real UNION ALL SELECT * FROM adult_fixed")
    found["dataset_manifest"] = with_(
        roles("heloc"),
        "SELECT 'heloc' AS dataset, 'orders' AS source, count(*)::BIGINT AS n_rows, "
        f"{lit(','.join(S.HELOC_COLUMNS))} AS columns FROM heloc_real",
    )
    reports = []
    for prefix, part in (("raw_constraints", "credit_raw"), ("repaired_constraints", "credit_fixed")):
        rule_cells = ", ".join(f"NOT coalesce({e}, false) AS {q(n)}" for n, e, _ in credit_rule_list())
        body = summary_body("credit", f"(SELECT {rule_cells} FROM {part}) f")
        names = ("n_rows", "n_constraints", "cvr", "cvc", "scvc", "row_violation_coverage")
        renamed = ", ".join(f"{n} AS \"{prefix}.{n}\"" for n in names)
        reports.append(f"(SELECT {renamed} FROM ({body}) s) AS {prefix}_")
    found["flatten_report"] = with_(roles("credit"), f"SELECT * FROM {', '.join(reports)}")

    found["split_train"] = split(False)
    found["split_test"] = split(True)
    label = q(S.CREDIT_LABEL)
    found["class_balanced_sample"] = with_(
        [*roles("credit"), ranked_cte("credit_real", 42, label), *drawn(label, 4, 3, 8, 42)], "SELECT * FROM draws"
    )
    share = f"round_even(24000 * (count(*)::DOUBLE / (SELECT count(*) FROM credit_real)), 0)::BIGINT"
    found["class_quota"] = with_(
        [*roles("credit"), ("shares", f"SELECT {label} AS class, {share} AS share FROM credit_real GROUP BY 1")],
        "SELECT class, (CASE WHEN class = (SELECT max(class) FROM shares) THEN 24000 - "
        "(SELECT coalesce(sum(share), 0) FROM shares WHERE class < (SELECT max(class) FROM shares)) "
        "ELSE share END)::BIGINT AS quota FROM shares",
    )
    upto = "SELECT class, quota, sum(quota) OVER (ORDER BY class) AS high FROM quotas"
    found["condition_slots"] = with_(
        [("quotas", found["class_quota"]), ("upto", upto)],
        f"SELECT i::BIGINT AS _row_id, concat({lit(S.CREDIT_LABEL + ' is ')}, class) AS prompt "
        "FROM range(24000) t(i) JOIN upto ON i >= high - quota AND i < high",
    )
    shown = [f"concat('{n} is ', rtrim(rtrim(printf('%.2f', {n}), '0'), '.'))" for n in LINE_NUMBERS]
    found["encode_float_text"] = f"SELECT l_orderkey, l_linenumber, concat_ws(', ', {', '.join(shown)}) AS text FROM lineitem"
    found["reject_invalid_lineitem"] = (
        "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem WHERE "
        + " AND ".join(test for _, test, _ in lineitem_rule_list())
    )
    kinds = [*[(n, "numeric_ks", ks_of) for n in LINE_NUMBERS], ("l_linestatus", "categorical_tvd", tvd_of)]
    found["column_similarity_lineitem"] = with_(
        [
            ("kept", "SELECT * FROM lineitem WHERE l_returnflag != 'R'"),
            ("back", "SELECT * FROM lineitem WHERE l_returnflag = 'R'"),
            ("sim", " UNION ALL ".join(f"SELECT '{n}' AS \"column\", '{kind}' AS type, {f(n, 'kept', 'back')} AS d" for n, kind, f in kinds)),
        ],
        'SELECT "column", type, round(d, 6) AS distance, round(greatest(0.0, 1.0 - d), 6) AS similarity FROM sim',
    )
    found["capped_sample"] = with_(
        [*roles("credit"), ranked_cte("credit_real", 42)], "SELECT * EXCLUDE (_index) FROM ranked WHERE _index < 5000"
    )
    found["bootstrap_jitter_credit"] = jitter_credit()
    found["bootstrap_jitter_generic"] = jitter_generic()

    pair = ("credit_real", "credit_fixed")
    found["column_tvd"] = with_(
        roles("credit"),
        " UNION ALL ".join(f"SELECT {lit(n)} AS \"column\", round({tvd_of(n, *pair)}, 6) AS distance" for n in S.CREDIT_CATEGORICAL),
    )
    numeric = [n for n in S.CREDIT_COLUMNS if n not in S.CREDIT_CATEGORICAL]
    found["column_ks"] = with_(
        roles("credit"),
        " UNION ALL ".join(f"SELECT {lit(n)} AS \"column\", round({ks_of(n, *pair)}, 6) AS distance" for n in numeric),
    )
    found["similarity_mean"] = with_(
        [*roles("credit"), ("sim", similarity_rows("credit"))],
        "SELECT round(avg(greatest(0.0, 1.0 - d)), 6) AS column_similarity_mean FROM sim",
    )
    tally = "count(*) FILTER ({y})::DOUBLE AS p, count(*) FILTER (NOT {y})::DOUBLE AS n"
    found["auc_binary"] = with_(
        roles("credit"), auc(f"SELECT \"AGE\" AS s, {tally.format(y=f'({label} = 1)')} FROM credit_real GROUP BY 1")
    )
    returned = tally.format(y="(l_returnflag = 'R')")
    found["auc_lineitem"] = auc(
        f"SELECT l_linestatus, l_extendedprice AS s, {returned} FROM lineitem GROUP BY 1, 2", "l_linestatus"
    )
    found["dcr_summary"] = with_(
        distance_rows("credit"),
        "SELECT count(*)::BIGINT AS count, round(avg(dcr), 6) AS mean, round(stddev_samp(dcr), 6) AS std, "
        "round(min(dcr), 6) AS min, round(quantile_cont(dcr, 0.25), 6) AS \"25%\", round(quantile_cont(dcr, 0.5), 6) AS \"50%\", "
        "round(quantile_cont(dcr, 0.75), 6) AS \"75%\", round(max(dcr), 6) AS max FROM dcr",
    )

    found["encode_rows_text"] = with_(
        roles("credit"), f"SELECT _row_id, {sentence(S.CREDIT_COLUMNS, 42)} AS text FROM credit_real"
    )
    found["decode_rows_text"] = with_(
        roles("credit"),
        f"SELECT _row_id, {', '.join(f'{q(n)}::VARCHAR AS {q(n)}' for n in S.CREDIT_COLUMNS)} FROM credit_real",
    )
    found["condition_prompts"] = with_(
        roles("adult"),
        "SELECT _row_id, 'income is ' || income || ', sex is ' || sex || ', age is ' || age AS prompt FROM adult_real",
    )
    empty = " ".join(f"WHEN {q(n)} IS NULL THEN {lit(n)}" for n in S.CREDIT_COLUMNS)
    found["partial_row_prompts"] = with_(
        [view_cte("credit"), num_cte("credit"), typed_cte("credit")],
        f"SELECT _row_id, {sentence(S.CREDIT_COLUMNS, 42)} || ', ' || (CASE {empty} ELSE 'LIMIT_BAL' END) || ' is' AS prompt "
        "FROM credit_typed",
    )
    adult_codes = [*roles("adult"), *codes_ctes("adult_real", S.ADULT_CATEGORICAL)]
    found["code_map"] = with_(adult_codes, "SELECT * FROM codes")
    found["code_support"] = with_(
        adult_codes, "SELECT \"column\", string_agg(code, ',' ORDER BY code) AS codes FROM codes GROUP BY 1"
    )
    found["map_values"] = with_(adult_codes, coded(S.ADULT_COLUMNS, S.ADULT_CATEGORICAL, "adult_typed"))
    found["unmap_values"] = with_(roles("adult"), "SELECT * FROM adult_typed")
    found["code_support_rows"] = with_(adult_codes, "SELECT \"column\", code FROM codes")
    found["map_values_joined"] = found["map_values"]
    found["unmap_values_joined"] = found["unmap_values"]
    found["revision_by_position"] = """
WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, * FROM orders),
a AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_custkey,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice * 1.0000001::DOUBLE AS o_totalprice,
    CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 5001 <> 5000
),
x AS (
  SELECT (abs(b.o_custkey - a.o_custkey) > 1e-8 + 1e-5 * abs(a.o_custkey))::BIGINT
    + (b.o_orderstatus IS DISTINCT FROM a.o_orderstatus)::BIGINT
    + (abs(b.o_totalprice - a.o_totalprice) > 1e-8 + 1e-5 * abs(a.o_totalprice))::BIGINT
    + (b.o_orderpriority IS DISTINCT FROM a.o_orderpriority)::BIGINT AS c
  FROM a JOIN b USING (k)
),
n AS (SELECT (SELECT count(*) FROM b) AS old, (SELECT count(*) FROM a) AS new, count(*) AS n, sum(c)::BIGINT AS cells, count(*) FILTER (c > 0) AS rows FROM x)
SELECT old AS n_rows_before, new AS n_rows_after, 4::BIGINT AS n_columns_compared, n * 4 AS compared_cells, cells AS revised_cells,
  rows AS revised_rows, round(cells / (n * 4.0::DOUBLE), 6) AS cell_revision_rate, round(rows / n::DOUBLE, 6) AS row_revision_rate,
  round((old - new) / old::DOUBLE, 6) AS dropped_row_rate, 0.0::DOUBLE AS added_row_rate
FROM n
"""
    found["csv_rows"] = with_(
        [view_cte("adult"), num_cte("adult"), typed_cte("adult")],
        f"SELECT _row_id, {csv_line(S.ADULT_COLUMNS)} AS line FROM adult_typed",
    )
    found["balanced_prompts"] = prompts()
    found["parse_replies"] = parsed()
    found["postprocess_rows"] = postprocessed()
    return found
