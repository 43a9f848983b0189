"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

#: Lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) n FROM windows),
spots AS (
  SELECT doc_id, i, n, w[i:i + n - 1] win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)
),
found AS (SELECT doc_id, i, n, item_id FROM spots JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, source IS NULL no_source, coalesce(source, '') source_key,
    len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT size,
    -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / greatest(0.05::DOUBLE, coalesce(length(regexp_replace(text, '[^\p{{Ll}}]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0)) k
  FROM documents
),
s AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1]::DOUBLE weight, 2.0::DOUBLE * source_size most
  FROM (SELECT no_source, source_key, sum(size)::BIGINT source_size FROM d GROUP BY ALL)
),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER earlier)) / (sum(weight) OVER () - (sum(weight) OVER earlier)) lvl
  FROM s WINDOW earlier AS (ORDER BY most / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
first_level AS (
  SELECT *, coalesce(lvl, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) / (SELECT sum(weight) FROM s)) lv FROM l
),
t AS (
  SELECT no_source, source_key, source_size,
    least(most, weight * (SELECT arg_min(lv, most / weight) FROM first_level WHERE lv <= most / weight)) target
  FROM s
),
k AS (
  SELECT doc_id, size, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT epochs,
    coalesce(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before
  FROM d JOIN t USING (no_source, source_key)
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT taken
FROM k
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) i FROM d)
),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id x, b.doc_id y, count(*) common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id x, doc_id y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
comp AS (SELECT x doc_id, min(y) component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, component_id, doc_id = component_id kept
FROM comp LEFT JOIN n USING (doc_id)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') plain FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) keep_id,
  count(*) OVER (PARTITION BY plain)::BIGINT group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) kept, sha256(plain) text_sha256
FROM d
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w FROM documents),
p AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) i FROM d WHERE len(w) >= 35)
),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) k FROM p SEMI JOIN r USING (h)),
words AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) k FROM d),
kept AS (
  SELECT doc_id, count(*) n, string_agg(word, ' ' ORDER BY k) t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) record
  FROM pages
),
n AS (
  SELECT page_id, strlen(record)::BIGINT length, sha256(record) digest,
    row_number() OVER (ORDER BY page_id, sha256(record)) - 1 k FROM r
)
SELECT page_id, k // 4096 shard, k % 4096 seq,
  coalesce(sum(length) OVER (PARTITION BY k // 4096 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT "offset",
  length, digest, page_id % 97 = 13 damaged
FROM n
"""

OP11 = r"""
WITH r AS (
  SELECT row_number() OVER () k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.k ak, a.vec_id anchor_id, b.k, b.vec_id, a.label = b.label same,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT score
  FROM r a JOIN r b ON a.k <> b.k WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT ak, anchor_id, k, vec_id positive_id, score positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id, k) <= 5
)
SELECT p.anchor_id, positive_id, vec_id negative_id, positive_score, score negative_score,
  row_number() OVER (PARTITION BY p.ak, p.k ORDER BY score DESC, vec_id, s.k)::INTEGER rank
FROM p JOIN s ON p.ak = s.ak AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

# The template's marks and the way marks in texts are escaped.
OP12 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
),
f AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|SYS|INST|ANS|ROLE))', '\1\\\2', 'g')) + 2
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 14 + 2 * strlen(role) END n
  FROM c
)
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
  (3 + sum(n))::BIGINT formatted_chars
FROM f GROUP BY conv_id
"""


def _repair_sql() -> str:
    """Forward search: the least (cost, audit) of each state after each turn, carried on turn by turn."""
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
    names = ("z", "s", "u", "a")  # start, after system, after user, after assistant
    nothing = "NULL::STRUCT(c BIGINT, m VARCHAR, o VARCHAR)"

    def then(state: str, cost: str, edit: str, line: str | None) -> str:
        """One edit more, from a state that can be reached."""
        out = f"{state}.o" if line is None else f"{state}.o || chr(10) || {line}"
        return f"CASE WHEN {state} IS NOT NULL THEN {{c: {state}.c + {cost}, m: {state}.m || '{edit}', o: {out}}} END"

    def least(options: list[str]) -> str:
        return f"list_min([{', '.join(options)}])"

    def inserted(source: str, keep: str) -> str:
        """The states of ``source`` after up to two inserted turns."""
        for k in (1, 2):
            user = least(["u", *[then(q, "3", "I", "'user:'") for q in ("z", "s", "a")]])
            assistant = least(["a", then("u", "3", "I", "'assistant:'")])
            source = f"(SELECT {keep}, z, s, {user} u, {assistant} a FROM {source}) i{k}"
        return source

    free, live = "3 * (fault = 'truncated')::BIGINT", "fault IN ('none', 'truncated')"
    said, letter = "role || ':' || text", "substr(role, 1, 1)"
    moved = {
        q: [
            then(q, "4", "D", None),
            *([f"CASE WHEN {live} AND {letter} = 's' THEN {then('z', free, 'K', said)} END"] if q == "s" else []),
            *([f"CASE WHEN {live} AND {letter} = 'u' THEN {then(p, free, 'K', said)} END" for p in ("z", "s", "a")] if q == "u" else []),
            *([f"CASE WHEN {live} THEN {then(p, free + ' + 3', 'R', "'user:' || text")} END" for p in ("z", "s", "a")] if q == "u" else []),
            *([f"CASE WHEN {live} AND {letter} = 'a' THEN {then('u', free, 'K', said)} END"] if q == "a" else []),
            *([f"CASE WHEN {live} THEN {then('u', free + ' + 3', 'R', "'assistant:' || text")} END"] if q == "a" else []),
        ]
        for q in names
    }
    begin = f"(SELECT conv_id, 0::BIGINT AS place, {{c: 0::BIGINT, m: '', o: ''}} z, {nothing} s, {nothing} u, {nothing} a FROM ids) b"
    onward = f"""(SELECT ways.conv_id, turns.place, {', '.join(f'{least(moved[q])} {q}' for q in names)}
      FROM ways JOIN turns ON turns.conv_id IS NOT DISTINCT FROM ways.conv_id AND turns.place = ways.place + 1) w"""
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') key
  FROM conversations
),
d AS (SELECT *, {crc} % 20 kind FROM k),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) copy
  FROM d WHERE kind <> 0
),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER along place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 again,
    lag(substr(role, 1, 1)) OVER along || substr(role, 1, 1) pair
  FROM rows WINDOW along AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
),
turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE 'none' END fault
  FROM placed
),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (
  SELECT * FROM {inserted(begin, 'conv_id, place')}
  UNION ALL SELECT * FROM {inserted(onward, 'conv_id, place')}
),
ends AS (SELECT conv_id, list_min([z, a]) w FROM ways QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT gaps, count(*) FILTER (fault = 'blank') blank,
    count(*) FILTER (fault = 'duplicate') duplicate, count(*) FILTER (fault = 'truncated') truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) illegal
  FROM turns GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, w.c cost, w.m audit, sha256(substr(w.o, 2)) repaired_sha256
FROM ids JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


OP13 = _repair_sql()

ORACLES = {
    "op4_decontamination": OP4,
    "op5_mixing": OP5,
    "op6_near_dedup": OP6,
    "op8_exact_dedup": OP8,
    "op9_substring_dedup": OP9,
    "op10_warc_audit": OP10,
    "op11_hard_negatives": OP11,
    "op12_chat_format": OP12,
    "op13_structure_repair": OP13,
}
