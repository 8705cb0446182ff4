"""DuckDB twins of the queries that SQL can say."""

from __future__ import annotations

from itertools import permutations

from fieldloom.llm import licences, url_filter

OP1 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
), h AS (SELECT doc_id, sha256(n) AS text_sha256 FROM t)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN iw USING (n, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP5 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s AS (
  SELECT *, len(regexp_extract_all(text, '<\\*\|')) AS marks,
    contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') AS conflict FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + CASE WHEN conflict THEN marks ELSE 0 END) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM s GROUP BY conv_id
"""

OP6 = r"""
WITH m AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), p AS (SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS place FROM m),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (
  SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, CAST([0.5, -0.5, 0.0][rank % 3 + 1] AS DOUBLE) AS a,
    CAST(source_size AS DOUBLE) * 2 AS most FROM k
), r AS (SELECT *, most / weight AS full_at, CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5 AS total FROM w),
c AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM r
), l AS (
  SELECT arg_min((total - stopped) / open_weight, full_at) AS level FROM c WHERE (total - stopped) / open_weight <= full_at
), t AS (SELECT c.*, CASE WHEN level <= full_at THEN level * weight ELSE most END AS target FROM c LEFT JOIN l ON true),
g AS (SELECT sum(target) AS total_a, sum(target * a) AS total_b FROM t),
o AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, t.a,
    coalesce(sum(p.size) OVER (PARTITION BY p.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
), u AS (SELECT *, least(start / target, 1.0) AS u FROM o),
x AS (SELECT *, 2 * u / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * u)) AS due FROM u)
SELECT doc_id, size, source_size, target,
  CASE WHEN (target - start) * 2 >= size THEN size ELSE 0 END + CASE WHEN (target - (start + source_size)) * 2 >= size THEN size ELSE 0 END AS taken,
  CASE WHEN size > 0 AND (target - start) * 2 >= size THEN CAST(floor(total_a * due + total_b * (due * due - due)) AS BIGINT) END AS first_position
FROM x, g
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_IDS = ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in licences.SENTENCES.items())


def _pattern(ids: tuple[str, ...], shown: int) -> str:
    """The identifiers in their order; group 1 is the place of the one that is shown."""
    parts = [f",{'(' if i == shown else '(?:'}[0-9]+)={name}," for i, name in enumerate(ids)]
    return _quoted("^.*?" + ".*?".join(parts))


_RULES = ", ".join(
    f"({_quoted(name)}, {_quoted(licence)}, {len(ids)}, {_pattern(ids, 0)}, {_pattern(ids, len(ids) - 1)})" for name, licence, ids in licences.RULES
)

OP8 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace({LOWERED}, '\n+|[.!?;:]+([\x20\x09-\x0D]|$)', chr(10), 'g'), '\n'),
    lambda s: trim(regexp_replace(s, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))), lambda s: s <> '') AS s FROM documents
), e AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS spot FROM d),
known AS (SELECT unnest(map_entries(MAP {{{_IDS}}}), recursive := true)),
i AS (SELECT doc_id, spot, known.value AS id FROM e JOIN known ON e.s = known.key),
n AS (SELECT doc_id, count(*) AS n, string_agg(',' || spot || '=' || id || ',', '' ORDER BY spot) AS ids FROM i GROUP BY doc_id),
rules(rule, licence, size, head, tail) AS (VALUES {_RULES}),
hit AS (
  SELECT doc_id, rule, licence, size, regexp_extract(ids, head, 1) AS first, regexp_extract(ids, tail, 1) AS last
  FROM n JOIN rules ON regexp_matches(ids, head)
), best AS (SELECT * FROM hit QUALIFY size = max(size) OVER (PARTITION BY doc_id, licence)),
out AS (
  SELECT doc_id, string_agg(rule || ':' || first || ':' || last, ',' ORDER BY rule || ':' || first || ':' || last) AS rules,
    array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences FROM best GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(n.n, 0) AS n_identified, coalesce(rules, '') AS rules, coalesce(licences, '') AS licences
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN out USING (doc_id)
"""

_URL_RULES = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for h, p, v in url_filter.RULES)

OP11 = rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS n, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', ['host', 'path'], 's') AS u FROM pages),
p AS (SELECT page_id, n, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, u.path AS path FROM u),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {_URL_RULES}),
best AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN regexp_matches(host, '{url_filter.UNWANTED_HOST}') THEN 'block' ELSE 'allow' END) AS verdict,
  regexp_matches(host, '{url_filter.UNWANTED_HOST}') AS listed
FROM p LEFT JOIN best USING (n)
"""

_ORDERS = ", ".join(f"('{''.join(order)}')" for order in permutations("ABCDE"))

OP12 = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o(filter_order) AS (VALUES {_ORDERS}),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
k AS (SELECT *, substr(filter_order, step, 1) AS letter, '[' || substr(filter_order, 1, step - 1) || '-]' AS before FROM s),
x AS (SELECT *, contains(fails, letter) AS fail, regexp_matches(fails, before) AS gone FROM c, k),
r AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
    coalesce(sum(n) FILTER (fail AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (fail AND NOT gone AND toxic), 0) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), n AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {
    "op1_exact_dedup": OP1, "op4_decontamination": OP4, "op5_chat_format": OP5, "op6_mixing": OP6, "op8_licence_scan": OP8,
    "op11_url_filter": OP11, "op12_filter_audit": OP12, "op13_fill_in_middle": OP13,
}
