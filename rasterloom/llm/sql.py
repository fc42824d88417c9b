"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables.

op1, op3, op7, op9 and the pipeline have none: trained or approximate results and tokenizer files are beyond
SQL; tests/llm holds them against brute force, round trips and held-out accuracy."""

from rasterloom.llm import mixing, quality

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)|\[(/?INST\])|<(</?SYS>>)', '\0#', 'g') AS marked FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(marked) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, array_agg(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS x FROM r) GROUP BY doc_id),
words AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, w, gone FROM d LEFT JOIN g USING (doc_id)),
k AS (SELECT doc_id, unnest(range(1, n + 1)) AS x, unnest(w) AS word FROM words),
gx AS (SELECT doc_id, unnest(gone) AS x FROM g),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.x) AS s FROM k ANTI JOIN gx ON k.doc_id = gx.doc_id AND k.x = gx.x GROUP BY k.doc_id)
SELECT words.doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM r) GROUP BY doc_id),
ln AS (SELECT doc_id, source, unnest(l) AS x FROM d),
nl AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(x), '{_SPACE}+', ' ', 'g'), '[0-9]+', '0', 'g')) AS s,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM ln),
hosts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sk AS (SELECT doc_id, coalesce(CASE WHEN len([x for x in w if length(x) >= {quality.SKETCH_LETTERS}]) * {quality.SKETCH_FEW} >= len(w) THEN
      list_min([md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) for i in range(1, len(w) - 1) if length(w[i]) >= {quality.SKETCH_LETTERS}]) END,
    list_min([md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) for i in range(1, len(w) - 1)]), md5(t)) AS known FROM d),
fr AS (SELECT nl.source, nl.s FROM nl JOIN hosts USING (source) JOIN sk USING (doc_id) GROUP BY nl.source, nl.s, hosts.n
  HAVING count(DISTINCT known) > least({quality.LINE_MOST}, greatest({quality.LINE_FLOOR}, CAST({quality.LINE_SHARE} AS DOUBLE) * hosts.n))),
gone AS (SELECT doc_id, sum(n) AS n FROM nl SEMI JOIN fr ON nl.source = fr.source AND nl.s = fr.s GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS words_left
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND words_left >= CAST({quality.LEFT_SHARE} AS DOUBLE) * n_words AS kept FROM v
"""


def _unit(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)})"


OP6 = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
m AS (SELECT source, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM n) * CAST((SELECT sum(n) FROM n) AS DOUBLE) / n AS mean FROM n),
p AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS below FROM m
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM p WHERE k < {mixing.MAX_COPIES - 1}
),
u AS (SELECT *, {_unit(f"'{mixing.SEED}'", "CAST(doc_id AS VARCHAR)")} AS u FROM documents),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (WHERE p.below <= u.u) AS n
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, CAST(n AS INTEGER) AS n_copies, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy_no FROM c WHERE n > 0)
SELECT *, {_unit(f"'{mixing.SEED}'", "CAST(doc_id AS VARCHAR)", "CAST(copy_no AS VARCHAR)", "'order'")} AS shuffle_order FROM e
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * b >= 80 * (nu.n + nv.n - b)),
reach AS (SELECT doc_id AS a, doc_id AS z FROM d UNION SELECT reach.a, l.v FROM reach JOIN l ON l.u = reach.z)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(z) AS component_id, min(z) = d.doc_id AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

_KINDS = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _matches(i: int, kind: str, pattern: str) -> str:
    value = r"length(regexp_extract(h, '^[A-Za-z_]+[\"'']?\x20*[:=]\x20*[\"'']?(.*)$', 1)) >= 8" if kind == "assign" else "true"
    return f"""
  SELECT doc_id, {i} AS no, '{kind}' AS kind, pos, CAST(pos - length(h) AS BIGINT) AS start FROM (
    SELECT doc_id, h, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
      SELECT doc_id, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS h, unnest(gs[1:len(hs)]) AS g FROM (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS hs, regexp_split_to_array(coalesce(text, ''), '{pattern}') AS gs FROM documents)))
  WHERE {value}"""


OP10 = f"""
WITH m AS ({' UNION ALL '.join(_matches(i, k, p) for i, (k, p) in enumerate(_KINDS))}),
s AS (SELECT *, kind || ':' || start || ':' || CAST(pos AS BIGINT) AS span FROM m),
a AS (SELECT doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, no) FILTER (WHERE no < 3) AS base, string_agg(span, ',' ORDER BY start, no) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_tree": OP2,
    "op4_substring_dedup": OP4,
    "op5_quality_rules": OP5,
    "op6_poisson_mix": OP6,
    "op8_minhash_near_dedup": OP8,
    "op10_secret_scan": OP10,
}
