"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(('0x' || md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, ''))[1:13]) AS BIGINT)::DOUBLE / 4503599627370496 AS unit, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
fill(round, source, source_size, weight, fixed) AS (
  SELECT 0, source, source_size, weight, false FROM w
  UNION ALL
  SELECT round + 1, source, source_size, weight, fixed OR 3.0 * source_size <= weight * level
  FROM (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (fixed) OVER (), 0)) / (sum(weight) FILTER (NOT fixed) OVER ())::DOUBLE AS level FROM fill)
  WHERE round < 40 AND level IS NOT NULL),
last AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
t AS (SELECT source, source_size, CASE WHEN fixed THEN 3.0 * source_size ELSE weight * (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (fixed) OVER (), 0)) / (sum(weight) FILTER (NOT fixed) OVER ())::DOUBLE END AS target FROM last)
SELECT doc_id, size, source_size, target, CAST(size * least(3, floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t) t ON sized.source IS NOT DISTINCT FROM t.source
"""

CONTROL = "<|im_end|><|im_start|>assistant ok"
OP7 = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
digest AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn) AS roles
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid FROM digest
"""


def _spans(kind: str, no: int, pattern: str, test: str) -> str:
    """Rows (doc_id, start, kind_no, kind, end) of one kind."""
    return rf"""
SELECT doc_id, s AS start, {no} AS kind_no, '{kind}' AS kind, s + length(m) AS stop FROM (
  SELECT doc_id, m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s FROM (
    SELECT doc_id, hits, gaps, unnest(hits) AS m, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM documents)))
WHERE {test}"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
#: kind, pattern, what a match must meet; in the order in which kinds are listed
KINDS = [
    ("assign", ASSIGN, rf"""length(regexp_extract(m, '(?:{_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8"""),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", "[0-9a-f]+", "length(m) >= 32"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("stripe", "sk_live_[A-Za-z0-9]{16,}", "true"),
    ("google", "AIza[A-Za-z0-9_-]{35}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "true"),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
]
OP10 = f"""
WITH spans AS ({" UNION ALL ".join(_spans(k, i, p, t) for i, (k, p, t) in enumerate(KINDS))}),
told AS (SELECT *, kind || ':' || start || ':' || stop AS told FROM spans),
digest AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(told, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base, string_agg(told, ',' ORDER BY start, kind_no) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN digest USING (doc_id)
"""

ORACLES: dict[str, str] = {"op3_mixing": OP3, "op7_chat": OP7, "op10_secrets": OP10}
