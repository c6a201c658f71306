"""SQL twins of those queries that SQL can express."""

from __future__ import annotations

from runledger.llm import chat_format as chat
from runledger.llm import periodic_runs as periodic
from runledger.llm import quality_rules as rules
from runledger.llm import secrets
from runledger.llm import source_audit as audit


def _either_case(words: list[str]) -> str:
    spell = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    return "|".join(spell(w) for w in words)


_KEYWORDS = _either_case(["password", "passwd", "secret", "token", "api_?key"])
_ASSIGN = f"(?:{_KEYWORDS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _located(name: str, pattern: str) -> str:
    """A CTE with each match of a pattern and its place."""
    return f"""
{name} AS (
  SELECT doc_id, m AS match, CAST(s AS BIGINT) AS start, CAST(s + length(m) AS BIGINT) AS stop FROM (
    SELECT doc_id, ms[i] AS m,
           coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs
      FROM d WHERE regexp_matches(t, '{pattern}')))))"""


def _secrets() -> str:
    classes = []
    for k, c in enumerate(secrets.CLASSES):
        needs = "".join(f" AND regexp_matches(match, '{n}')" for n in c.needs)
        needs += "".join(f" AND NOT regexp_matches(match, '{a}')" for a in secrets.ALLOWED)
        most = f"{secrets.WINDOW} * (log2({secrets.WINDOW}) - {c.bits}) * 1e6"
        classes.append(
            _located(f"c{k}", c.pattern)
            + f""",
w{k} AS (
  SELECT doc_id, start, w, substr(match, CAST(w + 1 AS BIGINT), {secrets.WINDOW}) AS s
  FROM (SELECT doc_id, match, start, unnest(range(0, len(match) - {secrets.WINDOW} + 1)) AS w
        FROM c{k} WHERE true{needs})),
e{k} AS (
  SELECT doc_id, start + min(w) AS start, start + max(w) + {secrets.WINDOW} AS stop
  FROM (SELECT *, list_sum(list_transform(list_distinct(string_split(s, '')),
          lambda x: round((length(s) - length(replace(s, x, ''))) * log2(length(s) - length(replace(s, x, ''))) * 1e6))) AS h FROM w{k})
  WHERE h <= round({most}) GROUP BY doc_id, start, length(s))"""
        )
    entropy = "\n".join(
        f"  UNION ALL SELECT doc_id, {secrets.KINDS.index(c.kind)}, '{c.kind}', start, stop FROM e{k}"
        for k, c in enumerate(secrets.CLASSES)
    )
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no, stop)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_located("m0", _ASSIGN)},
{_located("m1", secrets.ACCESS)},
{_located("m2", secrets.HEX)},
{",".join(classes)},
spans AS (
  SELECT doc_id, 0 AS kind_no, 'assign' AS kind, start, stop FROM m0
  WHERE length(regexp_extract(match, '{_ASSIGN}', 1)) >= {secrets.ASSIGN_VALUE}
  UNION ALL SELECT doc_id, 1, 'access', start, stop FROM m1 WHERE stop - start >= {secrets.ACCESS_LENGTH}
  UNION ALL SELECT doc_id, 2, 'hex', start, stop FROM m2
{entropy}),
g AS (
  SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
         count(*) FILTER (kind_no = 2) AS n_hex, {joined} FILTER (kind_no < 3) AS base, {joined} AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dedup_rows(table: str) -> str:
    """CTEs ``lines`` and ``deduped`` (doc_id, n_lines, n_dropped, kept) of a table."""
    return f"""
lines AS (
  SELECT doc_id, i, line, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}))),
shared AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
deduped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM (SELECT l.*, s.key IS NOT NULL AND doc_id <> s.last_doc AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
  GROUP BY doc_id)"""


_LINE_DEDUP = f"""
WITH {dedup_rows("documents")}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"""


def judged_rows(table: str) -> str:
    """CTEs up to ``judged``: every row's counts and verdict."""
    return f"""
q_texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM {table}),
q_words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM q_texts),
q_windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {rules.WINDOW - 1}], ' ')) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS i FROM q_words WHERE len(ws) >= {rules.WINDOW})),
q_repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {rules.WINDOW})) AS p FROM q_windows WHERE n > 1) GROUP BY doc_id),
q_counts AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM q_words LEFT JOIN q_repeats USING (doc_id)),
q_tested AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words AS base_failed,
    100 * n_symbols > {rules.SIGN_SYMBOLS_PERCENT} * n_words
    OR 100 * n_dup_lines > {rules.SIGN_DUP_LINES_PERCENT} * n_lines
    OR word_chars > {rules.SIGN_WORD_CHARS} * n_words AS sign_failed
  FROM q_counts),
q_hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR sign_failed) AS f FROM q_tested GROUP BY source),
q_sums AS (
  SELECT sum(n) AS docs, count(*) AS hosts, sum(f) / sum(n) AS m, sum(f) AS failed, sum(f * f / n) AS squares FROM q_hosts),
q_prior AS (
  SELECT m, CASE WHEN m * (1 - m) = 0 OR docs <= hosts THEN 1000.0 ELSE
    1 / least(0.5, greatest(1 / 1001, ((squares - failed * m) / (m * (1 - m)) - hosts) / (docs - hosts))) - 1 END AS w
  FROM q_sums),
q_verdicts AS (
  SELECT source, (f + m * w) / (n + w) >= {rules.BAD_HOST_RATE} AS bad_host FROM q_hosts, q_prior),
judged AS (
  SELECT t.*, bad_host, NOT base_failed AND NOT (bad_host AND sign_failed) AS kept
  FROM q_tested t JOIN q_verdicts v ON t.source IS NOT DISTINCT FROM v.source)"""


_QUALITY_RULES = f"""
WITH {judged_rows("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, sign_failed, bad_host, kept
FROM judged"""


_ESCAPED = "regexp_replace(coalesce({}, ''), '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g')"

_CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    {_ESCAPED.format('role')} AS r, {_ESCAPED.format('text')} AS x FROM c),
w AS (
  SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id) AS n_all,
    sum(length(r) + length(x) + {len(chat.OPEN + chat.HEAD + chat.TAIL + chat.CLOSE)}) OVER (o ROWS UNBOUNDED PRECEDING) AS stop
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, x))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{chat.TRAINED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = '{chat.TRAINED}'), '')) AS loss_sha256,
  sum(stop) FILTER (role = '{chat.TRAINED}' OR n = n_all)::BIGINT AS formatted_chars,
  count(*) FILTER (role = '{chat.TRAINED}' OR n = n_all) AS n_examples
FROM w GROUP BY conv_id"""


#: The checksum of a decimal id: every digit, then eight shifts of one bit.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
  string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384::BIGINT) ELSE h // 2 END))"""

_RUN_WORDS = f"""
h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_CRC32} AS h FROM documents),
a AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
    lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE ws END AS ws FROM p)"""

_PERIODIC = f"""
WITH {_RUN_WORDS},
w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM d),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y
  ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND {periodic.MIN_PERIODS} * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest({periodic.MIN_WORDS}, {periodic.MIN_PERIODS} * q)),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0
    AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
found AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': q}}, [-length, start, q]) AS longest,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (
    SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.q AND w.i < r.start + r.length)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, longest.start AS start, longest.length AS length,
  longest.period AS period, 1000 * longest.length // longest.period AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)"""


_SHARE = "1 + (1000000000::HUGEINT * ({} + 1)) // ({} + v)"

_AUDIT = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x80-\\x{{10FFFF}}]+') AS ts FROM documents),
w AS (SELECT row_no, lang, source, translate(unnest(ts), '{_UPPER}', '{_LOWER}') AS term FROM d),
kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= {audit.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
ls AS (SELECT lang, sum(total) AS total FROM g GROUP BY lang),
p AS (
  SELECT g.lang, g.source, term, coalesce(n, 0) AS n, v, {_SHARE.format("coalesce(n, 0)", "total")} AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value FROM g a
  JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS s
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) q
  ON q.lang = a.lang AND q.source = a.source AND q.other = b.source),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM (
    SELECT p.*, {_SHARE.format("lt.n", "ls.total")} AS q FROM p JOIN lt USING (lang, term) JOIN ls USING (lang))
  WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked)
WHERE part = 'pair' OR rank <= {audit.TOP_TERMS}"""


ORACLE = {
    "op1_secrets": _secrets(),
    "op6_line_dedup": _LINE_DEDUP,
    "op10_quality_rules": _QUALITY_RULES,
    "op11_source_audit": _AUDIT,
    "op12_chat_format": _CHAT,
    "op13_periodic_runs": _PERIODIC,
}
