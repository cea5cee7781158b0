"""SQL expressions of the text primitives, for the queries' SQL."""

from __future__ import annotations

from tessera.functions import lexicon as L


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def fold(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ß', 'ss')"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(replace({fold(x)}, '’', ''''), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({fold(x)}, '[\p{{L}}\p{{N}}_]+')"


def stem(t: str) -> str:
    return f"CASE WHEN length({t}) > 4 AND ends_with({t}, 'ing') THEN left({t}, length({t}) - 3) WHEN length({t}) > 3 AND ends_with({t}, 'ed') THEN left({t}, length({t}) - 2) WHEN length({t}) > 3 AND ends_with({t}, 's') THEN left({t}, length({t}) - 1) ELSE {t} END"


def stems(toks: str) -> str:
    return f"list_transform({toks}, lambda t: {stem('t')})"


def content(toks: str) -> str:
    stop = listed(L.STOPWORDS)
    return f"list_transform(list_filter({toks}, lambda t: NOT list_contains({stop}, t) AND NOT list_contains({stop}, {stem('t')}) AND length({stem('t')}) > 1), lambda t: {stem('t')})"


def audit(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9][A-Za-z0-9_''’-]*'), lambda t: replace(lower(t), '’', ''''))"


def grams(toks: str, n: int = 12) -> str:
    return f"CASE WHEN len({toks}) >= {n} THEN list_transform(range(1, len({toks}) - {n - 2}), lambda i: array_to_string({toks}[i:i + {n - 1}], ' ')) ELSE [] END"


def skeleton(toks: str) -> str:
    return f"array_to_string(list_transform({toks}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '<NUM>' WHEN list_contains({listed(L.FUNCTION_WORDS)}, t) THEN t ELSE '<CONTENT>' END), ' ')"


def hashed(*parts: str) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"({p})::VARCHAR" for p in parts) + "))"


def stripped(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def domain(x: str, fallback: str, table: dict = L.DOMAINS) -> str:
    out = []
    for d, phrases in table.items():
        single = "|".join(p for p in phrases if " " not in p)
        tests = [rf"regexp_matches({norm(x)}, '(^|[^a-z0-9_])({single})([^a-z0-9_]|$)')", *(f"contains({norm(x)}, '{p}')" for p in phrases if " " in p)]
        out.append(f"WHEN {' OR '.join(tests)} THEN '{d}'")
    return f"CASE {' '.join(out)} ELSE {fallback} END"


def parse_time(x: str) -> str:
    return f"coalesce(try_cast({x} AS TIMESTAMPTZ), TIMESTAMPTZ '{L.REFERENCE_TIME}')"


def recency(ts: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + greatest(0.0::DOUBLE, (epoch_us(TIMESTAMPTZ '{L.REFERENCE_TIME}') - epoch_us({ts}))::DOUBLE / 86400e6) / 30.0))"


#: Cases from conversations: the last user turn asks, the turns before it are the memories.
CASES = """
q AS (SELECT conv_id, max(turn) AS qt FROM conversations WHERE role = 'user' GROUP BY conv_id),
cq AS (SELECT c.conv_id::VARCHAR AS case_id, min(c.text) AS query, q.qt FROM conversations c JOIN q ON c.conv_id = q.conv_id AND c.turn = q.qt GROUP BY ALL),
cm AS (SELECT case_id, (row_number() OVER (PARTITION BY case_id ORDER BY turn, text) - 1)::BIGINT AS pos, case_id || ':' || turn AS memory_id, role, text,
       printf('2026-07-%02dT12:00:00+00:00', (1 + turn % 28)::INT) AS ts, query, turn = qt - 1 AS relevant
       FROM conversations c JOIN cq ON c.conv_id::VARCHAR = cq.case_id AND c.turn < cq.qt)
"""
