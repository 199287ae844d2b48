"""DuckDB SQL for the chat formatting query: noisy transcripts, counts, and Viterbi as a recursive query."""

from __future__ import annotations

from .chat_format import BEGIN, HEADER, INSIDE, MARKERS, NONE, OTHER, PARTS, ROLES, SIZES


def values(*rows: tuple) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def markers() -> str:
    """(state, marker, probability)."""
    n, rows = len(ROLES), []
    for r in range(n):
        rows += [(r, m, BEGIN["own"] if m == r else BEGIN["another role's"]) for m in range(n)] + [(r, OTHER, BEGIN["unknown"]), (r, NONE, BEGIN["none"])]
        rows += [(n + r, m, INSIDE["a role's"]) for m in range(n)] + [(n + r, OTHER, INSIDE["unknown"]), (n + r, NONE, INSIDE["none"])]
    return values(*rows)


def oracle(names, written, missing: int, unknown: int, misspelt: int, swapped: int, inner: int, inner_line: str) -> str:
    """The rows of the query whose transcripts are written with these markers and shares of noise."""
    noise = lambda seed: f"('0x' || substr(md5(conv_id || '|' || turn || '|{seed}'), 1, 8))::BIGINT % 100"
    lists = lambda rows: "[" + ", ".join("[" + ", ".join(f"'{v}'" for v in r) + "]" for r in rows) + "]"
    break_ = lambda s: s.replace("\n", "' || chr(10) || '")
    n, shown = len(ROLES), HEADER.pattern.replace("'", "''")
    size = lambda col: " + ".join(f"(length({col}) >= {s})::INT" for s in SIZES)
    return f"""
WITH RECURSIVE roles AS (SELECT * FROM ({values(*enumerate(ROLES))}) v(r, role)),
styled AS (SELECT *, {noise(1)} AS u, conv_id % {len(names)} AS style, (conv_id // {len(names)}) % {len(written)} AS form, r + 1 AS number FROM conversations LEFT JOIN roles USING (role)),
asked AS (SELECT *, CASE WHEN u >= {missing + unknown + misspelt} AND u < {missing + unknown + misspelt + swapped} THEN number % 3 + 1 ELSE number END AS other FROM styled),
named AS (SELECT *, CASE WHEN u >= {missing} AND u < {missing + unknown} THEN 'Dana' ELSE {lists(names)}[style + 1][other] || CASE WHEN u >= {missing + unknown} AND u < {missing + unknown + misspelt} THEN 'x' ELSE '' END END AS name FROM asked),
parts AS (SELECT conv_id AS c, turn AS part, CASE WHEN u < {missing} OR name IS NULL THEN '' ELSE {break_(lists([(w[0],) for w in written]))}[form + 1][1] || name || {break_(lists([(w[1],) for w in written]))}[form + 1][1] END
  || coalesce(text, '') || CASE WHEN {noise(2)} < {inner} THEN '{break_(inner_line)}' ELSE '' END AS text FROM named),
split AS (SELECT c, part, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM parts WHERE text <> ''),
numbered AS (SELECT c, line, row_number() OVER (PARTITION BY c ORDER BY part, text, pos) AS i, regexp_matches(line, '{shown}', 's') AS marked,
  lower(concat({", ".join(f"regexp_extract(line, '{shown}', {g}, 's')" for g in range(1, 7))})) AS name, regexp_extract(line, '{shown}', 7, 's') AS rest FROM split),
known AS (SELECT * FROM ({values(*((m, r) for r, role in enumerate(ROLES) for m in MARKERS[role]))}) v(name, r)),
seen AS (SELECT c, i, line, CASE WHEN marked THEN rest ELSE line END AS body, CASE WHEN NOT marked THEN {NONE} ELSE coalesce(r, {OTHER}) END AS m FROM numbered LEFT JOIN known USING (name)),
labelled AS (SELECT conv_id AS k, turn AS o, r, coalesce(text, '') AS t FROM conversations JOIN roles USING (role)),
follow AS (SELECT lag(r) OVER (PARTITION BY k, floor(o / {PARTS}) ORDER BY o, role) AS b, r FROM (SELECT DISTINCT k, o, r FROM labelled WHERE k IS NOT NULL AND o IS NOT NULL) JOIN roles USING (r)),
start AS (SELECT r, n / sum(n) OVER () AS p FROM (SELECT roles.r, 1 + count(follow.r) AS n FROM roles LEFT JOIN follow ON follow.r = roles.r AND b IS NULL GROUP BY 1)),
step AS (SELECT a, r, n / sum(n) OVER (PARTITION BY a) AS p FROM (SELECT x.r AS a, y.r, 1 + count(follow.r) AS n FROM roles x CROSS JOIN roles y LEFT JOIN follow ON follow.b = x.r AND follow.r = y.r GROUP BY 1, 2)),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM labelled),
sized AS (SELECT r, (pos > 0)::INT AS inner_, {size("line")} AS s FROM lines),
sizes AS (SELECT x.inner_, roles.r, y.s, 1 + count(sized.s) AS n FROM (VALUES (0), (1)) x(inner_) CROSS JOIN roles CROSS JOIN (SELECT unnest(range({len(SIZES) + 1})) AS s) y LEFT JOIN sized ON sized.inner_ = x.inner_ AND sized.r = roles.r AND sized.s = y.s GROUP BY 1, 2, 3),
stay AS (SELECT r, least(0.95, greatest(0.05, (sum(n) FILTER (inner_ = 1) / sum(n))::DOUBLE)) AS p FROM sizes GROUP BY r),
move AS (SELECT s.state AS a, {n} + r AS b, ln(p) AS w FROM stay JOIN (SELECT unnest(range({2 * n})) AS state) s ON state % {n} = r
  UNION ALL SELECT s.state, step.r, ln(1 - stay.p) + ln(step.p) FROM stay JOIN (SELECT unnest(range({2 * n})) AS state) s ON state % {n} = stay.r JOIN step ON step.a = stay.r),
emit AS (SELECT state, m, s, ln(p::DOUBLE) + ln((n / sum(n) OVER (PARTITION BY state, m))::DOUBLE) AS w FROM ({markers()}) v(state, m, p) JOIN sizes ON r = state % {n} AND inner_ = (state >= {n})::INT),
obs AS (SELECT c, i, m, {size("body")} AS s FROM seen),
viterbi AS (
  SELECT c, i, state, ln(p) + w AS score, [state] AS path FROM obs JOIN emit USING (m, s) JOIN start ON start.r = state WHERE i = 1
  UNION ALL
  SELECT obs.c, obs.i, move.b, max(score + move.w) + emit.w, list_append(arg_max(path, score + move.w), move.b) FROM viterbi JOIN obs ON obs.c = viterbi.c AND obs.i = viterbi.i + 1
    JOIN move ON move.a = viterbi.state JOIN emit ON emit.state = move.b AND emit.m = obs.m AND emit.s = obs.s GROUP BY obs.c, obs.i, move.b, emit.w),
best AS (SELECT c, arg_max(path, score) AS path FROM viterbi JOIN (SELECT c, max(i) AS i FROM obs GROUP BY c) USING (c, i) GROUP BY c),
states AS (SELECT c, unnest(path) AS state, unnest(range(1, len(path) + 1)) AS i FROM best),
turned AS (SELECT c, i, state, CASE WHEN state < {n} THEN body ELSE line END AS text, count(*) FILTER (state < {n}) OVER (PARTITION BY c ORDER BY i) - 1 AS turn FROM states JOIN seen USING (c, i)),
result AS (SELECT c, turn, arg_min(state, i) AS r, trim(string_agg(text, chr(10) ORDER BY i), chr(10)) AS text FROM turned GROUP BY c, turn)
SELECT c AS conv_id, turn::BIGINT AS turn, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered FROM result JOIN roles USING (r)"""
