"""DuckDB SQL for the registered queries, written apart from their Spark form."""

from __future__ import annotations

from ..functions import config as C
from . import adapters as A


def _list(values) -> str:
    return "[" + ", ".join(_s(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_s(v) for v in values) + ")"


def _s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick(values, number: str) -> str:
    return f"list_extract({_list(values)}, CAST(({number}) % {len(values)} + 1 AS BIGINT))"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_s(w)})" for w in words) + ")"


_MESSAGES = f"""
m AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, 'p' || (user_id % 5) AS project, event_id AS ord, ts, event_type = 'signup' AS is_prompt,
    CASE WHEN event_type = 'signup' THEN {_pick(A.PROMPTS, "event_id")} END AS prompt,
    CASE event_type WHEN 'click' THEN 'Read' WHEN 'view' THEN 'Bash' WHEN 'purchase' THEN 'Edit' END AS tool,
    CASE WHEN event_type = 'purchase' THEN 'src/f' || (event_id % 7) || '.py' END AS file,
    CAST(floor(value) AS BIGINT) AS tokens, CASE WHEN event_type = 'error' THEN event_id % 200 ELSE 0 END AS chars
  FROM events),
s AS (SELECT *, sum(CASE WHEN is_prompt THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, ord ROWS UNBOUNDED PRECEDING) AS seg FROM m),
g AS (
  SELECT session_id, CAST(seg AS BIGINT) AS seg, min(project) AS project, max(ts) FILTER (WHERE is_prompt) AS start_ts, max(ord) FILTER (WHERE is_prompt) AS start_ord,
    max(prompt) AS prompt, arg_max(ts, (ts, ord)) FILTER (WHERE NOT is_prompt) AS last_ts, count(tool) AS tool_calls,
    CAST(coalesce(sum(tokens) FILTER (WHERE NOT is_prompt), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(arg_max(chars, (ts, ord)) FILTER (WHERE NOT is_prompt AND chars > 0), 0) AS BIGINT) AS final_chars,
    count(*) FILTER (WHERE tool = 'Bash') AS n_bash, count(*) FILTER (WHERE tool = 'Edit') AS n_edit, count(*) FILTER (WHERE tool = 'Read') AS n_read,
    list_sort(list_distinct(list(file) FILTER (WHERE file IS NOT NULL))) AS files, list(tool ORDER BY ts, ord) FILTER (WHERE tool IS NOT NULL) AS calls
  FROM s WHERE seg > 0 GROUP BY session_id, seg),
t0 AS (SELECT *, coalesce(lead(start_ts) OVER (PARTITION BY session_id ORDER BY seg), last_ts, start_ts) AS end_ts FROM g),
t AS (SELECT *, floor((greatest(0, epoch_us(end_ts) - epoch_us(start_ts)) + 50000) / 100000) / 10.0 AS duration FROM t0)
"""
_CORRECTIONS = """
c AS (
  SELECT ts, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'workspace' ELSE 'P' || (user_id % 5) END AS project, event_id AS ord, 'cause-' || (event_id % 9) AS root_cause
  FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INT) >= 95)
"""
_ENRICHED = f"""
{_MESSAGES}, {_CORRECTIONS},
h AS (SELECT DISTINCT session_id, seg FROM t JOIN c ON c.ts BETWEEN t.start_ts AND t.end_ts AND (c.project IN ('', 'workspace') OR lower(c.project) = lower(t.project))),
e0 AS (SELECT t.*, h.seg IS NOT NULL AS logged FROM t LEFT JOIN h USING (session_id, seg)),
e AS (
  SELECT *, CASE WHEN logged THEN 'corrected' WHEN duration < 90 THEN 'abandoned' WHEN tool_calls = 0 AND final_chars = 0 THEN 'no-op' ELSE 'completed' END AS outcome,
    CASE WHEN len(coalesce(files, [])) > 0 THEN 'code-change' WHEN {_any("lower(prompt)", C.DEBUG_WORDS)} THEN 'debug' WHEN {_any("lower(prompt)", C.AUDIT_WORDS)} THEN 'audit'
      WHEN n_read > 0 AND n_bash > 0 THEN 'exploration' WHEN {_any("lower(prompt)", C.WRITING_WORDS)} THEN 'doc-write' ELSE 'chat' END AS task_type,
    CASE WHEN duration < 120 THEN 'short' WHEN duration < 600 THEN 'medium' ELSE 'long' END AS difficulty
  FROM e0),
r AS (
  SELECT *, tool_calls > 0 AND outcome IN ('completed', 'corrected') AND NOT starts_with(prompt, '/') AS replayable,
    duration >= 60 AND length(prompt) BETWEEN 20 AND 4000 AND outcome <> 'no-op' AND NOT starts_with(prompt, '<') AS eligible,
    CAST(floor((epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us(start_ts)) / 86400000000) AS BIGINT) AS age_days
  FROM e),
p AS (SELECT *, CASE WHEN age_days <= 30 THEN 'recent' WHEN age_days <= 90 THEN 'mid' ELSE 'older' END AS recency FROM r)
"""
_TEXTS = f"x AS (SELECT doc_id, text || {_pick(A.SUFFIXES, 'doc_id')} AS text, {_pick(A.PROMPTS, 'doc_id')} || ' ' || text AS prompt FROM documents)"


def _phrases(text: str) -> str:
    return " + ".join(f"(length(lower({text})) - length(replace(lower({text}), {_s(p)}, ''))) // {len(p)}" for p in C.PHRASES)


def _options(text: str) -> str:
    return " + ".join(f"CAST(regexp_matches({text}, {_s(p)}, 'i') AS BIGINT)" for p in C.OPTION_PATTERNS)


def _design(prompt: str) -> str:
    word = r"[^\p{L}\p{M}\p{N}_]"
    bare = C.DESIGN_PATTERN.removeprefix(r"\b").removesuffix(r"\b")
    return f"regexp_matches({prompt}, {_s(f'(^|{word}){bare}($|{word})')}, 'i')"


def _search_first(prompt: str, calls: str, text: str) -> str:
    first = f"list_extract(list_filter({calls}, lambda q: q NOT IN {_in(C.LOOKUP_TOOLS)}), 1)"
    return f"CASE WHEN {_design(prompt)} THEN coalesce({first} IN {_in(C.SEARCH_TOOLS)} OR ({first} = 'Bash' AND regexp_matches({text}, {_s(C.REPO_SEARCH_PATTERN)})), false) ELSE true END"


def _cost(run: str, truth: str) -> str:
    return f"CAST(CASE WHEN coalesce({run}, 0) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 2.0 - CAST({run} AS DOUBLE) / coalesce(nullif({truth}, 0), 1))) END AS DOUBLE)"


def _align(run: str, truth: str) -> str:
    q = f"(CAST({run} AS DOUBLE) / coalesce(nullif({truth}, 0), 1))"
    return f"CAST(CASE WHEN coalesce({run}, 0) = 0 THEN 0.0 WHEN {q} < 0.5 THEN {q} / 0.5 WHEN {q} <= 2 THEN 1.0 ELSE greatest(0.0, 1 - ({q} - 2) / 4) END AS DOUBLE)"


_PARTS = ("completion", "no_correction", "no_premature", "no_options", "search_first", "tool_alignment", "cost")


def _scored(pairs: str) -> str:
    """CTEs z0 and z over a CTE of pairs."""
    return f"""
z0 AS (
  SELECT *, CAST(completed_cleanly AS DOUBLE) AS completion, CAST(NOT fired AS DOUBLE) AS no_correction, CAST(greatest(0.0, 1 - 0.5 * ({_phrases("response_text")})) AS DOUBLE) AS no_premature,
    CAST(({_options("response_text")}) = 0 AS DOUBLE) AS no_options, CAST({_search_first("prompt", "calls", "response_text")} AS DOUBLE) AS search_first,
    {_align("run_calls", "tool_calls")} AS tool_alignment, {_cost("run_tokens", "output_tokens")} AS cost
  FROM {pairs}),
z AS (
  SELECT benchmark_id, round(completion, 3) AS completion, round(no_correction, 3) AS no_correction, round(no_premature, 3) AS no_premature, round(no_options, 3) AS no_options,
    round(search_first, 3) AS search_first, round(tool_alignment, 3) AS tool_alignment, round(cost, 3) AS cost,
    round((0.0 + completion * 1.5 + no_correction * 2.0 + no_premature * 1.5 + no_options * 1.5 + search_first * 1.0 + tool_alignment * 1.0) / 8.5, 4) AS score
  FROM z0)"""


_PAIRS = f"""
{_ENRICHED}, n AS (SELECT count(*) AS n FROM documents),
y AS (
  SELECT start_ord AS benchmark_id, prompt, calls, tool_calls, output_tokens, d.text || {_pick(A.SUFFIXES, "start_ord")} AS response_text,
    CAST(floor(CAST(tool_calls * (start_ord % 5) AS DOUBLE) / 2) AS BIGINT) AS run_calls, CAST(floor(CAST(output_tokens * (start_ord % 7) AS DOUBLE) / 4) AS BIGINT) AS run_tokens,
    start_ord % 6 <> 0 AS completed_cleanly, start_ord % 10 = 3 AS fired
  FROM p, n JOIN documents d ON d.doc_id = start_ord % n.n WHERE replayable),
{_scored("y")}
"""
_LOG = f"""
l AS (
  SELECT event_id AS ord, ts, 'run-' || event_id AS run_id, CASE WHEN user_id % 6 = 5 THEN 'user-approval' ELSE {_pick(C.STRATEGIES, "user_id")} END AS strategy,
    'memory/m' || (event_id % 11) || '.md' AS target_file, {_pick(A.DECISIONS, "event_id")} AS decision,
    CASE WHEN event_id % 13 <> 0 THEN CAST(0.5 AS DOUBLE) + (CAST(floor(value) AS BIGINT) % 50) / CAST(100 AS DOUBLE) END AS score_mean, user_id % 20 AS stream
  FROM events),
w AS (SELECT * FROM l WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND (decision IS NULL OR decision NOT IN {_in(C.NOT_RUNS)}))
"""
_STATS = f"""
q AS (
  SELECT strategy, count(*) AS tried, count(*) FILTER (WHERE decision IN {_in(C.KEPT)}) AS kept, count(*) FILTER (WHERE decision IN {_in(C.LOST)}) AS lost,
    max(ts) AS last_tried, max(ts) FILTER (WHERE decision IN {_in(C.KEPT)}) AS last_kept
  FROM l WHERE strategy IS NOT NULL AND strategy NOT IN {_in(C.NOT_STRATEGIES)} GROUP BY strategy),
u AS (
  SELECT *, CASE WHEN tried >= 5 AND kept / CAST(tried AS DOUBLE) < 0.10 THEN 'avoid' WHEN tried >= 3 AND kept / CAST(tried AS DOUBLE) >= 0.40 THEN 'promising' ELSE 'neutral' END AS recommendation,
    round(kept / CAST(tried AS DOUBLE), 3) AS success_rate
  FROM q)
"""
_DECLARED = "(VALUES " + ", ".join(f"({_s(x)})" for x in C.STRATEGIES) + ") d(strategy)"
_NP = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"
_LABELS = f"""
b AS (SELECT item_id AS benchmark_id, {_NP.format("text")} AS np FROM benchmark),
k0 AS (SELECT doc_id AS ord, text FROM documents UNION ALL SELECT item_id + 10000000, '  ' || replace(text, ' ', '   ') FROM benchmark WHERE item_id % 7 = 0),
k AS (SELECT {_NP.format("text")} AS cp, min(ord) AS key_ord FROM k0 GROUP BY 1 HAVING {_NP.format("min(text)")} <> ''),
x AS (SELECT benchmark_id, key_ord, 'exact' AS how FROM b JOIN k ON np = cp),
f AS (SELECT benchmark_id, min(key_ord) AS key_ord FROM b JOIN k ON length(cp) >= 20 AND (contains(np, cp) OR contains(cp, np)) GROUP BY 1)
"""
_KW = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s-]', ' ', 'g'), '\\s+'), lambda q: length(q) >= 4 AND q NOT IN " + _in(C.STOPWORDS) + "))"


def _hits(text: str, wanted: str) -> str:
    return f"len(list_filter({_KW.format(wanted)}, lambda q: contains(lower({text}), q)))"


_CORRECTED = f"""
q0 AS (
  SELECT event_id AS ord, 'cause-' || (event_id % 9) AS root_cause, {_pick(A.SUPPOSED, "event_id")} AS supposed_to, {_pick(A.DONE, "event_id")} AS what_i_did,
    CASE event_id % 4 WHEN 0 THEN '  ' || upper({_pick(A.PROMPTS[:3], "event_id // 4")}) WHEN 1 THEN 'short doc about the release'
      WHEN 2 THEN {_pick(A.PROMPTS[3:6], "event_id // 4")} || ' and more words after it' ELSE 'unrelated words that nobody asked for' END AS prompt
  FROM events WHERE event_type = 'error'),
q1 AS (SELECT {_NP.format("prompt")} AS cp, min(ord) AS key_ord, arg_max(root_cause, ord) AS root_cause, arg_max(supposed_to, ord) AS supposed_to, arg_max(what_i_did, ord) AS what_i_did FROM q0 GROUP BY 1),
q2 AS (SELECT benchmark_id, {_NP.format("prompt")} AS np, response_text FROM y),
q3 AS (SELECT benchmark_id, key_ord, 'exact' AS how FROM q2 JOIN q1 ON np = cp),
q4 AS (SELECT benchmark_id, min(key_ord) AS key_ord, 'contained' AS how FROM q2 JOIN q1 ON length(cp) >= 20 AND (contains(np, cp) OR contains(cp, np)) WHERE benchmark_id NOT IN (SELECT benchmark_id FROM q3) GROUP BY 1),
q5 AS (
  SELECT k.benchmark_id, how, root_cause, coalesce(response_text, '') = '' AS blank, {_hits("response_text", "supposed_to")} AS pos, {_hits("response_text", "what_i_did")} AS neg
  FROM (SELECT * FROM q3 UNION ALL SELECT * FROM q4) k JOIN q1 USING (key_ord) JOIN q2 ON q2.benchmark_id = k.benchmark_id),
q AS (SELECT benchmark_id, how, root_cause, CASE WHEN blank THEN 0.5 ELSE round((pos + 1) / CAST(pos + neg + 2 AS DOUBLE), 4) END AS label_score FROM q5)
"""


_VALUE = "CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE greatest(1, least(5, CAST(round_even((event_id % 14) / 2.0, 0) AS INT))) END"
_JUDGED = f"""
j AS (
  SELECT event_id AS benchmark_id, event_id % 17 = 0 AS judge_failed, (CAST(floor(value) AS BIGINT) % 10) / 1000.0 AS cost_usd,
    CASE WHEN event_id % 17 <> 0 THEN {_VALUE} END AS position_taking, CASE WHEN event_id % 17 <> 0 THEN 4 END AS task_completion,
    CASE WHEN event_id % 17 <> 0 THEN event_id % 5 + 1 END AS search_first, CASE WHEN event_id % 17 <> 0 THEN 5 END AS tool_appropriate, CASE WHEN event_id % 17 <> 0 THEN 2 END AS response_specific
  FROM events),
v AS ({" UNION ALL ".join(f"SELECT {_s(d)} AS dimension, CAST({d} AS DOUBLE) AS value FROM j" for d in C.DIMENSIONS)})
"""


def _cut(text: str, most: int) -> str:
    return f"CASE WHEN length({text}) <= {most} THEN {text} ELSE left({text}, {most - 50}) || chr(10) || '…[truncated]…' || chr(10) || right({text}, 50) END"


_HEAD = "Rate the response to the prompt from 1 to 5 on: " + ", ".join(C.DIMENSIONS) + ".\nAnswer with one line of JSON with these keys and \"rationale\", nothing else.\n\nPROMPT:\n"
_PROMPT = f"{_s(_HEAD)} || {_cut('prompt', 1500)} || {_s(chr(10) * 2 + 'RESPONSE:' + chr(10))} || {_cut('text', 2000)} || {_s(chr(10) * 2 + 'TOOLS (')} || (doc_id % 3 + doc_id % 5) || {_s(' in all):' + chr(10))} || 'Bash×' || (doc_id % 5) || ', Read×' || (doc_id % 3) || chr(10)"
_FORBIDDEN = " OR ".join(f"starts_with(target, {_s(p)}) OR target = {_s(p.rstrip('/'))}" for p in C.FORBIDDEN)
_KEY = "session_id, seg"

_SUITE = f"""WITH {_ENRICHED},
a1 AS (SELECT *, row_number() OVER (PARTITION BY recency, task_type, project ORDER BY duration DESC, start_ord) AS turn, md5('42|' || recency || '|' || task_type || '|' || project) AS hash FROM p WHERE eligible),
a2 AS (SELECT *, row_number() OVER (PARTITION BY recency ORDER BY turn, hash, start_ord) AS spot FROM a1),
a3 AS (SELECT *, 'quota' AS picked_by FROM a2 WHERE spot <= CASE recency WHEN 'recent' THEN 24 WHEN 'mid' THEN 12 ELSE 4 END),
a4 AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || start_ord), start_ord) AS place FROM a2 WHERE start_ord NOT IN (SELECT start_ord FROM a3)),
a5 AS (SELECT {_KEY}, recency, task_type, project, duration, replayable, picked_by, CASE recency WHEN 'recent' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS rank, spot FROM a3
  UNION ALL SELECT {_KEY}, recency, task_type, project, duration, replayable, 'topup', 9, place FROM a4 WHERE place <= 40),
a6 AS (SELECT *, row_number() OVER (ORDER BY rank, spot) AS pos FROM a5)"""

# The longest common run of lines by its table, row by row.
_DIFF = """
f0 AS (SELECT doc_id AS n, coalesce(text, '') AS old, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
f1 AS (SELECT n, old, CASE WHEN n % 3 = 0 THEN list_concat(l[2:], l[1:1]) ELSE l END AS l FROM f0),
f2 AS (SELECT n, old, array_to_string(list_append(flatten(list_transform(l, lambda x, i: CASE WHEN i % 4 = 0 THEN [] WHEN (i - 1) % 5 = 2 THEN [x, x] ELSE [x] END)), 'added line'), chr(10)) AS new FROM f1),
f3 AS (SELECT n, 'd' || n || '.md' AS path, CASE WHEN n % 6 <> 1 THEN old END AS old, CASE WHEN n % 6 <> 2 THEN new END AS new FROM f2),
f4 AS (SELECT *, string_split(old, chr(10)) AS ol, string_split(new, chr(10)) AS nl FROM f3 WHERE old IS DISTINCT FROM new),
f AS MATERIALIZED (SELECT n, path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' ELSE 'changed' END AS change, coalesce(CASE WHEN ol[-1] = '' THEN ol[:-2] ELSE ol END, []) AS o, coalesce(CASE WHEN nl[-1] = '' THEN nl[:-2] ELSE nl END, []) AS w FROM f4),
y AS (
  SELECT n, 0 AS i, list_transform(o, lambda q: 0) AS row FROM f
  UNION ALL
  SELECT y.n, y.i + 1, list_transform(range(1, len(o) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END + CAST(o[k] = w[y.i + 1] AS INT)))))
  FROM y JOIN f USING (n) WHERE y.i < len(w)),
x AS (SELECT n, path, change, CAST(len(w) - coalesce(row[-1], 0) AS BIGINT) AS added, CAST(len(o) - coalesce(row[-1], 0) AS BIGINT) AS removed FROM f JOIN y USING (n) WHERE y.i = len(w))
"""
_FEEDBACK = f"""
WITH {_LOG},
k AS (
  SELECT event_id AS n, 'run-' || event_id AS run, CASE event_type WHEN 'signup' THEN 'a' WHEN 'error' THEN 'r' ELSE 'd' END AS act, props AS reason, e.ts, CASE event_id % 2 WHEN 0 THEN 'reset' ELSE 'revert' END AS mode, l.decision,
    CASE WHEN event_type <> 'purchase' THEN event_id % 9 <> 0 ELSE l.decision IN {_in(C.KEPT)} AND event_id % 8 <> 0 END AS ok,
    CASE WHEN event_type = 'purchase' THEN l.strategy WHEN event_id % 5 <> 0 THEN {_pick(A.STRATEGY_NAMES, "user_id")} END AS s,
    CASE WHEN event_type = 'purchase' THEN l.target_file ELSE 'm' || (event_id % 11) END AS target,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'note ' || event_id END WHEN event_id % 3 = 1 THEN 'summary ' || event_id END AS did,
    CASE WHEN event_type = 'purchase' THEN l.score_mean ELSE (event_id % 50) / CAST(100 AS DOUBLE) END AS score,
    CASE WHEN event_type = 'purchase' THEN 'c' ELSE 'b' END || event_id AS before
  FROM events e JOIN l ON l.ord = event_id WHERE event_type IN ('signup', 'error', 'purchase')),
good AS (SELECT * FROM k WHERE ok)
"""

ORACLE = {
    "segment_tasks": f"WITH {_MESSAGES} SELECT left(session_id, 8) || '-' || CASE WHEN seg - 1 < 1000 THEN lpad(CAST(seg - 1 AS VARCHAR), 3, '0') ELSE CAST(seg - 1 AS VARCHAR) END AS task_id, {_KEY}, project, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, duration AS duration_sec, prompt, length(prompt) AS prompt_chars, tool_calls, output_tokens FROM t",
    "task_tool_histogram": f"WITH {_MESSAGES} SELECT {_KEY}, concat_ws(',', CASE WHEN n_bash > 0 THEN 'Bash=' || n_bash END, CASE WHEN n_edit > 0 THEN 'Edit=' || n_edit END, CASE WHEN n_read > 0 THEN 'Read=' || n_read END) AS tools FROM t",
    "task_files_distinct": f"WITH {_MESSAGES} SELECT {_KEY}, coalesce(len(files), 0) AS n_files, coalesce(array_to_string(files, ','), '') AS files FROM t",
    "last_nonzero_text": f"WITH {_MESSAGES} SELECT {_KEY}, final_chars AS final_response_chars, epoch_us(last_ts) AS last_us FROM t",
    "segment_turns": "WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM conversations) SELECT conv_id, CAST(seg AS BIGINT) AS seg, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM s WHERE seg > 0 GROUP BY conv_id, seg",
    "classify_tasks": f"WITH {_ENRICHED} SELECT {_KEY}, difficulty, task_type, outcome, logged AS correction_logged FROM e",
    "correction_interval_match": f"WITH {_ENRICHED} SELECT {_KEY} FROM h",
    "eligible_filter": f"WITH {_ENRICHED} SELECT {_KEY}, replayable FROM p WHERE eligible",
    "recency_age_days": f"WITH {_ENRICHED} SELECT {_KEY}, age_days, recency FROM p",
    "stratified_suite": f"""{_SUITE}
SELECT {_KEY}, pos, recency, task_type, project, duration AS duration_sec, picked_by FROM a6 WHERE pos <= 40""",
    "suite_breakdown": f"""WITH {_ENRICHED} SELECT CASE WHEN grouping(project) = 0 THEN 'project' WHEN grouping(task_type) = 0 THEN 'task_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'recency' END AS dimension,
coalesce(project, task_type, difficulty, recency) AS value, count(*) AS n, CAST(sum(CAST(replayable AS INT)) AS BIGINT) AS n_replayable FROM p WHERE eligible GROUP BY GROUPING SETS ((project), (task_type), (difficulty), (recency))""",
    "phrase_count": f"WITH {_TEXTS} SELECT doc_id, {_phrases('text')} AS n_phrases FROM x",
    "options_count": f"WITH {_TEXTS} SELECT doc_id, {_options('text')} AS n_options FROM x",
    "design_flag": f"WITH {_TEXTS} SELECT doc_id, {_design('prompt')} AS is_design, {_search_first('prompt', _list(['Read', 'Bash']), 'text')} AS search_first FROM x",
    "prompt_flags": f"WITH {_TEXTS}, w AS (SELECT doc_id, ltrim(CASE WHEN doc_id % 4 = 0 THEN ' <system-reminder>' ELSE '  ' END || prompt, ' ') AS text FROM x) SELECT doc_id, coalesce(text <> '' AND NOT ({' OR '.join(f'starts_with(text, {_s(t)})' for t in C.WRAPPER_TAGS)}), false) AS is_prompt FROM w",
    "cost_and_alignment": f"WITH k AS (SELECT CAST(l_quantity AS BIGINT) % 12 AS run, CAST(l_linenumber AS BIGINT) - 1 AS truth, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT run, truth, n, round({_cost('run', 'truth')}, 4) AS cost, round({_align('run', 'truth')}, 4) AS alignment FROM k",
    "score_tasks": f"WITH {_PAIRS} SELECT * FROM z",
    "score_run": f"WITH {_PAIRS} SELECT benchmark_id % 3 AS run, count(*) AS n_scored, round(avg(score), 4) AS score_mean, round(median(score), 4) AS score_median, round(stddev_samp(score), 4) AS score_stdev, "
    + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in _PARTS)
    + " FROM z GROUP BY 1",
    "missing_responses": f"WITH {_ENRICHED} SELECT start_ord AS benchmark_id FROM p WHERE replayable AND start_ord NOT IN (SELECT event_id FROM events WHERE event_id % 3 <> 0)",
    "unknown_responses": f"WITH {_ENRICHED} SELECT event_id AS benchmark_id FROM events WHERE event_id % 3 <> 0 AND event_id NOT IN (SELECT start_ord FROM p)",
    "baseline_echo": f"""WITH {_ENRICHED},
y AS (SELECT start_ord AS benchmark_id, prompt, calls, tool_calls, output_tokens, '(ground truth)' AS response_text, tool_calls AS run_calls, output_tokens AS run_tokens, outcome IN ('completed', 'corrected') AS completed_cleanly, logged AS fired FROM p WHERE replayable),
{_scored("y")} SELECT * FROM z""",
    "prompt_normalize": f"SELECT page_id, md5({_NP.format('html')}) AS normalized_md5 FROM pages",
    "keyword_extract": f"WITH {_TEXTS}, y AS (SELECT doc_id, {_KW.format('prompt')} AS kw FROM x WHERE prompt IS NOT NULL) SELECT doc_id, len(kw) AS n_keywords, md5(array_to_string(list_sort(kw), ' ')) AS keywords_md5 FROM y",
    "laplace_score": f"WITH {_TEXTS}, n AS (SELECT count(*) AS n FROM benchmark), y AS (SELECT doc_id, {_hits('x.text', 'b.text')} AS pos, {_hits('x.text', _pick(A.SUFFIXES[1:], 'doc_id'))} AS neg FROM x, n JOIN benchmark b ON b.item_id = x.doc_id % n.n WHERE length(x.text) > 0) SELECT doc_id, round((pos + 1) / CAST(pos + neg + 2 AS DOUBLE), 4) AS label_score FROM y",
    "label_exact": f"WITH {_LABELS} SELECT benchmark_id, key_ord FROM x",
    "label_contains": f"WITH {_LABELS} SELECT benchmark_id, key_ord FROM f",
    "label_union": f"WITH {_LABELS} SELECT * FROM x UNION ALL SELECT benchmark_id, key_ord, 'contained' FROM f WHERE benchmark_id NOT IN (SELECT benchmark_id FROM x)",
    "resample_noise": f"""WITH {_PAIRS}, n2 AS (SELECT count(*) AS n, greatest(3, floor(count(*) * 0.7)) AS size FROM z),
d AS (SELECT rep, score, row_number() OVER (PARTITION BY rep ORDER BY md5('42|' || rep || '|' || benchmark_id), benchmark_id) AS place FROM z, range(20) r(rep)),
o AS (SELECT rep, round(avg(score), 4) AS mean FROM d, n2 WHERE place <= size AND n >= 5 GROUP BY rep)
SELECT count(mean) AS n_valid, round(avg(mean), 4) AS mean, round(median(mean), 4) AS median, round(stddev_samp(mean), 4) AS stdev, min(mean) AS min, max(mean) AS max, round(stddev_samp(mean) * 1.5, 4) AS noise_threshold FROM o HAVING count(mean) >= 3""",
    "resample_components": f"""WITH {_PAIRS}, n2 AS (SELECT count(*) AS n, greatest(3, floor(count(*) * 0.7)) AS size FROM z),
d AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY md5('42|' || rep || '|' || benchmark_id), benchmark_id) AS place FROM z, range(20) r(rep))
SELECT CAST(rep AS INT) AS rep, count(*) AS n_tasks, round(avg(score), 4) AS mean, """
    + ", ".join(f"(CAST(sum(CAST(round({c} * 1000) AS BIGINT)) AS BIGINT) * 20 + count({c})) // nullif(2 * count({c}), 0) / CAST(10000 AS DOUBLE) AS mean_{c}" for c in _PARTS)
    + " FROM d, n2 WHERE place <= size AND n >= 5 GROUP BY rep",
    "corrections_score": f"WITH {_PAIRS}, {_CORRECTED} SELECT * FROM q",
    "experiment": f"""WITH {_PAIRS}, {_CORRECTED}, {_JUDGED}, {_LOG},
a1 AS (SELECT benchmark_id % 12 AS run, round(avg(score), 4) AS score_mean FROM z GROUP BY 1),
a2 AS (SELECT run, greatest(3, floor(count(*) * 0.7)) AS size FROM (SELECT benchmark_id % 12 AS run FROM z) GROUP BY run HAVING count(*) >= 5),
a3 AS (SELECT benchmark_id % 12 AS run, rep, score, row_number() OVER (PARTITION BY benchmark_id % 12, rep ORDER BY md5('42|' || rep || '|' || benchmark_id), benchmark_id) AS place FROM z, range(20) r(rep)),
a4 AS (SELECT run, rep, round(avg(score), 4) AS mean FROM a3 JOIN a2 USING (run) WHERE place <= size GROUP BY run, rep),
a5 AS (SELECT run, round(stddev_samp(mean) * 1.5, 4) AS noise FROM a4 WHERE run <> 4 GROUP BY run HAVING count(mean) >= 3),
a6 AS (SELECT benchmark_id % 12 AS run, count(*) FILTER (WHERE judge_failed) AS jf FROM j WHERE benchmark_id % 12 <> 7 GROUP BY 1),
a7 AS (SELECT benchmark_id % 12 AS run, round(avg((value - 1) / CAST(4 AS DOUBLE)), 4) AS judge FROM (SELECT benchmark_id, unnest([{', '.join(C.DIMENSIONS)}]) AS value FROM j) WHERE value IS NOT NULL GROUP BY 1),
a8 AS (SELECT benchmark_id % 12 AS run, count(*) AS nm, round(avg(label_score), 4) AS cc FROM q GROUP BY 1),
a9 AS (SELECT run_id AS baseline_run, score_mean AS base FROM l WHERE decision IN {_in(C.KEPT)} ORDER BY ord DESC LIMIT 1),
b1 AS (SELECT a1.run, score_mean AS sc, baseline_run, base, CASE WHEN jf IS NOT NULL THEN judge END AS judge, coalesce(jf, 0) AS jf, noise, nm, cc, run % 3 > 0 AS auto, run % 4 = 1 AS skip_v, run % 6 = 0 AS skip_j, sc - base AS delta
  FROM a1 LEFT JOIN a5 USING (run) LEFT JOIN a6 USING (run) LEFT JOIN a7 USING (run) LEFT JOIN a8 USING (run) LEFT JOIN a9 ON true),
b2 AS (SELECT *, baseline_run IS NOT NULL AS has_b, coalesce(delta < 0.02, true) AS f1, NOT skip_v AND noise IS NULL AS f2, NOT skip_v AND noise IS NOT NULL AND coalesce(delta <= noise, baseline_run IS NOT NULL) AS f3, NOT skip_j AND judge IS NULL AS f4,
  coalesce(NOT skip_j AND judge < 0.6, false) AS f5, NOT skip_j AND jf >= 2 AS f6, coalesce(nm > 0 AND cc < 0.4, false) AS f7 FROM b1),
b3 AS (SELECT *, concat_ws(',', CASE WHEN f1 THEN 'delta-floor' END, CASE WHEN f2 THEN 'variance-missing' END, CASE WHEN f3 THEN 'variance' END, CASE WHEN f4 THEN 'judge-missing' END, CASE WHEN f5 THEN 'judge' END, CASE WHEN f6 THEN 'judge-completeness' END, CASE WHEN f7 THEN 'corrections-aligned' END) AS failed FROM b2)
SELECT run, sc AS score_mean, baseline_run, judge AS judge_composite, noise AS noise_threshold, nm AS n_matched, cc AS corrections_composite, round(delta, 6) AS delta, failed,
  CASE WHEN sc IS NULL THEN 'error' WHEN base IS NULL AND NOT has_b THEN CASE WHEN sc < 0.5 THEN 'sanity-floor-rejected' WHEN auto THEN 'first-real-baseline' ELSE 'proposed-first-real-baseline' END
  WHEN NOT auto THEN CASE WHEN failed = '' THEN 'proposed-kept' ELSE 'proposed-reverted' END
  WHEN failed = '' THEN 'kept' WHEN failed = 'delta-floor' AND delta <= -0.02 THEN 'reverted' WHEN failed = 'delta-floor' THEN 'delta-below-floor' WHEN f3 THEN 'noise-rejected' WHEN f5 OR f6 THEN 'judge-rejected'
  WHEN f7 THEN 'corrections-misaligned' WHEN f2 OR f4 THEN 'gates-missing' ELSE 'gates-failed' END AS decision FROM b3""",
    "baseline_seed": f"""WITH {_ENRICHED},
y AS (SELECT start_ord AS benchmark_id, prompt, calls, tool_calls, output_tokens, '(ground truth)' AS response_text, tool_calls AS run_calls, output_tokens AS run_tokens, outcome IN ('completed', 'corrected') AS completed_cleanly, logged AS fired FROM p WHERE replayable),
{_scored("y")} SELECT 'seed-0001' AS run_id, epoch_us(TIMESTAMP '{A.AS_OF}') AS ts_us, 'synthetic-baseline-seed' AS strategy, 'seed' AS decision, round(avg(score), 4) AS score_mean, round(median(score), 4) AS score_median, count(*) AS n_replayed FROM z HAVING count(*) > 0""",
    "budget_prefix": "WITH o AS (SELECT o_custkey, floor(o_totalprice) AS cost, coalesce(sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) SELECT o_custkey, count(*) AS n_run, sum(cost) AS spent FROM o WHERE before < 500000 GROUP BY o_custkey",
    "budget_run": """WITH o AS (SELECT o_orderpriority, o_orderkey, floor(o_totalprice) AS cost, coalesce(sum(floor(o_totalprice)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT o_orderpriority, count(*) AS n_run, sum(cost) AS spent, max(o_orderkey) AS last_ord FROM o WHERE before < (SELECT floor(sum(cost) / 10) FROM o) GROUP BY o_orderpriority""",
    "replay_counts": "WITH o AS (SELECT o_orderpriority AS run, o_orderkey % 9 = 0 AS late, o_orderstatus <> 'O' AS done, o_orderkey % 4 AS n, floor(o_totalprice) AS cost FROM orders), a AS (SELECT run, count(*) AS attempted, count(*) FILTER (WHERE late) AS timed_out, count(*) FILTER (WHERE NOT late AND done) AS completed, count(*) FILTER (WHERE NOT late AND NOT done) AS failed, count(*) FILTER (WHERE n > 0) AS with_tools, round(sum(cost), 2) AS total_cost FROM o GROUP BY run) SELECT *, attempted > 0 AND completed = 0 AS invalid FROM a",
    "judge_normalize": f"WITH {_JUDGED} SELECT benchmark_id, {', '.join(f'CAST({d} AS BIGINT) AS {d}' for d in C.DIMENSIONS)}, judge_failed FROM j",
    "judge_dims": f"WITH {_JUDGED} SELECT dimension, round(avg((value - 1) / 4), 4) AS mean, count(value) AS n FROM v GROUP BY dimension",
    "judge_totals": f"WITH {_JUDGED} SELECT (SELECT count(*) FROM j WHERE NOT judge_failed) AS n_judged, (SELECT count(*) FROM j WHERE judge_failed) AS n_failed, (SELECT round(sum(cost_usd), 4) FROM j) AS total_cost, (SELECT round(avg((value - 1) / 4), 4) FROM v) AS judge_composite",
    "judge_prompts": f"WITH {_TEXTS}, y AS (SELECT doc_id, {_PROMPT} AS pr FROM x) SELECT doc_id, length(pr) AS n_chars, md5(pr) AS prompt_md5 FROM y",
    "baseline_latest": f"WITH {_LOG} SELECT run_id AS baseline_run, score_mean AS baseline_score FROM l WHERE decision IN {_in(C.KEPT)} ORDER BY ord DESC LIMIT 1",
    "decide_inputs": f"""WITH d AS (SELECT event_id AS n, CASE WHEN event_id % 13 < 6 THEN '{{"n_scored": 3, "score_mean": ' || CAST((event_id % 100) / CAST(100 AS DOUBLE) AS VARCHAR) || '}}'
  ELSE {_pick(("", "not json {{", "{{}}", '{{"score_mean": null}}', '{{"score_mean": "0.9"}}', '{{"score_mean": true}}', "[1]"), "event_id")} END AS value FROM events),
k AS (SELECT n, CASE WHEN value <> '' AND json_valid(value) AND json_type(value) = 'OBJECT' THEN CAST(value AS JSON) END AS j FROM d),
t AS (SELECT n, j, json_type(j, '$.score_mean') AS kind FROM k),
r AS (SELECT n, j, kind, CASE WHEN n % 11 = 0 THEN 'run folder missing' WHEN j IS NULL THEN 'scores missing' WHEN kind IS NULL THEN 'scores without score_mean'
  WHEN kind = 'NULL' THEN 'score_mean is null, likely of no replayable task' WHEN kind = 'VARCHAR' THEN 'score_mean is no number, likely of no replayable task' END AS reason FROM t)
SELECT n AS run, CASE WHEN reason IS NULL THEN CASE WHEN kind = 'BOOLEAN' THEN CAST(json_extract_string(j, '$.score_mean') = 'true' AS DOUBLE) ELSE CAST(json_extract_string(j, '$.score_mean') AS DOUBLE) END END AS score_mean, reason FROM r""".replace("{{", "{").replace("}}", "}"),
    "decide_ladder": """WITH i AS (
  SELECT event_id AS run, CASE WHEN event_id % 19 <> 0 THEN CAST(0.5 AS DOUBLE) + (CAST(floor(value) AS BIGINT) % 50) / CAST(100 AS DOUBLE) END AS sc, CASE WHEN event_id % 6 <> 0 THEN CAST(0.5 AS DOUBLE) + (event_id % 40) / CAST(100 AS DOUBLE) END AS base,
    CASE WHEN event_id % 4 <> 0 THEN (event_id % 10) / CAST(10 AS DOUBLE) END AS judge, event_id % 3 AS jf, CASE WHEN event_id % 5 <> 0 THEN (event_id % 8) / CAST(100 AS DOUBLE) END AS noise,
    event_id % 2 AS nm, (event_id % 7) / CAST(10 AS DOUBLE) AS cc, event_id % 9 <> 0 AS auto, event_id % 8 = 0 AS skip_v, event_id % 10 >= 7 AS skip_j FROM events),
d AS (SELECT *, sc - base AS delta FROM i),
g AS (SELECT *, coalesce(delta < 0.02, true) AS f1, NOT skip_v AND noise IS NULL AS f2, coalesce(NOT skip_v AND delta <= noise, false) AS f3, NOT skip_j AND judge IS NULL AS f4, coalesce(NOT skip_j AND judge < 0.6, false) AS f5, NOT skip_j AND jf >= 2 AS f6, nm > 0 AND cc < 0.4 AS f7 FROM d),
o AS (SELECT *, concat_ws(',', CASE WHEN f1 THEN 'delta-floor' END, CASE WHEN f2 THEN 'variance-missing' END, CASE WHEN f3 THEN 'variance' END, CASE WHEN f4 THEN 'judge-missing' END, CASE WHEN f5 THEN 'judge' END, CASE WHEN f6 THEN 'judge-completeness' END, CASE WHEN f7 THEN 'corrections-aligned' END) AS failed FROM g)
SELECT run, round(delta, 6) AS delta, failed, CASE WHEN sc IS NULL THEN 'error' WHEN base IS NULL THEN CASE WHEN sc < 0.5 THEN 'sanity-floor-rejected' WHEN auto THEN 'first-real-baseline' ELSE 'proposed-first-real-baseline' END
  WHEN NOT auto THEN CASE WHEN failed = '' THEN 'proposed-kept' ELSE 'proposed-reverted' END
  WHEN failed = '' THEN 'kept' WHEN failed = 'delta-floor' AND delta <= -0.02 THEN 'reverted' WHEN failed = 'delta-floor' THEN 'delta-below-floor' WHEN f3 THEN 'noise-rejected' WHEN f5 OR f6 THEN 'judge-rejected'
  WHEN f7 THEN 'corrections-misaligned' WHEN f2 OR f4 THEN 'gates-missing' ELSE 'gates-failed' END AS decision FROM o""",
    "strategy_stats": f"WITH {_LOG}, {_STATS} SELECT strategy, tried, kept, lost, epoch_us(last_tried) AS last_tried_us, epoch_us(last_kept) AS last_kept_us, success_rate, recommendation FROM u",
    "strategy_fill": f"WITH {_LOG}, {_STATS} SELECT strategy, coalesce(tried, 0) AS tried, coalesce(kept, 0) AS kept, coalesce(lost, 0) AS lost, coalesce(success_rate, 0.0) AS success_rate, coalesce(recommendation, 'untried') AS recommendation FROM {_DECLARED} FULL JOIN (SELECT * FROM u WHERE strategy IN ('rule-rewrite', 'memory-add', 'user-approval')) USING (strategy)",
    "strategy_explore": "WITH " + _LOG + f", k AS (SELECT count(*) AS n FROM {_DECLARED} WHERE strategy NOT IN (SELECT strategy FROM l WHERE strategy IN ('rule-rewrite', 'memory-add'))) SELECT n AS n_untried, n >= 3 AS explore FROM k",
    "weekly_decisions": f"WITH {_LOG} SELECT decision, count(*) AS n FROM w GROUP BY decision",
    "weekly_trend": f"WITH {_LOG}, k AS (SELECT arg_min(score_mean, (ts, ord)) AS a, arg_max(score_mean, (ts, ord)) AS b, median(score_mean) AS m, count(*) AS n FROM w WHERE score_mean IS NOT NULL) SELECT a AS first_score, b AS last_score, round(m, 4) AS median_score, n AS n_scored, round(b - a, 4) AS delta FROM k",
    "weekly_strategies": f"WITH {_LOG} SELECT strategy, count(*) AS tried, count(*) FILTER (WHERE decision IN {_in(C.KEPT)}) AS kept, round(count(*) FILTER (WHERE decision IN {_in(C.KEPT)}) / CAST(count(*) AS DOUBLE), 3) AS rate FROM w GROUP BY strategy",
    "deadletter_block": f"WITH {_LOG} SELECT run_id, strategy, target_file FROM l WHERE EXISTS (SELECT 1 FROM l k WHERE k.decision = 'user-reverted' AND k.ord % 5 = 0 AND k.strategy = l.strategy AND k.target_file = l.target_file)",
    "deadletter_pairs": f"WITH {_LOG} SELECT strategy, target_file, count(*) AS n_rows, arg_max(run_id, ord) AS last_run FROM l WHERE decision = 'user-reverted' GROUP BY ALL",
    "recent_runs": f"WITH {_LOG} SELECT run_id, decision FROM l ORDER BY ord DESC LIMIT 5",
    "three_strikes": f"WITH {_LOG}, k AS (SELECT stream, run_id, CAST(coalesce(score_mean < 0.85, false) OR decision = 'sanity-floor-rejected' AS INT) AS bad, ord FROM l), o AS (SELECT *, min(bad) OVER (PARTITION BY stream ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS every, row_number() OVER (PARTITION BY stream ORDER BY ord) AS rn FROM k) SELECT stream, run_id FROM o WHERE every = 1 AND rn >= 3",
    "shared_root_cause": f"WITH {_CORRECTIONS}, k AS (SELECT root_cause FROM c ORDER BY ord DESC LIMIT 20) SELECT root_cause, count(*) AS n FROM k GROUP BY root_cause HAVING count(*) >= 2",
    "top_improvements": f"WITH {_PAIRS}, k AS (SELECT benchmark_id, score AS before, round(score * (benchmark_id % 17 + 90) / 100, 4) AS after FROM z) SELECT *, round(after - before, 4) AS change FROM k ORDER BY change DESC, benchmark_id LIMIT 3",
    "top_regressions": f"WITH {_PAIRS}, k AS (SELECT benchmark_id, score AS before, round(score * (benchmark_id % 17 + 90) / 100, 4) AS after FROM z) SELECT *, round(after - before, 4) AS change FROM k ORDER BY change, benchmark_id LIMIT 3",
    "guard_paths": rf"WITH k AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '^/+', '') AS path FROM pages), o AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'plugins/' || path WHEN 1 THEN 'settings.json' ELSE path END AS target FROM k) SELECT page_id, target, {_FORBIDDEN} AS forbidden, NOT (starts_with(target, 'en/') OR starts_with(target, 'memory/') OR starts_with(target, 'corrections.jsonl')) AS outside FROM o",
    "guard_shrink": r"""WITH o AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN left(text, length(text) // 3) ELSE text END AS cut FROM documents),
k AS (SELECT doc_id AS path, len(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda q: regexp_matches(q, '\S'))) AS n_old, CASE WHEN cut IS NOT NULL THEN len(list_filter(regexp_split_to_array(cut, '\r\n|\r|\n'), lambda q: regexp_matches(q, '\S'))) END AS n_new FROM o)
SELECT path, n_old, n_new, CASE WHEN n_new IS NULL THEN 'deleted' WHEN n_old >= 50 AND n_new < 20 THEN 'shrunk' WHEN n_old > 0 AND (n_old - n_new) / CAST(n_old AS DOUBLE) > 0.5 THEN 'halved' ELSE 'safe' END AS status FROM k""",
    "json_extract_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(json_extract_string(props, '$.k')) AS n_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type",
    "parse_model_output": "WITH k AS (SELECT *, (conv_id + turn) % 7 = 0 AS bad FROM conversations) SELECT conv_id, turn, md5(CASE WHEN bad THEN 'not json: ' || left(text, 50) ELSE text END) AS text_md5, CASE WHEN bad THEN 0 ELSE turn * 10 END AS output_tokens, CAST(0 AS BIGINT) AS n_calls, NOT bad AND turn % 3 = 0 AND turn % 4 <> 3 AS completed_cleanly, bad AS parse_error FROM k",
    "project_totals": f"WITH {_MESSAGES} SELECT project, count(*) AS n_tasks, count(DISTINCT session_id) AS n_sessions FROM t GROUP BY project ORDER BY n_tasks DESC, project LIMIT 10",
    "find_run": f"WITH {_LOG} SELECT 'g77' AS run_id, ord, decision, CASE WHEN decision IN {_in(C.KEPT)} THEN 'ok' ELSE 'not-kept' END AS status FROM l WHERE ord % 1000 = 77 ORDER BY ord DESC LIMIT 1",
    "run_ids": "SELECT strftime(ts, '%Y-%m-%d-%H%M') AS run_id, count(*) AS n FROM events GROUP BY 1",
    "suite_readiness": f"{_SUITE} SELECT count(*) FILTER (WHERE replayable) AS n_replayable, count(*) FILTER (WHERE replayable) >= 6 AS ready FROM a6 WHERE pos <= 40",
    "proposals_listed": f"WITH {_LOG} SELECT run_id, strategy, target_file FROM l ORDER BY run_id LIMIT 20",
    "status_row": f"""WITH {_LOG}, k AS (SELECT * FROM l ORDER BY ord DESC LIMIT 5)
SELECT (SELECT string_agg(run_id || ':' || decision, ' ' ORDER BY ord DESC) FROM k) AS last_runs, (SELECT count(*) FROM (SELECT DISTINCT strategy, target_file FROM l WHERE decision = 'user-reverted' AND ord % 5 = 0)) AS n_dead,
  EXISTS (SELECT 1 FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) = DATE '2024-01-20') AS reported_today, run_id AS baseline_run, score_mean AS baseline_score
FROM (SELECT 1) LEFT JOIN (SELECT * FROM l WHERE decision IN {_in(C.KEPT)} ORDER BY ord DESC LIMIT 1) ON true""",
    "report_banner": f"""WITH {_LOG}, d AS (SELECT max(strftime(ts, '%Y-%m-%d')) || '.md' AS name FROM events WHERE event_type = 'signup'), k AS (SELECT *, CASE WHEN ord % 4 <> 0 THEN (ord % 64) / CAST(64 AS DOUBLE) - 0.5 END AS delta FROM l ORDER BY ord DESC LIMIT 1)
SELECT name, run_id || ', ' || decision || ', ' || strategy || CASE WHEN delta IS NULL THEN '' ELSE printf(' (%+.3f)', delta) END AS last_run FROM d LEFT JOIN k ON true WHERE name IS NOT NULL AND NOT name < '2024-01-10'""",
    "guidance_row": f"""WITH {_LOG}, {_STATS}, k AS (SELECT strategy, coalesce(recommendation, 'untried') AS r FROM {_DECLARED} FULL JOIN (SELECT * FROM u WHERE strategy IN ('rule-rewrite', 'memory-add', 'user-approval')) USING (strategy))
SELECT {', '.join(f"coalesce(string_agg(strategy, ', ' ORDER BY strategy) FILTER (WHERE r = {_s(x)}), '') AS {x}" for x in ("promising", "untried", "avoid"))} FROM k""",
    "feedback": f"""{_FEEDBACK}
SELECT 'experiment_log' AS "table", run || CASE act WHEN 'a' THEN '-approved' WHEN 'r' THEN '-rejected' ELSE '-disapproved' END AS run_id, epoch_us(ts) AS ts_us, CASE act WHEN 'a' THEN 'user-approved' WHEN 'r' THEN 'user-rejected' ELSE 'user-reverted' END AS decision,
  CASE act WHEN 'a' THEN 'user-approval' WHEN 'r' THEN 'user-rejection' ELSE 'user-disapproval' END AS strategy, target AS target_file, before AS commit_before, CASE WHEN act <> 'r' THEN 'h' || n END AS commit_after,
  CASE WHEN act = 'd' THEN score END AS score_before, CASE WHEN act = 'a' THEN score END AS score_after,
  CASE act WHEN 'a' THEN 'Manually approved from proposal at proposed/' || n || '.md' WHEN 'r' THEN 'Manually rejected from observation-mode proposal. reason=' || reason ELSE 'Disapproved by user. revert_mode=' || mode || '. reason=' || reason END AS text
FROM good
UNION ALL SELECT 'corrections', NULL, epoch_us(ts), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  concat('workspace|LOOP ', run, ': ', coalesce(s, 'None'), ' on ', target, '|', coalesce(nullif(did, ''), s, '~'), '|', reason, '|avoid this change; do not retry the same (strategy=', coalesce(s, 'None'), ', target=', target, ') pair|',
    CASE act WHEN 'r' THEN 'loop-rejected-in-observation' ELSE 'loop-disapproved' END, '|Dead-letter (strategy=', coalesce(s, 'None'), ', target_file=', target, '). ',
    CASE act WHEN 'r' THEN 'The reason: ' ELSE 'Future /loop runs MUST NOT propose the same pair. The reason the user vetoed: ' END, reason)
FROM good WHERE act <> 'a'
UNION ALL SELECT 'dead_letter', run, epoch_us(ts), NULL, s, target, CASE WHEN act = 'd' THEN before END, NULL, NULL, NULL, concat(CASE act WHEN 'r' THEN 'observation-rejected' ELSE mode END, '|', reason) FROM good WHERE act <> 'a'""",
    "feedback_refused": f"""{_FEEDBACK} SELECT run AS run_id, CASE act WHEN 'a' THEN 'approve' WHEN 'r' THEN 'reject' ELSE 'disapprove' END AS action,
CASE WHEN act <> 'd' THEN 'no-proposal' WHEN decision NOT IN {_in(C.KEPT)} THEN 'not-kept' ELSE 'no-commit' END AS status FROM k WHERE NOT ok""",
    "suite_entries": f"""{_SUITE}
SELECT left(session_id, 8) || '-' || CASE WHEN seg - 1 < 1000 THEN lpad(CAST(seg - 1 AS VARCHAR), 3, '0') ELSE CAST(seg - 1 AS VARCHAR) END AS benchmark_id, session_id, p.prompt, p.project, p.task_type, p.difficulty, p.replayable, epoch_us(p.start_ts) AS first_us,
  p.tool_calls, concat_ws(',', CASE WHEN n_bash > 0 THEN 'Bash=' || n_bash END, CASE WHEN n_edit > 0 THEN 'Edit=' || n_edit END, CASE WHEN n_read > 0 THEN 'Read=' || n_read END) AS tools, coalesce(len(p.files), 0) AS n_files, p.duration AS duration_sec, p.output_tokens, p.outcome, p.logged AS correction_logged
FROM (SELECT {_KEY} FROM a6 WHERE pos <= 40) JOIN p USING ({_KEY})""",
    "diffstat": f"WITH RECURSIVE {_DIFF} SELECT 'c' || 2 * n AS \"commit\", path, change, added, removed FROM x",
    "weekly_kept": f"""WITH RECURSIVE {_LOG}, {_DIFF}
SELECT w.run_id, 'c' || w.ord AS new_commit, x.path || ' | ' || (added + removed) || ' +' || added || ' -' || removed || chr(10) || '1 changed, ' || added || ' added, ' || removed || ' removed' AS summary
FROM w LEFT JOIN x ON 2 * x.n = w.ord WHERE w.decision IN {_in(C.KEPT)}""",
}
ORACLE |= {
    "sql_functions": ORACLE["cost_and_alignment"],
    "phrase_count_listed": ORACLE["phrase_count"],
    # printf goes by the exact binary value, round does not
    "exact_rounding": """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 4000 AS DOUBLE) / 800 + CAST(l_linenumber AS DOUBLE) / 1000 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', x) AS DOUBLE) AS two, CAST(printf('%.3f', x / 3) AS DOUBLE) AS three, CAST(printf('%.1f', x * -7) AS DOUBLE) AS one FROM v""",
    "weekly_table": ORACLE["weekly_strategies"],
    "strategy_table": f"""WITH {_LOG}, {_STATS}
SELECT strategy, coalesce(tried, 0) AS tried, coalesce(kept, 0) AS kept, coalesce(lost, 0) AS lost, coalesce(success_rate, 0.0) AS success_rate, coalesce(recommendation, 'untried') AS recommendation FROM {_DECLARED} FULL JOIN u USING (strategy)""",
    "stream_tasks": ORACLE["segment_tasks"],
    "stream_strategies": ORACLE["strategy_stats"],
    "stream_baseline": ORACLE["baseline_latest"],
}
