"""Transcript operators bound to the driver tables.

Stand-ins (SURVEY §7.5): planner replies are built from ``conversations`` rows with fixed templates around each
row's own text; the action log and its stored results are built from ``events`` (one action per event, keyed by
an md5-derived 36-character key, run = calendar day); ``event_type`` is the task name for the dependency check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.functions import parsing as ps
from wellspark.operators import transcripts as tr
from wellspark.session import materialize, scratch_path
from wellspark.sources.tables import table

# Fixed task registry of the reference's wearable tasks: name, number of inputs, declared dependency.
TASK_REGISTRY = (
    ("affect_sleep_get", 3, None),
    ("affect_sleep_analysis", 2, "affect_sleep_get"),
    ("affect_activity_get", 3, None),
    ("affect_activity_analysis", 2, "affect_activity_get"),
    ("affect_ppg_get", 3, None),
    ("affect_ppg_analysis", 1, "affect_ppg_get"),
    ("affect_stress_analysis", 1, "affect_ppg_analysis"),
)
# Five-row registry for the event stand-in (event_type as task name; 'error' is deliberately unregistered).
EVENT_REGISTRY = (
    ("signup", 1, None),
    ("view", 1, None),
    ("click", 1, "view"),
    ("purchase", 2, "click"),
    ("refund", 1, "purchase"),
)
REGISTRY_SCHEMA = "task string, n_inputs int, depends_on string"


def registry(spark: SparkSession, rows=TASK_REGISTRY) -> DataFrame:
    return spark.createDataFrame(list(rows), REGISTRY_SCHEMA)


def md5_key(x: Column) -> Column:
    """Deterministic 36-character key ``8-4-4-4-12`` from the md5 of a value (stands in for uuid4)."""
    m = F.md5(x.cast("string"))
    return F.concat_ws(
        "-", F.substr(m, F.lit(1), F.lit(8)), F.substr(m, F.lit(9), F.lit(4)), F.substr(m, F.lit(13), F.lit(4)),
        F.substr(m, F.lit(17), F.lit(4)), F.substr(m, F.lit(21), F.lit(12)),
    )


def reply_text(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    h = F.length(text)
    sep = F.when(h % 3 == 0, F.lit(": ")).when(h % 3 == 1, F.lit(" - ")).otherwise(F.lit(" "))
    flag1 = F.when(h % 2 == 0, F.lit("yes")).otherwise(F.lit("No"))
    flag2 = (
        F.when(h % 5 == 0, F.lit("maybe")).when(h % 5 == 1, F.lit("Yes")).when(h % 5 == 2, F.lit("yes"))
        .when(h % 5 == 3, F.lit("no")).otherwise(F.lit("Yes, done"))
    )
    task2 = (
        F.when(role == "assistant", F.lit("affect_ppg_analysis"))
        .when(role == "user", F.lit("affect_stress_analysis"))
        .otherwise(F.lit("affect_sleep_show"))
    )
    code = F.concat(
        F.lit("self.execute_task('affect_ppg_get', ['par_"), conv_id.cast("string"),
        F.lit("', '2020-08-01', '2020-08-30'])\nself.execute_task('"), task2, F.lit("', ['datapipe:"),
        md5_key(conv_id * 1000 + turn), F.lit("'])\n"),
    )
    content = F.when(h % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("\n[CONTENT]: "), text, F.lit("\n```python\n"), code, F.lit("``"))
    )
    # some replies hold two tags on one line, some repeat a tag
    gap = F.when(h % 19 == 0, F.lit(" ")).otherwise(F.lit("\n"))
    first = F.when(h % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("[STRATEGY_CHANGE]"), sep, flag1, gap))
    again = F.when(h % 17 == 0, F.lit("\n[STEP_SUCCESS] no")).otherwise(F.lit(""))
    return F.concat(first, F.lit("[step_success]: "), flag2, content, again)


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.coalesce(F.col("text"), F.lit(""))
    return c.select("conv_id", "turn", "role", reply_text(F.col("conv_id"), F.col("turn"), F.col("role"), t).alias("reply"))


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.parse_replies(_replies(spark, sf_dir), "reply")


def reply_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_replies(spark, sf_dir).select(
        "conv_id", "turn", "parse_status", "strategy_change", "step_success", "code"
    )


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed_replies(spark, sf_dir).where(F.col("parse_status") == "ok")
    calls = tr.extract_tool_calls(p, ["conv_id", "turn"], "code")
    checked = tr.check_registry(calls, registry(spark))
    return tr.dependency_check(checked, ["conv_id"], ["turn", "call_no"])


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select(
        "conv_id", "turn", "call_no", "task", F.size("args").cast("long").alias("n_args"), "known", "arity_ok",
        "dep_ok",
    )


def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed_replies(spark, sf_dir)
    out = tr.run_outcome(p, ["conv_id"], ["turn"], bucket=F.floor(F.col("turn") / F.lit(512)))
    return out.select(
        "conv_id", F.col("n_passes").cast("long"), F.col("attempts").cast("long"), F.col("skipped").cast("long"),
        F.col("errors").cast("long"), F.col("strategy_changes").cast("long"), F.col("failures").cast("long"),
        F.col("passes_after_end").cast("long"), "success",
    )


def action_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of each run's succeeded pass, appended to a history table in two overlapping batches, of which the
    second comes twice, as after a lost job."""
    done = tr.succeeded_passes(parsed_replies(spark, sf_dir), ["conv_id"], ["turn"],
                               bucket=F.floor(F.col("turn") / F.lit(512)))
    calls = tr.extract_tool_calls(done, ["conv_id", "pass_no"], "code")
    calls = materialize(calls.select("conv_id", "pass_no", "call_no", "task", F.concat_ws(", ", "args").alias("inputs")),
                        "calls")
    path = scratch_path(spark, f"tables/action-history-{uuid.uuid4().hex[:12]}")
    keys = ["conv_id", "pass_no", "call_no"]
    tr.append_history(calls.where(F.col("task") == "affect_ppg_get"), path, keys)
    tr.append_history(calls, path, keys)
    return tr.append_history(calls, path, keys)


def decision_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.coalesce(F.col("text"), F.lit(""))
    msg = F.when(
        F.col("role") == "assistant",
        F.concat(t, F.lit("\nDecision: "), F.col("role"), F.lit(" turn "), F.col("turn").cast("string")),
    ).otherwise(t)
    return c.select("conv_id", "turn", F.concat(F.lit("Decision:\n"), ps.decision_text(msg)).alias("decision"))


def react_message(conv_id: Column, role: Column, text: Column) -> Column:
    h = F.length(text)
    c = conv_id.cast("string")
    return (
        F.when(role == "system", text)
        .when(h % 4 == 0, F.concat(F.lit('Thought: need data\nAction: affect_sleep_get\nAction Inputs: "par_'), c,
                                   F.lit(', 2020-08-01"\n')))
        .when(h % 4 == 1, F.concat(F.lit("Thought: ok\nFinal Answer: "), text))
        .when(h % 4 == 2, F.concat(F.lit("Final Answer: "), text, F.lit("\n\nAction: affect_ppg_get\nAction Inputs: par_"), c))
        .otherwise(F.concat(F.lit("Action: affect_ppg_get\nAction Inputs: x\nFinal Answer: "), text))
    )


def react_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = F.coalesce(F.col("text"), F.lit(""))
    msgs = c.select("conv_id", "turn", react_message(F.col("conv_id"), F.col("role"), t).alias("msg"))
    out = tr.react_parse(msgs, "msg", [r[0] for r in TASK_REGISTRY])
    return out.select("conv_id", "turn", "outcome", "task", "task_input", "answer")


def action_log(spark: SparkSession, sf_dir: str):
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("long")
    actions = ev.select(
        F.to_date("ts").alias("run_id"),
        "event_id",
        "user_id",
        F.col("event_type").alias("task"),
        md5_key(F.col("event_id")).alias("key"),
        F.array(
            F.concat(F.lit("datapipe:"), md5_key(F.col("event_id") - 1 - k % 3)),
            F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")),
        ).alias("args"),
    )
    results = ev.select(
        F.to_date("ts").alias("run_id"),
        md5_key(F.col("event_id")).alias("key"),
        F.concat(F.lit('{"event": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"),
                 F.lit('"}')).alias("data"),
        F.concat(F.lit("Output of "), F.col("event_type")).alias("description"),
    )
    return actions, results, tr.call_args(actions, ["run_id"], ["event_id"])


def action_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, results, _ = action_log(spark, sf_dir)
    refs = tr.resolve_refs(actions, results, ["run_id"], ["event_id"])
    return refs.select("event_id", "arg_no", "arg", "ref_key", "resolved", "value")


def unused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, results, refs = action_log(spark, sf_dir)
    return tr.unused_results(results, refs, ["run_id"]).select("run_id", "key")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, results, refs = action_log(spark, sf_dir)
    return tr.evidence(actions, results, refs, ["run_id"]).select("event_id", "used", "evidence")


def _event_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("task"))
    ev = ev.withColumn("args", F.array(F.col("user_id").cast("string")))
    checked = tr.check_registry(ev, registry(spark, EVENT_REGISTRY))
    return tr.dependency_check(checked, ["user_id"], ["ts", "event_id"])


def dependency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_tasks(spark, sf_dir).select("event_id", "user_id", "task", "known", "depends_on", "dep_ok")


def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = tr.tool_usage(_event_tasks(spark, sf_dir), ["user_id"])
    return u.select("task", "calls", "runs", "unknown_calls", "wrong_arity", "missing_dependency")


QUERIES = {
    "reply_tags": reply_tags,
    "tool_calls": tool_calls,
    "run_outcome": run_outcome,
    "action_history": action_history,
    "decision_text": decision_text,
    "react_parse": react_parse,
    "action_refs": action_refs,
    "unused_results": unused_results,
    "evidence": evidence,
    "dependency_check": dependency_check,
    "tool_usage": tool_usage,
}


# ------------------------------------------------------------------ oracles (DuckDB SQL, RE2 regexes)
def _md5key(x: str) -> str:
    m = f"md5(CAST({x} AS VARCHAR))"
    return (f"concat_ws('-', substr({m}, 1, 8), substr({m}, 9, 4), substr({m}, 13, 4), substr({m}, 17, 4), "
            f"substr({m}, 21, 12))")


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else (str(v) if isinstance(v, int) else f"'{v}'")
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ") AS r(task, n_inputs, depends_on)"


_STOPS = "|".join(ps.STOP_TAGS)
_TAGGED = f"(?is)\\[({'|'.join(ps.TAGS)})\\](.*)"


def _section(tag: str) -> str:
    return f"list_filter(parts, lambda p: p.tag = '{tag}')[-1].body"


def _yes_no(sec: str) -> str:
    w = f"lower(regexp_extract({sec}, '^\\s*(\\S+)', 1))"
    return f"CASE WHEN {w} = 'yes' THEN TRUE WHEN {w} = 'no' THEN FALSE END"


_CODE = "(?i)```python([\\s\\S]*?)``?"

_REPLIES = f"""
  base AS (SELECT conv_id, turn, role, COALESCE(text, '') AS text, length(COALESCE(text, '')) AS h FROM conversations),
  rep AS (SELECT conv_id, turn, concat(
      CASE WHEN h % 11 = 0 THEN '' ELSE concat('[STRATEGY_CHANGE]',
           CASE WHEN h % 3 = 0 THEN ': ' WHEN h % 3 = 1 THEN ' - ' ELSE ' ' END,
           CASE WHEN h % 2 = 0 THEN 'yes' ELSE 'No' END, CASE WHEN h % 19 = 0 THEN ' ' ELSE chr(10) END) END,
      '[step_success]: ',
      CASE WHEN h % 5 = 0 THEN 'maybe' WHEN h % 5 = 1 THEN 'Yes' WHEN h % 5 = 2 THEN 'yes' WHEN h % 5 = 3 THEN 'no'
           ELSE 'Yes, done' END,
      CASE WHEN h % 7 = 0 THEN '' ELSE concat(chr(10), '[CONTENT]: ', text, chr(10), '```python', chr(10),
           'self.execute_task(''affect_ppg_get'', [''par_', CAST(conv_id AS VARCHAR),
           ''', ''2020-08-01'', ''2020-08-30''])', chr(10), 'self.execute_task(''',
           CASE WHEN role = 'assistant' THEN 'affect_ppg_analysis' WHEN role = 'user' THEN 'affect_stress_analysis'
                ELSE 'affect_sleep_show' END,
           ''', [''datapipe:', {_md5key('conv_id * 1000 + turn')}, '''])', chr(10), '``') END,
      CASE WHEN h % 17 = 0 THEN concat(chr(10), '[STEP_SUCCESS] no') ELSE '' END) AS reply
    FROM base),
  cl AS (SELECT conv_id, turn,
      regexp_replace(reply, '(?i)\\[(STRATEGY_CHANGE|STEP_SUCCESS|CONTENT)\\]\\s*[-:]\\s*', '[\\1] ', 'g') AS clean
    FROM rep),
  prt AS (SELECT conv_id, turn, list_transform(
      string_split(regexp_replace(clean, '(?i)\\n\\s*(\\[(?:{_STOPS})\\])', chr(1) || '\\1', 'g'), chr(1)),
      lambda p: {{'tag': upper(regexp_extract(p, '{_TAGGED}', 1)),
                  'body': regexp_replace(regexp_extract(p, '{_TAGGED}', 2), '^\\s+|\\s+$', '', 'g')}}) AS parts
    FROM cl),
  pck AS (SELECT conv_id, turn, {_section('STRATEGY_CHANGE')} AS sc_text, {_section('STEP_SUCCESS')} AS ss_text,
      {_section('CONTENT')} AS content
    FROM prt),
  sec AS (SELECT conv_id, turn, content, sc_text IS NOT NULL AND ss_text IS NOT NULL AS has_flags,
      content IS NOT NULL AS has_content, {_yes_no('sc_text')} AS sc, {_yes_no('ss_text')} AS ss
    FROM pck),
  cod AS (SELECT *, CASE WHEN NOT has_content THEN ''
                          WHEN regexp_matches(content, '{_CODE}') THEN regexp_extract(content, '{_CODE}', 1) END AS code0
    FROM sec),
  parsed AS (SELECT conv_id, turn,
      CASE WHEN NOT has_flags THEN 'missing_tag' WHEN sc IS NULL OR ss IS NULL THEN 'bad_flag'
           WHEN code0 IS NULL THEN 'no_code' ELSE 'ok' END AS parse_status,
      CASE WHEN has_flags THEN sc ELSE FALSE END AS strategy_change,
      CASE WHEN has_flags THEN ss ELSE FALSE END AS step_success,
      CASE WHEN has_flags THEN code0 ELSE '' END AS code
    FROM cod)"""

_TOOL = "self\\.execute_task\\(\\s*''([^'']*)''\\s*,\\s*\\[(.*?)\\]\\s*\\)"

_CALLS = f"""{_REPLIES},
  ex AS (SELECT conv_id, turn, regexp_extract_all(code, '{_TOOL}', 1) AS names,
                regexp_extract_all(code, '{_TOOL}', 2) AS argl
         FROM parsed WHERE parse_status = 'ok'),
  calls AS (SELECT conv_id, turn, CAST(i AS BIGINT) AS call_no, names[i + 1] AS task,
      CASE WHEN length(regexp_replace(argl[i + 1], '\\s', '', 'g')) = 0 THEN 0
           ELSE len(string_split(argl[i + 1], ',')) END AS n_args
    FROM (SELECT *, unnest(generate_series(0, len(names) - 1)) AS i FROM ex)),
  reg AS (SELECT * FROM {_values(TASK_REGISTRY)}),
  chk AS (SELECT c.*, reg.task IS NOT NULL AS known,
                 CASE WHEN reg.task IS NOT NULL THEN c.n_args = reg.n_inputs END AS arity_ok, reg.depends_on
          FROM calls c LEFT JOIN reg ON c.task = reg.task),
  firsts AS (SELECT conv_id, task, min(turn * 1000000 + call_no) AS first_pos FROM calls GROUP BY 1, 2)"""

# the evaluation loop: what each pass is, and whether the loop comes to it (ev)
_LOOP = f"""
      num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pass_no FROM parsed),
      fl AS (SELECT *, CASE
               WHEN parse_status = 'missing_tag' THEN 'skipped'
               WHEN parse_status <> 'ok' THEN 'error'
               WHEN pass_no = 1 OR NOT (strategy_change OR step_success) THEN 'failure'
               WHEN strategy_change AND step_success THEN 'error'
               WHEN step_success THEN 'success' ELSE 'change' END AS what FROM num),
      j AS (SELECT *, count(*) FILTER (WHERE what IN ('error', 'success'))
                        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0
                      AND pass_no <= {tr.MAX_PASSES} AS ev
            FROM fl)"""

_EVENTS_LOG = f"""
  acts AS (SELECT CAST(ts AS DATE) AS run_id, event_id, event_type AS task, {_md5key('event_id')} AS key,
                  [concat('datapipe:', {_md5key("event_id - 1 - CAST(json_extract_string(props, '$.k') AS BIGINT) % 3")}),
                   concat(' ', CAST(user_id AS VARCHAR), ' ')] AS args
           FROM events),
  res AS (SELECT CAST(ts AS DATE) AS run_id, {_md5key('event_id')} AS key,
                 concat('{{"event": ', CAST(event_id AS VARCHAR), ', "type": "', event_type, '"}}') AS data
          FROM events),
  args AS (SELECT run_id, event_id, CAST(i - 1 AS INTEGER) AS arg_no, args[i] AS arg,
                  NULLIF(regexp_extract(args[i], 'datapipe:([0-9a-f-]{{36}})', 1), '') AS ref_key
           FROM (SELECT *, unnest(generate_series(1, len(args))) AS i FROM acts)),
  refs AS (SELECT a.*, res.data AS data FROM args a LEFT JOIN res ON a.run_id = res.run_id AND a.ref_key = res.key),
  used AS (SELECT DISTINCT run_id, ref_key AS key FROM refs WHERE ref_key IS NOT NULL)"""

_EVENT_DEPS = f"""
  reg AS (SELECT * FROM {_values(EVENT_REGISTRY)}),
  chk AS (SELECT e.event_id, e.user_id, e.ts, e.event_type AS task, reg.task IS NOT NULL AS known, reg.depends_on
          FROM events e LEFT JOIN reg ON e.event_type = reg.task),
  dep AS (SELECT c.*, CASE WHEN c.depends_on IS NOT NULL THEN EXISTS (
              SELECT 1 FROM events e2 WHERE e2.user_id = c.user_id AND e2.event_type = c.depends_on
                AND (e2.ts < c.ts OR (e2.ts = c.ts AND e2.event_id < c.event_id))) END AS dep_ok
          FROM chk c)"""

_FA = "Final Answer:"
_REACT_RE = ("(?s)\\s*Action\\s*\\d*\\s*:[\\s]*.*?((?:" + "|".join(r[0] for r in TASK_REGISTRY) +
             ")).*?[\\s]*Action\\s*\\d*\\s*Inputs\\s*\\d*\\s*:[\\s]*(.*)")

ORACLES = {
    "reply_tags": f"WITH {_REPLIES} SELECT conv_id, turn, parse_status, strategy_change, step_success, code FROM parsed",
    "tool_calls": f"""WITH {_CALLS}
      SELECT c.conv_id, c.turn, c.call_no, c.task, CAST(c.n_args AS BIGINT) AS n_args, c.known, c.arity_ok,
             CASE WHEN c.depends_on IS NOT NULL
                  THEN COALESCE(f.first_pos < c.turn * 1000000 + c.call_no, FALSE) END AS dep_ok
      FROM chk c LEFT JOIN firsts f ON f.conv_id = c.conv_id AND f.task = c.depends_on""",
    "action_history": f"""WITH {_REPLIES}, {_LOOP},
      ex AS (SELECT conv_id, pass_no, regexp_extract_all(code, '{_TOOL}', 1) AS names,
               regexp_extract_all(code, '{_TOOL}', 2) AS argl FROM j WHERE ev AND what = 'success')
      SELECT conv_id, pass_no, CAST(i AS BIGINT) AS call_no, names[i + 1] AS task,
        array_to_string(list_transform(string_split(argl[i + 1], ','),
          lambda a: trim(regexp_replace(a, '^\\s*[''"]|[''"]\\s*$', '', 'g'))), ', ') AS inputs
      FROM (SELECT *, unnest(generate_series(0, len(names) - 1)) AS i FROM ex)""",
    "run_outcome": f"""WITH {_REPLIES}, {_LOOP}
      SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_passes,
        CAST(COUNT(*) FILTER (WHERE ev) AS BIGINT) AS attempts,
        CAST(COUNT(*) FILTER (WHERE ev AND what = 'skipped') AS BIGINT) AS skipped,
        CAST(COUNT(*) FILTER (WHERE ev AND what = 'error') AS BIGINT) AS errors,
        CAST(COUNT(*) FILTER (WHERE ev AND what = 'change') AS BIGINT) AS strategy_changes,
        CAST(COUNT(*) FILTER (WHERE ev AND what = 'failure') AS BIGINT) AS failures,
        CAST(COUNT(*) FILTER (WHERE NOT ev) AS BIGINT) AS passes_after_end,
        bool_or(ev AND what = 'success') AS success
      FROM j GROUP BY conv_id""",
    "decision_text": """
      SELECT conv_id, turn, concat('Decision:', chr(10), string_split(
        CASE WHEN role = 'assistant' THEN concat(COALESCE(text, ''), chr(10), 'Decision: ', role, ' turn ',
                                                 CAST(turn AS VARCHAR))
             ELSE COALESCE(text, '') END, 'Decision:')[-1]) AS decision
      FROM conversations""",
    "react_parse": f"""
      WITH b AS (SELECT conv_id, turn, role, COALESCE(text, '') AS text, length(COALESCE(text, '')) AS h
                 FROM conversations),
      m AS (SELECT conv_id, turn, CASE
              WHEN role = 'system' THEN text
              WHEN h % 4 = 0 THEN concat('Thought: need data', chr(10), 'Action: affect_sleep_get', chr(10),
                                         'Action Inputs: "par_', CAST(conv_id AS VARCHAR), ', 2020-08-01"', chr(10))
              WHEN h % 4 = 1 THEN concat('Thought: ok', chr(10), '{_FA} ', text)
              WHEN h % 4 = 2 THEN concat('{_FA} ', text, chr(10), chr(10), 'Action: affect_ppg_get', chr(10),
                                         'Action Inputs: par_', CAST(conv_id AS VARCHAR))
              ELSE concat('Action: affect_ppg_get', chr(10), 'Action Inputs: x', chr(10), '{_FA} ', text) END AS msg
            FROM b),
      x AS (SELECT conv_id, turn, msg, regexp_matches(msg, '{_REACT_RE}') AS has_action,
                   regexp_extract(msg, '{_REACT_RE}', 0) AS full_m,
                   regexp_extract(msg, '{_REACT_RE}', 1) AS task_m,
                   regexp_extract(msg, '{_REACT_RE}', 2) AS input_m,
                   strpos(msg, '{_FA}') AS fa
            FROM m),
      y AS (SELECT *, fa > 0 AS has_answer, fa < strpos(msg, full_m) AS finish_first,
                   substr(msg, fa + {len(_FA)}) AS rest FROM x),
      z AS (SELECT *, CASE WHEN has_action AND has_answer AND finish_first THEN 'finish'
                           WHEN has_action AND has_answer THEN 'error'
                           WHEN has_action THEN 'action'
                           WHEN has_answer THEN 'finish' ELSE 'malformed' END AS outcome,
                      trim(input_m, ' ') AS spaced
            FROM y)
      SELECT conv_id, turn, outcome,
        CASE WHEN outcome = 'action' THEN regexp_replace(task_m, '^\\s+|\\s+$', '', 'g') END AS task,
        CASE WHEN outcome = 'action' THEN
          CASE WHEN starts_with(spaced, 'SELECT ') THEN spaced ELSE trim(spaced, '"') END END AS task_input,
        CASE WHEN has_action AND has_answer AND finish_first THEN regexp_replace(
               CASE WHEN strpos(rest, chr(10) || chr(10)) > 0 THEN substr(rest, 1, strpos(rest, chr(10) || chr(10)) - 1)
                    ELSE substr(rest, 1, greatest(length(rest) - 1, 0)) END, '^\\s+|\\s+$', '', 'g')
             WHEN NOT has_action AND has_answer THEN regexp_replace(string_split(msg, '{_FA}')[-1], '^\\s+|\\s+$', '', 'g')
        END AS answer
      FROM z""",
    "action_refs": f"""WITH {_EVENTS_LOG}
      SELECT event_id, arg_no, arg, ref_key,
             CASE WHEN ref_key IS NOT NULL THEN data IS NOT NULL END AS resolved,
             CASE WHEN ref_key IS NOT NULL THEN data ELSE arg END AS value
      FROM refs""",
    "unused_results": f"""WITH {_EVENTS_LOG}
      SELECT run_id, key FROM res WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.run_id = res.run_id AND u.key = res.key)""",
    "evidence": f"""WITH {_EVENTS_LOG}
      SELECT a.event_id, u.key IS NOT NULL AS used,
        concat(chr(10), '------------------', chr(10), a.task, ': [',
               array_to_string(list_transform(a.args, lambda v: concat('''', v, '''')), ', '), ']', chr(10),
               CASE WHEN r.data IS NOT NULL AND u.key IS NULL THEN r.data ELSE concat('datapipe:', a.key) END,
               chr(10), '------------------', chr(10)) AS evidence
      FROM acts a LEFT JOIN res r ON a.run_id = r.run_id AND a.key = r.key
      LEFT JOIN used u ON a.run_id = u.run_id AND a.key = u.key""",
    "dependency_check": f"WITH {_EVENT_DEPS} SELECT event_id, user_id, task, known, depends_on, dep_ok FROM dep",
    "tool_usage": f"""WITH {_EVENT_DEPS}
      SELECT task, COUNT(*) AS calls, COUNT(DISTINCT CAST(user_id AS VARCHAR)) AS runs,
             COUNT(*) FILTER (WHERE NOT known) AS unknown_calls,
             COUNT(*) FILTER (WHERE known AND 1 <> n_inputs) AS wrong_arity,
             COUNT(*) FILTER (WHERE dep_ok = FALSE) AS missing_dependency
      FROM dep LEFT JOIN reg USING (task) GROUP BY task""",
}
