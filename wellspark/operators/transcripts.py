"""Agent transcripts as tables: reply parsing, tool calls, stored results and their references, registry and
dependency checks, per-run outcomes and tool usage (F15-F19, P18, P20, J1-J5, S13-S14, A17, A19).

The reference runs these steps inside one agent process per question; here they are joins and grouped
aggregates over all transcripts at once. Generated code is parsed, never executed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspark.functions import parsing as ps
from wellspark.operators.ordered import join_back, row_number_across_buckets
from wellspark.session import materialize, path_exists

MAX_PASSES = 11  # evaluated passes per question (fixed value of the reference loop)
EVIDENCE_RULE = "\n------------------\n"


def parse_replies(df: DataFrame, text_col: str) -> DataFrame:
    """Tagged evaluation replies.

    Adds ``parse_status`` (ok / missing_tag / bad_flag / no_code), ``strategy_change``, ``step_success``,
    ``content`` and ``code``. ``missing_tag``: a flag tag is absent (the reference returns all-false);
    ``bad_flag``: a flag is neither yes nor no (the reference raises); ``no_code``: CONTENT without a python
    block (the reference raises). A missing CONTENT tag gives empty code. Of a repeated tag the last one counts.
    """
    df = df.withColumn("__sections", ps.tag_sections(ps.normalise_tags(text_col)))
    section = lambda tag: ps.tag_section(F.col("__sections"), tag)
    has_flags = section("STRATEGY_CHANGE").isNotNull() & section("STEP_SUCCESS").isNotNull()
    sc, ss = ps.yes_no(section("STRATEGY_CHANGE")), ps.yes_no(section("STEP_SUCCESS"))
    has_content = section("CONTENT").isNotNull()
    content = F.coalesce(section("CONTENT"), F.lit(""))
    code = F.when(has_content, ps.first_code_block(section("CONTENT"))).otherwise(F.lit(""))
    status = (
        F.when(~has_flags, F.lit("missing_tag"))
        .when(sc.isNull() | ss.isNull(), F.lit("bad_flag"))
        .when(code.isNull(), F.lit("no_code"))
        .otherwise(F.lit("ok"))
    )
    return (
        df.withColumn("parse_status", status)
        .withColumn("strategy_change", F.when(has_flags, sc).otherwise(F.lit(False)))
        .withColumn("step_success", F.when(has_flags, ss).otherwise(F.lit(False)))
        .withColumn("content", F.when(has_flags, content).otherwise(F.lit("")))
        .withColumn("code", F.when(has_flags, code).otherwise(F.lit("")))
        .drop("__sections")
    )


def extract_tool_calls(df: DataFrame, keys: Sequence[str], code_col: str) -> DataFrame:
    """one row per ``self.execute_task(...)`` call: ``call_no``, ``task``, ``args`` (array, stripped)."""
    calls = df.select(*keys, F.posexplode(ps.tool_calls(code_col)).alias("call_no", "__c"))
    return calls.select(
        *keys,
        F.col("call_no").cast("long").alias("call_no"),
        F.col("__c.task").alias("task"),
        ps.split_args(F.col("__c.args")).alias("args"),
    )


def check_registry(calls: DataFrame, registry: DataFrame, task_col: str = "task") -> DataFrame:
    """Join calls with the task registry (``task, n_inputs, depends_on``).

    The registry is a fixed list of task definitions (bounded), so it is broadcast. Adds ``known`` and
    ``arity_ok`` (argument count equals the declared inputs; NULL for unknown tasks).
    """
    reg = F.broadcast(registry.withColumnRenamed("task", "__rtask").withColumn("__known", F.lit(True)))
    out = calls.join(reg, F.col(task_col) == F.col("__rtask"), "left")
    return out.withColumn("known", F.coalesce(F.col("__known"), F.lit(False))).withColumn(
        "arity_ok", F.when(F.col("known"), F.size("args") == F.col("n_inputs"))
    ).drop("__rtask", "__known")


def dependency_check(
    actions: DataFrame, run_keys: Sequence[str], order: Sequence[str], task_col: str = "task", dep_col: str = "depends_on"
) -> DataFrame:
    """Did the declared dependency run earlier in the same run?

    First occurrence of every (run, task) is a grouped ``min`` (partial aggregation, one row per run and task);
    each action joins the first occurrence of its dependency on (run, dependency) - an equi join, never all
    pairs. ``dep_ok`` is NULL for actions without a dependency.
    """
    run_keys = list(run_keys)
    pos = F.struct(*[F.col(c) for c in order])
    renamed = [f"__rk{i}" for i in range(len(run_keys))]
    first = actions.groupBy(*[F.col(k).alias(r) for k, r in zip(run_keys, renamed)], F.col(task_col).alias("__dep")).agg(
        F.min(pos).alias("__first")
    )
    cond = [F.col(k) == F.col(r) for k, r in zip(run_keys, renamed)] + [F.col(dep_col) == F.col("__dep")]
    out = actions.withColumn("__pos", pos).join(first, on=cond, how="left")
    return out.withColumn(
        "dep_ok",
        F.when(F.col(dep_col).isNotNull(), F.coalesce(F.col("__first") < F.col("__pos"), F.lit(False))),
    ).drop("__dep", "__first", "__pos", *renamed)


def call_args(calls: DataFrame, run_keys: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per argument: keys, run keys, ``arg_no``, ``arg`` and ``ref_key`` (NULL for plain arguments)."""
    args = calls.select(*keys, *[k for k in run_keys if k not in keys], F.posexplode("args").alias("arg_no", "arg"))
    return args.withColumn("ref_key", ps.datapipe_key(F.col("arg")))


def resolve_refs(
    calls: DataFrame, results: DataFrame, run_keys: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """One row per argument; ``datapipe:<key>`` arguments are replaced by the stored payload of the same run.

    ``results``: ``run keys..., key, data, description``. Adds ``arg_no``, ``arg``, ``ref_key``, ``resolved``
    (NULL for plain arguments, false for an unknown key - an error in the reference) and ``value``. Plain arguments take
    part in the join under a key of their own each, which no result has, so that they gather in no partition.
    """
    run_keys = list(run_keys)
    args = call_args(calls, run_keys, keys)
    own = F.concat(F.lit("-"), F.xxhash64(*keys, "arg_no").cast("string"))
    args = args.withColumn("__ref", F.coalesce("ref_key", own))
    res = results.select(*run_keys, F.col("key").alias("__ref"), F.col("data").alias("__data"))
    out = args.join(res, on=[*run_keys, "__ref"], how="left")
    is_ref = F.col("ref_key").isNotNull()
    return out.withColumns({
        "resolved": F.when(is_ref, F.col("__data").isNotNull()),
        "value": F.when(is_ref, F.col("__data")).otherwise(F.col("arg")),
    }).drop("__data", "__ref")


def used_keys(refs: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """The keys that arguments refer to; ``refs`` from :func:`call_args` or :func:`resolve_refs`."""
    return refs.where(F.col("ref_key").isNotNull()).select(*run_keys, F.col("ref_key").alias("key")).distinct()


def unused_results(results: DataFrame, refs: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Stored results never used as an input in the same run (``left_anti``)."""
    return results.join(used_keys(refs, run_keys), on=[*run_keys, "key"], how="left_anti")


def evidence(
    actions: DataFrame, results: DataFrame, refs: DataFrame, run_keys: Sequence[str]
) -> DataFrame:
    """Evidence block per action: ``task: [inputs]`` then the raw stored payload when the result was stored
    and never used later, else the action's own response text (``datapipe:<key>``)."""
    run_keys = list(run_keys)
    stored = results.select(*run_keys, "key", F.col("data").alias("__payload"), F.lit(False).alias("__used"))
    used = used_keys(refs, run_keys).select(
        *run_keys, "key", F.lit(None).cast(stored.schema["__payload"].dataType).alias("__payload"), F.lit(True).alias("__used"))
    # one row per key with its payload and whether it is used, then one join
    known = stored.unionByName(used).groupBy(*run_keys, "key").agg(
        F.max("__payload").alias("__payload"), F.max("__used").alias("__used"))
    out = actions.join(known, on=[*run_keys, "key"], how="left")
    inputs = F.concat(
        F.lit("["), F.array_join(F.transform("args", lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", "), F.lit("]")
    )
    shown = F.when(F.col("__payload").isNotNull() & ~F.col("__used"), F.col("__payload")).otherwise(
        F.concat(F.lit("datapipe:"), F.col("key"))
    )
    return out.withColumn(
        "evidence",
        F.concat(F.lit(EVIDENCE_RULE), F.col("task"), F.lit(": "), inputs, F.lit("\n"), shown, F.lit(EVIDENCE_RULE)),
    ).withColumn("used", F.coalesce(F.col("__used"), F.lit(False))).drop("__payload", "__used")


def evidence_per_run(blocks: DataFrame, run_keys: Sequence[str], order: str) -> DataFrame:
    """J3 per run: the evidence blocks of :func:`evidence` joined in order, with their number."""
    return blocks.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.expr(f"listagg(evidence, '') WITHIN GROUP (ORDER BY {order})").alias("evidence"),
    )


def react_parse(df: DataFrame, text_col: str, task_names: Sequence[str]) -> DataFrame:
    """thought/action replies. Adds ``outcome`` (action / finish / error / malformed), ``task``,
    ``task_input`` and ``answer``."""
    pattern = ps.react_task_pattern(task_names)
    t = F.col(text_col)
    df = df.withColumns(
        {
            "__has_action": t.rlike(pattern),
            "__full": F.regexp_extract(t, pattern, 0),
            "__task": F.regexp_extract(t, pattern, 1),
            "__input": F.regexp_extract(t, pattern, 2),
            "__fa": F.instr(t, ps.FINAL_ANSWER),
        }
    )
    both_finish_first = F.col("__fa") < F.expr(f"instr({text_col}, __full)")
    start = F.col("__fa") + F.lit(len(ps.FINAL_ANSWER))
    rest = F.substr(t, start, F.length(t))
    nl2 = F.instr(rest, "\n\n")
    # Python's find(..) == -1 slices to the last-but-one character of the whole text
    head = F.when(nl2 > 0, F.substr(rest, F.lit(1), nl2 - 1)).otherwise(
        F.substr(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0)))
    )
    finish_first = F.regexp_replace(head, r"^\s+|\s+$", "")
    finish_only = F.regexp_replace(F.element_at(F.split(t, ps.FINAL_ANSWER, -1), -1), r"^\s+|\s+$", "")
    spaced = F.regexp_replace(F.col("__input"), r"\A +| +\z", "")
    task_input = F.when(spaced.startswith("SELECT "), spaced).otherwise(F.regexp_replace(spaced, r'\A"+|"+\z', ""))
    has_answer = F.col("__fa") > 0
    outcome = (
        F.when(F.col("__has_action") & has_answer & both_finish_first, F.lit("finish"))
        .when(F.col("__has_action") & has_answer, F.lit("error"))
        .when(F.col("__has_action"), F.lit("action"))
        .when(has_answer, F.lit("finish"))
        .otherwise(F.lit("malformed"))
    )
    answer = (
        F.when(F.col("__has_action") & has_answer & both_finish_first, finish_first)
        .when(~F.col("__has_action") & has_answer, finish_only)
    )
    return (
        df.withColumn("outcome", outcome)
        .withColumn("task", F.when(outcome == "action", F.regexp_replace(F.col("__task"), r"^\s+|\s+$", "")))
        .withColumn("task_input", F.when(outcome == "action", task_input))
        .withColumn("answer", answer)
        .drop("__has_action", "__full", "__task", "__input", "__fa")
    )


def run_outcome(
    passes: DataFrame, run_keys: Sequence[str], order: Sequence[str], bucket: Column | None = None,
    max_passes: int = MAX_PASSES,
) -> DataFrame:
    """Per run, the evaluation loop's result over parsed passes (``parse_replies`` output).

    The flags of pass 1 count as no. The loop ends with the first success, with the first error (a bad flag, content
    without code, or both flags yes after pass 1) or after ``max_passes`` passes; ``passes_after_end`` counts the
    passes that it never comes to. Pass numbers come from the distributed row numbering (no whole-run window).
    """
    run_keys = list(run_keys)
    ok = F.col("parse_status") == "ok"
    later = F.col("pass_no") > 1
    change, step = F.col("strategy_change") & later, F.col("step_success") & later
    success = ok & step & ~change
    error = F.col("parse_status").isin("bad_flag", "no_code") | (ok & step & change)
    j = _numbered_passes(passes, run_keys, order, bucket, success, error)
    ev = F.col("pass_no") <= F.least(F.coalesce(F.col("__end"), F.col("n_passes")), F.lit(max_passes))
    return j.groupBy(*run_keys).agg(
        F.first("n_passes").alias("n_passes"),
        F.count_if(ev).alias("attempts"),
        F.count_if(ev & (F.col("parse_status") == "missing_tag")).alias("skipped"),
        F.count_if(ev & error).alias("errors"),
        F.count_if(ev & ok & change & ~step).alias("strategy_changes"),
        F.count_if(ev & ok & ~change & ~step).alias("failures"),
        F.count_if(~ev).alias("passes_after_end"),
        F.max(ev & F.coalesce(success, F.lit(False))).alias("success"),
    )


def _numbered_passes(
    passes: DataFrame, run_keys: list[str], order: Sequence[str], bucket: Column | None, success: Column, error: Column
) -> DataFrame:
    """The passes with their number, their run's number of passes and the number of the pass that ends the loop."""
    numbered = row_number_across_buckets(passes, run_keys, order, "pass_no", bucket=bucket)
    first = numbered.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("n_passes"), F.min(F.when(success | error, F.col("pass_no"))).alias("__end"))
    return join_back(numbered, first, run_keys)


def succeeded_passes(
    passes: DataFrame, run_keys: Sequence[str], order: Sequence[str], bucket: Column | None = None,
    max_passes: int = MAX_PASSES,
) -> DataFrame:
    """Per run, the pass that ends its loop in success (at most one), with ``pass_no``; the rules of
    :func:`run_outcome`."""
    ok = F.col("parse_status") == "ok"
    later = F.col("pass_no") > 1
    change, step = F.col("strategy_change") & later, F.col("step_success") & later
    success = ok & step & ~change
    error = F.col("parse_status").isin("bad_flag", "no_code") | (ok & step & change)
    j = _numbered_passes(passes, list(run_keys), order, bucket, success, error)
    return j.where(success & (F.col("pass_no") == F.col("__end")) & (F.col("pass_no") <= max_passes)).drop(
        "__end", "n_passes")


def append_history(actions: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append the actions of succeeded passes to the history table at ``path`` and return the whole history.

    ``keys`` name an action (run, pass and call number). Actions that the history has are left out by an anti-join that
    takes NULL keys as equal, and rows that repeat within ``actions`` are kept once, so an append that is run again,
    after a lost job or with an overlapping batch, adds nothing. The history is read before it is written: the rows to
    add go through a written table.
    """
    spark, keys = actions.sparkSession, list(keys)
    fresh = actions.dropDuplicates()
    if path_exists(spark, path):
        known = spark.read.schema(actions.schema).parquet(path).select(F.struct(*keys).alias("__key")).distinct()
        fresh = fresh.withColumn("__key", F.struct(*keys)).join(known, on="__key", how="left_anti").drop("__key")
        fresh = materialize(fresh, "history")
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(actions.schema).parquet(path)


def tool_usage(checked: DataFrame, run_keys: Sequence[str], task_col: str = "task") -> DataFrame:
    """Per tool: calls, distinct runs, unknown-tool, wrong-arity and missing-dependency counts."""
    run = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in run_keys])
    aggs = [
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct(run).alias("runs"),
        F.count_if(~F.col("known")).alias("unknown_calls"),
    ]
    if "arity_ok" in checked.columns:
        aggs.append(F.count_if(F.col("arity_ok") == F.lit(False)).alias("wrong_arity"))
    if "dep_ok" in checked.columns:
        aggs.append(F.count_if(F.col("dep_ok") == F.lit(False)).alias("missing_dependency"))
    return checked.groupBy(task_col).agg(*aggs)


def malformed_share(parsed: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    """Per run, the replies of :func:`parse_replies`, those without usable tags, flags or code, and their share."""
    bad = F.count_if(F.col("parse_status") != "ok")
    return parsed.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("n_replies"), bad.alias("n_malformed"),
        (bad / F.count(F.lit(1))).alias("malformed_share"))
