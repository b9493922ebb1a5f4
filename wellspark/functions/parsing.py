"""Column expressions that parse agent replies and transcripts.

Replies are only parsed, never executed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------
# Fixed values of the reply formats (tags, markers, call syntax).
# ---------------------------------------------------------------------------------------------------------
TAGS = ("STRATEGY_CHANGE", "STEP_SUCCESS", "CONTENT")
STOP_TAGS = ("STRATEGY_CHANGE", "STEP_SUCCESS", "STRATEGY_COMPLETE", "CONTENT")
CODE_BLOCK = r"(?i)```python([\s\S]*?)``?"
DECISION_MARKER = "Decision:"
FINAL_ANSWER = "Final Answer:"
TOOL_CALL = (
    r"execute_task\(\s*(?:'([^']*)'|\"([^\"]*)\")\s*,\s*"
    r"\[((?:[^\]'\"]|'[^']*'|\"[^\"]*\")*+)\]\s*\)"
)
QUOTED_ARGUMENT = r"'[^']*'|\"[^\"]*\"|[^,'\"\s][^,]*"
TAG_SEPARATOR = r"(?i)\[(STRATEGY_CHANGE|STEP_SUCCESS|CONTENT)]\s*[-:]\s*"  # becomes "[tag] "
# around the registry's names: the action line in front, the inputs line behind
ACTION_OPENS = r"(?s)\s*Action\s*\d*\s*:[\s]*.*?("
ACTION_INPUTS = r"(?=.*Action\s*\d*\s*Inputs)).*?[\s]*Action\s*\d*\s*Inputs\s*\d*\s*:[\s]*(.*)"
DATAPIPE_REF = r"datapipe:([0-9a-f-]{36})"
# ---------------------------------------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_tags(text: Column | str) -> Column:
    """``[TAG]: value`` / ``[TAG] - value`` -> ``[TAG] value`` (case-insensitive tags)."""
    return F.regexp_replace(_c(text), TAG_SEPARATOR, "[$1] ")


def tag_sections(text: Column) -> Column:
    """``array<struct<tag, body>>`` in order: the text is cut before every line that starts with a known tag, and in
    each part the first reply tag takes all that follows it (a second one on the same line is part of its body)."""
    parts = F.split(text, rf"(?i)\n\s*(?=\[(?:{'|'.join(STOP_TAGS)})])", -1)
    tagged = rf"(?is)\[({'|'.join(TAGS)})](.*)"
    return F.transform(parts, lambda p: F.struct(
        F.upper(F.regexp_extract(p, tagged, 1)).alias("tag"),
        F.regexp_replace(F.regexp_extract(p, tagged, 2), r"^\s+|\s+$", "").alias("body"),
    ))


def tag_section(sections: Column, tag: str) -> Column:
    """The body of the last section of a tag, NULL where the tag is missing."""
    return F.try_element_at(F.filter(sections, lambda s: s["tag"] == tag), F.lit(-1))["body"]


def yes_no(section: Column) -> Column:
    """P20: first word of the section, lower-cased: ``yes`` -> true, ``no`` -> false, anything else -> NULL
    (the reference raises; callers flag the reply as malformed)."""
    word = F.lower(F.regexp_extract(section, r"^\s*(\S+)", 1))
    return F.when(word == "yes", F.lit(True)).when(word == "no", F.lit(False))


def first_code_block(text: Column) -> Column:
    """F16: body of the first ```python block (closed by one or two backticks); NULL when there is none."""
    has = text.rlike(CODE_BLOCK)
    return F.when(has, F.regexp_extract(text, CODE_BLOCK, 1))


def decision_text(text: Column | str) -> Column:
    """the part after the last ``Decision:`` (the whole text when the marker is absent)."""
    return F.element_at(F.split(_c(text), DECISION_MARKER, -1), -1)


def tool_calls(code: Column | str) -> Column:
    """``array<struct<task, args>>`` of ``self.execute_task('<task>', [args])`` calls in order; names and
    arguments in single or double quotes."""
    c = _c(code)
    single = F.regexp_extract_all(c, F.lit(TOOL_CALL), F.lit(1))
    double = F.regexp_extract_all(c, F.lit(TOOL_CALL), F.lit(2))
    names = F.zip_with(single, double, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    args = F.regexp_extract_all(c, F.lit(TOOL_CALL), F.lit(3))
    return F.arrays_zip(names.alias("task"), args.alias("args"))


def split_args(args: Column) -> Column:
    """Argument list text ``'a', 'b'`` -> array of values with whitespace and quotes stripped (F22); a comma inside quotes
    belongs to its value."""
    parts = F.regexp_extract_all(args, F.lit(QUOTED_ARGUMENT), F.lit(0))
    cleaned = F.transform(parts, lambda p: F.regexp_replace(p, r"^[\s'\"]+|[\s'\"]+$", ""))
    return F.when(F.length(F.regexp_replace(args, r"\s", "")) == 0, F.array().cast("array<string>")).otherwise(cleaned)


def datapipe_key(arg: Column) -> Column:
    """The 36-character key of a ``datapipe:<key>`` argument, NULL for plain values."""
    k = F.regexp_extract(arg, DATAPIPE_REF, 1)
    return F.when(k != "", k)


def react_task_pattern(task_names: Sequence[str]) -> str:
    """action pattern of the thought/action reply format for the given registry names."""
    return f"{ACTION_OPENS}(?:{'|'.join(task_names)}){ACTION_INPUTS}"
