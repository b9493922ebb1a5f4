"""String / regex column helpers.

Every helper returns a Column, so the work stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results (patterns, texts, separators).
# ---------------------------------------------------------------------------------------------------------
URL_PATTERN = r"(?i)(https?://\S+|data:image/\w+;base64,[A-Za-z0-9+/=]+)"
URL_TRAILING = ").,;'\""
HTTP_URL_PATTERN = r"https?://\S+"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "gif", "bmp")
LOCAL_IMAGE_PATTERN = r"(?i)(?:(?<=\s)|^)(/[^ \n\t]+\.(?:jpg|jpeg|png|webp|gif|bmp))"
ATTACHMENT_PATTERN = r"address:([a-zA-Z0-9/_-]+\.(?:png|csv|json))"
DEFAULT_IMAGE_QUESTION = (
    "Please answer my question about this image (e.g., healthiness, ingredients, nutrition)."
)
SEARCH_ERROR_TEXT = "Could not get the proper response from the search. Try another search query."
HISTORY_SEPARATOR = "------------"
CHARS_PER_TOKEN = 4
DEFAULT_MAX_TOKENS = 10000
MAX_CHUNK_ANSWER_TOKENS = 2000
# ---------------------------------------------------------------------------------------------------------

# HTML: blocks whose text is not visible, then tags; references are decoded in the text between them.
INVISIBLE_BLOCKS = (
    r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>"
)
# a tag ends at the first '>' outside quotes (a lone quote counts as text)
TAG_PATTERN = r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[^>]*>"
# the character references of HTML5 (the standard library's table: names with their ';', older ones also without it)
NAMED_ENTITIES = html5
OLD_NAMES = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)  # lengths of names without ';'
NUMBER_PATTERN = "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
NAME_PATTERN = "^[^\\t\\n\\f <&#;]{1,32};?"
# numbers that mean another character: 128 to 159 are read as Windows-1252, as browsers do, and some are none at all
REPLACED_NUMBERS = {0: "\ufffd", 13: "\r"} | {
    n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the ASCII whitespace set of Python's ``str.strip()`` / regex ``\s`` (space, tab, LF, VT, FF, CR).
ASCII_WHITESPACE = " \t\n\x0b\x0c\r"
UNICODE_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"  # what ``str.strip()`` takes off


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (Spark ``trim`` removes spaces only); ``btrim`` with the
    whitespace set, no regular expression."""
    return F.btrim(_c(c), F.lit(ASCII_WHITESPACE))


def collapse_ws(c: Column | str) -> Column:
    """``" ".join(s.split())``."""
    return strip_ws(F.regexp_replace(_c(c), r"\s+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's body would compute an outer expression per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def numbered_character(n: Column) -> Column:
    """The character that HTML gives a number (NULL: too large for a number)."""
    special = F.from_json(F.lit(json.dumps({str(n): c for n, c in REPLACED_NUMBERS.items()})), "map<string,string>")
    none = functools.reduce(lambda a, b: a | b, [
        n < 9, n == 11, n.between(14, 31), n.between(127, 159), n.between(64976, 65007), n % 65536 >= 65534])
    return (F.when(n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when((n == 0) | (n == 13) | n.between(128, 159), F.try_element_at(special, n.cast("string")))
            .when(none, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def decode_reference(part: Column) -> Column:
    """The text behind one '&' with the reference that it opens decoded; '&' is put back where it opens none.

    A name is looked up whole; if there is none, its longest beginning among the older names without ';' counts.
    """
    by_letter: dict[str, dict[str, str]] = {}
    for name, character in NAMED_ENTITIES.items():
        by_letter.setdefault(name[0], {})[name] = character
    names = F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")  # folded to one literal

    def rest(n) -> Column:
        return F.substr(part, (F.length(n) if isinstance(n, Column) else F.lit(n)) + 1)

    number, name = F.regexp_extract(part, NUMBER_PATTERN, 0), F.regexp_extract(part, NAME_PATTERN, 0)
    digits = F.regexp_replace(number, "[#;]", "")
    value = F.when(F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits)
    known = F.try_element_at(names, F.substr(part, F.lit(1), F.lit(1)))
    older = [F.when(F.length(name) >= n, F.concat(F.try_element_at(known, F.substr(part, F.lit(1), F.lit(n))), rest(n)))
             for n in OLD_NAMES]
    named = F.coalesce(F.concat(F.try_element_at(known, name), rest(name)), *older, F.concat(F.lit("&"), part))
    return F.when(number != "", F.concat(numbered_character(value.try_cast("bigint")), rest(number))).otherwise(named)


def decode_entities(c: Column | str) -> Column:
    """Every character reference of HTML5 decoded in one pass over the pieces between '&'; nothing is read twice."""
    t = _c(c)

    def decoded(parts: Column) -> Column:
        later = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decode_reference)
        return F.concat(F.element_at(parts, 1), F.array_join(later, ""))

    return F.when(F.instr(t, "&") == 0, t).otherwise(let(F.split(t, "&", -1), decoded))


def html_visible_text(html: Column | str) -> Column:
    """visible text nodes, each decoded and stripped (of Unicode white space too), empties dropped, joined by one
    space."""
    cleaned = F.regexp_replace(_c(html), INVISIBLE_BLOCKS, " ")
    parts = F.split(cleaned, TAG_PATTERN)
    stripped = F.transform(parts, lambda p: F.regexp_replace(decode_entities(p), UNICODE_EDGES, ""))
    kept = F.filter(stripped, lambda p: F.length(p) > 0)
    return F.array_join(kept, " ")


def url_scheme_ok(url: Column | str) -> Column:
    """Scheme must be http or https; unparsable URL -> false."""
    proto = F.lower(F.try_parse_url(_c(url), F.lit("PROTOCOL")))
    return F.coalesce(proto.isin("http", "https"), F.lit(False))


def is_pdf_url(url: Column | str) -> Column:
    """Route ``.pdf`` URLs to the PDF reader."""
    return F.lower(_c(url)).endswith(".pdf")


def status_text(status: Column | str, text: Column | str, msg: str) -> Column:
    """Text when the fetch returned 200, else a fixed message."""
    return F.when(_c(status) == 200, _c(text)).otherwise(F.lit(msg))


def _may_have_url(t: Column) -> Column:
    # cheap substring guard before the regex: most texts carry no link at all
    low = F.lower(t)
    return low.contains("http") | low.contains("data:image")


def first_url(text: Column | str) -> Column:
    """F8: first http(s) or data-image URL, trailing punctuation stripped; NULL when none."""
    t = _c(text)
    m = F.regexp_extract(t, URL_PATTERN, 1)
    stripped = F.regexp_replace(m, r"[).,;'\"]+$", "")
    return F.when(_may_have_url(t) & (m != ""), stripped)


def first_local_image(text: Column | str) -> Column:
    """first local image path at line start or after whitespace; NULL when none."""
    t = _c(text)
    m = F.regexp_extract(t, LOCAL_IMAGE_PATTERN, 1)
    return F.when(t.contains("/") & (m != ""), m)


def strip_image_refs(text: Column | str) -> Column:
    """remove URLs and local image paths, collapse whitespace."""
    t = F.coalesce(_c(text), F.lit(""))
    t = F.when(t.contains("http"), F.regexp_replace(t, HTTP_URL_PATTERN, "")).otherwise(t)
    t = F.when(t.contains("/"), F.regexp_replace(t, LOCAL_IMAGE_PATTERN, "")).otherwise(t)
    return collapse_ws(t)


def question_or_default(text: Column | str) -> Column:
    """the stripped question, or the default instruction when nothing is left."""
    return F.coalesce(F.nullif(strip_image_refs(text), F.lit("")), F.lit(DEFAULT_IMAGE_QUESTION))


def file_name(path: Column | str) -> Column:
    """last path component."""
    return F.element_at(F.split(_c(path), "/"), -1)


def token_estimate(text: Column | str) -> Column:
    """characters / 4."""
    return F.length(_c(text)) / F.lit(float(CHARS_PER_TOKEN))


def kv_line(cols: list[str]) -> Column:
    """``col = val, col = val`` (NULL values print as ``None`` like the reference's f-string)."""
    return F.concat_ws(
        ", ", *[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in cols]
    )


def kv_parse(line: Column | str) -> Column:
    """``col = val, ...`` text -> map<string,string>: split on ',', then on '=', both sides stripped
    (values stay strings). A part without '=' has a NULL value; of a repeated name the last value counts."""
    pairs = F.transform(
        F.split(_c(line), ","),
        lambda p, i: F.struct(
            strip_ws(F.element_at(F.split(p, "="), 1)).alias("k"),
            i.alias("i"),
            strip_ws(F.try_element_at(F.split(p, "="), F.lit(2))).alias("v"),
        ),
    )

    def last_of_each(pairs: Column) -> Column:  # sorted by name and place, a name's last one has another behind it
        return F.filter(pairs, lambda p, i: F.coalesce(F.try_element_at(pairs, i + 2)["k"] != p["k"], F.lit(True)))

    last = let(F.array_sort(pairs), last_of_each)
    placed = F.array_sort(F.transform(last, lambda p: F.struct(p["i"].alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
    return F.map_from_entries(F.transform(placed, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))


def running_totals(numbers: Column, block: int = 64) -> Column:
    """For an array of numbers the sums of those before each, in blocks, so that long arrays take no quadratic time."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def of_blocks(blocks: Column) -> Column:
        def offsets(sums: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, k: let(
                total(F.slice(sums, F.lit(1), k)),
                lambda before: F.transform(b, lambda x, i: before + total(F.slice(b, F.lit(1), i))))))

        return let(F.transform(blocks, total), offsets)

    cut = lambda xs: F.transform(
        F.sequence(F.lit(0), F.size(xs) - 1, F.lit(block)), lambda s: F.slice(xs, s + 1, F.lit(block)))
    return let(numbers, lambda xs: F.when(F.size(xs) > 0, let(cut(xs), of_blocks)).otherwise(F.slice(xs, 1, 0)))
