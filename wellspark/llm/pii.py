"""Personal data by a semi-Markov conditional random field over candidate segments.

Candidates are whole spans: the matches of the base patterns of each kind, and assignments or free strings that may be
secrets. A segment's score is the weighted sum of features of the *whole* span (its kind, length, share of digits,
distinct characters, the word in front of it, checks such as the Luhn sum) plus a transition weight from the kind of
the segment before it. Candidates are maximal runs of any length, so nothing of a long credential is left over; the
dynamic programme over the sorted candidates - best segmentation that ends at or before each boundary, per last kind -
chooses boundaries and kinds jointly, in time linear in the candidates of a text.

Weights maximise the conditional log-likelihood of gold segmentations (forward and backward sums over all segmentations
give its gradient) on labelled texts of :mod:`wellspark.llm.pii_examples`, in which secrets and look-alikes such as
checksums, identifiers and page slugs stand in equal contexts. So a string is judged the same in every corpus. A ridge
draws the weights to :data:`PRIOR`. Values assigned to a credential's name and strings in an issuer's format are fixed
segments of the programme: it places the others around them. The field adds the kind ``secret``; base spans always stay.

Edge cases: null counts as empty; empty texts have no spans. Offsets are in code points. All scans are linear in the
text. Ids are carried along; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import pii_examples

# Fixed patterns of the base kinds. A local part ends at the @, so it is found from there; digit runs are entered at
# their start only, which gives the same matches in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
# Names of credentials that a value may be assigned to.
NAMES = frozenset("token key secret password passwd apikey api_key access_key auth credential".split())
# The value is only looked at, so that a name inside the value of another name is met as well.
ASSIGNED = re.compile(r"([A-Za-z_]{3,32})\x20?[=:]\x20?[\"']?(?=[A-Za-z0-9+/_.=-]{12})")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
# Public formats of issued credentials, in any case (texts may be upper- or lower-cased), of 20 characters at least.
ISSUED = re.compile(r"(?<![0-9A-Z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Z]{36}|glpat-[0-9A-Z_-]{20,}"
                    r"|xox[abpr]-[0-9A-Z-]{15,}|[rs]k_live_[0-9A-Z]{16,}|AIza[0-9A-Z_-]{35})(?![0-9A-Z])", re.IGNORECASE)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HASH_NAMES = frozenset("commit sha sha1 sha256 sha512 md5 crc checksum hash digest revision rev uuid guid etag build id".split())
FIXED = 1e6  # above any sum of weights
PRIOR = {f"{SECRET}|named:True": 2.0, f"{SECRET}|issued:True": 2.0}
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", SECRET: "[SECRET]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches, found from each @ backwards."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end(), True
            end = m.end()
        at = text.find("@", max(at + 1, end))


def matches(text: str):
    """(kind, start, end, valid) of every match of the base patterns; ``valid`` where its check passes."""
    for a, b, ok in emails(text):
        yield "email", a, b, ok
    if not any(d in text for d in "0123456789"):
        return
    for m in IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256
                                            for p in m.group().split("."))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield "card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        n = sum(c in "0123456789" for c in m.group())
        yield "phone", m.start(), m.end(), 8 <= n <= 15


def secrets(text: str):
    """(start, end, assigned to a credential's name) of strings that may be secrets: values of credentials' names (the
    outermost of nested ones), free strings with a digit, and issued credentials wherever they stand in a run."""
    seen = set()
    if "=" in text or ":" in text:
        end = 0
        for m in ASSIGNED.finditer(text):
            name = m.group(1).lower()
            if m.end() >= end and any(part in NAMES for part in (name, *name.split("_"))):
                end = VALUE.match(text, m.end()).end()
                seen.add((m.end(), end))
                yield m.end(), end, True
    for m in RUN.finditer(text):
        run = m.group()
        if m.span() not in seen and "=" not in run and any(c in "0123456789" for c in run):
            seen.add(m.span())
            yield *m.span(), False
        for i in ISSUED.finditer(text, *m.span()):
            if i.span() not in seen:
                yield *i.span(), False


def shape(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span, apart from its kind."""
    span = text[start:end]
    n = len(span)
    digits = sum(c.isdigit() for c in span)
    marks = {c: span.count(c) for c in set(span)}
    entropy = -sum(k / n * math.log2(k / n) for k in marks.values())
    before = re.split(r"[^\w]+", text[max(0, start - 24) : start].rstrip(" =:\"'"))[-1].lower()
    parts = [p for p in re.split(r"[-_+/=.]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])", span) if p]
    spoken = sum(len(p) for p in parts if len(p) > 2 and p.isalpha() and any(c in "aeiouyAEIOUY" for c in p[1:]) and p[1:].islower())
    case = "both" if span.upper() != span and span.lower() != span else "one"
    return [
        f"length:{min(n.bit_length(), 9)}", f"digits:{4 * digits // n}", f"entropy:{int(2 * entropy)}",
        f"letters:{4 * sum(c.isalpha() for c in span) // n}", f"mixed:{digits > 0 and digits < n}",
        f"named:{any(p in NAMES for p in (before, *before.split('_')))}", f"issued:{bool(ISSUED.fullmatch(span))}",
        f"hex:{all(c in '0123456789abcdef-' for c in span.lower())}", f"case:{case}", f"parts:{min(len(parts), 6) // 2}",
        f"spoken:{4 * spoken // n}", f"hashed:{before in HASH_NAMES}", f"path:{span.count('/') > 1}",
    ]


def candidates(text: str) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, kind, vouched for by a base rule, a credential's name or an issuer's format, features), by end."""
    out = [(a, b, k, ok, [f"{k}|valid:{ok}", f"{k}|bias"]) for k, a, b, ok in matches(text)]
    for a, b, named in secrets(text):
        own = shape(text, a, b)
        out.append((a, b, SECRET, named or "issued:True" in own, [f"{SECRET}|{f}" for f in own] + [f"{SECRET}|bias"]))
    return sorted(out, key=lambda c: (c[1], c[0], c[2]))


def segment(found: list, weights: dict[str, float], fixed: frozenset = frozenset()) -> list:
    """The best set of non-overlapping candidates: dynamic programme over candidates in order of their end. Those whose
    (start, end, kind) is in ``fixed`` are in every segmentation that has room for them."""
    if not found:
        return []
    ends = [c[1] for c in found]
    #: best[i][kind]: (score, chain) over the first i candidates with `kind` chosen last; None for none chosen yet
    best: list[dict] = [{None: (0.0, None)}]
    for i, (start, _, kind, _, feats) in enumerate(found):
        own = sum(weights.get(f, 0.0) for f in feats) + (FIXED if found[i][:3] in fixed else 0.0)
        lo = bisect.bisect_right(ends, start, 0, i)  # the candidates that end at or before this one starts
        now = dict(best[i])
        last, (score, chain) = max(best[lo].items(), key=lambda e: e[1][0] + weights.get(f"{e[0]}>{kind}", 0.0))
        total = score + own + weights.get(f"{last}>{kind}", 0.0)
        if kind not in now or total > now[kind][0]:
            now[kind] = (total, (i, chain))
        best.append(now)
    chain = max(best[-1].values(), key=lambda e: e[0])[1]
    picked = []
    while chain is not None:
        picked.append(found[chain[0]])
        chain = chain[1]
    return picked[::-1]


def gold(found: list) -> list:
    """The segments that the rules vouch for, without overlaps (the longer first)."""
    out = []
    for c in sorted((c for c in found if c[3]), key=lambda c: (c[0] - c[1], c[0], c[2])):
        if all(c[1] <= d[0] or d[1] <= c[0] for d in out):
            out.append(c)
    return sorted(out)


def vouched_secrets(found: list) -> list:
    """Secrets that a credential's name or an issuer's format vouches for, the outermost of nested ones. They do not rest
    on the weights: the sample that these are fitted on may hold none."""
    out, end = [], -1
    for c in sorted((c for c in found if c[3] and c[2] == SECRET), key=lambda c: (c[0], -c[1])):
        if c[0] >= end:
            out.append(c)
            end = c[1]
    return out


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expectations(found: list, weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """(log of the partition function, expected count of every feature and transition) over all segmentations.

    Forward: ``alpha[i][kind]`` sums the segmentations of the first i candidates that end in ``kind`` (None for none
    chosen). Each candidate is either left out or joined to the segmentations that end at or before its start.
    Backward: ``beta`` hands each sum's share of the whole back along the same steps.
    """
    alpha: list[dict] = [{None: 0.0}]
    steps = []
    ends = [c[1] for c in found]
    for i, (start, _, kind, _, feats) in enumerate(found):
        lo = bisect.bisect_right(ends, start, 0, i)
        own = sum(weights.get(f, 0.0) for f in feats)
        ways = {last: v + own + weights.get(f"{last}>{kind}", 0.0) for last, v in alpha[lo].items()}
        now = dict(alpha[i])
        now[kind] = log_sum([*ways.values()] + ([now[kind]] if kind in now else []))
        alpha.append(now)
        steps.append((lo, ways))
    whole = log_sum([*alpha[-1].values()])
    #: beta[i][kind]: probability of the segmentations that pass through alpha[i][kind]
    beta = [dict.fromkeys(a, 0.0) for a in alpha]
    beta[-1] = {kind: math.exp(v - whole) for kind, v in alpha[-1].items()}
    counts: dict[str, float] = {}
    for i in range(len(found) - 1, -1, -1):
        kind, feats = found[i][2], found[i][4]
        lo, ways = steps[i]
        for last, v in alpha[i].items():
            beta[i][last] += beta[i + 1][last] * math.exp(v - alpha[i + 1][last])
        taken = 0.0
        for last, v in ways.items():
            p = beta[i + 1][kind] * math.exp(v - alpha[i + 1][kind])
            beta[lo][last] += p
            counts[f"{last}>{kind}"] = counts.get(f"{last}>{kind}", 0.0) + p
            taken += p
        for f in feats:
            counts[f] = counts.get(f, 0.0) + taken
    return whole, counts


def fit(lists: list[list], steps: int = 60, ridge: float = 0.01, rate: float = 0.5) -> dict[str, float]:
    """Weights that maximise the conditional log-likelihood of the gold segmentations, less a ridge penalty on the distance from PRIOR, by
    gradient steps scaled per feature (Adagrad). Equal candidate lists count together, so repeated rows cost nothing."""
    groups: Counter = Counter()
    for found in lists:  # the programme only asks which candidates end at or before which start
        if found:
            ranks = {at: n for n, at in enumerate(sorted({at for c in found for at in c[:2]}))}
            groups[tuple((ranks[c[0]], ranks[c[1]], c[2], c[3], tuple(c[4])) for c in found)] += 1
    rows, observed = [], {}
    for found, times in sorted(groups.items()):
        rows.append((found, times))
        last = None
        for c in gold(found):
            for f in (*c[4], f"{last}>{c[2]}"):
                observed[f] = observed.get(f, 0.0) + times
            last = c[2]
    n = max(sum(groups.values()), 1)
    weights = dict(PRIOR)
    seen: dict[str, float] = {}
    for _ in range(steps):
        slope = dict.fromkeys(weights, 0.0) | observed
        for found, times in rows:
            for f, e in expectations(found, weights)[1].items():
                slope[f] = slope.get(f, 0.0) - times * e
        for f, g in slope.items():
            g = (g - ridge * (weights.get(f, 0.0) - PRIOR.get(f, 0.0))) / n
            seen[f] = seen.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) + rate * g / (math.sqrt(seen[f]) + 1e-9)
    return dict(sorted(weights.items()))


def labelled(text: str, gold_spans: list[tuple[str, str]]) -> list:
    """The candidates of a training text, marked where they are one of its (kind, span text)."""
    wanted = set(gold_spans)
    return [(a, b, kind, (kind, text[a:b]) in wanted, feats) for a, b, kind, _, feats in candidates(text)]


@lru_cache(maxsize=4)
def _learned(n: int, seed: int) -> tuple[tuple[str, float], ...]:
    return tuple(fit([labelled(t, g) for t, g in pii_examples.examples(n, seed)]).items())


def learn(n: int = 800, seed: int = 9) -> dict[str, float]:
    """Weights from ``n`` training texts (a few seconds on the driver, whatever the corpus; once a process)."""
    return dict(_learned(n, seed))


def spans(text: str | None, weights: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans), each (kind, start, end), by kind as listed, then start."""
    found = candidates(text or "")
    base = [(c[2], c[0], c[1]) for c in found if c[3] and c[2] != SECRET]
    sure = vouched_secrets(found)
    ends = [c[1] for c in sure]
    fixed = frozenset(c[:3] for c in sure)

    def free(c) -> bool:
        at = bisect.bisect_right(ends, c[0])  # the first vouched secret that ends behind the candidate's start
        return at == len(sure) or sure[at][0] >= c[1]

    chosen = segment([c for c in found if free(c) or c[:3] in fixed], weights, fixed)
    more = [(c[2], c[0], c[1]) for c in chosen if c[2] == SECRET and c[:3] not in fixed]
    # a span of the field that crosses a base span yields to it
    more = [m for m in more if all(m[2] <= b[1] or b[2] <= m[1] or (m[1] <= b[1] and b[2] <= m[2]) for b in base)]
    # a vouched one only yields to a longer base span that covers all of it
    places = sorted((b[1], b[2]) for b in base)
    reach = list(itertools.accumulate((b for _, b in places), max))
    same = set(places)
    for a, b, *_ in sure:
        at = bisect.bisect_right(places, (a, math.inf))  # the base spans that start at or before a
        if not at or reach[at - 1] < b or (a, b) in same:
            more.append((SECRET, a, b))
    order = lambda s: ((*KINDS, SECRET).index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def find(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    struct = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]

    def run(batches):
        for batch in batches:
            both = [spans(t.as_py(), weights) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([struct(b) for b, _ in both], kind),
                 pa.array([struct(s) for _, s in both], kind)], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    one = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"doc_id long, base {one}, spans {one}")


def masked(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with every span replaced by its kind's mark; overlapping spans become one mark (of the first)."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans(text, weights)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], MARKS[kind]]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, weights: dict[str, float], text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with masked texts (and their new length in ``length_col``, where there is such a column)."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [masked(t.as_py(), weights) for t in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.length(text_col).cast(kind))
    return out.select(docs.columns)
