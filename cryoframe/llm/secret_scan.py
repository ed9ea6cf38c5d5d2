"""Secrets by pattern and by sliding-window entropy, with built-in functions only.

Beside three fixed patterns, candidate strings of at least ``WINDOW`` characters that mix letters and
digits are scored with the largest Shannon entropy of any ``WINDOW`` characters in a row.  The window
slides by counts, five bits for each of the characters that a candidate can have: each step adds one
to a count, takes one from another and mends the sum of n log n by these two.  The threshold depends on
the character class of the candidate, and allow-listed forms are suppressed.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, apart, bound, find_spans, joined, part, pieces

WINDOW = 20
#: Smallest entropy in bits, by character class, of a window in a secret.
LEAST_BITS = {"hex": 3.0, "mixed": 3.6}
#: Forms of long strings that are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|xxxx|changeme",
    r"(?i)^sha(1|256|384|512)-",
    r"(?i)abcdefghij|0123456789",
    r"^(?:[A-Za-z]++[_/-])++[A-Za-z]*+[_/-]?[0-9]{0,4}$",
)
#: Context right before a candidate that marks it as a checksum or an address.
ALLOWED_BEFORE = r"(?i)(commit|checksum|digest|etag|md5|sha1|sha256|https?:/{0,2}[^ ]*)[ :=]*$"

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["\x27]?+\x20*+[:=]\x20*+["\x27]?+[A-Za-z0-9+/_.=-]++"""
_ASSIGN_VALUE = r"""^[A-Za-z_]+["\x27]?\x20*[:=]\x20*["\x27]?"""
_ACCESS = r"AKIA[A-Z0-9]++"
_HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"


#: The characters of candidates; their counts lie twelve to a long of an array.
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_TO_A_LONG, _BITS = 12, 5


def window_entropy(value: str, window: int = WINDOW) -> str:
    """SQL for the largest entropy, in bits, of any ``window`` (at most 30) characters in a row of ``value``."""
    f = "array(" + ", ".join(f"{k * log2(k) if k else 0.0!r}D" for k in range(window + 2)) + ")"
    spot = lambda c: f"cast({c} div {_TO_A_LONG} as int)"
    shift = lambda c: f"{_BITS} * ({c} % {_TO_A_LONG})"
    held = lambda c: f"cast(shiftright(acc.n[{spot(c)}], {shift(c)}) & {(1 << _BITS) - 1} as int)"
    new, old = "w[i]", f"w[i - {window}]"
    enter = f"{f}[{held(new)} + 1] - {f}[{held(new)}]"
    count = f"({held(old)} + cast({new} = {old} as int))"
    total = f"acc.s + {enter} - if(i >= {window}, {f}[{count}] - {f}[{count} - 1], 0D)"
    one = lambda c: f"if(j = {spot(c)}, shiftleft(1L, {shift(c)}), 0L)"
    counts = f"transform(acc.n, (c, j) -> c + {one(new)} - if(i >= {window}, {one(old)}, 0L))"
    best = f"greatest(acc.best, if(i >= {window} - 1, {log2(window)!r}D - ({total}) / {window}, 0D))"
    fold = f"""aggregate(sequence(0, size(w) - 1), named_struct('n', array_repeat(0L, {-(-len(_ALPHABET) // _TO_A_LONG)}), 's', 0D, 'best', 0D),
        (acc, i) -> named_struct('n', {counts}, 's', {total}, 'best', {best}), acc -> acc.best)"""
    return bound(f"transform(split({value}, ''), c -> locate(c, '{_ALPHABET}') - 1)", "w", fold)


def _base_spans(rows: DataFrame) -> DataFrame:
    raw = rows.withColumns({
        "assign": find_spans("text", _ASSIGN, "assign", 0, "contains(text, ':') or contains(text, '=')"),
        "access": find_spans("text", _ACCESS, "access", 1, "contains(text, 'AKIA')"),
        "hex": find_spans("text", _HEX, "hex", 2, "length(text) >= 32"),
        "loose": find_spans("text", _CANDIDATE, "entropy", 3, f"length(text) >= {WINDOW}"),
    })
    return raw.withColumns({
        "assign": F.expr(f"filter(assign, s -> length(regexp_replace(s.value, r'{_ASSIGN_VALUE}', '')) >= 8)"),
        "access": F.expr("filter(access, s -> length(s.value) >= 16)"),
    }).withColumn("base", F.expr("sort_array(concat(assign, access, hex))"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy``.

    Base spans are the leftmost non-overlapping matches of each pattern: an assignment to a secret's
    name with a value of 8 characters or more, an access key id of 16 or more, a lower-case hex run of
    32 or more.  The entropy method adds spans of kind ``entropy`` that overlap no base span.

    Null and empty texts have no spans (``spans`` is empty, ``base_sha256`` that of the empty string).
    Very long texts are searched whole; repeated rows and null doc_ids are each judged by their text;
    other columns are ignored.  Spans that start together are ordered by kind as listed.  An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _base_spans(rows)
    allowed = " or ".join(f"rlike(s.value, r'{p}')" for p in ALLOWED)
    before = part("cut", "greatest(0, s.start - 24)", "least(s.start, 24)")
    likely = f"rlike(s.value, '[0-9]') and rlike(s.value, '[A-Za-z]') and not ({allowed}) and not rlike({before}, r'{ALLOWED_BEFORE}')"
    kept = bound(pieces("text"), "cut", f"filter({apart('loose', 'base', SPAN)}, s -> {likely})")
    found = found.withColumn("loose", F.expr(f"if(size(loose) = 0, loose, {kept})"))
    bits = f"if(rlike(s.value, '^[0-9a-fA-F]+$'), {LEAST_BITS['hex']}D, {LEAST_BITS['mixed']}D)"
    found = found.withColumn("added", F.expr(f"filter(loose, s -> {window_entropy('s.value')} >= {bits})"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.expr(joined("base")), 256).alias("base_sha256"),
        F.expr(joined("sort_array(concat(base, added))")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
