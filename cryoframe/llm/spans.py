"""Pattern spans in text with built-in functions only.

Offsets are code points, end exclusive.  A pattern's hits and the gaps between them come from two
built-in regular-expression calls, and offsets are running sums of their lengths.  Quantifiers in
patterns are possessive where nothing after them could need what they took, which gives the same
matches without backtracking or deep recursion on very long runs.

A fold copies what it has gathered at each step, and a substring walks the text from its start.  So running
values are plain numbers gathered in blocks (:func:`scanned`), and parts of a text are read from pieces of it
(:func:`part`), which keeps the time near that of the matches, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"
_NONE = f"cast(array() as array<{SPAN}>)"
#: Items in a block of a fold, and code points in a piece of a text.
BLOCK, PIECE = 256, 64


def bound(value: str, name: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` stands for ``value``; the value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scanned(items: str, state: str, kind: str, onward: str, value: str) -> str:
    """SQL for an array with one ``value`` (of the primitive type ``kind``) for each of ``items``.

    ``state`` is the first state; ``onward``, the next state, and ``value`` are SQL in the state ``a.s`` and the item ``x``.
    """
    none = f"cast(array() as array<{kind}>)"
    block = f"""aggregate(slice(v, b * {BLOCK} + 1, {BLOCK}), named_struct('s', acc.s, 'out', {none}),
        (a, x) -> named_struct('s', {onward}, 'out', array_append(a.out, {value})))"""
    step = bound(block, "r", "named_struct('s', r.s, 'out', array_append(acc.out, r.out))")
    blocks = f"""aggregate(sequence(0, cast((size(v) - 1) div {BLOCK} as int)), named_struct('s', {state}, 'out', cast(array() as array<array<{kind}>>)),
        (acc, b) -> {step}, acc -> flatten(acc.out))"""
    return bound(items, "v", blocks)


def find_spans(text: str, pattern: str, kind: str, ord_: int, gate: str) -> Column:
    """Array of spans of ``pattern`` in column ``text``, left to right; ``gate`` is SQL that every text with a hit satisfies."""
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    sizes = f"zip_with(split({text}, {p}, -1), hits, (gap, hit) -> named_struct('gap', length(gap), 'size', coalesce(length(hit), 0)))"
    starts = scanned(sizes, "0", "int", "a.s + x.gap + x.size", "a.s + x.gap")
    span = f"named_struct('start', starts[i], 'ord', {ord_}, 'end', starts[i] + length(hit), 'kind', '{kind}', 'value', hit)"
    found = bound(f"regexp_extract_all({text}, {p}, 0)", "hits", bound(starts, "starts", f"transform(hits, (hit, i) -> {span})"))
    return F.expr(f"case when {text} is not null and ({gate}) and rlike({text}, {p}) then {found} else {_NONE} end")


def pieces(text: str) -> str:
    """SQL for ``text`` as an array of pieces of ``PIECE`` code points."""
    return f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"


def part(cut: str, start: str, size: str) -> str:
    """SQL for ``size`` code points from ``start`` (counted from 0) of a text cut into :func:`pieces`."""
    first, last = f"cast(({start}) div {PIECE} as int)", f"cast(({start} + {size} - 1) div {PIECE} as int)"
    return f"substring(array_join(slice({cut}, {first} + 1, greatest(0, {last} - {first} + 1)), ''), ({start}) % {PIECE} + 1, {size})"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(value: str) -> str:
    """SQL that tells whether the digits in ``value`` pass the Luhn test."""
    return f"""aggregate(transform(split(reverse({digits(value)}), ''), (c, i) ->
        if(i % 2 = 0, cast(c as int), if(2 * cast(c as int) > 9, 2 * cast(c as int) - 9, 2 * cast(c as int)))), 0, (a, x) -> a + x) % 10 = 0"""


def joined(spans: str) -> str:
    """SQL for ``kind:start:end`` of sorted spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def apart(spans: str, base: str, kind: str) -> str:
    """SQL for those ``spans``, of type ``kind``, that overlap none of ``base``, in the order of their starts.

    One pass from the left finds how far the base spans before each reach, one from the right where the next one starts.
    """
    side = lambda of, other, span: f"transform({of}, s -> named_struct('start', s.start, 'other', {other}, 'end', s.end, 'span', {span}))"
    both = f"sort_array(concat({side(base, 0, f'cast(null as {kind})')}, {side(spans, 1, 's')}))"
    reached = scanned("both", "0", "int", "if(x.other = 0, greatest(a.s, x.end), a.s)", "a.s")
    following = scanned("reverse(both)", "2147483647", "int", "if(x.other = 0, x.start, a.s)", "a.s")
    free = "filter(both, (x, i) -> x.other = 1 and x.start >= reached[i] and x.end <= following[size(both) - 1 - i])"
    kept = bound(both, "both", bound(reached, "reached", bound(following, "following", f"transform({free}, x -> x.span)")))
    return f"if(size({spans}) = 0 or size({base}) = 0, {spans}, {kept})"
