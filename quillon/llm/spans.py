"""Matches of a pattern with their places, in SQL functions only.

``split`` gives what stands between the matches that ``regexp_extract_all`` gives, so sums of lengths are the places, in code
points. Sums over many matches are taken in two levels (blocks of about the root of their number).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prefixes(values: str, fold: str) -> str:
    """SQL: for each element of an array of numbers, ``fold`` (of ``s`` and ``x``, from 0) over those before it."""
    over = lambda part: f"aggregate({part}, 0L, (s, x) -> {fold})"
    joined = fold.replace("x", "y")
    return (
        f"element_at(transform(array({values}), v -> element_at(transform(array(greatest(1, cast(ceil(sqrt(size(v))) as int))), g -> "
        f"element_at(transform(array(transform(sequence(0, cast(ceil(size(v) / g) as int)), j -> {over('slice(v, j * g + 1, g)')})), b -> "
        f"element_at(transform(array(transform(sequence(0, size(b) - 1), j -> {over('slice(b, 1, j)')})), p -> "
        f"transform(v, (w, i) -> aggregate(slice(v, cast(i div g as int) * g + 1, cast(i % g as int)), element_at(p, cast(i div g as int) + 1), (s, y) -> {joined})))"
        ", 1)), 1)), 1)), 1)"
    )


def prefix_sums(lengths: str) -> str:
    """SQL: for each element of an array of ints, the sum of those before it."""
    return _prefixes(lengths, "s + x")


def prefix_maxima(values: str) -> str:
    """SQL: for each element of an array of longs from 0 on, the largest of those before it, 0 for the first."""
    return _prefixes(values, "if(s > x, s, x)")


def outside(spans: str, taken: str) -> str:
    """SQL: those of ``spans`` that overlap none of ``taken`` (sorted by start), each found by bisection."""
    step = "if(s.a >= s.b, s, if(element_at(t.starts, (s.a + s.b) div 2 + 1) < m.end, named_struct('a', (s.a + s.b) div 2 + 1, 'b', s.b), named_struct('a', s.a, 'b', (s.a + s.b) div 2)))"
    step = step.replace("(s.a + s.b) div 2", "cast((s.a + s.b) div 2 as int)")
    before = f"aggregate(sequence(1, 31), named_struct('a', 0, 'b', size(t.starts)), (s, k) -> {step}, s -> s.a)"
    ends = prefix_maxima(f"concat(transform({taken}, b -> b.end), array(0L))")
    return (
        f"if(size({taken}) = 0 or size({spans}) = 0, {spans}, element_at(transform(array(named_struct('starts', transform({taken}, b -> b.start), 'ends', {ends})), "
        f"t -> filter({spans}, m -> element_at(t.ends, {before} + 1) <= m.start)), 1))"
    )


def replaced(text: str, spans: str, mark: str) -> str:
    """SQL: ``text`` with each of ``spans`` (sorted by start) replaced by the string literal ``mark``; overlapping ones are one.

    The pieces are taken from four bytes a code point, so that each is found at once: the work grows with text and spans only.
    """
    piece = lambda a, b: f"decode(substring(w, cast(4 * ({a}) + 1 as int), cast(4 * ({b} - ({a})) as int)), 'UTF-32')"
    each = f"transform({spans}, (m, i) -> if(m.start < element_at(e, i + 1), '', concat({piece('element_at(e, i + 1)', 'm.start')}, {mark})))"
    rest = piece("element_at(e, -1)", f"length({text})")
    ends = prefix_maxima(f"concat(transform({spans}, m -> m.end), array(0L))")
    return f"element_at(transform(array({ends}), e -> element_at(transform(array(encode({text}, 'UTF-32')), w -> concat(array_join({each}, ''), {rest})), 1)), 1)"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """Array of structs ``start, end, match, value`` (end exclusive) of the leftmost matches that don't overlap."""
    regex = quoted(pattern)
    found = (
        f"element_at(transform(array(named_struct('m', regexp_extract_all({text}, {regex}, 0), 'p', split({text}, {regex}, -1))), f -> "
        f"element_at(transform(array({prefix_sums('transform(f.m, (x, i) -> length(x) + length(element_at(f.p, i + 1)))')}), s -> "
        "transform(f.m, (x, i) -> named_struct('start', element_at(s, i + 1) + length(element_at(f.p, i + 1)), "
        "'end', element_at(s, i + 1) + length(element_at(f.p, i + 1)) + length(x), 'match', x))), 1)), 1)"
    )
    if group:
        found = f"zip_with({found}, regexp_extract_all({text}, {regex}, {group}), (a, b) -> named_struct('start', a.start, 'end', a.end, 'match', a.match, 'value', b))"
    else:
        found = f"transform({found}, a -> named_struct('start', a.start, 'end', a.end, 'match', a.match, 'value', a.match))"
    empty = "cast(array() as array<struct<start: bigint, end: bigint, match: string, value: string>>)"
    return F.expr(f"if({text} rlike {regex}, {found}, {empty})")
