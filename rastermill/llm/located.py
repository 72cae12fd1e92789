"""Places of regular-expression matches by SQL functions alone, in code points, in time linear in the text.

Folding an array into an array by `aggregate` copies what it has for each element. `with_before` therefore folds blocks of
BLOCK elements, then the blocks' sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string,c:string>>"
BLOCK = 64
#: Code points before a match that are its context.
REACH = 32
#: Code points in the parts into which a text is cut before pieces are taken from it.
CUT = 4096


def quoted(pattern: str) -> str:
    """The pattern as a raw SQL literal."""
    if '"' in pattern and "'" in pattern:
        raise ValueError("write one of the quotes as an escape")
    return f"r'{pattern}'" if '"' in pattern or "'" not in pattern else f'r"{pattern}"'


def bound(value: str, name: str, body: str) -> str:
    """SQL: body, in which `name` is the value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def with_before(items: str, value: str, join: str, zero: str = "0") -> str:
    """SQL: (x, before) for each x of an array; before joins the values of all that stand earlier.

    `value` is SQL over x that gives an int; `join` is SQL over {p} and {q}.
    """
    both = lambda p, q: join.replace("{p}", p).replace("{q}", q)
    empty = f"named_struct('acc', {zero}, 'out', CAST(array() AS array<int>))"
    inside = f"transform(bl, b -> aggregate(b, {empty}, (a, x) -> named_struct('acc', {both('a.acc', f'({value})')}, 'out', concat(a.out, array(a.acc)))))"
    starts = f"aggregate(ins, {empty}, (a, x) -> named_struct('acc', {both('a.acc', 'x.acc')}, 'out', concat(a.out, array(a.acc)))).out"
    joined = f"flatten(transform(bl, (b, k) -> transform(b, (x, i) -> named_struct('x', x, 'before', {both('get(get(ins, k).out, i)', 'get(sts, k)')}))))"
    blocks = f"transform(sequence(0, (size(it) - 1) div {BLOCK}), k -> slice(it, CAST(k * {BLOCK} + 1 AS INT), {BLOCK}))"
    return bound(items, "it", bound(blocks, "bl", bound(inside, "ins", bound(starts, "sts", joined))))


def matches(text: str, pattern: str, where: str = "true") -> Column:
    """Leftmost non-overlapping matches in column `text`: array of (s, e, m, c), e exclusive; empty unless `where`.

    m is the match, c the up to REACH code points before it that no earlier match holds. The pattern must not match the
    empty string. Splitting at the matches gives what stands between them.
    """
    p = quoted(pattern)
    pairs = bound(f"regexp_extract_all({text}, {p}, 0)", "ms", f"transform(split({text}, {p}, -1), (g, i) -> named_struct('g', char_length(g), 'c', right(g, {REACH}), 'm', get(ms, i)))")
    placed = with_before(pairs, "x.g + coalesce(char_length(x.m), 0)", "{p} + {q}")
    spans = f"transform(filter({placed}, y -> y.x.m IS NOT NULL), y -> named_struct('s', y.before + y.x.g, 'e', y.before + y.x.g + char_length(y.x.m), 'm', y.x.m, 'c', y.x.c))"
    return F.expr(f"CASE WHEN {where} THEN {spans} ELSE CAST(array() AS {SPAN}) END")


def apart(spans: str, others: str) -> str:
    """SQL: those of spans (structs that hold s and e) that touch none of `others`; others keep their order among themselves.

    Sorted by their start together, a span is touched by what begins before it and ends in it, or by what begins in it.
    """
    tagged = f"concat(transform({others}, x -> named_struct('s', x.s, 'o', 0, 'e', x.e, 'n', 0)), transform({spans}, (x, i) -> named_struct('s', x.s, 'o', 1, 'e', x.e, 'n', i)))"
    reached = with_before(f"array_sort({tagged})", "CASE WHEN x.o = 0 THEN x.e ELSE 0 END", "greatest({p}, {q})")
    # from the end: where the next of the others begins
    back = with_before(f"reverse({reached})", "CASE WHEN x.x.o = 0 THEN -x.x.s ELSE -2147483647 END", "greatest({p}, {q})", "-2147483647")
    free = f"transform(filter({back}, y -> y.x.x.o = 1 AND y.x.before <= y.x.x.s AND -y.before >= y.x.x.e), y -> y.x.x.n)"
    picked = f"transform(array_sort({free}), n -> get({spans}, n))"
    return f"CASE WHEN size({others}) = 0 OR size({spans}) = 0 THEN {spans} ELSE {picked} END"


def replaced(text: str, spans: str, label: str) -> str:
    """SQL: the text with each span (s, e first of the struct) replaced by `label` (SQL over x); overlapping spans become one."""
    parts = f"transform(sequence(0, greatest(0, char_length({text}) - 1) div {CUT}), k -> substr({text}, CAST(k * {CUT} + 1 AS INT), {CUT}))"

    def cut(a: str, b: str) -> str:
        first, last = f"CAST({a} div {CUT} AS INT)", f"CAST({b} div {CUT} AS INT)"
        one = f"substr(get(pt, {first}), {a} % {CUT} + 1, {b} - {a})"
        many = f"concat(substr(get(pt, {first}), {a} % {CUT} + 1), array_join(slice(pt, {first} + 2, {last} - {first} - 1), ''), coalesce(substr(get(pt, {last}), 1, {b} % {CUT}), ''))"
        return f"CASE WHEN {b} <= {a} THEN '' WHEN {first} = {last} THEN {one} ELSE {many} END"

    ordered = with_before(f"array_sort({spans})", "x.e", "greatest({p}, {q})")
    pieces = f"transform(od, y -> CASE WHEN y.x.s < y.before THEN '' ELSE concat({cut('y.before', 'y.x.s')}, {label.replace('{x}', 'y.x')}) END)"
    whole = f"concat(array_join({pieces}, ''), {bound('array_max(transform(od, y -> y.x.e))', 'z', cut('z', f'char_length({text})'))})"
    return bound(parts, "pt", bound(ordered, "od", whole))
