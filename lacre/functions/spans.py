"""Finding all matches of patterns with their places, without leaving the JVM.

One pass of ``regexp_replace`` puts a mark around each match; splitting at the marks gives gaps and
matches in turn. The offsets are code points, as lengths of pieces add up. Patterns are Java's and
always literals, so that each is compiled once; the marks' own character in a text is replaced by
another control character first (``clean``), which no pattern tells apart. All functions take and
give SQL text.
"""

from __future__ import annotations

from .sql import let, lit, name, struct, walked

MARK = r"'\u0001'"
#: Two search windows of 120 characters and what may lie between them.
LOOK_BACK = 256
#: Bytes of a text and number of spans up to which covering them one by one is cheaper than cutting the text up.
SHORT, SHORT_SPANS = 1024, 32
#: Character classes that mean in Java's patterns what they mean in Unicode-aware ones.
ALNUM = r"[\p{L}\p{N}]"
NUM = r"\p{Nd}"
WORDS = r"\p{L}\p{N}_"
SPACES = r"\s\x1c-\x1f\x85\p{Z}"
SPANS = "array<struct<form: string, start: int, text: string, before: string>>"


def clean(text: str) -> str:
    """The text without the marks' own character, which no pattern tells from what it becomes."""
    return rf"if(contains({text}, {MARK}), translate({text}, {MARK}, '\u0002'), {text})"


def pieces(text: str, pattern: str) -> str:
    """Gaps (even places) and matches (odd places) of a clean text in turn."""
    return rf"split(regexp_replace({text}, {lit(pattern)}, '\u0001$0\u0001'), {MARK}, -1)"


def tail(text: str, size: int) -> str:
    """The last ``size`` characters."""
    return f"substring({text}, -{size}, {size})"


def searched(text: str, forms: dict[str, tuple[str, str]]) -> str:
    """array<struct<form, parts>>: a clean text in pieces by each form it has matches of.

    ``forms`` have a pattern and a condition without which a text is not searched.
    """
    return "array_compact(array(" + ", ".join(f"CASE WHEN {condition} THEN {struct(form=lit(k), parts=pieces(text, pattern))} END" for k, (pattern, condition) in forms.items()) + "))"


def find_spans(parts: str) -> str:
    """array<struct<form, start, text, before>> of the matches, form by form, left to right, from what ``searched`` gives.

    ``before`` are the last ``LOOK_BACK`` characters in front of a match.
    """
    none = f"cast(array() AS {SPANS})"
    f, hit = name("f"), name("h")

    def step(s: str, piece: str) -> dict[str, str]:
        here = struct(form=f"{f}.form", start=f"{s}.at", text=piece, before=f"{s}.tail")
        return {"at": f"{s}.at + length({piece})", "tail": tail(f"concat({s}.tail, {piece})", LOOK_BACK), "odd": f"NOT {s}.odd", "found": f"if({s}.odd, concat({s}.found, array({here})), {s}.found)"}

    many = walked(f"{f}.parts", {"at": "0", "tail": "''", "odd": "false"}, step, none, lambda r: f"flatten({r}.found)")
    # One match needs no walk.
    one = struct(form=f"{f}.form", start=f"length({f}.parts[0])", text=f"{f}.parts[1]", before=tail(f"{f}.parts[0]", LOOK_BACK))
    own = f"if(size({f}.parts) = 3, array({one}), {many})"
    return f"flatten(transform(filter({parts}, {hit} -> size({hit}.parts) > 2), {f} -> {own}))"


def last_span(text: str, pattern: str) -> str:
    """struct<start, text> of the rightmost match in a clean text, or null."""

    def last(parts: str) -> str:
        start = f"length({text}) - length(element_at({parts}, -1)) - length(element_at({parts}, -2))"
        return f"CASE WHEN size({parts}) >= 3 THEN {struct(start=start, text=f'element_at({parts}, -2)')} END"

    return let(pieces(text, pattern), last)


def is_blank(text: str) -> str:
    return f"{text} RLIKE {lit(rf'^[{SPACES}]*\z')}"


def search_window(before: str, size: int) -> str:
    """The last ``size`` characters of the line that ``before`` ends in.

    Where that is blank, the line before is put in front of it, unless that is blank as well. As both
    lines count with ``size`` characters at most, the last ``LOOK_BACK`` in front of a place are enough.
    """
    above = rf"if(contains({before}, '\n'), regexp_replace(substring_index(substring_index({before}, '\n', -2), '\n', 1), {lit(r'\r+\z')}, ''), '')"
    joined = lambda line, a: f"if({is_blank(line)} AND NOT {is_blank(a)}, concat({a}, {line}), {line})"
    lines = let(rf"substring_index({before}, '\n', -1)", lambda line: let(above, lambda a: joined(line, a)))
    return tail(rf"if(contains({before}, '\n'), {lines}, {before})", size)


def cut(text: str, spans: str, then, chunk: int = 8192) -> str:
    """An array of ``then`` (chunk, its spans, sorted, with offsets within it) for the text in chunks.

    Reading a place of a text costs as much as the text before it is long; in chunks that stays bounded.
    """
    k, s, p, c, i = (name(x) for x in "kspci")
    within = struct(k=k, start=f"greatest({s}.start - {k} * {chunk}, 0)", end=f"least({s}.end - {k} * {chunk}, {chunk})")
    parts = f"array_sort(flatten(transform(filter({spans}, {p} -> {p}.start < {p}.end), {s} -> transform(sequence({s}.start div {chunk}, ({s}.end - 1) div {chunk}), {k} -> {within}))))"
    chunks = f"regexp_extract_all({text}, {lit(f'(?s).{{1,{chunk}}}')}, 0)"
    q = name("q")
    return let(parts, lambda all_: f"transform({chunks}, ({c}, {i}) -> {then(c, f'filter({all_}, {q} -> {q}.k = {i})')})")


def replaced(text: str, spans: str, sign: str) -> str:
    """The text with every character of the spans (array<struct<start, end>>) replaced by ``sign``."""

    def step(s: str, x: str) -> dict[str, str]:
        start, end = f"greatest({x}.start, {s}.at)", f"greatest({x}.end, {s}.at)"
        return {"at": f"cast({end} AS int)", "own": f"{s}.own", "found": f"concat({s}.found, array(substring({s}.own, {s}.at + 1, cast({start} AS int) - {s}.at), repeat({lit(sign)}, cast({end} - {start} AS int))))"}

    def covered(chunk: str, own: str) -> str:
        rest = lambda r: f"concat(array_join(flatten({r}.found), ''), substring({chunk}, {r}.at + 1, length({chunk})))"
        walk = let(own, lambda parts: f"if(size({parts}) = 0, {chunk}, {walked(parts, {'at': '0', 'own': chunk}, step, 'cast(array() AS array<string>)', rest)})")
        return walk

    s, x, y = name("s"), name("x"), name("y")
    # A short text is covered span by span, as each keeps its length.
    short = f"octet_length({text}) <= {SHORT} AND size({spans}) <= {SHORT_SPANS} AND NOT exists({spans}, {y} -> {y}.start < 0 OR {y}.end > length({text}))"
    over = f"aggregate({spans}, {text}, ({s}, {x}) -> if({x}.start < {x}.end, overlay({s}, repeat({lit(sign)}, cast({x}.end - {x}.start AS int)), cast({x}.start + 1 AS int)), {s}))"
    return f"if({short}, {over}, array_join({cut(text, spans, covered)}, ''))"
