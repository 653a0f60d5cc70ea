"""Pieces of SQL text that the operators put their expressions together from.

An operator over the elements of an array is a nest of lambda functions. As SQL text such a nest is
parsed in one go, where the same made of Column calls takes seconds on the driver.
"""

from __future__ import annotations

from itertools import count

_names = count()


def name(stem: str) -> str:
    """A lambda variable that no other lambda uses."""
    return f"{stem}_{next(_names)}"


def lit(text: str) -> str:
    """A string literal, taken as it is."""
    if "'" in text:
        raise ValueError("no literal with a quotation mark")
    return f"r'{text}'"


def quoted(values) -> str:
    return ", ".join(map(lit, values))


def let(value: str, then) -> str:
    """``then`` of a value that is computed once, however often it is used."""
    v = name("v")
    return f"transform(array({value}), {v} -> {then(v)})[0]"


def mapped(items: str, then) -> str:
    x = name("x")
    return f"transform({items}, {x} -> {then(x)})"


def chosen(cases, otherwise: str = "null") -> str:
    """The value of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {value}" for condition, value in cases) + f" ELSE {otherwise} END"


def looked_up(key: str, values: dict[str, str]) -> str:
    """The value that a constant map has for a key, or null; a map is one step where a CASE compares with each in turn."""
    return f"element_at(map({', '.join(f'{lit(k)}, {lit(v)}' for k, v in values.items())}), {key})"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def walked(items: str, first: dict[str, str], step, empty: str, then, least: int = 64) -> str:
    """``then`` of what ``step`` makes of the fields of ``first`` and of ``found`` on its way over the items.

    ``step`` takes the state and an item and gives the next fields, ``found`` among them, which starts
    as ``empty`` and is appended to. Appending copies an array, so the way is cut into blocks of about
    the square root of its length, each with a ``found`` of its own; ``then`` sees ``found`` as the
    array of those. Long arrays stay far from quadratic.
    """
    size = f"cast(greatest({least}, 2 * ceil(sqrt(size({items})) / 2)) AS int)"
    i, s, x, o, b, w, r = (name(k) for k in "isxobwr")
    blocks = f"transform(sequence(0, greatest(size({items}) - 1, 0), {size}), {i} -> slice({items}, {i} + 1, {size}))"
    inside = f"aggregate({b}, {struct(**{k: f'{o}.{k}' for k in first}, found=empty)}, ({s}, {x}) -> {struct(**step(s, x))})"
    block = f"transform(array({inside}), {w} -> {struct(**{k: f'{w}.{k}' for k in first}, found=f'concat({o}.found, array({w}.found))')})[0]"
    return f"aggregate({blocks}, {struct(**first, found=f'slice(array({empty}), 1, 0)')}, ({o}, {b}) -> {block}, {r} -> {then(r)})"
