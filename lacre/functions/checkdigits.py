"""Check digits of Brazilian identifiers as native boolean expressions.

Every function takes the SQL of a string and gives the SQL of a condition, which is false, never
null or an error, for what the string cannot be: null, other characters than digits and the
separators ``. - /`` and blank, or the wrong length.
"""

from __future__ import annotations

from collections.abc import Sequence

from .sql import chosen, let

#: Area codes in use.
DDDS = tuple(
    [*range(11, 20), 21, 22, 24, 27, 28, *range(31, 36), 37, 38, *range(41, 50), 51, 53, 54, 55]
    + [*range(61, 70), 71, 73, 74, 75, 77, 79, *range(81, 90), *range(91, 100)]
)


def digits_of(value: str) -> str:
    """The digits without separators; null where there is anything else or nothing."""
    return let(f"translate({value}, '.-/ ', '')", lambda d: rf"CASE WHEN {d} RLIKE r'^[0-9]+\z' THEN {d} END")


def digit(d: str, i: int) -> str:
    """The i-th digit, from 1."""
    return f"(ascii(substr({d}, {i}, 1)) - 48)"


def weighted(d: str, weights: Sequence[int], first: int = 1) -> str:
    return "(" + " + ".join(f"ascii(substr({d}, {i}, 1)) * {w}" for i, w in enumerate(weights, first)) + f" - {48 * sum(weights)})"


def digits_in(size: int, d: str, then) -> str:
    """``then`` of a function that gives the i-th of ``size`` digits: by arithmetic, which takes less than cutting a string."""
    return let(f"cast({d} AS bigint)", lambda n: then(lambda i: f"{n} div {10 ** (size - i)}L % 10" if i < size else f"{n} % 10"))


def rest11(at, weights: Sequence[int]) -> str:
    """The weighted sum's remainder by 11."""
    return "((" + " + ".join(f"({at(i)}) * {w}" for i, w in enumerate(weights, 1)) + ") % 11)"


def check11(at, weights: Sequence[int]) -> str:
    """11 minus the remainder, 0 for what would be 10 or 11."""
    return let(rest11(at, weights), lambda rest: f"if({rest} < 2, 0, 11 - {rest})")


def mod11(d: str, weights: Sequence[int]) -> str:
    """11 minus the weighted sum's remainder, 0 for what would be 10 or 11."""
    return let(f"{weighted(d, weights)} % 11", lambda rest: f"if({rest} < 2, 0, 11 - {rest})")


def varied(d: str) -> str:
    """Not all digits are the same."""
    return f"translate({d}, left({d}, 1), '') <> ''"


def _check(value: str, size: int, rule) -> str:
    """Whether the digits of a value have the size and keep the rule."""
    return f"coalesce({let(digits_of(value), lambda d: f'CASE WHEN length({d}) = {size} THEN {rule(d)} END')}, false)"


# The rules take the SQL of a string of as many digits as they need.


def cpf(d: str) -> str:
    return digits_in(11, d, lambda at: f"({at(10)} = {check11(at, range(10, 1, -1))} AND {at(11)} = {check11(at, range(11, 1, -1))} AND {varied(d)})")


def cnpj(d: str) -> str:
    second = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    return f"({digit(d, 13)} = {mod11(d, second[1:])} AND {digit(d, 14)} = {mod11(d, second)} AND {varied(d)})"


def pis(d: str) -> str:
    return digits_in(11, d, lambda at: f"({at(11)} = {check11(at, (3, 2, 9, 8, 7, 6, 5, 4, 3, 2))} AND {varied(d)})")


def titulo_eleitor(d: str) -> str:
    state = f"({digit(d, 9)} * 10 + {digit(d, 10)})"

    def dv(total: str) -> str:
        return let(f"{total} % 11", lambda rest: chosen([(f"{rest} = 0", f"if({state} IN (1, 2), 1, 0)"), (f"{rest} = 10", "0")], rest))

    second = let(dv(weighted(d, range(2, 10))), lambda first: f"CASE WHEN {digit(d, 11)} = {first} THEN {dv(f'({digit(d, 9)} * 7 + {digit(d, 10)} * 8 + {first} * 9)')} END")
    return f"({state} BETWEEN 1 AND 28 AND {digit(d, 12)} = {second})"


def cnh(d: str) -> str:
    def fits(at, rest: str) -> str:
        second = let(f"pmod({rest11(at, range(1, 10))} - if({rest} >= 10, 2, 0), 11)", lambda x: f"if({x} >= 10, 0, {x})")
        return f"({at(10)} = if({rest} >= 10, 0, {rest}) AND {at(11)} = {second} AND {varied(d)})"

    return digits_in(11, d, lambda at: let(rest11(at, range(9, 0, -1)), lambda rest: fits(at, rest)))


def cns(d: str) -> str:
    def tail(total: str) -> str:
        # 11 becomes 0; 10 does not fit and moves on to a sum of two more, with suffix 001.
        return let(f"11 - {total} % 11", lambda plain: chosen([(f"{plain} = 10", f"concat('001', cast(11 - ({total} + 2) % 11 AS string))"), (f"{plain} = 11", "'0000'")], f"concat('000', cast({plain} AS string))"))

    final = f"substr({d}, 12, 4) = {let(weighted(d, range(15, 4, -1)), tail)}"
    interim = f"{weighted(d, range(15, 0, -1))} % 11 = 0"
    return chosen([(f"left({d}, 1) IN ('1', '2')", final), (f"left({d}, 1) IN ('7', '8', '9')", interim)])


def processo_cnj(d: str) -> str:
    return f"(98 - cast(cast(concat(substr({d}, 1, 7), substr({d}, 10, 11), '00') AS decimal(38, 0)) % 97 AS int) = {digit(d, 8)} * 10 + {digit(d, 9)})"


def is_cpf(value: str) -> str:
    return _check(value, 11, cpf)


def is_cnpj(value: str) -> str:
    return _check(value, 14, cnpj)


def is_pis(value: str) -> str:
    return _check(value, 11, pis)


def is_titulo_eleitor(value: str) -> str:
    return _check(value, 12, titulo_eleitor)


def is_cnh(value: str) -> str:
    return _check(value, 11, cnh)


def is_cns(value: str) -> str:
    return _check(value, 15, cns)


def is_processo_cnj(value: str) -> str:
    return _check(value, 20, processo_cnj)


def is_luhn(value: str) -> str:
    return f"coalesce({let(digits_of(value), lambda d: f'CASE WHEN length({d}) >= 2 THEN luhn_check({d}) END')}, false)"


def is_phone(area: str, subscriber: str) -> str:
    """Area code in use; nine digits from 9, or eight from 2 to 5."""
    form = f"if(length({subscriber}) = 9, left({subscriber}, 1) = '9', left({subscriber}, 1) IN ('2', '3', '4', '5'))"
    return f"coalesce(try_cast({area} AS int) IN ({', '.join(map(str, DDDS))}) AND {form}, false)"
