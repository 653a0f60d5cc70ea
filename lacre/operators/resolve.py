"""Settling disputes between detections of one text.

Detections are ranked: validated ones first, then the longer, the more confident, the earlier, and
the type's name. In that order each is accepted unless it crosses an accepted one or has the same
span; nesting is no dispute. Then weak detections inside a validated document number are dropped as
fragments of it. Only the few detections of a text come together, as an array, never the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import let, mapped, name, struct, walked
from ..model import ENTITY_FIELDS, METHODS

WEAK_METHODS = ("padrao", "contextual")


def overlaps(a: str, b: str) -> str:
    return f"({a}.start < {b}.end AND {b}.start < {a}.end)"


def contains(outer: str, inner: str) -> str:
    """Strictly: an equal span is not contained."""
    return f"({outer}.start <= {inner}.start AND {inner}.end <= {outer}.end AND {outer}.end - {outer}.start > {inner}.end - {inner}.start)"


def compete(a: str, b: str) -> str:
    return f"({overlaps(a, b)} AND NOT {contains(a, b)} AND NOT {contains(b, a)})"


def fragment(inner: str, outer: str) -> str:
    weak = ", ".join(f"'{m}'" for m in WEAK_METHODS)
    return f"({outer}.validated AND {outer}.method = 'validado_dv' AND NOT {inner}.validated AND {inner}.method IN ({weak}) AND {contains(outer, inner)})"


def _accepted(found: str) -> str:
    """The accepted of entities that lie close together, without fragments."""
    rank = lambda e: struct(a=f"NOT {e}.validated", b=f"{e}.start - {e}.end", c=f"-{e}.confidence", d=f"{e}.start", t=f"{e}.type", o=f"{e}.ord", e=e)
    ranked = mapped(f"sort_array({mapped(found, rank)})", lambda r: f"{r}.e")
    kept, e, k, x, o = (name(n) for n in "kexyo")
    accepted = f"aggregate({ranked}, slice({found}, 1, 0), ({kept}, {e}) -> if(exists({kept}, {k} -> {compete(e, k)}), {kept}, concat({kept}, array({e}))))"
    return let(accepted, lambda all_: f"filter({all_}, {x} -> NOT exists({all_}, {o} -> {fragment(x, o)}))")


def in_reading_order(found: str) -> str:
    """By start, the longer first."""
    order = lambda e: struct(a=f"{e}.start", b=f"-{e}.end", o=f"{e}.ord", e=e)
    return mapped(f"sort_array({mapped(found, order)})", lambda r: f"{r}.e")


def resolved(found: str) -> str:
    """The accepted of an array of entities (with ``ord`` and ``method``), in reading order; SQL in and out.

    Entities that no chain of overlaps ties together are settled apart from each other.
    """
    none = f"slice({found}, 1, 0)"

    def step(s: str, e: str) -> dict[str, str]:
        apart = f"{e}.start >= {s}.reach"
        return {"reach": f"greatest({s}.reach, {e}.end)", "held": f"if({apart}, array({e}), concat({s}.held, array({e})))", "found": f"if({apart}, concat({s}.found, array({s}.held)), {s}.found)"}

    def groups(x: str) -> str:
        return walked(x, {"reach": "0", "held": none}, step, f"slice(array({none}), 1, 0)", lambda r: f"concat(flatten({r}.found), array({r}.held))")

    settled = lambda x: mapped(groups(x), lambda g: f"if(size({g}) < 2, {g}, {in_reading_order(_accepted(g))})")
    i = name("i")
    # Most texts have no two entities that overlap: then all stay.
    crossed = lambda x: f"exists(sequence(1, size({x}) - 1), {i} -> {x}[{i}].start < {x}[{i} - 1].end)"
    return f"if(size({found}) < 2, {found}, {let(in_reading_order(found), lambda x: f'if({crossed(x)}, flatten({settled(x)}), {x})')})"


def resolve(candidates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each accepted entity: ``keys``, ``ord`` (from 0, in reading order) and the entity's fields.

    For candidates that are rows already; those of equal keys, null ones as well, are one text's. A
    few small rows for each text are shuffled, no text.
    """
    method = F.element_at(F.create_map(*(F.lit(x) for pair in METHODS.items() for x in pair)), F.col("type"))
    entity = F.struct(*ENTITY_FIELDS, "ord", method.alias("method"))
    grouped = candidates.groupBy(*keys).agg(F.collect_list(entity).alias("_found"))
    return grouped.select(*keys, F.posexplode(F.expr(resolved("_found"))).alias("ord", "e")).select(*keys, "ord", *(F.col(f"e.{f}").alias(f) for f in ENTITY_FIELDS))
