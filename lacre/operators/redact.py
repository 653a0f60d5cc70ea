"""Redaction of texts and the report on it.

Entities to be hidden are covered where they stand, a CPF only in its first three and last two
digits; a CPF that came masked is left as it is and counted apart; published ones stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import HIDDEN
from ..functions.spans import replaced
from ..functions.sql import let, looked_up, name, struct
from ..model import TYPES

BLOCK = "█"
SPAN = "array<struct<start: int, end: int>>"


def hidden_parts(entity: str) -> str:
    """SQL of the spans to cover for an entity that has to be hidden: of a CPF its first three and last two digits."""
    i, h, c = name("i"), name("h"), name("c")
    places = f"filter(transform(split({entity}.text, ''), ({c}, {i}) -> if({c} RLIKE r'\\p{{Nd}}', {i}, null)), {i} -> {i} IS NOT NULL)"
    digits = let(places, lambda p: f"transform(array({', '.join(map(str, HIDDEN))}), {h} -> {p}[{h}])")
    part = struct(start=f"cast({entity}.start + {i} AS int)", end=f"cast({entity}.start + {i} + 1 AS int)")
    whole = struct(start=f"cast({entity}.start AS int)", end=f"cast({entity}.end AS int)")
    return f"CASE WHEN {entity}.type = 'CPF_MASCARADO' THEN cast(array() AS {SPAN}) WHEN {entity}.type = 'CPF' THEN transform({digits}, {i} -> {part}) ELSE array({whole}) END"


def policy_action(entity: str, policy: dict[str, str] | None = None) -> str:
    """SQL of the action for an entity's type; a type without one is an error, never a default."""
    rules = policy if policy is not None else {t: a for t, _, _, a in TYPES}
    known = f"{looked_up(f'{entity}.type', rules)}, " if rules else ""
    return f"coalesce({known}raise_error(concat('no action for type ', coalesce({entity}.type, 'null'))))"


def redact_in_place(texts: DataFrame, entities: str = "entities", text: str = "text", policy: dict[str, str] | None = None, into: str = "redacted") -> DataFrame:
    """``texts`` with the text redacted by the policy, for rows that have the array of their entities. No row moves."""
    e, x = name("e"), name("x")
    covered = f"flatten(transform(filter({entities}, {e} -> {policy_action(e, policy)} = 'tarjar'), {x} -> {hidden_parts(x)}))"
    rows = texts.withColumn("_spans", F.expr(f"coalesce({covered}, array())"))
    return rows.withColumn(into, F.expr(f"if(size(_spans) = 0, `{text}`, {replaced(f'`{text}`', '_spans', BLOCK)})")).drop("_spans")


def hidden_spans(entities: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys``, start, end of what to cover; ``entities`` are rows and have an action."""
    covered = entities.where((F.col("acao") == "tarjar") & (F.col("type") != "CPF_MASCARADO"))
    rows = covered.withColumn("_e", F.struct("type", "start", "end", "text"))
    return rows.select(*keys, F.explode_outer(F.expr(hidden_parts("_e"))).alias("s")).select(*keys, "s.start", "s.end")


def redact(texts: DataFrame, entities: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", manual: DataFrame | None = None) -> DataFrame:
    """``texts`` with the column redacted, by entities that are rows, such as those a reviewer has decided on.

    ``manual`` has further spans (keys, start, end) to cover. The spans of a text come together, never
    texts with each other; lengths and offsets stay. Where the entities are on the text's own row,
    ``redact_in_place`` needs no join.
    """
    spans = hidden_spans(entities, keys)
    if manual is not None:
        spans = spans.unionByName(manual.select(*keys, "start", "end"))
    spans = spans.groupBy(*keys).agg(F.collect_set(F.struct("start", "end")).alias("_spans")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_spans")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = texts.join(spans, condition, "left")
    out = F.expr(f"if(_spans IS NULL, `{text}`, {replaced(f'`{text}`', '_spans', BLOCK)})")
    return joined.withColumn("redacted", out).drop("_spans", *(f"_k_{k}" for k in keys))


def report(entities: DataFrame, keys: tuple[str, ...] = ("doc_id",), manual: DataFrame | None = None) -> DataFrame:
    """Counters for each text: covered, published, masked before, partly covered CPFs, marked for review and, with ``manual``, drawn spans."""
    hidden = F.col("acao") == "tarjar"
    found = entities.groupBy(*keys).agg(
        F.count_if(hidden & (F.col("type") != "CPF_MASCARADO")).alias("n_covered"), F.count_if(F.col("acao") == "publicar").alias("n_published"),
        F.count_if(hidden & (F.col("type") == "CPF_MASCARADO")).alias("n_masked_before"), F.count_if(hidden & (F.col("type") == "CPF")).alias("n_partial_cpf"),
        F.count_if("requires_review").alias("n_review"),
    )
    if manual is None:
        return found
    drawn = manual.groupBy(*keys).agg(F.count("*").alias("n_manual"))
    return found.join(drawn, list(keys), "full_outer").fillna(0)


def file_hashes(files: DataFrame) -> DataFrame:
    """path, length and SHA-256 of files read with ``binaryFile``."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
