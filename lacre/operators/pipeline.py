"""From texts to entities with an action."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import let, name, struct
from ..model import ENTITY, ENTITY_FIELDS, types_table
from ..session import shared
from .detect import FRAGILE_IN_OCR, Detector, detection, with_candidates
from .resolve import resolved


MOST_ROUNDS = 400


def with_entities(texts: DataFrame, text: str = "text", ocr: str | None = None, types: Iterable[str] | None = None, extra: Iterable[Detector] = (), into: str = "entities") -> DataFrame:
    """``texts`` with an array of the entities of each text, resolved and in reading order; no row moves.

    With ``ocr``, types that OCR reads badly are marked for review on the rows it is true for.
    """
    found = with_candidates(texts, text, ocr, types, extra).withColumn("_found", F.expr(resolved("_found")))

    def kept(e):
        review = e["requires_review"]
        if ocr:
            review = review | (F.coalesce(F.col(ocr), F.lit(False)) & e["type"].isin(*FRAGILE_IN_OCR))
        return F.struct(*((review if f == "requires_review" else e[f]).alias(f) for f in ENTITY_FIELDS))

    return found.withColumn(into, F.coalesce(F.transform("_found", kept), F.array())).drop("_found")


def rows_of(texts: DataFrame, keys: tuple[str, ...], entities: str = "entities") -> DataFrame:
    """``keys``, ``ord`` (from 0, in reading order) and the fields of each entity of an array."""
    # posexplode_outer, as posexplode would have what made the array written out once more for a filter on its size.
    return texts.select(*keys, F.posexplode_outer(entities).alias("ord", "_e")).where("_e IS NOT NULL").select(*keys, "ord", *(F.col(f"_e.{f}") for f in ENTITY_FIELDS))


def detect(texts: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", ocr: str | None = None, types: Iterable[str] | None = None, extra: Iterable[Detector] = ()) -> DataFrame:
    """The entities of each text, resolved, as rows. ``keys`` (and ``ocr``) are carried; offsets are code points of the text as given."""
    columns = tuple(dict.fromkeys([*keys, *([ocr] if ocr else [])]))
    return rows_of(with_entities(texts.select(*dict.fromkeys([*columns, text])), text, ocr, types, extra, into="_entities"), columns, "_entities")


def register(spark: SparkSession, function: str = "detect_entities", types: Iterable[str] | None = None) -> None:
    """A function for SQL: the entities of a text, as ``with_entities`` gives them for text that OCR has not read.

        SELECT doc_id, inline(found) FROM (SELECT doc_id, detect_entities(text) AS found FROM docs)

    It is a SQL function whose body is the operators' own expression, so it runs where they do, in the JVM.
    The body is one nest of some hundred lambda functions, for which the analyzer of the session is given
    more rounds. Spark takes no SQL functions inside LATERAL VIEW.
    """
    rounds = "spark.sql.analyzer.maxIterations"
    spark.conf.set(rounds, max(int(spark.conf.get(rounds)), MOST_ROUNDS))
    e = name("e")
    fields = struct(**{f: f"{e}.{f}" for f in ENTITY_FIELDS})
    body = f"coalesce(transform({let(detection('text', types), resolved)}, {e} -> {fields}), cast(array() AS array<{ENTITY}>))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(text STRING) RETURNS ARRAY<{ENTITY}> RETURN {body}")


def with_known(texts: DataFrame, known: DataFrame, text: str = "text", types: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``texts`` with their entities, and what has to be added to ``known`` (sha256, entities) for the next run.

    Only texts whose digest ``known`` lacks are searched, each different one once: over documents that
    have not changed a second run searches nothing. The additions are stored in the shared folder, as
    both results need them. A null text has no entities and no digest.
    """
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    keyed = texts.withColumn("_sha256", digest)
    new = keyed.where(F.col("_sha256").isNotNull()).join(known.select(F.col("sha256").alias("_sha256")), "_sha256", "left_anti")
    once = new.groupBy("_sha256").agg(F.first(text).alias("_text"))
    fresh = shared(with_entities(once, "_text", types=types).select(F.col("_sha256").alias("sha256"), "entities"))
    both = known.select("sha256", "entities").unionByName(fresh).withColumnRenamed("sha256", "_sha256").withColumnRenamed("entities", "_entities")
    found = keyed.join(both, "_sha256", "left").withColumn("entities", F.coalesce("_entities", F.array().cast(f"array<{ENTITY}>")))
    return found.drop("_sha256", "_entities"), fresh


def with_action(entities: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """``acao`` for each entity. A type without one is an error, never a default. The policy has a row for each type, 19 at most."""
    rules = (types_table(entities.sparkSession) if policy is None else policy).select(F.col("type").alias("_type"), F.col("acao").alias("_acao"))
    joined = entities.join(F.broadcast(rules), F.col("type") == F.col("_type"), "left")
    missing = F.raise_error(F.concat(F.lit("no action for type "), F.coalesce("type", F.lit("null"))))
    return joined.withColumn("acao", F.coalesce("_acao", missing)).drop("_type", "_acao")
