"""Reconciling reviewers' decisions with what was detected, and comparing with annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import walked

SIDE = 4.0
LEAST_SIDE = 6.0


def entity_ids(entities: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``entidade_id``: the same for the same place in the same detection, so that a second run finds it. A null key keeps its place in it."""
    return entities.withColumn("entidade_id", F.sha2(F.to_json(F.array(*(F.col(k).cast("string") for k in (*keys, "ord", "type")))), 256))


def recovered(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``fresh`` entities with the stored ids, by place; a different number or type is an error."""
    a = stored.select(*keys, "ord", F.col("type").alias("_type"), F.col("entidade_id").alias("_id"))
    joined = a.join(fresh, [*keys, "ord"], "full_outer")
    differs = ~F.col("type").eqNullSafe(F.col("_type"))
    return joined.withColumn("entidade_id", F.when(differs, F.raise_error(F.lit("detection differs from what was stored"))).otherwise(F.col("_id"))).drop("_type", "_id")


def missing_decisions(known: DataFrame, decisions: DataFrame) -> DataFrame:
    """Known entities without a decision. Their order is the caller's: a sort of them all would serve only a report."""
    return known.join(decisions, "entidade_id", "left_anti").select("entidade_id")


def known_decisions(known: DataFrame, decisions: DataFrame) -> DataFrame:
    """Known entities with the decided action; a decision for another page than the entity's is an error."""
    chosen = decisions.select("entidade_id", F.col("pagina").alias("_page"), F.col("acao").alias("_acao"))
    joined = known.drop("acao").join(chosen, "entidade_id")
    wrong = F.raise_error(F.concat(F.lit("decision for another page: "), F.col("entidade_id")))
    return joined.withColumn("acao", F.when(F.col("_page") == F.col("pagina"), F.col("_acao")).otherwise(wrong)).drop("_page", "_acao")


def manual_decisions(known: DataFrame, decisions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Rectangles that a reviewer added and wants covered (entidade_id, pagina, x0, y0, x1, y1): decisions of unknown ids.

    Each must have rectangles, also one to be published, and name a page of ``pages`` (pagina) if those are given; else it is an error.
    """
    new = decisions.join(known, "entidade_id", "left_anti")
    wrong = F.when(F.size(F.coalesce("bboxes", F.array())) < 1, F.concat(F.lit("no rectangle for "), F.col("entidade_id")))
    if pages is not None:
        new = new.join(F.broadcast(pages.select(F.col("pagina").alias("_there")).distinct()), F.col("pagina") == F.col("_there"), "left")
        wrong = F.coalesce(wrong, F.when(F.col("_there").isNull(), F.concat(F.lit("no such page for "), F.col("entidade_id"))))
    # The check is part of the filter: before it, a row that is to go would not be looked at.
    covered = new.where(F.when(wrong.isNull(), F.col("acao") == "tarjar").otherwise(F.raise_error(wrong).cast("boolean")))
    return covered.select("entidade_id", "pagina", F.explode_outer("bboxes").alias("_b")).select("entidade_id", "pagina", "_b.*")


def normalized_rectangle(x0: Column, y0: Column, x1: Column, y1: Column, side: float = SIDE) -> Column:
    """Corners in order, no side shorter than ``side``."""
    left, top = F.least(x0, x1), F.least(y0, y1)
    return F.struct(left.alias("x0"), top.alias("y0"), F.greatest(F.greatest(x0, x1), left + side).alias("x1"), F.greatest(F.greatest(y0, y1), top + side).alias("y1"))


def drawn_rectangles(drawn: DataFrame, scale: float = 1.0) -> DataFrame:
    """Rectangles with both sides of ``LEAST_SIDE`` on screen, clamped to their page (width, height)."""
    big = drawn.where((F.abs(F.col("x1") - F.col("x0")) * scale >= LEAST_SIDE) & (F.abs(F.col("y1") - F.col("y0")) * scale >= LEAST_SIDE))
    clamp = lambda a, b, top: F.least(F.greatest(F.least(a, b), F.lit(0.0)), top)
    high = lambda a, b, top: F.least(F.greatest(F.greatest(a, b), F.lit(0.0)), top)
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    return big.withColumns({"x0": clamp(x0, x1, F.col("width")), "x1": high(x0, x1, F.col("width")), "y0": clamp(y0, y1, F.col("height")), "y1": high(y0, y1, F.col("height"))})


#: What a rectangle's row has beside its id: fields of the state that the events of a review change.
STATE = "struct<type: string, pagina: int, bboxes: array<struct<x0: double, y0: double, x1: double, y1: double>>, confidence: double, context: string, requires_review: boolean, manual: boolean, rejeitada: boolean, vista: boolean, ajustada: boolean>"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def review_states(loaded: DataFrame, events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rectangles of each review after its events: ``keys``, entidade_id and the fields of a state.

    ``loaded``: keys, entidade_id, type, pagina, bboxes, confidence, context, requires_review: what the
    last ``carregar`` brought. ``events``: keys, seq, acao, entidade_id, pagina, indice, bbox, in the order
    of seq. The fold is by rectangle: ``alternarRejeicao`` turns the decision and counts as seen,
    ``marcarVista`` marks as seen, ``ajustarBBox`` replaces the rectangle at ``indice`` (from 0; none at a
    place that is not there) and counts as seen and adjusted, ``adicionarManual`` makes a rectangle of its
    own, ``removerManual`` takes away such a one and no other. ``carregar`` forgets all that was before;
    ``selecionar`` and ``definirModo`` change no rectangle. Events of unknown ids do nothing.
    """
    item = F.struct("seq", "acao", F.col("pagina").cast("int").alias("pagina"), F.col("indice").cast("int").alias("indice"), F.col("bbox").cast(BOX).alias("bbox"))
    own = events.where(~F.col("acao").isin("carregar", "selecionar", "definirModo")).groupBy(*keys, "entidade_id").agg(F.array_sort(F.collect_list(item)).alias("_events"))
    resets = events.where("acao = 'carregar'").groupBy(*keys).agg(F.max("seq").alias("_reset"))
    base = loaded.select(*keys, "entidade_id", F.struct(
        "type", F.col("pagina").cast("int").alias("pagina"), F.col("bboxes").cast(f"array<{BOX}>").alias("bboxes"), F.col("confidence").cast("double").alias("confidence"), "context", "requires_review",
        *(F.lit(False).alias(f) for f in ("manual", "rejeitada", "vista", "ajustada")),
    ).cast(STATE).alias("_base"))
    rows = base.join(own, [*keys, "entidade_id"], "full_outer").join(resets, list(keys), "left")
    since = rows.withColumn("_events", F.expr("filter(_events, e -> _reset IS NULL OR e.seq > _reset)"))
    made = "named_struct('type', 'MANUAL', 'pagina', e.pagina, 'bboxes', array(e.bbox), 'confidence', cast(null AS double), 'context', cast(null AS string), 'requires_review', false, 'manual', true, 'rejeitada', false, 'vista', true, 'ajustada', false)"
    same = {f: f"s.{f}" for f in ("type", "pagina", "bboxes", "confidence", "context", "requires_review", "manual", "rejeitada", "vista", "ajustada")}

    def with_(**new: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in (same | new).items()) + ")"

    step = (
        f"CASE WHEN e.acao = 'adicionarManual' AND s IS NULL THEN cast({made} AS {STATE}) WHEN s IS NULL THEN s"
        f" WHEN e.acao = 'alternarRejeicao' THEN cast({with_(rejeitada='NOT s.rejeitada', vista='true')} AS {STATE})"
        f" WHEN e.acao = 'marcarVista' THEN cast({with_(vista='true')} AS {STATE})"
        f" WHEN e.acao = 'ajustarBBox' THEN cast({with_(bboxes='transform(s.bboxes, (b, i) -> if(i = e.indice, e.bbox, b))', vista='true', ajustada='true')} AS {STATE})"
        f" WHEN e.acao = 'removerManual' AND s.manual THEN cast(null AS {STATE}) ELSE s END"
    )
    folded = since.withColumn("_s", F.expr(f"aggregate(coalesce(_events, array()), _base, (s, e) -> {step})"))
    return folded.where("_s IS NOT NULL").select(*keys, "entidade_id", "_s.*")


def decisions_of(states: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A decision for each rectangle, rejected ones too: keys, entidade_id, pagina, acao and, of those drawn by hand, bboxes."""
    return states.select(*keys, "entidade_id", "pagina", F.when(F.col("rejeitada"), "publicar").otherwise("tarjar").alias("acao"), F.when(F.col("manual"), F.col("bboxes")).alias("bboxes"))


SURE = 0.9


def appearance(type_: Column, review: Column, manual: Column, confidence: Column, context: Column) -> Column:
    """How a rectangle is shown: what came masked, then what needs a review, what was drawn, what no label confirms, the rest."""
    sure = F.coalesce((confidence >= SURE) & context.isNull(), F.lit(False))
    return F.when(type_ == "CPF_MASCARADO", "mascarado").when(review, "revisao").when(manual, "manual").when(sure, "sem_contexto").otherwise("padrao")


def review_summary(states: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of active, rejected, flagged, pending, manual and adjusted entities; ``pode_confirmar`` is false while any is pending."""
    active, review, seen = F.col("ativa"), F.col("requires_review"), F.col("vista")
    out = states.groupBy(*keys).agg(
        F.count_if(active).alias("ativas"), F.count_if(~active).alias("rejeitadas"), F.count_if(active & review).alias("sinalizadas"),
        F.count_if(active & review & ~seen).alias("pendentes"), F.count_if(active & F.col("manual")).alias("manuais"), F.count_if(active & F.col("ajustada")).alias("ajustadas"),
    )
    return out.withColumn("pode_confirmar", F.col("pendentes") == 0)


def compared(expected: DataFrame, found: DataFrame, columns: tuple[str, ...], accepted: DataFrame | None = None) -> DataFrame:
    """Rows by outcome: VP in both, FN expected only, FP found only; FPs that were accepted are left out.

    One aggregation over both sides: a row's outcome is where it was seen. Nulls are equal to each other.
    """
    sides = [expected.select(*columns, F.lit(1).alias("_side")), found.select(*columns, F.lit(2).alias("_side"))]
    if accepted is not None:
        sides.append(accepted.select(*columns, F.lit(4).alias("_side")))
    seen = sides[0]
    for side in sides[1:]:
        seen = seen.unionByName(side)
    seen = seen.groupBy(*columns).agg(F.bit_or("_side").alias("_seen"))
    outcome = F.when(F.col("_seen").bitwiseAND(3) == 3, "VP").when(F.col("_seen").bitwiseAND(1) == 1, "FN").when(F.col("_seen") == 2, "FP")
    return seen.withColumn("outcome", outcome).where("outcome IS NOT NULL").select("outcome", *columns)


def counted(entities: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many entities there are of each type, for all or by ``keys``."""
    return entities.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def loose_numbers(texts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Literals of 11, 12, 14, 15 or 20 digits in a text: keys, raw, n_digits, the first line (from 1) and how often."""
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n", -1)).alias("line", "_line"))
    found = lines.select(*keys, "line", F.explode(F.regexp_extract_all("_line", F.lit(r"\p{Nd}(?:[.\-/ ]?\p{Nd}){10,19}"), F.lit(0))).alias("raw"))
    sized = found.withColumn("n_digits", F.length(F.regexp_replace("raw", r"\P{Nd}", ""))).where(F.col("n_digits").isin(11, 12, 14, 15, 20))
    return sized.groupBy(*keys, "raw", "n_digits").agg((F.min("line") + 1).alias("first_line"), F.count("*").alias("n"))


def claimed(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The longest literal first: spans (keys, start, end) that no longer one, or an earlier one of the same length, overlaps.

    Spans that no chain of overlaps ties together are settled apart from each other.
    """
    grouped = spans.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_all"))
    none = "slice(_all, 1, 0)"

    def step(s: str, x: str) -> dict[str, str]:
        apart = f"{x}.start >= {s}.reach"
        return {"reach": f"greatest({s}.reach, {x}.end)", "held": f"if({apart}, array({x}), concat({s}.held, array({x})))", "found": f"if({apart}, concat({s}.found, array({s}.held)), {s}.found)"}

    groups = walked("_all", {"reach": "cast(0 AS bigint)", "held": none}, step, f"slice(array({none}), 1, 0)", lambda r: f"concat(flatten({r}.found), array({r}.held))")
    sized = "transform(g, s -> named_struct('size', s.start - s.end, 'start', s.start, 'end', s.end))"
    settled = f"aggregate(array_sort({sized}), slice({sized}, 1, 0), (kept, s) -> if(exists(kept, k -> k.start < s.end AND s.start < k.end), kept, concat(kept, array(s))))"
    rows = grouped.withColumn("_all", F.transform("_all", lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))))
    found = rows.withColumn("_kept", F.expr(f"flatten(transform({groups}, g -> {settled}))"))
    return found.select(*keys, F.explode_outer("_kept").alias("s")).where("s IS NOT NULL").select(*keys, "s.start", "s.end")


def pages_of(extracted: DataFrame, sizes: DataFrame, entities: DataFrame) -> DataFrame:
    """Every page with its size and its entities in order, also those without any; a page without a size is an error."""
    own = entities.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "start", "end", "confidence", "requires_review"))).alias("entidades"))
    known = sizes.withColumn("_sized", F.lit(True))
    columns = [c for c in sizes.columns if c not in ("doc_id", "page")]
    joined = extracted.select("doc_id", "page").join(known, ["doc_id", "page"], "left")
    missing = F.raise_error(F.concat(F.lit("no size for page "), F.col("page").cast("string"), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # Each column of the size carries the check, so that none can be read without it.
    sized = joined.select("doc_id", "page", *(F.when(F.col("_sized"), F.col(c)).otherwise(missing).alias(c) for c in columns))
    return sized.join(own, ["doc_id", "page"], "left")
