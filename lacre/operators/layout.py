"""Text of pages from placed glyphs or from words that OCR read, and rectangles of spans of it.

A page is one row: its characters are an array of (char, box, confidence, real, word) in the order of
its text, with blanks and line breaks where the page shows them without having them. Glyphs or words
meet once, by page; rows, cells, blanks and breaks follow from walks over arrays, and a span is a
piece of the page's own array. A page holds as much as a sheet of paper does, so its row is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.masking import HIDDEN

#: Slack of a line's edges, least gap of a blank and least overlap of a row, in heights.
EDGE_SLACK, LEAST_GAP, LEAST_OVERLAP = 0.5, 0.25, 0.5
LOW_CONFIDENCE = 60.0
PAGE = ("doc_id", "page")
BOX = ("x0", "y0", "x1", "y1")


def edges_agree(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two boxes have the same upper and lower edge, within half the larger height."""
    slack = F.greatest(a1 - a0, b1 - b0, F.lit(1.0)) * EDGE_SLACK
    return (F.abs(a0 - b0) <= slack) & (F.abs(a1 - b1) <= slack)


def same_row(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two lines are cells of one row: they overlap by half the smaller height, and their edges agree."""
    overlap = F.least(a1, b1) - F.greatest(a0, b0)
    return (overlap > 0) & (overlap >= F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1.0)) * LEAST_OVERLAP) & edges_agree(a0, a1, b0, b1)


def is_space(c: Column) -> Column:
    return c.rlike(r"^[\s\x1c-\x1f\x85\p{Z}]+\z")


def _upto(start: Column, end: Column) -> Column:
    """The whole numbers from ``start`` on, before ``end``."""
    return F.filter(F.sequence(start, F.greatest(end - 1, start)), lambda i: i < end)


def _starts(items: Column, goes_on) -> Column:
    """The places at which a stretch begins: ``goes_on`` (an item before, an item) says that one does not."""
    return F.filter(_upto(F.lit(0), F.size(items)), lambda i: (i == 0) | ~F.coalesce(goes_on(F.get(items, i - 1), F.get(items, i)), F.lit(False)))


def _stretch(starts: Column, k: Column, size: Column) -> Column:
    """The places of the k-th stretch."""
    return _upto(F.get(starts, k), F.coalesce(F.get(starts, k + 1), size))


def _union(boxes: Column) -> dict[str, Column]:
    """The box around several."""
    side = lambda n: F.transform(boxes, lambda b: b[n])
    return {n: (F.array_min if n in ("x0", "y0") else F.array_max)(side(n)) for n in BOX}


def _with_characters(pages: DataFrame) -> DataFrame:
    """``pages``: PAGE and rows, an array of structs of a box and glyphs: cell, c, box, confidence, word."""
    none = F.lit(None)

    def item(char: Column, box: dict[str, Column], confidence: Column, real: bool, word: Column) -> Column:
        return F.struct(char.alias("char"), *(box[n].cast("double").alias(n) for n in BOX), confidence.cast("double").alias("confidence"), F.lit(real).alias("real"), word.cast("bigint").alias("word"))

    def characters(glyphs: Column, g: Column, i: Column) -> Column:
        b = F.get(glyphs, i - 1)
        gap = g["x0"] - b["x1"] > F.greatest(b["y1"] - b["y0"], F.lit(1.0)) * LEAST_GAP
        blank = F.coalesce(~is_space(F.right(b["c"], F.lit(1))) & ((b["cell"] != g["cell"]) | gap), F.lit(False))
        own = F.transform(F.split(g["c"], ""), lambda c: item(c, {n: g[n] for n in BOX}, g["confidence"], True, g["word"]))
        space = item(F.lit(" "), {"x0": b["x1"], "y0": b["y0"], "x1": F.greatest(g["x0"], b["x1"]), "y1": b["y1"]}, none, False, none)
        return F.when(blank, F.concat(F.array(space), own)).otherwise(own)

    def row(r: Column, k: Column) -> Column:
        text = F.flatten(F.transform(r["glyphs"], lambda g, i: characters(r["glyphs"], g, i)))
        end = item(F.lit("\n"), {"x0": r["x1"], "y0": r["y0"], "x1": r["x1"], "y1": r["y1"]}, none, False, none)
        return F.when(k < F.size("rows") - 1, F.concat(text, F.array(end))).otherwise(text)

    return pages.select(*PAGE, F.flatten(F.transform("rows", row)).alias("chars"))


def pages_of_glyphs(glyphs: DataFrame) -> DataFrame:
    """PAGE and chars, from glyphs: PAGE, line (in the order of extraction), ord, c, a box and the line's box (line_x0 ...).

    Only blocks of text (block_type 0) count. Lines next to each other that are cells of one row are
    read from left to right with a blank between them; a glyph of several characters gives its box to
    each of them.
    """
    fields = F.struct("line", *(f"line_{n}" for n in BOX), "ord", "c", *BOX)
    pages = glyphs.where("block_type = 0").groupBy(*PAGE).agg(F.sort_array(F.collect_list(fields)).alias("all"))
    pages = pages.withColumn("starts", _starts(F.col("all"), lambda b, x: b["line"] == x["line"]))

    def line(start: Column, k: Column) -> Column:
        first = F.get("all", start)
        own = F.filter(F.transform(_stretch(F.col("starts"), k, F.size("all")), lambda j: F.get("all", j)), lambda g: F.length(g["c"]) > 0)
        return F.struct(first["line"].alias("line"), *(first[f"line_{n}"].alias(n) for n in BOX), F.transform(own, lambda g: F.struct(*(g[f].alias(f) for f in ("c", *BOX)))).alias("glyphs"))

    pages = pages.select(*PAGE, F.transform("starts", line).alias("lines"))
    starts = _starts(F.col("lines"), lambda b, x: same_row(b["y0"], b["y1"], x["y0"], x["y1"]))
    pages = pages.withColumn("starts", starts).withColumn("n", F.size("lines"))

    def row(_: Column, k: Column) -> Column:
        own = F.transform(_stretch(F.col("starts"), k, F.col("n")), lambda j: F.get("lines", j))
        cells = F.sort_array(F.transform(own, lambda x: F.struct(x["x0"].alias("left"), x["line"].alias("line"), x["glyphs"].alias("glyphs"))))
        placed = F.flatten(F.transform(cells, lambda c, j: F.transform(c["glyphs"], lambda g: F.struct(j.alias("cell"), *(g[f].alias(f) for f in ("c", *BOX)), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("bigint").alias("word")))))
        return F.struct(*(v.alias(n) for n, v in _union(own).items()), placed.alias("glyphs"))

    return _with_characters(pages.select(*PAGE, F.transform("starts", row).alias("rows")))


def pages_of_words(words: DataFrame) -> DataFrame:
    """PAGE and chars, from OCR's words: PAGE, idx, block_num, par_num, line_num, word_num, left, top, width, height, conf, text.

    Words without text or confidence are structure, not text. Lines keep the order in which they
    first appear; every character has the box and the confidence of its word.
    """
    key = ("block_num", "par_num", "line_num")
    clean = words.withColumn("c", F.regexp_replace("text", r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+\z", "")).where((F.col("c") != "") & (F.col("conf") >= 0))
    boxed = clean.select(*PAGE, "idx", *key, "word_num", "c", F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), F.col("conf").alias("confidence"))
    pages = boxed.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*key, "word_num", "c", *BOX, "confidence", "idx"))).alias("all"))
    pages = pages.withColumn("starts", _starts(F.col("all"), lambda b, w: F.struct(*(b[k] for k in key)).eqNullSafe(F.struct(*(w[k] for k in key)))))

    def line(_: Column, k: Column) -> Column:
        own = F.transform(_stretch(F.col("starts"), k, F.size("all")), lambda j: F.get("all", j))
        glyphs = F.transform(own, lambda w, j: F.struct(j.alias("cell"), *(w[f].alias(f) for f in ("c", *BOX, "confidence")), w["idx"].cast("bigint").alias("word")))
        return F.struct(F.array_min(F.transform(own, lambda w: w["idx"])).alias("first"), *(v.alias(n) for n, v in _union(own).items()), glyphs.alias("glyphs"))

    return _with_characters(pages.select(*PAGE, F.sort_array(F.transform("starts", line)).alias("rows")))


def characters_of(pages: DataFrame) -> DataFrame:
    """The characters as rows: PAGE, idx, char, box, confidence, real, word."""
    return pages.select(*PAGE, F.posexplode("chars").alias("idx", "_c")).select(*PAGE, "idx", "_c.*")


def pages_of_characters(characters: DataFrame) -> DataFrame:
    """PAGE and chars, from characters as rows: PAGE, idx, char and a box."""
    own = F.transform(F.sort_array(F.collect_list(F.struct("idx", "char", *BOX))), lambda c: F.struct(c["char"].alias("char"), *(c[n].cast("double").alias(n) for n in BOX)))
    return characters.groupBy(*PAGE).agg(own.alias("chars"))


def low_confidence(pages: DataFrame, least: float = LOW_CONFIDENCE) -> DataFrame:
    """Words below ``least``, which stay in the text: PAGE, idx of the word, text, start, end, confidence."""
    same = lambda b, c: b["real"] & c["real"] & (b["word"] == c["word"])
    held = pages.withColumn("_starts", _starts(F.col("chars"), same))

    def word(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("chars"))
        first = F.get("chars", start)
        text = F.array_join(F.transform(_upto(start, end), lambda i: F.get("chars", i)["char"]), "")
        return F.when(first["real"] & (first["confidence"] < least), F.struct(first["word"].alias("idx"), text.alias("text"), start.alias("start"), end.alias("end"), first["confidence"].alias("confidence")))

    return held.select(*PAGE, F.explode(F.array_compact(F.transform("_starts", word))).alias("_w")).select(*PAGE, "_w.*")


def page_text(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda c: c["char"]), "")


def page_texts(pages: DataFrame) -> DataFrame:
    """PAGE and text."""
    return pages.select(*PAGE, page_text(F.col("chars")).alias("text"))


def scaled(characters: DataFrame, scale_x: Column, scale_y: Column) -> DataFrame:
    """Boxes in points from boxes in pixels."""
    return characters.withColumns({n: F.col(n) * (scale_x if n[0] == "x" else scale_y) for n in BOX})


def visual_lines(chars: Column, start: Column, end: Column) -> Column:
    """array<struct<n, box>>: one box around each visual line of a span. Line breaks are in no box."""

    def goes_on(before: Column, c: Column) -> Column:
        return (before["char"] != "\n") & edges_agree(before["y0"], before["y1"], c["y0"], c["y1"])

    def within(own: Column) -> Column:
        def line(starts: Column, k: Column) -> Column:
            boxes = F.filter(F.transform(_stretch(starts, k, F.size(own)), lambda j: F.get(own, j)), lambda c: c["char"] != "\n")
            return F.when(F.size(boxes) > 0, F.struct((k + 1).alias("n"), *(v.alias(n) for n, v in _union(boxes).items())))

        return F.get(F.transform(F.array(_starts(own, goes_on)), lambda starts: F.array_compact(F.transform(starts, lambda _, k: line(starts, k)))), 0)

    own = F.transform(_upto(start, F.least(end, F.size(chars))), lambda i: F.get(chars, i))
    return F.get(F.transform(F.array(own), within), 0)


def hidden_digits(chars: Column, start: Column, end: Column) -> Column:
    """array<struct<n, box>>: the boxes of the digits of a CPF that are to be hidden."""
    digits = F.filter(F.transform(_upto(start, F.least(end, F.size(chars))), lambda i: F.get(chars, i)), lambda c: c["char"].rlike(r"\p{Nd}"))
    shown = F.filter(digits, lambda _, i: i.isin(*HIDDEN))
    return F.transform(shown, lambda c, i: F.struct((i + 1).alias("n"), *(c[b].alias(b) for b in BOX)))


def rectangles_in_place(pages: DataFrame, spans: str = "spans", keep: tuple[str, ...] = ("span_id",)) -> DataFrame:
    """PAGE, ``keep``, n and a box for each visual line of the spans that pages have as an array of (``keep``, start, end)."""
    boxed = F.transform(spans, lambda s: F.struct(*(s[k].alias(k) for k in keep), visual_lines(F.col("chars"), s["start"], s["end"]).alias("boxes")))
    return _rows_of_boxes(pages, boxed, keep)


def _rows_of_boxes(pages: DataFrame, boxed: Column, keep: tuple[str, ...]) -> DataFrame:
    flat = F.flatten(F.transform(boxed, lambda s: F.transform(s["boxes"], lambda b: F.struct(*(s[k].alias(k) for k in keep), b["n"].alias("n"), *(b[x].alias(x) for x in BOX)))))
    return pages.select(*PAGE, F.explode_outer(flat).alias("_b")).where("_b IS NOT NULL").select(*PAGE, "_b.*")


def _with_spans(pages: DataFrame, spans: DataFrame, fields: tuple[str, ...], how: str) -> DataFrame:
    """The pages with their spans as an array. Where pages come from one shuffle by page, only the spans move.

    The join is a merge: estimates of size do not see what arrays hold or generators make, and a
    broadcast of pages that seem few would go through the driver's memory.
    """
    grouped = spans.groupBy(*PAGE).agg(F.collect_list(F.struct(*fields)).alias("spans")).hint("merge")
    return pages.select(*PAGE, "chars").join(grouped, [*PAGE], how)


def rectangles(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """One box around each visual line of a span: spans are PAGE, span_id, start, end. Line breaks are in no box."""
    return rectangles_in_place(_with_spans(pages, spans, ("span_id", "start", "end"), "inner"))


def entity_rectangles(pages: DataFrame, entities: DataFrame, keep: tuple[str, ...] = ("span_id",)) -> DataFrame:
    """PAGE, ``keep``, n and a box for each rectangle that shows an entity: PAGE, span_id, type, start, end, por_ocr.

    A CPF of a page that was not read by OCR is five boxes of one digit each, the ones to hide; anything
    else one box around each of its visual lines. A span beyond the page is an error. ``keep`` names the
    columns of the entities that their rectangles have as well, so that no join has to fetch them.
    """
    held = _with_spans(pages, entities, tuple(dict.fromkeys([*keep, "type", "start", "end", "por_ocr"])), "right")
    chars = F.coalesce(F.col("chars"), F.array())
    held = held.withColumn("chars", chars)

    def boxes(s: Column) -> Column:
        sound = (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.size("chars"))
        digits = (s["type"] == "CPF") & ~F.coalesce(s["por_ocr"], F.lit(False))
        bad = F.raise_error(F.concat(F.lit("span beyond its page, end "), s["end"].cast("string")))
        start, end = s["start"].cast("int"), s["end"].cast("int")
        found = F.when(digits, hidden_digits(F.col("chars"), start, end)).otherwise(visual_lines(F.col("chars"), start, end))
        return F.struct(*(s[k].alias(k) for k in keep), F.when(F.coalesce(sound, F.lit(False)), found).otherwise(bad).alias("boxes"))

    return _rows_of_boxes(held, F.transform("spans", boxes), keep)


def routed(pages: DataFrame) -> DataFrame:
    """``por_ocr`` for each page: true for all pages of a document none of which has any text."""
    any_text = F.max(F.coalesce(~F.coalesce(is_space(F.col("text")), F.lit(True)) & (F.col("text") != ""), F.lit(False))).over(W.partitionBy("doc_id"))
    return pages.withColumn("por_ocr", ~any_text)
