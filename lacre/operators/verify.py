"""Verification of what was redacted: an independent scan, and checks of a document's other channels.

Every channel gives leaks as rows (keys, page, type, origin, detail); a document without any passes.
The channels of PDF files read tables of their objects, annotations and layers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import name
from .pipeline import detect, with_entities
from .redact import policy_action

LEAK = ("doc_id", "page", "type", "origin", "detail")


#: Small letters that a comparison without case has as several, or as another one, and ``lower`` leaves alone.
CASEFOLD = (("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("ς", "σ"), ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def text_key(text: Column) -> Column:
    """A value without separators and case."""
    key = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))
    for one, several in CASEFOLD:
        key = F.replace(key, F.lit(one), F.lit(several))
    return key


def text_leaks(texts: DataFrame, expected: DataFrame, text: str = "text") -> DataFrame:
    """What should have gone from a document (doc_id, type, text, acao) and is found again on any page (doc_id, page, text)."""
    forbidden = expected.where((F.col("acao") == "tarjar") & (F.col("type") != "CPF_MASCARADO")).select("doc_id", "type", text_key(F.col("text")).alias("_key"))
    found = detect(texts, ("doc_id", "page"), text).withColumn("_key", text_key(F.col("text")))
    leaks = found.join(forbidden, ["doc_id", "type", "_key"], "left_semi")
    return leaks.select("doc_id", "page", "type", F.lit("texto").alias("origin"), F.concat(F.col("type"), F.lit(" still legible")).alias("detail"))


def leaks_in_place(documents: DataFrame, entities: str = "entities", text: str = "text", policy: dict[str, str] | None = None, into: str = "vazamentos") -> DataFrame:
    """``documents`` with an array of what should have gone from each and is found again in ``text``, on the row where both are.

    No row moves. Every text is looked through for the letters and digits of what had to go. What is found
    is a piece of the text, so its key is a piece of the whole text's key: a text without any of the keys
    in that has no leak, and detection runs on the others. Keys meet by a hash, so a text with very many
    values costs no more than its values.
    """
    e = name("e")
    gone = F.expr(f"filter({entities}, {e} -> {e}.type <> 'CPF_MASCARADO' AND {policy_action(e, policy)} = 'tarjar')")
    key = lambda x: F.concat(x["type"], F.lit(":"), text_key(x["text"]))
    rows = documents.withColumns({"_gone": F.transform(gone, key), "_whole": text_key(F.col(text))})
    may = F.exists("_gone", lambda g: F.contains("_whole", F.substring_index(g, ":", -1)))
    rows = rows.withColumn("_searched", F.when(F.coalesce(may, F.size("_gone") > 0), F.col(text)))
    rows = with_entities(rows, "_searched", into="_after").withColumn("_keys", F.transform("_after", key))
    rows = rows.withColumn("_leaked", F.array_intersect("_gone", "_keys"))
    again = F.filter(F.zip_with("_after", "_keys", lambda x, k: F.when(F.array_contains("_leaked", k), x)), lambda x: x.isNotNull())
    return rows.withColumn(into, F.when(F.size("_leaked") > 0, again).otherwise(F.slice("_after", 1, 0))).drop("_gone", "_whole", "_searched", "_after", "_keys", "_leaked")


def verdict_in_place(documents: DataFrame, leaks: str = "vazamentos") -> DataFrame:
    """The same as ``verdict`` for documents of one page, with their leaks as an array."""
    n = F.size(leaks).cast("bigint")
    return documents.select("doc_id", (n == 0).alias("aprovado"), n.alias("n_leaks"), F.lit(1).cast("bigint").alias("n_pages"))


def _leak(rows: DataFrame, origin: str, detail: Column, page: Column | None = None) -> DataFrame:
    return rows.select("doc_id", (F.lit(None) if page is None else page).cast("int").alias("page"), F.lit(None).cast("string").alias("type"), F.lit(origin).alias("origin"), detail.alias("detail"))


#: What is always there and tells nothing.
DERIVED, TOLERATED = ("format", "encryption"), "Producer"
JS_LITERAL, JS_HEX, JS_REFERENCE = r"/JS\s*\((?!\))", r"/JS\s*<(?!>)", r"/JS\s+(\d+)\s+\d+\s+R"


def _filled(stream: str) -> Column:
    """Whether a stream is there and has more than white space."""
    return F.coalesce(F.length(F.regexp_replace(F.hex(stream), "(?:09|0A|0B|0C|0D|20|00)*$", "")) > 0, F.lit(False))


def metadata_leaks(objects: DataFrame) -> DataFrame:
    """Document information (type ``Info`` of the trailer, ``CatalogInfo`` of the catalog) and XMP streams.

    The catalog's own information may name its producer. XMP that the catalog refers to (type
    ``Catalog``, key ``Metadata``, the target's number as value) is one leak, each loose stream another.
    """
    info = objects.where((F.col("type") == "Info") & ~F.lower("key").isin(*DERIVED) & (F.coalesce(F.col("value"), F.lit("")) != ""))
    own = objects.where((F.col("type") == "CatalogInfo") & (F.col("key") != TOLERATED))
    attached = objects.where((F.col("type") == "Catalog") & (F.col("key") == "Metadata")).select("doc_id", F.col("value").cast("int").alias("_xref")).distinct()
    xmp = objects.where((F.col("type") == "Metadata") & F.col("is_stream") & _filled("stream")).select("doc_id", "xref").distinct()
    xmp = xmp.join(attached.withColumn("_attached", F.lit(True)), (xmp.doc_id == attached.doc_id) & (xmp.xref == F.col("_xref")), "left").select(xmp.doc_id, "xref", "_attached")
    named = F.when(F.col("_attached"), F.lit("XMP of the catalog")).otherwise(F.concat(F.lit("XMP in object "), F.col("xref").cast("string")))
    found = _leak(info, "metadados", F.concat(F.lit("/Info "), F.col("key"))).unionByName(_leak(own, "metadados", F.concat(F.lit("catalog /Info "), F.col("key"))))
    return found.unionByName(_leak(xmp, "metadados", named))


def form_leaks(objects: DataFrame, annotations: DataFrame) -> DataFrame:
    """A form in the catalog, and widgets by page."""
    fields = objects.where((F.col("type") == "Catalog") & (F.col("key") == "AcroForm"))
    widgets = annotations.where(F.col("kind") == "Widget").groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return _leak(fields, "acroform", F.lit("AcroForm")).unionByName(_leak(widgets, "acroform", F.concat(F.col("n").cast("string"), F.lit(" widgets")), F.col("page")))


def attachment_leaks(objects: DataFrame, annotations: DataFrame) -> DataFrame:
    """Files in the name tree, and those that a page's annotations hold."""
    names = objects.where((F.col("type") == "EmbeddedFiles") | (F.col("key") == "EmbeddedFiles"))
    notes = annotations.where(F.col("kind") == "FileAttachment")
    return _leak(names, "anexo", F.coalesce("value", F.lit("EmbeddedFiles"))).unionByName(_leak(notes, "anexo", F.lit("FileAttachment"), F.col("page")))


def script_leaks(objects: DataFrame) -> DataFrame:
    """Objects with a script that is not empty: a literal, hexadecimal digits, or a reference to a stream with any content."""
    scripts = objects.where(F.contains("source", F.lit("/JS")))
    direct = scripts.where(F.col("source").rlike(JS_LITERAL) | F.col("source").rlike(JS_HEX)).select("doc_id", "xref")
    filled = objects.where(F.col("is_stream") & _filled("stream")).select("doc_id", F.col("xref").alias("_target")).distinct()
    targets = scripts.select("doc_id", "xref", F.explode(F.regexp_extract_all("source", F.lit(JS_REFERENCE), F.lit(1))).alias("_target")).withColumn("_target", F.col("_target").cast("int"))
    referred = targets.join(filled, ["doc_id", "_target"], "left_semi").select("doc_id", "xref")
    return _leak(direct.unionByName(referred).distinct(), "javascript", F.concat(F.lit("object "), F.col("xref").cast("string")))


def layer_leaks(layers: DataFrame) -> DataFrame:
    """Any layer may hide content: one leak for each document that has some, with their names in order."""
    named = layers.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("_names"))
    return _leak(named, "optional_content", F.col("_names"))


def verdict(documents: DataFrame, pages: DataFrame, *leaks: DataFrame) -> DataFrame:
    """doc_id, aprovado, n_leaks and the number of pages checked, for each document."""
    all_leaks = reduce(DataFrame.unionByName, (x.select(*LEAK) for x in leaks))
    counts = all_leaks.groupBy("doc_id").agg(F.count("*").alias("n_leaks"))
    checked = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    joined = documents.select("doc_id").distinct().join(counts, "doc_id", "left").join(checked, "doc_id", "left")
    n = F.coalesce("n_leaks", F.lit(0))
    return joined.select("doc_id", (n == 0).alias("aprovado"), n.alias("n_leaks"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))
