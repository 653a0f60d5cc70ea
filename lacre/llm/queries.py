"""The operators' queries over the standard tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, sql
from .common import id_remainder, prepare, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, find_contamination, with_hits

    prepare(spark)
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return with_hits(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    prepare(spark)
    base = F.filter("spans", lambda s: s["depth"] == 0)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"), "n_layers", "n_oversized",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    prepare(spark)
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    prepare(spark)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("restored").alias("n_restored"))


def op5_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linedup import classify_lines

    prepare(spark)
    return classify_lines(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    prepare(spark)
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    found = scan_licences(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["dice"])), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.round(best, 6).alias("best_dice"), names.alias("licences"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, learn

    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return identify(docs, learn(docs)).select("doc_id", held_out, "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    prepare(spark)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    prepare(spark)
    return remove_repeats(table(spark, sf_dir, "documents"), of_files=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    prepare(spark)
    found = whiten(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    each = found.rows.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(found.explained), F.col("i") + 1).alias("explained"), F.lit(found.identity_error).alias("identity_error"),
    )


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import score_texts

    prepare(spark)
    return score_texts(table(spark, sf_dir, "documents")).drop("token_scores")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    prepare(spark)
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_packing, op4_toxicity, op5_linedup, op6_topk, op7_licences, op8_langid, op9_simhash, op10_substrings, op11_whitening, op12_pitman_yor, op13_centroids)}

SQL: dict[str, str] = {
    "op1_decontaminate": sql.decontamination(),
    "op6_topk": sql.top_k(),
    "op7_licences": licences.oracle(),
    "op10_substrings": sql.substrings(),
    "op13_centroids": sql.centroids(),
}
