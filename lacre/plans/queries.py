"""The registered queries of the library's own operators, and their SQL for DuckDB."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checkdigits, masking
from ..model import ENTITY, TYPES, types_table
from ..operators import layout, pipeline, redact, review, verify
from ..operators.detect import detect_candidates
from ..operators.resolve import resolve
from ..session import shared, shared_folder
from ..sources import job_results
from ..sources.documents import refusal
from ..streaming import expiry, jobs
from . import recipes as r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared ones that nothing else uses."""
    shared_folder(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files, whether it is a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(f"{sf_dir}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a query that both engines read, over the tables it names after FROM or JOIN."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "events") if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    for t in named:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **named)


# Check digits: every order's key makes a number; some have fitting digits by chance, half by their making.

MANY = "(k * 7919 + 104729)"
NUMBERS = {
    "cpf": (checkdigits.is_cpf, r.padded(f"{MANY} * 131 % 99999999977", 11), r.cpf),
    "cnpj": (checkdigits.is_cnpj, r.padded(f"{MANY} * 1319 % 99999999999971", 14), r.cnpj),
    "pis": (checkdigits.is_pis, r.padded(f"{MANY} * 137 % 99999999977", 11), r.pis),
    "titulo_eleitor": (checkdigits.is_titulo_eleitor, r.padded(f"{MANY} * 139 % 99999999", 8) + " || " + r.padded("k % 31", 2) + " || " + r.padded("k % 97", 2), r.titulo),
    "cnh": (checkdigits.is_cnh, r.padded(f"{MANY} * 149 % 99999999977", 11), r.cnh),
    "cns": (checkdigits.is_cns, "CAST(1 + k % 9 AS VARCHAR(2)) || " + r.padded(f"{MANY} * 151 % 9999999967", 10) + " || '00' || " + r.padded("k % 20", 2), r.cns),
    "processo_cnj": (checkdigits.is_processo_cnj, r.padded(f"{MANY} % 9999991", 7) + " || " + r.padded("k % 98", 2) + " || " + r.padded(f"{MANY} * 157 % 99999999977", 11), r.cnj),
    "luhn": (checkdigits.is_luhn, r.padded(f"{MANY} * 163 % 9999999999999937", 16), lambda d: r.luhn(d, 16)),
}


def _number_query(name: str, check: Callable[[str], str], value: str, rule: Callable[[str], str]) -> None:
    recipe = [("v", value)]

    @query(f"valid_{name}", r.in_sql(recipe, f"SELECT k, v, {rule('v')} AS valid, {rule('v')} AS valid_masked FROM made"))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = r.in_spark(spark, sf_dir, recipe)
        masked = F.concat(F.substring("v", 1, 3), F.lit("."), F.substring("v", 4, 4), F.lit(" "), F.expr("substr(v, 8)"))
        return rows.withColumn("m", masked).select("k", "v", F.expr(check("v")).alias("valid"), F.expr(check("m")).alias("valid_masked"))


for _name, (_check, _value, _rule) in NUMBERS.items():
    _number_query(_name, _check, _value, _rule)

PHONE = [("ddd", "CAST(10 + k % 90 AS VARCHAR(2))"), ("sub", "CAST(CASE WHEN k % 2 = 0 THEN 700000000 + k * 7919 % 300000000 ELSE 10000000 + k * 7919 % 80000000 END AS VARCHAR(9))")]


@query(
    "valid_phone",
    r.in_sql(PHONE, "SELECT k, ddd, sub, CAST(ddd AS INT) IN (" + ", ".join(map(str, checkdigits.DDDS)) + ") AND CASE WHEN length(sub) = 9 THEN substr(sub, 1, 1) = '9' ELSE substr(sub, 1, 1) IN ('2', '3', '4', '5') END AS valid FROM made"),
)
def valid_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.in_spark(spark, sf_dir, PHONE).select("k", "ddd", "sub", F.expr(checkdigits.is_phone("ddd", "sub")).alias("valid"))


# Detection on texts made from keys; the SQL tells from the making what must be found.

CPF_MADE = [
    ("b", r.padded(f"{MANY} * 131 % 999999937", 9)), ("d1", f"b || CAST({r.mod11('b', range(10, 1, -1))} AS VARCHAR(1))"),
    ("n", f"d1 || CAST({r.mod11('d1', range(11, 1, -1))} AS VARCHAR(1))"),
    ("f", "substr(n, 1, 3) || '.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-' || substr(n, 10, 2)"),
]
CNPJ_MADE = [
    ("b", r.padded(f"{MANY} * 1319 % 999999999989", 12)), ("d1", f"b || CAST({r.mod11('b', r.CNPJ[1:])} AS VARCHAR(1))"),
    ("n", f"d1 || CAST({r.mod11('d1', r.CNPJ)} AS VARCHAR(1))"),
    ("f", "substr(n, 1, 2) || '.' || substr(n, 3, 3) || '.' || substr(n, 6, 3) || '/' || substr(n, 9, 4) || '-' || substr(n, 13, 2)"),
]
PIS_MADE = [("b", "'1' || " + r.padded(f"{MANY} * 137 % 999999937", 9)), ("n", f"b || CAST({r.mod11('b', r.PIS)} AS VARCHAR(1))"), ("f", "substr(n, 1, 3) || '.' || substr(n, 4, 5) || '.' || substr(n, 9, 2) || '-' || substr(n, 11, 1)")]
CNH_MADE = [
    ("b", r.padded(f"{MANY} * 149 % 999999937", 9)), ("r1", f"{r.total('b', range(9, 0, -1))} % 11"), ("d1", "CASE WHEN r1 >= 10 THEN 0 ELSE r1 END"),
    ("r2", f"({r.total('b', range(1, 10))} % 11 - CASE WHEN r1 >= 10 THEN 2 ELSE 0 END + 11) % 11"),
    ("n", "b || CAST(d1 AS VARCHAR(2)) || CAST(CASE WHEN r2 >= 10 THEN 0 ELSE r2 END AS VARCHAR(2))"), ("f", "n || ''"),
]
TITULO_MADE = [
    ("b", r.padded(f"{MANY} * 139 % 99999989", 8)), ("uf", r.padded("1 + k % 28", 2)), ("t1", f"{r.total('b', range(2, 10))} % 11"),
    ("d1", "CASE WHEN t1 = 10 THEN 0 WHEN t1 = 0 AND uf IN ('01', '02') THEN 1 ELSE t1 END"), ("t2", f"({r.digit('uf', 1)} * 7 + {r.digit('uf', 2)} * 8 + d1 * 9) % 11"),
    ("n", "b || uf || CAST(d1 AS VARCHAR(2)) || CAST(CASE WHEN t2 = 10 THEN 0 WHEN t2 = 0 AND uf IN ('01', '02') THEN 1 ELSE t2 END AS VARCHAR(2))"),
    ("f", "CASE WHEN k % 2 = 0 THEN n ELSE substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4) END"),
]
CNS_MADE = [
    ("b", "CAST(7 + k % 3 AS VARCHAR(2)) || " + r.padded(f"{MANY} * 151 % 9999999999971", 13)), ("x", f"(11 - {r.total('b', range(15, 1, -1))} % 11) % 11"),
    ("n", "b || CASE WHEN x = 10 THEN '0' ELSE CAST(x AS VARCHAR(2)) END"), ("f", "substr(n, 1, 3) || ' ' || substr(n, 4, 4) || ' ' || substr(n, 8, 4) || ' ' || substr(n, 12, 4)"),
]
CNJ_MADE = [
    ("a", r.padded(f"{MANY} % 9999991", 7)), ("c", r.padded(f"{MANY} * 157 % 99999999977", 11)), ("m1", "CAST(a AS BIGINT) % 97"), ("m2", "(m1 * 1000000 + CAST(substr(c, 1, 6) AS BIGINT)) % 97"),
    ("m3", "(m2 * 10000000 + CAST(substr(c, 7, 5) AS BIGINT) * 100) % 97"), ("dv", r.padded("98 - m3", 2)),
    ("f", "a || '-' || dv || '.' || substr(c, 1, 4) || '.' || substr(c, 5, 1) || '.' || substr(c, 6, 2) || '.' || substr(c, 8, 4)"),
]
#: A CPF that is a CNH as well, without a label of either, loses the dispute: of equal ranks, the type's name decides.
CPF_OR_PIS, NO_CNH = r.pis("n"), f"NOT {r.cnh('n')}"


def _detection(name: str, recipe: list[tuple[str, str]], cases: list[tuple[str, str, str | None, str]], type_: str, review: str = "false", value_start: str = "strpos(text, f)", size: str = "length(f)") -> None:
    """``cases`` are (text before, text after, confidence or None, condition): the n-th for keys with remainder n.

    The value is ``f``; a None says that nothing is found, or only where the condition is not met.
    """
    texts = "CASE " + " ".join(f"WHEN k % {len(cases)} = {i} THEN '{a}' || f || '{b}'" for i, (a, b, _, _) in enumerate(cases)) + " END"
    whole = [*recipe, ("text", texts)]
    confidence = "CASE " + " ".join(f"WHEN k % {len(cases)} = {i} THEN {c or 'NULL'}" for i, (_, _, c, _) in enumerate(cases)) + " END"
    allowed = "CASE " + " ".join(f"WHEN k % {len(cases)} = {i} THEN {w}" for i, (_, _, _, w) in enumerate(cases)) + " END"
    sql = r.in_sql(whole, f"SELECT k AS doc_id, '{type_}' AS type, CAST({value_start} - 1 AS INT) AS \"start\", CAST({value_start} - 1 + {size} AS INT) AS \"end\", CAST({confidence} AS DOUBLE) AS confidence, {review} AS requires_review FROM made WHERE {confidence} IS NOT NULL AND {allowed}")

    @query(f"detect_{name}", sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = r.in_spark(spark, sf_dir, whole).select(F.col("k").alias("doc_id"), "text")
        found = pipeline.detect(made).where(F.col("type") == type_)
        return found.select("doc_id", "type", "start", "end", "confidence", "requires_review")


def _plain(prefix: str) -> str:
    return f"'{prefix}'"


_detection("cpf", CPF_MADE, [("Fulano, CPF nº ", ", residente", "0.99", "true"), ("valor ", " pago", f"CASE WHEN {CPF_OR_PIS} THEN 0.6 ELSE 0.95 END", NO_CNH), ("lote ", " entregue", None, "true"), ("lote 7, CPF ", "", "0.99", "true"), ("PIS ", "", "0.95", f"NOT {r.pis('n')} AND {NO_CNH}"), ("linha\n\nitem ", "", None, "true")], "CPF")
_detection("cpf_loose", [*CPF_MADE[:3], ("f", "substr(n, 1, 5) || ' ' || substr(n, 6, 6)")], [("CPF:\n", "\nfim", "0.99", "true"), ("valor ", " pago", f"CASE WHEN {CPF_OR_PIS} THEN 0.6 ELSE 0.85 END", NO_CNH), ("BR", "", None, "true"), ("ref 7-", "", None, "true")], "CPF")
_detection("cnpj", CNPJ_MADE, [("CNPJ ", " da", "0.99", "true"), ("empresa ", "", "0.95", "true"), ("protocolo ", "", None, "true"), ("inscrita no cnpj: ", ".", "0.99", "true")], "CNPJ")
_detection("pis", PIS_MADE, [("PIS/PASEP ", " ok", "0.99", "true"), ("número de série ", "", None, "true"), ("NIT: ", "", "0.99", "true")], "PIS")
_detection("email", [("f", "'user' || CAST(k AS VARCHAR(20)) || '.x@mail.example.com.br'")], [("e-mail: ", ", ok", "0.99", "true"), ("veja ", " ok", "0.9", "true"), ("código ", "", None, "true"), ("protocolo 1, email ", "", "0.99", "true")], "EMAIL")
_detection("phone", [("f", "'(15) 9' || " + r.padded("k * 7919 % 9999", 4) + " || '-' || " + r.padded("k % 9999", 4))], [("telefone ", ".", "0.99", "true"), ("em ", ".", "0.9", "true"), ("empenho ", "", None, "true"), ("tel. ", "", "0.99", "true")], "TELEFONE")
_detection("cep", [("f", r.padded("k * 7919 % 99999", 5) + " || '-' || " + r.padded("k % 999", 3))], [("CEP ", ".", "0.99", "true"), ("Rua das Flores, 10, ", ".", "0.9", "true"), ("nada ", "", "0.5", "true"), ("Sorocaba/SP, ", "", "0.9", "true"), ("ficha ", "", None, "true")], "CEP", review="k % 5 = 2")
_detection("masked_cpf", [("f", "'***.' || " + r.padded("k * 7919 % 999", 3) + " || '.' || " + r.padded("k % 999", 3) + " || '-**'")], [("CPF ", ".", "0.99", "true"), ("de ", ".", "0.9", "true"), ("versão ", "", None, "true")], "CPF_MASCARADO", review="true")
_detection("rg", [("f", "'4' || CAST(k % 10 AS VARCHAR(1)) || '.' || " + r.padded("k * 7919 % 999", 3) + " || '.' || " + r.padded("k % 999", 3) + " || '-6'")], [("RG: ", " SSP", "0.99", "true"), ("de ", ".", None, "true"), ("RG do lote ", "", None, "true"), ("lote, carteira de identidade ", "", "0.99", "true")], "RG")
_detection("account", [("f", "'1' || " + r.padded("k % 999", 3) + " || '-3'")], [("agência ", " ok", "0.99", "true"), ("de ", "", None, "true"), ("c/c ", "", "0.99", "true")], "AGENCIA_CONTA")
_detection("birth_date", [("f", r.padded("1 + k % 28", 2) + " || '/' || " + r.padded("1 + k % 12", 2) + " || '/' || CAST(1940 + k % 60 AS VARCHAR(4))")], [("nascido em ", ",", "0.99", "true"), ("em ", "", None, "true"), ("data de nascimento: ", "", "0.99", "true")], "DATA_NASCIMENTO")
_detection("cid", [("f", "'F' || " + r.padded("k % 99", 2) + " || '.' || CAST(k % 10 AS VARCHAR(1))")], [("CID ", " x", "0.99", "true"), ("sala ", "", None, "true"), ("diagnóstico ", "", "0.99", "true")], "CID")
_detection("pix", [("f", "lpad(CAST(k AS VARCHAR(20)), 8, '0') || '-0000-4abc-9abc-00000000000a'")], [("chave PIX: ", ".", "0.99", "true"), ("id ", "", None, "true"), ("PIX ", "", "0.99", "true")], "CHAVE_PIX")
_detection("card", [("b", "'4' || " + r.padded(f"{MANY} * 163 % 99999999999977", 14)), ("n", "b || CAST((10 - (" + " + ".join(r.digit("b", i) if (16 - i) % 2 == 0 else f"(CASE WHEN {r.digit('b', i)} * 2 > 9 THEN {r.digit('b', i)} * 2 - 9 ELSE {r.digit('b', i)} * 2 END)" for i in range(1, 16)) + ") % 10) % 10 AS VARCHAR(1))"), ("f", "substr(n, 1, 4) || ' ' || substr(n, 5, 4) || ' ' || substr(n, 9, 4) || ' ' || substr(n, 13, 4)")], [("cartão de crédito ", ".", "0.99", "true"), ("pago ", "", "0.95", "true"), ("identificador ", "", None, "true")], "CARTAO_CREDITO")


_detection("cnh", CNH_MADE, [("CNH ", " ok", "0.99", "true"), ("doc ", ".", f"CASE WHEN {r.cpf('n')} OR {CPF_OR_PIS} THEN 0.6 ELSE 0.95 END", f"NOT {r.same('n')}"), ("lote ", "", None, "true"), ("carteira de habilitação: ", "", "0.99", f"NOT {r.same('n')}")], "CNH")
_detection("titulo", TITULO_MADE, [("Título de Eleitor ", ", zona", "0.99", "true"), ("doc ", ".", "0.95", "true"), ("protocolo ", "", None, "true")], "TITULO_ELEITOR")
_detection("cns", CNS_MADE, [("CNS: ", ".", "0.99", "x < 10"), ("cartão SUS ", " a", "0.99", "x < 10"), ("doc ", "", "0.95", "x < 10"), ("empenho ", "", None, "true")], "CNS")
_detection("processo_cnj", CNJ_MADE, [("processo ", " da vara", "0.99", "true"), ("feito ", ".", "0.95", "true"), ("lote ", "", None, "true"), ("protocolo 7, autos nº ", "", "0.99", "true")], "PROCESSO_CNJ")
_detection("pix_borrowed", CPF_MADE[:3] + [("f", "n || ''")], [("chave PIX: ", " ok", "0.7", "true"), ("PIX ", " ok", None, "true"), ("item, chave PIX: ", "", "0.7", "true"), ("PIX do lote: ", "", None, "true")], "CHAVE_PIX", value_start="strpos(text, f) - 1", size="length(f) + 1")

OCR_MADE = [("f", "'user' || CAST(k AS VARCHAR(20)) || '&mail.example.com'"), ("text", "CASE k % 3 WHEN 0 THEN 'e-mail: ' WHEN 1 THEN 'RG: 42.815.739-6, ' ELSE 'lote ' END || f || ' fim'")]


@query("detect_ocr", r.in_sql(OCR_MADE, """
    SELECT k AS doc_id, 'EMAIL' AS type, CAST(strpos(text, f) - 1 AS INT) AS "start", 'email_ocr_ambiguo' AS context, CAST(0.5 AS DOUBLE) AS confidence, true AS requires_review FROM made WHERE k % 2 = 0 AND k % 3 <> 2
    UNION ALL SELECT k, 'RG', 4, 'RG', CAST(0.99 AS DOUBLE), k % 2 = 0 FROM made WHERE k % 3 = 1"""))
def detect_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read by OCR have the rescue of e-mail addresses, and types that OCR reads badly come up for review."""
    made = r.in_spark(spark, sf_dir, OCR_MADE).select(F.col("k").alias("doc_id"), "text", (F.col("k") % 2 == 0).alias("por_ocr"))
    return pipeline.detect(made, ocr="por_ocr").select("doc_id", "type", "start", "context", "confidence", "requires_review")


FORMS_MADE = [("f", "'ABC-' || " + r.padded("k % 9999", 4)), ("text", "'placa ' || f || ' e e-mail u@mail.com'")]


@query("detect_extra", r.in_sql(FORMS_MADE, "SELECT k AS doc_id, 'PLACA' AS type, CAST(6 AS INT) AS \"start\", CAST(14 AS INT) AS \"end\", f AS text FROM made UNION ALL SELECT k, 'EMAIL', 24, 34, 'u@mail.com' FROM made"))
def detect_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of the user's beside those of one type."""

    def plates(n: Column) -> Column:
        at = F.regexp_instr(n, F.lit("[A-Z]{3}-[0-9]{4}")) - 1
        return F.when(at >= 0, F.array(F.struct(F.lit("PLACA").alias("type"), at.alias("start"), (at + 8).alias("end"), F.lit(0.9).alias("confidence"), F.lit("placa").alias("detector")))).otherwise(F.array())

    made = r.in_spark(spark, sf_dir, FORMS_MADE).select(F.col("k").alias("doc_id"), "text")
    return pipeline.detect(made, types=("EMAIL",), extra=(plates,)).select("doc_id", "type", "start", "end", "text")


NORMAL_MADE = [("text", "CASE k % 4 WHEN 0 THEN 'ﬁcha ' WHEN 1 THEN 'a' || chr(769) || ' ' WHEN 2 THEN '½ ' ELSE 'nº' || chr(160) END || 'e-mail u' || CAST(k AS VARCHAR(20)) || '@mail.com fim'")]


@query("detect_normalised", r.in_sql(NORMAL_MADE, "SELECT k AS doc_id, CAST(CASE k % 4 WHEN 0 THEN 12 WHEN 1 THEN 10 WHEN 2 THEN 9 ELSE 10 END AS INT) AS \"start\", 'u' || CAST(k AS VARCHAR(20)) || '@mail.com' AS text, CAST(0.99 AS DOUBLE) AS confidence FROM made"))
def detect_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that become several, or several one, in front of the value: offsets are those of the text as given."""
    made = r.in_spark(spark, sf_dir, [(n, e.replace("chr(769)", "'\u0301'").replace("chr(160)", "'\u00a0'")) for n, e in NORMAL_MADE]).select(F.col("k").alias("doc_id"), "text")
    return pipeline.detect(made).where("type = 'EMAIL'").select("doc_id", "start", "text", "confidence")


#: Disputes: case, type, start, end, confidence, validated, whether it stays.
DISPUTES = (
    (0, "CPF", 0, 14, 0.95, True, True), (0, "TELEFONE", 10, 24, 0.99, False, False),
    (1, "PIS", 0, 11, 0.6, True, False), (1, "CPF", 0, 11, 0.6, True, True),
    (2, "ENDERECO", 0, 50, 0.9, False, True), (2, "CEP", 30, 39, 0.99, False, True),
    (3, "CNPJ", 0, 18, 0.99, True, True), (3, "TELEFONE", 3, 14, 0.9, False, False), (3, "CEP", 20, 29, 0.5, False, True),
    (4, "EMAIL", 0, 20, 0.9, False, True), (4, "CEP", 15, 33, 0.9, False, False), (4, "RG", 30, 40, 0.9, False, True),
    (5, "CHAVE_PIX", 4, 20, 0.7, False, False), (5, "EMAIL", 4, 20, 0.9, False, True),
    (6, "TELEFONE", 8, 18, 0.99, False, False), (6, "RG", 0, 12, 0.5, False, True),
    (7, "CNPJ", 0, 18, 0.85, True, True), (7, "CPF", 2, 16, 0.6, True, True), (7, "CHAVE_PIX", 1, 17, 0.99, False, False),
    (8, "CID", 0, 5, 0.99, False, True), (8, "CID", 5, 9, 0.99, False, True),
)
DISPUTED = "SELECT k AS doc_id, type, CAST(s + k % 7 AS INT) AS s, CAST(e + k % 7 AS INT) AS e, CAST(confidence AS DOUBLE) AS confidence, validated, stays FROM (SELECT o_orderkey AS k FROM orders) AS o JOIN (VALUES " + ", ".join(f"({c}, '{t}', {a}, {b}, {q}, {str(v).lower()}, {str(z).lower()})" for c, t, a, b, q, v, z in DISPUTES) + ") AS d(c, type, s, e, confidence, validated, stays) ON k % 9 = c"


@query("resolve_disputes", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC) - 1 AS INT) AS ord, type, s, e FROM ({DISPUTED}) WHERE stays")
def resolve_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, DISPUTED).selectExpr("doc_id", "type", "s AS start", "e AS end", "'x' AS text", "confidence", "'d' AS detector", "validated", "CAST(NULL AS STRING) AS context", "false AS requires_review", "CAST(0 AS INT) AS ord")
    return resolve(rows, ("doc_id",)).selectExpr("doc_id", "ord", "type", "start AS s", "end AS e")


@query("detect_documents")
def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors and the policy over the whole texts of ``documents``."""
    found = pipeline.with_action(pipeline.detect(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "ord", "type", "start", "end", "text", "confidence", "detector", "validated", "context", "requires_review", "acao")


EMAIL_SQL = """
    WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.+%-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)', 1)) AS text FROM documents)
    SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id"""


@query("emails_of_documents", EMAIL_SQL)
def emails_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.contains("text", F.lit("@")))
    return detect_candidates(docs, ("doc_id",), types=("EMAIL",)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("detect_sql", EMAIL_SQL)
def detect_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same asked for in SQL, by a function that stands for detection."""
    pipeline.register(spark, "emails_in", types=("EMAIL",))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, inline(found) FROM (SELECT doc_id, emails_in(text) AS found FROM {docs})) GROUP BY doc_id", docs=docs)


@query("detect_changed", EMAIL_SQL)
def detect_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents is known from an earlier run; only the texts of the others are searched."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    nothing = spark.createDataFrame([], f"sha256 string, entities array<{ENTITY}>")
    _, known = pipeline.with_known(docs.where("doc_id % 3 = 0"), nothing, types=("EMAIL",))
    found, _ = pipeline.with_known(docs, known, types=("EMAIL",))
    return found.where(F.size("entities") > 0).select("doc_id", F.explode("entities")).groupBy("doc_id").agg(F.count("*").alias("n"))


#: One row for each place of an order, as keys may come twice.
ITEMS = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) AS items"


# Entities made from line items, for the operators that work on entities.

ENTITIES = f"""
    SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'CPF' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'CNPJ' WHEN 3 THEN 'CPF_MASCARADO' ELSE 'RG' END AS type,
        CAST(l_quantity AS INT) AS s, CAST(l_quantity AS INT) + 3 + CAST(l_suppkey % 9 AS INT) AS e, l_partkey % 3 = 0 AS flag, l_suppkey % 2 = 0 AS seen, l_partkey % 7 <> 0 AS active
    FROM {ITEMS}"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, ENTITIES)


@query("redaction_report", f"""
    SELECT doc_id, count(*) FILTER (WHERE type IN ('CPF', 'EMAIL', 'RG')) AS n_covered, count(*) FILTER (WHERE type = 'CNPJ') AS n_published, count(*) FILTER (WHERE type = 'CPF_MASCARADO') AS n_masked_before,
        count(*) FILTER (WHERE type = 'CPF') AS n_partial_cpf, count(*) FILTER (WHERE flag) AS n_review FROM ({ENTITIES}) GROUP BY doc_id""")
def redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.report(pipeline.with_action(_entities(spark, sf_dir).withColumnRenamed("flag", "requires_review")))


POLICY_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{m}', '{a}')" for t, c, m, a in TYPES) + ") AS p(type, categoria, metodo, acao)) AS policy"


@query("policy", f"SELECT type, categoria, metodo, acao, count(doc_id) AS n, count(DISTINCT doc_id) AS n_docs FROM {POLICY_SQL} LEFT JOIN ({ENTITIES}) USING (type) GROUP BY ALL")
def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type with what the policy says of it, and how many entities and documents that concerns."""
    counts = _entities(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
    return types_table(spark).join(F.broadcast(counts), "type", "left").fillna(0, ["n", "n_docs"])


@query("redaction_report_manual", f"""
    WITH e AS (SELECT doc_id, count(*) FILTER (WHERE type IN ('CPF', 'EMAIL', 'RG')) AS n_covered, count(*) FILTER (WHERE type = 'CNPJ') AS n_published FROM ({ENTITIES}) WHERE doc_id % 3 <> 0 GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_manual FROM ({ENTITIES}) WHERE active AND doc_id % 2 = 0 GROUP BY doc_id)
    SELECT doc_id, coalesce(n_covered, 0) AS n_covered, coalesce(n_published, 0) AS n_published, coalesce(n_manual, 0) AS n_manual FROM e FULL JOIN m USING (doc_id)""")
def redaction_report_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with entities, with drawn rectangles, or both."""
    rows = _entities(spark, sf_dir)
    manual = rows.where("active AND doc_id % 2 = 0").select("doc_id", F.col("s").alias("start"), F.col("e").alias("end"))
    found = redact.report(pipeline.with_action(rows.where("doc_id % 3 <> 0").withColumnRenamed("flag", "requires_review")), manual=manual)
    return found.select("doc_id", "n_covered", "n_published", "n_manual")


@query("document_hashes", "SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each document as a file of UTF-8 would have it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    content = F.encode("text", "UTF-8")
    files = docs.select(F.col("doc_id").alias("path"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))
    return redact.file_hashes(files).select(F.col("path").alias("doc_id"), F.col("length").alias("n_bytes"), "sha256")


@query("review_summary", f"""
    SELECT doc_id, count(*) FILTER (WHERE active) AS ativas, count(*) FILTER (WHERE NOT active) AS rejeitadas, count(*) FILTER (WHERE active AND flag) AS sinalizadas, count(*) FILTER (WHERE active AND flag AND NOT seen) AS pendentes,
        count(*) FILTER (WHERE active AND type = 'RG') AS manuais, count(*) FILTER (WHERE active AND s > 25) AS ajustadas, count(*) FILTER (WHERE active AND flag AND NOT seen) = 0 AS pode_confirmar FROM ({ENTITIES}) GROUP BY doc_id""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir)
    return review.review_summary(rows.selectExpr("doc_id", "active AS ativa", "flag AS requires_review", "seen AS vista", "type = 'RG' AS manual", "s > 25 AS ajustada"))


@query("appearance", f"""
    SELECT doc_id, ord, CASE WHEN type = 'CPF_MASCARADO' THEN 'mascarado' WHEN flag THEN 'revisao' WHEN type = 'RG' THEN 'manual' WHEN s > 25 AND seen THEN 'sem_contexto' ELSE 'padrao' END AS shown FROM ({ENTITIES})""")
def appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    confidence, context = F.when(c("s") > 25, 0.95).otherwise(0.6), F.when(~c("seen"), "CPF")
    return _entities(spark, sf_dir).select("doc_id", "ord", review.appearance(c("type"), c("flag"), c("type") == "RG", confidence, context).alias("shown"))


@query("type_counts", f"SELECT type, count(*) AS n FROM ({ENTITIES}) GROUP BY type")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counted(_entities(spark, sf_dir))


@query("accepted_findings", f"""
    WITH a AS (SELECT DISTINCT doc_id, type FROM ({ENTITIES}) WHERE flag), b AS (SELECT DISTINCT doc_id, type FROM ({ENTITIES}) WHERE active), c AS (SELECT DISTINCT doc_id, type FROM ({ENTITIES}) WHERE seen)
    SELECT CASE WHEN b.doc_id IS NULL THEN 'FN' WHEN a.doc_id IS NULL THEN 'FP' ELSE 'VP' END AS outcome, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.type, b.type) AS type
    FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.type = b.type WHERE a.doc_id IS NOT NULL OR (b.doc_id, b.type) NOT IN (SELECT (doc_id, type) FROM c)""")
def accepted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir)
    return review.compared(rows.where("flag"), rows.where("active"), ("doc_id", "type"), rows.where("seen"))


@query("golden_comparison", f"""
    WITH a AS (SELECT DISTINCT doc_id, type, s, e FROM ({ENTITIES}) WHERE flag), b AS (SELECT DISTINCT doc_id, type, s, e FROM ({ENTITIES}) WHERE active AND type <> 'CNPJ')
    SELECT CASE WHEN a.doc_id IS NULL THEN 'FP' WHEN b.doc_id IS NULL THEN 'FN' ELSE 'VP' END AS outcome, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.type, b.type) AS type, coalesce(a.s, b.s) AS s, coalesce(a.e, b.e) AS e
    FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.type = b.type AND a.s = b.s AND a.e = b.e""")
def golden_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir)
    return review.compared(rows.where("flag"), rows.where("active AND type <> 'CNPJ'"), ("doc_id", "type", "s", "e"))


#: The id of an entity as SQL: its place and type in its document.
ENTITY_ID = """sha256('["' || CAST(doc_id AS VARCHAR(20)) || '","' || CAST(ord AS VARCHAR(20)) || '","' || type || '"]')"""


@query("missing_decisions", f"SELECT {ENTITY_ID} AS entidade_id FROM ({ENTITIES}) WHERE NOT seen")
def missing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.entity_ids(_entities(spark, sf_dir))
    return review.missing_decisions(rows, rows.where("seen"))


@query("known_decisions", f"SELECT {ENTITY_ID} AS entidade_id, type, CASE WHEN flag THEN 'publicar' ELSE 'tarjar' END AS acao FROM ({ENTITIES}) WHERE seen")
def known_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.entity_ids(_entities(spark, sf_dir)).withColumn("pagina", F.lit(1))
    decisions = rows.where("seen").selectExpr("entidade_id", "pagina", "CASE WHEN flag THEN 'publicar' ELSE 'tarjar' END AS acao")
    return review.known_decisions(rows, decisions).select("entidade_id", "type", "acao")


@query("recovered_ids", f"SELECT {ENTITY_ID} AS entidade_id, doc_id, ord, s FROM ({ENTITIES})")
def recovered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows have ids and no spans, the fresh ones spans and no ids."""
    rows = _entities(spark, sf_dir)
    stored = review.entity_ids(rows).select("doc_id", "ord", "type", "entidade_id")
    return review.recovered(stored, rows, ("doc_id",)).select("entidade_id", "doc_id", "ord", "s")


@query("manual_decisions", f"SELECT {ENTITY_ID} AS entidade_id, CAST(ord % 3 AS INT) AS pagina, CAST(s AS DOUBLE) AS x0, CAST(e AS DOUBLE) AS x1 FROM ({ENTITIES}) WHERE NOT seen AND active")
def manual_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of ids that are not known are rectangles drawn by hand."""
    rows = review.entity_ids(_entities(spark, sf_dir)).withColumn("pagina", (F.col("ord") % 3).cast("int"))
    box = F.struct(F.col("s").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.col("e").cast("double").alias("x1"), F.lit(9.0).alias("y1"))
    decisions = rows.select("entidade_id", "pagina", F.when(F.col("active"), "tarjar").otherwise("publicar").alias("acao"), F.array(box).alias("bboxes"))
    pages = spark.range(3).selectExpr("CAST(id AS INT) AS pagina")
    return review.manual_decisions(rows.where("seen"), decisions, pages).select("entidade_id", "pagina", "x0", "x1")


#: Events of a review: case, seq, event, whether it is about the rectangle drawn by hand.
REVIEW_EVENTS = (
    (1, 1, "alternarRejeicao", False), (2, 1, "alternarRejeicao", False), (2, 2, "alternarRejeicao", False), (3, 1, "marcarVista", False), (3, 2, "selecionar", False), (4, 1, "ajustarBBox", False),
    (5, 1, "adicionarManual", True), (5, 2, "alternarRejeicao", True), (6, 1, "adicionarManual", True), (6, 2, "removerManual", True), (6, 3, "removerManual", False),
    (7, 1, "alternarRejeicao", False), (7, 2, "adicionarManual", True), (7, 3, "carregar", False), (7, 4, "definirModo", False),
)
REVIEWED = "SELECT k AS doc_id, CAST(seq AS INT) AS seq, acao, CAST(k AS VARCHAR(20)) || CASE WHEN manual THEN 'm' ELSE 'a' END AS entidade_id, CAST(0 AS INT) AS pagina, CAST(1 AS INT) AS indice, CAST(k AS DOUBLE) AS x FROM (SELECT o_orderkey AS k FROM orders) AS o JOIN (VALUES " + ", ".join(f"({c}, {n}, '{a}', {str(m).lower()})" for c, n, a, m in REVIEW_EVENTS) + ") AS v(c, seq, acao, manual) ON k % 8 = c"
REVIEW_SQL = """
    SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) || 'a' AS entidade_id, false AS manual, o_orderkey % 8 = 1 AS rejeitada, o_orderkey % 8 IN (1, 2, 3, 4) AS vista, o_orderkey % 8 = 4 AS ajustada,
        CAST(2 AS INT) AS n_boxes, CASE WHEN o_orderkey % 8 = 4 THEN CAST(o_orderkey AS DOUBLE) ELSE 5.0 END AS x0 FROM orders
    UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || 'm', true, true, true, false, 1, CAST(o_orderkey AS DOUBLE) FROM orders WHERE o_orderkey % 8 = 5"""


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda x: F.struct(x.alias("x0"), x.alias("y0"), x.alias("x1"), x.alias("y1"))
    events = _rows(spark, sf_dir, REVIEWED).withColumn("bbox", box(F.col("x")))
    boxes = F.array(box(F.lit(1.0)), box(F.lit(5.0)))
    loaded = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit("a")).alias("entidade_id"), F.lit("CPF").alias("type"), F.lit(0).alias("pagina"), boxes.alias("bboxes"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("context"), F.lit(False).alias("requires_review"))
    return review.review_states(loaded, events)


@query("review_states", REVIEW_SQL)
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight events of a review, folded by rectangle."""
    return _review(spark, sf_dir).select("doc_id", "entidade_id", "manual", "rejeitada", "vista", "ajustada", F.size("bboxes").alias("n_boxes"), F.element_at("bboxes", -1)["x0"].alias("x0"))


@query("review_decisions", f"SELECT entidade_id, CASE WHEN rejeitada THEN 'publicar' ELSE 'tarjar' END AS acao, manual AS com_bboxes FROM ({REVIEW_SQL})")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decisions_of(_review(spark, sf_dir)).select("entidade_id", "acao", F.col("bboxes").isNotNull().alias("com_bboxes"))


MASKED = [*CPF_MADE, ("text", "CASE WHEN k % 2 = 0 THEN f ELSE n END")]


@query("mask_cpf", r.in_sql(MASKED, "SELECT k, '***.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-**' AS masked, CASE WHEN k % 2 = 0 THEN '0,1,2,12,13' ELSE '0,1,2,9,10' END AS places FROM made"))
def mask_cpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.in_spark(spark, sf_dir, MASKED)
    return rows.select("k", masking.mask_cpf(F.col("text")).alias("masked"), F.array_join(masking.hidden_places(F.col("text")), ",").alias("places"))


REDACTED = [*CPF_MADE, ("text", "'CPF ' || f || ', e-mail u' || CAST(k AS VARCHAR(20)) || '@mail.com; fim'")]


@query("redact", r.in_sql(REDACTED, "SELECT k AS doc_id, 'CPF ███.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-██, e-mail ' || repeat('█', CAST(length(CAST(k AS VARCHAR(20))) + 10 AS INT)) || '; fim' AS redacted FROM made"))
def redact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the texts: detection and redaction on the same row."""
    made = r.in_spark(spark, sf_dir, REDACTED).select(F.col("k").alias("doc_id"), "text")
    return redact.redact_in_place(pipeline.with_entities(made)).select("doc_id", "redacted")


@query("redact_decided", r.in_sql(REDACTED, "SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'CPF ███.' || substr(n, 4, 3) || '.' || substr(n, 7, 3) || '-██' ELSE 'CPF ' || f END || substr(text, length('CPF ' || f) + 1, length(text) - length('CPF ' || f) - 3) || '███' AS redacted FROM made"))
def redact_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer hides every second CPF and no address, and draws over the last three characters."""
    made = r.in_spark(spark, sf_dir, REDACTED).select(F.col("k").alias("doc_id"), "text")
    entities = pipeline.detect(made, types=("CPF",)).withColumn("acao", F.when(F.col("doc_id") % 2 == 0, "tarjar").otherwise("publicar"))
    drawn = made.select("doc_id", (F.length("text") - 3).alias("start"), F.length("text").alias("end"))
    return redact.redact(made, entities, manual=drawn).select("doc_id", "redacted")


@query("verify_redaction", r.in_sql(REDACTED, "SELECT k AS doc_id, k % 4 <> 0 AS aprovado, CAST(CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_leaks, CAST(1 AS BIGINT) AS n_pages FROM made"))
def verify_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth text is passed on as it was, so its two values must be found again.

    What is verified is read back from where it was written, as an independent look at it has to.
    """
    written = shared(_passed_on(spark, sf_dir))
    return verify.verdict_in_place(verify.leaks_in_place(written))


def _passed_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found in each text, and the text as it is passed on: every fourth as it was, the others redacted."""
    made = r.in_spark(spark, sf_dir, REDACTED).select(F.col("k").alias("doc_id"), "text")
    out = redact.redact_in_place(pipeline.with_entities(made))
    return out.select("doc_id", "entities", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.col("redacted")).alias("text"))


@query("verify_pages", r.in_sql(REDACTED, "SELECT k AS doc_id, k % 4 <> 0 AS aprovado, CAST(CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_leaks, CAST(2 AS BIGINT) AS n_pages FROM made WHERE k % 5 = 0"))
def verify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the documents, with a page for each of their two values: what had to go may be found on any page."""
    written = shared(_passed_on(spark, sf_dir).where("doc_id % 5 = 0"))
    entities = pipeline.with_action(pipeline.rows_of(written, ("doc_id",)))
    pages = written.select("doc_id", F.posexplode(F.split("text", ", ")).alias("page", "text"))
    return verify.verdict(written, pages, verify.text_leaks(pages, entities))


REVERSED = [*CPF_MADE, ("text", "'e-mail u' || CAST(k AS VARCHAR(20)) || '@mail.com; CPF ' || f")]


@query("registry_order", r.in_sql(REVERSED, "SELECT k AS doc_id, 'CPF' AS type, CAST(0 AS INT) AS ord, strpos(text, 'CPF') + 3 AS n_start FROM made UNION ALL SELECT k, 'EMAIL', 1, 7 FROM made"))
def registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before disputes are settled detections come in the order of the detectors, not of the text: documents before addresses."""
    made = r.in_spark(spark, sf_dir, REVERSED).select(F.col("k").alias("doc_id"), "text")
    return detect_candidates(made, ("doc_id",), types=("EMAIL", "CPF")).select("doc_id", "type", "ord", F.col("n_start").cast("bigint").alias("n_start"))


#: Objects of a file: case, object, type, key, value, source, stream.
OBJECTS = (
    (0, 1, "Info", "Title", "x", "", None), (0, 2, "Info", "format", "PDF 1.7", "", None), (1, 1, "Info", "Title", "", "", None), (1, 2, "CatalogInfo", "Producer", "p", "", None), (1, 3, "CatalogInfo", "Author", "p", "", None),
    (2, 4, "Catalog", "Metadata", "5", "", None), (2, 5, "Metadata", "", "", "", "<x/>"), (2, 6, "Metadata", "", "", "", "<y/>"), (2, 7, "Metadata", "", "", "", "  "),
    (3, 4, "Catalog", "AcroForm", "9", "", None), (4, 4, "EmbeddedFiles", "", "a.txt", "", None),
    (5, 7, "Action", "", "", "<< /JS (app.alert(1)) >>", None), (5, 8, "Action", "", "", "<< /JS () /S /JavaScript >>", None), (5, 9, "Action", "", "", "<< /JS <2f2f> >>", None), (5, 10, "Action", "", "", "<< /JS 11 0 R >>", None), (5, 11, "Stream", "", "", "", "code"), (5, 12, "Action", "", "", "<< /JS 13 0 R >>", None), (5, 13, "Stream", "", "", "", " "),
)
NOTES = ((3, 1, "Widget"), (3, 1, "Widget"), (3, 2, "Widget"), (4, 0, "FileAttachment"), (1, 0, "Link"))
LAYERS = ((6, "b"), (6, "a"))
CHANNELS_SQL = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 8 " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in {0: "metadados:/Info Title", 1: "metadados:catalog /Info Author", 2: "metadados:XMP in object 6;metadados:XMP of the catalog", 3: "acroform:1 widgets@2;acroform:2 widgets@1;acroform:AcroForm", 4: "anexo:FileAttachment@0;anexo:a.txt", 5: "javascript:object 10;javascript:object 7;javascript:object 9", 6: "optional_content:a, b"}.items()) + " ELSE '' END AS leaks, o_orderkey % 8 = 7 AS aprovado FROM orders"


@query("verify_channels", CHANNELS_SQL)
def verify_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels beside the text: each case of a file has something left in one of them, the last in none."""

    def cases(rows: tuple, schema: str) -> DataFrame:
        table = F.broadcast(spark.createDataFrame(rows, "c int, " + schema))
        return orders.join(table, orders.doc_id % 8 == table.c).drop("c")

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    objects = cases(OBJECTS, "xref int, type string, key string, value string, source string, stream string").withColumn("is_stream", F.col("stream").isNotNull()).withColumn("stream", F.col("stream").cast("binary"))
    notes, layers = cases(NOTES, "page int, kind string"), cases(LAYERS, "name string")
    channels = (verify.metadata_leaks(objects), verify.form_leaks(objects, notes), verify.attachment_leaks(objects, notes), verify.script_leaks(objects), verify.layer_leaks(layers))
    told = verify.verdict(orders, orders.withColumn("page", F.lit(0)), *channels)
    leaks = channels[0]
    for c in channels[1:]:
        leaks = leaks.unionByName(c)
    line = F.concat("origin", F.lit(":"), "detail", F.coalesce(F.concat(F.lit("@"), F.col("page").cast("string")), F.lit("")))
    listed = leaks.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), ";").alias("leaks"))
    return told.join(listed, "doc_id", "left").select("doc_id", F.coalesce("leaks", F.lit("")).alias("leaks"), "aprovado")


RECTANGLES = "SELECT l_orderkey AS doc_id, l_linenumber AS n, l_quantity AS x0, l_quantity * 2 AS y0, CASE WHEN l_partkey % 2 = 0 THEN l_quantity - l_discount * 100 ELSE l_quantity + l_tax * 900 END AS x1, l_quantity * 2 + l_tax * 200 AS y1 FROM lineitem"


@query("rectangles", f"SELECT doc_id, n, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1, least(x0, x1) + 4) AS x1, greatest(y0, y1, least(y0, y1) + 4) AS y1 FROM ({RECTANGLES})")
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, RECTANGLES)
    return rows.select("doc_id", "n", review.normalized_rectangle(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("b")).select("doc_id", "n", "b.*")


@query("upload_filter", "SELECT page_id, octet_length(encode(html)) AS size, CASE WHEN octet_length(encode(html)) > 3000 THEN 413 WHEN substr(html, 1, 9) <> '<!doctype' THEN 415 END AS recusa FROM pages")
def upload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("content", F.col("html").cast("binary"))
    size = F.octet_length("content").cast("bigint")
    return pages.select("page_id", size.alias("size"), refusal(F.col("content"), size, 3000, b"<!doctype").alias("recusa"))


DRAWN = "SELECT l_orderkey AS doc_id, l_linenumber AS n, l_quantity * 2 AS x0, 5.0 AS y0, l_quantity * 2 - l_discount * 200 AS x1, 5.0 + l_tax * 100 AS y1, 60.0 AS width, 10.0 AS height FROM lineitem"


@query("drawn_rectangles", f"SELECT doc_id, n, greatest(least(x0, x1, width), 0) AS x0, greatest(least(y0, y1, height), 0) AS y0, least(greatest(x0, x1, 0), width) AS x1, least(greatest(y0, y1, 0), height) AS y1 FROM ({DRAWN}) WHERE abs(x1 - x0) * 1.5 >= 6 AND abs(y1 - y0) * 1.5 >= 6")
def drawn_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = _rows(spark, sf_dir, DRAWN).select("doc_id", "n", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width", "height")))
    return review.drawn_rectangles(drawn, 1.5).select("doc_id", "n", "x0", "y0", "x1", "y1")


CLAIMS = "SELECT k AS doc_id, CAST(s + k % 5 AS INT) AS s, CAST(e + k % 5 AS INT) AS e, stays FROM (SELECT o_orderkey AS k FROM orders) AS o JOIN (VALUES (0, 0, 9, true), (0, 3, 7, false), (0, 9, 12, true), (1, 0, 4, false), (1, 2, 9, true), (1, 8, 11, false), (2, 0, 4, true), (2, 2, 6, false), (2, 5, 9, true)) AS c(c, s, e, stays) ON k % 3 = c"


@query("claimed_literals", f"SELECT doc_id, s, e FROM ({CLAIMS}) WHERE stays")
def claimed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.claimed(_rows(spark, sf_dir, CLAIMS).selectExpr("doc_id", "s AS start", "e AS end"))
    return found.select("doc_id", F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"))


LITERALS = [*CPF_MADE, ("text", "'a ' || f || chr(10) || 'b ' || n || ' c ' || n || chr(10) || '123456789'")]


@query("loose_numbers", r.in_sql(LITERALS, "SELECT k AS doc_id, f AS raw, CAST(11 AS INT) AS n_digits, CAST(1 AS INT) AS first_line, CAST(1 AS BIGINT) AS n FROM made UNION ALL SELECT k, n, 11, 2, 2 FROM made"))
def loose_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = r.in_spark(spark, sf_dir, [(n, e.replace("chr(10)", "'\\n'")) for n, e in LITERALS]).select(F.col("k").alias("doc_id"), "text")
    return review.loose_numbers(made)


# Layout: glyph and word tables made from line items: an order is a page, its items are cells of words.

WORDS = f"""
    SELECT l_orderkey AS doc_id, 0 AS page, l_linenumber AS idx, CAST(floor(l_linenumber / 3) AS INT) AS block_num, 1 AS par_num, CAST(l_quantity AS INT) % 2 AS line_num, l_linenumber AS word_num,
        l_quantity AS left_, CAST(l_linenumber * 10 AS DOUBLE) AS top, 30.0 AS width, 8.0 AS height, CAST(l_partkey % 101 AS DOUBLE) - 1 AS conf, ' w' || CAST(l_suppkey AS VARCHAR(20)) || ' ' AS text
    FROM {ITEMS}"""


@query("ocr_text", f"""
    WITH w AS (SELECT *, trim(text) AS t, CAST(block_num AS VARCHAR) || '-' || CAST(line_num AS VARCHAR) AS key FROM ({WORDS}) WHERE conf >= 0),
    l AS (SELECT doc_id, key, min(idx) AS first, string_agg(t, ' ' ORDER BY word_num) AS line FROM w GROUP BY doc_id, key)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY first) AS text FROM l GROUP BY doc_id""")
def ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _rows(spark, sf_dir, WORDS).withColumnRenamed("left_", "left")
    return layout.page_texts(layout.pages_of_words(words)).select("doc_id", "text")


@query("ocr_low_confidence", f"""
    WITH w AS (SELECT *, trim(text) AS t, CAST(block_num AS VARCHAR) || '-' || CAST(line_num AS VARCHAR) AS key FROM ({WORDS}) WHERE conf >= 0),
    o AS (SELECT *, min(idx) OVER (PARTITION BY doc_id, key) AS first FROM w),
    p AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY first, word_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o)
    SELECT doc_id, idx, t AS text, conf, CAST(start AS INT) AS "start", CAST(start + length(t) AS INT) AS "end" FROM p WHERE conf < 60""")
def ocr_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _rows(spark, sf_dir, WORDS).withColumnRenamed("left_", "left")
    return layout.low_confidence(layout.pages_of_words(words)).select("doc_id", "idx", "text", F.col("confidence").alias("conf"), "start", "end")


GLYPHS = f"""
    SELECT l_orderkey AS doc_id, 0 AS page, l_linenumber AS line, CAST(o AS INT) AS ord, CASE o WHEN 0 THEN 'a' WHEN 1 THEN CAST(l_linenumber AS VARCHAR(2)) ELSE 'ffi' END AS c,
        100.0 * (8 - l_linenumber) + 10 * o AS x0, 20.0 * floor(l_linenumber / 2) AS y0, 100.0 * (8 - l_linenumber) + 10 * o + 9 AS x1, 20.0 * floor(l_linenumber / 2) + 10 AS y1,
        100.0 * (8 - l_linenumber) AS line_x0, 20.0 * floor(l_linenumber / 2) AS line_y0, 100.0 * (8 - l_linenumber) + 29 AS line_x1, 20.0 * floor(l_linenumber / 2) + 10 AS line_y1, 0 AS block_type
    FROM {ITEMS} CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2) AS three"""
LAYOUT_SQL = f"""
    WITH cells AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, floor(l_linenumber / 2) AS fila, 'a' || CAST(l_linenumber AS VARCHAR) || 'ffi' AS t FROM {ITEMS}),
    rows_ AS (SELECT doc_id, fila, string_agg(t, ' ' ORDER BY line DESC) AS t FROM cells GROUP BY doc_id, fila)
    SELECT doc_id, string_agg(t, chr(10) ORDER BY fila) AS text FROM rows_ GROUP BY doc_id"""


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, GLYPHS)


@query("layout_text", LAYOUT_SQL)
def layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_texts(layout.pages_of_glyphs(_glyphs(spark, sf_dir))).select("doc_id", "text")


@query("layout_rectangles", "SELECT l_orderkey AS doc_id, CAST(floor(l_linenumber / 2) AS BIGINT) AS fila, CAST(min(100.0 * (8 - l_linenumber)) AS DOUBLE) AS x0, CAST(max(100.0 * (8 - l_linenumber) + 29) AS DOUBLE) AS x1 FROM lineitem GROUP BY 1, 2")
def layout_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of each page as one span: one rectangle for each of its lines."""
    pages = layout.pages_of_glyphs(_glyphs(spark, sf_dir))
    whole = F.array(F.struct(F.lit(0).alias("span_id"), F.lit(0).alias("start"), F.size("chars").alias("end")))
    found = layout.rectangles_in_place(pages.withColumn("spans", whole))
    return found.select("doc_id", F.floor(F.col("y0") / 20).alias("fila"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))


@query("entity_rectangles", """
    WITH c AS (SELECT o_orderkey AS k, i FROM orders, range(14) AS r(i)), cpf AS (SELECT k, i, 10.0 * i AS x0, 10.0 * i + 9 AS x1 FROM c WHERE i NOT IN (3, 7, 11))
    SELECT k AS doc_id, 'CPF' AS type, CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS INT) AS n, x0, x1 FROM cpf WHERE i IN (0, 1, 2, 12, 13) AND k % 2 = 0
    UNION ALL SELECT k, 'CPF', 1, 0.0, 139.0 FROM cpf WHERE k % 2 = 1 GROUP BY k
    UNION ALL SELECT k, 'EMAIL', 1, 40.0, 99.0 FROM cpf GROUP BY k""")
def entity_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one line, 529.982.247-25: as a CPF its five digits to hide, or one box where OCR has read it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"))
    at = lambda plus: (F.col("idx") * 10 + plus).cast("double")
    glyphs = orders.select("*", F.posexplode(F.split(F.lit("529.982.247-25"), "")).alias("idx", "char")).withColumns({"x0": at(0), "x1": at(9), "y0": F.lit(0.0), "y1": F.lit(9.0)})
    kinds = F.array(F.struct(F.lit("CPF").alias("type"), F.lit(0).alias("start"), F.lit(14).alias("end")), F.struct(F.lit("EMAIL").alias("type"), F.lit(4).alias("start"), F.lit(10).alias("end")))
    entities = orders.select("*", F.posexplode(kinds).alias("span_id", "e")).select("doc_id", "page", "span_id", "e.*", (F.col("doc_id") % 2 == 1).alias("por_ocr"))
    found = layout.entity_rectangles(layout.pages_of_characters(glyphs), entities, ("span_id", "type"))
    return found.selectExpr("doc_id", "type", "row_number() OVER (PARTITION BY doc_id, type ORDER BY x0) AS n", "x0", "x1")


PAGES = "SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_partkey % 3 = 0 AND l_orderkey % 2 = 0 THEN 'x' WHEN l_partkey % 3 = 1 THEN '  ' END AS text FROM lineitem"


@query("source_routing", f"SELECT doc_id, page, NOT bool_or(coalesce(trim(text) <> '', false)) OVER (PARTITION BY doc_id) AS por_ocr FROM ({PAGES})")
def source_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.routed(_rows(spark, sf_dir, PAGES)).select("doc_id", "page", "por_ocr")


@query("pages_with_entities", f"SELECT p.doc_id, p.page, CAST(100 + p.page AS DOUBLE) AS largura, CAST(CASE WHEN p.page % 2 = 0 THEN 2 ELSE 0 END AS INT) AS n FROM (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem) p")
def pages_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page appears, also one without any entity. What is made of the pages stays in their tasks."""
    pages = r.dealt(_rows(spark, sf_dir, PAGES).select("doc_id", "page"), r.TASK_ROWS, "doc_id", "page").distinct()
    sizes = pages.select("doc_id", "page", (F.col("page") + 100).cast("double").alias("largura"), F.lit(1.0).alias("altura"))
    entities = pages.where("page % 2 = 0").select("*", F.explode(F.array(F.lit(1), F.lit(0))).alias("ord")).selectExpr("doc_id", "page", "ord", "'CPF' AS type", "ord AS start", "ord + 1 AS end", "0.9D AS confidence", "false AS requires_review")
    return review.pages_of(pages, sizes, entities).select("doc_id", "page", "largura", F.coalesce(F.size("entidades"), F.lit(0)).alias("n"))


@query("scaled_boxes", "SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_quantity * 0.24 AS x0, l_quantity * 0.5 AS y0 FROM lineitem")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _rows(spark, sf_dir, "SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_quantity AS x0, l_quantity AS y0, l_quantity AS x1, l_quantity AS y1 FROM lineitem")
    return layout.scaled(boxes, F.lit(0.24), F.lit(0.5)).select("doc_id", "idx", "x0", "y0")


# Jobs: the events of a user are those of a job.

JOB_SQL = """
    WITH e AS (SELECT md5(CAST(user_id AS VARCHAR)) AS id, ts, event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'created' WHEN 1 THEN 'started' WHEN 2 THEN 'extracted' WHEN 3 THEN 'done' ELSE 'failed' END AS event FROM events),
    l AS (SELECT id, ts, event, row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) AS n, min(ts) OVER (PARTITION BY id) AS first FROM e)
    SELECT id, CASE event WHEN 'created' THEN 'recebido' WHEN 'started' THEN 'processando' WHEN 'extracted' THEN 'processando' WHEN 'done' THEN 'pronto' ELSE 'erro' END AS status,
        CAST(CASE event WHEN 'extracted' THEN 0.5 WHEN 'done' THEN 1.0 WHEN 'failed' THEN NULL ELSE 0.0 END AS DOUBLE) AS progresso, first + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) AS vencido FROM l WHERE n = 1"""


def _named(events: DataFrame) -> DataFrame:
    kinds = F.array(*map(F.lit, ("created", "started", "extracted", "done", "failed")))
    return events.select(F.md5(F.col("user_id").cast("string")).alias("id"), "ts", F.col("event_id").alias("seq"), F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("event"))


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return jobs.states(_named(events)), F.lit(events.agg(F.max("ts")).first()[0])


@query("job_states", JOB_SQL)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, as_of = _jobs(spark, sf_dir)
    return states.select("id", "status", "progresso", (F.col("expira_em") <= as_of).alias("vencido"))


@query("job_stream", JOB_SQL)
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of all events: the last state each job was given, and whether its timer went off."""
    place = new_folder(spark, "job-stream")
    out = expiry.lives(_named(streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", "0 seconds"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    out.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("id string, status string, progresso double, expira_em timestamp, batch int").parquet(f"{place}/rows")
    over = F.col("status") == expiry.EXPIRED
    last = rows.groupBy("id").agg(F.max_by(F.when(~over, F.struct("status", "progresso")), F.when(~over, F.col("batch"))).alias("s"), F.max(over).alias("vencido"))
    return last.select("id", "s.status", "s.progresso", "vencido")


@query("job_purged", f"SELECT id, true AS removed, count(*) OVER () AS n FROM ({JOB_SQL}) WHERE vencido AND status = 'pronto'")
def job_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of finished jobs are stored; of the jobs whose time is over they are deleted."""
    place = new_folder(spark, "job-purge")
    states, as_of = _jobs(spark, sf_dir)
    jobs.write_results(states.where("status = 'pronto'").select("id", F.to_json(F.struct("id")).alias("resultado")), place)
    done = job_results.purge(job_results.listed(spark, place).join(jobs.expired(states, as_of).select("id"), "id", "left_semi"))
    left = job_results.listed(spark, place).join(done.where("removed"), "id", "left_semi").count()
    if left:
        raise RuntimeError(f"{left} results are still there after the purge")
    return done.select("id", "removed", F.lit(done.count()).cast("bigint").alias("n"))


@query("job_purge", f"SELECT id FROM ({JOB_SQL}) WHERE vencido")
def job_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.expired(*_jobs(spark, sf_dir)).select("id")


@query("job_served", f"SELECT id, status FROM ({JOB_SQL.replace('SELECT max(ts) FROM events', 'SELECT min(ts) + INTERVAL 6 HOUR FROM events')}) WHERE NOT vencido")
def job_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs still to be had six hours after the first event of all."""
    states, _ = _jobs(spark, sf_dir)
    first = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts")).first()[0]
    return jobs.alive(states, F.lit(first) + F.expr("INTERVAL 6 HOURS")).select("id", "status")


@query("job_queue", f"SELECT id FROM ({JOB_SQL}) WHERE status <> 'erro'")
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued work of jobs that are still there."""
    states, _ = _jobs(spark, sf_dir)
    queued = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.md5(F.col("user_id").cast("string")).alias("id")).distinct()
    return jobs.still_wanted(queued, states.where("status <> 'erro'"))


@query("job_results", f"""
    WITH p AS (SELECT md5(CAST(user_id AS VARCHAR)) AS id, CAST(event_id % 3 AS INT) AS numero FROM events GROUP BY ALL), j AS (SELECT id FROM ({JOB_SQL}) WHERE status = 'pronto')
    SELECT id, '{{"paginas":[' || string_agg('{{"numero":' || CAST(numero AS VARCHAR) || ',"largura":100.0,"altura":50.0,"entidades":' || CASE WHEN numero = 1 THEN '[{{"type":"CPF"}}]' ELSE '[]' END || '}}', ',' ORDER BY numero) || ']}}' AS resultado FROM p JOIN j USING (id) GROUP BY id""")
def stored_job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, _ = _jobs(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages = events.select(F.md5(F.col("user_id").cast("string")).alias("id"), (F.col("event_id") % 3).cast("int").alias("numero")).distinct()
    entities = F.when(F.col("numero") == 1, F.array(F.struct(F.lit("CPF").alias("type"))))
    found = jobs.results(pages.select("id", "numero", F.lit(100.0).alias("largura"), F.lit(50.0).alias("altura"), entities.alias("entidades")), states)
    # Stored in two runs, the second of which has a part of the jobs once more, and read again.
    place = new_folder(spark, "job-results")
    jobs.write_results(found.withColumn("resultado", F.when(F.col("id") < "8", F.col("resultado")).otherwise("{}")), place)
    jobs.write_results(found.where("id >= '8'"), place)
    return job_results.stored(spark, place).select("id", "resultado")
