"""Detection, disputes, offsets and redaction against the plain Python of ``plain``, and on made documents with marked values."""

import itertools
import os
import random
import re
import time
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

import plain
from lacre.functions import masking, normalize, spans
from lacre.model import ENTITY as ENTITY_TYPE
from lacre.operators import pipeline, redact, resolve, review, verify
from lacre.operators.resolve import resolved
from lacre.plans import recipes

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ENTITY = ("type", "start", "end", "confidence", "validated", "context", "requires_review", "text")


def found_in(spark, texts, ocr=False):
    rows = spark.createDataFrame([(i, t, ocr) for i, t in enumerate(texts)], "doc_id int, text string, por_ocr boolean").repartition(4)
    out = {i: [] for i in range(len(texts))}
    for r in sorted(pipeline.detect(rows, ocr="por_ocr").collect(), key=lambda r: (r.doc_id, r.ord)):
        out[r.doc_id].append(tuple(r[f] for f in ENTITY))
    return [out[i] for i in range(len(texts))]


def number(rng, make, size):
    """Random digits with a fitting end, by trying."""
    while True:
        head = "".join(rng.choice("0123456789") for _ in range(size - 3))
        for tail in range(1000):
            d = head + f"{tail:03d}"
            if make(d):
                return d


def masked(d, form):
    it = iter(d)
    return re.sub("#", lambda _: next(it), form)


def values(rng):
    c, j, p, h = (number(rng, f, n) for f, n in ((plain.cpf, 11), (plain.cnpj, 14), (plain.pis, 11), (plain.cnh, 11)))
    t, s, l = number(rng, plain.titulo, 12), number(rng, plain.cns, 15), number(rng, plain.luhn, 16)
    n = f"{rng.randrange(10**7):07d}", f"{rng.randrange(10**11):011d}"
    n = f"{n[0]}{98 - int(n[0] + n[1] + '00') % 97:02d}{n[1]}"
    return [
        masked(c, "###.###.###-##"), c, masked(c, "### ### ### ##"), masked(j, "##.###.###/####-##"), j, masked(p, "###.#####.##-#"), p, h, masked(t, "#### #### ####"), t, masked(s, "### #### #### ####"), s,
        masked(n, "#######-##.####.#.##.####"), n, masked(l, "#### #### #### ####"), l, "fulano.de-tal@mail.example.com", "a@b.co", "fulano&mail.example.com", "(15) 91234-5678", "+55 15 3232-1234", "11987654321",
        "18000-123", "18000123", "***.456.789-**", "XXX.456.789-XX", "42.815.739-6", "428157396", "1234-5", "0001", "F10.1", "A00", "01/02/1990", "1990-02-01", "01.02.1990", "123e4567-e89b-12d3-a456-426614174000", c[:10] + "9",
    ]


WORDS = [
    "CPF", "CPF nº", "CNPJ:", "RG", "RG:\n", "PIS/PASEP", "NIT", "CNH", "carteira de habilitação", "Título de Eleitor", "CNS", "cartão SUS", "processo", "autos nº", "cartão de crédito", "e-mail:", "tel.", "CEP", "Rua das Flores,", "Sorocaba/SP,",
    "agência", "conta corrente", "chave PIX", "PIX:", "CID", "nascido em", "código", "protocolo", "lote", "item", "ficha", "versão", "número de série", "inscrito no", "de", "e", "\n", "\n\n", " \n", "\r\n", ",", ";", "-", "/", ".", "ﬁcha", "½",
    "á", " ", "–", "１２３", "٣٤", "😀", "İ", "\x01", "ß", "Ⅷ", "가", "x" * 45, "  ",
]


def random_texts(seed, n):
    rng = random.Random(seed)
    pool = values(rng) + values(rng)
    for _ in range(n):
        parts = [rng.choice(WORDS) if rng.random() < 0.6 else rng.choice(pool) for _ in range(rng.randint(1, 14))]
        yield "".join(p + rng.choice(["", " ", " ", " ", ": ", "."]) for p in parts)


@pytest.mark.parametrize("ocr", [False, True])
def test_random_texts_are_as_in_plain_python(spark, ocr):
    texts = list(random_texts(7 + ocr, 1500)) + ["", " ", "529.982.247-25", "\n529.982.247-25", "RG:\r\n42.815.739-6", "x\n\n 529.982.247-25"]
    wanted = [plain.detect(t, ocr) for t in texts]
    for text, got, want in zip(texts, found_in(spark, texts, ocr), wanted):
        assert got == want, repr(text)
    kinds = {e[0] for w in wanted for e in w}
    assert kinds == set(plain.DOCUMENTS) | set(plain.OTHER)


def test_documents_are_as_in_plain_python(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    found = {}
    for r in sorted(pipeline.detect(rows).collect(), key=lambda r: r.ord):
        found.setdefault(r.doc_id, []).append(tuple(r[f] for f in ENTITY))
    wanted = {i: w for i, t in texts.items() if (w := plain.detect(t or ""))}
    assert found == wanted and len(wanted) > 3


GOLDEN = [
    "Contrato celebrado por Fulano de Tal, CPF nº [CPF:{cpf}], RG: [RG:42.815.739-6], residente na Rua das Flores, 10, CEP [CEP:18000-123].",
    "A empresa Exemplo Ltda, inscrita no CNPJ [CNPJ:{cnpj}], com sede em Sorocaba/SP, [CEP:18010-456], e-mail [EMAIL:contato@exemplo.com.br].",
    "NOME;CPF;LOTE\nFulano;[CPF:{cpf}];7\nBeltrano;[CPF:{cpf2}];8\n",
    "PIS/PASEP [PIS:{pis}]\nCNH [CNH:{cnh}]\nTítulo de Eleitor [TITULO_ELEITOR:{titulo}]\nCNS: [CNS:{cns}]",
    "Telefone: [TELEFONE:(15) 91234-5678] ou [TELEFONE:(15) 3232-1234], fax não há.",
    "Processo nº [PROCESSO_CNJ:{cnj}], da 1ª vara.",
    "CPF: [CPF_MASCARADO:***.456.789-**], conforme publicado.",
    "Favorecido: agência [AGENCIA_CONTA:1234-5], c/c [AGENCIA_CONTA:98765-0], chave PIX [CHAVE_PIX:123e4567-e89b-12d3-a456-426614174000].",
    "Nascido em [DATA_NASCIMENTO:01/02/1990], diagnóstico [CID:F10.1], pago em 03/04/2024.",
    "Cartão de crédito [CARTAO_CREDITO:{card}].",
]
CLEAN = [
    "Protocolo {cpf}, lote {cnpj}, código de rastreamento {pis}.", "Versão 10.2.3, build 20240101, item 12, ficha 345.", "Nota de empenho 2024/000123, dotação orçamentária 12.345.678, total de registros 98765432.",
    "Número de série: {card}", "Reunião em 03/04/2024, sala F10, prazo de 30 dias, valor de R$ 1.234,56.",
]


def golden(seed):
    rng = random.Random(seed)
    only = lambda f, n, *others: next(d for d in iter(lambda: number(rng, f, n), None) if not any(o(d) for o in others))
    c, c2 = (masked(only(plain.cpf, 11, plain.pis, plain.cnh), "###.###.###-##") for _ in range(2))
    head = f"{rng.randrange(10**7):07d}", f"{rng.randrange(10**11):011d}"
    n = f"{head[0]}{98 - int(head[0] + head[1] + '00') % 97:02d}{head[1]}"
    fill = {
        "cpf": c, "cpf2": c2, "cnpj": masked(number(rng, plain.cnpj, 14), "##.###.###/####-##"), "pis": masked(only(plain.pis, 11, plain.cpf, plain.cnh), "###.#####.##-#"), "cnh": only(plain.cnh, 11, plain.cpf, plain.pis),
        "titulo": masked(number(rng, plain.titulo, 12), "#### #### ####"), "cns": only(plain.cns, 15, plain.luhn), "cnj": masked(n, "#######-##.####.#.##.####"), "card": masked(number(rng, plain.luhn, 16), "#### #### #### ####"),
    }
    for marked in GOLDEN + CLEAN:
        text, rows = "", []
        for part in re.split(r"(\[\w+:[^\]]+\])", marked.format(**fill)):
            m = re.fullmatch(r"\[(\w+):([^\]]+)\]", part)
            if m:
                rows.append((m[1], len(text), len(text) + len(m[2]), m[2]))
            text += m[2] if m else part
        yield text, rows


def test_marked_documents_have_no_miss_and_no_false_find(spark):
    made = [x for seed in range(8) for x in golden(seed)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc int, text string")
    expected = spark.createDataFrame([(i, *row) for i, (_, rows) in enumerate(made) for row in rows], "doc int, type string, start int, end int, text string")
    outcome = review.compared(expected, pipeline.detect(docs, ("doc",)), ("doc", "type", "start", "end", "text"))
    counts = dict(outcome.groupBy("outcome").count().collect())
    assert set(counts) == {"VP"} and counts["VP"] >= 100, outcome.where("outcome <> 'VP'").collect()


def resolved_rows(spark, groups):
    schema = "g int, type string, start int, end int, confidence double, validated boolean, text string, detector string, context string, requires_review boolean, ord int"
    rows = [(g, t, a, b, c, v, "x", "d", None, False, i) for g, group in enumerate(groups) for i, (t, a, b, c, v) in enumerate(group)]
    out = {g: [] for g in range(len(groups))}
    for r in sorted(resolve.resolve(spark.createDataFrame(rows, schema), ("g",)).collect(), key=lambda r: r.ord):
        out[r.g].append((r.type, r.start, r.end, r.confidence, r.validated))
    return [out[g] for g in range(len(groups))]


def test_disputes_are_as_in_plain_python(spark):
    rng = random.Random(5)
    types = ("CPF", "CNPJ", "EMAIL", "RG", "CEP", "ENDERECO")
    groups = []
    for _ in range(600):
        group = {}
        for _ in range(rng.randint(0, 9)):
            a, t = rng.randrange(30), rng.choice(types)
            group[(t, a, a + rng.randint(1, 12))] = (rng.choice((0.5, 0.9, 0.99)), t in ("CPF", "CNPJ") and rng.random() < 0.8)
        groups.append([(*k, *v) for k, v in group.items()])
    assert resolved_rows(spark, groups) == [plain.settled(g) for g in groups]


def test_the_order_of_detections_does_not_matter(spark):
    group = [("CPF", 0, 11, 0.6, True), ("PIS", 0, 11, 0.6, True), ("TELEFONE", 5, 16, 0.9, False), ("CEP", 15, 23, 0.5, False), ("CNPJ", 20, 34, 0.95, True), ("RG", 21, 29, 0.99, False)]
    found = resolved_rows(spark, list(itertools.permutations(group)))
    assert all(f == found[0] for f in found) and len(found[0]) > 1


def test_texts_with_one_id_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "CPF 529.982.247-25"), (1, "CPF  529.982.247-25"), (None, "e-mail a@b.co"), (None, "tel. (15) 91234-5678"), (2, None), (3, "")], "doc_id int, text string")
    found = pipeline.detect(docs).collect()
    assert sorted((r.type, r.start, r.ord) for r in found) == [("CPF", 4, 0), ("CPF", 5, 0), ("EMAIL", 7, 0), ("TELEFONE", 5, 0)]
    assert pipeline.with_entities(docs).where("size(entities) = 0").count() == 2


def test_long_texts_end_in_time(spark):
    began = time.perf_counter()
    texts = ["529.982.247-25, " * 60_000, "CEP 18000-123\n" * 30_000, "x" * 1_000_000, "1 " * 500_000, "é " * 200_000 + "– CPF 529.982.247-25"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = redact.redact_in_place(pipeline.with_entities(docs)).select("doc_id", F.size("entities").alias("n"), F.length("redacted").alias("size"), F.substring("redacted", 1, 17).alias("first"), F.right("redacted", F.lit(14)).alias("last")).collect()
    found = {r.doc_id: r for r in rows}
    assert [found[i].n for i in range(5)] == [60_000, 30_000, 0, 0, 1] and all(found[i].size == len(t) for i, t in enumerate(texts))
    assert found[0].first == "███.982.247-██, █" and found[4].last == "███.982.247-██"
    assert time.perf_counter() - began < 240


def test_redaction_is_that_of_the_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = "".join(rng.choice("abc é😀\n") for _ in range(rng.randint(0, 60)))
        spans = [(a, min(len(text), a + rng.randint(0, 9))) for a in (rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))]
        rows.append((i, text, spans))
    schema = "doc_id int, text string, spans array<struct<start: int, end: int>>"
    from lacre.functions.spans import cut, replaced

    docs = spark.createDataFrame(rows, schema)
    for chunk in (8192, 7):
        out = docs.withColumn("r", F.expr(replaced("text", "spans", "█") if chunk == 8192 else f"array_join({cut('text', 'spans', lambda c, own: f'concat({c}, size({own}))', chunk)}, '')"))
        for r in out.collect():
            if chunk == 8192:
                hidden = {k for s in r.spans for k in range(s.start, s.end)}
                assert r.r == "".join("█" if k in hidden else c for k, c in enumerate(r.text))
            else:
                assert re.sub(r"\d", "", r.r) == r.text


def normal_forms(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    out = {r["i"]: (r["_n"], r["_map"]) for r in normalize.with_normal_form(rows, "t").collect()}
    return [(n, list(range(len(t or "") + 1)) if places is None else places) for t, (n, places) in ((t, out[i]) for i, t in enumerate(texts))]


def traceable(text):
    """Whether normalising by starters is normalising the whole."""
    ready = "".join("-" if c in "‐‑‒–—" else " " if unicodedata.category(c) == "Zs" else c for c in text)
    return plain.normal(text)[0] == unicodedata.normalize("NFKC", ready)


def test_normal_form_and_places(spark):
    rng = random.Random(3)
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    changed, marks = [c for c in every if unicodedata.normalize("NFKC", c) != c], [c for c in every if unicodedata.combining(c)]
    kinds = [every, changed, marks, list("abcé –\n"), list("\x01 9각ᅡ")]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + changed + marks
    texts = [t for t in [*texts, "ﬁm", "áb", "½ x", "각", "ẹ́x", "１２", "– ", "", "ǆ", "´"] if traceable(t)]
    assert len(texts) > 10_000
    for text, (n, places) in zip(texts, normal_forms(spark, texts)):
        assert (n, places) == plain.normal(text) and len(places) == len(n) + 1 and places == sorted(places)


def test_long_texts_are_normalised(spark):
    texts = ["½ ﬁ x\u0301 " * 30_000, "a" + "\u0301" * 30_000 + "ﬁ", None]
    found = normal_forms(spark, texts)
    assert found[:2] == [plain.normal(t) for t in texts[:2]] and found[2][0] is None


def test_a_text_without_traceable_offsets_is_an_error(spark):
    for text in ("\uff76\uff9e", "\u09c7\u09be"):
        assert not traceable(text)
        with pytest.raises(Exception, match="cannot be traced"):
            normal_forms(spark, [text])


def test_detection_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "CPF 529.982.247-25", False)], "doc_id int, text string, por_ocr boolean")
    plan = pipeline.detect(docs, ocr="por_ocr")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_masks_hide_the_outer_digits(spark):
    rows = spark.createDataFrame([("529.982.247-25",), ("52998224725",), (None,)], "v string")
    found = rows.select(masking.mask_cpf(F.col("v")), masking.hidden_places(F.col("v"))).collect()
    assert [r[0] for r in found] == ["***.982.247-**"] * 2 + [None] and found[0][1] == [0, 1, 2, 12, 13]
    with pytest.raises(Exception, match="11 digits"):
        spark.createDataFrame([("123",)], "v string").select(masking.mask_cpf(F.col("v"))).collect()


def test_a_detector_that_breaks_the_rules_is_an_error(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id int, text string")

    def beyond_end(end, confidence):
        return lambda n: F.array(F.struct(F.lit("X").alias("type"), F.lit(1).alias("start"), F.lit(end).alias("end"), F.lit(confidence).alias("confidence"), F.lit("d").alias("detector")))

    assert pipeline.detect(docs, types=(), extra=(beyond_end(3, 0.5),)).first().text == "bc"
    for end, confidence in ((4, 0.5), (1, 0.5), (3, 1.5), (3, None)):
        with pytest.raises(Exception, match="out of bounds"):
            pipeline.detect(docs, types=(), extra=(beyond_end(end, confidence),)).collect()


def test_only_the_types_asked_for(spark):
    docs = spark.createDataFrame([(1, "CPF 529.982.247-25, e-mail a@b.co, tel. (15) 91234-5678")], "doc_id int, text string")
    assert {r.type for r in pipeline.detect(docs, types=("EMAIL", "TELEFONE")).collect()} == {"EMAIL", "TELEFONE"}
    assert pipeline.detect(docs, types=()).count() == 0


def test_a_type_without_an_action_is_an_error(spark):
    docs = spark.createDataFrame([(1, "e-mail a@b.co")], "doc_id int, text string")
    with pytest.raises(Exception, match="no action for type EMAIL"):
        redact.redact_in_place(pipeline.with_entities(docs), policy={"CPF": "tarjar"}).collect()
    policy = spark.createDataFrame([("CPF", "tarjar")], "type string, acao string")
    with pytest.raises(Exception, match="no action for type EMAIL"):
        pipeline.with_action(pipeline.detect(docs), policy).collect()


def test_detection_by_sql(spark):
    """The function for SQL gives what the operator gives, on texts of every kind."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(WORDS) if rng.random() < 0.6 else rng.choice(values(rng)) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id int, text string").repartition(4)
    pipeline.register(spark)
    by_sql = spark.sql("SELECT doc_id, inline(found) FROM (SELECT doc_id, detect_entities(text) AS found FROM {docs})", docs=docs)
    own = pipeline.detect(docs).drop("ord")
    assert by_sql.columns == own.columns
    found = sorted(map(repr, by_sql.collect()))
    assert found == sorted(map(repr, own.collect())) and len(found) > 50


def test_known_texts_are_not_searched_again(spark):
    docs = spark.createDataFrame([(1, "e-mail a@b.co"), (2, "e-mail a@b.co"), (3, "CPF 529.982.247-25"), (4, None), (5, "")], "doc_id int, text string")
    nothing = spark.createDataFrame([], f"sha256 string, entities array<{ENTITY_TYPE}>")
    found, fresh = pipeline.with_known(docs, nothing)
    want = {r["doc_id"]: r["entities"] for r in pipeline.with_entities(docs).collect()}
    assert {r["doc_id"]: r["entities"] for r in found.collect()} == want and fresh.count() == 3
    again, more = pipeline.with_known(docs, fresh)
    assert more.count() == 0 and {r["doc_id"]: r["entities"] for r in again.collect()} == want
    # What is known is taken as it is: a text that changed is searched, the others are not.
    marked = fresh.withColumn("entities", F.slice("entities", 1, 0))
    changed = docs.where("doc_id <> 2").unionByName(spark.createDataFrame([(2, "tel. (15) 91234-5678")], docs.schema))
    found, more = pipeline.with_known(changed, marked)
    assert {r["doc_id"]: [e["type"] for e in r["entities"]] for r in found.collect()} == {1: [], 2: ["TELEFONE"], 3: [], 4: [], 5: []} and more.count() == 1


def test_tasks_stay_short_as_keys_grow(spark, monkeypatch):
    """The number of tasks follows the number of keys, not the number of cores alone."""
    monkeypatch.setattr(recipes, "TASK_KEYS", 100)
    made = recipes.in_spark(spark, "/root/testdata/sf0.001", [("text", "'x'")])
    assert made.rdd.getNumPartitions() == 15 and made.count() == 1500


def test_short_texts_are_covered_like_long_ones(spark, monkeypatch):
    """Spans in any order, overlapping, empty or with characters beyond the basic plane; no text is cut up for them."""
    rows = [("a😀xbcdf", [(4, 6), (0, 2), (1, 3)]), ("abc", []), ("abc", [(1, 1)]), ("abc", [(2, 5)]), ("áé", [(0, 2)]), (None, [(0, 1)])]
    table = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "id int, text string, spans array<struct<start: int, end: int>>")
    told = lambda: [r.x for r in table.select("id", F.expr(spans.replaced("text", "spans", "█")).alias("x")).orderBy("id").collect()]
    short = told()
    assert "overlay" in spans.replaced("text", "spans", "█")
    monkeypatch.setattr(spans, "SHORT", -1)
    assert short == told() == ["███b██f", "abc", "abc", "ab███", "██", None]
    assert short[0].count("█") == 5 and len(short[0]) == 7


def test_entities_without_overlap_are_not_walked(spark):
    """Sorting is native and what no other entity crosses is settled without a walk."""
    text = resolved("found")
    assert "array_sort(" not in text and "exists(sequence(1" in text



def test_blocks_of_a_redaction_need_no_map(spark):
    """Redacted texts are their own normal form; cutting them into starters took longer than searching them."""
    texts = ["CPF ███.456.789-██, e-mail ██████; fim", "─╿▀▟", "ª ███", "ﬁ ███"]
    found = normalize.with_normal_form(spark.createDataFrame([(t,) for t in texts], "text string"), "text").select("text", "_n", F.col("_map").isNull().alias("plain")).collect()
    assert [r["_n"] for r in found] == [unicodedata.normalize("NFKC", r["text"]) for r in found]
    assert {r["text"]: r["plain"] for r in found} == dict(zip(texts, [True, True, True, False]))


def test_leaks_on_the_row_are_those_of_a_search_of_every_text(spark):
    """Texts without the letters and digits of what had to go are not searched: no leak may be lost by that."""
    values = ["CPF 529.982.247-25", "e-mail Ana.Maria@Mail.com", "CPF 111.444.777-35 e chave PIX: ana@mail.com", "CNPJ 11.222.333/0001-81", "nada", "CPF ***.982.247-**"]
    after = [*values, "CPF 52998224725", "CPF: 529 982 247 25", "CPF ███.982.247-██", "veja ana.maria@mail.com.", "veja aana.maria@mail.com", "E-MAIL ANA.MARIA@MAIL.COM", "pix 11144477735, PIX: ANA@mail.com", "CPF ５２９．９８２．２４７－２５", "", None]
    rows = [(i * 100 + j, a, b) for i, a in enumerate(values) for j, b in enumerate(after)]
    made = pipeline.with_entities(spark.createDataFrame(rows, "doc_id bigint, text string, after string")).localCheckpoint()
    found = {r["doc_id"]: r["n"] for r in verify.leaks_in_place(made.select("doc_id", "entities", F.col("after").alias("text"))).select("doc_id", F.size("vazamentos").alias("n")).collect()}
    pages = made.select("doc_id", F.lit(0).alias("page"), F.col("after").alias("text"))
    told = Counter(r["doc_id"] for r in verify.text_leaks(pages, pipeline.with_action(pipeline.rows_of(made, ("doc_id",)))).collect())
    assert {k: n for k, n in found.items() if n} == dict(told) and len(found) == len(rows) and sum(told.values()) == 10
