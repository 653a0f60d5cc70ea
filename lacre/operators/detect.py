"""Detection of personal data: 17 detectors, and one more for text from OCR.

A text is searched where it is: each written form is a literal pattern over the normalised text,
behind a cheap gate. What matches becomes an array of candidates, each with its place and what stands
before it; check digits come first, then labels, and what remains is an array of entities on the
text's own row. There is no shuffle, no filter that would have the search written out twice, and no
pattern that depends on the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checkdigits as dv
from ..functions.normalize import normal_form, original_end, original_start, with_normal_form
from ..functions.spans import ALNUM, NUM, SPACES, WORDS, clean, find_spans, last_span, search_window, searched, tail
from ..functions.sql import chosen, let, lit, looked_up, mapped, name, quoted, struct
from ..model import ENTITY, ENTITY_FIELDS, METHODS
from ..session import ship
from .anchors import ADDRESS_WINDOW, ADMINISTRATIVE, ANY_LABEL, LABEL_WINDOW, OF_TYPE, POSITIVE, in_address, label_of, nearest, ruled_out

#: Confidence with a label, in canonical form, in another form, and where several types fit.
LABELLED, CANONICAL, IRREGULAR, AMBIGUOUS = 0.99, 0.95, 0.85, 0.6
PLAIN, WEAK, BORROWED = 0.9, 0.5, 0.7

#: A candidate touches no letter or digit, nor one beyond a single ``. - /``.
BEFORE = rf"(?<!{ALNUM})(?<!{ALNUM}[.\-/])"
AFTER = rf"(?!{ALNUM})(?![.\-/]{ALNUM})"


def run_of(n: int) -> str:
    """``n`` digits with at most one separator between two of them."""
    return rf"(?={NUM}){BEFORE}{NUM}(?:[.\-/ ]?{NUM}){{{n - 1},{n - 1}}}{AFTER}"


#: The written forms.
CARD = rf"(?:{NUM}{{13,19}}|{NUM}{{4}}([ -]){NUM}{{4}}\1{NUM}{{4}}\1{NUM}{{4}}|{NUM}{{4}}([ -]){NUM}{{6}}\2{NUM}{{5}})"
HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
PHONE = rf"(?:\+[{SPACES}]?55[{SPACES}.-]?)?(?:\(({NUM}{{2}})\)|({NUM}{{2}}))[{SPACES}.-]?({NUM}{{4,5}})[{SPACES}.-]?({NUM}{{4}})"
GROUP3, GROUP2 = rf"(?:{NUM}{{3}}|\*{{3}}|[Xx]{{3}})", rf"(?:{NUM}{{2}}|\*{{2}}|[Xx]{{2}})"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LOOSE_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
LOOSE_CPF = rf"{NUM}{{3}}\.{NUM}{{3}}\.{NUM}{{3}}-{NUM}{{2}}|{NUM}{{11}}"
LOOSE_PHONE = rf"\+?[{SPACES}]?(?:55[{SPACES}.-]?)?(?:\({NUM}{{2}}\)|{NUM}{{2}})[{SPACES}.-]?{NUM}{{4,5}}[{SPACES}.-]?{NUM}{{4}}"


def at_least(n: int) -> str:
    return rf"{NUM}(?:[.\-/ ]?{NUM}){{{n - 1}}}"


def email(sign: str) -> str:
    return rf"(?=[A-Za-z0-9._%+-])(?<![{WORDS}.+-])[A-Za-z0-9._%+-]+{sign}{HOST}(?:\.{HOST})+(?![{WORDS}-])"


#: name of the form: (pattern, what a text must have to be searched for it, types that a literal of it may be).
FORMS = {
    "run11": (run_of(11), (at_least(11),), ("CPF", "PIS", "CNH")),
    "run12": (run_of(12), (at_least(12),), ("TITULO_ELEITOR",)),
    "run14": (run_of(14), (at_least(14),), ("CNPJ",)),
    "run15": (run_of(15), (at_least(15),), ("CNS",)),
    "run20": (run_of(20), (at_least(20),), ("PROCESSO_CNJ",)),
    "card": (f"(?={NUM}){BEFORE}{CARD}{AFTER}", (at_least(13),), ("CARTAO_CREDITO",)),
    "email": (email("@"), ("@",), ("EMAIL",)),
    "phone": (rf"(?=[+({NUM}])(?<!{ALNUM}){PHONE}{AFTER}", (rf"{NUM}{{2}}\)?[{SPACES}.-]?{NUM}{{4}}",), ("TELEFONE",)),
    "cep": (rf"(?={NUM}){BEFORE}{NUM}{{5}}-?{NUM}{{3}}{AFTER}", (rf"{NUM}{{5}}-?{NUM}{{3}}",), ("CEP",)),
    "masked": (rf"(?=[{NUM}*Xx]){BEFORE}{GROUP3}\.{GROUP3}\.{GROUP3}-{GROUP2}{AFTER}", (r"[*Xx]{2}",), ("CPF_MASCARADO",)),
    "rg": (rf"(?={NUM}){BEFORE}(?:{NUM}{{1,2}}\.{NUM}{{3}}\.{NUM}{{3}}-?[0-9Xx]|{NUM}{{7,9}}[Xx]?){AFTER}", (rf"{NUM}{{3}}",), ("RG",)),
    "account": (rf"(?={NUM}){BEFORE}{NUM}{{3,12}}(?:-[0-9Xx])?{AFTER}", (rf"{NUM}{{3}}",), ("AGENCIA_CONTA",)),
    "pix": (rf"(?<![{WORDS}.+-])(?:{UUID}|{LOOSE_EMAIL}|{LOOSE_CPF}|{LOOSE_PHONE})", ("@", rf"{NUM}{{3}}", "-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"), ("CHAVE_PIX",)),
    "cid": (rf"(?<!{ALNUM})[A-Z]{NUM}{{2}}(?:\.{NUM})?(?!{ALNUM})", (rf"[A-Z]{NUM}{{2}}",), ("CID",)),
    "date": (rf"(?={NUM}){BEFORE}(?:{NUM}{{2}}/{NUM}{{2}}/{NUM}{{4}}|{NUM}{{2}}\.{NUM}{{2}}\.{NUM}{{4}}|{NUM}{{4}}-{NUM}{{2}}-{NUM}{{2}}){AFTER}", (rf"{NUM}{{2}}[/.-]{NUM}{{2}}",), ("DATA_NASCIMENTO",)),
}
#: Forms without any two digits that at most a separator parts; all others need such.
WITHOUT_DIGITS = ("email", "masked", "pix")
#: Forms of a number of digits in a row, at the least.
RUNS = {"run11": 11, "run12": 12, "card": 13, "run14": 14, "run15": 15, "run20": 20}
DETECTORS = {
    "CPF": "cpf_dv", "CNPJ": "cnpj_dv", "PIS": "pis_dv", "CNH": "cnh_dv", "TITULO_ELEITOR": "titulo_eleitor_dv", "CNS": "cns_dv", "PROCESSO_CNJ": "processo_cnj_dv",
    "CARTAO_CREDITO": "cartao_credito_luhn", "EMAIL": "email_padrao", "TELEFONE": "telefone_padrao", "CEP": "cep_padrao", "CPF_MASCARADO": "cpf_mascarado_padrao", "RG": "rg_contextual",
    "AGENCIA_CONTA": "agencia_conta_contextual", "CHAVE_PIX": "chave_pix_contextual", "CID": "cid_contextual", "DATA_NASCIMENTO": "data_nascimento_contextual",
}
OCR_FORM, OCR_CONTEXT = "email_ocr", "email_ocr_ambiguo"
#: Types that are found only behind a label of their own; a text without any is not searched for them.
CONTEXTUAL = ("RG", "AGENCIA_CONTA", "CHAVE_PIX", "CID", "DATA_NASCIMENTO")
DOCUMENT = ("CPF", "CNPJ", "PIS", "CNH", "TITULO_ELEITOR", "CNS", "PROCESSO_CNJ", "CARTAO_CREDITO")
FRAGILE_IN_OCR = ("RG",)
#: Takes the normalised text and gives array<struct<type, start, end, confidence, detector>> with offsets of it.
Detector = Callable[[Column], Column]

#: The canonical forms.
CANON = {
    "CPF": rf"{NUM}{{3}}\.{NUM}{{3}}\.{NUM}{{3}}-{NUM}{{2}}|{NUM}{{11}}",
    "CNPJ": rf"{NUM}{{2}}\.{NUM}{{3}}\.{NUM}{{3}}/{NUM}{{4}}-{NUM}{{2}}|{NUM}{{14}}",
    "PIS": rf"{NUM}{{3}}\.{NUM}{{5}}\.{NUM}{{2}}-{NUM}|{NUM}{{11}}",
    "CNH": rf"{NUM}{{11}}",
    "TITULO_ELEITOR": rf"{NUM}{{4}} {NUM}{{4}} {NUM}{{4}}|{NUM}{{12}}",
    "CNS": rf"{NUM}{{3}} {NUM}{{4}} {NUM}{{4}} {NUM}{{4}}|{NUM}{{15}}",
    "PROCESSO_CNJ": rf"{NUM}{{7}}-{NUM}{{2}}\.{NUM}{{4}}\.{NUM}\.{NUM}{{2}}\.{NUM}{{4}}|{NUM}{{20}}",
    "CARTAO_CREDITO": rf"{NUM}{{4}} {NUM}{{4}} {NUM}{{4}} {NUM}{{4}}|{NUM}{{13,19}}",
}
#: Digits of a literal: the types it may be of, and their rules.
RULES = {
    11: {"CPF": dv.cpf, "PIS": dv.pis, "CNH": dv.cnh}, 12: {"TITULO_ELEITOR": dv.titulo_eleitor}, 14: {"CNPJ": dv.cnpj}, 15: {"CNS": dv.cns}, 20: {"PROCESSO_CNJ": dv.processo_cnj},
}


def _valid_types(raw: str) -> str:
    """The document types whose form a literal of one of the runs or the card's has and whose check digits hold."""

    def fitting(d: str) -> str:
        card = f"if(length({d}) BETWEEN 13 AND 19 AND luhn_check({d}) AND {raw} RLIKE {lit(rf'^{CARD}\z')}, 'CARTAO_CREDITO', null)"
        of_size = {n: [f"if({rule(d)}, '{t}', null)" for t, rule in rules.items()] + ([card] if 13 <= n <= 19 else []) for n, rules in RULES.items()}
        cases = chosen(((f"length({d}) = {n}", f"array({', '.join(options)})") for n, options in of_size.items()), f"array({card})")
        return rf"if({d} RLIKE r'^[0-9]+\z', array_compact({cases}), cast(array() AS array<string>))"

    return let(f"translate({raw}, '.-/ ', '')", fitting)


def _plausible_phone(raw: str) -> str:
    """Area code and subscriber's number follow from the digits: a country code comes with a plus sign only."""
    return let(f"substr(regexp_replace({raw}, {lit(r'\P{Nd}')}, ''), if(startswith({raw}, '+'), 3, 1))", lambda d: dv.is_phone(f"left({d}, 2)", f"substr({d}, 3)"))


def _searched(n: str, wanted: set[str], ocr: str | None) -> tuple[dict[str, tuple[str, str]], dict[str, list[str]]]:
    """The forms to look for, with their patterns and conditions, and the types that each may be of."""
    forms, types_of = {}, {}
    for form, (pattern, gates, types) in FORMS.items():
        own = [t for t in types if t in wanted]
        condition = f"_digits >= {RUNS[form]}" if form in RUNS else "(" + " OR ".join(f"contains({n}, '{g}')" if len(g) == 1 else f"{n} RLIKE {lit(g)}" for g in gates) + ")"
        if form not in WITHOUT_DIGITS and form not in RUNS:
            condition = f"_digits >= 2 AND {condition}"
        if types[0] in CONTEXTUAL:
            condition += f" AND {n} RLIKE {lit(OF_TYPE[types[0]])}"
        if own:
            forms[form], types_of[form] = (pattern, condition), own
    if ocr and "EMAIL" in wanted:
        forms[OCR_FORM], types_of[OCR_FORM] = (email("&"), f"`{ocr}` AND contains({n}, '&')"), ["EMAIL"]
    return forms, types_of


def _digits(n: str) -> str:
    """How many digits in a row a text has: the largest of 2 and the sizes of ``RUNS`` that it reaches, or 0. The first that fails ends the search."""
    sizes = [2, *sorted(set(RUNS.values()))]
    return chosen([(f"{n} IS NULL", "0"), *((f"NOT {n} RLIKE {lit(at_least(size))}", str(below)) for below, size in zip([0, *sizes], sizes))], str(sizes[-1]))


def _candidates(parts: str, types_of: dict[str, list[str]]) -> str:
    """array<struct<start, text, before, type, ocr, valid>>: the matches that their types' own rules accept."""
    documents = [form for form in types_of if types_of[form][0] in DOCUMENT] or ["none"]

    def accepted(m: str) -> str:
        raw, form = f"{m}.text", f"{m}.form"
        types = chosen((f"{form} = '{f}'", f"array({quoted(types_of[f])})") for f in types_of)
        of_form = f"CASE WHEN {form} = 'phone' AND NOT {_plausible_phone(raw)} THEN null WHEN {form} = 'masked' AND NOT {raw} RLIKE '[*Xx]' THEN null ELSE {types} END"

        def typed(v: str) -> str:
            own = f"if({v} IS NULL, {of_form}, array_intersect({types}, {v}))"
            return mapped(own, lambda t: struct(start=f"{m}.start", text=raw, before=f"{m}.before", type=t, ocr=f"{form} = '{OCR_FORM}'", valid=v))

        return let(f"if({form} IN ({quoted(documents)}), {_valid_types(raw)}, null)", typed)

    return f"flatten(array_compact({mapped(find_spans(parts), accepted)}))"


def _judged(c: str) -> str:
    """The entity that a candidate is by its labels, with offsets of the normalised text, or null."""
    kind, raw, valid = f"{c}.type", f"{c}.text", f"{c}.valid"
    several = f"coalesce(size({valid}) > 1, false)"
    rescued, contextual, document = f"{c}.ocr", f"{kind} IN ({quoted(CONTEXTUAL)})", f"{kind} IN ({quoted(DOCUMENT)})"
    borrowed = lit(rf"^(?:{LOOSE_EMAIL}|{LOOSE_CPF}|{LOOSE_PHONE})\z")
    canonical = chosen((f"{kind} = '{t}'", f"{raw} RLIKE {lit(rf'^(?:{form})' + chr(92) + 'z')}") for t, form in CANON.items())

    def labels(w: str) -> str:
        return struct(
            own=f"if({rescued}, null, {label_of(w, kind)})", neg=last_span(w, ADMINISTRATIVE),
            chosen=f"if({several} AND {w} RLIKE {lit(ANY_LABEL)}, {nearest(w, DOCUMENT, valid)}, null)", w=w,
        )

    def entity(window: str, x: str) -> str:
        def judged(out: str) -> str:
            stays = f"if({contextual}, {x}.own IS NOT NULL AND NOT {out}, {x}.own IS NOT NULL OR NOT {out}) AND (NOT {several} OR {x}.chosen IS NULL OR {x}.chosen.type = {kind})"
            unsure = f"{kind} = 'CEP' AND {x}.own IS NULL AND NOT {in_address(window)}"
            confidence = chosen(
                [
                    (rescued, WEAK), (several, f"if({x}.chosen IS NULL, {AMBIGUOUS}, {LABELLED})"), (f"{kind} = 'CHAVE_PIX' AND {raw} RLIKE {borrowed}", BORROWED),
                    (f"{x}.own IS NOT NULL", LABELLED), (document, f"if({canonical}, {CANONICAL}, {IRREGULAR})"), (unsure, WEAK),
                ],
                PLAIN,
            )
            found = struct(
                type=kind, start=f"{c}.start", end=f"{c}.start + length({raw})", text=raw, confidence=f"cast({confidence} AS double)", detector=f"if({rescued}, '{OCR_CONTEXT}', {looked_up(kind, DETECTORS)})", validated=document,
                context=f"if({rescued}, '{OCR_CONTEXT}', {x}.own)", requires_review=f"({rescued} OR {kind} = 'CPF_MASCARADO' OR ({unsure}))",
            )
            return f"if({stays}, {found}, null)"

        return let(ruled_out(f"{x}.neg", nearest(f"{x}.w", POSITIVE)), judged)

    return let(search_window(f"{c}.before", ADDRESS_WINDOW), lambda w: let(labels_of(w, labels), lambda x: entity(w, x)))


def labels_of(window: str, then) -> str:
    return let(tail(window, LABEL_WINDOW), then)


def bounded(entity: Column, size: Column) -> Column:
    """``entity`` if it keeps the rules of one: 0 <= start < end <= size, confidence from 0 to 1. Else an error."""
    sound = (entity["start"] >= 0) & (entity["start"] < entity["end"]) & (entity["end"] <= size) & entity["confidence"].between(0, 1)
    text = F.concat(F.lit("detector "), F.coalesce(entity["detector"], F.lit("null")), F.lit(": span or confidence out of bounds, end "), F.coalesce(entity["end"].cast("string"), F.lit("null")))
    return F.when(F.coalesce(sound, F.lit(False)), entity).otherwise(F.raise_error(text))


def _foreign(detector: Detector, n: Column) -> Column:
    """What a detector of the user's finds, held to the rules; its literal is cut from the normalised text."""

    def entity(e: Column) -> Column:
        return F.struct(
            e["type"].alias("type"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), F.substring(n, e["start"] + 1, e["end"] - e["start"]).alias("text"),
            e["confidence"].cast("double").alias("confidence"), e["detector"].alias("detector"), F.lit(False).alias("validated"), F.lit(None).cast("string").alias("context"), F.lit(False).alias("requires_review"),
        )

    return F.transform(detector(n), lambda e: entity(bounded(e, F.length(n))))


def _anchored(e: str, i: str, text: str, offsets: str) -> str:
    """The entity with its place and literal in the text as given; ``_c`` is the clean normal form."""

    def placed(at: str) -> str:
        # A text that is its own normal form has its literals at hand already.
        literal = f"if({text} <=> _c, {e}.text, substring({text}, {at}.start + 1, {at}.end - {at}.start))"
        method = looked_up(f"{e}.type", METHODS)
        return struct(type=f"{e}.type", start=f"{at}.start", end=f"{at}.end", text=literal, **{f: f"{e}.{f}" for f in ("confidence", "detector", "validated", "context", "requires_review")}, n_start=f"{e}.start", ord=i, method=method)

    return let(struct(start=original_start(f"{e}.start", offsets), end=original_end(f"{e}.start", f"{e}.end", offsets)), placed)


def detection(text: str, types: Iterable[str] | None = None) -> str:
    """SQL of what ``with_candidates`` finds in one text, for places where only an expression can stand."""
    wanted = set(DETECTORS) if types is None else set(DETECTORS) & set(types)
    forms, types_of = _searched("_c", wanted, None)
    e, i = name("e"), name("i")
    if not forms:
        return f"cast(array() AS array<{ENTITY}>)"
    placed = f"transform(_j, ({e}, {i}) -> {_anchored(e, i, text, '_nf.map')})"
    judged = f"array_compact({mapped(_candidates('_parts', types_of), _judged)})"
    steps = (("_nf", normal_form(text)), ("_c", clean("_nf.text")), ("_digits", _digits("_c")), ("_parts", searched("_c", forms)), ("_j", judged))
    body = placed
    for variable, value in reversed(steps):
        body = f"transform(array({value}), {variable} -> {body})[0]"
    return body


def with_candidates(texts: DataFrame, text: str = "text", ocr: str | None = None, types: Iterable[str] | None = None, extra: Iterable[Detector] = ()) -> DataFrame:
    """``texts`` with ``_found``: every detection, before disputes are settled, as an array of entities with ``ord`` and ``method``.

    ``types`` names the types to look for, all by default: only their detectors run. ``extra`` are
    further detectors of the user's. ``ocr`` names a boolean column that says a text was read by OCR;
    the detector that rescues e-mail addresses with a misread sign runs on those rows only. A null
    text has no detections.
    """
    ship(texts.sparkSession)
    wanted = set(DETECTORS) if types is None else set(DETECTORS) & set(types)
    rows = with_normal_form(texts, text)
    rows = rows.withColumns({"_c": F.expr(clean("_n")), "_digits": F.expr(_digits("_n"))})
    forms, types_of = _searched("_c", wanted, ocr)
    # Twice a reference keeps this a step of its own: the search is compiled code, what follows is not.
    rows = rows.withColumn("_parts", F.expr(searched("_c", forms)) if forms else F.array())
    entities = f"if(size(_parts) = 0, null, array_compact({mapped(_candidates('_parts', types_of), _judged)}))" if forms else "null"
    judged = F.coalesce(F.expr(entities), F.array().cast(f"array<{ENTITY}>"))
    judged = F.concat(judged, *(_foreign(d, F.col("_n")) for d in extra))

    e, i = name("e"), name("i")
    rows = rows.withColumn("_j", judged)
    return rows.withColumn("_found", F.expr(f"transform(_j, ({e}, {i}) -> {_anchored(e, i, f'`{text}`', '_map')})")).drop("_n", "_map", "_c", "_digits", "_parts", "_j")


def detect_candidates(texts: DataFrame, keys: tuple[str, ...], text: str = "text", ocr: str | None = None, types: Iterable[str] | None = None, extra: Iterable[Detector] = ()) -> DataFrame:
    """Every detection as a row of its own: ``keys``, n_start (in the normalised text), the entity's fields and ``ord``, its place among them."""
    rows = with_candidates(texts.select(*dict.fromkeys([*keys, text, *([ocr] if ocr else [])])), text, ocr, types, extra)
    # explode_outer, as explode would have the search written out once more for a filter on its size.
    return rows.select(*keys, F.explode_outer("_found").alias("_e")).where("_e IS NOT NULL").select(*keys, *(F.col(f"_e.{f}") for f in ("n_start", *ENTITY_FIELDS, "ord")))
