"""Labels in front of a candidate: which type they speak for, and whether they rule it out."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..functions.spans import ALNUM, last_span
from ..functions.sql import chosen, let, lit, struct

LABEL_WINDOW = 40
ADDRESS_WINDOW = 120

#: The labels of each type.
POSITIVE = {
    "CPF": ["CPF", "C.P.F.", "CPF nº", "inscrito no CPF", "inscrita no CPF", "portador do CPF", "portadora do CPF", "CPF do titular"],
    "CPF_MASCARADO": ["CPF", "C.P.F.", "CPF mascarado"],
    "CNPJ": ["CNPJ", "C.N.P.J.", "CNPJ nº", "inscrito no CNPJ", "inscrita no CNPJ", "CNPJ da contratada"],
    "RG": ["RG", "R.G.", "RG nº", "Cédula de Identidade", "Identidade nº", "documento de identidade", "carteira de identidade", "registro geral"],
    "PIS": ["PIS", "PASEP", "PIS/PASEP", "NIT", "PIS/PASEP/NIT"],
    "CNH": ["CNH", "Registro CNH", "carteira de habilitação", "carteira nacional de habilitação", "habilitação"],
    "TITULO_ELEITOR": ["Título de Eleitor", "título eleitoral", "título eleitor", "inscrição eleitoral"],
    "CNS": ["CNS", "Cartão Nacional de Saúde", "cartão SUS", "cartão do SUS"],
    "PROCESSO_CNJ": ["processo", "processo judicial", "autos", "autos nº", "número único"],
    "CARTAO_CREDITO": ["cartão de crédito", "cartão de débito", "nº do cartão", "número do cartão"],
    "EMAIL": ["e-mail", "email", "endereço eletrônico", "correio eletrônico"],
    "TELEFONE": ["telefone", "tel.", "tel", "fone", "celular", "whatsapp", "contato"],
    "CEP": ["CEP"],
    "DATA_NASCIMENTO": ["data de nascimento", "nascido em", "nascida em", "nasc.", "nascimento"],
    "AGENCIA_CONTA": ["agência", "ag.", "conta", "conta corrente", "conta poupança", "c/c"],
    "CHAVE_PIX": ["chave PIX", "PIX"],
    "CID": ["CID", "CID-10", "CID 10", "diagnóstico"],
    "NOME": ["nome", "razão social", "favorecido", "favorecida"],
    "ENDERECO": ["endereço", "residente", "domiciliado", "domiciliada", "estabelecido", "estabelecida", "sede"],
}
#: Administrative labels; what follows them is no personal data.
NEGATIVE = [
    "código", "código interno", "código patrimonial", "código de rastreamento", "código de verificação", "código verificador",
    "número de série", "total de registros", "identificador", "identificador do lote", "chave de integração", "protocolo",
    "nota de empenho", "empenho", "processo", "lote", "item", "ficha", "ficha orçamentária", "dotação", "dotação orçamentária",
    "versão", "build",
]
#: Words of an address.
ADDRESS = [
    "rua", "avenida", "av.", "alameda", "travessa", "praça", "rodovia", "estrada", "largo",
    "sala", "bloco", "apartamento", "apto", "andar", "conjunto", "casa", "lote", "quadra",
    "bairro", "jardim", "parque", "vila", "distrito", "centro", "residencial",
    "endereço", "residente", "domiciliado", "domiciliada", "estabelecido", "estabelecida", "sede", "com sede",
]
#: Fixed value: a city and its state right before the candidate.
CITY_STATE = r"[A-ZÁ-Ú][a-zá-ú]+/[A-Z]{2}[\s\x1c-\x1f\x85\p{Z},.;:-]*\z"


def whole_words(labels: Iterable[str]) -> str:
    """Any of the labels between characters that are neither letters nor digits, in any case; of two that fit, the longer."""
    names = sorted(set(labels), key=lambda x: (-len(x), x))
    first = "".join(sorted({x[0].lower() for x in names}))
    # The first letter is looked at before anything else, as most places have another.
    return rf"(?iu)(?=[{first}])(?<!{ALNUM})(?:{'|'.join(re.sub(r'([^\w\s])', r'\\\1', x) for x in names)})(?!{ALNUM})"


#: One literal pattern for each type, one for what rules a candidate out, one that finds out whether there is any label.
OF_TYPE = {name: whole_words(labels) for name, labels in POSITIVE.items()}
ADMINISTRATIVE = whole_words(NEGATIVE)
ADDRESS_WORD = whole_words(ADDRESS)
ANY_LABEL = whole_words([x for labels in [*POSITIVE.values(), NEGATIVE] for x in labels])


def label_of(window: str, type_: str) -> str:
    """The last label of the row's own type, as written, or null."""
    return chosen((f"{type_} = '{name}'", f"{last_span(window, pattern)}.text") for name, pattern in OF_TYPE.items())


def nearest(window: str, types: Iterable[str], only: str | None = None) -> str:
    """struct<start, size, place, type>: the last label of any type; the longer one wins a tie, then the first type."""

    def found(place: int, name: str) -> str:
        own = let(last_span(window, OF_TYPE[name]), lambda s: f"if({s} IS NULL, null, {struct(start=f'{s}.start', size=f'length({s}.text)', place=str(-place), type=lit(name))})")
        return own if only is None else f"if(array_contains({only}, '{name}'), {own}, null)"

    return f"array_max(array({', '.join(found(place, name) for place, name in enumerate(types))}))"


def ruled_out(negative: str, positive: str) -> str:
    """Whether the nearest label is administrative: a label of a type at the same place or later cancels it."""
    return f"if({negative} IS NULL, false, {let(positive, lambda p: f'({p} IS NULL OR {p}.start < {negative}.start)')})"


def in_address(window: str) -> str:
    """Whether the text before the candidate reads like an address."""
    return f"({window} RLIKE {lit(CITY_STATE)} OR {window} RLIKE {lit(ADDRESS_WORD)})"
