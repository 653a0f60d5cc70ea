"""Entity types, their legal category and method, the redaction policy and the row types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Type, legal category, detection method, action of the standard policy.
TYPES = (
    ("CPF", "pessoal", "validado_dv", "tarjar"),
    ("CPF_MASCARADO", "pessoal", "padrao", "tarjar"),
    ("CNPJ", "pessoa_juridica", "validado_dv", "publicar"),
    ("RG", "pessoal", "contextual", "tarjar"),
    ("PIS", "pessoal", "validado_dv", "tarjar"),
    ("CNH", "pessoal", "validado_dv", "tarjar"),
    ("TITULO_ELEITOR", "pessoal", "validado_dv", "tarjar"),
    ("CNS", "pessoal", "validado_dv", "tarjar"),
    ("PROCESSO_CNJ", "publico_obrigatorio", "validado_dv", "publicar"),
    ("CARTAO_CREDITO", "pessoal", "validado_dv", "tarjar"),
    ("EMAIL", "pessoal", "padrao", "tarjar"),
    ("TELEFONE", "pessoal", "padrao", "tarjar"),
    ("CEP", "pessoal", "padrao", "tarjar"),
    ("DATA_NASCIMENTO", "pessoal", "contextual", "tarjar"),
    ("AGENCIA_CONTA", "pessoal", "contextual", "tarjar"),
    ("CHAVE_PIX", "pessoal", "contextual", "tarjar"),
    ("CID", "sensivel", "contextual", "tarjar"),
    ("NOME", "publico_obrigatorio", "ner", "publicar"),
    ("ENDERECO", "pessoal", "ner", "tarjar"),
)
METHODS = {name: method for name, _, method, _ in TYPES}
ENTITY = "struct<type: string, start: int, end: int, text: string, confidence: double, detector: string, validated: boolean, context: string, requires_review: boolean>"
ENTITY_FIELDS = ("type", "start", "end", "text", "confidence", "detector", "validated", "context", "requires_review")


def types_table(spark: SparkSession) -> DataFrame:
    """The 19 types: type, categoria, metodo, acao."""
    return spark.createDataFrame(TYPES, "type string, categoria string, metodo string, acao string")
