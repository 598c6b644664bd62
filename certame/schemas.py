"""Schemas of the domain's tables, their keys, and how tables gain columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Schemas are kept as DDL text, which readers take as it is; fields() parses it where a session runs.
QUESTIONS = (
    "id bigint, numero int, ano int, dia string, area string, competencia string, enunciado array<string>, comando string, alternativas map<string,string>, gabarito string, "
    "confianca double, revisado boolean, anulada boolean, tem_imagem boolean, pagina_pdf int, imagens array<struct<path:string,posicao:string,supabase_url:string>>, "
    "imagens_alternativas map<string,string>, fonte string, tipo string, evento string, turno string, provedor string"
)
USER_ANSWERS = "usuario_id string, questao_id bigint, simulado_id bigint, ano int, dia string, numero int, area string, resposta_usuario string, gabarito string, acertou boolean, respondido_em timestamp, versao_tt int, zerada boolean"
MOCK_ANSWERS = "simulado_id bigint, questao_id bigint, resposta string, correta boolean"
MOCKS = "id bigint, usuario_id string, tipo string, filtros string, questoes_ids array<bigint>, total_questoes int, acertos int, status string, iniciado_em timestamp, concluido_em timestamp"
RETRIES = "id string, usuario_id string, versao int, questoes_ids string, total int, acertos int, status string, criado_em timestamp, concluido_em timestamp"
QUOTES = "id bigint, titulo string, texto string, categoria string, criado_em timestamp"
REPORTS = "questao_id bigint, ano int, dia string, numero int, tipo_erro string, descricao string, status string"
KEY_ENTRIES = "numero int, letra string"
SHEET_RESULT = "sucesso boolean, respostas array<string>, total_questoes int, n_marcadas int, n_ambiguas int, confiancas array<double>, conf_media double, erro string"
CHANGES = "seq bigint, kind string, key string, payload string"

#: Natural key of a question. It is compared null-safely: mock exams have no year.
QUESTION_KEY = ("fonte", "tipo", "ano", "dia", "turno", "evento", "provedor", "numero")
#: Columns that local files carry and the table does not.
LOCAL_ONLY = ("ocr",)


def fields(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def same_key(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> Column:
    """Null-safe equality of all key columns."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in key])


def dimension(spark: SparkSession, labels: dict[str, str], code: str, label: str) -> DataFrame:
    """A fixed label table, small enough to go to every task."""
    return F.broadcast(spark.createDataFrame(list(labels.items()), f"{code} string, {label} string"))


def evolve(df: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Df with exactly the columns of schema; a missing one, and nulls of one with a default, take the default."""
    defaults = defaults or {}

    def column(f: T.StructField) -> Column:
        own = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(own, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else own).alias(f.name)

    return df.select(*map(column, fields(schema)))


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fails, when a row is read, on one that does not meet the condition."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def missing_columns(df: DataFrame, schema: str) -> list[str]:
    """Columns of schema that df lacks: the check before a load."""
    return [f.name for f in fields(schema) if f.name not in df.columns]


def mock_checks(df: DataFrame) -> DataFrame:
    """States of a retry."""
    return checked(df, F.col("status").isin("pendente", "em_andamento", "concluido"), "unknown status")

