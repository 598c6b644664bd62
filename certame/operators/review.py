"""The retry list and its versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certame.operators import ranks
from certame.schemas import checked
from certame.sources.staging import dealt


def missed(acertou: str = "acertou"):
    """Wrong, or never answered."""
    return ~F.coalesce(F.col(acertou), F.lit(False))


def retry_list(answers: DataFrame, questions: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """What a user missed, with the question, newest first.

    The area is the answer's, else the question's, else Outras. keep_unknown keeps answers whose question is gone.
    """
    q = questions.select(F.col("id").alias("questao_id"), F.col("area").alias("q_area"), F.get("enunciado", F.lit(0)).alias("inicio"))
    rows = answers.where(missed()).join(q, "questao_id", "left" if keep_unknown else "inner")
    area = F.coalesce(F.nullif("area", F.lit("")), F.col("q_area"), F.lit("Outras"))
    return rows.withColumn("area", area).drop("q_area").orderBy(F.col("respondido_em").desc_nulls_last(), "questao_id")


def current_version(state: DataFrame, by: str = "usuario_id") -> DataFrame:
    """The highest version of each user, 1 without any."""
    return state.groupBy(by).agg(F.coalesce(F.max("versao_tt"), F.lit(1)).alias("versao"))


def versions(current: DataFrame) -> DataFrame:
    """Every version from 1."""
    return current.select("*", F.explode(F.sequence(F.lit(1), "versao")).alias("v"))


def next_version(state: DataFrame, answers: DataFrame, by: str = "usuario_id") -> DataFrame:
    """The retry table after a round.

    state: usuario_id, questao_id, versao_tt, acertou, zerada; answers: usuario_id, questao_id, acertou. What was
    answered right is mastered (zerada, acertou); what was missed again moves to the user's next version and is neither. A question
    with both answers counts as missed; one without an answer stays as it is. State is dealt by user over a fixed number of tasks, so that none
    holds a core's share of all.
    """
    told = answers.groupBy(by, "questao_id").agg(F.bool_and(F.coalesce("acertou", F.lit(False))).alias("certa"))
    joined = dealt(state.join(told, [by, "questao_id"], "left"), by).join(current_version(state, by), by, "left")
    return joined.select(
        by, "questao_id",
        F.when(F.col("certa") == F.lit(False), F.col("versao") + 1).otherwise(F.col("versao_tt")).cast("int").alias("versao_tt"),
        F.coalesce("certa", "acertou", F.lit(False)).alias("acertou"), F.coalesce("certa", "zerada", F.lit(False)).alias("zerada"),
    )


def round_counts(state: DataFrame, answers: DataFrame, by: str = "usuario_id") -> DataFrame:
    """M8: mastered, repeated and the new version, for each user with answers.

    Every answered question counts, whether the state knows it or not; a user without state has version 1 so far.
    """
    told = answers.groupBy(by, "questao_id").agg(F.bool_and(F.coalesce("acertou", F.lit(False))).alias("certa"))
    counts = told.groupBy(by).agg(F.count_if("certa").alias("zeradas"), F.count_if(~F.col("certa")).alias("repetidas"))
    return counts.join(current_version(state, by), by, "left").select(by, "zeradas", "repetidas", (F.coalesce("versao", F.lit(1)) + 1).alias("nova_versao"))


def may_retry(mocks: DataFrame) -> DataFrame:
    """Fails on a mock that is not a finished retry."""
    return checked(mocks, (F.col("tipo") == "tira-teima") & (F.col("status") == "concluido"), "not a finished retry")


def by_area(rows: DataFrame, order: list[str]) -> DataFrame:
    """The ids of each area in order, for printing."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col("questao_id").alias("__id"))))
    return rows.groupBy("area").agg(F.transform(listed, lambda s: s["__id"]).alias("questoes"))


def pages_by_area(rows: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """A17 for any number of rows: (area, pagina, questoes), pages of `size` ids of each area in order, from 1; no row holds more."""
    along = ranks.placed(rows.select("area", "questao_id", *[c for c in order if c not in ("area", "questao_id")]), ["area"], [*[F.col(c).asc() for c in order], F.col("questao_id").asc()], "__place")
    page = (F.floor((F.col("__place") - 1) / size) + 1).alias("pagina")
    listed = F.sort_array(F.collect_list(F.struct("__place", "questao_id")))
    return along.groupBy("area", page).agg(F.transform(listed, lambda s: s["questao_id"]).alias("questoes"))
