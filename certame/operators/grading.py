"""Grading of answers from forms, click logs and scanned sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame.functions.numbers import clock, medal, minutes, percent, time_budget


def right(answer: Column, key: Column) -> Column:
    """A missing answer is wrong, also to a voided question."""
    return F.coalesce(answer == key, F.lit(False))


def right_nullsafe(answer: Column, key: Column) -> Column:
    """The single-answer form: no answer to a question without a key counts as right."""
    return answer.eqNullSafe(key)


def grade(answers: DataFrame, questions: DataFrame, nullsafe: bool = False) -> DataFrame:
    """Answers (questao_id, resposta, ...) with area, competencia, gabarito and correta.

    Answers to unknown questions have no key. Spark broadcasts the questions as long as they are small.
    """
    key = questions.select(F.col("id").alias("questao_id"), "area", "competencia", "gabarito")
    return answers.join(key, "questao_id", "left").withColumn("correta", (right_nullsafe if nullsafe else right)(F.col("resposta"), F.col("gabarito")))


def mock_areas(graded: DataFrame) -> DataFrame:
    """For each mock and area."""
    return graded.groupBy("simulado_id", "area").agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"))


def mock_result(graded: DataFrame, mocks: DataFrame) -> DataFrame:
    """Hits, percent and medal of each mock."""
    got = graded.groupBy("simulado_id").agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"))
    pct = percent(F.col("acertos"), F.col("total"))
    return mocks.join(got, mocks["id"] == got["simulado_id"]).select("simulado_id", "usuario_id", "status", "total", "acertos", pct.alias("pct"), medal(pct).alias("medalha"))


def finish(mocks: DataFrame, graded: DataFrame, now: Column) -> DataFrame:
    """Mocks with answers get their hits, state and time; finished ones stay as they are."""
    got = graded.groupBy(F.col("simulado_id").alias("id")).agg(F.count_if("correta").alias("n"))
    open_ = (F.col("status") != "concluido") & F.col("n").isNotNull()
    return mocks.join(got, "id", "left").withColumns({
        "acertos": F.when(open_, F.col("n").cast("int")).otherwise(F.col("acertos")),
        "concluido_em": F.when(open_, now).otherwise(F.col("concluido_em")),
        "status": F.when(open_, "concluido").otherwise(F.col("status")),
    }).drop("n")


def durations(mocks: DataFrame) -> DataFrame:
    """Minutes taken, and the time that the mock allows."""
    allowed = time_budget(F.col("total_questoes"))
    return mocks.select("id", minutes(F.col("iniciado_em"), F.col("concluido_em")).alias("minutos"), allowed.alias("segundos"), clock(allowed).alias("relogio"))


def sheet_status(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """Detected letters (simulado_id, respostas, confiancas) against keys (simulado_id, chave), place by place.

    Places without a key are neutral; marks with 0 < confidence < 0.6 are in doubt.
    """
    read = answers.select("simulado_id", F.posexplode(F.arrays_zip("respostas", "confiancas")).alias("pos", "r"))
    told = keys.select("simulado_id", F.posexplode("chave").alias("pos", "gabarito"))
    both = read.join(told, ["simulado_id", "pos"], "left").select("simulado_id", "pos", F.col("r.respostas").alias("resposta"), F.col("r.confiancas").alias("confianca"), "gabarito")
    status = F.when(F.col("gabarito").isNull() | F.col("resposta").isNull(), "neutra").when(F.col("resposta") == F.col("gabarito"), "certa").otherwise("errada")
    return both.withColumns({"situacao": status, "duvida": F.coalesce((F.col("confianca") > 0) & (F.col("confianca") < 0.6), F.lit(False))})


def eliminated(clicks: DataFrame) -> DataFrame:
    """Options that a user struck out: those clicked an odd number of times."""
    return clicks.groupBy("user_id", "questao", "letra").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select("user_id", "questao", "letra")


def chosen(clicks: DataFrame) -> DataFrame:
    """The answer that a click log leaves: the same letter again clears it, another replaces it.

    Within a run of equal letters the state alternates, and a run starts with a choice: so the last
    run's parity decides. Runs come from windows by user and question; no row of Python.
    """
    order = Window.partitionBy("user_id", "questao").orderBy("ts", "event_id")
    runs = clicks.withColumn("novo", F.when(F.lag("letra").over(order).eqNullSafe(F.col("letra")), 0).otherwise(1)).withColumn("corrida", F.sum("novo").over(order))
    sizes = runs.groupBy("user_id", "questao", "corrida").agg(F.first("letra").alias("letra"), F.count("*").alias("n"))
    last = sizes.groupBy("user_id", "questao").agg(F.max_by(F.struct("letra", "n"), "corrida").alias("u"))
    return last.select("user_id", "questao", F.when(F.col("u.n") % 2 == 1, F.col("u.letra")).alias("resposta"))
