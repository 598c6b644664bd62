"""Mock exams: sampling, loading in order, print layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame import fixed
from certame.operators import ranks


def area_rank(area: Column) -> Column:
    """Place of an area in print, from 0; -1 for one that is unknown."""
    return (F.coalesce(F.array_position(F.array(*map(F.lit, fixed.AREAS)), area), F.lit(0)) - 1).cast("int")


def sample(pool: DataFrame, n: int | None, seed: str) -> DataFrame:
    """N questions (10 of nothing said, at most all), the same for the same seed on any cluster.

    The order is that of a hash of seed and id, so each task sends its n best.
    """
    return pool.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), "id").limit(n or fixed.DEFAULT_SAMPLE)


def sample_by(pool: DataFrame, by: str, n: int, seed: str) -> DataFrame:
    """O7 for each value of a column."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))), "id")
    return pool.withColumn("ordem", F.row_number().over(order)).where(F.col("ordem") <= n)


def in_order(mocks: DataFrame, questions: DataFrame) -> DataFrame:
    """(simulado_id, pos, question columns) of each mock's list, in its order; ids without a question fall out."""
    listed = mocks.select(F.col("id").alias("simulado_id"), F.posexplode("questoes_ids").alias("pos", "questao_id"))
    return listed.join(questions, listed["questao_id"] == questions["id"]).drop("id")


def answered_or_listed(mocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(simulado_id, questao_id) from the answers of a mock, and of one without answers from its list."""
    given = answers.select("simulado_id", "questao_id").distinct()
    rest = mocks.join(given.select(F.col("simulado_id").alias("id")).distinct(), "id", "left_anti")
    return given.unionByName(rest.select(F.col("id").alias("simulado_id"), F.explode("questoes_ids").alias("questao_id")).distinct())


def layout(rows: DataFrame, by: str) -> DataFrame:
    """Numbers, area blocks, columns and sheet rows of each printed exam (a value of `by`).

    Order: area, year, number, id. The first half of an area stands in column 1; answer
    sheets have rows of five and pages of ten.
    """
    order = [area_rank(F.col("area")).asc(), F.col("ano").asc_nulls_last(), F.col("numero").asc_nulls_last(), F.col("id").asc()]
    numbered = ranks.placed(rows, [by], order, "num").drop("__g")
    within = ranks.placed(numbered, [by, "area"], [F.col("num")], "__place").drop("__g")  # areas without a rank may alternate
    areas = numbered.groupBy(by, "area").agg(F.min("num").alias("area_inicio"), F.max("num").alias("area_fim"), F.count("*").alias("__size"))
    return ranks.joined(within, areas, [by, "area"]).withColumns({
        "coluna": F.when(F.col("__place") <= F.ceil(F.col("__size") / 2), 1).otherwise(2),
        "linha": F.floor((F.col("num") - 1) / 5),
        "pagina": F.floor((F.col("num") - 1) / 10),
    }).drop("__place", "__size")


def islands(rows: DataFrame, by: str, order: list[Column], value: str) -> DataFrame:
    """Runs of equal neighbours: (by, grupo, value, inicio, fim)."""
    return ranks.runs(rows, [by], order, value)


def recent(mocks: DataFrame, n: int = 5) -> DataFrame:
    """The n latest of each user; ranks are limited before rows move."""
    w = Window.partitionBy("usuario_id").orderBy(F.col("iniciado_em").desc_nulls_last(), F.col("id").desc())
    return mocks.withColumn("ordem", F.row_number().over(w)).where(F.col("ordem") <= n)


def create(pool: DataFrame, user: object, n: int | None, seed: str, now: Column) -> DataFrame:
    """A new mock of one row; fails if nothing is in the pool."""
    picked = sample(pool, n, seed).select(F.collect_list("id").alias("questoes_ids"))
    return picked.select(
        F.lit(user).alias("usuario_id"), F.lit("online").alias("tipo"),
        F.when(F.size("questoes_ids") > 0, F.col("questoes_ids")).otherwise(F.raise_error("no question fits").cast("array<bigint>")).alias("questoes_ids"),
        F.size("questoes_ids").alias("total_questoes"), F.lit("em_andamento").alias("status"), now.alias("iniciado_em"),
    )
