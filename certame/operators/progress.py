"""Progress of a user or of all: by area, skill, coverage and streak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certame import fixed
from certame.functions.numbers import coverage, percent, performance, skill_number
from certame.operators.exams import area_rank


def areas(spark: SparkSession) -> DataFrame:
    """The four areas and their place in print."""
    return F.broadcast(spark.createDataFrame([(a, i) for i, a in enumerate(fixed.AREAS)], "area string, ordem int"))


def by_area(graded: DataFrame) -> DataFrame:
    """Total, hits and percent of each area, known or not."""
    got = graded.groupBy("area").agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"))
    return got.withColumn("pct", percent(F.col("acertos"), F.col("total"))).orderBy(area_rank(F.col("area")), "area")


def by_skill(graded: DataFrame) -> DataFrame:
    """The same for each skill, with the area of its first answer in order of seq."""
    got = graded.where("competencia is not null").groupBy("competencia").agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"), F.min_by("area", "seq").alias("area"))
    pct = percent(F.col("acertos"), F.col("total"))
    return got.withColumns({"pct": pct, "cor": performance(pct)})


def catalogue(questions: DataFrame) -> DataFrame:
    """A5: size of the catalogue by area and by skill, in one pass."""
    sets = questions.groupingSets([["area"], ["competencia"]], "area", "competencia").agg(F.count("*").alias("total"), F.grouping("area").alias("g"))
    kind = F.when(F.col("g") == 0, "area").otherwise("competencia")
    return sets.select(kind.alias("nivel"), F.when(F.col("g") == 0, F.col("area")).otherwise(F.col("competencia")).alias("valor"), "total").where("valor is not null")


def area_coverage(graded: DataFrame, questions: DataFrame) -> DataFrame:
    """Distinct questions answered of each area's catalogue; areas without answers show 0."""
    done = graded.select("area", "questao_id").distinct().groupBy("area").agg(F.count("*").alias("feitas"))
    size = questions.groupBy("area").agg(F.count("*").alias("catalogo"))
    out = areas(graded.sparkSession).join(done, "area", "left").join(size, "area", "left")
    feitas = F.coalesce("feitas", F.lit(0))
    return out.select("area", feitas.alias("feitas"), F.coalesce("catalogo", F.lit(0)).alias("catalogo"), coverage(feitas, F.col("catalogo")).alias("cobertura"))


def overall(graded: DataFrame) -> DataFrame:
    """One row for all answers."""
    got = graded.agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"), F.count_distinct("competencia").alias("habilidades"))
    return got.withColumn("pct", percent(F.col("acertos"), F.col("total")))


def skills_of_area(graded: DataFrame) -> DataFrame:
    """The skills practised in each area, by number."""
    pairs = graded.where("competencia is not null").select("area", "competencia").distinct()
    listed = F.sort_array(F.collect_list(F.struct(skill_number(F.col("competencia")).alias("n"), "competencia")))
    return pairs.groupBy("area").agg(F.transform(listed, lambda s: s["competencia"]).alias("habilidades"))


def streak(rows: DataFrame, by: str, right: str, order: list[str]) -> DataFrame:
    """Right answers since the last miss: (by, sequencia).

    The place of the last miss is one aggregate, so no user's rows are sorted: what comes after it counts.
    """
    at = F.struct(*order)
    miss = rows.groupBy(by).agg(F.max(F.when(~F.col(right), at)).alias("erro"))
    after = rows.join(miss, by).where(F.col("erro").isNull() | (at > F.col("erro"))).groupBy(by).agg(F.count("*").alias("sequencia"))
    return miss.select(by).join(after, by, "left").select(by, F.coalesce("sequencia", F.lit(0)).alias("sequencia"))


def streak_window(rows: DataFrame, by: str, right: str, order: list[str]) -> DataFrame:
    """W1 as a running count of misses from the end; for tables whose ties the order breaks."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("erros", F.sum(F.when(F.col(right), 0).otherwise(1)).over(w))
    return run.groupBy(by).agg(F.count_if(F.col("erros") == 0).alias("sequencia"))
