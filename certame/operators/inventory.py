"""Inventory of source files: what they are, which belong together, which are copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame.functions.text import file_day, file_kind

COPY = r"\(\d\)\.pdf$"


def is_copy(name: Column) -> Column:
    """P19."""
    return F.lower(name).rlike(COPY)


def named(name: Column, has: tuple[str, ...] = (), lacks: tuple[str, ...] = (), copies: bool = False) -> Column:
    """Names that hold all of some parts and none of others."""
    low = F.lower(name)
    parts = [F.contains(low, F.lit(p.lower())) for p in has] + [~F.contains(low, F.lit(p.lower())) for p in lacks]
    return reduce(lambda a, b: a & b, parts, is_copy(name) if copies else ~is_copy(name))


def only_one(rows: DataFrame) -> DataFrame:
    """P20: the one row; fails on none or several."""
    got = rows.limit(2).agg(F.collect_list(F.struct("*")).alias("r"))
    one = F.when(F.size("r") == 1, F.get("r", F.lit(0))).otherwise(F.raise_error("not exactly one match"))
    return got.select(one.cast(rows.schema).alias("r")).select("r.*")


def classified(files: DataFrame) -> DataFrame:
    """(pasta, nome, tipo, dia) of files (pasta, nome)."""
    return files.withColumns({"tipo": file_kind(F.col("nome")), "dia": file_day(F.col("nome"))})


def papers(files: DataFrame) -> DataFrame:
    """For each folder and day the exam and its key: (pasta, dia, prova, gabarito).

    The first name of each kind and day counts. A folder without any classified file takes its
    exams and keys by place: first of either kind is day 1, second day 2. Days without an exam fall out.
    """
    named_files = classified(files)
    known = named_files.where("tipo is not null and dia is not null").groupBy("pasta", "tipo", "dia").agg(F.min("nome").alias("nome"))
    rest = named_files.join(known.select("pasta").distinct(), "pasta", "left_anti")
    key = F.lower("nome").rlike("gab|resolu")
    place = F.row_number().over(Window.partitionBy("pasta", "chave").orderBy("nome"))
    guessed = rest.withColumn("chave", key).withColumn("n", place).where("n <= 2").select("pasta", F.when(F.col("chave"), "gabarito").otherwise("prova").alias("tipo"), F.concat(F.lit("simu_dia"), F.col("n").cast("string")).alias("dia"), "nome")
    every = known.unionByName(guessed)
    paired = every.groupBy("pasta", "dia").agg(F.max(F.when(F.col("tipo") == "prova", F.col("nome"))).alias("prova"), F.max(F.when(F.col("tipo") == "gabarito", F.col("nome"))).alias("gabarito"))
    return paired.where("prova is not null")


def first_existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Of variants (alvo, ordem, nome) the first that is there, for each folder and target."""
    return files.join(wanted, "nome").groupBy("pasta", "alvo").agg(F.min_by("nome", "ordem").alias("nome"))


def with_key(mocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Mocks (evento, turno, ...) with their key (evento, turno, gabarito); a key without turno serves every shift, one with it goes first."""
    own = keys.where("turno is not null").groupBy("evento", "turno").agg(F.max("gabarito").alias("__own"))
    common = keys.where("turno is null").groupBy("evento").agg(F.max("gabarito").alias("__common"))
    found = mocks.join(own, ["evento", "turno"], "left").join(common, "evento", "left")
    return found.select(*[F.col(c) for c in mocks.columns], F.coalesce("__own", "__common").alias("gabarito"))


def unmapped(files: DataFrame, mapping: DataFrame, key: str = "nome") -> DataFrame:
    """J12, U2."""
    return files.join(mapping.select(key).distinct(), key, "left_anti")


def present(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose file is there."""
    return rows.join(files.select(key).distinct(), key, "left_semi")


def missing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose file is not."""
    return rows.join(files.select(key).distinct(), key, "left_anti")


def duplicates(texts: DataFrame, id: str, text: str, chars: int = 2000) -> DataFrame:
    """U4: groups of texts with equal beginnings: (hash, original, copias)."""
    hashed = texts.select(F.md5(F.substring(F.coalesce(text, F.lit("")), 1, chars)).alias("hash"), F.col(id).alias("id"))
    return hashed.groupBy("hash").agg(F.min("id").alias("original"), (F.count("*") - 1).alias("copias")).where("copias > 0")


def originals(files: DataFrame) -> DataFrame:
    """Copies 'x (1).pdf' with the file they copy: (nome, dup_de)."""
    base = F.regexp_replace(F.lower("nome"), r"\s*\(\d\)(?=\.pdf$)", "")
    plain = files.where(~is_copy(F.col("nome"))).select(F.lower("nome").alias("base"), F.col("nome").alias("dup_de"))
    return files.where(is_copy(F.col("nome"))).withColumn("base", base).join(plain, "base", "left").select("nome", "dup_de")


def kind_counts(mapping: DataFrame, by: str, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of fixed kinds, zeros kept."""
    return mapping.groupBy(by).pivot(column, list(kinds)).count().na.fill(0, list(kinds))


def copy_plan(mapping: DataFrame, folders: dict[str, str]) -> DataFrame:
    """K9: where each file goes, by kind."""
    to = F.element_at(F.create_map(*[F.lit(x) for p in folders.items() for x in p]), F.col("tipo"))
    return mapping.select(F.col("nome").alias("origem"), F.concat(to, F.lit("/"), F.coalesce("nome_pad", "nome")).alias("destino")).where("destino is not null")


def free_suffix(names: DataFrame, stem: str = "stem", number: str = "n") -> DataFrame:
    """For each file stem the first number from 1 that is not taken."""
    order = Window.partitionBy(stem).orderBy(number)
    run = names.where(f"{number} >= 1").select(stem, number).distinct().withColumn("ordem", F.row_number().over(order))
    return run.groupBy(stem).agg((F.coalesce(F.max(F.when(F.col(number) == F.col("ordem"), F.col("ordem"))), F.lit(0)) + 1).alias("livre"))


def days(rows: DataFrame, by: str) -> DataFrame:
    """A22."""
    return rows.groupBy(by).agg(F.sort_array(F.collect_set("dia")).alias("dias"))


def quality(questions: DataFrame) -> DataFrame:
    """Of each year: all, with five options, with a key."""
    return questions.groupBy("ano").agg(F.count("*").alias("total"), F.count_if(F.size("alternativas") == 5).alias("completas"), F.count_if(F.col("gabarito").isNotNull()).alias("com_gabarito"))
