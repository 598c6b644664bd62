"""Merges, bulk updates and the log of pending changes.

Nothing here rewrites a table in place: each function returns the table as it is afterwards, and
sinks.replace_table() puts it where the old one was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame import fixed
from certame.functions.arrays import map_put, map_without, put_image, without_path
from certame.schemas import REPORTS, evolve

#: Buckets that new rows are numbered in.
ID_BUCKETS = 1024


def latest_per_key(rows: DataFrame, key: tuple[str, ...], order: list[str]) -> DataFrame:
    """The last row of each key. One aggregate, so rows of a key meet pre-reduced, however many they are."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*rows.columns)


def first_per_key(rows: DataFrame, key: tuple[str, ...], order: list[str]) -> DataFrame:
    """W9."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...], columns: tuple[str, ...] | None = None) -> DataFrame:
    """New rows, and old ones with the columns that new brings (all but the key, or `columns`).

    Keys are compared null-safely; new must have one row for each key (latest_per_key()). Columns
    that new lacks stay; rows that only new has get null there.
    """
    bring = [c for c in (columns or new.columns) if c not in key]
    n = new.select(*[F.col(c).alias(f"__k_{c}") for c in key], *[F.col(c).alias(f"__n_{c}") for c in bring], F.lit(True).alias("__new"))
    both = old.withColumn("__old", F.lit(True)).join(n, [old[c].eqNullSafe(n[f"__k_{c}"]) for c in key], "full_outer")

    def value(c: str) -> Column:
        if c in key:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__k_{c}")).alias(c)
        return F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in bring else F.col(c)

    return both.select(*map(value, old.columns))


def refused(new: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """M2: rows that lack something required (null, empty or 0), with erro naming what."""
    lacks = [F.when(F.coalesce(F.trim(F.col(c).cast("string")).isin("", "0"), F.lit(True)), F.lit(c)) for c in required]
    return new.withColumn("erro", F.concat_ws(", ", *lacks)).where("erro <> ''")


def insert(rows: DataFrame, new: DataFrame, schema: str, required: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """M2: rows and new ones, with the columns of schema; refused() ones stay out, missing columns and nulls take their defaults."""
    good = reduce(lambda a, b: a & b, [~F.coalesce(F.trim(F.col(c).cast("string")).isin("", "0"), F.lit(True)) for c in required], F.lit(True))
    return evolve(rows, schema).unionByName(evolve(new.where(good), schema, defaults))


def report_errors(reports: DataFrame, new: DataFrame) -> DataFrame:
    """M2: error reports of users (ano, dia, numero, tipo_erro, maybe questao_id, descricao); a blank description is none, and all wait."""
    told = new.withColumn("descricao", F.nullif(F.trim("descricao"), F.lit(""))) if "descricao" in new.columns else new
    return insert(reports, told.drop("status"), REPORTS, ("ano", "dia", "numero", "tipo_erro"), {"status": "pendente"})


def insert_or_patch(old: DataFrame, new: DataFrame, next_id: int) -> DataFrame:
    """M3: rows with an id change theirs; rows without one come in, with ids from next_id on, without gaps.

    Ids follow the rows' contents, so a task that runs again gives the same: a row's place in its hash bucket, after the rows of the buckets before.
    """
    patched = upsert(old, new.where("id is not null"), ("id",))
    fresh = new.where("id is null").drop("id").withColumn("__row", F.to_json(F.struct(*[c for c in new.columns if c != "id"])))
    fresh = fresh.withColumn("__in", F.pmod(F.xxhash64("__row"), F.lit(ID_BUCKETS)))
    # a row for each bucket
    before = fresh.groupBy("__in").agg(F.count("*").alias("n")).select("__in", (F.sum("n").over(Window.orderBy("__in")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__in").orderBy("__row"))
    numbered = fresh.join(F.broadcast(before), "__in").withColumn("id", F.lit(next_id) + F.col("__before") + place - 1).drop("__in", "__row", "__before")
    return patched.unionByName(numbered, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """M4."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def rename_value(rows: DataFrame, column: str, before: str, after: str, fonte: str) -> DataFrame:
    """M5: a facet's value under a new name, within a source."""
    return rows.withColumn(column, F.when((F.col("fonte") == fonte) & (F.col(column) == before), after).otherwise(F.col(column)))


def would_rename(rows: DataFrame, column: str, before: str, fonte: str) -> DataFrame:
    """How many rows that touches."""
    return rows.where((F.col("fonte") == fonte) & (F.col(column) == before)).agg(F.count("*").alias("afetadas"))


def void_listed(questions: DataFrame, listed: tuple[tuple[int, int], ...] = fixed.VOIDED) -> DataFrame:
    """M9: questions of the national exam on the list are void and lose their key."""
    pairs = F.array(*[F.struct(F.lit(y).alias("ano"), F.lit(n).alias("numero")) for y, n in listed])
    hit = F.coalesce((F.col("fonte") == "ENEM") & (F.col("tipo") == "PROVA") & F.array_contains(pairs, F.struct("ano", "numero")), F.lit(False))
    return questions.withColumns({"anulada": hit | F.col("anulada"), "gabarito": F.when(hit, None).otherwise(F.col("gabarito"))})


def backfill_kind(questions: DataFrame) -> DataFrame:
    """Rows without a kind are mocks of EXATO, exams of all others."""
    return questions.withColumn("tipo", F.coalesce("tipo", F.when(F.col("fonte") == "EXATO", "SIMULADO").otherwise("PROVA")))


def mark(rows: DataFrame, ids: DataFrame, column: str, value: object, key: str = "questao_id") -> DataFrame:
    """M6: sets a column where the key is listed."""
    listed = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(listed, key, "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).drop("__hit").select(*rows.columns)


def compact(log: DataFrame) -> DataFrame:
    """Pending changes (seq, kind, key, payload): the last of each key; changes without a key all stay."""
    keyed = latest_per_key(log.where("key is not null"), ("kind", "key"), ["seq"])
    return keyed.unionByName(log.where("key is null"))


def pending_counts(log: DataFrame) -> DataFrame:
    """A23."""
    return compact(log).groupBy("kind").agg(F.count("*").alias("n"))


FLUSH_ORDER = ("questoes", "imagens", "frases")


def flush_plan(log: DataFrame) -> DataFrame:
    """Changes in the order in which they go out: questions, images, quotes."""
    place = F.array_position(F.array(*map(F.lit, FLUSH_ORDER)), F.col("kind"))
    return compact(log).withColumn("ordem", F.row_number().over(Window.partitionBy("kind").orderBy("seq"))).orderBy(place, "ordem")


def after_flush(log: DataFrame, results: DataFrame) -> DataFrame:
    """What remains pending. What failed stays, unlike in a flush that clears all that it tried."""
    done = results.where("ok").select("seq").distinct()
    settled = compact(log).join(done, "seq").select("kind", "key", "seq")
    newest = settled.where("key is not null").groupBy("kind", "key").agg(F.max("seq").alias("upto"))
    rest = log.join(done, "seq", "left_anti").join(newest, ["kind", "key"], "left")
    return rest.where(F.col("upto").isNull() | (F.col("seq") > F.col("upto"))).select(*log.columns)


def flush_report(results: DataFrame) -> DataFrame:
    """Successes and failures of each kind."""
    return results.groupBy("kind").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("erro"))


def with_recovered(questions: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Options recovered from a page replace the old ones only if there are three."""
    f = found.select(key, F.col("alternativas").alias("__found"))
    enough = F.coalesce(F.size("__found"), F.lit(0)) >= 3
    return questions.join(f, key, "left").withColumn("alternativas", F.when(enough, F.col("__found")).otherwise(F.col("alternativas"))).drop("__found").select(*questions.columns)


def add_image(questions: DataFrame, hit: Column, image: Column) -> DataFrame:
    """Adds or moves an image of the questions that `hit` marks."""
    imagens = F.when(hit, put_image(F.col("imagens"), image)).otherwise(F.col("imagens"))
    return questions.withColumns({"imagens": imagens, "tem_imagem": F.when(hit, True).otherwise(F.col("tem_imagem"))})


def set_option_image(questions: DataFrame, hit: Column, letter: Column, path: Column) -> DataFrame:
    """M18, F47."""
    own = F.coalesce("imagens_alternativas", F.create_map().cast("map<string,string>"))
    return questions.withColumn("imagens_alternativas", F.when(hit, map_put(own, letter, path)).otherwise(F.col("imagens_alternativas")))


def drop_image(questions: DataFrame, path: Column) -> DataFrame:
    """Takes a file out of texts and options; the flag follows."""
    left, options = without_path(F.col("imagens"), path), map_without(F.col("imagens_alternativas"), path)
    return questions.withColumns({"imagens": left, "imagens_alternativas": options, "tem_imagem": (F.coalesce(F.size(left), F.lit(0)) > 0) | options.isNotNull()})
