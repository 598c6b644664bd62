"""Reports on a collection of files as rows (secao, chave, item), a section each kind of finding.

A section may be as long as the collection, so none is gathered into one value: rows are written sorted, a folder a section, and read back section by section.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "secao string, chave string, item string"
#: What an item of each section holds.
ITEMS = {
    "resumo": "tipo string, arquivos long",
    "associacoes": "prova string, gabarito string, evento string, turno string",
    "duplicatas": "nome string, dup_de string",
    "material_apoio": "nome string, tipo string",
    "nao_identificados": "nome string",
    "inconsistencias": "nome string, motivo string",
    "eventos": "evento string, turnos array<string>, provas long, com_gabarito long",
    "filtros": "filtro string, valor string, total long",
}


def _section(rows: DataFrame, name: str, key: Column) -> DataFrame:
    """rows as a section; an item is the JSON of its columns, absent ones left out."""
    return rows.select(F.lit(name).alias("secao"), F.coalesce(key, F.lit("")).alias("chave"), F.to_json(F.struct(*rows.columns)).alias("item"))


def linked(mapping: DataFrame) -> DataFrame:
    """(prova, gabarito, evento, turno): each exam of a mapping and the key of its event and shift; a key without shift serves all of the event's, one with it goes first."""
    exams = mapping.where("tipo = 'prova' and dup_de is null").select(F.col("nome").alias("prova"), "evento", "turno")
    keys = mapping.where("tipo = 'gabarito' and dup_de is null")
    own = keys.where("turno is not null").groupBy("evento", "turno").agg(F.min("nome").alias("__own"))
    common = keys.where("turno is null").groupBy("evento").agg(F.min("nome").alias("__common"))
    found = exams.join(own, ["evento", "turno"], "left").join(common, "evento", "left")
    return found.select("prova", F.coalesce("__own", "__common").alias("gabarito"), "evento", "turno")


def report(mapping: DataFrame, support: tuple[str, ...] = ("material",)) -> DataFrame:
    """Of files (nome, tipo, evento, turno, nome_pad, dup_de) how many there are of each kind, exams with their keys, copies, support material, what is not told, and what doesn't fit.

    Of inconsistencies there are exams without a key, keys that no exam has, and target names that several files share.
    """
    plain = mapping.where("dup_de is null")
    links = linked(mapping)
    resumo = mapping.groupBy("tipo").agg(F.count("*").alias("arquivos"))
    reason = lambda rows, text: rows.select("nome", F.lit(text).alias("motivo"))
    unused = plain.where("tipo = 'gabarito'").join(links.select(F.col("gabarito").alias("nome")).where("nome is not null").distinct(), "nome", "left_anti")
    shared = plain.where("nome_pad is not null").groupBy("nome_pad").agg(F.count("*").alias("n")).where("n > 1")
    wrong = [reason(links.where("gabarito is null").withColumnRenamed("prova", "nome"), "prova sem gabarito"), reason(unused, "gabarito sem prova"), reason(plain.join(shared, "nome_pad"), "nome de destino repetido")]
    bad = reduce(DataFrame.unionByName, wrong)
    parts = [
        _section(resumo, "resumo", F.col("tipo")),
        _section(links, "associacoes", F.col("prova")),
        _section(mapping.where("dup_de is not null").select("nome", "dup_de"), "duplicatas", F.col("nome")),
        _section(plain.where(F.col("tipo").isin(*support)).select("nome", "tipo"), "material_apoio", F.col("nome")),
        _section(plain.where("tipo is null").select("nome"), "nao_identificados", F.col("nome")),
        _section(bad, "inconsistencias", F.concat_ws("|", "nome", "motivo")),
    ]
    return reduce(DataFrame.unionByName, parts)


def metadata(mapping: DataFrame, questions: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """The events of a collection with shifts and how many exams have a key, and the values of each filter of its questions."""
    links = linked(mapping).where("evento is not null")
    events = links.groupBy("evento").agg(F.sort_array(F.collect_set("turno")).alias("turnos"), F.count("*").alias("provas"), F.count("gabarito").alias("com_gabarito"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("filtro"), F.col(c).cast("string").alias("valor")) for c in filters]))
    values = questions.select(pairs.alias("f")).where("f.valor is not null").groupBy("f.filtro", "f.valor").agg(F.count("*").alias("total"))
    return _section(events, "eventos", F.col("evento")).unionByName(_section(values, "filtros", F.concat_ws("|", "filtro", "valor")))


def write(sections: DataFrame, path: str) -> None:
    """Sections as folders of JSON lines, sorted by key over each folder's files."""
    dealt = sections.repartitionByRange("secao", "chave", "item").sortWithinPartitions("secao", "chave", "item")
    dealt.write.mode("overwrite").partitionBy("secao").json(path)


def read(spark: SparkSession, path: str, section: str) -> DataFrame:
    """One section's items as columns; only its folder is opened."""
    rows = spark.read.schema("chave string, item string, secao string").json(path).where(F.col("secao") == section)
    return rows.select("chave", F.from_json("item", ITEMS[section]).alias("i")).orderBy("chave").select("i.*")
