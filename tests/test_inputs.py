"""Uploads, reports, copies, models that a test brings, and tables that gain columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from certame import fixed, schemas
from certame.functions import numbers, text
from certame.operators import changes, inventory, models, review, search, sheets
from certame.sources import files, sinks


def test_types_of_uploads(spark):
    heads = {"jpeg": b"\xff\xd8\xff\xe0", "png": b"\x89PNG\r\n\x1a\n", "webp": b"RIFF\x01\x02\x03\x04WEBP", "pgm": b"P5\n3 3", "pdf": b"%PDF-1.7", "none": b""}
    rows = spark.createDataFrame([(k, v + bytes(2000)) for k, v in heads.items()] + [("null", None)], "id string, content binary")
    got = {r.id: r.t for r in rows.select("id", sheets.content_type(F.col("content")).alias("t")).collect()}
    assert got == {"jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "pgm": "image/x-portable-graymap", "pdf": None, "none": None, "null": None}
    blank = b"P5\n300 300\n255\n" + bytes([255]) * 90_000
    sent = spark.createDataFrame([("a", blank, 45, "application/pdf"), ("b", b"x", 45, "image/png"), ("c", blank, 0, "image/png"), ("d", blank, 45, None)], "id string, content binary, total_questoes int, content_type string")
    assert {r.id: r.erro for r in sheets.bubble_fills(sent).collect()} == {"a": "tipo de arquivo não suportado", "b": "imagem muito pequena", "c": "número de questões inválido", "d": "tipo de arquivo não suportado"}


def test_photographs_of_a_folder(spark, tmp_path):
    """S17."""
    (tmp_path / "a.pgm").write_bytes(b"P5\n3 3\n255\n123456789")
    got = files.photographs(spark, str(tmp_path), 20).collect()
    assert [(r.id.rsplit("/", 1)[1], bytes(r.content)[:2], r.total_questoes) for r in got] == [("a.pgm", b"P5", 20)]


def test_reports_that_wait(spark, tmp_path):
    """S20, M2."""
    (tmp_path / "r.json").write_text('[{"questao_id": 1, "ano": 2020, "dia": "dia1", "numero": 3, "tipo_erro": "texto", "status": "pendente"}, {"questao_id": 2, "status": "resolvido"}]')
    waiting = files.pending_reports(spark, str(tmp_path / "r.json"))
    assert [r.questao_id for r in waiting.collect()] == [1]
    new = spark.createDataFrame([(None, 2021, "dia2", 7, "gabarito", "  "), (5, None, "dia1", 1, "x", "y"), (6, 2020, "", 1, "x", "y"), (7, 2020, "dia1", 0, "x", "y")], "questao_id long, ano int, dia string, numero int, tipo_erro string, descricao string")
    after = changes.report_errors(waiting, new).collect()
    assert [(r.questao_id, r.numero, r.descricao, r.status) for r in after] == [(1, 3, None, "pendente"), (None, 7, None, "pendente")]
    assert {r.questao_id: r.erro for r in changes.refused(new, ("ano", "dia", "numero", "tipo_erro")).collect()} == {5: "ano", 6: "dia", 7: "numero"}


def test_copies_and_addresses(spark):
    """K7, K9, O9."""
    mapping = spark.createDataFrame([("a", "prova", "p1"), ("b", "gabarito", None), ("c", None, None), ("d", "outro", "x")], "nome string, tipo string, nome_pad string")
    plan = inventory.copy_plan(mapping, {"prova": "PROVAS", "gabarito": "GABARITOS"})
    assert sorted(map(tuple, plan.collect())) == [("a", "PROVAS/p1"), ("b", "GABARITOS/b")]
    objects = spark.createDataFrame([("x/y.png", b"1")], "path string, content binary")
    assert sinks.public_urls(objects, "http://h/").first().url == "http://h/x/y.png"
    picks = spark.range(5).select(numbers.pick(F.array(*map(F.lit, "abc")), F.col("id").cast("int") - 1).alias("v"))
    assert [r.v for r in picks.collect()] == ["c", "a", "b", "c", "a"]


def test_tables_gain_columns(spark):
    """M12."""
    old = spark.createDataFrame([(1, None), (2, "PROVA")], "id long, tipo string")
    grown = schemas.evolve(old, "id long, tipo string, versao int, nota string", {"tipo": "SIMULADO", "versao": 1})
    assert [tuple(r) for r in grown.orderBy("id").collect()] == [(1, "SIMULADO", 1, None), (2, "PROVA", 1, None)]
    assert schemas.missing_columns(old, "id long, versao int") == ["versao"]
    with pytest.raises(Exception, match="unknown status"):
        schemas.mock_checks(spark.createDataFrame([("x",)], "status string")).collect()


def test_skills_by_a_model(spark):
    """L1, L2: the next model where one fails, done questions skipped, a second run goes on."""
    rows = spark.createDataFrame([(k, "H05" if k == 1 else None, "A", ["t"], "c") for k in range(1, 5)], "id long, competencia string, area string, enunciado array<string>, comando string")

    def broken(question):
        raise ValueError

    def make():
        return models.first_of(broken, lambda q: None, lambda q: "Resposta: h07." if "Área: A" in q else "")

    once = models.classify_skills(rows, make, fixed_skills(), limit=1)
    assert {r.id: r.competencia for r in once.collect()} == {1: "H05", 2: "H07", 3: None, 4: None}
    again = models.classify_skills(once, make, fixed_skills())
    assert {r.id: r.competencia for r in again.collect()} == {1: "H05", 2: "H07", 3: "H07", 4: "H07"}


def fixed_skills():
    return {"H05": "five", "H07": "seven"}


def test_search_by_a_model(spark):
    """L3: a question becomes a filter."""
    rows = spark.createDataFrame([(" ondas do mar ",)], "pedido string").withColumn("q", text.search_prompt(F.col("pedido"), fixed.AREAS))
    answer = '```{"termos": [" onda ", "", "mar", "som"], "area": "%s", "competencia": "H17"}```' % fixed.NATUREZA
    told = models.asked(rows, "q", "a", lambda: lambda q: answer if "ondas do mar" in q else None)
    got = told.select(text.search_answer(text.json_object(F.col("a")), F.col("pedido")).alias("s")).first().s
    spec = search.spec_from_answer(search.SearchSpec(), got.termos, got.area, got.competencia)
    assert spec.terms == ("onda", "mar") and spec.filters == {"area": fixed.NATUREZA, "competencia": "H17"}


def test_pages_of_an_area(spark):
    rows = spark.createDataFrame([(k, "a" if k % 5 else None) for k in range(47)], "questao_id long, area string")
    got = {(r.area, r.pagina): r.questoes for r in review.pages_by_area(rows, ["questao_id"], 10).collect()}
    assert [len(got["a", p]) for p in range(1, 5)] == [10, 10, 10, 7] and got[None, 1] == list(range(0, 47, 5)) and sum(got["a", 1], 0) == sum(k for k in range(13) if k % 5)
