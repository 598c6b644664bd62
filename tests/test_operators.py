"""Edge cases of the exam-bank operators: nulls, ties, empty tables, sources, sinks and streams."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from certame.functions import numbers
from certame.operators import answer_key, changes, grading, models, review, search
from certame.sources import files, sinks

MINI = "id long, fonte string, tipo string, ano int, dia string, numero int, area string, competencia string, enunciado array<string>, comando string, gabarito string, anulada boolean, evento string, turno string, provedor string"


@pytest.fixture(scope="module")
def bank(spark):
    rows = [
        (1, "ENEM", "PROVA", 2020, "dia1", 5, "A", "H01", ["A 50% rise", "second"], "Choose.", "A", False, None, None, None),
        (2, "ENEM", "PROVA", 2020, "dia1", 5, "A", "H02", ["nothing"], None, "B", False, None, None, "P"),
        (3, "ENEM", "SIMULADO", 2021, "dia2", 9, "B", None, [], "a_b", None, True, "SIM_01", None, "P"),
        (4, "EXATO", "SIMULADO", None, "exato", 1, "B", "", ["x_y"], None, "C", False, "C0", "MANHA", None),
        (5, "UFT", "PROVA", 2019, "exato", 1, None, "H03", None, None, "D", False, None, "TARDE", None),
    ]
    return spark.createDataFrame(rows, MINI)


def ids(df):
    return [r.id for r in df.collect()]


def test_search_applies_what_the_source_knows(bank):
    spec = search.SearchSpec
    assert ids(search.search(bank, spec())) == [1, 2]  # the default source, without void questions
    assert ids(search.search(bank, spec(filters={"provedor": "P", "ano": 0, "dia": ""}))) == [2]
    assert ids(search.search(bank, spec(fonte="EXATO", filters={"ano": 2020, "turno": "MANHA"}, year_from=2020))) == [4]
    assert ids(search.search(bank, spec(fonte="UFT", filters={"tipo": "SIMULADO"}))) == []
    assert ids(search.search(bank, spec(fonte="UFT", filters={"tipo": "SIMULADO"}, sampling=True))) == [5]
    assert ids(search.search(bank, spec(page=3))) == []


def test_terms_stand_for_themselves(bank):
    assert ids(search.search(bank, search.SearchSpec(terms=("50%", " ")))) == [1]
    assert ids(search.search(bank, search.SearchSpec(terms=("%",)))) == [1]
    assert ids(search.search(bank, search.SearchSpec(terms=("choose", "NOTHING")))) == [1, 2]
    assert ids(search.search(bank, search.SearchSpec(fonte="EXATO", terms=("x%y",), escape=False))) == [4]


def test_go_to_number_ignores_other_input(bank):
    assert ids(search.go_to(bank, "5")) == [1] and ids(search.go_to(bank, "five")) == []


def test_neighbours_break_ties_by_id(bank):
    got = {r.id: (r.anterior, r.proximo) for r in search.neighbours(bank).collect()}
    assert got[1] == (None, 2) and got[2] == (1, 3) and got[3] == (2, None)


@pytest.mark.parametrize(("answer", "key", "strict", "loose"), [(None, None, False, True), (None, "A", False, False), ("A", None, False, False), ("A", "A", True, True), ("B", "A", False, False)])
def test_both_forms_of_grading(spark, answer, key, strict, loose):
    row = spark.createDataFrame([(answer, key)], "a string, k string").select(grading.right(F.col("a"), F.col("k")).alias("s"), grading.right_nullsafe(F.col("a"), F.col("k")).alias("l")).first()
    assert (row.s, row.l) == (strict, loose)


@pytest.mark.parametrize(("part", "whole", "pct", "medal"), [(1, 8, 13, "nenhuma"), (0, 0, 0, "nenhuma"), (1, 2, 50, None), (7, 10, 70, None), (9, 10, 90, None)])
def test_percent_rounds_halves_up(spark, part, whole, pct, medal):
    row = spark.createDataFrame([(part, whole)], "p long, w long").select(numbers.percent(F.col("p"), F.col("w")).alias("pct"), numbers.medal(numbers.percent(F.col("p"), F.col("w"))).alias("m")).first()
    assert row.pct == pct and (row.m == medal if medal else row.m != "nenhuma")


@pytest.mark.parametrize(
    ("fill", "letter", "low", "high"),
    [([0.05, 0.65, 0.08, 0.06, 0.07], "B", 0.3, 0.5), ([0.02, 0.03, 0.01, 0.02, 0.02], None, 0.0, 0.0), ([0.05, 0.50, 0.48, 0.05, 0.05], None, 0.5, 0.5), ([], None, 0.0, 0.0)],
)
def test_bubble_decision(spark, fill, letter, low, high):
    row = spark.createDataFrame([(fill,)], "f array<double>").select(numbers.decision(F.col("f")).alias("d")).first().d
    assert row.letra == letter and low <= row.confianca <= high


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("01 A  02 B  03 C  04 D  05 E", {1: "A", 2: "B", 3: "C", 4: "D", 5: "E"}),
        ("1. A\n2- B\n3. ANULADA\n4. C\n5. D", {1: "A", 2: "B", 3: None, 4: "C", 5: "D"}),
        ("1. [A] 2. [B] – ANULADA 3. [C] 4. [D] 5. [E]", {1: "A", 2: None, 3: "C", 4: "D", 5: "E"}),
        ("01 A 02 B 03 C 04 D", {}),
        ("121 A 122 B 123 C 124 D 125 E", {21: "A", 22: "B", 23: "C", 24: "D", 25: "E"}),
        (None, {}),
    ],
)
def test_answer_keys(spark, text, want):
    papers = spark.createDataFrame([(1, text)], "prova int, texto string")
    assert {r.numero: r.letra for r in answer_key.key_rows(papers).collect()} == want


def test_strict_keys_do_not_truncate(spark):
    papers = spark.createDataFrame([(1, "121 A 122 B 123 C 124 D 125 E")], "prova int, texto string")
    assert {r.numero for r in answer_key.key_rows(papers, strict=True).collect()} == {121, 122, 123, 124, 125}


def test_upsert_is_null_safe(spark):
    old = spark.createDataFrame([(None, 1, "a", "k"), (2020, 1, "b", "k")], "ano int, numero int, v string, other string")
    new = changes.latest_per_key(spark.createDataFrame([(None, 1, "c", 1), (None, 1, "d", 2), (2021, 1, "e", 3)], "ano int, numero int, v string, seq int"), ("ano", "numero"), ["seq"]).drop("seq")
    got = {(r.ano, r.numero, r.v, r.other) for r in changes.upsert(old, new, ("ano", "numero")).collect()}
    assert got == {(None, 1, "d", "k"), (2020, 1, "b", "k"), (2021, 1, "e", None)}
    assert changes.upsert(old, new.limit(0), ("ano", "numero")).count() == 2


def test_pending_changes(spark):
    log = spark.createDataFrame([(1, "questoes", "1", "a"), (2, "questoes", "2", "b"), (3, "questoes", "1", "c"), (4, "imagens", "x", "d"), (5, "frases", None, "e"), (6, "frases", None, "f")], "seq int, kind string, key string, payload string")
    assert {r.kind: r.n for r in changes.pending_counts(log).collect()} == {"questoes": 2, "imagens": 1, "frases": 2}
    results = spark.createDataFrame([(3, True), (2, False), (5, True)], "seq int, ok boolean")
    assert sorted(r.seq for r in changes.after_flush(log, results).collect()) == [2, 4, 6]


def test_retry_versions(spark):
    state = spark.createDataFrame([("u", 1, 1, False, False), ("u", 2, 3, True, True), ("u", 3, 3, True, True), ("u", 4, 1, True, True), ("v", 1, None, None, None)], "usuario_id string, questao_id long, versao_tt int, acertou boolean, zerada boolean")
    told = spark.createDataFrame([("u", 1, True), ("u", 2, None), ("u", 4, True), ("u", 4, False), ("w", 9, True)], "usuario_id string, questao_id long, acertou boolean")
    got = {(r.usuario_id, r.questao_id): (r.versao_tt, r.acertou, r.zerada) for r in review.next_version(state, told).collect()}
    assert got == {("u", 1): (1, True, True), ("u", 2): (4, False, False), ("u", 3): (3, True, True), ("u", 4): (4, False, False), ("v", 1): (None, False, False)}


def test_clicks_leave_the_last_run(spark):
    clicks = spark.createDataFrame([(1, 1, c, i, datetime(2024, 1, 1)) for i, c in enumerate("AABBB")] + [(2, 1, c, i, datetime(2024, 1, 1)) for i, c in enumerate("AA")], "user_id long, questao long, letra string, event_id long, ts timestamp")
    assert {r.user_id: r.resposta for r in grading.chosen(clicks).collect()} == {1: "B", 2: None}
    assert {(r.user_id, r.letra) for r in grading.eliminated(clicks).collect()} == {(1, "B")}


def test_json_files(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none*.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_json_strict(spark, str(tmp_path / "none.json"))
    (tmp_path / "enem_2020.json").write_text('[{"numero": 1, "ano": 2020, "enunciado": ["é"]}, {"numero": 2}]', encoding="utf-8")
    (tmp_path / "enem_2021.json").write_text("{broken", encoding="utf-8")
    got = files.read_json(spark, str(tmp_path / "enem_*.json"))
    assert sorted((r.numero, r.ano_arquivo) for r in got.collect()) == [(1, 2020), (2, 2020)]
    assert got.count() == 2
    assert files.bad_files(spark, str(tmp_path / "enem_*.json")).count() == 1
    assert sorted(r.nome for r in files.list_files(spark, str(tmp_path), ".json").collect()) == ["enem_2020.json", "enem_2021.json"]


def test_pages_report_what_fails(spark):
    def reader(content):
        if content == b"bad":
            raise ValueError("no document")
        return iter([("one", None), ("two", None)])

    found = files.pages(spark.createDataFrame([("a", b"ok"), ("b", b"bad")], "path string, content binary"), reader)
    got = {r.path: r for r in files.page_counts(found).collect()}
    assert got["a"].paginas == 2 and got["a"].erro is None and got["b"].erro == "no document"


def test_tables_are_partitioned_and_swapped(spark, bank, tmp_path):
    at = str(tmp_path / "bank")
    sinks.write_table(bank, at)
    back = spark.read.parquet(at)
    assert back.count() == 5
    assert "PartitionFilters: [isnotnull(fonte" in back.where("fonte = 'UFT'")._jdf.queryExecution().toString()
    sinks.replace_table(back.where("id > 2"), at)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [3, 4, 5]


def test_only_bad_rows_are_reported(spark):
    def open_sink():
        def put(rows):
            if any(r["id"] == 7 for r in rows):
                raise ValueError("refused")

        return put

    rows = spark.range(20).coalesce(1)
    got = {r.chave: r.ok for r in sinks.send(rows, "id", open_sink, batch=5).collect()}
    assert len(got) == 20 and [k for k, ok in got.items() if not ok] == ["7"]
    assert all(r.ok for r in sinks.send(rows, "id", open_sink, dry_run=True).collect())


def test_objects_stay_without_force(spark):
    old = spark.createDataFrame([("a", b"1"), ("b", b"1")], "path string, content binary")
    new = spark.createDataFrame([("b", b"2"), ("c", b"2")], "path string, content binary")
    assert {r.path: bytes(r.content) for r in sinks.put_objects(old, new).collect()} == {"a": b"1", "b": b"2", "c": b"2"}
    assert {r.path: bytes(r.content) for r in sinks.put_objects(old, new, force=False).collect()} == {"a": b"1", "b": b"1", "c": b"2"}


def test_patience_with_a_limited_model():
    waits, tries = [], iter([models.Limited(), models.Limited(), "done"])

    def model(question):
        step = next(tries)
        if isinstance(step, Exception):
            raise step
        return step

    assert models.patient(model, tries=3, sleep=waits.append)("q") == "done"
    assert [w for w in waits if w] == [65, 120]


def test_blank_sheets_are_refused():
    from certame.operators import sheets

    fills, error = sheets.read_sheet(b"no image", 5)
    assert error and not fills
    assert len(sheets.bubble_centres(15)) == 15 and np.asarray(sheets.bubble_centres(45)).max() < 1123
