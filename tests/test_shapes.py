"""Mixed items, facet bitmaps, reports, and questions from papers: small cases by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from certame.functions import variants
from certame.operators import exams, extract, facet_index, inventory, reports, search


def first(spark, kind, given, make):
    return spark.createDataFrame([(given,)], f"c {kind}").select(make(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    ("saved", "want"),
    [
        ('"a.png"', [("a.png", "antes_1", None)]),
        ('["a.png", {"path": "b.png", "posicao": "apos_ultimo", "supabase_url": "u"}]', [("a.png", "antes_1", None), ("b.png", "apos_ultimo", "u")]),
        ('{"path": "c", "posicao": "", "n": [1]}', [("c", "antes_1", None)]),
        ('[7, null, {}, {"path": null}, true, ["x"]]', []),
        ("null", []), ("[]", []), (None, []), ("12", []),
    ],
)
def test_images_of_any_shape(spark, saved, want):
    assert list(map(tuple, first(spark, "string", saved, lambda c: variants.images(F.parse_json(c))))) == want


def test_files_of_mixed_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["x.png", {"path": "y.png"}, 3]))
    (tmp_path / "b.json").write_text(json.dumps([{"path": "z.png", "posicao": "entre_1_2"}]))
    rows = variants.read_items(spark, str(tmp_path))
    found = rows.select(variants.images(F.col(variants.ITEM)).alias("i")).select(F.explode("i").alias("i")).select("i.*")
    assert sorted((r.path, r.posicao) for r in found.collect()) == [("x.png", "antes_1"), ("y.png", "antes_1"), ("z.png", "entre_1_2")]


def test_shape_of_a_column(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.parse_json("props").alias("p"))
    assert variants.shape(events, "p").first().schema == "OBJECT<k: BIGINT>"


FACETS = "id long, a string, b int, c string"


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(k * 9000, f"a{k % 3}", None if k % 7 == 0 else k % 4, "x" if k % 5 else None) for k in range(200)]
    return spark.createDataFrame(rows + rows[:20] + [(None, "a0", 1, "x")], FACETS)


@pytest.mark.parametrize("chosen", [{}, {"a": ["a1"]}, {"a": ["a1", "a2"], "b": [1, 3]}, {"a": ["a0"], "b": [2], "c": ["x"]}, {"a": ["none"]}, {"a": ["none"], "b": [1]}, {"a": [], "b": [0]}])
def test_facets_under_choice(bank, chosen):
    rows = [r for r in bank.dropDuplicates().collect() if r.id is not None]
    want = {}
    for facet in ("a", "b", "c"):
        for r in rows:
            if r[facet] is not None and all(r[f] in v for f, v in chosen.items() if v and f != facet):
                want[facet, str(r[facet])] = want.get((facet, str(r[facet])), 0) + 1
    got = facet_index.counts(facet_index.build(bank, ("a", "b", "c")), chosen)
    assert {(r.faceta, r.valor): r.total for r in got.collect()} == want


def test_reports_of_nothing_and_of_nulls(spark, tmp_path):
    shape = "nome string, tipo string, evento string, turno string, nome_pad string, dup_de string"
    reports.write(reports.report(spark.createDataFrame([], shape)), str(tmp_path / "none"))
    rows = [("p1", "prova", "E1", "MANHA", "same", None), ("p2", "prova", "E1", "TARDE", None, None), ("p3", "prova", None, None, None, None), ("g1", "gabarito", "E1", None, "same", None), ("g2", "gabarito", "E1", "MANHA", None, None), ("g9", "gabarito", "E9", None, None, None), ("p1 (1)", "prova", "E1", "MANHA", None, "p1"), ("?", None, None, None, None, None)]
    path = str(tmp_path / "some")
    reports.write(reports.report(spark.createDataFrame(rows, shape)), path)
    assert [tuple(r) for r in reports.read(spark, path, "associacoes").collect()] == [("p1", "g2", "E1", "MANHA"), ("p2", "g1", "E1", "TARDE"), ("p3", None, None, None)]
    assert [tuple(r) for r in reports.read(spark, path, "inconsistencias").collect()] == [("g1", "nome de destino repetido"), ("g9", "gabarito sem prova"), ("p1", "nome de destino repetido"), ("p3", "prova sem gabarito")]
    assert [r.nome for r in reports.read(spark, path, "nao_identificados").collect()] == ["?"] and [tuple(r) for r in reports.read(spark, path, "duplicatas").collect()] == [("p1 (1)", "p1")]
    assert {r.tipo: r.arquivos for r in reports.read(spark, path, "resumo").collect()} == {"prova": 4, "gabarito": 3, None: 1}
    assert reports.read(spark, path, "material_apoio").collect() == []




@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Stem one\nstem two\nAsk?\nA x\nB y\nC z\nD w", (["Stem one", "stem two"], "Ask?", "x y z w")),
        ("A x\nB y\nC z\nD w", ([], "", "x y z w")),
        ("Ask\nA x\nB y\nC z", None),
        ("Ask\nA 1\nB 2\nC 3\nD 4\nmore\nA 5\nB 6\nC 7\nD 8", (["Ask", "A 1", "B 2", "C 3", "D 4"], "more", "5 6 7 8")),  # of equal runs the later
        ("Ask\nA 1\nB 2\nC 3\nD 4\nE 5\nA 6\nB 7\nC 8\nD 9", ([], "Ask", "1 2 3 4 5")),  # the longest
        ("Ask\nA 1\nA 2\nC no\nB 3\nC 4\nB no\nD 5", (["Ask"], "A 1", "2 3 4 5")),  # marks out of turn are passed over
        ("Ask\nA) 1\nl1\nl2\nl3\nl4\nl5\nl6\nB. 2\n\nno\nC  3\nD\t4", ([], "Ask", "1 l1 l2 l3 l4 l5|2|3|4")),
        ("", None), (None, None),
    ],
)
def test_question_blocks(spark, text, want):
    got = first(spark, "string", text, extract.parse_block)
    if want is None:
        assert got is None
    else:
        told = list(got.alternativas.values())
        assert (got.enunciado, got.comando) == (want[0], want[1]) and told == want[2].split("|" if "|" in want[2] else " ")
        assert "".join(got.alternativas) == "ABCDE"[: len(told)]


def test_papers_to_rows(spark):
    """Text where it parses, a reader for the other pages, keys joined, rows as the table has them."""
    good = "Ciências da Natureza e suas Tecnologias " + "texto " * 40 + "\nQuestão 1\nUm\nPergunta?\nA a\nB b\nC c\nD d\nE e\nQuestão 2\nDois\nA a\nB b\nC c\nD d\n"
    pages = spark.createDataFrame([("p", 0, good), ("p", 1, "pouco"), ("q", 0, "x" * 400)], "prova string, page int, texto string")
    seen = lambda rest: rest.select("prova", "page", F.lit(7).alias("numero"), F.array(F.lit("lido")).alias("enunciado"), F.map_from_arrays(F.array(F.lit("A")), F.array(F.lit("z"))).alias("alternativas"))
    read = extract.questions_of_papers(pages, ("prova", "page"), seen)
    assert sorted((r.prova, r.page, r.numero) for r in read.collect()) == [("p", 0, 1), ("p", 0, 2), ("p", 1, 7), ("q", 0, 7)]
    assert sorted((r.prova, r.numero) for r in extract.questions_of_papers(pages, ("prova", "page")).collect()) == [("p", 1), ("p", 2)]
    keys = spark.createDataFrame([("p", 0, "01 C  02 B  03 A  04 A  05 E")], "prova string, page int, texto string")
    rows = {(r.numero, r.fonte): r for r in extract.papers_pipeline(pages, ("prova",), keys, "UFT", "PROVA").collect()}
    assert rows[1, "UFT"].gabarito == "C" and rows[1, "UFT"].comando == "Pergunta?" and rows[1, "UFT"].enunciado == ["Um"] and rows[2, "UFT"].tipo == "PROVA" and not rows[2, "UFT"].anulada and rows[1, "UFT"].revisado is False


def test_options_from_scans(spark):
    """The first page whose block has three options."""
    pages = spark.createDataFrame([("p", 1, "QUESTAO 5\nstem\nA um\nB dois"), ("p", 2, "Questão 5 stem\nA) um\nmais\nB) dois\nC) tres\nQuestão 6\nA x"), ("p", 3, "Questão 5\nA 9\nB 9\nC 9")], "prova string, page int, texto string")
    wanted = spark.createDataFrame([("p", 5), ("p", 6), ("q", 5)], "prova string, numero int")
    assert [(r.prova, r.numero, r.alternativas) for r in extract.options_by_ocr(pages, wanted, ("prova",)).collect()] == [("p", 5, {"A": "um mais", "B": "dois", "C": "tres"})]


def test_starts_of_questions_and_options(spark):
    spans = "array<struct<text:string,flags:int>>"
    starts = lambda given, year: first(spark, spans, given, lambda c: extract.question_start(c, F.lit(year)))
    assert [starts([("QUESTÃO 12 ", 0)], 2020), starts([("Questão", 0), (" 7 ", 0)], 2009), starts([("Questão", 0), ("7", 0)], 2010), starts([], 2020), starts([("questão 1", 0)], 2020)] == [12, 7, None, None, None]
    option = lambda given: first(spark, spans, given, extract.option_start)
    assert [option([(" B ", 16), ("x", 0)]), option([("B", 0)]), option([("B", 4)]), option([("BC", 16)]), option([])] == ["B", None, "B", None, None]


def test_blocks_of_a_web_page(spark):
    html = "<html><style>p{}</style><h1>Ti<b>tu</b>lo &amp; x</h1><ul><li>um<li>dois</ul><p>par<script>var p='<p>no</p>'</script>á</p>fora<p></p></html>"
    found = first(spark, "string", html, extract.html_blocks)
    assert [(b.x0, ["".join(s.text for s in x.spans) for x in b.lines]) for b in found] == [(0.0, ["Titulo & x"]), (0.0, ["um"]), (0.0, ["dois"]), (320.0, ["pará"]), (320.0, [""])]
    assert [s.text for s in found[0].lines[0].spans if s.flags] == ["tu"]


def test_new_mocks(spark):
    """M2, O8."""
    pool = spark.range(30)
    made = exams.create(pool, "u", 5, "s", F.lit("2024-01-01").cast("timestamp")).first()
    assert made.total_questoes == 5 == len(set(made.questoes_ids)) and made.status == "em_andamento" and exams.create(pool, "u", None, "s", F.current_timestamp()).first().total_questoes == 10
    with pytest.raises(Exception, match="no question fits"):
        exams.create(pool.limit(0), "u", 5, "s", F.current_timestamp()).collect()


def test_one_match_and_first_names(spark):
    """P20, S16, S2."""
    rows = spark.range(3)
    assert inventory.only_one(rows.where("id = 1")).first().id == 1
    for none_or_more in ("id = 9", "id > 0"):
        with pytest.raises(Exception, match="not exactly one"):
            inventory.only_one(rows.where(none_or_more)).collect()
    files = spark.createDataFrame([("f", "b.png"), ("f", "c.png"), ("g", "c.png"), ("g", "other")], "pasta string, nome string")
    wanted = spark.createDataFrame([("x", 1, "a.png"), ("x", 2, "b.png"), ("x", 3, "c.png")], "alvo string, ordem int, nome string")
    assert sorted(map(tuple, inventory.first_existing(wanted, files).collect())) == [("f", "x", "b.png"), ("g", "x", "c.png")]
    assert search.question(rows, 2).collect()[0].id == 2 and search.question(rows, 7).collect() == []
