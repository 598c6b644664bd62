"""Small functions and edits of questions, one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from certame import fixed
from certame.functions import arrays, numbers, text
from certame.operators import changes, inventory, search, sheets

IMAGE = "struct<path:string,posicao:string,supabase_url:string>"


def value(spark, kind, given, make):
    return spark.createDataFrame([(given,)], f"c {kind}").select(make(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    ("kind", "given", "make", "want"),
    [
        ("string", "a b \n\n\n\n c", text.paragraphs, ["a b", "c"]),
        ("string", "um  dois   ", text.ocr_paragraphs, ["um", "dois"]),
        ("string", "   ", text.ocr_paragraphs, ["   "]),
        ("string", " a , ,b", text.search_terms, ["a", "b"]),
        ("string", "a\0b", text.strip_nul, "ab"),
        ("array<string>", ["a\0", "b"], arrays.nul_free, ["a", "b"]),
        ("string", "x", arrays.as_array, ["x"]),
        ("array<string>", [], arrays.first_or_null, None),
        ("array<string>", ["p", "q"], arrays.first_or_null, "p"),
        ("string", "2024-03-05T10:00:00", numbers.local_date, "05/03/2024"),
        ("string", "ontem", numbers.local_date, "ontem"),
        ("string", "12", numbers.to_int, 12),
        ("string", "x1", numbers.to_int, None),
        ("string", '{"gabarito": {"91": "a", "92": null, "x": "B", "93": "F"}}', arrays.key_map, {91: "A", 92: None}),
        ("string", "  ", lambda c: text.search_prompt(c, ("A",)), None),
    ],
)
def test_functions(spark, kind, given, make, want):
    assert value(spark, kind, given, make) == want


def test_data_uri(spark):
    got = value(spark, "string", "data:image/png;base64,aGk=", text.data_uri)
    assert (got.mime, bytes(got.content)) == ("image/png", b"hi")
    assert value(spark, "string", "none", text.data_uri) is None


def test_prompts(spark):
    asked = value(spark, "string", " ondas ", lambda c: text.search_prompt(c, ("Humanas", "Natureza")))
    assert '"ondas"' in asked and '"Humanas" | "Natureza"' in asked


def test_row_json_keeps_some_nulls(spark):
    df = spark.createDataFrame([(1, None, None)], "a int, b string, c string")
    assert df.select(arrays.row_json(["a", "b", "c"], ("c",)).alias("j")).first().j == '{"a":1,"c":null}'


def test_images_of_a_question(spark):
    rows = spark.createDataFrame([(1, False, [], None), (2, True, [("p", "antes_1", None), ("q", "entre_1_2", None)], {"A": "p", "B": "r"})], f"id long, tem_imagem boolean, imagens array<{IMAGE}>, imagens_alternativas map<string,string>")
    image = F.struct(F.lit("n").alias("path"), F.lit("antes_1").alias("posicao"), F.lit(None).cast("string").alias("supabase_url"))
    put = {r.id: r for r in changes.add_image(rows, F.col("id") == 1, image).collect()}
    assert put[1].tem_imagem and [i.path for i in put[1].imagens] == ["n"] and [i.path for i in put[2].imagens] == ["p", "q"]
    option = {r.id: r.imagens_alternativas for r in changes.set_option_image(rows, F.lit(True), F.lit("C"), F.lit("z")).collect()}
    assert option == {1: {"C": "z"}, 2: {"A": "p", "B": "r", "C": "z"}}
    left = {r.id: r for r in changes.drop_image(rows, F.lit("p")).collect()}
    assert [i.path for i in left[2].imagens] == ["q"] and left[2].imagens_alternativas == {"B": "r"} and left[2].tem_imagem and not left[1].tem_imagem
    assert [r.id for r in search.with_images(rows).collect()] == [2]
    assert rows.where("id = 2").select(arrays.before_images(F.col("imagens")).alias("v")).first().v[0].path == "p"


def test_recovered_options_need_three(spark):
    rows = spark.createDataFrame([(1, {"A": "x"}), (2, {"A": "x"}), (3, {"A": "x"})], "id long, alternativas map<string,string>")
    found = spark.createDataFrame([(1, {"A": "1", "B": "2", "C": "3"}), (2, {"A": "1", "B": "2"})], "id long, alternativas map<string,string>")
    assert {r.id: len(r.alternativas) for r in changes.with_recovered(rows, found).collect()} == {1: 3, 2: 1, 3: 1}


def test_new_rows_have_ids_without_gaps(spark):
    old = spark.createDataFrame([(4, "a")], "id long, titulo string")
    new = spark.createDataFrame([(4, "b"), (None, "c"), (None, "c"), (None, None)], "id long, titulo string")
    first, again = ({(r.id, r.titulo) for r in changes.insert_or_patch(old, new.repartition(n), 5).collect()} for n in (1, 3))
    assert first == again and {i for i, _ in first} == {4, 5, 6, 7} and (4, "b") in first


def test_key_of_equal_mocks(spark):
    """Equal mocks stay apart, and may hold maps."""
    mocks = spark.createDataFrame([("e", "M", {"a": 1}), ("e", "M", {"a": 1}), ("e", "T", None), ("f", "T", None)], "evento string, turno string, x map<string,int>")
    keys = spark.createDataFrame([("e", "M", "k1"), ("e", None, "k2")], "evento string, turno string, gabarito string")
    assert sorted((r.evento, r.turno, r.gabarito or "") for r in inventory.with_key(mocks, keys).collect()) == [("e", "M", "k1"), ("e", "M", "k1"), ("e", "T", "k2"), ("f", "T", "")]


def drawn_sheet(answers: list[int | None], turn: int = 0) -> bytes:
    """A photograph (binary PGM) of a filled sheet: four corner marks, and discs for the answers; lowered on the right by `turn` pixels."""
    w, h, left, top = 1000, 1400, 125, 175
    page = np.full((h + turn, w), 245, np.uint8)
    yy, xx = np.mgrid[: h + turn, :w]
    lower = lambda x: turn * x / w
    for x in (left, w - left):
        for y in (top, h - top):
            page[(np.abs(xx - x) <= 20) & (np.abs(yy - y - lower(x)) <= 20)] = 10
    for row, a in zip(sheets.bubble_centres(len(answers)).tolist(), answers, strict=True):
        if a is not None:
            x, y = left + row[a][0] * (w - 2 * left) / fixed.SHEET_WIDTH, top + row[a][1] * (h - 2 * top) / fixed.SHEET_HEIGHT
            page[(xx - x) ** 2 + (yy - y - lower(x)) ** 2 <= 81] = 10
    return b"P5\n%d %d\n255\n" % (w, h + turn) + page.tobytes()


@pytest.mark.parametrize("turn", [0, 25])
def test_sheets_are_read(spark, turn):
    """V1-V8 on drawn sheets, straight and slanted: the answers, a blank, a double mark's absence, and the summary."""
    answers = [(7 * k) % 5 if k % 9 else None for k in range(45)]
    blank = b"P5\n300 300\n255\n" + bytes([255]) * 90_000
    photos = spark.createDataFrame([("s", drawn_sheet(answers, turn), 45), ("blank", blank, 45), ("small", b"x", 45), ("many", blank, 400)], "id string, content binary, total_questoes int")
    got = {r.id: r for r in sheets.correct_sheets(photos).collect()}
    assert got["s"].sucesso and got["s"].respostas == [None if a is None else "ABCDE"[a] for a in answers]
    assert (got["s"].n_marcadas, got["s"].total_questoes) == (40, 45) and got["s"].conf_media > 0.5
    assert not any(got[k].sucesso for k in ("blank", "small", "many")) and all(got[k].erro for k in ("blank", "small", "many"))


def test_outlines():
    square = np.array([(x, y) for x in range(20) for y in range(20) if x in (0, 19) or y in (0, 19)])
    assert sorted(map(tuple, sheets.hull(square).tolist())) == [(0, 0), (0, 19), (19, 0), (19, 19)]
    assert sheets.corners(sheets.hull(square)) == 4 and sheets.corners(np.array([[0.0, 0.0], [9.0, 0.0]])) == 2
    ring = np.array([(10 + 10 * np.cos(k * np.pi / 20), 10 + 10 * np.sin(k * np.pi / 20)) for k in range(40)])
    assert sheets.corners(ring) <= 6 < sheets.corners(ring, 0.002)
