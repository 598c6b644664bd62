"""The trigram index finds what a scan finds, and opens the folders of its candidates only."""

from __future__ import annotations

import re

import pytest

from certame.operators import text_index

TEXTS = ["A casa Amarela", "casas", "CASA", "ab", "", None, "50% de_x", "São Paulo é 𝄞𝄞 longe", "casa casa casa", "amare\nla", "x" * 5000 + "fim", "ççç"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(2, "CASA")], "doc_id long, text string")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    made = text_index.build(rows.where("doc_id < 6"), str(tmp_path_factory.mktemp("index") / "i"), "doc_id", "text")
    made.add(rows.where("doc_id >= 6"), "text")
    return made


@pytest.mark.parametrize("terms", [["casa"], ["CASA A", "fim", "50%"], ["a"], ["e\nl", "ab", "é 𝄞"], ["%", "_x", "xxx"], ["nothing here"], [""], [], ["casa", "casa", "ÇÇÇ", "São"]])
def test_search_equals_a_scan(spark, rows, index, terms):
    want = sorted({(t, r.doc_id) for t in terms if t for r in rows.collect() if r.text is not None and t.lower() in r.text.lower()})
    assert sorted(map(tuple, index.search(terms).collect())) == want


def test_only_candidates_folders_are_opened(index):
    plan = index.search(["amarela"])._jdf.queryExecution().executedPlan().toString()
    opened = [m.split(",") for m in re.findall(r"PartitionFilters: \[[^\]]*?part#\d+ IN \(([\d,]+)\)", plan)]
    opened += [[m] for m in re.findall(r"PartitionFilters: \[[^\]]*?\(part#\d+ = (\d+)\)", plan)]
    assert sorted(map(len, opened)) == [1, 4]  # the folder of the one candidate, and those of the term's four rarest trigrams


def test_questions_by_any_column(spark, index):
    bank = spark.createDataFrame([(0, "p"), (2, "q"), (9, "r"), (77, "s")], "id long, nome string")
    assert sorted(r.id for r in text_index.matching(bank, index, ["casa", "amarela"]).collect()) == [0, 2]


def test_edited_texts(spark, tmp_path):
    """The last text of a key counts; a null one takes it out; keys that are added twice at once count with any of their rows."""
    made = text_index.build(spark.createDataFrame([(1, "old casa"), (2, "casa b"), (3, "casa c"), (4, "x")], "id long, t string"), str(tmp_path / "i"), "id", "t")
    made.add(spark.createDataFrame([(1, "new house"), (3, None), (4, "casa"), (4, "other"), (None, "casa")], "id long, t string"), "t")
    assert sorted(map(tuple, made.search(["casa", "house", "x", "c"]).collect())) == [("c", 2), ("c", 4), ("casa", 2), ("casa", 4), ("house", 1)]
    made.add(spark.createDataFrame([(3, "casa again")], "id long, t string"), "t")
    assert sorted(r.id for r in made.search(["casa"]).collect()) == [2, 3, 4]


def test_an_empty_index(spark, rows, tmp_path):
    index = text_index.build(rows.where("text is null"), str(tmp_path / "i"), "doc_id", "text")
    assert index.search(["casa"]).collect() == []


def test_texts_are_cut_once(spark, tmp_path, monkeypatch):
    """sizes are counted from the table of trigrams of this add(), in which a search finds them sorted."""
    cuts, grams = [], text_index.grams
    monkeypatch.setattr(text_index, "grams", lambda c: cuts.append(c) or grams(c))
    made = text_index.build(spark.createDataFrame([(1, "casas"), (2, "casa"), (3, "éàçx")], "id long, t string"), str(tmp_path / "i"), "id", "t")
    assert len(cuts) == 1
    made.add(spark.createDataFrame([(4, "casa")], "id long, t string"), "t")
    assert sorted((r.gram, r.n) for r in made._read("sizes").collect()) == [("asa", 1), ("asa", 2), ("cas", 1), ("cas", 2), ("sas", 1), ("àçx", 1), ("éàç", 1)]
