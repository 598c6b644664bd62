"""Nulls, repeated rows, empty tables and clashing names, where the other tests leave them out."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from certame.llm import katz, neardup, packing, token_files, url_filter
from certame.llm.kernels import shingle_sets, word_hashes

ROWS = [(None, "no id here"), (None, "no id here"), (3, "one two three " * 500), (3, "one two three " * 500), (3, "other text"), (1, None), (2, ""), (2, ""), (9, "é" * 3000)]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, start int, length int, sequence_id string, ids string, n_tokens int, part string, w long, h long, found int, kept int, key int, around int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *[1] * 2, "x", "y", 2, "p", *[5] * 6) for r in rows], SHAPE)


def test_packing_of_nulls_and_repeats(spark):
    pieces = packing.pack(clashing(spark, ROWS)).collect()
    ids = {(d, t): packing_ids(t) for d, t in ROWS}
    assert Counter(d for d, _ in ROWS) == Counter(r.doc_id for r in pieces if r.start == 0)
    for doc in {d for d, _ in ROWS}:
        assert sum(r.length for r in pieces if r.doc_id == doc) == sum(len(ids[x]) for x in ROWS if x[0] == doc)
    windows = {}
    for r in pieces:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert packing.pack(clashing(spark, [])).collect() == []


def packing_ids(text):
    from tokenizers import Tokenizer

    from certame.llm.tokens import default_tokenizer

    return [*Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 0]


def test_token_files_of_nulls_and_repeats(spark):
    got = token_files.token_table(clashing(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 1, 2, 2, 3, 3, 3, 9]
    assert token_files.token_table(clashing(spark, [])).collect() == []


def test_files_grow_with_rows_and_are_skipped(spark, monkeypatch, tmp_path):
    """A file for some rows; a lookup by doc_id reads the rows of its group alone."""
    monkeypatch.setattr(token_files, "FILE_ROWS", 3000)
    docs = spark.range(30_000).selectExpr("id as doc_id", "'a b c' as text")
    token_files.write_token_files(docs, str(tmp_path / "f"))
    assert len(list((tmp_path / "f").glob("*.orc"))) == 10
    found = token_files.read_token_files(spark, str(tmp_path / "f")).where("doc_id = 12345")
    assert [r.doc_id for r in found.collect()] == [12345]
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() <= 4096  # the rows of one index group, read in batches, of 30,000


def test_scores_of_nulls_and_repeats(spark):
    got = katz.score(clashing(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    assert len({(r.doc_id, r.n_tokens, r.score) for r in got if r.doc_id == 3}) == 2
    assert katz.score(clashing(spark, [])).collect() == []
    held = katz.score(clashing(spark, [(d, "a b c") for d in range(60) if katz.held_out(d)])).collect()
    assert held and all(r.train_tokens == 0 and r.n_known == 0 for r in held)


def test_pages_that_repeat_and_tie(spark):
    """Repeated pages count each; a host that trust and distrust reach alike gets one verdict for all its pages."""
    page = lambda k, url, *to: (k, url, "".join(f'<a href="{t}">x</a>' for t in to))
    rows = [page(1, "http://a.example.com/en/7/x", "http://tie.test/p"), page(1, "http://a.example.com/en/7/x", "http://tie.test/p"), page(2, "http://tie.test/p", "http://b.com/en/z"), page(2, "http://tie.test/p", "http://b.com/en/z"), page(3, "http://b.com/en/z"), page(4, "http://tie.test/q"), page(None, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert len({r.verdict for r in got if r.host == "tie.test"}) == 1 and all(r.verdict in ("allow", "block") for r in got)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    words = " ".join(f"word{k}" for k in range(120))
    rows = [(1, words), (2, f"{words} and one more"), (3, None), (4, ""), (None, words), (5, "the house by the river " * 4000), (6, words.replace("word", "w"))]
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {r.sequence_id for r in out.collect()} <= {"x"}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.where("doc_id is not null"), sf_dir).collect()} == {1, 3, 4, 5, 6}


def test_centre_of_copies_with_one_sketch(spark, monkeypatch):
    """Copies whose tails miss the sketch tie; the text that all of them hold is the centre, whatever its doc_id, and one round of meetings is enough."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=8))

    def hashes(words):
        text = " ".join(words).encode()
        return next(shingle_sets(*word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)])), neardup.WIDTH))

    base = [word() for _ in range(300)]
    bound = hashes(base)[neardup.SKETCH - 1]

    def tail():
        out = base[-4:]
        while len(out) < 64:
            out.append(word())
            if hashes(out[-5:])[0] <= bound:
                out.pop()
        return out[4:]

    rows = [(99, " ".join(base)), *((k, " ".join(base + tail())) for k in range(8))]
    met = []

    def counted(df, name, staged=neardup.staged):
        out = staged(df, name)
        if name == "pairs":
            met.append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and met == [8]
