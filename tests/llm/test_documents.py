"""Near-duplicates, repeated passages, packing, token files and scores of documents against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from certame.llm import decontamination, katz, neardup, packing, suffix_dedup, token_files, tokens
from certame.llm.kernels import text_buffers  # noqa: F401  imported once on the driver
from certame.llm.queries import QUERIES
from tests.llm import brute

DOCS = "doc_id long, text string"
#: Extra columns whose names the operators use themselves.
EXTRA = "doc_id long, text string, value string, component string, part int, key string, ids string, rank int, a int, b int, n long, ranges string"


def frame(spark, rows, extra=False):
    return spark.createDataFrame([(*r, *["x", "y", 1, "k", "i", 2, 3, 4, 5, "r"]) for r in rows], EXTRA) if extra else spark.createDataFrame(rows, DOCS)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_texts() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    shared = sentence(rng, 60)
    near = shared.split()
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "three short words"), (5, "Three  SHORT words"), (6, long), (7, long + " and an end"), (8, shared), (9, " ".join([*near[:30], "odd", *near[31:]])),
        (10, shared.upper()), (11, "a " * 500), (12, "a " * 300), (13, "Ünï çødé " * 40), (14, "Ünï çødé " * 41), (15, f"{sentence(rng, 40)} {shared} {sentence(rng, 40)}"), (16, "z" * 100), (17, "z" * 350), (18, "z" * 99), (20, "x y z  w\x1c v"), (21, "<|endoftext|> it's a  test\r\n\r\n  ok"),
    ]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates_of_documents(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op3_near_duplicates"](spark, sf_dir).collect()}
    assert got == brute.near_duplicates(documents)


@pytest.mark.parametrize("extra", [False, True])
def test_near_duplicates_of_edge_cases(spark, extra):
    rows = edge_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows, extra)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_at_the_threshold(spark):
    """Chains of sets that share just enough, or just too little."""
    rng = random.Random(1)
    rows = []
    for chain in range(12):
        w = sentence(rng, 200).split()
        for k in range(8):
            cut = w.copy()
            for _ in range(rng.randint(0, 7)):
                cut[rng.randrange(len(cut))] = f"n{rng.random()}"
            rows.append((chain * 10 + k, " ".join(cut)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_beyond_a_groups_centre(spark):
    """One group whose members lie around the threshold from its centre, some linked by edits that they share, some by what both leave out."""
    rng = random.Random(8)
    base, odd = sentence(rng, 120).split(), sentence(rng, 3).split()
    rows = []
    for k in range(160):
        w = base[: rng.choice((120, 120, 100, 86))]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w) // 8) * 8] = rng.choice(odd)
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)
    assert len({c for _, c, _ in got.values()}) > 1


def test_near_duplicates_of_repeated_rows_and_none(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "One two three four five six"), (None, "one two three four five six")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_suffix_dedup_of_documents(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, sf_dir).collect()}
    assert got == brute.suffix_dedup(documents)


@pytest.mark.parametrize("extra", [False, True])
def test_suffix_dedup_of_edge_cases(spark, extra):
    rows = edge_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, rows, extra)).collect()}
    assert got == brute.suffix_dedup(rows)


def test_suffix_dedup_without_ids_and_rows(spark):
    text = "q" * 150
    got = sorted(((r.doc_id is None, r.n_removed) for r in suffix_dedup.suffix_dedup(frame(spark, [(None, text), (None, text)])).collect()))
    assert got == [(True, 0), (True, 0)]
    assert suffix_dedup.suffix_dedup(frame(spark, [])).collect() == []


def test_suffix_dedup_of_repeated_rows(spark):
    """Equal rows take nothing from each other; rows of one doc_id with other texts are cut each by what starts earlier."""
    rng = random.Random(31)
    a, b = sentence(rng, 50), sentence(rng, 50)
    rows = [(1, a), (1, a), (2, f"{a} {b}"), (2, b), (3, b), (None, a)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    n, m = len(a), len(b)
    assert got == sorted([(0, n, 0), (1, n, 0), (1, n, 0), (2, n + 1 + m, n + m), (2, m, 0), (3, m, m)]) or got == sorted([(0, n, 0), (1, n, 0), (1, n, 0), (2, n + 1 + m, n + m + 1), (2, m, 0), (3, m, m)])


@pytest.mark.parametrize("length", [7, 20, 400])
def test_suffix_dedup_of_other_lengths(spark, length):
    rng = random.Random(length)
    passage = sentence(rng, 220)
    rows = [(k, f"{sentence(rng, 40)} {passage[rng.randint(0, 300) :]} {sentence(rng, 40)}") for k in range(12)] + [(20, None), (21, "a" * 900)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, rows), length).collect()}
    assert got == brute.suffix_dedup(rows, length)
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(frame(spark, rows), 10, 20)


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    """A passage in many different surroundings, dealt window by window, and in small batches."""
    rng = random.Random(33)
    passage = sentence(rng, 25)
    rows = [(k, f"{sentence(rng, 30)} {passage} {sentence(rng, 30)}") for k in range(60)] + [(100, passage * 3)]
    for name, value in (("HOT", 3), ("BATCH_WINDOWS", 64), ("BATCH_ANCHORS", 50)):
        monkeypatch.setattr(suffix_dedup, name, value)
    for none in (True, False):
        if none:
            monkeypatch.setattr(suffix_dedup, "frequent_anchors", lambda *_: np.zeros(0, np.int64))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
        assert got == brute.suffix_dedup(rows)
        monkeypatch.undo()
    cut = suffix_dedup._sort_windows
    windows = sorted(passage[i : i + 100] for i in range(len(passage) - 99)) * 5
    made = suffix_dedup._record(suffix_dedup.WINDOW, {"key": np.sort(np.arange(len(windows)) % 2), "doc_id": np.arange(len(windows)), "sub": np.zeros(len(windows)), "start": np.zeros(len(windows)), "n": np.ones(len(windows)), "off": np.zeros(len(windows)), "bytes": pa.array([w.encode() for w in windows])})
    first = {}
    want = {d for d, (k, w) in enumerate(zip(made.column(0).to_pylist(), windows, strict=True)) if first.setdefault((k, w), d) != d}
    assert {d for b in cut(iter([made.slice(i, 7) for i in range(0, len(windows), 7)]), 100) for d in b.column(0).to_pylist()} == want


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that collide under every odd multiplier modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_built_to_collide(spark, n):
    """Each is a text of its own to every operator."""
    x, y = thue_morse(n)
    rows = [(1, x), (2, y), (3, f"{x} {y} {x}"), (4, f"{y} {x} {y}"), (5, "other words")]
    ids = ids_of(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()} == brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()} == brute.suffix_dedup(rows)
    check_packing(packing.pack(frame(spark, rows)).collect(), ids)
    assert {r.doc_id: r.ids for r in token_files.tokenised(frame(spark, rows)).collect()} == {d: [*i, 2] for d, i in ids.items()}
    items = spark.createDataFrame([(9, f"{x} {y} {y} {x} {y} and more {x} {x} {y} here"), (8, f"some {x} {x} item of {y} {y} words {y} that {x} {y} hold")], "item_id long, text string")
    leaked = [*rows, (6, f"it reads some {x} {x} item of {y} {y} words {y} that {x} {y} hold"), (7, f"it reads some {y} {y} item of {x} {x} words {x} that {y} {x} hold"), (8, f"{x} " * 9)]
    found = {r.doc_id: (r.contaminated, r.item_id) for r in decontamination.contamination(frame(spark, leaked), items).collect()}
    assert {d: i for d, (hit, i) in found.items() if hit} == {6: 8}
    want = brute.base_scores(rows)
    for r in katz.score(frame(spark, rows)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]


def test_repeats_are_cut_and_columns_stay(spark):
    rng = random.Random(2)
    passage = sentence(rng, 60)
    docs = spark.createDataFrame([(2, f"é {passage} tail", "de", 9, 7), (1, f"{passage} head", None, 1, 8), (3, None, "fr", None, 9)], "doc_id long, text string, lang string, n_chars long, ranges int")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1].text == f"{passage} head" and got[1].ranges == 8
    assert passage not in got[2].text and got[2].text.endswith("tail") and got[2].n_chars == len(got[2].text) and got[2].lang == "de"
    assert got[3].text is None and got[3].lang == "fr"


def test_half_a_digest_settles_nothing(spark, monkeypatch):
    """Surroundings whose digests agree in one half only are told apart: here both halves name different stretches, and one half is the same for all."""
    rng = random.Random(8)
    rows = [(k, f"{sentence(rng, 40)} {sentence(random.Random(k % 3), 30)} {sentence(rng, 10)}") for k in range(12)]
    plain = suffix_dedup._digests
    for half in (0, 1):
        monkeypatch.setattr(suffix_dedup, "_digests", lambda *a, half=half: tuple(np.zeros_like(d) if k == half else d for k, d in enumerate(plain(*a))))
        batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([0] * len(rows)), pa.array([r[1] for r in rows])], ["doc_id", "sub", "text"])
        found = pa.Table.from_batches(suffix_dedup._find_anchors(iter([batch]), 100, 32, np.zeros(0, np.int64)))
        monkeypatch.setattr(suffix_dedup, "_digests", plain)
        whole = pa.Table.from_batches(suffix_dedup._find_anchors(iter([batch]), 100, 32, np.zeros(0, np.int64)))
        settled = lambda t: sorted(zip(t["doc_id"].to_pylist(), t["place"].to_pylist(), t["key"].is_null().to_pylist(), strict=True))
        assert settled(found) == settled(whole) and any(s[2] for s in settled(whole))


def test_collisions_are_held_against_bytes():
    """Windows of one group whose hashes agree but whose bytes do not."""
    data = np.frombuffer(b"a" * 20 + b"b" * 20, np.uint8)
    at, group, doc, start = np.array([0, 20, 5]), np.array([1, 1, 1]), np.array([1, 2, 3]), np.zeros(3, np.int64)
    real = suffix_dedup.Suffixes.common
    try:
        suffix_dedup.Suffixes.common = lambda self, x, y: np.full(len(x), self.length)
        assert suffix_dedup.repeated_windows(data, at, group, doc, start, 10).tolist() == [2]
    finally:
        suffix_dedup.Suffixes.common = real


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return t


def ids_of(rows):
    t = tokenizer()
    return {d: t.encode(text or "", add_special_tokens=False).ids for d, text in rows}


def check_packing(got, ids, most=1024):
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at, whole = 0, [*ids[d], 0]
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) and r.ids_crc32 == brute.crc(whole[at : at + r.length])
            at += r.length
        assert at == len(whole)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    return len(sequences)


def test_packing_of_documents(spark, sf_dir, documents):
    ids = ids_of(documents)
    n = check_packing(QUERIES["op5_packing"](spark, sf_dir).collect(), ids)
    assert n * 1024 <= 1.03 * sum(len(x) + 1 for x in ids.values()) + 8 * 1024


def test_packing_of_edge_cases(spark):
    rows = edge_texts()
    got = packing.pack(frame(spark, rows, True)).collect()
    check_packing(got, ids_of(rows))
    assert all(len(r.ids) == r.length for r in got)
    assert packing.pack(frame(spark, [])).collect() == []


def test_windows_rise_with_capacity():
    assert sorted(map(len, packing.windows([6, 6, 6], 10))) == [1, 1, 1]
    dealt = packing.difference([8, 7, 6, 5, 4], 2)
    assert abs(sum([8, 7, 6, 5, 4][i] for i in dealt[0]) - 15) <= 1
    assert packing.windows([], 10) == []


def test_token_files_of_documents(spark, sf_dir, documents):
    ids, at, want = ids_of(documents), 0, []
    for d, _ in sorted(documents):
        whole = [*ids[d], 2]
        want.append((d, at, len(whole), brute.crc(whole)))
        at += len(whole)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_files"](spark, sf_dir).collect())
    assert got == want


def test_token_files_of_edge_cases(spark, tmp_path):
    rows = edge_texts()
    ids = ids_of(rows)
    token_files.write_token_files(frame(spark, rows, True), str(tmp_path / "t"), partitions=3)
    back = token_files.read_token_files(spark, str(tmp_path / "t"))
    assert {r.doc_id: r.ids for r in back.collect()} == {d: [*x, 2] for d, x in ids.items()}
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in back.where("doc_id = 7")._jdf.queryExecution().toString()
    starts = [r.start for r in token_files.token_positions(spark, str(tmp_path / "t")).orderBy("doc_id").collect()]
    assert starts == np.cumsum([0, *[len(ids[d]) + 1 for d in sorted(ids)]])[:-1].tolist()
    token_files.write_token_files(frame(spark, []), str(tmp_path / "none"))
    assert token_files.token_positions(spark, str(tmp_path / "none")).collect() == []


def test_tokens_of_odd_texts():
    """Pieces give the ids that the tokenizer gives to whole texts."""
    rng, t = random.Random(3), tokenizer()
    letters = ["a", "B", "é", "ß", "中", "🙂", "1", "23", "'s", "'ll", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", ".", "!!", "<|endoftext|>", "́", "\x00"]
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, at = tokens.encoder(tokens.default_tokenizer()).encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_scores_of_documents(spark, sf_dir, documents):
    want = brute.base_scores(documents)
    model = brute.Katz(documents, katz.LEAST_COUNT, katz.DISCOUNTED)
    got = QUERIES["op6_katz_score"](spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    for r in got[:60]:
        assert r.score == pytest.approx(model.score(dict(documents)[r.doc_id]), rel=1e-6)
    tested = [r for r in got if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_scores_of_edge_cases(spark):
    rows = edge_texts()
    want, model = brute.base_scores(rows), brute.Katz(rows, katz.LEAST_COUNT, katz.DISCOUNTED)
    for r in katz.score(frame(spark, rows, True)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(model.score(dict(rows)[r.doc_id]), rel=1e-6, abs=1e-9)
    assert katz.score(frame(spark, [])).collect() == []
    one = katz.score(frame(spark, [(None, "a b"), (None, "a b")])).collect()
    assert len(one) == 2 and all(r.doc_id is None and r.n_tokens == 3 for r in one)


def test_bigrams_seen_once_are_in_the_model(spark, documents):
    """Held against a model that keeps them, whatever the operator's own constant says."""
    model, texts = brute.Katz(documents, 1, katz.DISCOUNTED), dict(documents)
    assert sum(c == 1 for c in model.pairs.values()) > len(model.pairs) / 2
    for r in katz.score(frame(spark, documents)).where("held_out").limit(20).collect():
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-6)


def test_probabilities_add_up():
    """After every history the words and the unseen share make one."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a b c d e f g h i j k l m n o p q".split()) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    model = brute.Katz(rows, 2, 5)
    for h in model.after:
        assert sum(model.prob(h, w) for w in model.uni) + model.prob(h, "never") == pytest.approx(1.0)


def test_top_search_and_scores_have_one_row_each(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in QUERIES["op7_top_search"](spark, sf_dir).collect()}
    assert got == brute.top_scores(vectors)


def test_shared_words_are_counted_once(spark):
    docs = frame(spark, [(i, "same words here") for i in range(50)])
    assert katz.score(docs).agg(F.countDistinct("score")).first()[0] == 1
