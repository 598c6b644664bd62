"""Benchmark leaks in documents by latent semantic retrieval, longest common subsequences and answers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certame.llm.kernels import LOWER, quick_hash, text_hash, text_slices, word_spans

#: Items of the benchmark that share a latent space; pieces of long items count each.
BLOCK_ITEMS = 256
#: Items of more than LONG words are sought by pieces of about PIECE words.
LONG, PIECE = 64, 32
OVERSAMPLE, POWER_STEPS = 16, 2
#: Words hash to so many document frequencies.
DF_BUCKETS = 1 << 18
SLAB = 1 << 13
#: Passages that are compared with items at a time.
COMPARED = 1 << 16
#: Blocks of words that are projected at a time.
COMPARED_BLOCKS = 512
#: Least weight of a benchmark's word, however many documents hold it, and most weight of any other word.
LEAST_WEIGHT = 1.0
#: Passages: PASSAGE_BLOCKS blocks of BLOCK_WORDS words, a passage from each block.
BLOCK_WORDS, PASSAGE_BLOCKS = 8, 4
COSINE = 0.3
#: Share of an item's words, in order, that a verbatim leak and a paraphrase hold; a paraphrase must also hold so much of the answer.
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.5
ANSWER_WORDS = 5

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
NO_WORD = np.ones(256, dtype=bool)
NO_WORD[48:58] = NO_WORD[65:91] = NO_WORD[97:123] = NO_WORD[128:] = False


@dataclass
class Spelled:
    """The words of a slice of texts, by a quick hash and, where that decides, by their bytes."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray

    def bytes(self, lo: int, hi: int) -> list[bytes]:
        return [self.low[a:b].tobytes() for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def _spelled(data: np.ndarray, at: np.ndarray) -> tuple[Spelled, np.ndarray]:
    """The words and for each row the index of its first one. Words of one spelling have one hash; those of one hash may differ, so leaks are held against the spelling."""
    low = LOWER[data]
    start, end, rows = word_spans(low, at, NO_WORD)
    return Spelled(low, start, end, quick_hash(text_hash(low), start, end)), rows


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spelled, rows = _spelled(data, at)
    return spelled.words, rows


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - 18)).astype(np.int64)


def summed(df: DataFrame, name: str, size: int) -> np.ndarray:
    """Sum of all arrays in df (slab int, part binary of float64), slab by slab; `size` numbers in all reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw)
                got[k] = got[k] + part if k in got else part
        if got:
            yield pa.record_batch([pa.array(list(got), pa.int32()), pa.array([v.tobytes() for v in got.values()], pa.binary())], ["slab", "part"])

    out = np.zeros(size)
    for k, raw in df.repartition(16, "slab").mapInArrow(add, "slab int, part binary").collect():
        part = np.frombuffer(bytes(raw))
        out[k * SLAB : k * SLAB + len(part)] += part
    return out


def _slabs(values: np.ndarray) -> pa.RecordBatch:
    flat = values.ravel()
    cuts = range(0, len(flat), SLAB)
    return pa.record_batch([pa.array([c // SLAB for c in cuts], pa.int32()), pa.array([flat[c : c + SLAB].tobytes() for c in cuts], pa.binary())], ["slab", "part"])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """For each hash bucket the number of rows of docs (doc_id, text) with a word in it; the last entry counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DF_BUCKETS + 1)
        for batch, data, at in text_slices(batches):
            words, rows = _words(data, at)
            key = np.repeat(np.arange(batch.num_rows), np.diff(rows)) * DF_BUCKETS + _bucket(words)
            total[:-1] += np.bincount(np.unique(key) % DF_BUCKETS, minlength=DF_BUCKETS)
            total[-1] += batch.num_rows
        if total[-1]:
            yield _slabs(total)

    return summed(docs.select("doc_id", "text").mapInArrow(run, "slab int, part binary"), "df", DF_BUCKETS + 1)


def weights_of(frequencies: np.ndarray) -> np.ndarray:
    return np.log((max(frequencies[-1], 1.0) + 1) / (frequencies[:-1] + 1))


def randomised_svd(rows: DataFrame, terms: int, rank: int, steps: int = POWER_STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms x rank) and singular values of the sparse matrix in rows (terms array<int>, weights array<double>).

    A seeded Gaussian range finder with power steps: a pass over the rows adds up A'(AQ) in
    every task, its sum of terms x (rank + OVERSAMPLE) numbers meets in slabs, and only that comes to the driver for the orthogonal factor.
    """
    width = max(1, min(rank + OVERSAMPLE, terms))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    spark = rows.sparkSession
    for step in range(steps + 1):
        shared = spark.sparkContext.broadcast(q)  # terms of one block of items, so bounded

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, total = shared.value, None
            for batch in batches:
                for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    t, w = np.array(t, dtype=np.int64), np.array(w)
                    total = np.zeros_like(q) if total is None else total
                    np.add.at(total, t, w[:, None] * (w @ q[t]))
            if total is not None:
                yield _slabs(total)

        z = summed(rows.select("terms", "weights").mapInArrow(run, "slab int, part binary"), "svd", terms * width).reshape(terms, width)
        shared.destroy()
        if step == steps:
            values, vectors = np.linalg.eigh(q.T @ z)
            top = np.argsort(-values)[:rank]
            return q @ vectors[:, top], np.sqrt(np.maximum(values[top], 0.0))
        q = np.linalg.qr(z)[0]
    raise AssertionError


@dataclass
class Index:
    """What a pass over the documents needs of a block of items."""

    items: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    spellings: list[tuple[list[bytes], list[bytes]]]  # of the words and of the answer's
    vocabulary: np.ndarray
    latent: np.ndarray  # of each term, times its weight
    targets: np.ndarray  # unit vectors of the items' pieces
    owners: np.ndarray  # of each piece, the item
    weights: np.ndarray
    masks: np.ndarray  # for each term and item the item's places that hold it, as bits; the last row, for other words, is empty


def _answer(text: str) -> str:
    """The last sentence; the last words of the text if it is shorter than ANSWER_WORDS."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if p.strip()]
    last = parts[-1] if parts else text
    return last if len(last.split()) >= ANSWER_WORDS else " ".join(text.split()[-ANSWER_WORDS:])


def _spell_text(text: str) -> Spelled:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _spelled(raw, np.array([0, len(raw)]))[0]


def _hash_text(text: str) -> np.ndarray:
    return _spell_text(text).words


def _pieces(n: int) -> int:
    return 1 if n <= LONG else -(-n // PIECE)


def blocks_of(items: list[tuple[int, str, str | None]], most: int) -> list[list[tuple[int, str, str | None]]]:
    """Cuts items into runs of `most` pieces at most; an item of more is a run of its own."""
    out, room = [], 0
    for x in items:
        n = _pieces(len(_hash_text(x[1])))
        if n > room or not out:
            out.append([])
            room = most
        out[-1].append(x)
        room -= n
    return out


def build_index(spark: SparkSession, items: list[tuple[int, str, str | None]], weights: np.ndarray) -> Index | None:
    """The latent space has a dimension for each piece of an item, so that none is lost in it."""
    items = [(i, t, a) for i, t, a in items if t and len(_hash_text(t))]
    if not items:
        return None
    words = [_hash_text(t) for _, t, _ in items]
    vocabulary = np.unique(np.concatenate(words))
    # an item that is in most documents keeps a weight, and no rare word beside it outweighs it for being elsewhere in no item
    own = np.unique(_bucket(vocabulary))
    floored = np.minimum(weights, LEAST_WEIGHT)
    floored[own] = np.maximum(weights[own], LEAST_WEIGHT)
    weights = floored
    weight = weights[_bucket(vocabulary)]
    rows = []
    pieces = [(k, x) for k, w in enumerate(words) for x in np.array_split(w, _pieces(len(w)))]
    for _, w in pieces:
        term, n = np.unique(np.searchsorted(vocabulary, w), return_counts=True)
        v = n * weight[term]
        rows.append((term.tolist(), (v / max(np.linalg.norm(v), 1e-12)).tolist()))
    matrix = spark.createDataFrame(rows, "terms array<int>, weights array<double>")
    basis, _ = randomised_svd(matrix, len(vocabulary), min(len(rows), len(vocabulary)))
    targets = np.stack([np.array(v) @ basis[t] for t, v in rows])
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
    answers = [_hash_text(a or _answer(t)) for _, t, a in items]
    spellings = [tuple((w := _spell_text(x)).bytes(0, len(w.words)) for x in (t, a or _answer(t))) for _, t, a in items]
    masks = np.zeros((len(vocabulary) + 1, len(items)), dtype=np.uint64)
    for k, w in enumerate(words):
        if len(w) <= 64:
            np.bitwise_or.at(masks, (np.searchsorted(vocabulary, w), k), np.uint64(1) << np.arange(len(w), dtype=np.uint64))
    return Index([i for i, _, _ in items], words, answers, spellings, vocabulary, (basis * weight[:, None]).astype(np.float32), targets.astype(np.float32), np.array([k for k, _ in pieces]), weights.astype(np.float32), masks)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    masks: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for w in b.tolist():
        if m := masks.get(w):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def numbered(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of words as numbers that are equal where the words are."""
    known: dict[bytes, int] = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in x], dtype=np.int64) for x in (a, b))


def common_subsequences(words: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, index: Index) -> np.ndarray:
    """Length of the longest common subsequence of words[lo:hi] and the item, for each of many; `at` is the place of each word in the vocabulary.

    Items of up to 64 words are compared all at once, a bit for each word of an item and a step for each word of a stretch.
    """
    out = np.zeros(len(item), dtype=np.int64)
    size = np.array([len(w) for w in index.words])[item]
    for k in np.flatnonzero(size > 64):
        near = words[lo[k] : hi[k]]
        out[k] = common_subsequence(index.words[item[k]], near[np.isin(near, index.words[item[k]])])
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(lo[short] - hi[short], kind="stable")]
    for first in range(0, len(short), COMPARED):
        own = short[first : first + COMPARED]
        begin, length, which = lo[own], hi[own] - lo[own], item[own]
        full = np.uint64(2**64 - 1) >> (np.uint64(64) - size[own].astype(np.uint64))
        state = full.copy()
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for t, n in enumerate(active.tolist()):
            u = state[:n] & index.masks[at[begin[:n] + t], which[:n]]
            state[:n] = ((state[:n] + u) | (state[:n] - u)) & full[:n]
        out[own] = size[own] - np.bitwise_count(state)
    return out


def _places(words: np.ndarray, index: Index) -> np.ndarray:
    """The place of each word in the vocabulary; the place after the last for all others."""
    at = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    return np.where(index.vocabulary[at] == words, at, len(index.vocabulary))


def _latent(terms: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """For each block the sum of its words' places in the latent space; `terms` holds the words of the benchmark first, then the number past the last term."""
    out = np.zeros((len(terms), latent.shape[1]), dtype=latent.dtype)
    for k in range(terms.shape[1]):
        own = np.flatnonzero(terms[:, k] < len(latent))
        if not len(own):
            break
        if len(own) == len(out):
            out += latent[terms[:, k]]
        else:
            out[own] += latent[terms[own, k]]
    return out


def _passages(blocks: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sum of each block and the PASSAGE_BLOCKS - 1 after it, as far as they belong to the same row."""
    out = blocks.copy()
    for k in range(1, min(PASSAGE_BLOCKS, len(blocks))):
        inside = row[k:] == row[:-k]
        if inside.all():
            out[:-k] += blocks[k:]
        else:
            out[:-k] += blocks[k:] * inside[:, None]
    return out


def _search(words: np.ndarray, places: np.ndarray, rows: np.ndarray, index: Index, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, item, first word and cosine of every passage whose cosine to an item is `cosine` at least, by row."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    lengths = np.diff(rows)
    blocks = -(-lengths // BLOCK_WORDS)
    first_block = np.append(0, np.cumsum(blocks))
    if not first_block[-1]:
        return none
    row_of_word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - rows[row_of_word]
    block = first_block[row_of_word] + place // BLOCK_WORDS
    weight = index.weights[_bucket(words)]
    size = np.bincount(block, weights=weight * weight, minlength=first_block[-1])
    row_of_block = np.repeat(np.arange(len(lengths)), blocks)
    terms = np.full((first_block[-1], BLOCK_WORDS), len(index.vocabulary))
    terms[block, place % BLOCK_WORDS] = places
    terms.sort(axis=1)  # words of the benchmark first
    size = np.sqrt(_passages(size[:, None], row_of_block)[:, 0])
    got = []
    for lo in range(0, len(terms), COMPARED_BLOCKS):  # portions that stay in the processor's cache
        hi = min(lo + COMPARED_BLOCKS, len(terms))
        # the last passages reach into the blocks of the next portion
        near = slice(lo, hi + PASSAGE_BLOCKS - 1)
        passage = _passages(_latent(terms[near], index.latent), row_of_block[near])[: hi - lo]
        # no cosine is above the share of a passage that lies in the latent space
        likely = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", passage, passage)) >= np.maximum(cosine * size[lo:hi], 1e-9))
        score = passage[likely] @ index.targets.T
        score /= size[lo + likely, None]
        flat = np.flatnonzero(score >= cosine)
        q, piece = np.divmod(flat, score.shape[1])
        got.append((lo + likely[q], piece, score.ravel()[flat]))
    p, piece, value = (np.concatenate(x) for x in zip(*got, strict=True))
    item, value = index.owners[piece], value.astype(np.float64)
    if len(index.owners) > len(index.items):  # a passage and an item once, by the piece of the highest cosine
        order = np.lexsort((-value, item, p))
        order = order[np.append(True, (np.diff(p[order]) != 0) | (np.diff(item[order]) != 0))] if len(order) else order
        p, item, value = p[order], item[order], value[order]
    row = row_of_block[p]
    return row, item, rows[row] + (p - first_block[row]) * BLOCK_WORDS, value


SCHEMA = "doc_id long, contaminated boolean, item_id long, cosine double, lcs double, answer double"


def _judge(docs: DataFrame, blocks: list[Index], cosine: float, verbatim: float, paraphrase: float, answer: float) -> DataFrame:
    # a block holds BLOCK_ITEMS items, about 15 MB; all of them meet every text in one pass
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def leaks(spelled: Spelled, rows: np.ndarray, index: Index, best: dict[int, tuple]) -> None:
        """Puts the strongest candidate of each row into best: (leak, lcs, cosine, answer, -item).

        Hashes can only make a subsequence longer than it is; one long enough for a leak is counted again by its words' bytes.
        """
        words = spelled.words
        sizes = np.array([len(w) for w in index.words])
        places = _places(words, index)
        row, item, begin, value = _search(words, places, rows, index, cosine)
        size = sizes[item]
        lo, hi = np.maximum(rows[row], begin - size), np.minimum(rows[row + 1], begin + BLOCK_WORDS * PASSAGE_BLOCKS + size)
        lcs = common_subsequences(words, places, lo, hi, item, index) / size
        order = np.lexsort((-value, -lcs, row))
        for k in order.tolist():
            if (have := best.get(r := int(row[k]))) and (lcs[k], value[k]) < have[1:3] and (have[0] or lcs[k] < paraphrase):
                continue
            held = float(lcs[k])
            if held >= paraphrase:
                held, told = (common_subsequence(*numbered(x, spelled.bytes(lo[k], hi[k]))) / max(len(x), 1) for x in index.spellings[item[k]])
            else:
                told = common_subsequence(index.answers[item[k]], words[lo[k] : hi[k]]) / max(len(index.answers[item[k]]), 1)
            leak = held >= verbatim or (held >= paraphrase and told >= answer)
            best[r] = max(best.get(r, ()), (leak, held, float(value[k]), told, -index.items[item[k]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text_slices(batches):
            spelled, rows = _spelled(data, at)
            best: dict[int, tuple] = {}
            for block in shared:
                leaks(spelled, rows, block.value, best)
            out = [best.get(r) for r in range(batch.num_rows)]
            yield pa.record_batch(
                [
                    batch.column(0), pa.array([bool(x and x[0]) for x in out]), pa.array([x and -x[4] for x in out], pa.int64()),
                    pa.array([x and x[2] for x in out], pa.float64()), pa.array([x and x[1] for x in out], pa.float64()), pa.array([x and x[3] for x in out], pa.float64()),
                ],
                ["doc_id", "contaminated", "item_id", "cosine", "lcs", "answer"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, verbatim: float = VERBATIM, paraphrase: float = PARAPHRASE, answer: float = ANSWER) -> DataFrame:
    """Every row of docs (doc_id, text) with the benchmark item (item_id, text, maybe answer) that it leaks, if any.

    Word weights come from the document frequencies of all docs; those of the items' words never fall below LEAST_WEIGHT. The items' TF-IDF vectors are
    reduced by a randomised SVD; overlapping passages of the documents are projected, and those with a cosine of at
    least `cosine` to an item are candidates. Around every such passage the longest common
    subsequence of words decides, and the strongest counts: `verbatim` of the item's words, or `paraphrase` of them and
    `answer` of the answer's (the column answer, else the item's last sentence); leaks are decided by the words' bytes. Returns doc_id, contaminated,
    and of the strongest candidate item_id, cosine, lcs and answer (null if there is none; ties to the
    smaller item). Null or empty texts leak nothing; null or empty items are never leaked; repeated rows, and rows without doc_id, give a row each;
    very long texts are searched whole; an empty table gives no rows; other columns, whatever their names, are left aside.
    Long items are sought by pieces. Items make blocks of BLOCK_ITEMS pieces with a latent space each; every text meets all blocks in one
    pass. The items go through the driver and to every task: a benchmark is bounded, at about 15 MB for 256 pieces.
    """
    spark = docs.sparkSession
    weights = weights_of(document_frequencies(docs))
    told = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text", told.alias("answer"))
    blocks = blocks_of(sorted(map(tuple, items.collect()), key=lambda x: (x[0], x[1])), BLOCK_ITEMS)
    found = [index for index in (build_index(spark, block, weights) for block in blocks) if index]
    if not found:
        return docs.select(F.col("doc_id").cast("long"), F.lit(False).alias("contaminated"), *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("cosine", "double"), ("lcs", "double"), ("answer", "double"))])
    return _judge(docs, found, cosine, verbatim, paraphrase, answer)
