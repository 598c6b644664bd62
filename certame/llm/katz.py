"""Katz backoff bigrams with Good-Turing discounts and exactly normalised backoff weights.

Counts move as compressed columns between tasks, dealt by the word that follows, which then has its own count beside its bigrams;
bigrams and scores are dealt by the history, which then has all that its backoff rests on. Words that make up a noticeable share of
all tokens are split further by their partner; what is known of these few goes to every task. The model is kept as a table of bigrams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certame.llm.kernels import mix, text_slices, word_hashes
from certame.llm.storage import drop_shuffles, staged

#: Words are 64-bit hashes; these two stand for a text's start and end.
START, END = 1, 2
#: Bigrams seen less often in training have no place in the table; at 1 all have one.
LEAST_COUNT = 1
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: A word with this share of all tokens is split in SALTS.
HOT_SHARE, SALTS = 1 / 1000, 16
#: Tokens of a partition; small tables are dealt to SPREAD partitions, as long as those have SPREAD_TOKENS each.
PARTITION_TOKENS, SPREAD, SPREAD_TOKENS = 2_500_000, 48, 500_000
#: Tasks for each partition: as many tasks as partitions would leave up to five partitions to one task, as their hashes fall.
TASKS = 3
BATCH_TOKENS = 1_500_000
HELD_OUT = (7, 2)


def pack(**columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed."""
    parts = [b"".join((np.array([len(c), c.dtype.itemsize], "<i8").tobytes(), c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())) for c in columns.values()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes, **kinds: str) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, {}
    for name, kind in kinds.items():
        n, width = np.frombuffer(raw, "<i8", 2, at).tolist()
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T).view(kind).ravel()
        at += 16 + n * width
    return out


FOLDED = {"lead": "<u8", "run": "<u4", "known": "<u8", "at": "<u4"}


def fold(lead: np.ndarray, other: np.ndarray, **more: np.ndarray) -> bytes:
    """Pairs in the order of `lead`, packed: that one as differences and runs, the other as places in the list of those that occur."""
    head = _runs(lead)
    known, at = np.unique(other, return_inverse=True)
    return pack(lead=np.diff(lead[head], prepend=np.uint64(0)), run=np.diff(np.append(head, len(lead))).astype("<u4"), known=np.diff(known, prepend=np.uint64(0)), at=at.astype("<u4"), **more)


def unfold(raw: bytes, **more: str) -> dict[str, np.ndarray]:
    """`lead` once a run, `other` for each pair."""
    x = unpack(raw, **FOLDED, **more)
    return x | {"lead": np.cumsum(x["lead"], dtype=np.uint64), "other": np.cumsum(x["known"], dtype=np.uint64)[x["at"]]}


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: crc32 of its doc_id as text, modulo 7, is 2."""
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def _parts(h: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The partition of h; if that is hot, of both."""
    salt = np.where(np.isin(h, hot), w % np.uint64(SALTS), np.uint64(0)) if len(hot) else np.uint64(0)
    return ((mix(h + salt * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], training: bool, most: int = BATCH_TOKENS) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, and for each token its history, itself and the number of its document, some `most` tokens at once."""
    ids, found, n = [], [], 0
    for batch, data, at in text_slices(batches):
        words, rows = word_hashes(data, at)
        own = batch.column(0).to_pylist()
        size = np.diff(rows) + 1
        first = np.cumsum(size) - size
        w = np.insert(words, rows[1:], np.uint64(END))
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[first] = START
        doc = np.repeat(np.arange(len(own)), size)
        if training:
            use = np.array([not held_out(i) for i in own])[doc]
            h, w, doc = h[use], w[use], doc[use]
        found.append((h, w, doc + len(ids)))
        ids += own
        n += len(h)
        if n >= most:
            yield ids, *(np.concatenate(x) for x in zip(*found, strict=True))
            ids, found, n = [], [], 0
    if ids:
        yield ids, *(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _deal(part: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    edge = np.append(np.searchsorted(part, np.arange(parts)), len(part)).tolist()
    return ((p, edge[p], edge[p + 1]) for p in range(parts) if edge[p] < edge[p + 1])


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    """Rows of a kind, with the columns of COUNTED that they have."""
    kinds = {"kind": pa.int32(), "part": pa.int32(), "key": pa.int64(), "n": pa.int64(), "found": pa.binary()}
    return pa.record_batch([pa.array([kind] * size, t) if k == "kind" else pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()], list(kinds))


def _count_pairs(batches: Iterator[pa.RecordBatch], parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the bigrams of a batch, for the partitions of their second words."""
    for _, h, w, _ in _pairs(batches, True):
        order = np.lexsort((h, w))
        h, w = h[order], w[order]
        at = _runs(h, w)
        n = np.diff(np.append(at, len(h))).astype("<u4")
        h, w = h[at], w[at]
        part = _parts(w, h, hot, parts)
        order = np.argsort(part, kind="stable")
        h, w, n, part = h[order], w[order], n[order], part[order]
        out = [(p, fold(w[a:b], h[a:b], n=n[a:b])) for p, a, b in _deal(part, parts)]
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["part", "found"])


COUNTED = "kind int, part int, key long, n long, found binary"
PAIR, PAIRS_WITH, WORDS_WITH, OFTEN, DISTINCT, TOKENS, ASKED, NAMED = range(8)


def _add_pairs(batches: Iterator[pa.RecordBatch], parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bigrams with both counts, for the partitions of their histories, and sums.

    PAIRS_WITH, WORDS_WITH: how many bigrams, and words that are not hot, have the count in key; OFTEN: count of a hot word here;
    DISTINCT, TOKENS: the words that are not hot. The count of a hot word stands as 0 beside its bigrams.
    """
    got = []
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            x = unfold(raw, n="<u4")
            got.append((np.repeat(x["lead"], x["run"]), x["other"], x["n"].astype(np.int64)))
    if not got:
        return
    w, h, n = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((h, w))
    w, h, n = w[order], h[order], n[order]
    at = _runs(w, h)
    w, h, c = w[at], h[at], np.add.reduceat(n, at)
    head = _runs(w)
    count, often = np.add.reduceat(c, head), np.isin(w[head], hot)
    rest = count[~often]
    for kind, values in ((PAIRS_WITH, c), (WORDS_WITH, rest)):
        of, times = np.unique(values[values <= DISCOUNTED + 1], return_counts=True)
        yield _rows(kind, len(of), key=of, n=times)
    yield _rows(OFTEN, int(often.sum()), key=w[head][often].view(np.int64), n=count[often])
    yield _rows(DISTINCT, 1, key=[0], n=[len(rest)])
    yield _rows(TOKENS, 1, key=[0], n=[int(rest.sum())])
    beside = np.repeat(np.where(often, 0, count), np.diff(np.append(head, len(w))))
    part = _parts(h, w, hot, parts)
    order = np.argsort(part, kind="stable")
    w, h, c, beside, part = w[order], h[order], c[order].astype("<u4"), beside[order], part[order]
    out = [(p, fold(w[a:b], h[a:b], c=c[a:b], count=beside[a:b][_runs(w[a:b])])) for p, a, b in _deal(part, parts)]
    yield _rows(PAIR, len(out), part=[x[0] for x in out], found=[x[1] for x in out])


def discounts(times: dict[int, int], least: int = 1, most: int = DISCOUNTED) -> dict[int, float]:
    """Katz's factor for every count up to `most`, from the numbers of entries with each count.

    Counts below `least` get 0. Where the Good-Turing estimate is not between 0 and 1, half a count is taken off.
    """
    n = lambda r: times.get(r, 0)
    tail = (most + 1) * n(most + 1) / n(1) if n(1) else 1.0
    out = {}
    for r in range(1, most + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - tail) / (1 - tail) if n(r) and tail != 1 else 0.0
        out[r] = 0.0 if r < least else d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Model:
    pairs: DataFrame  # part, found: bigrams with their own counts and those of their second words
    train_tokens: int
    distinct: int
    whole: float  # what counts are shares of
    unknown: float  # log10 of the probability of a word not seen in training
    parts: int
    least: int
    word_factor: np.ndarray  # by count, as are pair_factor; the last one is for all larger counts
    pair_factor: np.ndarray
    hot: np.ndarray  # sorted; the others are of these words
    count: np.ndarray
    after: np.ndarray  # tokens that have it as history
    mass: np.ndarray  # sum of the discounted counts of its bigrams
    words: np.ndarray  # sum of the probabilities of the words that follow it


def _factors(table: dict[int, float]) -> np.ndarray:
    return np.array([0.0, *(table[r] for r in range(1, DISCOUNTED + 1)), 1.0])


def _discounted(c: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return c * factor[np.minimum(c, DISCOUNTED + 1)]


def _bigrams(raw: bytes, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Histories, words, the counts of both together and of the word."""
    x = unfold(raw, c="<u4", count="<i8")
    lead, count = x["lead"], x["count"].copy()
    hot = np.flatnonzero(count == 0)
    count[hot] = model.count[np.searchsorted(model.hot, lead[hot])]
    return x["other"], np.repeat(lead, x["run"]), x["c"].astype(np.int64), np.repeat(count, x["run"])


def _shares(c: np.ndarray, count: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What bigrams of the table add to the mass of their histories, and their words to the probabilities that the table covers."""
    seen = c >= model.least
    return np.where(seen, _discounted(c, model.pair_factor), 0.0), np.where(seen, _discounted(count, model.word_factor) / model.whole, 0.0)


def _hot_sums(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    mass, words = np.zeros(len(model.hot)), np.zeros(len(model.hot))
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            h, _, c, count = _bigrams(raw, model)
            own = np.isin(h, model.hot)
            at = np.searchsorted(model.hot, h[own])
            for out, x in zip((mass, words), _shares(c[own], count[own], model), strict=True):
                out += np.bincount(at, weights=x, minlength=len(out))
    some = np.flatnonzero(mass)
    yield pa.record_batch([pa.array(some), pa.array(mass[some]), pa.array(words[some])], ["k", "m", "u"])


def frequent_words(docs: DataFrame, share: float = HOT_SHARE) -> tuple[int, np.ndarray]:
    """The number of all tokens, and the histories that make up a noticeable share of them: 2 / share at most.

    A batch sends those that reach `share` of its own tokens. Which ones are split is a matter of
    layout alone: counting and scoring use one list, and no count rests on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _, _ in _pairs(batches, False):
            w, n = np.unique(h, return_counts=True)
            top = n >= share * len(h)
            yield pa.record_batch([pa.array(np.append(w[top].view(np.int64), 0)), pa.array(np.append(n[top], len(h)).astype(np.int64))], ["w", "n"])

    sums = docs.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    got = {w: n for w, n in sums.orderBy(F.desc("n"), "w").limit(int(2 / share) + 1).collect()}
    total = got.pop(0, 0)
    return total, np.array(sorted(w for w, n in got.items() if n >= share * total / 2), dtype=np.int64).view(np.uint64)


def fit(docs: DataFrame, least: int = LEAST_COUNT) -> Model:
    """The model of the rows of docs (doc_id, text) that are not held out."""
    total, hot = frequent_words(docs)
    hot = np.union1d(hot, np.array([START, END], np.uint64))
    parts = max(8, min(SPREAD, total // SPREAD_TOKENS), -(-total // PARTITION_TOKENS))
    counted = docs.mapInArrow(lambda b: _count_pairs(b, parts, hot), "part int, found binary").repartition(TASKS * parts, "part").mapInArrow(lambda b: _add_pairs(b, parts, hot), COUNTED)
    counted = staged(counted, "ngrams")
    drop_shuffles(docs.sparkSession)

    sums = {(r.kind, r.key): r.n for r in counted.where(F.col("kind") != PAIR).groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}
    often = {np.int64(w).view(np.uint64): n for (kind, w), n in sums.items() if kind == OFTEN}
    of = {r: sums.get((WORDS_WITH, r), 0) + sum(n == r for n in often.values()) for r in range(1, DISCOUNTED + 2)}
    tokens, distinct = sums.get((TOKENS, 0), 0) + sum(often.values()), sums.get((DISTINCT, 0), 0) + len(often)
    d1 = discounts(of)
    free = sum(of[r] * r * (1 - d) for r, d in d1.items())
    # without rare words nothing is free: a word not seen yet counts as one more
    whole = tokens if free else tokens + 1
    d2 = discounts({r: n for (kind, r), n in sums.items() if kind == PAIRS_WITH}, least)

    count = np.array([often.get(w, 0) for w in hot], np.int64)
    # every word is the history of what follows it; START stands before the first, as often as END after the last
    after = np.where(hot == START, count[np.searchsorted(hot, np.uint64(END))], count)
    pairs = counted.where(F.col("kind") == PAIR).select("part", "found")
    model = Model(pairs, tokens, distinct, float(max(whole, 1)), float(np.log10((free or 1) / whole)), parts, least, _factors(d1), _factors(d2), hot, count, after, np.zeros(len(hot)), np.zeros(len(hot)))
    bare = replace(model, pairs=None)
    for r in pairs.select("found").mapInArrow(lambda b: _hot_sums(b, bare), "k long, m double, u double").groupBy("k").agg(F.sum("m").alias("m"), F.sum("u").alias("u")).collect():
        model.mass[r.k], model.words[r.k] = r.m, r.u
    return model


NAMES = {"ids": "<i8", "null": "u1"}


def _ask(batches: Iterator[pa.RecordBatch], parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    batch_id = TaskContext.get().partitionId() << 24
    for ids, h, w, doc in _pairs(batches, False):
        part = _parts(h, w, hot, parts)
        order = np.lexsort((w, h, part))
        h, w, doc, part = h[order], w[order], doc[order], part[order]
        out = []
        for p, a, b in _deal(part, parts):
            pair = _runs(h[a:b], w[a:b])
            times = np.diff(np.append(pair, b - a)).astype("<u4")
            out.append((p, fold(h[a:b][pair], w[a:b][pair], times=times, doc=doc[a:b].astype("<u4"))))
        # the documents that the batch numbers, once
        out.append((batch_id % parts, pack(ids=np.array([i or 0 for i in ids], np.int64), null=np.array([i is None for i in ids], np.uint8))))
        kinds = [ASKED] * (len(out) - 1) + [NAMED]
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array(kinds, pa.int32()), pa.array([batch_id] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["part", "kind", "batch", "found"])
        batch_id += 1


SUMS = {"doc": "<u4", "score": "<f8", "base": "<f8", "known": "<u4", "tokens": "<u4"}
PARTIAL = "batch long, kind int, found binary"


@dataclass
class Shelf:
    """What a partition knows: its histories and hot words by word, and its bigrams by the hash of both."""

    w: np.ndarray
    c: np.ndarray  # count as a word
    p: np.ndarray  # log10 of its probability
    a: np.ndarray  # log10 of its backoff weight
    key: np.ndarray
    first: np.ndarray
    second: np.ndarray
    y: np.ndarray  # log10 of what a bigram changes


def _shelf(found: list[bytes], model: Model) -> Shelf:
    got = [_bigrams(raw, model) for raw in found] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    h, w, c, count = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(h, kind="stable")
    h, w, c, count = h[order], w[order], c[order], count[order]
    m, u = _shares(c, count, model)
    head = _runs(h)
    own = ~np.isin(h[head], model.hot)  # a hot one has only some of its bigrams here
    add = lambda x: np.add.reduceat(x, head)[own] if len(x) else x
    n = add(c)
    word, order = np.unique(np.concatenate((h[head][own], model.hot)), return_index=True)
    number, after, mass, words = (np.concatenate(x)[order] for x in ((n, model.count), (n, model.after), (add(m), model.mass), (add(u), model.words)))
    some = mass > 0
    share = np.where(some, mass, 1.0) / np.maximum(after, 1)
    # a history with nothing discounted still leaves one part of n + 1 to other words
    keep = np.minimum(1.0, after / (after + 1) / share)
    a = np.where(some, np.log10(np.where(some, (1 - keep * share) / (1 - words), 1.0)), 0.0)
    p = np.where(number > 0, np.log10(np.maximum(_discounted(number, model.word_factor) / model.whole, 1e-300)), model.unknown)
    kept = c >= model.least
    h, w, m, count = h[kept], w[kept], m[kept], count[kept]
    at = np.searchsorted(word, h)
    y = np.log10(keep[at] * m / after[at]) - a[at] - np.log10(_discounted(count, model.word_factor) / model.whole)
    key = mix(h ^ mix(w))
    order = np.argsort(key, kind="stable")
    return Shelf(word, number, p, a, key[order], h[order], w[order], y[order])


def _answer(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Partial sums of each batch's documents, packed: bigram score, logs of counts plus one, known words, tokens."""
    asked, pairs = [], []
    for batch in batches:
        for kind, n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if kind == ASKED:
                asked.append((n, raw))
            elif kind == PAIR:
                pairs.append(raw)
            else:
                yield pa.record_batch([pa.array([n], pa.int64()), pa.array([NAMED], pa.int32()), pa.array([raw], pa.binary())], ["batch", "kind", "found"])
    if not asked:
        return
    shelf = _shelf(pairs, model)
    del pairs
    for n, raw in asked:
        x = unfold(raw, times="<u4", doc="<u4")
        head, doc, w = x["lead"], x["doc"].astype(np.int64), x["other"]
        size = int(doc.max()) + 1
        at = np.searchsorted(shelf.w, head)
        at[at == len(shelf.w)] = 0
        known = shelf.w[at] == head
        start = head == START
        count = np.where(known & ~start, shelf.c[at], 0)
        # the history's backoff weight, and its own probability as the word of the token before
        score = np.where(known, shelf.a[at], 0.0) + np.where(start, 0.0, np.where(count > 0, shelf.p[at], model.unknown))
        base = np.log10(count + 1.0)
        of = np.repeat(np.arange(len(head)), x["run"])  # the history of each pair
        h = head[of]
        # a bigram is looked up by the hash of both, and then held against both
        k = np.searchsorted(shelf.key, mix(h ^ mix(w)))
        k[k == len(shelf.key)] = 0
        gain = np.where((shelf.first[k] == h) & (shelf.second[k] == w), shelf.y[k], 0.0) if len(shelf.key) else np.zeros(len(h))
        pair = np.repeat(np.arange(len(h)), x["times"])  # the pair of each token
        gain, of = gain[pair], of[pair]
        total = np.bincount(doc, weights=score[of] + gain, minlength=size)
        bases, knows, tokens = np.bincount(doc, weights=base[of], minlength=size), np.bincount(doc, weights=(count > 0)[of], minlength=size), np.bincount(doc, minlength=size)
        some = np.flatnonzero(tokens)
        found = pack(doc=some.astype("<u4"), score=total[some], base=bases[some], known=knows[some].astype("<u4"), tokens=tokens[some].astype("<u4"))
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([ASKED], pa.int32()), pa.array([found], pa.binary())], ["batch", "kind", "found"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial sums of each batch; a row for each of its documents."""
    got: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for n, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            got.setdefault(n, ([], []))[kind == NAMED].append(raw)
    for parts, (names,) in got.values():
        x = unpack(names, **NAMES)
        ids = [None if away else i for i, away in zip(x["ids"].tolist(), x["null"].tolist(), strict=True)]
        sums = {k: np.zeros(len(ids)) for k in SUMS if k != "doc"}
        for raw in parts:
            x = unpack(raw, **SUMS)
            for k, v in sums.items():
                v[x["doc"]] += x[k]  # a document is once in a part
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(sums["score"]), pa.array(sums["base"]), pa.array(sums["known"].astype(np.int64)), pa.array(sums["tokens"].astype(np.int64))],
            ["doc_id", "held_out", "score", "base", "known", "tokens"],
        )


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row of docs (doc_id, text) with its log10 probability, under a model fitted on those that are not held out.

    Tokens are words (A-Z lower-cased, parted by ASCII white space) and one end; null text counts as empty.
    A token's probability is its discounted share after its history, if the table has the bigram, else the history's backoff weight
    times the discounted share of the word, and if that is new, all that the words leave. Written as sums, a text's score is that
    of its words and histories, which need a lookup by word, plus what the bigrams of the table change. The
    base score takes (c + 1) / (N + V + 1). Repeated rows are scored and counted each; a null doc_id is a row like others. Texts of any length
    are scored whole; an empty table gives no rows, and one whose rows are all held out a model that knows no word; words of equal counts have equal chances, so nothing hangs on their order; other columns, whatever their names, are left aside.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = model or fit(docs)
    parts, hot, bare = model.parts, model.hot, replace(model, pairs=None)
    asked = docs.mapInArrow(lambda b: _ask(b, parts, hot), "part int, kind int, batch long, found binary")
    pairs = model.pairs.select("part", F.lit(PAIR).alias("kind"), F.lit(None).cast("long").alias("batch"), "found")
    partial = asked.union(pairs).repartition(TASKS * parts, "part").mapInArrow(lambda b: _answer(b, bare), PARTIAL)
    # a batch's partial sums move packed: rows by part and batch, not by part and document
    sums = partial.repartition(parts, "batch").mapInArrow(_total, "doc_id long, held_out boolean, score double, base double, known long, tokens long")
    end_c = int(model.count[np.searchsorted(hot, np.uint64(END))])
    end_p = float(np.log10(_discounted(end_c, model.word_factor) / model.whole)) if end_c else model.unknown
    return sums.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), (F.col("known") + int(end_c > 0)).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(end_c + 1)) - F.col("tokens") * float(np.log10(model.train_tokens + model.distinct + 1))).alias("base_score"),
        (F.col("score") + float(end_p)).alias("score"),
    )
