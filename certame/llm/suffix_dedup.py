"""Removal of repeated passages by a hash-compared suffix sort.

Every `length`-byte window belongs to one anchor: the k-gram of smallest hash in it (the
leftmost of equals). Equal windows have equal anchors at equal places, so only
anchors move between tasks, not all suffixes. Anchors of one k-gram whose whole surroundings repeat are settled by a
128-bit cryptographic digest of those bytes; around the others the suffixes themselves are sorted, by merging runs with
comparisons that find the common extension of two suffixes by binary search over prefix
hashes. Windows that compare equal are held against their bytes. Frequent k-grams are known from a first pass;
their anchors are dealt by their surroundings, and their windows one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certame.llm.kernels import MULT_INV, SMALL_SLICE, mix, powers, prefix_hash, quick_hash, rolling_hash, same_spans, span_value, text_buffers, text_hash, text_slices
from certame.llm.storage import drop_shuffles, removed, staged

LENGTH = 100
GRAM = 32
#: Anchors whose repeats are settled together before they move.
BATCH_ANCHORS = 1 << 17
#: A k-gram that makes up this share of all anchors is frequent, and one that HOT rows have after their batches settled theirs.
HOT_SHARE, HOT = 1e-4, 4096
#: Windows that are sorted at once.
BATCH_WINDOWS = 1 << 17
#: A row of a table is told apart by doc_id and sub; sub is 0 but for rows that share a doc_id.
#: around and beside are the two halves of the digest of an anchor's surroundings; place holds start, n and off in 31, 16 and 16 bits, and is negative for frequent ones.
ANCHOR = "key long, around long, beside long, doc_id long, sub long, place long"
#: A window with this place of its anchor is known to start earlier, and has no bytes.
SETTLED = -1
WINDOW = "key long, doc_id long, sub long, start int, n int, off int, bytes binary"
RANGE = "doc_id long, sub long, start int, n int"


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    return np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :]) if width > reach else keys


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of a 128-bit digest of each stretch."""
    raw, digest = memoryview(data.tobytes()), hashlib.blake2b
    both = np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<i8")
    return both[::2].copy(), both[1::2].copy()


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """For each run of windows with one anchor: row, start in the row, windows, place of the anchor, hash of the k-gram."""
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "n", "off", "fp")}
    grams = rolling_hash(data, gram)
    owner = (_sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    valid = row[: len(owner)] == row[length - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    count = np.add.reduceat(valid, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    rows = row[start].astype(np.int64)
    return {"row": rows, "start": start - at[rows], "n": count, "off": owner[start] - start, "fp": grams[owner[start]].view(np.int64)}


def _new_key(*columns: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal rows."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _later(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks rows that stand after the first one of their run: in a document of larger id, or later in one of the same id."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return (doc > doc[first]) | ((doc == doc[first]) & (start > start[first]))


def _record(schema: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [c.split(" ") for c in schema.split(", ")]
    return pa.record_batch([columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k].astype(np.int64), pa.int64()).cast(kinds[t]) for k, t in names], [k for k, _ in names])


def _column(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.asarray(batch.column(k).to_numpy(zero_copy_only=False), dtype=np.int64)


def frequent_anchors(known: DataFrame, length: int, gram: int, share: float = HOT_SHARE) -> np.ndarray:
    """Sorted hashes of the k-grams that make up a noticeable share of all anchors: 2 / share at most.

    A batch sends those that reach `share` of its own anchors. Which ones are split is a matter of layout alone: no result rests on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for _, data, at in text_slices(batches, most=SMALL_SLICE):
            kept.append(anchors(data, at, length, gram)["fp"])
            size += len(kept[-1])
            if size >= BATCH_ANCHORS:
                yield count(np.concatenate(kept))
                kept, size = [], 0
        if size:
            yield count(np.concatenate(kept))

    def count(fp: np.ndarray) -> pa.RecordBatch:
        found, n = np.unique(fp, return_counts=True)
        top = n >= max(2, share * len(fp))
        return pa.record_batch([pa.array(np.append(found[top], 0)), pa.array(np.append(n[top], 0)), pa.array(np.append(np.zeros(int(top.sum()), np.int64), len(fp)))], ["fp", "n", "every"])

    sums = known.select("sub", "text").mapInArrow(run, "fp long, n long, every long").groupBy("fp").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))
    got = sums.orderBy(F.desc("every"), F.desc("n"), "fp").limit(int(2 / share) + 1).collect()
    total = got[0].every if got else 0
    return np.array(sorted(r.fp for r in got if r.n >= share * total / 2), dtype=np.int64)


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors of (doc_id, sub, text), under the hash of their k-gram, or, of frequent ones, of k-gram and surroundings.

    What repeats among those of one batch is settled at once (key null), so surroundings that repeat move once for a batch.
    """
    kept: list[dict] = []

    def flush() -> pa.RecordBatch:
        c = {k: np.concatenate([x[k] for x in kept]) for k in kept[0]}
        kept.clear()
        order = np.lexsort((c["place"], c["doc_id"], c["beside"], c["around"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        again = _later(_new_key(c["key"], c["around"], c["beside"]), c["doc_id"], c["place"])
        c["key"], c["around"], c["beside"] = pa.array(c["key"], pa.int64(), mask=again), np.where(again, 0, c["around"]), np.where(again, 0, c["beside"])
        return _record(ANCHOR, c)

    size = 0
    for batch, data, at in text_slices(batches, most=SMALL_SLICE):
        x = anchors(data, at, length, gram)
        row, fp = x.pop("row"), x.pop("fp")
        x["doc_id"], x["sub"] = _column(batch, 0)[row], _column(batch, 1)[row]
        begin = at[row] + x["start"]
        (around, beside), hot = _digests(data, begin, begin + x["n"] - 1 + length), np.isin(fp, frequent)
        place = (x["start"] << 32) | (x["n"] << 16) | x["off"] | np.where(hot, np.int64(-(2**63)), 0)
        key = np.where(hot, mix(fp.view(np.uint64) ^ around.view(np.uint64)).view(np.int64), fp)
        kept.append({"key": key, "around": around, "beside": beside, "doc_id": x["doc_id"], "sub": x["sub"], "place": place})
        size += len(row)
        if size >= BATCH_ANCHORS:
            yield flush()
            size = 0
    if kept:
        yield flush()


def _hot_repeats(data: np.ndarray, begin: np.ndarray, c: dict[str, np.ndarray], own: np.ndarray, length: int) -> np.ndarray:
    """Of the rows `own`, each a window under its hash, those whose bytes start earlier among them."""
    own = own[np.lexsort((c["start"][own], c["doc_id"][own], c["key"][own]))]
    new = _new_key(c["key"][own])
    first = begin[own[np.flatnonzero(new)[np.cumsum(new) - 1]]]
    return own[_later(new, c["doc_id"][own], c["start"][own]) & same_spans(data, begin[own], begin[own] + length, data, first)]


def _find_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes around the anchors that the last column lists for each text of (doc_id, sub, text, around); windows of hot anchors each alone, under their own hash."""
    for batch, data, at in text_slices(batches):
        listed = batch.column(3)
        inner = listed.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
        fp, hot, start, n, off = (np.asarray(inner.field(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in range(5))
        doc, sub, hot = _column(batch, 0), _column(batch, 1), hot.astype(bool)
        if hot.any():
            times = np.where(hot, n, 1)
            step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, fp, start, off, n, hot = (np.repeat(x, times) for x in (row, fp, start, off, n, hot))
            start, off, n = start + np.where(hot, step, 0), np.where(hot, 0, off), np.where(hot, 1, n)
            begin = at[row] + start
            fp = np.where(hot, quick_hash(text_hash(data), begin, begin + length).view(np.int64), fp)
        c = {"key": fp, "doc_id": doc[row], "sub": sub[row], "start": start, "n": n, "off": off}
        begin, size = at[row] + start, n + length - 1
        if hot.any():
            done = _hot_repeats(data, begin, c, np.flatnonzero(hot), length)
            size[done], c["off"][done], c["key"][done] = 0, SETTLED, mix(c["doc_id"][done].view(np.uint64)).view(np.int64)
        total = np.append(0, np.cumsum(size))
        text = data[np.repeat(begin - total[:-1], size) + np.arange(int(total[-1]))]
        c["bytes"] = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(total.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
        yield _record(WINDOW, c)


class Suffixes:
    """Comparison of windows of a buffer by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.q, self.inverse = data, length, text_hash(data), powers(MULT_INV, len(data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, up to `length`, by binary search."""
        same = np.zeros(len(x), dtype=np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            to = np.minimum(same + step, self.length)
            equal = (self.q[x + to] - self.q[x + same]) * self.inverse[x + same] == (self.q[y + to] - self.q[y + same]) * self.inverse[y + same]
            same = np.where(equal, to, same)
            step >>= 1
        return same

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = self.common(x, y)
        end = np.minimum(same, self.length - 1)
        return np.where(same == self.length, 0, np.sign(self.data[x + end].astype(np.int16) - self.data[y + end].astype(np.int16)))

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes at `at` within each group (sorted group numbers): runs of 1, 2, 4 ... merge, in all groups at once; equal ones keep their order."""
        new = _new_key(group)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.int64)
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.int64)
        place = np.arange(len(at)) - head
        order, run, largest = np.arange(len(at)), 1, int(size.max(initial=1))
        while run < largest:
            which = np.flatnonzero(size > run)
            mine, h, k, m = order[which], head[which], place[which], size[which]
            left = (k // run) % 2 == 0
            other = (k // run ^ 1) * run
            lo, hi = np.zeros(len(which), np.int64), np.clip(m - other, 0, run)
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) // 2
                sign = self.compare(at[order[h[live] + other[live] + mid]], at[mine[live]])
                before = np.where(left[live], sign < 0, sign <= 0)
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
            target = h + (k // (2 * run)) * 2 * run + k % run + lo
            after = order.copy()
            after[target] = mine
            order, run = after, 2 * run
        return order

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return same_spans(self.data, x, x + self.length, self.data, y)


def repeated_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the windows whose bytes also start earlier, by (doc, start), in a window of their group."""
    if not len(at):
        return np.zeros(0, np.int64)
    by = np.lexsort((start, doc, group))
    suffixes = Suffixes(data, length)
    order = by[suffixes.sort(at[by], group[by])]
    x, y = order[:-1], order[1:]
    same = (group[x] == group[y]) & (suffixes.common(at[x], at[y]) == length)
    told = np.flatnonzero(same)
    wrong = group[x[told[~suffixes.equal_bytes(at[x[told]], at[y[told]])]]]
    # a collision within a window may also have parted equal ones: each value of another hash must make one run
    values = span_value(prefix_hash(data), at, at + length)[order]
    by_value = np.lexsort((values, group[order]))
    g, v = group[order][by_value], values[by_value]
    of, runs = np.unique(group[order][np.append(True, ~same)], return_counts=True)
    kinds = np.bincount(np.searchsorted(of, g[_new_key(g, v)]), minlength=len(of))
    wrong = np.union1d(wrong, of[runs != kinds])
    if len(wrong):  # two texts with one hash: their groups are compared by their bytes alone
        bad = np.isin(group, wrong)
        rest = repeated_windows(data, at[~bad], group[~bad], doc[~bad], start[~bad], length)
        seen: dict[tuple, tuple] = {}
        plain = []
        for i in sorted(np.flatnonzero(bad).tolist(), key=lambda i: (doc[i], start[i])):
            first = seen.setdefault((int(group[i]), data[at[i] : at[i] + length].tobytes()), (doc[i], start[i]))
            if first < (doc[i], start[i]):
                plain.append(i)
        return np.append(np.flatnonzero(~bad)[rest], np.array(plain, dtype=np.int64))
    # the sort keeps the earliest of equals first
    return order[_later(np.append(True, ~same), doc[order], start[order])]


def _windows_of(c: dict[str, np.ndarray], text: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The windows of rows (sorted by key) that also start earlier: number of the row, step from its start."""
    n = c["n"]
    item = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    # windows of one anchor are equal only where the anchor stands at one place
    place = c["off"][item] - step
    low = int(place.min(initial=0))
    group = (np.cumsum(_new_key(c["key"]))[item]) * (int(place.max(initial=0)) - low + 1) + place - low
    several = np.unique(group, return_inverse=True, return_counts=True)
    use = np.flatnonzero(several[2][several[1]] > 1)
    item, step, group = item[use], step[use], group[use]
    again = repeated_windows(text, at[item] + step, group, c["doc_id"][item], c["start"][item] + step, length)
    return {"item": item[again], "step": step[again]}


def _sort_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that also start earlier, of rows of WINDOW in the order of key, doc_id, start.

    Whole keys are sorted, about BATCH_WINDOWS windows at once. A key of many more windows has them alone, as hot ones; of
    what is equal its first row stays for the rest of the key, so memory is bounded by the different windows of a hash.
    """
    kept: list[pa.RecordBatch] = []

    def settle(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        c = {k: _column(batch, i) for i, k in enumerate(("key", "doc_id", "sub", "start", "n", "off"))}
        raw = batch.column(6)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        text = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(raw) else np.zeros(0, np.uint8)
        again = _windows_of(c, text, offsets[:-1] - offsets[0], length)
        item = again["item"]
        found = {"doc_id": c["doc_id"][item], "sub": c["sub"][item], "start": c["start"][item] + again["step"], "n": np.ones(len(item), np.int64)}
        gone = np.zeros(batch.num_rows, bool)
        gone[item] = True
        return _record(RANGE, found), batch.filter(pa.array(~gone | (c["n"] > 1)))

    size = 0
    for batch in batches:
        done = _column(batch, 5) == SETTLED
        if done.any():
            yield batch.filter(pa.array(done)).select([k.split(" ")[0] for k in RANGE.split(", ")])
            batch = batch.filter(pa.array(~done))
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += int(_column(batch, 4).sum())
        if size < BATCH_WINDOWS:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        key = _column(whole, 0)
        edge = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if edge:
            yield settle(whole.slice(0, edge))[0]
        rest = whole.slice(edge)
        if (_column(rest, 4) == 1).all() and rest.num_rows >= BATCH_WINDOWS // 2:
            found, rest = settle(rest)
            yield found
        kept, size = [rest], int(_column(rest, 4).sum())
    if kept:
        yield settle(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])[0]


def merged(ranges: np.ndarray, length: int) -> np.ndarray:
    """Maximal byte spans [from, to) covered by windows that start in ranges (start, n)."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 0] + ranges[:, 1] - 1 + length)
    new = np.append(True, ranges[1:, 0] > end[:-1])
    return np.stack([ranges[new, 0], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _spans(ranges: pa.Scalar, length: int) -> np.ndarray:
    inner = ranges.values
    return merged(np.stack([inner.field(0).to_numpy(), inner.field(1).to_numpy()], axis=1).astype(np.int64), length)


def _kept(raw: np.ndarray, spans: np.ndarray) -> np.ndarray:
    keep = np.ones(len(raw), dtype=bool)
    for a, b in spans.tolist():
        keep[a:b] = False
    return raw[keep]


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        out = []
        for r, (doc, ranges) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
            raw = data[at[r] : at[r + 1]]
            spans = _spans(ranges, length) if ranges.is_valid else np.zeros((0, 2), np.int64)
            kept = _kept(raw, spans).tobytes()
            out.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans.tolist()]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        if out:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _told_apart(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a column __sub: 0, or, for rows that share a doc_id, a hash of their text; and whether there are such."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    twice = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id", F.lit(True).alias("__twice")), "twice")
    if twice.isEmpty():
        return docs.withColumn("__sub", F.lit(0).cast("long")), False
    docs = docs.join(twice, "doc_id", "left").withColumn("__sub", F.when(F.col("__twice"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0)).drop("__twice")
    return docs, True


def _repeated(known: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, sub, ranges for rows of known (doc_id, sub, text), of which none has the doc_id and sub of another."""
    drop_shuffles(known.sparkSession)
    frequent = frequent_anchors(known, length, gram)
    found = known.mapInArrow(lambda b: _find_anchors(b, length, gram, frequent), ANCHOR)
    # rows that their batch has settled stand alone, by their document
    key = ["key", F.when(F.col("key").isNull(), F.col("doc_id"))]
    by_key, same = Window.partitionBy(*key), Window.partitionBy(*key, "around", "beside").orderBy("doc_id", "place")
    again = F.col("key").isNull() | (F.struct("doc_id", "place") > F.first(F.struct("doc_id", "place")).over(same))
    # only where a k-gram has several surroundings are there windows to compare
    several = (F.col("place") < 0) | (F.min(F.struct("around", "beside")).over(by_key) < F.max(F.struct("around", "beside")).over(by_key))
    hot = (F.col("place") < 0) | (F.count("*").over(by_key) > HOT)
    place = F.col("place").bitwiseAND(2**63 - 1)
    settled = (
        found.select(F.when(~again, F.col("key")).alias("key"), (hot & ~again).alias("hot"), "doc_id", "sub", "place", (again | several).alias("use"))
        .where("use")
        .select("key", "hot", "doc_id", "sub", F.shiftright(place, 32).cast("int").alias("start"), F.shiftright(place, 16).bitwiseAND(65535).cast("int").alias("n"), place.bitwiseAND(65535).cast("int").alias("off"))
    )
    settled = staged(settled, "anchors")
    drop_shuffles(known.sparkSession)
    compare = settled.where("key is not null").groupBy("doc_id", "sub").agg(F.collect_list(F.struct("key", "hot", "start", "n", "off")).alias("around"))
    windows = known.join(compare, ["doc_id", "sub"]).select("doc_id", "sub", "text", "around").mapInArrow(lambda b: _find_windows(b, length), WINDOW)
    windows = windows.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(lambda b: _sort_windows(b, length), RANGE)
    found = settled.where("key is null").select("doc_id", "sub", "start", "n").union(windows).groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    # written, so that the texts' way to the windows leaves the disk before their way to the ranges
    found = staged(found, "ranges")
    removed(settled)
    drop_shuffles(known.sparkSession)
    return found


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs with a column __sub, and (doc_id, sub, ranges) for the rows with windows that also start earlier: ranges of their starts, as (start, n).

    Earlier: in a document of smaller doc_id, or before in one of the same doc_id. Texts are UTF-8 bytes, null counts as
    empty; rows without doc_id take no part. gram: bytes of an anchor, at most `length`.
    """
    if not 1 <= length < 1 << 16 or (gram is not None and not 1 <= gram <= length):
        raise ValueError("length must be between 1 and 65535, and gram between 1 and length")
    docs, several = _told_apart(docs)
    known = docs.where("doc_id is not null").select("doc_id", F.col("__sub").alias("sub"), F.coalesce("text", F.lit("")).alias("text"))
    own = known.where("sub = 0").union(known.where("sub <> 0").dropDuplicates(["doc_id", "sub"])) if several else known
    return docs, _repeated(own, length, gram or max(1, min(GRAM, length // 3)))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """Removes from each text of docs (doc_id, text) every byte covered by a `length`-byte string that also starts earlier.

    Overlaps count, and strings are judged on the input. Earlier is a smaller doc_id, or the same doc_id and a
    smaller start: of repeated rows none is earlier than the other, so they remove nothing from each other. A null doc_id has nothing removed,
    nor makes others repeat. Null text counts as empty; texts of any length are taken whole; an empty table gives no rows; other columns, whatever
    their names, are left aside. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of
    the remaining bytes) and spans.
    """
    docs, ranges = repeated_ranges(docs.select("doc_id", "text"), length, gram)
    return docs.withColumnRenamed("__sub", "sub").join(ranges, ["doc_id", "sub"], "left").select("doc_id", "text", "ranges").mapInArrow(lambda b: _cut(b, length), OUT)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """docs with what suffix_dedup() removes cut from text; all other columns stay, n_chars (if there) is counted anew.

    A character that is cut in part goes whole. A text that is removed in full becomes empty; null stays null; an empty table stays so.
    """
    told, ranges = repeated_ranges(docs, length, gram)
    ranges = ranges.select(F.col("doc_id").alias("__of"), F.col("sub").alias("__at"), F.col("ranges").alias("__ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            data, at = text_buffers(batch.column(place))
            texts = batch.column(place).to_pylist()
            for r, found in enumerate(batch.column(batch.num_columns - 1)):
                if found.is_valid:
                    texts[r] = _kept(data[at[r] : at[r + 1]], _spans(found, length)).tobytes().decode("utf-8", "ignore")
            batch = batch.drop_columns(batch.schema.names[-1:]).set_column(place, batch.schema.field(place), pa.array(texts, batch.column(place).type))
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(k, batch.schema.field(k), pa.array([None if t is None else len(t) for t in texts], batch.column(k).type))
            yield batch

    joined = told.join(ranges, (told["doc_id"] == ranges["__of"]) & (told["__sub"] == ranges["__at"]), "left").select(*docs.columns, "__ranges")
    return joined.mapInArrow(run, docs.schema)
