"""How the sources of a language differ in their terms: exact shares, their divergence for every pair of sources, and the terms behind it.

Tokens are sorted by language, term, source and document where their text is read; runs of equal ones give document frequencies and counts, which are
dealt by language and term, sorted again, and scanned run by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame.llm.kernels import LOWER, text_slices, word_spans
from certame.llm.storage import drop_shuffles, staged

#: Documents of a language that must hold a term for it to be kept.
LEAST_DOCS = 10
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Text that is sorted at a time.
SORT_BYTES = 8 << 20
#: Pairs of sources are dealt out by so many blocks of the one side.
BLOCKS = 16
#: Pairs whose values are summed at a time.
PAIR_ROWS = 1 << 20

#: Whatever is no letter of ASCII and no byte of a longer character parts terms.
_BREAK = np.ones(256, dtype=bool)
_BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False

COUNTS = "lang string, term string, source string, docs long, n long"
RUNS = "lang string, term string, source string, n long, total long, opens boolean"


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sorted_runs(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text) the runs of equal (lang, term, source) of each slice's sorted tokens: how many documents, how many tokens."""
    for batch, data, at in text_slices(batches, most=slice_bytes):
        low = LOWER[data]
        start, end, first = word_spans(low, at, _BREAK)
        if not len(start):
            continue
        letters = np.ascontiguousarray(low[~_BREAK[low]])
        offsets = np.append(0, np.cumsum(end - start))
        tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters))
        term, terms = _codes(tokens)
        lang, langs = _codes(batch.column(0))
        source, sources = _codes(batch.column(1))
        row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(first))
        key = ((lang[row] * len(terms) + term) * len(sources) + source[row]) * batch.num_rows + row
        key.sort()
        opens = np.append(True, key[1:] != key[:-1])  # a document's tokens of a term
        key //= batch.num_rows
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        docs, n = np.add.reduceat(opens.astype(np.int64), edge), np.diff(np.append(edge, len(key)))
        key = key[edge]
        held, key = key % len(sources), key // len(sources)
        word, tongue = key % len(terms), key // len(terms)
        yield pa.record_batch([langs.take(pa.array(tongue)), terms.take(pa.array(word)).cast(pa.string()), sources.take(pa.array(held)), pa.array(docs), pa.array(n)], ["lang", "term", "source", "docs", "n"])


def _opens(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Where a sorted batch's rows differ from the row before in any of the columns."""
    out = np.ones(batch.num_rows, dtype=bool)
    out[1:] = False
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        out[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that no (lang, term) is parted; the runs of equal (lang, term, source) at a cut are summed while they wait."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
        cut = int(np.flatnonzero(_opens(both, ("lang", "term")))[-1])
        if cut:
            yield both.slice(0, cut)
        rest = both.slice(cut)
        if "docs" in rest.schema.names:
            rest = _summed(rest)
    if rest is not None:
        yield rest


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of equal (lang, term, source), which stand together, as one."""
    edge = np.flatnonzero(_opens(batch, ("lang", "term", "source")))
    keys = batch.select(["lang", "term", "source"]).take(pa.array(edge))
    sums = [pa.array(np.add.reduceat(batch.column(k).to_numpy(), edge)) for k in (3, 4)]
    return pa.record_batch([*keys.columns, *sums], batch.schema.names)


def kept_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of terms that enough documents of the language hold, with the language's count of the term; opens marks a term's first run."""
    for batch in by_term(batches):
        runs = _summed(batch)
        opens = _opens(runs, ("lang", "term"))
        edge, docs, n = np.flatnonzero(opens), runs.column(3).to_numpy(), runs.column(4).to_numpy()
        size = np.diff(np.append(edge, len(docs)))
        keep = np.repeat(np.add.reduceat(docs, edge) >= LEAST_DOCS, size)
        if keep.any():
            total = np.repeat(np.add.reduceat(n, edge), size)
            chosen = runs.select(["lang", "term", "source"]).take(pa.array(np.flatnonzero(keep)))
            yield pa.record_batch([*chosen.columns, pa.array(n[keep]), pa.array(total[keep]), pa.array(opens[keep])], ["lang", "term", "source", "n", "total", "opens"])


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shared_terms(batches: Iterator[pa.RecordBatch], pair_rows: int) -> Iterator[pa.RecordBatch]:
    """From sorted (lang, term, source, p, z) the partial sums over terms that two sources share, for each pair a < b.

    Each term adds what its two shares give beyond what each gives against the other's share of a term that it lacks (z). Partners
    are met step by step along a term's run, so a batch holds no list of all of them.
    """
    for batch in by_term(batches):
        lang, langs = _codes(batch.column(0))
        source, sources = _codes(batch.column(2))
        p, z = (batch.column(k).to_numpy() for k in (3, 4))
        edge = np.flatnonzero(_opens(batch, ("lang", "term")))
        end = np.repeat(np.append(edge[1:], batch.num_rows), np.diff(np.append(edge, batch.num_rows)))
        keys, sums, waiting = [], [], 0

        def flush(keys=keys, sums=sums, langs=langs, sources=sources) -> pa.RecordBatch:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            value = np.bincount(where, weights=np.concatenate(sums)).astype(np.int64)  # sums of some pair_rows numbers below 4e9: exact
            b, key = key % len(sources), key // len(sources)
            keys.clear(), sums.clear()
            return pa.record_batch([langs.take(pa.array(key // len(sources))), sources.take(pa.array(key % len(sources))), sources.take(pa.array(b)), pa.array(value)], ["lang", "source", "item", "value"])

        i, step = np.arange(batch.num_rows), 1
        while len(i := i[i + step < end[i]]):
            for lo in range(0, len(i), pair_rows):
                a = i[lo : lo + pair_rows]
                b = a + step
                keys.append((lang[a] * len(sources) + source[a]) * len(sources) + source[b])
                sums.append((gap(p[a], p[b]) - gap(p[a], z[b]) - gap(z[a], p[b]) + gap(z[a], z[b])).astype(np.float64))
                waiting += len(a)
                if waiting >= pair_rows:
                    yield flush()
                    waiting = 0
            step += 1
        if keys:
            yield flush()


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact at any size; null where there are no terms."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(19,0)) div nullif(cast({total} + 2 * {terms} as decimal(19,0)), 0)")


def distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def divergence(docs: DataFrame, slice_bytes: int = SORT_BYTES, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text): part pair, all other sources of the language by divergence; part term, ten terms at most.

    A row is a document; null lang, source and text are ''. Terms are runs of letters, of which A to Z are lower-cased, and kept if
    LEAST_DOCS rows of their language hold them. Rows without terms still make a group. Of a language without kept terms all values are 0, and it has
    no part term. Equal values go by the item's bytes. A text of any length is read whole, and a language, source or term with very many rows comes as a sum for
    each slice of text. Repeated rows count each; other columns are left alone; an empty table gives no rows.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    dealt = rows.mapInArrow(lambda batches: sorted_runs(batches, slice_bytes), COUNTS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    runs = staged(dealt.mapInArrow(kept_runs, RUNS), "runs")
    drop_shuffles(docs.sparkSession)
    by_source = runs.groupBy("lang", "source").agg(F.sum("n").alias("tokens"))
    by_lang = runs.groupBy("lang").agg(F.sum("n").alias("lang_tokens"), F.count_if("opens").alias("terms"))
    none = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["tokens", "lang_tokens", "terms"])
    groups = staged(groups.withColumn("z", share("0", "tokens", "terms")), "groups")
    told = runs.join(groups, ["lang", "source"]).withColumn("p", share("n", "tokens", "terms"))

    whole = told.withColumn("q", share("total", "lang_tokens", "terms")).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term"))

    # a term that one source has and the other lacks counts by its share and the other's z: all such terms of one count at once
    counts = told.groupBy("lang", "source", "n").agg(F.count("*").alias("times"), F.first("p").alias("p"), F.first("z").alias("z"))
    block = F.pmod(F.xxhash64("source"), F.lit(BLOCKS)).cast("int").alias("block")
    others = groups.select("lang", block, F.col("source").alias("item"), F.col("z").alias("other"))
    met = lambda df: df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).join(others, ["lang", "block"]).where("source <> item")
    none_shared = met(groups.select("lang", "source", "z", "terms")).select("lang", "source", "item", F.coalesce(F.expr("terms * " + distance("z", "other")), none).alias("value"))
    one_side = met(counts).groupBy("lang", "source", "item").agg(F.sum(F.expr(f"times * ({distance('p', 'other')} - {distance('z', 'other')})")).alias("value"))
    dealt = told.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = dealt.mapInArrow(lambda batches: shared_terms(batches, pair_rows), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    half = staged(one_side.unionByName(both), "pairs")
    pairs = none_shared.unionByName(half).unionByName(turned(half)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(terms.select(*columns))


#: The same for DuckDB, over every kept term of every group.
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
tok AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS nn FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (nn + 2 * v))::BIGINT AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL), ln AS (SELECT lang, sum(n) AS nn FROM c GROUP BY ALL),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // (nn + 2 * v))::BIGINT AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pr AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN pv USING (lang, source, item)),
tr AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
