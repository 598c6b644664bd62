"""Language by fusion of evidence: the text, the declared language, the address suffix, and what the host's other pages say."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certame.llm.kernels import LOWER, SMALL_SLICE, list_array, text_slices
from certame.llm.storage import staged

#: No language: what is likelier drawn evenly from all features than from any language.
NONE = "und"
BUCKETS = 1 << 14
#: Labelled rows that the text model is fitted on, at most: those whose hashed doc_id is smallest.
TRAIN_ROWS = 4000
#: A text counts as so many independent features at most, else long texts would silence all other evidence.
TEXT_WEIGHT = 60.0
#: Chance that a declared language, and one that belongs to an address suffix, is the true one.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.7
#: Pages that a host's own counts, and a domain's, are worth when they meet the level above.
HOST_STRENGTH, DOMAIN_STRENGTH = 5.0, 10.0
ACCEPT = 0.5
#: Languages of address suffixes.
SUFFIXES = {
    "de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "sn": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "ve": "es", "uy": "es", "ec": "es",
    "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "pt": "pt", "br": "pt", "it": "it", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko",
}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    #: Logarithms of likelihoods, a row for each bucket, a column for each language.
    table: np.ndarray


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of letters with word edges, and the row of each."""
    low = LOWER[data]
    if len(low) > 1:  # capital letters of the Latin-1 block
        second = np.append(False, low[:-1] == 0xC3)
        low = np.where(second & (low >= 0x80) & (low <= 0x9E), low + np.uint8(0x20), low)
    letter = _LETTER[low]
    plain = np.where(letter, low, 32).astype(np.uint32)
    if len(plain) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    use = np.flatnonzero(letter[1:-1] & (row[:-2] == row[2:]))
    code = (plain[use] << 16) | (plain[use + 1] << 8) | plain[use + 2]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64), row[use].astype(np.int64)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> TextModel:
    """Fits the text model on at most `rows` rows of docs (doc_id, text, lang) that have a lang.

    Only their sums reach the driver: BUCKETS numbers for each language. Without labelled rows the model knows no language.
    """
    chosen = docs.where("lang is not null and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text", "lang").where("lang is not null").join(F.broadcast(chosen.distinct()), "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text_slices(batches, most=SMALL_SLICE):
            names, kind = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            bucket, row = features(data, at)
            n = np.bincount(kind[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(names[some // BUCKETS].tolist(), pa.string()), pa.array(some % BUCKETS, pa.int64()), pa.array(n[some], pa.int64())], ["lang", "bucket", "n"])

    got = sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    counts = np.full((BUCKETS, len(languages) + 1), 0.5)
    for k, name in enumerate(languages):
        own = got[got["lang"] == name]
        counts[own["bucket"], k] += own["n"]
    counts[:, -1] = 1.0
    return TextModel((*languages, NONE), np.log(counts / counts.sum(axis=0)))


def suffix_language(host: Column) -> Column:
    """Language of the last part of a host, null if it has none."""
    last = F.lower(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), last)


def identify(rows: DataFrame, model: TextModel, accept: float = ACCEPT) -> DataFrame:
    """Adds lang, confidence and accepted to rows (key, text, declared, host); keeps key, declared and host.

    The posterior of a language is its text likelihood, times the chance of the declared language
    (its first two letters; unknown ones tell nothing), times that of the address suffix, times its prior at the host. That prior is what
    the host's other rows gave without it, smoothed towards the host's domain (its last two parts), this towards all rows, these
    towards equal shares; own counts are left out. Counts come from grouped sums. accepted: a language
    with at least `accept` of the posterior. Null or empty texts, and such without letters, tell nothing and
    are not accepted (und). Null hosts are one host. Ties go to the language first by name. Repeated rows, and rows with a null key, count each. A text of
    any length is read whole, and weighs TEXT_WEIGHT features at most; an empty table gives no rows; other columns, whatever their names, are left aside.
    """
    names = list(model.languages)
    shared = model.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in text_slices(batches, most=SMALL_SLICE):
            bucket, row = features(data, at)
            n = np.bincount(row, minlength=batch.num_rows)
            log = np.stack([np.bincount(row, weights=shared[bucket, k], minlength=batch.num_rows) for k in range(len(names))], axis=1).astype(np.float64)
            log *= (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), list_array(log.ravel(), np.arange(batch.num_rows + 1) * len(names), pa.float64())], ["key", "declared", "host", "features", "log"])

    key = rows.schema["key"].dataType.simpleString()
    told = rows.select("key", "text", F.col("declared").cast("string"), F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host")).mapInArrow(run, f"key {key}, declared string, host string, features long, log array<double>")
    others = max(len(names) - 2, 1)

    def chance(said: Column, name: str, right: float) -> Column:
        known = said.isin(*[n for n in names if n != NONE]) if len(names) > 1 else F.lit(False)
        if name == NONE:
            return F.when(known, F.lit(float(np.log(1.0 / max(len(names) - 1, 1))))).otherwise(0.0)
        return F.when(~F.coalesce(known, F.lit(False)), 0.0).when(said == name, F.lit(float(np.log(right)))).otherwise(float(np.log((1 - right) / others)))

    declared = F.substring(F.lower(F.trim("declared")), 1, 2)
    suffix = suffix_language(F.col("host"))
    own = F.array(*[F.col("log")[k] + chance(declared, n, DECLARED_RIGHT) + chance(suffix, n, SUFFIX_RIGHT) for k, n in enumerate(names)])

    def normal(logs: Column) -> Column:
        top = F.array_max(logs)
        odds = F.transform(logs, lambda x: F.exp(x - top))
        return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))

    told = told.withColumn("own", own).withColumn("share", normal(F.col("own"))).withColumn("domain", F.substring_index("host", ".", -2))
    told = staged(told.drop("log"), "language")
    size = len(names)
    sums = [F.sum(F.col("share")[k]).alias(f"s{k}") for k in range(size)]
    array = lambda: F.array(*[F.col(f"s{k}") for k in range(size)])
    hosts = staged(told.groupBy("domain", "host").agg(*sums), "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(size)])
    total = domains.agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(size)]).first()
    everywhere = np.array([x or 0.0 for x in total]) + 1.0
    everywhere /= everywhere.sum()
    priors = hosts.select("domain", "host", array().alias("host_sums")).join(domains.select("domain", array().alias("domain_sums")), "domain").drop("domain")
    less = lambda name, k: F.greatest(F.col(name)[k] - F.col("share")[k], F.lit(0.0))
    plus = lambda name: F.greatest(F.aggregate(name, F.lit(0.0), lambda a, b: a + b) - 1, F.lit(0.0))
    domain_prior = [(less("domain_sums", k) + DOMAIN_STRENGTH * float(everywhere[k])) / (plus("domain_sums") + DOMAIN_STRENGTH) for k in range(size)]
    host_prior = [(less("host_sums", k) + HOST_STRENGTH * domain_prior[k]) / (plus("host_sums") + HOST_STRENGTH) for k in range(size)]
    joined = told.join(priors, "host").withColumn("post", normal(F.array(*[F.col("own")[k] + F.log(host_prior[k]) for k in range(size)])))
    best = F.array_position("post", F.array_max("post"))
    return joined.select(
        "key", "declared", "host",
        F.when(F.col("features") == 0, NONE).otherwise(F.element_at(F.array(*map(F.lit, names)), best.cast("int"))).alias("lang"),
        F.when(F.col("features") == 0, 0.0).otherwise(F.array_max("post")).alias("confidence"),
    ).withColumn("accepted", (F.col("lang") != NONE) & (F.col("confidence") >= accept))


SCRIPT = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
TAG = r"(?s)<!--.*?-->|<[^>]*>"
DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)"


def page_rows(pages: DataFrame) -> DataFrame:
    """identify()'s columns from pages (page_id, url, html)."""
    from certame.llm.url_filter import host_of

    html = F.col("html")
    return pages.select(
        F.col("page_id").alias("key"),
        F.regexp_replace(F.regexp_replace(html, SCRIPT, " "), TAG, " ").alias("text"),
        F.nullif(F.regexp_extract(html, DECLARED, 1), F.lit("")).alias("declared"),
        host_of(F.col("url")).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """identify()'s columns from documents (doc_id, text, lang, source): the source stands for the host."""
    return docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
