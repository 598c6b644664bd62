"""Substring search in any case over an inverted table of trigrams, so that a search reads few texts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certame.sources import folders

#: Folders of trigrams, and of texts.
GRAM_PARTS, TEXT_PARTS = 64, 64
#: Tasks that share a folder of trigrams.
SPREAD = 8
WIDTH = 3
#: Trigrams of a term, the rarest ones, that its candidates must hold; the texts decide in the end.
RAREST = 4


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in lower case, as the search compares it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{WIDTH}}}))"), F.lit(1)))


def _part(c: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")


def _place(gram: Column) -> Column:
    """A trigram's place in the order of its characters as one number, which sorts faster than text."""
    at = lambda k: F.ascii(F.substring(gram, k, 1)).cast("long")
    return F.shiftleft(at(1), 42) + F.shiftleft(at(2), 21) + at(3)


@dataclass(frozen=True)
class TextIndex:
    """Two tables below a path, for rows (key, text).

    grams: (gram, key) in folders by add() (lote) and the gram's hash (part), sorted, so that a search opens the folders of its own trigrams and skips row groups within.
    sizes: (gram, n) in folders by the hash alone: in how many rows a gram is, for each add().
    texts: the rows in folders by the key's hash (part), of which a search opens those that hold a candidate, for each add() (lote).

    A key's rows of the last add() that has it count, so an edited text takes the place of the old one, and a null text takes a key out; trigrams
    of old texts only make candidates that their text then turns down, until build() starts anew. One add() at a time; one that dies before its texts are written changes no result.
    """

    spark: SparkSession
    path: str
    key: str
    key_type: str

    def _read(self, table: str) -> DataFrame:
        own = {"grams": f"gram string, {self.key} {self.key_type}", "sizes": "gram string, n long", "texts": f"text string, {self.key} {self.key_type}"}[table]
        return self.spark.read.schema(f"{own}, lote int, part int" if table != "sizes" else f"{own}, part int").parquet(f"{self.path}/{table}")

    def _of(self, table: str, cut: dict[str, list[tuple[str, int]]]) -> DataFrame:
        """Rows of a table for some terms' trigrams, from their folders only."""
        parts, names = {p for g in cut.values() for _, p in g}, {x for g in cut.values() for x, _ in g}
        return self._read(table).where(F.col("part").isin(sorted(parts)) & F.col("gram").isin(sorted(names)))

    def add(self, rows: DataFrame, text: str) -> None:
        """Takes rows in, in place of older ones of their keys; rows without a key are left out. A text shorter than a trigram is found by terms that are as short only."""
        done = [int(n.split("=")[1]) for n in folders.names(self.spark, f"{self.path}/texts") if n.startswith("lote=")]
        own = rows.select(F.col(self.key), F.col(text).alias("text")).where(F.col(self.key).isNotNull())
        lot = max(done, default=0) + 1
        posted = own.select(self.key, F.explode(grams(F.col("text"))).alias("gram")).withColumn("part", _part(F.col("gram"), GRAM_PARTS))
        posted = posted.repartition("part", F.pmod(F.xxhash64(self.key), F.lit(SPREAD))).withColumn("lote", F.lit(lot)).sortWithinPartitions(_place(F.col("gram")))
        posted.write.mode("append").partitionBy("lote", "part").parquet(f"{self.path}/grams")
        # counted from the table, so that texts are cut once
        sizes = self._read("grams").where(F.col("lote") == lot).groupBy("part", "gram").agg(F.count("*").alias("n")).select("gram", "n", "part")
        sizes.repartition("part").sortWithinPartitions("part", "gram").write.mode("append").partitionBy("part").parquet(f"{self.path}/sizes")
        kept = own.withColumns({"lote": F.lit(lot), "part": _part(F.col(self.key), TEXT_PARTS)}).repartition("part").sortWithinPartitions("part", self.key)
        kept.write.mode("append").partitionBy("lote", "part").parquet(f"{self.path}/texts")

    def _grams_of(self, terms: list[str]) -> dict[str, list[tuple[str, int]]]:
        """The trigrams of each term and their folders, cut by the same expressions as the texts'."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.explode_outer(grams(F.col("term"))).alias("gram"))
        found: dict[str, list[tuple[str, int]]] = {t: [] for t in terms}
        for r in asked.withColumn("part", _part(F.col("gram"), GRAM_PARTS)).collect():
            if r["gram"] is not None:
                found[r["term"]].append((r["gram"], r["part"]))
        return found

    def _rarest(self, cut: dict[str, list[tuple[str, int]]]) -> dict[str, list[tuple[str, int]]]:
        """The RAREST trigrams of each term; none for a term with a trigram that no row holds."""
        sizes = {r["gram"]: r["n"] for r in self._of("sizes", cut).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        return {t: sorted(g, key=lambda x: (sizes[x[0]], x))[:RAREST] for t, g in cut.items() if all(x in sizes for x, _ in g)}

    def candidates(self, terms: list[str]) -> DataFrame:
        """(term, key) of texts that hold the rarest trigrams of a term, for terms of three characters or more."""
        cut = {t: g for t, g in self._grams_of(terms).items() if g}
        cut = self._rarest(cut) if cut else cut
        posted = self._of("grams", cut)
        wanted = self.spark.createDataFrame([(t, x, len(g)) for t, g in cut.items() for x, _ in g], "term string, gram string, size int")
        met = posted.select("gram", self.key).distinct().join(F.broadcast(wanted), "gram")  # the asked terms' own trigrams
        return met.groupBy("term", "size", self.key).count().where("count = size").select("term", self.key)

    def search(self, terms: list[str]) -> DataFrame:
        """(term, key) of every text that holds a term, in any case; empty terms are not asked for, repeated ones count once.

        Candidates' folders are counted first, TEXT_PARTS at most, and named in the read; every candidate's text is then held against the term. A term
        shorter than a trigram is held against all texts.
        """
        asked = sorted({t for t in terms if t})
        long = [t for t, g in self._grams_of(asked).items() if g] if asked else []
        texts = self._read("texts")
        hit = F.coalesce(F.contains(F.lower("text"), F.lower("term")), F.lit(False)).alias("hit")
        found = []
        if long:
            hits = self.candidates(long).withColumn("part", _part(F.col(self.key), TEXT_PARTS))
            parts = sorted(r["part"] for r in hits.select("part").distinct().collect())
            pruned = texts.where(F.col("part").isin(parts)) if parts else texts.where("false")
            found.append(hits.join(pruned, ["part", self.key]).select("term", self.key, "lote", hit))
        if short := [t for t in asked if t not in long]:
            found.append(texts.withColumn("term", F.explode(F.array(*map(F.lit, short)))).select("term", self.key, "lote", hit))
        held = reduce(DataFrame.unionByName, found, texts.select(F.lit("").alias("term"), self.key, "lote", F.lit(False).alias("hit")).limit(0))
        last = held.groupBy("term", self.key).agg(F.max(F.struct("lote", "hit")).alias("last"))  # the newest rows of a key, any of which may hold the term
        return last.where("last.hit").select("term", self.key)


def build(rows: DataFrame, path: str, key: str, text: str) -> TextIndex:
    """A new index of rows below a path that is not there yet."""
    index = TextIndex(rows.sparkSession, path.rstrip("/"), key, dict(rows.dtypes)[key])
    index.add(rows, text)
    return index


def matching(questions: DataFrame, index: TextIndex, terms: list[str], key: str = "id") -> DataFrame:
    """Questions of which any indexed column holds any of the terms."""
    return questions.join(index.search(terms).select(F.col(index.key).alias(key)).distinct(), key, "left_semi")
