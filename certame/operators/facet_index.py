"""Counts of facets under chosen filters, from bitmaps of question numbers instead of the questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = "__bucket"


def build(questions: DataFrame, facets: tuple[str, ...], id: str = "id") -> DataFrame:
    """(faceta, valor, bucket, bits): for each value of each facet the questions that have it, a bitmap for 32,768 numbers. One pass over the rows; nulls are no value, and a repeated number counts once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("faceta"), F.col(c).cast("string").alias("valor")) for c in facets]))
    rows = questions.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("n"), pairs.alias("f")).where("f.valor is not null")
    return rows.groupBy("f.faceta", "f.valor", F.bitmap_bucket_number("n").alias(PLACE)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def counts(index: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """(faceta, valor, total) of every value under the chosen values of all other facets; values that none has left are left out.

    Of one facet any chosen value will do. A facet without chosen values filters nothing; one with an empty list, nothing either. Bitmaps of a bucket meet at that
    bucket: those of a facet's chosen values as one, then each value's with those of the other facets.
    """
    kept = {f: [str(v) for v in values] for f, values in chosen.items() if values}
    allowed = [
        index.where((F.col("faceta") == f) & F.col("valor").isin(values)).groupBy(PLACE).agg(F.bitmap_or_agg("bits").alias("bits")).select(F.lit(f).alias("by"), PLACE, F.col("bits").alias("filter"))
        for f, values in kept.items()
    ]
    if not allowed:
        return index.groupBy("faceta", "valor").agg(F.sum(F.bitmap_count("bits")).alias("total"))
    filters = reduce(DataFrame.unionByName, allowed)
    met = index.join(filters, PLACE).where("faceta <> by").select("faceta", "valor", PLACE, "by", F.explode(F.array("bits", "filter")).alias("bits"))
    both = met.groupBy("faceta", "valor", PLACE).agg(F.bitmap_and_agg("bits").alias("bits"), F.count_distinct("by").alias("filters"))
    # a bucket in which one of the other facets has no chosen question is not met by all of them
    needed = F.lit(len(kept)) - F.col("faceta").isin(*kept).cast("int")
    under = both.where(F.col("filters") == needed)
    free = index.where(F.col("faceta").isin(*kept)) if len(kept) == 1 else index.limit(0)  # its own choice is the only one
    every = under.select("faceta", "valor", "bits").unionByName(free.select("faceta", "valor", "bits"))
    return every.groupBy("faceta", "valor").agg(F.sum(F.bitmap_count("bits")).alias("total")).where("total > 0")
