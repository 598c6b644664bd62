"""Places, neighbours and runs of rows in an order, without a window over a whole group.

Rows are dealt out by ranges of the order, sorted within each, and numbered there; the ranges' sizes, a number for each, say where a range begins. So a group
(a source, say) of any size is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame.sources.staging import staged

#: Rows of a block, within which neighbours are looked up; the rows at its edges come along.
BLOCK = 1024
#: monotonically_increasing_id() counts within a partition in its lower bits.
LOW_BITS = 33


def ordered(rows: DataFrame, order: list[Column], name: str = "__g") -> DataFrame:
    """rows with their place in the order, from 0, without gaps. Of rows that the order does not tell apart any may come first, always the same one."""
    ranged = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", LOW_BITS)
    sizes = sorted(ranged.groupBy(part.alias("part")).count().collect())  # a row for each range
    starts, total = [], 0
    for number, n in sizes:
        starts.append((number, total))
        total += n
    known = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    placed = ranged.withColumn("__part", part).join(F.broadcast(known), "__part")
    return placed.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << LOW_BITS) - 1))).drop("__at", "__part", "__start")


def joined(rows: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of sums (a row for each value of by); nulls are one value."""
    named = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], *[c for c in sums.columns if c not in by])
    return rows.join(named, [rows[c].eqNullSafe(named[f"__by_{c}"]) for c in by]).drop(*[f"__by_{c}" for c in by])


def placed(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order within a group, from 1, and __g over all groups; nulls in by are one group."""
    along = ordered(rows, [*map(F.col, by), *order])
    first = along.groupBy(*by).agg(F.min("__g").alias("__first"))
    return joined(along, first, by).withColumn(name, F.col("__g") - F.col("__first") + 1).drop("__first")


def tied(rows: DataFrame, by: list[str], order: list[Column], equal: list[str], name: str) -> DataFrame:
    """rows with how many of their group stand no later than they do; rows equal in `equal` stand at one place."""
    along = placed(rows, by, order, "__place")
    last = along.groupBy(*by, *equal).agg(F.max("__place").alias(name))
    return joined(along.drop("__g", "__place"), last, [*by, *equal])


def beside(rows: DataFrame, by: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """rows (with __g) and, for each name, a column of the row before (-1) or after (1) in the same group; null where there is none.

    A window sees one block of places and the row on either side of it, which is dealt to both blocks.
    """
    block, place = F.floor(F.col("__g") / BLOCK), F.col("__g") % BLOCK
    seen = F.array_compact(F.array(block, F.when(place == BLOCK - 1, block + 1), F.when((place == 0) & (block > 0), block - 1)))
    dealt = rows.withColumn("__block", F.explode(seen))
    w = Window.partitionBy("__block").orderBy("__g")

    def of(column: str, shift: int) -> Column:
        there = lambda c: F.lag(c, -shift).over(w)
        same = F.lit(True)
        for c in by:
            same = same & there(c).eqNullSafe(F.col(c))
        return F.when(same, there(column))

    return dealt.withColumns({name: of(*what) for name, what in columns.items()}).where(F.col("__block") == block).drop("__block")


def runs(rows: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Runs of equal neighbours in a group: (by, grupo, value, inicio, fim), numbered from 1. Only the rows that open a run are looked at further."""
    along = placed(rows, by, order, "inicio").select(*by, value, "inicio", "__g")
    size = along.groupBy(*by).agg(F.count("*").alias("__size"))
    before = beside(along, by, {"__before": (value, -1)})
    opens = before.where((F.col("inicio") == 1) | ~F.col("__before").eqNullSafe(F.col(value))).select(*by, value, "inicio")
    numbered = beside(placed(opens, by, [F.col("inicio")], "grupo"), by, {"__next": ("inicio", 1)})
    return joined(numbered, size, by).select(*by, "grupo", value, "inicio", F.coalesce(F.col("__next") - 1, "__size").alias("fim"))
