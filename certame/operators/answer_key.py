"""Answer keys from text: three layouts, the first that gives enough entries counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certame.functions.arrays import let
from certame.sources.staging import dealt

LEAST = 5
# The three layouts.
TABLE = r"(\d{1,2})\s+([A-E])\b"
TABLE_STRICT = r"(?:^|\D)(\d{1,3})\s+([A-E])\b"
LINES = r"(?im)^(\d{1,3})[.\-]\s*([A-E]|ANULADA)(?:\s|$)"
BRACKETS = r"(?i)(\d{1,3})[.\-]\s*\[([A-E])\](?:\s*[-–]\s*(ANULADA))?"


def _entries(text: Column, pattern: str, voided: int | None = None) -> Column:
    """Structs (numero, letra) in the order of the text; numbers 1 to 180."""
    all_of = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = [all_of(1).alias("n"), all_of(2).alias("l")] + ([all_of(voided).alias("v")] if voided else [])
    letter = lambda e: F.when((F.length(e["l"]) > 1) | (F.coalesce(e["v"], F.lit("")) != "" if voided else F.lit(False)), None).otherwise(F.upper(e["l"]))
    rows = F.transform(F.arrays_zip(*parts), lambda e: F.struct(e["n"].try_cast("int").alias("numero"), letter(e).alias("letra")))
    return F.filter(rows, lambda r: r["numero"].between(1, 180))


def _last_wins(entries: Column) -> Column:
    """The last entry of each number, by number; none if they are too few. Sorted by number and place, an entry is last where the next number differs."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["numero"].alias("numero"), i.alias("i"), e["letra"].alias("letra"))))

    last = lambda all_: F.filter(all_, lambda e, i: ~F.get(all_, i + 1)["numero"].eqNullSafe(e["numero"]))
    enough = lambda own: F.when(F.size(own) >= LEAST, F.transform(own, lambda e: F.struct(e["numero"].alias("numero"), e["letra"].alias("letra"))))
    return let(placed, lambda all_: let(last(all_), enough))


def by_table(text: Column, strict: bool = False) -> Column:
    """X5: '01 A  02 B'. Of a three-digit number the last two digits are read, unless strict."""
    return _last_wins(_entries(text, TABLE_STRICT if strict else TABLE))


def by_lines(text: Column) -> Column:
    """X6: '1. A' on a line; ANULADA voids."""
    return _last_wins(_entries(text, LINES))


def by_brackets(text: Column) -> Column:
    """X7: '1. [A] - ANULADA'."""
    return _last_wins(_entries(text, BRACKETS, 3))


def answer_key(text: Column, strict: bool = False, fallback: Column | None = None) -> Column:
    """Array of (numero, letra); null letters are voided, null if no layout fits and no fallback (a model's answer) tells."""
    found = [by_table(text, strict), by_lines(text), by_brackets(text)]
    return F.coalesce(*found, *([fallback] if fallback is not None else []))


def key_rows(papers: DataFrame, text: str = "texto", strict: bool = False) -> DataFrame:
    """One row for each entry of each paper's key."""
    rest = [c for c in papers.columns if c != text]
    return dealt(papers).select(*rest, F.explode(answer_key(F.col(text), strict)).alias("k")).select(*rest, F.col("k.numero").alias("numero"), F.col("k.letra").alias("letra"))


def with_key(questions: DataFrame, key: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Gabarito and anulada of questions: voided is a number that the key holds without a letter, not one that it lacks.

    A key's entries come from texts, whose size does not tell how many there are, so they are dealt out by paper and never broadcast.
    """
    k = key.select(*on, "letra", F.lit(True).alias("__there")).hint("merge")
    joined = questions.drop("gabarito", "anulada").join(k, list(on), "left")
    return joined.withColumns({"gabarito": F.col("letra"), "anulada": F.coalesce("__there", F.lit(False)) & F.col("letra").isNull()}).drop("letra", "__there")
