"""Functions on numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from certame import fixed


def half_up(c: Column) -> Column:
    """to the nearest whole number, halves upwards."""
    return F.floor(c + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percent, 0 of nothing."""
    return F.when(whole > 0, half_up(part * 100.0 / whole)).otherwise(F.lit(0).cast("long"))


def coverage(answered: Column, catalogue: Column) -> Column:
    """At most 100; an unknown catalogue counts as one."""
    return F.least(F.lit(100).cast("long"), half_up(answered * 100.0 / F.coalesce(F.nullif(catalogue, F.lit(0)), F.lit(1))))


def minutes(start: Column, end: Column) -> Column:
    """null while it lasts."""
    return half_up((F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))) / 60000.0)


def medal(pct: Column) -> Column:
    """F62."""
    out = None
    for least, name in fixed.MEDALS:
        out = F.when(pct >= least, name) if out is None else out.when(pct >= least, name)
    return out.otherwise("nenhuma")


def performance(pct: Column) -> Column:
    """F63."""
    return F.when(pct >= 70, "verde").when(pct >= 50, "amarelo").otherwise("vermelho")


def clock(seconds: Column) -> Column:
    """F64: h:mm:ss, without hours mm:ss."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s.cast("long"))).otherwise(F.format_string("%02d:%02d", m, s.cast("long")))


def clock_colour(seconds: Column) -> Column:
    """F64."""
    return F.when(seconds < 300, "vermelho").when(seconds < 600, "amarelo").otherwise("normal")


def time_budget(questions: Column) -> Column:
    return (questions * fixed.MINUTES_PER_QUESTION * 60).cast("long")


def local_date(c: Column) -> Column:
    """dd/MM/yyyy; what is no date stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "dd/MM/yyyy"), c)


def to_int(c: Column) -> Column:
    """null where it is no number."""
    return F.expr("1") * c.try_cast("int")


def skill_number(c: Column) -> Column:
    """The digits of a code."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).cast("int")


def spread_page(item: Column, items: Column, first: int, pages: Column) -> Column:
    """The page of item (from 0) of so many, dealt evenly from page `first` on."""
    return F.least(first + F.floor(item * (pages - first) / items), pages - 1).cast("int")


def pick(values: Column, i: Column) -> Column:
    """The element at i modulo the length."""
    return F.element_at(values, (F.pmod(i, F.size(values)) + 1).cast("int"))


def decision(fill: Column) -> Column:
    """Letter and confidence of one question from the fill of its bubbles."""
    top = F.array_max(fill)
    second = F.get(F.sort_array(fill, asc=False), F.lit(1))
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    letter = F.element_at(F.array(*map(F.lit, fixed.LETTERS)), F.array_position(fill, top).cast("int"))
    sure = F.least(F.lit(1.0), (top - fixed.FILLED) / (1 - fixed.FILLED))
    empty = (F.size(fill) == 0) | (top < fixed.FILLED)
    close = F.coalesce(top - second < fixed.CLEAR_LEAD, F.lit(False))
    return F.when(F.coalesce(empty, F.lit(True)), F.struct(none.alias("letra"), zero.alias("confianca"))).when(close, F.struct(none.alias("letra"), F.lit(fixed.DOUBTFUL).alias("confianca"))).otherwise(F.struct(letter.alias("letra"), sure.alias("confianca")))


def bubble_grid(question: Column, option: Column, questions: int) -> Column:
    """centre of a bubble (both from 0) on the rectified sheet, in pixels."""
    left, top = int(fixed.SHEET_MARGIN * fixed.SHEET_WIDTH), int(fixed.SHEET_HEADER * fixed.SHEET_HEIGHT)
    cell = (fixed.SHEET_WIDTH - 2 * left) // fixed.PER_ROW
    height = (fixed.SHEET_HEIGHT - top - fixed.SHEET_FOOTER) // max(-(-questions // fixed.PER_ROW), 1)
    block = 5 * fixed.BUBBLE + 4 * fixed.BUBBLE_GAP
    x = left + F.pmod(question, F.lit(fixed.PER_ROW)) * cell + cell // 2 - block // 2 + option * (fixed.BUBBLE + fixed.BUBBLE_GAP) + fixed.BUBBLE // 2
    y = top + F.floor(question / fixed.PER_ROW) * height + height // 2
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def corner(points: Column, which: str) -> Column:
    """V3: a corner of four points: tl, tr, bl or br, by the extremes of x + y and y - x."""
    size = (lambda p: p["x"] + p["y"]) if which in ("tl", "br") else (lambda p: p["y"] - p["x"])
    best = F.array_min if which in ("tl", "tr") else F.array_max
    keyed = F.transform(points, lambda p: F.struct(size(p).alias("k"), p.alias("p")))
    return best(keyed)["p"]
