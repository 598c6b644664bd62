"""Functions on arrays, maps and structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from certame import fixed

LETTERS = lambda: F.array(*map(F.lit, fixed.LETTERS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, however often, and in whatever lambda, body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def options_map(texts: Column) -> Column:
    """a list of options as a map from A, B, ..."""
    return F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.greatest(F.size(texts) - 1, F.lit(0))), lambda i: F.char(F.lit(65) + i)), texts)


def as_array(c: Column) -> Column:
    """F41."""
    return F.array(c)


def image_struct(c: Column) -> Column:
    """an image item as a struct, whether it is JSON or a bare path."""
    told = F.from_json(c, "path string, posicao string, supabase_url string")
    bare = F.struct(c.alias("path"), F.lit("").alias("posicao"), F.lit(None).cast("string").alias("supabase_url"))
    return F.when(F.ltrim(c).startswith("{"), told).otherwise(bare)


def default_position(images: Column, position: str = "antes_1") -> Column:
    """images without a position take one."""
    return F.transform(images, lambda i: i.withField("posicao", F.coalesce(F.nullif(i["posicao"], F.lit("")), F.lit(position))))


def without_path(images: Column, path: Column) -> Column:
    """F44."""
    return F.filter(images, lambda i: ~i["path"].eqNullSafe(path))


def map_without(values: Column, value: Column) -> Column:
    """entries with another value; null if none is left."""
    kept = F.map_filter(values, lambda k, v: ~v.eqNullSafe(value))
    return F.when(F.size(kept) > 0, kept)


def put_image(images: Column, image: Column) -> Column:
    """replaces the image of the same path, else appends it."""
    there = F.exists(images, lambda i: i["path"] == image["path"])
    return F.when(there, F.transform(images, lambda i: F.when(i["path"] == image["path"], image).otherwise(i))).otherwise(F.array_append(F.coalesce(images, F.array()), image))


def map_put(values: Column, key: Column, value: Column) -> Column:
    """F47."""
    return F.map_concat(F.map_filter(values, lambda k, v: k != key), F.create_map(key, value))


def letters_present(options: Column) -> Column:
    """letters with a text, in order."""
    return F.filter(LETTERS(), lambda x: F.coalesce(F.try_element_at(options, x), F.lit("")) != "")


def option_lines(options: Column, between: str = "\n") -> Column:
    """'A) text' lines in the order of letters."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), between)


def image_slots(n: Column) -> Column:
    """places for images around n paragraphs."""
    between = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("entre_"), i.cast("string"), F.lit("_"), (i + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    last = F.when(n > 0, F.array(F.lit("apos_ultimo"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("antes_1")), between, last)


def first_or_null(items: Column) -> Column:
    """F55."""
    return F.get(items, F.lit(0))


def before_images(images: Column) -> Column:
    """Images that stand before the text."""
    return F.filter(images, lambda i: i["posicao"].startswith("antes"))


def row_json(columns: list[str], keep_null: tuple[str, ...]) -> Column:
    """a row as JSON without null fields, but for those that may be null."""
    free = F.to_json(F.struct(*[c for c in columns if c not in keep_null]))
    held = [c for c in columns if c in keep_null]
    if not held:
        return free
    kept = F.to_json(F.struct(*held), {"ignoreNullFields": "false"})
    return F.when(free == "{}", kept).otherwise(F.concat(F.substring(free, 1, 1 << 30).substr(F.lit(1), F.length(free) - 1), F.lit(","), kept.substr(F.lit(2), F.length(kept))))


def nul_free(items: Column) -> Column:
    """F23 on arrays."""
    return F.transform(items, lambda x: F.replace(x, F.lit("\0"), F.lit("")))


def key_map(answer: Column, strict: bool = True) -> Column:
    """numbers to letters from {"gabarito": {...}}.

    Keys are digits, values one letter A to E or null. Without strict, a value may be any run of ABCDE, or empty.
    """
    got = F.from_json(answer, "gabarito map<string,string>")["gabarito"]
    fits = (lambda v: F.upper(v).rlike("^[A-E]$")) if strict else (lambda v: F.contains(F.lit("ABCDE"), F.upper(v)))
    kept = F.map_filter(got, lambda k, v: k.rlike(r"^\d+$") & (v.isNull() | fits(v)))
    return F.transform_values(F.transform_keys(kept, lambda k, v: k.cast("int")), lambda k, v: F.nullif(F.upper(v), F.lit("")))
