"""Items of mixed shape: bare text in old exports, objects in new ones, read as variants and lifted to one struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "struct<path:string,posicao:string,supabase_url:string>"
ITEM = "item"


def items(value: Column) -> Column:
    """a variant as an array of variants; anything but an array is one item, and null none."""
    kind = F.schema_of_variant(value)
    several = F.when(kind.startswith("ARRAY"), value).cast("array<variant>")
    return F.when(value.isNull() | (kind == "VOID"), F.array().cast("array<variant>")).when(kind.startswith("ARRAY"), several).otherwise(F.array(value))


def image(item: Column, position: str = "antes_1") -> Column:
    """an image as a struct: text is its path, an object says more; a missing or empty place is `position`. Null without a path."""
    kind = F.schema_of_variant(item)
    of = lambda k: F.when(kind.startswith("OBJECT"), F.try_variant_get(item, f"$.{k}", "string"))
    path = F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).otherwise(of("path"))
    place = F.coalesce(F.nullif(of("posicao"), F.lit("")), F.lit(position))
    return F.when(path.isNotNull(), F.struct(path.alias("path"), place.alias("posicao"), of("supabase_url").alias("supabase_url")))


def images(value: Column, position: str = "antes_1") -> Column:
    """All images of a question, whatever shape they were saved in; items that are no image are left out."""
    return F.filter(F.transform(items(value), lambda item: image(item, position)), lambda i: i.isNotNull())


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of JSON files, each an array, as variants, whatever their shapes."""
    return spark.read.option("singleVariantColumn", ITEM).option("multiLine", True).json(path)


def shape(rows: DataFrame, column: str) -> DataFrame:
    """One row: the schema that holds all values of a variant column."""
    return rows.agg(F.schema_of_variant_agg(column).alias("schema"))
