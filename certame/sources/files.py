"""Sources: JSON exports, folders of papers, photographs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certame import schemas
from certame.functions.text import year_of_file

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def _row(rows: DataFrame, condition: Column) -> Column:
    """condition, with a mention of a data column: Spark refuses queries that need the corrupt record alone, such as a count."""
    return condition & (F.length(F.concat_ws("", F.col(rows.columns[0]).cast("string"), F.lit("x"))) > 0)


def read_json(spark: SparkSession, path: str, schema: str = schemas.QUESTIONS) -> DataFrame:
    """Arrays of rows from a file, folder or pattern; no rows if nothing is there, bad files and rows are left out.

    Adds arquivo and, from its name, ano_arquivo. A filter on a folder's partition columns prunes files.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, arquivo string, ano_arquivo int")
    wide = f"{schema}, {CORRUPT} string"
    rows = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    rows = rows.withColumn("arquivo", F.input_file_name())
    return rows.where(_row(rows, F.col(CORRUPT).isNull())).drop(CORRUPT).withColumn("ano_arquivo", year_of_file(F.col("arquivo")))


def read_json_strict(spark: SparkSession, path: str, schema: str = schemas.QUESTIONS) -> DataFrame:
    """Fails on a missing file at once, on a bad one when it is read."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files of which a row can't be read."""
    schema = f"{schemas.QUESTIONS}, {CORRUPT} string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.withColumn("arquivo", F.input_file_name()).where(_row(rows, F.col(CORRUPT).isNotNull())).select("arquivo").distinct()


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, nome, pasta, modified, bytes) of a folder's files, contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    name, parent = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    return rows.select("path", name.alias("nome"), parent.alias("pasta"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def photographs(spark: SparkSession, folder: str, questions: int = 45) -> DataFrame:
    """(id, content, total_questoes); contents are decoded in the tasks that read bubbles."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select(F.col("path").alias("id"), "content", F.lit(questions).alias("total_questoes"))


PAGES = "path string, page int, texto string, imagem binary, erro string"


def pages(files: DataFrame, reader: Callable[[bytes], Iterator[tuple[str | None, bytes | None]]]) -> DataFrame:
    """Pages of files (path, content) by a reader that the caller brings: text, raster or OCR.

    A file that it fails on gives one row with erro. What a document is read with (a PDF or OCR library) stays out of the package.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, n, text, image, None) for n, (text, image) in enumerate(reader(content))]
                except Exception as e:
                    rows.append((path, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page", "texto", "imagem", "erro"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def page_counts(found: DataFrame) -> DataFrame:
    """Pages, beginning and its hash, and error of each file."""
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("page") < 3, F.struct("page", F.coalesce("texto", F.lit("")).alias("t"))))), lambda x: x["t"]), "")
    got = found.groupBy("path").agg(F.count("page").alias("paginas"), first.alias("inicio"), F.max("erro").alias("erro"))
    return got.withColumns({"texto_inicio": F.substring("inicio", 1, 3000), "hash_inicio": F.md5(F.substring("inicio", 1, 2000))}).drop("inicio")


def pending_reports(spark: SparkSession, path: str) -> DataFrame:
    """S20."""
    return read_json(spark, path, schemas.REPORTS).where("status = 'pendente'")
