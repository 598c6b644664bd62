"""Every query that has SQL gives the rows of that SQL in another engine."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from certame import catalogue


def plain(v):
    """A value as both engines would print it: floats to nine digits, NaN as null, sequences as tuples."""
    if v is None or isinstance(v, bool | int):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    asked = duck.execute(catalogue.ORACLES[name])
    assert table_of(df.columns, df.collect()) == table_of([d[0] for d in asked.description], asked.fetchall())


def test_every_query_of_the_exam_bank_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_character_references_of_items(spark, tmp_path):
    """positioned_options: quotation marks in a title, and a title that is cut within a reference."""
    items = "".join(f"<li><a href='/{c}'>{c}</a></li>" for c in ("um", "a &lt; b", "&quot;tres&quot;", "c&#39;est &amp;lt;", "cinco"))
    pages = [(k, f"<html><nav><ul>{items}</ul></nav><h1>{title}</h1><p>par &quot;x&quot;</p></html>") for k, title in enumerate(("token = &quot;3c68d7&quot; &amp; x", "von &am", ""))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = catalogue.QUERIES["positioned_options"](spark, str(tmp_path))
    asked = con.execute(catalogue.ORACLES["positioned_options"])
    found = table_of(df.columns, df.collect())
    assert found == table_of([d[0] for d in asked.description], asked.fetchall()) and len(found[1]) == 15
