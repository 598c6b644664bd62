"""Remote tables on the embedded database that Spark brings: what runs there, and what comes over."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from certame.operators import search
from certame.sources import remote

URL = "jdbc:derby:memory:bank;create=true"


@pytest.fixture(scope="module")
def bank(spark):
    rows = spark.range(1000).selectExpr(
        "id", "element_at(array('ENEM','EXATO','UFT'), cast(id % 3 as int) + 1) as fonte", "if(id % 2 = 0, 'PROVA', 'SIMULADO') as tipo", "if(id % 50 = 0, null, cast(2000 + id % 20 as int)) as ano",
        "cast(id % 90 as int) as numero", "concat('dia', id % 2) as dia", "concat('A', id % 4) as area", "concat('H', id % 30) as competencia", "'A' as gabarito", "id % 10 = 0 as anulada", "if(id % 9 = 0, null, id) as ordem",
    )
    rows.write.format("jdbc").options(url=URL, dbtable="questoes", user="app", password="x", createTableColumnTypes=", ".join(f"{c} varchar(40)" for c in ("fonte", "tipo", "dia", "area", "competencia", "gabarito"))).mode("overwrite").save()
    for k, v in {"url": URL, "user": "app", "password": "x", "schema": "APP"}.items():
        spark.conf.set(f"spark.certame.jdbc.{k}", v)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans name all filters
    yield rows
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for k in ("url", "user", "password", "schema"):
        spark.conf.unset(f"spark.certame.jdbc.{k}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_settings_are_named(spark):
    with pytest.raises(ValueError, match="jdbc.url, .*jdbc.password"):
        remote.settings(spark)


def test_a_search_runs_there(spark, bank):
    spec = search.SearchSpec(filters={"area": "A2", "tipo": "PROVA"}, year_from=2004)
    there, here = (search.search(df, spec).select(*search.LIGHT) for df in (remote.table(spark, "QUESTOES"), bank))
    assert there.collect() == here.collect() and len(here.collect()) == 12
    assert "TakeOrderedAndProject" in plan(there) and "area = 'A2'" in plan(there) and "ano >= 2004" in plan(there)
    assert search.question(remote.table(spark, "QUESTOES"), 42).collect()[0].numero == 42
    assert "id = 42" in plan(search.question(remote.table(spark, "QUESTOES"), 42))


def test_limits_go_to_databases_that_take_them(spark, bank):
    remote.attach(spark)
    assert spark.conf.get(f"spark.sql.catalog.{remote.CATALOG}.pushDownLimit") == "false"
    assert "jdbc:postgresql://host/db".startswith(remote.TAKE_LIMITS)


def test_counts_are_made_there(spark, bank):
    counted = search.source_counts(remote.table(spark, "QUESTOES"))
    assert sorted(counted.collect()) == sorted(search.source_counts(bank).collect())
    assert "PushedAggregates: [COUNT(*)]" in plan(counted) and "PushedGroupByExpressions: [fonte]" in plan(counted)


@pytest.mark.parametrize(("by", "where"), [("id", None), ("ordem", None), ("id", "fonte = 'UFT'"), ("id", "id = 5"), ("id", "id < 0")])
def test_whole_by_ranges(spark, bank, by, where):
    condition = F.expr(where) if where else None
    got = remote.whole(spark, "QUESTOES", by, 4, condition)
    want = bank.where(where) if where else bank
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.rdd.getNumPartitions() == (4 if want.count() > 1 else 1)
    assert not where or "PushedFilters: [*" in plan(got)
