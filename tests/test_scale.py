"""Plans that stay whole when tables grow: what is dealt out, and what is never sent to every machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from certame import catalogue
from certame.operators import answer_key, extract, review


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_entries_are_not_broadcast(spark):
    """a small file of keys may hold more entries than a driver has room for."""
    keys = spark.range(20).select("id", F.lit("01 C  02 B  03 A  04 A  05 E").alias("texto")).coalesce(1)
    asked = spark.range(20).select("id", F.explode(F.array(F.lit(1), F.lit(6))).alias("numero"))
    rows = answer_key.with_key(asked, answer_key.key_rows(keys), ("id", "numero"))
    assert "Broadcast" not in plan(rows) and "REPARTITION_BY_NUM" in plan(rows)
    assert sorted(map(tuple, rows.select("id", "numero", "gabarito", "anulada").where("id < 2").collect())) == [(0, 1, "C", False), (0, 6, None, False), (1, 1, "C", False), (1, 6, None, False)]


def test_pages_are_dealt_out_and_parsed_once(spark):
    """one small file of pages keeps all cores busy, and what is asked of a question does not parse it again."""
    pages = spark.range(40).select("id", F.lit(0).alias("page"), F.concat(F.lit("Questão "), "id", F.lit("\nUm\nPergunta?\nA a\nB b\nC c\nD d\n")).alias("texto")).coalesce(1)
    rows = extract.questions_of_pages(pages, ("id", "page"))
    assert "REPARTITION_BY_NUM" in plan(rows)
    filters = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("aggregate(" in x for x in filters)  # the fold over an option's marks
    assert {(r.id, r.numero, r.comando) for r in rows.collect()} == {(i, i, "Pergunta?") for i in range(40)}


def test_retry_state_is_dealt_over_fixed_tasks(spark, sf_dir):
    """a task of the retry table holds no core's share of all answers."""
    state = spark.createDataFrame([("u", 1, 1, False, False), ("u", 2, 3, True, False), ("v", 1, 2, False, False)], "usuario_id string, questao_id int, versao_tt int, acertou boolean, zerada boolean")
    told = spark.createDataFrame([("u", 1, False), ("v", 1, True)], "usuario_id string, questao_id int, acertou boolean")
    rows = review.next_version(state, told)
    assert "hashpartitioning(usuario_id" in plan(rows) and "REPARTITION_BY_NUM" in plan(rows)
    assert sorted(map(tuple, rows.collect())) == [("u", 1, 4, False, False), ("u", 2, 3, True, False), ("v", 1, 2, True, True)]
    assert plan(catalogue.QUERIES["next_retry_version"](spark, sf_dir)).count("REPARTITION_BY_NUM") >= 3
