"""Queries that write tables and streams and read them back: merges, exports, the latest answers, mocks that run out."""

from __future__ import annotations

from pyspark.sql import functions as F

from certame import fixed
from certame.plans.adapter import CLICKS_SQL, QUESTIONS_SQL, clicks, questions
from certame.plans.registry import query
from certame.sources import files, sinks
from certame.sources.staging import scratch
from certame.streaming import answers


@query(f"""WITH {QUESTIONS_SQL}, m AS (SELECT max(id) AS m FROM questoes), novas AS (SELECT id + CASE WHEN id % 20 = 0 THEN (SELECT m FROM m) + 1 ELSE 0 END AS id, 'UFT' AS fonte, tipo, ano, NULL AS turno, -numero AS numero FROM questoes WHERE fonte = 'EXATO' AND id % 10 = 0)
  SELECT id, fonte, tipo, ano, turno, numero FROM novas UNION ALL SELECT id, fonte, tipo, ano, turno, numero FROM questoes WHERE id NOT IN (SELECT id FROM novas)""")
def merged_into_partitions(spark, sf_dir):
    """M1, K3, K8: rows that move to another partition, and new ones, merged into a partitioned table."""
    columns = ("id", "fonte", "tipo", "ano", "turno", "numero")
    rows = questions(spark, sf_dir).select(*columns)
    path = scratch(spark, "merged")
    sinks.write_table(rows, path)
    top = rows.agg(F.max("id")).first()[0]
    new = rows.where("fonte = 'EXATO' and id % 10 = 0").withColumns({"id": F.col("id") + F.when(F.col("id") % 20 == 0, top + 1).otherwise(0), "fonte": F.lit("UFT"), "turno": F.lit(None).cast("string"), "numero": -F.col("numero")})
    sinks.merge_table(new, path, ("id",))
    return spark.read.parquet(path).select(*columns)


EXPORTED = "numero int, ano int, fonte string, enunciado array<string>, alternativas map<string,string>, anulada boolean, id bigint"


@query(f"""WITH {QUESTIONS_SQL} SELECT id, numero, ano, fonte, p_name || '|' || p_type || '|' || p_brand AS textos, (p_size + 1)::VARCHAR AS b, anulada, fonte || '_' || ano || '.json' AS arquivo FROM questoes WHERE ano IS NOT NULL""")
def exported_arrays(spark, sf_dir):
    """A file of one JSON array for each source and year, read back; rows without a year are set aside."""
    path = scratch(spark, "arrays")
    rows = questions(spark, sf_dir).select("id", "numero", "ano", "fonte", "enunciado", "alternativas", "anulada")
    sinks.write_json_arrays(rows, path, unit=("fonte", "ano"), required=("ano",))
    back = files.read_json_strict(spark, f"{path}/*.json", EXPORTED).withColumn("arquivo", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return back.select("id", "numero", "ano", "fonte", F.array_join("enunciado", "|").alias("textos"), F.col("alternativas")["B"].alias("b"), "anulada", "arquivo")


@query(f"WITH {CLICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, questao ORDER BY ts DESC, event_id DESC) AS k FROM cliques) SELECT user_id, questao, letra, event_id FROM r WHERE k = 1")
def latest_answer_state(spark, sf_dir):
    """T4: clicks in twelve batches into a state table, which is merged on the way."""
    rows = clicks(spark, sf_dir).select("user_id", "questao", "letra", "event_id", "ts")
    table = answers.StateTable(spark, scratch(spark, "state"), ("user_id", "questao"), ["ts", "event_id"], live=4)
    for n in range(12):
        table.put(rows.where(F.col("event_id") % 12 == n), n)
    return table.current().select("user_id", "questao", "letra", "event_id")


MOCK_EVENTS = 20


@query(f"""WITH e AS (SELECT event_id // {MOCK_EVENTS} AS simulado_id, ts, min(ts) OVER (PARTITION BY event_id // {MOCK_EVENTS}) AS inicio FROM events), f AS (SELECT *, inicio + to_minutes((({fixed.MINUTES_PER_QUESTION} * (5 + simulado_id % 10)))::INTEGER) AS fim FROM e)
  SELECT simulado_id, count(*) FILTER (date_trunc('millisecond', ts) <= date_trunc('millisecond', fim)) AS respostas, true AS expirou FROM f GROUP BY simulado_id HAVING epoch_ms(max(fim)) <= (SELECT epoch_ms(max(ts)) FROM events) - 60000""")
def expired_mocks(spark, sf_dir):
    """A stream of answers, twenty a mock, to the mocks whose time is over when it ends."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / MOCK_EVENTS).alias("simulado_id"), F.col("ts").cast("timestamp").alias("ts"))
    begun = e.groupBy("simulado_id").agg(F.min("ts").alias("iniciado_em"))
    told = e.join(begun, "simulado_id").withColumn("total_questoes", (5 + F.col("simulado_id") % 10).cast("int"))
    source, out = scratch(spark, "answers"), scratch(spark, "expired")
    told.write.parquet(source)
    with answers.timers(spark):
        rows = answers.timeouts(answers.event_stream(spark, source, told.schema))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(answers.EXPIRED).parquet(out)
