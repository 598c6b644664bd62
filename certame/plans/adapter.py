"""The domain's tables from the test tables, in Spark and as SQL text.

Arithmetic on non-negative keys only, so both engines agree; nulls are made, since the test tables have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certame import fixed


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fonte = _pick(("ENEM", "EXATO", "UFT"), k % 3)
    tipo = _pick(("PROVA", "SIMULADO"), F.floor(k / 3) % 2)
    enem, mock = F.col("fonte") == "ENEM", F.col("tipo") == "SIMULADO"
    numero = (k % 180 + 1).cast("int")
    half = F.when(F.col("numero") <= 90, "1").otherwise("2")
    base = read(spark, sf_dir, "part").select(k.alias("id"), "p_name", "p_type", "p_brand", "p_size", fonte.alias("fonte"), tipo.alias("tipo"), numero.alias("numero"))
    i = F.col("id")
    return base.select(
        "id", "numero",
        F.when((F.col("fonte") == "EXATO") & mock, None).otherwise((2009 + F.floor(i / 180) % 16).cast("int")).alias("ano"),
        F.when(~enem, "exato").when(mock, F.concat(F.lit("simu_dia"), half)).otherwise(F.concat(F.lit("dia"), half)).alias("dia"),
        _pick(fixed.AREAS, i % 4).alias("area"),
        F.when(i % 11 == 0, None).otherwise(F.concat(F.lit("H"), F.lpad((i % 30 + 1).cast("string"), 2, "0"))).alias("competencia"),
        F.array("p_name", "p_type", "p_brand").alias("enunciado"),
        F.when(i % 13 == 0, None).otherwise(F.concat(F.lit("Assinale "), "p_type")).alias("comando"),
        F.map_from_arrays(F.array(*map(F.lit, fixed.LETTERS)), F.array(*[(F.col("p_size") + n).cast("string") for n in range(5)])).alias("alternativas"),
        F.when(i % 97 == 0, None).otherwise(_pick(fixed.LETTERS, i % 5)).alias("gabarito"),
        (i % 97 == 0).alias("anulada"), (i % 7 == 0).alias("tem_imagem"),
        F.when(i % 5 == 0, None).otherwise((i % 40).cast("int")).alias("pagina_pdf"),
        "fonte", "tipo",
        F.when((F.col("fonte") == "EXATO") & mock, _pick(fixed.EVENTS, i % 7)).when(F.col("fonte") == "EXATO", None)
        .when(F.col("fonte") == "UFT", _pick(("1_EDICAO", "2_EDICAO", ""), F.floor(i / 3) % 3)).when(mock, F.concat(F.lit("SIM_0"), (i % 9).cast("string"))).alias("evento"),
        F.when(~enem, _pick(("MANHA", "TARDE"), F.floor(i / 6) % 2)).alias("turno"),
        F.when(enem & mock, _pick(tuple(v for _, v in fixed.VENDORS), F.floor(i / 6) % 5)).alias("provedor"),
    ).withColumn("evento", F.nullif("evento", F.lit("")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("simulado_id"), F.col("l_suppkey").alias("usuario_id"), F.col("l_partkey").alias("questao_id"), F.col("l_linenumber").cast("long").alias("seq"),
        F.col("l_shipdate").alias("respondido_em"), F.when(k != 0, _pick(fixed.LETTERS, k - 1)).alias("resposta"),
    )


def mocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"), F.max("l_shipdate").alias("fim"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "concluido").when(F.col("o_orderstatus") == "O", "em_andamento").otherwise("pendente")
    ids = F.coalesce(F.transform("ls", lambda x: x["l_partkey"]), F.array().cast("array<bigint>"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("usuario_id"), status.alias("status"), F.col("o_orderdate").alias("iniciado_em"),
        F.when(status == "concluido", F.col("fim")).alias("concluido_em"), ids.alias("questoes_ids"), F.size(ids).cast("long").alias("total_questoes"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", n.alias("questao"), _pick(fixed.LETTERS, F.col("event_id") % 5).alias("letra"), "event_type")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LETTERS_SQL = _sql_list(fixed.LETTERS)
AREAS_SQL = _sql_list(fixed.AREAS)
QUESTIONS_SQL = f"""questoes0 AS (
  SELECT p_partkey AS id, p_name, p_type, p_brand, p_size, ['ENEM','EXATO','UFT'][p_partkey % 3 + 1] AS fonte,
    ['PROVA','SIMULADO'][(p_partkey // 3) % 2 + 1] AS tipo, (p_partkey % 180 + 1)::INTEGER AS numero FROM part),
questoes AS (
  SELECT id, numero, CASE WHEN fonte='EXATO' AND tipo='SIMULADO' THEN NULL ELSE (2009 + (id // 180) % 16)::INTEGER END AS ano,
    CASE WHEN fonte<>'ENEM' THEN 'exato' WHEN tipo='SIMULADO' THEN 'simu_dia' || CASE WHEN numero<=90 THEN '1' ELSE '2' END ELSE 'dia' || CASE WHEN numero<=90 THEN '1' ELSE '2' END END AS dia,
    {AREAS_SQL}[id % 4 + 1] AS area,
    CASE WHEN id % 11 = 0 THEN NULL ELSE 'H' || lpad((id % 30 + 1)::VARCHAR, 2, '0') END AS competencia,
    [p_name, p_type, p_brand] AS enunciado, CASE WHEN id % 13 = 0 THEN NULL ELSE 'Assinale ' || p_type END AS comando,
    p_size, p_name, p_type, p_brand,
    CASE WHEN id % 97 = 0 THEN NULL ELSE {LETTERS_SQL}[id % 5 + 1] END AS gabarito, id % 97 = 0 AS anulada, id % 7 = 0 AS tem_imagem,
    CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 40)::INTEGER END AS pagina_pdf, fonte, tipo,
    nullif(CASE WHEN fonte='EXATO' AND tipo='SIMULADO' THEN {_sql_list(fixed.EVENTS)}[id % 7 + 1] WHEN fonte='EXATO' THEN NULL
      WHEN fonte='UFT' THEN ['1_EDICAO','2_EDICAO',''][(id // 3) % 3 + 1] WHEN tipo='SIMULADO' THEN 'SIM_0' || (id % 9)::VARCHAR END, '') AS evento,
    CASE WHEN fonte<>'ENEM' THEN ['MANHA','TARDE'][(id // 6) % 2 + 1] END AS turno,
    CASE WHEN fonte='ENEM' AND tipo='SIMULADO' THEN {_sql_list(v for _, v in fixed.VENDORS)}[(id // 6) % 5 + 1] END AS provedor
  FROM questoes0)"""
ANSWERS_SQL = f"""respostas AS (
  SELECT l_orderkey AS simulado_id, l_suppkey AS usuario_id, l_partkey AS questao_id, l_linenumber::BIGINT AS seq, l_shipdate AS respondido_em,
    CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN NULL ELSE {LETTERS_SQL}[(l_orderkey + l_linenumber) % 6] END AS resposta FROM lineitem)"""
GRADED_SQL = f"""{QUESTIONS_SQL}, {ANSWERS_SQL}, corrigidas AS (
  SELECT r.*, q.area, q.competencia, q.gabarito, coalesce(r.resposta = q.gabarito, false) AS correta FROM respostas r LEFT JOIN questoes q ON q.id = r.questao_id)"""
MOCKS_SQL = """linhas AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids, max(l_shipdate) AS fim FROM lineitem GROUP BY 1),
simulados AS (
  SELECT o_orderkey AS id, o_custkey AS usuario_id, CASE o_orderstatus WHEN 'F' THEN 'concluido' WHEN 'O' THEN 'em_andamento' ELSE 'pendente' END AS status, o_orderdate AS iniciado_em,
    CASE WHEN o_orderstatus = 'F' THEN fim END AS concluido_em, coalesce(ids, []) AS questoes_ids, len(coalesce(ids, []))::BIGINT AS total_questoes
  FROM orders LEFT JOIN linhas ON o_orderkey = l_orderkey)"""
CLICKS_SQL = f"""cliques AS (
  SELECT event_id, ts, user_id, (props->>'$.k')::BIGINT AS questao, {LETTERS_SQL}[event_id % 5 + 1] AS letra, event_type FROM events)"""
