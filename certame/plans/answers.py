"""Queries on answers: grading, progress, retries, clicks."""

from __future__ import annotations

from pyspark.sql import functions as F

from certame.functions.numbers import minutes
from certame.operators import changes, exams, grading, progress, review
from certame.plans.adapter import ANSWERS_SQL, AREAS_SQL, CLICKS_SQL, GRADED_SQL, LETTERS_SQL, MOCKS_SQL, QUESTIONS_SQL, answers, clicks, mocks, questions
from certame.plans.registry import query
from certame.sources.staging import dealt

PCT = "CASE WHEN {t} > 0 THEN floor(100.0::DOUBLE * {h} / {t} + 0.5)::BIGINT ELSE 0 END"
ORDER = ["respondido_em", "simulado_id", "seq", "questao_id"]


def graded(spark, sf_dir, nullsafe=False):
    return grading.grade(answers(spark, sf_dir), questions(spark, sf_dir), nullsafe)


@query(f"WITH {GRADED_SQL} SELECT area, count(*) AS total, count(*) FILTER (correta) AS acertos, {PCT.format(t='count(*)', h='count(*) FILTER (correta)')} AS pct FROM corrigidas GROUP BY area")
def progress_by_area(spark, sf_dir):
    return progress.by_area(graded(spark, sf_dir))


@query(f"""WITH {GRADED_SQL} SELECT competencia, count(*) AS total, count(*) FILTER (correta) AS acertos, min(area) AS area, {PCT.format(t='count(*)', h='count(*) FILTER (correta)')} AS pct,
  CASE WHEN {PCT.format(t='count(*)', h='count(*) FILTER (correta)')} >= 70 THEN 'verde' WHEN {PCT.format(t='count(*)', h='count(*) FILTER (correta)')} >= 50 THEN 'amarelo' ELSE 'vermelho' END AS cor
  FROM (SELECT competencia, correta, first_value(area) OVER (PARTITION BY competencia ORDER BY respondido_em, simulado_id, seq, questao_id) AS area FROM corrigidas WHERE competencia IS NOT NULL) GROUP BY competencia""")
def progress_by_skill(spark, sf_dir):
    return progress.by_skill(graded(spark, sf_dir).withColumn("seq", F.struct(*ORDER)))


@query(f"""WITH {GRADED_SQL}, d AS (SELECT area, count(DISTINCT questao_id) AS feitas FROM corrigidas GROUP BY 1), c AS (SELECT area, count(*) AS catalogo FROM questoes GROUP BY 1)
  SELECT a.area, coalesce(feitas, 0) AS feitas, coalesce(catalogo, 0) AS catalogo, least(100, floor(100.0::DOUBLE * coalesce(feitas, 0) / coalesce(nullif(catalogo, 0), 1) + 0.5)::BIGINT) AS cobertura
  FROM (SELECT unnest({AREAS_SQL}) AS area) a LEFT JOIN d USING (area) LEFT JOIN c USING (area)""")
def coverage_by_area(spark, sf_dir):
    return progress.area_coverage(graded(spark, sf_dir), questions(spark, sf_dir))


@query(f"""WITH {QUESTIONS_SQL} SELECT 'area' AS nivel, area AS valor, count(*) AS total FROM questoes WHERE area IS NOT NULL GROUP BY area
  UNION ALL SELECT 'competencia', competencia, count(*) FROM questoes WHERE competencia IS NOT NULL GROUP BY competencia""")
def catalogue_sizes(spark, sf_dir):
    return progress.catalogue(questions(spark, sf_dir))


@query(f"WITH {GRADED_SQL} SELECT count(*) AS total, count(*) FILTER (correta) AS acertos, count(DISTINCT competencia) AS habilidades, {PCT.format(t='count(*)', h='count(*) FILTER (correta)')} AS pct FROM corrigidas")
def overall_score(spark, sf_dir):
    return progress.overall(graded(spark, sf_dir))


@query(f"WITH {GRADED_SQL} SELECT area, string_agg(competencia, ',' ORDER BY substr(competencia, 2)::INTEGER) AS habilidades FROM (SELECT DISTINCT area, competencia FROM corrigidas WHERE competencia IS NOT NULL) GROUP BY area")
def skills_per_area(spark, sf_dir):
    return progress.skills_of_area(graded(spark, sf_dir)).withColumn("habilidades", F.array_join("habilidades", ","))


STREAK = """SELECT {by}, count(*) FILTER (erros = 0) AS sequencia FROM (
  SELECT {by}, sum(CASE WHEN {right} THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS erros FROM {source}) GROUP BY {by}"""


@query(f"WITH {GRADED_SQL}, t AS (SELECT *, max(CASE WHEN NOT correta THEN row(respondido_em, simulado_id, seq, questao_id) END) OVER (PARTITION BY usuario_id) AS erro FROM corrigidas) SELECT usuario_id, count(*) FILTER (erro IS NULL OR row(respondido_em, simulado_id, seq, questao_id) > erro) AS sequencia FROM t GROUP BY 1")
def trailing_streak(spark, sf_dir):
    return progress.streak(graded(spark, sf_dir), "usuario_id", "correta", ORDER)


@query("WITH e AS (SELECT user_id, ts, event_id, value >= 20 AS certa FROM events) " + STREAK.format(by="user_id", right="certa", order="ts DESC, event_id DESC", source="e"))
def streak_events(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", (F.col("value") >= 20).alias("certa"))
    return progress.streak_window(rows, "user_id", "certa", ["ts", "event_id"])


GRADE = "SELECT area, count(*) AS total, count(*) FILTER ({c}) AS acertos FROM corrigidas GROUP BY area"


@query(f"WITH {GRADED_SQL} " + GRADE.format(c="correta"))
def grade_strict(spark, sf_dir):
    return graded(spark, sf_dir).groupBy("area").agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"))


@query(f"WITH {GRADED_SQL} " + GRADE.format(c="resposta IS NOT DISTINCT FROM gabarito"))
def grade_nullsafe(spark, sf_dir):
    return graded(spark, sf_dir, True).groupBy("area").agg(F.count("*").alias("total"), F.count_if("correta").alias("acertos"))


@query(f"""WITH {GRADED_SQL}, {MOCKS_SQL}, r AS (SELECT simulado_id, count(*) AS total, count(*) FILTER (correta) AS acertos FROM corrigidas GROUP BY 1),
  p AS (SELECT simulado_id, usuario_id, status, total, acertos, {PCT.format(t='total', h='acertos')} AS pct FROM simulados JOIN r ON simulado_id = id)
  SELECT *, CASE WHEN pct >= 90 THEN 'ouro' WHEN pct >= 70 THEN 'prata' WHEN pct >= 50 THEN 'bronze' ELSE 'nenhuma' END AS medalha FROM p""")
def mock_result(spark, sf_dir):
    return grading.mock_result(graded(spark, sf_dir), mocks(spark, sf_dir))


@query(f"WITH {GRADED_SQL} SELECT simulado_id, area, count(*) AS total, count(*) FILTER (correta) AS acertos FROM corrigidas GROUP BY 1, 2")
def mock_areas(spark, sf_dir):
    return grading.mock_areas(graded(spark, sf_dir))


@query(f"""WITH {MOCKS_SQL}, t AS (SELECT id, floor((epoch_ms(concluido_em) - epoch_ms(iniciado_em)) / 60000.0::DOUBLE + 0.5)::BIGINT AS minutos, total_questoes * 180 AS segundos FROM simulados)
  SELECT id, minutos, segundos, CASE WHEN segundos >= 3600 THEN (segundos // 3600)::VARCHAR || ':' || lpad(((segundos % 3600) // 60)::VARCHAR, 2, '0') ELSE lpad((segundos // 60)::VARCHAR, 2, '0') END || ':' || lpad((segundos % 60)::VARCHAR, 2, '0') AS relogio FROM t""")
def mock_duration(spark, sf_dir):
    return grading.durations(mocks(spark, sf_dir))


@query(f"""WITH {GRADED_SQL}, {MOCKS_SQL}, h AS (SELECT simulado_id, count(*) FILTER (correta)::INTEGER AS n FROM corrigidas GROUP BY 1)
  SELECT id, CASE WHEN status <> 'concluido' AND n IS NOT NULL THEN n END AS acertos, CASE WHEN status <> 'concluido' AND n IS NOT NULL THEN TIMESTAMP '2000-01-01' ELSE concluido_em END AS concluido_em,
  CASE WHEN status <> 'concluido' AND n IS NOT NULL THEN 'concluido' ELSE status END AS status FROM simulados LEFT JOIN h ON simulado_id = id""")
def finish_mocks(spark, sf_dir):
    open_ = mocks(spark, sf_dir).withColumn("acertos", F.lit(None).cast("int"))
    return grading.finish(open_, graded(spark, sf_dir), F.expr("timestamp '2000-01-01'")).select("id", "acertos", F.col("concluido_em").cast("timestamp_ntz").alias("concluido_em"), "status")


@query(f"""WITH {MOCKS_SQL}, {QUESTIONS_SQL}, l AS (SELECT id AS simulado_id, generate_subscripts(questoes_ids, 1) - 1 AS pos, unnest(questoes_ids) AS questao_id FROM simulados)
  SELECT simulado_id, pos::INTEGER AS pos, questao_id, numero, area FROM l JOIN questoes ON questao_id = id""")
def mock_in_order(spark, sf_dir):
    return exams.in_order(mocks(spark, sf_dir), questions(spark, sf_dir)).select("simulado_id", "pos", "questao_id", "numero", "area")


@query(f"""WITH {MOCKS_SQL}, {ANSWERS_SQL}, g AS (SELECT DISTINCT simulado_id, questao_id FROM respostas WHERE simulado_id % 2 = 0)
  SELECT * FROM g UNION ALL SELECT DISTINCT s.id, x.q FROM simulados s, unnest(s.questoes_ids) AS x(q) WHERE s.id NOT IN (SELECT simulado_id FROM g)""")
def two_path_questions(spark, sf_dir):
    given = answers(spark, sf_dir).where("simulado_id % 2 = 0")  # so that some mocks have no answers
    return exams.answered_or_listed(mocks(spark, sf_dir), given)


@query(f"""WITH {MOCKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY usuario_id ORDER BY iniciado_em DESC NULLS LAST, id DESC) AS ordem FROM simulados)
  SELECT usuario_id, id, ordem::INTEGER AS ordem FROM r WHERE ordem <= 5""")
def recent_mocks_per_user(spark, sf_dir):
    return exams.recent(mocks(spark, sf_dir)).select("usuario_id", "id", "ordem")


@query(f"""WITH {MOCKS_SQL}, {QUESTIONS_SQL}, l AS (SELECT id AS simulado_id, (generate_subscripts(questoes_ids, 1) - 1)::INTEGER AS pos, unnest(questoes_ids) AS questao_id FROM simulados),
  k AS (SELECT simulado_id, pos, gabarito, CASE WHEN (simulado_id + pos) % 6 = 0 THEN NULL ELSE {LETTERS_SQL}[(simulado_id + pos) % 6] END AS resposta, ((simulado_id + pos) % 10) / 10.0::DOUBLE AS confianca FROM l JOIN questoes ON questao_id = id)
  SELECT simulado_id, pos, resposta, confianca, gabarito, CASE WHEN gabarito IS NULL OR resposta IS NULL THEN 'neutra' WHEN resposta = gabarito THEN 'certa' ELSE 'errada' END AS situacao, confianca > 0 AND confianca < 0.6 AS duvida FROM k""")
def sheet_vs_key(spark, sf_dir):
    listed = exams.in_order(mocks(spark, sf_dir), questions(spark, sf_dir))
    n = (F.col("simulado_id") + F.col("pos")) % 6
    letter = F.when(n != 0, F.element_at(F.array(*map(F.lit, "ABCDE")), F.greatest(n, F.lit(1)).cast("int")))
    rows = listed.select("simulado_id", F.struct("pos", letter.alias("l"), ((F.col("simulado_id") + F.col("pos")) % 10 / 10.0).alias("c"), F.col("gabarito").alias("g")).alias("r"))
    sheets = rows.groupBy("simulado_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    read = sheets.select("simulado_id", F.transform("rs", lambda r: r["l"]).alias("respostas"), F.transform("rs", lambda r: r["c"]).alias("confiancas"))
    return grading.sheet_status(read, sheets.select("simulado_id", F.transform("rs", lambda r: r["g"]).alias("chave")))


RETRY = f"""{GRADED_SQL}, ultimas AS (SELECT usuario_id, questao_id, max(respondido_em) AS respondido_em, bool_and(correta) AS acertou FROM corrigidas GROUP BY 1, 2)"""


def last_answers(spark, sf_dir):
    # dealt by hand: partitions that Spark joins up itself take as much memory a task as there is data for each core
    rows = dealt(graded(spark, sf_dir), "usuario_id", "questao_id").groupBy("usuario_id", "questao_id").agg(F.max("respondido_em").alias("respondido_em"), F.bool_and("correta").alias("acertou"))
    return rows.withColumn("area", F.lit(None).cast("string"))


@query(f"WITH {RETRY} SELECT usuario_id, questao_id, coalesce(area, 'Outras') AS area, p_name AS inicio FROM ultimas JOIN questoes ON id = questao_id WHERE NOT acertou")
def retry_list(spark, sf_dir):
    return review.retry_list(last_answers(spark, sf_dir), questions(spark, sf_dir)).select("usuario_id", "questao_id", "area", "inicio")


NEXT = f"""{RETRY}, estado AS (SELECT usuario_id, questao_id, (questao_id % 3 + 1)::INTEGER AS versao_tt, questao_id % 7 = 0 AS acertou, questao_id % 5 = 0 AS zerada FROM ultimas),
 v AS (SELECT usuario_id, max(versao_tt) AS versao FROM estado GROUP BY 1), novas AS (SELECT usuario_id, questao_id, acertou FROM ultimas WHERE questao_id % 2 = 0)"""


def state_and_answers(spark, sf_dir):
    last = last_answers(spark, sf_dir)
    state = last.select("usuario_id", "questao_id", (F.col("questao_id") % 3 + 1).cast("int").alias("versao_tt"), (F.col("questao_id") % 7 == 0).alias("acertou"), (F.col("questao_id") % 5 == 0).alias("zerada"))
    return state, last.where("questao_id % 2 = 0").select("usuario_id", "questao_id", "acertou")


# two updates, one after the other: what is right is mastered, then what is wrong moves on
@query(f"""WITH {NEXT}, certas AS (SELECT e.usuario_id, e.questao_id, e.versao_tt, coalesce(n.acertou, e.acertou) AS acertou, coalesce(n.acertou, e.zerada) AS zerada
    FROM estado e LEFT JOIN novas n ON n.usuario_id = e.usuario_id AND n.questao_id = e.questao_id AND n.acertou),
  erradas AS (SELECT usuario_id, questao_id FROM novas WHERE NOT acertou)
  SELECT usuario_id, questao_id, (versao + 1)::INTEGER AS versao_tt, false AS acertou, false AS zerada FROM certas SEMI JOIN erradas USING (usuario_id, questao_id) JOIN v USING (usuario_id)
  UNION ALL SELECT * FROM certas ANTI JOIN erradas USING (usuario_id, questao_id)""")
def next_retry_version(spark, sf_dir):
    return review.next_version(*state_and_answers(spark, sf_dir))


@query(f"WITH {NEXT} SELECT n.usuario_id, count(*) FILTER (acertou) AS zeradas, count(*) FILTER (NOT acertou) AS repetidas, max(versao) + 1 AS nova_versao FROM novas n JOIN v ON v.usuario_id = n.usuario_id GROUP BY 1")
def retry_round_counts(spark, sf_dir):
    return review.round_counts(*state_and_answers(spark, sf_dir))


@query(f"""WITH {NEXT}, parte AS (SELECT * FROM estado WHERE questao_id % 4 <> 0 AND usuario_id % 3 <> 0), w AS (SELECT usuario_id, max(versao_tt) AS versao FROM parte GROUP BY 1)
  SELECT n.usuario_id, count(*) FILTER (acertou) AS zeradas, count(*) FILTER (NOT acertou) AS repetidas, coalesce(max(versao), 1) + 1 AS nova_versao FROM novas n LEFT JOIN w ON w.usuario_id = n.usuario_id GROUP BY 1""")
def retry_round_beyond_state(spark, sf_dir):
    """M8 where the state lacks questions, and some users altogether."""
    state, told = state_and_answers(spark, sf_dir)
    return review.round_counts(state.where("questao_id % 4 <> 0 and usuario_id % 3 <> 0"), told)


@query(f"WITH {NEXT} SELECT usuario_id, versao, unnest(range(1, versao + 1))::INTEGER AS v FROM v")
def retry_versions(spark, sf_dir):
    return review.versions(review.current_version(state_and_answers(spark, sf_dir)[0]))


@query(f"WITH {RETRY} SELECT area, count(*) AS n, md5(string_agg(questao_id::VARCHAR, ',' ORDER BY questao_id)) AS lista FROM (SELECT DISTINCT area, questao_id FROM ultimas JOIN questoes ON id = questao_id WHERE NOT acertou) GROUP BY area")
def retry_by_area(spark, sf_dir):
    rows = retry_list(spark, sf_dir).select("area", "questao_id").distinct()
    return review.by_area(rows, ["questao_id"]).select("area", F.size("questoes").cast("long").alias("n"), F.md5(F.array_join(F.transform("questoes", lambda x: x.cast("string")), ",")).alias("lista"))


@query(f"""WITH {RETRY}, d AS (SELECT DISTINCT area, questao_id FROM ultimas JOIN questoes ON id = questao_id WHERE NOT acertou), n AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY questao_id) - 1 AS k FROM d)
  SELECT area, k // 40 + 1 AS pagina, count(*) AS n, md5(string_agg(questao_id::VARCHAR, ',' ORDER BY questao_id)) AS lista FROM n GROUP BY 1, 2""")
def retry_pages_by_area(spark, sf_dir):
    """A17."""
    rows = review.pages_by_area(retry_list(spark, sf_dir).select("area", "questao_id").distinct(), ["questao_id"], 40)
    return rows.select("area", "pagina", F.size("questoes").cast("long").alias("n"), F.md5(F.array_join(F.transform("questoes", lambda x: x.cast("string")), ",")).alias("lista"))


@query("""WITH e AS (SELECT event_id, nullif(user_id % 7, 3) AS questao_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 2000 + user_id % 20 END AS ano, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'dia' || (event_id % 2 + 1) END AS dia, (event_id % 9)::INTEGER AS numero, event_type AS tipo_erro, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' ' || props END AS descricao FROM events)
  SELECT questao_id, ano::INTEGER AS ano, dia, numero, tipo_erro, nullif(trim(descricao), '') AS descricao, CASE WHEN event_id % 2 = 0 THEN 'resolvido' ELSE 'pendente' END AS status FROM e WHERE event_id % 2 = 0 OR (ano IS NOT NULL AND trim(dia) <> '' AND numero <> 0)""")
def reported_errors(spark, sf_dir):
    """M2: half of the reports stand in the table, the others come in."""
    i, u = F.col("event_id"), F.col("user_id")
    told = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        i.alias("k"), F.nullif(u % 7, F.lit(3)).alias("questao_id"), F.when(i % 10 != 0, 2000 + u % 20).alias("ano"), F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("dia"), (i % 2 + 1).cast("string"))).alias("dia"),
        (i % 9).alias("numero"), F.col("event_type").alias("tipo_erro"), F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "props")).alias("descricao"),
    )
    old = told.where("k % 2 = 0").withColumns({"status": F.lit("resolvido"), "descricao": F.nullif(F.trim("descricao"), F.lit(""))})
    return changes.report_errors(old, told.where("k % 2 = 1"))


@query(f"""WITH {ANSWERS_SQL}, u AS (SELECT simulado_id, questao_id, max(row(respondido_em, seq, coalesce(resposta, ''))) AS m FROM respostas GROUP BY 1, 2)
  SELECT simulado_id, questao_id, nullif(m[3], '') AS resposta, m[1] AS respondido_em FROM u""")
def upsert_latest(spark, sf_dir):
    rows = answers(spark, sf_dir).select("simulado_id", "questao_id", "resposta", "respondido_em", F.coalesce("resposta", F.lit("")).alias("r"), "seq")
    last = changes.latest_per_key(rows, ("simulado_id", "questao_id"), ["respondido_em", "seq", "r"]).select("simulado_id", "questao_id", "resposta", "respondido_em")
    # half of the rows stand in the table already, and are replaced by themselves
    old = last.where("questao_id % 2 = 0").withColumn("resposta", F.lit("?"))
    return changes.upsert(old, last, ("simulado_id", "questao_id"))


@query(f"""WITH {CLICKS_SQL}, n AS (SELECT *, CASE WHEN lag(letra) OVER w IS NOT DISTINCT FROM letra THEN 0 ELSE 1 END AS novo FROM cliques WINDOW w AS (PARTITION BY user_id, questao ORDER BY ts, event_id)),
  c AS (SELECT *, sum(novo) OVER (PARTITION BY user_id, questao ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS corrida FROM n),
  g AS (SELECT user_id, questao, corrida, min(letra) AS letra, count(*) AS n FROM c GROUP BY 1, 2, 3), m AS (SELECT user_id, questao, max(corrida) AS corrida FROM g GROUP BY 1, 2)
  SELECT user_id, questao, CASE WHEN n % 2 = 1 THEN letra END AS resposta FROM g JOIN m USING (user_id, questao, corrida)""")
def toggle_state(spark, sf_dir):
    return grading.chosen(clicks(spark, sf_dir))


@query(f"WITH {CLICKS_SQL} SELECT user_id, questao, letra FROM cliques GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1")
def eliminated_options(spark, sf_dir):
    return grading.eliminated(clicks(spark, sf_dir))


@query(f"WITH {CLICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, questao ORDER BY ts DESC, event_id DESC) AS k FROM cliques) SELECT user_id, questao, letra, event_id FROM r WHERE k = 1")
def latest_answer(spark, sf_dir):
    return changes.latest_per_key(clicks(spark, sf_dir).select("user_id", "questao", "letra", "event_id", "ts"), ("user_id", "questao"), ["ts", "event_id"]).drop("ts")


@query("""WITH e AS (SELECT event_id AS seq, event_type AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (user_id % 50)::VARCHAR END AS key FROM events)
  SELECT kind, count(*) AS n FROM (SELECT kind, key FROM e WHERE key IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT kind, key FROM e WHERE key IS NULL) GROUP BY kind""")
def pending_changes(spark, sf_dir):
    return changes.pending_counts(change_log(spark, sf_dir))


def change_log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.when(F.col("event_id") % 4 != 0, (F.col("user_id") % 50).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), key.alias("key"), F.col("props").alias("payload"))


@query("SELECT event_type AS kind, count(*) FILTER (value >= 20) AS ok, count(*) FILTER (NOT value >= 20) AS erro FROM events GROUP BY 1")
def upload_report(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return changes.flush_report(e.select(F.col("event_type").alias("kind"), (F.col("value") >= 20).alias("ok")))


@query("""WITH e AS (SELECT event_id AS seq, event_type AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (user_id % 50)::VARCHAR END AS key, value >= 20 AS ok FROM events),
  c AS (SELECT max(seq) AS seq FROM e WHERE key IS NOT NULL GROUP BY kind, key UNION ALL SELECT seq FROM e WHERE key IS NULL),
  done AS (SELECT e.* FROM e JOIN c USING (seq) WHERE ok), n AS (SELECT kind, key, max(seq) AS upto FROM done WHERE key IS NOT NULL GROUP BY 1, 2)
  SELECT e.seq, e.kind, e.key FROM e LEFT JOIN n ON n.kind = e.kind AND n.key = e.key WHERE e.seq NOT IN (SELECT seq FROM done) AND (upto IS NULL OR e.seq > upto)""")
def after_flush(spark, sf_dir):
    log = change_log(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), (F.col("value") >= 20).alias("ok"))
    tried = e.join(changes.compact(log).select("seq"), "seq")
    return changes.after_flush(log, tried).select("seq", "kind", "key")


@query("SELECT round(avg(floor((epoch_ms(fim) - epoch_ms(o_orderdate)) / 60000.0::DOUBLE + 0.5)), 6) AS media FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS fim FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def mean_duration(spark, sf_dir):
    """A25."""
    return mocks(spark, sf_dir).select(minutes(F.col("iniciado_em"), F.col("concluido_em")).alias("m")).agg(F.round(F.avg("m"), 6).alias("media"))
