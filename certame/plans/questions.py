"""Queries on questions: search, facets, places, layout, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certame import fixed
from certame.functions import arrays, text
from certame.functions.numbers import bubble_grid, decision, spread_page
from certame.operators import changes, exams, facet_index, inventory, ranks, reports, search
from certame.operators.search import SearchSpec
from certame.plans.adapter import ANSWERS_SQL, AREAS_SQL, GRADED_SQL, LETTERS_SQL, QUESTIONS_SQL, answers, questions
from certame.plans.answers import graded
from certame.plans.registry import query
from certame.schemas import dimension
from certame.sources.staging import scratch

LISTED = "ORDER BY ano DESC NULLS FIRST, numero NULLS LAST, id"
LIGHT = "id, numero, ano, dia, area, competencia, gabarito"


def light(df):
    return df.select(*search.LIGHT)


@query(f"WITH {QUESTIONS_SQL} SELECT {LIGHT} FROM questoes WHERE fonte = 'ENEM' AND NOT anulada AND ano BETWEEN 2010 AND 2018 AND area = '{fixed.NATUREZA}' AND tipo = 'PROVA' {LISTED} LIMIT 12 OFFSET 12")
def search_enem(spark, sf_dir):
    return light(search.search(questions(spark, sf_dir), SearchSpec(filters={"area": fixed.NATUREZA, "tipo": "PROVA", "evento": "CICLO_ZERO", "dia": ""}, year_from=2010, year_to=2018, page=2)))


@query(f"WITH {QUESTIONS_SQL} SELECT {LIGHT} FROM questoes WHERE fonte = 'EXATO' AND NOT anulada AND evento = 'CICLO_ZERO' AND turno = 'TARDE' {LISTED} LIMIT 12")
def search_exato(spark, sf_dir):
    return light(search.search(questions(spark, sf_dir), SearchSpec("EXATO", {"evento": "CICLO_ZERO", "turno": "TARDE", "ano": 2010})))


@query(f"WITH {QUESTIONS_SQL} SELECT {LIGHT} FROM questoes WHERE fonte = 'UFT' AND NOT anulada AND evento = '2_EDICAO' AND ano >= 2012 {LISTED} LIMIT 12")
def search_uft(spark, sf_dir):
    return light(search.search(questions(spark, sf_dir), SearchSpec("UFT", {"evento": "2_EDICAO", "competencia": "H01"}, year_from=2012)))


@query(f"""WITH {QUESTIONS_SQL} SELECT {LIGHT} FROM questoes WHERE fonte = 'UFT' AND NOT anulada AND
  (contains(lower(p_name), 'brass') OR contains(lower(p_type), 'brass') OR contains(lower(p_brand), 'brass') OR contains(lower(p_name), 'brand#1') OR contains(lower(p_type), 'brand#1') OR contains(lower(p_brand), 'brand#1')
  OR coalesce(contains(lower(comando), 'brass') OR contains(lower(comando), 'brand#1'), false)) {LISTED} LIMIT 40""")
def search_text_or(spark, sf_dir):
    return light(search.search(questions(spark, sf_dir), SearchSpec("UFT", terms=("BRASS", " brand#1 ", ""), page_size=40)))


@query(f"""WITH {GRADED_SQL}, a AS (SELECT q.ano, q.dia, q.numero, c.correta, row(c.respondido_em, c.questao_id, c.seq, c.correta) AS k FROM corrigidas c JOIN questoes q ON q.id = c.questao_id WHERE c.usuario_id = 7),
  u AS (SELECT ano, dia, numero, max(k)[4] AS badge FROM a GROUP BY 1, 2, 3)
  SELECT q.id, q.ano, q.dia, q.numero, u.badge FROM questoes q LEFT JOIN u ON q.ano IS NOT DISTINCT FROM u.ano AND q.dia IS NOT DISTINCT FROM u.dia AND q.numero IS NOT DISTINCT FROM u.numero""")
def search_with_badges(spark, sf_dir):
    q = questions(spark, sf_dir)
    own = search.for_user(graded(spark, sf_dir), 7).join(q.select(F.col("id").alias("questao_id"), "ano", "dia", "numero"), "questao_id")
    own = own.select("ano", "dia", "numero", "respondido_em", "questao_id", F.struct("seq", "correta").alias("seq"), F.col("correta").alias("acertou"))
    return search.with_badges(q.select("id", "ano", "dia", "numero"), own)


@query(f"WITH {QUESTIONS_SQL} SELECT fonte, count(*) AS total, ceil(count(*) / 12.0)::BIGINT AS paginas FROM questoes WHERE NOT anulada GROUP BY 1")
def page_counts(spark, sf_dir):
    return search.page_counts(questions(spark, sf_dir), "fonte")


FACETS = ("ano", "dia", "evento", "turno", "provedor")


@query(f"WITH {QUESTIONS_SQL} SELECT fonte, string_agg(ano::VARCHAR, ',' ORDER BY ano DESC) AS valores FROM (SELECT DISTINCT fonte, ano FROM questoes WHERE ano IS NOT NULL) GROUP BY 1")
def facets_by_source(spark, sf_dir):
    listed = search.facet_list(questions(spark, sf_dir), "ano", descending=True)
    return listed.select("fonte", F.array_join(F.transform("valores", lambda x: x.cast("string")), ",").alias("valores"))


@query(f"WITH {QUESTIONS_SQL} " + " UNION ALL ".join(f"SELECT fonte, '{c}' AS faceta, {c}::VARCHAR AS valor, count(*) AS total FROM questoes WHERE {c} IS NOT NULL GROUP BY 1, 3" for c in FACETS))
def facet_counts(spark, sf_dir):
    return search.facets(questions(spark, sf_dir), FACETS)


@query(f"WITH {QUESTIONS_SQL} SELECT fonte, count(*) AS total FROM questoes WHERE NOT anulada GROUP BY 1")
def source_counts(spark, sf_dir):
    return search.source_counts(questions(spark, sf_dir))


@query(f"WITH {QUESTIONS_SQL} SELECT id, fonte, lag(id) OVER w AS anterior, lead(id) OVER w AS proximo FROM questoes WINDOW w AS (PARTITION BY fonte ORDER BY ano NULLS LAST, numero NULLS LAST, id)")
def neighbours(spark, sf_dir):
    return search.neighbours(questions(spark, sf_dir))


@query(f"""WITH {QUESTIONS_SQL}, e AS (SELECT * FROM questoes WHERE fonte = 'ENEM' AND NOT anulada) SELECT * FROM (SELECT 'anterior' AS lado, id FROM e WHERE ano < 2010 OR (ano = 2010 AND numero < 40) ORDER BY ano DESC, numero DESC, id DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'proximo', id FROM e WHERE ano > 2010 OR (ano = 2010 AND numero > 40) ORDER BY ano, numero, id LIMIT 1)""")
def neighbour_ids(spark, sf_dir):
    return search.neighbour_ids(questions(spark, sf_dir).where("fonte = 'ENEM' and not anulada"), 2010, 40)


@query(f"WITH {QUESTIONS_SQL} SELECT id, fonte, count(*) OVER (PARTITION BY fonte ORDER BY ano DESC NULLS FIRST, numero NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS posicao FROM questoes")
def list_position(spark, sf_dir):
    return search.list_position(questions(spark, sf_dir))


@query(f"WITH {QUESTIONS_SQL} SELECT id FROM questoes WHERE numero = 33 ORDER BY id LIMIT 1")
def go_to_number(spark, sf_dir):
    return search.go_to(questions(spark, sf_dir), "33").select("id")


@query(f"""WITH {QUESTIONS_SQL}, e AS (SELECT DISTINCT fonte, coalesce(ano, 0) AS ano, dia FROM questoes), w AS (SELECT *, lag(ano || '/' || dia) OVER p AS antes, lead(ano || '/' || dia) OVER p AS depois FROM e WINDOW p AS (PARTITION BY fonte ORDER BY ano, dia)) SELECT * FROM w""")
def exam_neighbours(spark, sf_dir):
    exams_ = search.exam_neighbours(questions(spark, sf_dir).withColumn("ano", F.coalesce("ano", F.lit(0))), "ano", "dia")
    text = lambda c: F.concat_ws("/", F.col(f"{c}.ano").cast("string"), F.col(f"{c}.dia"))
    return exams_.select("fonte", "ano", "dia", F.nullif(text("antes"), F.lit("")).alias("antes"), F.nullif(text("depois"), F.lit("")).alias("depois"))


@query(f"""WITH {QUESTIONS_SQL}, s AS (SELECT fonte, id, row_number() OVER (PARTITION BY fonte ORDER BY md5('42-' || id::VARCHAR), id) AS ordem FROM questoes WHERE NOT anulada) SELECT fonte, id, ordem::INTEGER AS ordem FROM s WHERE ordem <= 25""")
def sample_mock(spark, sf_dir):
    return exams.sample_by(questions(spark, sf_dir).where("not anulada"), "fonte", 25, "42").select("fonte", "id", "ordem")


@query(f"WITH {QUESTIONS_SQL} SELECT id FROM questoes WHERE fonte = 'ENEM' AND NOT anulada ORDER BY md5('7-' || id::VARCHAR), id LIMIT 10")
def sample_default(spark, sf_dir):
    return exams.sample(questions(spark, sf_dir).where(search.predicate(SearchSpec(sampling=True))), None, "7").select("id")


RANK = f"coalesce(list_position({AREAS_SQL}, area), 0)"


@query(f"""WITH {QUESTIONS_SQL}, n AS (SELECT id, fonte, area, row_number() OVER (PARTITION BY fonte ORDER BY {RANK}, ano NULLS LAST, numero NULLS LAST, id) AS num FROM questoes),
  a AS (SELECT *, min(num) OVER p AS area_inicio, max(num) OVER p AS area_fim, row_number() OVER (PARTITION BY fonte, area ORDER BY num) AS k, count(*) OVER p AS c FROM n WINDOW p AS (PARTITION BY fonte, area))
  SELECT fonte, id, num::INTEGER AS num, area_inicio::INTEGER AS area_inicio, area_fim::INTEGER AS area_fim, CASE WHEN k <= ceil(c / 2.0) THEN 1 ELSE 2 END AS coluna, ((num - 1) // 5)::INTEGER AS linha, ((num - 1) // 10)::INTEGER AS pagina FROM a""")
def print_layout(spark, sf_dir):
    return exams.layout(questions(spark, sf_dir), "fonte").select("fonte", "id", *[F.col(c).cast("int") for c in ("num", "area_inicio", "area_fim", "coluna", "linha", "pagina")])


@query(f"""WITH {QUESTIONS_SQL}, n AS (SELECT fonte, area, row_number() OVER w AS num, CASE WHEN lag(area) OVER w IS NOT DISTINCT FROM area THEN 0 ELSE 1 END AS novo FROM questoes WINDOW w AS (PARTITION BY fonte ORDER BY numero, id)),
  g AS (SELECT *, sum(novo) OVER (PARTITION BY fonte ORDER BY num ROWS UNBOUNDED PRECEDING) AS grupo FROM n) SELECT fonte, grupo::BIGINT AS grupo, area, min(num)::INTEGER AS inicio, max(num)::INTEGER AS fim FROM g GROUP BY 1, 2, 3""")
def area_islands(spark, sf_dir):
    found = exams.islands(questions(spark, sf_dir), "fonte", [F.col("numero").asc(), F.col("id").asc()], "area")
    return found.withColumns({c: F.col(c).cast("int") for c in ("inicio", "fim")})


GRID = {"left": int(28 / 595 * 794), "top": int(0.20 * 1123)}


@query(f"""SELECT l_orderkey, l_linenumber, q::INTEGER AS questao, o::INTEGER AS opcao, ({GRID['left']} + q % 5 * {(794 - 2 * GRID['left']) // 5} + {(794 - 2 * GRID['left']) // 5 // 2} - 41 + o * 17 + 7)::INTEGER AS x,
  ({GRID['top']} + q // 5 * {(1123 - GRID['top'] - 50) // 9} + {(1123 - GRID['top'] - 50) // 9 // 2})::INTEGER AS y FROM (SELECT l_orderkey, l_linenumber, l_partkey % 45 AS q FROM lineitem), range(5) u(o)""")
def sheet_grid(spark, sf_dir):
    """the bubbles of every answer's question."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 45).cast("int").alias("questao"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("opcao"))
    return rows.withColumn("c", bubble_grid(F.col("questao"), F.col("opcao"), 45)).select("l_orderkey", "l_linenumber", "questao", "opcao", "c.x", "c.y")


@query(f"""WITH f AS (SELECT p_partkey AS id, [((p_partkey * 7 + p_size * i) % 101) / 100.0::DOUBLE for i in [1, 2, 3, 5, 8]] AS v FROM part), s AS (SELECT *, list_max(v) AS m, list_sort(v, 'DESC')[2] AS n FROM f)
  SELECT id, CASE WHEN m < 0.35 OR m - n < 0.10 THEN NULL ELSE {LETTERS_SQL}[list_position(v, m)] END AS letra, round(CASE WHEN m < 0.35 THEN 0.0 WHEN m - n < 0.10 THEN 0.5 ELSE least(1.0, (m - 0.35) / (1 - 0.35)) END, 9) AS confianca FROM s""")
def bubble_decision(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    fill = F.array(*[(F.col("p_partkey") * 7 + F.col("p_size") * i) % 101 / 100.0 for i in (1, 2, 3, 5, 8)])
    return part.select(F.col("p_partkey").alias("id"), decision(fill).alias("d")).select("id", "d.letra", F.round("d.confianca", 9).alias("confianca"))


@query(f"WITH {QUESTIONS_SQL} SELECT id, fonte, CASE WHEN fonte = 'UFT' AND evento = '1_EDICAO' THEN 'PRIMEIRA' ELSE evento END AS evento FROM questoes")
def bulk_rename(spark, sf_dir):
    return changes.rename_value(questions(spark, sf_dir), "evento", "1_EDICAO", "PRIMEIRA", "UFT").select("id", "fonte", "evento")


@query(f"WITH {QUESTIONS_SQL} SELECT count(*) AS afetadas FROM questoes WHERE fonte = 'UFT' AND evento = '1_EDICAO'")
def rename_count(spark, sf_dir):
    return changes.would_rename(questions(spark, sf_dir), "evento", "1_EDICAO", "UFT")


VOID = " OR ".join(f"(ano = {y} AND numero = {n})" for y, n in fixed.VOIDED)


@query(f"WITH {QUESTIONS_SQL}, v AS (SELECT *, coalesce(fonte = 'ENEM' AND tipo = 'PROVA' AND ({VOID}), false) AS hit FROM questoes) SELECT id, hit OR anulada AS anulada, CASE WHEN hit THEN NULL ELSE gabarito END AS gabarito FROM v")
def void_questions(spark, sf_dir):
    return changes.void_listed(questions(spark, sf_dir)).select("id", "anulada", "gabarito")


@query(f"WITH {QUESTIONS_SQL} SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN tipo END, CASE WHEN fonte = 'EXATO' THEN 'SIMULADO' ELSE 'PROVA' END) AS tipo FROM questoes")
def backfill_tipo(spark, sf_dir):
    gaps = questions(spark, sf_dir).withColumn("tipo", F.when(F.col("id") % 2 == 0, F.col("tipo")))
    return changes.backfill_kind(gaps).select("id", "tipo")


@query(f"WITH {QUESTIONS_SQL}, {ANSWERS_SQL} SELECT id, numero FROM questoes WHERE id NOT IN (SELECT questao_id FROM respostas WHERE seq = 1)")
def delete_anti(spark, sf_dir):
    gone = answers(spark, sf_dir).where("seq = 1").select(F.col("questao_id").alias("id"))
    return changes.delete(questions(spark, sf_dir), gone).select("id", "numero")


@query(f"WITH {QUESTIONS_SQL}, {ANSWERS_SQL} SELECT id, numero, CASE WHEN id IN (SELECT questao_id FROM respostas WHERE seq = 1) THEN true ELSE tem_imagem END AS tem_imagem FROM questoes")
def mark_listed(spark, sf_dir):
    q = questions(spark, sf_dir).select(F.col("id").alias("questao_id"), "numero", "tem_imagem")
    return changes.mark(q, answers(spark, sf_dir).where("seq = 1"), "tem_imagem", True).withColumnRenamed("questao_id", "id")


@query(f"WITH {QUESTIONS_SQL} SELECT ano, count(*) AS total, count(*) AS completas, count(gabarito) AS com_gabarito FROM questoes GROUP BY ano")
def quality_by_year(spark, sf_dir):
    return inventory.quality(questions(spark, sf_dir))


@query(f"WITH {QUESTIONS_SQL} SELECT ano, string_agg(dia, ',' ORDER BY dia) AS dias FROM (SELECT DISTINCT ano, dia FROM questoes) GROUP BY ano")
def days_by_year(spark, sf_dir):
    return inventory.days(questions(spark, sf_dir), "ano").select("ano", F.array_join("dias", ",").alias("dias"))


@query(f"""WITH {QUESTIONS_SQL} SELECT id, concat_ws(';', 'A=' || p_size, 'B=' || (p_size + 1), 'C=' || (p_size + 2), 'D=' || (p_size + 3), 'E=' || (p_size + 4)) AS mapa, 'ABCDE' AS letras,
  concat_ws('|', 'A) ' || p_size, 'B) ' || (p_size + 1), 'C) ' || (p_size + 2), 'D) ' || (p_size + 3), 'E) ' || (p_size + 4)) AS linhas FROM questoes""")
def options_map(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    made = part.select(F.col("p_partkey").alias("id"), arrays.options_map(F.array(*[(F.col("p_size") + n).cast("string") for n in range(5)])).alias("m"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return made.select("id", pairs.alias("mapa"), F.array_join(arrays.letters_present(F.col("m")), "").alias("letras"), arrays.option_lines(F.col("m"), "|").alias("linhas"))


@query("""SELECT n, CASE WHEN n = 0 THEN 'antes_1' WHEN n = 1 THEN 'antes_1,apos_ultimo' ELSE 'antes_1,' || array_to_string([('entre_' || i || '_' || (i + 1)) for i in range(1, n)], ',') || ',apos_ultimo' END AS lugares FROM (SELECT DISTINCT p_size % 8 AS n FROM part)""")
def image_slots(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") % 8).alias("n")).distinct()
    return n.select("n", F.array_join(arrays.image_slots(F.col("n")), ",").alias("lugares"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'a.png:antes_1,b.png:' || CASE WHEN id % 2 = 0 THEN 'antes_1' ELSE 'apos_ultimo' END ELSE 'b.png:' || CASE WHEN id % 2 = 0 THEN 'antes_1' ELSE 'apos_ultimo' END || CASE WHEN id % 3 = 1 THEN ',c.png:antes_1' ELSE '' END END AS imagens
  FROM (SELECT p_partkey AS id FROM part)""")
def image_edits(spark, sf_dir):
    """Bare paths and structs lifted, one taken out, one put in, places filled."""
    image = lambda path, at: F.struct(F.lit(path).alias("path"), at.alias("posicao"), F.lit(None).cast("string").alias("supabase_url"))
    id_ = F.col("id")
    raw = F.array(F.when(id_ % 3 == 0, F.lit('{"path":"a.png"}')).otherwise(F.lit("x.png")), F.when(id_ % 2 == 0, F.lit("b.png")).otherwise(F.lit('{"path":"b.png","posicao":"apos_ultimo"}')))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    lifted = rows.select("id", F.transform(raw, arrays.image_struct).alias("imagens"))
    lifted = lifted.withColumn("imagens", arrays.without_path(F.col("imagens"), F.lit("x.png")))
    lifted = lifted.withColumn("imagens", F.when(id_ % 3 == 1, arrays.put_image(F.col("imagens"), image("c.png", F.lit("")))).otherwise(F.col("imagens")))
    placed = lifted.withColumn("imagens", arrays.default_position(F.col("imagens")))
    return placed.select("id", F.array_join(F.transform("imagens", lambda i: F.concat(i["path"], F.lit(":"), i["posicao"])), ",").alias("imagens"))


@query(f"""WITH {QUESTIONS_SQL}, n AS (SELECT id, ano, pagina_pdf, row_number() OVER (PARTITION BY ano ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY ano) AS c FROM questoes)
  SELECT id, coalesce(pagina_pdf, least(2 + floor(i * (32 - 2) / c::DOUBLE), 31))::INTEGER AS pagina FROM n""")
def spread_pages(spark, sf_dir):
    """W12."""
    numbered = ranks.placed(questions(spark, sf_dir).select("id", "ano", "pagina_pdf"), ["ano"], [F.col("id").asc()], "i")
    n = ranks.joined(numbered, numbered.groupBy("ano").agg(F.count("*").alias("c")), ["ano"])
    return n.select("id", F.coalesce("pagina_pdf", spread_page(F.col("i") - 1, F.col("c"), 2, F.lit(32))).alias("pagina"))


def _values(labels: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in labels.items()) + ")"


@query(f"WITH {QUESTIONS_SQL} SELECT q.id, coalesce(e.r, q.evento) AS rotulo, coalesce(d.r, q.dia) AS dia_rotulo FROM questoes q LEFT JOIN {_values(fixed.EVENT_LABELS)} e(c, r) ON e.c = q.evento LEFT JOIN {_values(fixed.DAY_LABELS)} d(c, r) ON d.c = q.dia")
def event_and_day_labels(spark, sf_dir):
    events, days = dimension(spark, fixed.EVENT_LABELS, "evento", "rotulo"), dimension(spark, fixed.DAY_LABELS, "dia", "dia_rotulo")
    return search.labelled(search.labelled(questions(spark, sf_dir), events, "evento", "rotulo"), days, "dia", "dia_rotulo").select("id", "rotulo", "dia_rotulo")


@query(f"WITH {QUESTIONS_SQL} SELECT id, numero, row_number() OVER (ORDER BY numero NULLS LAST, id) AS lugar FROM questoes WHERE dia = 'dia2'")
def file_order(spark, sf_dir):
    return search.file_order(questions(spark, sf_dir), "dia2").select("id", "numero", "lugar")


@query(f"WITH {QUESTIONS_SQL} SELECT id, fonte FROM questoes WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 7)")
def questions_among(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity = 7").select(F.col("l_partkey").alias("id"))
    return search.among(questions(spark, sf_dir), ids).select("id", "fonte")


@query(f"WITH {QUESTIONS_SQL} SELECT {LIGHT} FROM questoes WHERE fonte = 'ENEM' AND NOT anulada AND id IN (3, 6, 9, 12, 30) {LISTED} LIMIT 12")
def search_ids(spark, sf_dir):
    return light(search.search(questions(spark, sf_dir), SearchSpec(ids=(3, 6, 9, 12, 30))))


@query(f"""WITH {QUESTIONS_SQL} SELECT id, concat_ws(chr(10), '## Letra do gabarito', coalesce(gabarito, ''), '## Pergunta', coalesce(comando, ''), '## Opções', 'A) ' || p_size, 'B) ' || (p_size + 1), 'C) ' || (p_size + 2), 'D) ' || (p_size + 3), 'E) ' || (p_size + 4),
  '## Textos de apoio', p_name, p_type, p_brand, '## Origem', 'ENEM ' || coalesce(ano::VARCHAR, '') || ' nº ' || numero, '## Tarefa', 'Mostre o raciocínio que leva à letra do gabarito; em seguida aponte, letra a letra, o engano de cada outra opção. Escreva para um aluno do ensino médio.') AS pedido FROM questoes""")
def explain_prompts(spark, sf_dir):
    pedido = text.explain_prompt(*[F.col(c) for c in ("ano", "numero", "enunciado", "comando", "alternativas", "gabarito")])
    return questions(spark, sf_dir).select("id", pedido.alias("pedido"))


@query(f"WITH {QUESTIONS_SQL} SELECT id FROM questoes WHERE competencia IS NULL OR competencia = ''")
def unclassified_questions(spark, sf_dir):
    return search.unclassified(questions(spark, sf_dir)).select("id")


@query(f"WITH {QUESTIONS_SQL} SELECT id FROM questoes WHERE contains(p_name, 'gizmo') OR contains(p_type, 'gizmo') OR contains(p_brand, 'gizmo')")
def placeholder_questions(spark, sf_dir):
    return search.placeholder_left(questions(spark, sf_dir), "gizmo").select("id")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id DESC NULLS FIRST LIMIT 500")
def latest_texts(spark, sf_dir):
    return search.latest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


@query("""WITH n AS (SELECT p_partkey AS k, p_name FROM part), old AS (SELECT k AS id, p_name AS titulo FROM n WHERE k % 2 = 0), maior AS (SELECT coalesce(max(id), 0) AS m FROM old)
  SELECT count(*) AS linhas, count(DISTINCT id) AS ids, max(id) AS ultimo, sum(id)::BIGINT AS soma, count(*) FILTER (titulo = 'novo') AS trocadas FROM (
  SELECT id, CASE WHEN id % 10 = 0 THEN 'novo' ELSE titulo END AS titulo FROM old UNION ALL SELECT m + row_number() OVER (ORDER BY k), p_name FROM n, maior WHERE k % 2 = 1)""")
def insert_or_patch_totals(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("titulo"))
    old = part.where("id % 2 = 0")
    new = old.where("id % 10 = 0").withColumn("titulo", F.lit("novo")).union(part.where("id % 2 = 1").withColumn("id", F.lit(None).cast("long")))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return changes.insert_or_patch(old, new, top + 1).agg(F.count("*").alias("linhas"), F.count_distinct("id").alias("ids"), F.max("id").alias("ultimo"), F.sum("id").alias("soma"), F.count_if(F.col("titulo") == "novo").alias("trocadas"))


CHOSEN = {"area": [fixed.NATUREZA, fixed.AREAS[0]], "fonte": ["ENEM"], "dia": ["dia1", "simu_dia1", "exato"]}
COUNTED = ("ano", "dia", "area", "competencia", "fonte", "turno")


def _under(facet: str) -> str:
    chosen = [f"{c} IN ({', '.join(repr(v) for v in values)})" for c, values in CHOSEN.items() if c != facet]
    return f"SELECT '{facet}' AS faceta, {facet}::VARCHAR AS valor, count(*) AS total FROM questoes WHERE {facet} IS NOT NULL AND {' AND '.join(chosen)} GROUP BY 2"


@query(f"WITH {QUESTIONS_SQL} " + " UNION ALL ".join(map(_under, COUNTED)))
def facet_counts_under_choice(spark, sf_dir):
    """Each facet's counts under what is chosen of the others."""
    return facet_index.counts(facet_index.build(questions(spark, sf_dir), COUNTED), CHOSEN)


MAPPING_SQL = """arquivos AS (SELECT 'f' || lpad(p_partkey::VARCHAR, 8, '0') AS nome, CASE p_partkey % 6 WHEN 0 THEN 'prova' WHEN 1 THEN 'gabarito' WHEN 2 THEN 'prova' WHEN 3 THEN 'material' WHEN 4 THEN 'gabarito' END AS tipo,
  'E' || p_partkey % 45 AS evento, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE ['MANHA', 'TARDE'][p_partkey % 2 + 1] END AS turno, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'n' || (p_partkey // 2) END AS nome_pad,
  CASE WHEN p_partkey % 11 = 0 THEN 'f' || lpad((p_partkey // 2)::VARCHAR, 8, '0') END AS dup_de FROM part),
  unicos AS (SELECT * FROM arquivos WHERE dup_de IS NULL), proprias AS (SELECT evento, turno, min(nome) AS g FROM unicos WHERE tipo = 'gabarito' AND turno IS NOT NULL GROUP BY 1, 2), comuns AS (SELECT evento, min(nome) AS g FROM unicos WHERE tipo = 'gabarito' AND turno IS NULL GROUP BY 1),
  elos AS (SELECT u.nome AS prova, coalesce(p.g, c.g) AS gabarito, u.evento, u.turno FROM unicos u LEFT JOIN proprias p ON p.evento = u.evento AND p.turno = u.turno LEFT JOIN comuns c ON c.evento = u.evento WHERE u.tipo = 'prova')"""


def mapping(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("f"), F.lpad(c.cast("string"), 8, "0"))
    kinds, shifts = F.array(*map(F.lit, ("prova", "gabarito", "prova", "material", "gabarito", None))), F.array(F.lit("MANHA"), F.lit("TARDE"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        name(k).alias("nome"), F.get(kinds, (k % 6).cast("int")).alias("tipo"), F.concat(F.lit("E"), (k % 45).cast("string")).alias("evento"), F.when(k % 4 != 0, F.get(shifts, (k % 2).cast("int"))).alias("turno"),
        F.when(k % 3 != 0, F.concat(F.lit("n"), F.floor(k / 2).cast("string"))).alias("nome_pad"), F.when(k % 11 == 0, name(F.floor(k / 2))).alias("dup_de"),
    )


@query(f"""WITH {MAPPING_SQL} SELECT 'resumo' AS secao, coalesce(tipo, '') AS chave, count(*)::VARCHAR AS valor FROM arquivos GROUP BY 2
  UNION ALL SELECT 'associacoes', prova, concat_ws('/', gabarito, evento, turno) FROM elos UNION ALL SELECT 'duplicatas', nome, dup_de FROM arquivos WHERE dup_de IS NOT NULL
  UNION ALL SELECT 'material_apoio', nome, tipo FROM unicos WHERE tipo = 'material' UNION ALL SELECT 'nao_identificados', nome, nome FROM unicos WHERE tipo IS NULL
  UNION ALL SELECT 'inconsistencias', prova || '|prova sem gabarito', 'prova sem gabarito' FROM elos WHERE gabarito IS NULL
  UNION ALL SELECT 'inconsistencias', nome || '|gabarito sem prova', 'gabarito sem prova' FROM unicos WHERE tipo = 'gabarito' AND nome NOT IN (SELECT gabarito FROM elos WHERE gabarito IS NOT NULL)
  UNION ALL SELECT 'inconsistencias', nome || '|nome de destino repetido', 'nome de destino repetido' FROM unicos WHERE nome_pad IN (SELECT nome_pad FROM unicos GROUP BY 1 HAVING count(*) > 1)""")
def collection_report(spark, sf_dir):
    """K10, written and read back section by section."""
    path = scratch(spark, "report")
    reports.write(reports.report(mapping(spark, sf_dir)), path)
    shown = {"resumo": ("coalesce(tipo, '')", "cast(arquivos as string)"), "associacoes": ("prova", "concat_ws('/', gabarito, evento, turno)"), "duplicatas": ("nome", "dup_de"), "material_apoio": ("nome", "tipo"), "nao_identificados": ("nome", "nome"), "inconsistencias": ("concat_ws('|', nome, motivo)", "motivo")}
    parts = [reports.read(spark, path, name).selectExpr(f"'{name}' AS secao", f"{key} AS chave", f"{value} AS valor") for name, (key, value) in shown.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {MAPPING_SQL}, {QUESTIONS_SQL}, e AS (SELECT evento, string_agg(DISTINCT turno, ',' ORDER BY turno) AS turnos, count(*) AS provas, count(gabarito) AS com_gabarito FROM elos WHERE evento IS NOT NULL GROUP BY 1)
  SELECT 'eventos' AS secao, evento AS chave, coalesce(turnos, '') || '/' || provas || '/' || com_gabarito AS valor FROM e UNION ALL SELECT 'filtros', 'fonte|' || fonte, count(*)::VARCHAR FROM questoes GROUP BY 2 UNION ALL SELECT 'filtros', 'turno|' || turno, count(*)::VARCHAR FROM questoes WHERE turno IS NOT NULL GROUP BY 2""")
def collection_metadata(spark, sf_dir):
    """K11."""
    path = scratch(spark, "metadata")
    reports.write(reports.metadata(mapping(spark, sf_dir), questions(spark, sf_dir), ("fonte", "turno")), path)
    events = reports.read(spark, path, "eventos").selectExpr("'eventos' AS secao", "evento AS chave", "concat_ws('/', array_join(turnos, ','), provas, com_gabarito) AS valor")
    return events.unionByName(reports.read(spark, path, "filtros").selectExpr("'filtros' AS secao", "concat_ws('|', filtro, valor) AS chave", "cast(total as string) AS valor"))
