"""Queries on what the other plans leave out: small functions, edits of images, sheets, objects, files, papers and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certame import fixed, schemas
from certame.functions import arrays, numbers, text
from certame.operators import changes, exams, extract, inventory, models, search, sheets
from certame.plans.adapter import AREAS_SQL, LETTERS_SQL, QUESTIONS_SQL, questions
from certame.plans.registry import query
from certame.sources import files, sinks
from certame.sources.staging import scratch

K = "p_partkey"


def part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def said(c):
    return c.cast("string")


@query("""SELECT p_partkey AS id, replace(p_name, ' ', '|') AS por_espacos, trim(p_name) || '|' || p_type || '|' || p_brand AS termos, p_name || p_type AS sem_nul, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::INTEGER END AS numero,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (2000 + p_partkey % 30)::INTEGER END AS ano, CASE WHEN p_partkey % 5 <> 0 THEN 'image/png' END AS mime, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS conteudo,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS primeiro, [p_name, p_type, p_brand][(p_partkey + 1) % 3 + 1] AS sorteado, [p_brand] AS lista FROM part""")
def text_pieces(spark, sf_dir):
    """F12, F15, F23, F24, F27, F41, F55, F70, O9."""
    k, n = F.col(K), F.col("p_name")
    file = F.concat(F.lit("x/"), F.when(k % 4 == 0, "enem").otherwise("enem_"), said(2000 + k % 30), F.lit(".json"))
    uri = F.concat(F.lit("data:image/png;base64"), F.when(k % 5 == 0, "").otherwise(","), F.base64(n.cast("binary")))
    return part(spark, sf_dir).select(
        k.alias("id"), F.array_join(text.ocr_paragraphs(F.replace(n, F.lit(" "), F.lit("   "))), "|").alias("por_espacos"), F.array_join(text.search_terms(F.concat(n, F.lit(" , "), "p_type", F.lit(",, "), "p_brand", F.lit(","))), "|").alias("termos"),
        text.strip_nul(F.concat(n, F.lit("\0"), "p_type")).alias("sem_nul"), numbers.to_int(F.when(k % 3 == 0, n).otherwise(said(F.col("p_size")))).alias("numero"), text.year_of_file(file).alias("ano"),
        text.data_uri(uri)["mime"].alias("mime"), text.data_uri(uri)["content"].cast("string").alias("conteudo"), arrays.first_or_null(F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))).alias("primeiro"),
        numbers.pick(F.array("p_name", "p_type", "p_brand"), (k + 1).cast("int")).alias("sorteado"), arrays.as_array(F.col("p_brand")).alias("lista"),
    )


PARS = "[regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)) if regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '']"


@query(f"SELECT doc_id, len({PARS})::INTEGER AS n, md5(array_to_string({PARS}, '|')) AS hash FROM documents")
def blank_line_paragraphs(spark, sf_dir):
    """F11."""
    ps = text.paragraphs(F.replace("text", F.lit(". "), F.lit(".\n\n")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(ps).alias("n"), F.md5(F.array_join(ps, "|")).alias("hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'sem data ' || o_orderkey ELSE strftime(o_orderdate, '%d/%m/%Y') END AS quando FROM orders")
def local_dates(spark, sf_dir):
    """F65."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    told = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("sem data "), said(F.col("o_orderkey")))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", numbers.local_date(told).alias("quando"))


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN ['b'] ELSE [] END || CASE WHEN p_partkey % 4 = 0 THEN ['c'] ELSE [] END AS imagens,
    CASE WHEN p_partkey % 2 = 0 THEN ['B=c'] ELSE [] END || CASE WHEN p_partkey % 5 = 0 THEN ['C=z'] ELSE [] END AS opcoes, p_partkey % 4 = 0 AS antes FROM part)
  SELECT id, array_to_string(imagens, ',') AS imagens, array_to_string(opcoes, ',') AS opcoes, CASE WHEN antes THEN 1 ELSE 0 END AS antes, CASE WHEN len(opcoes) > 0 THEN '{"id":' || id || ',"imagens":"' || array_to_string(imagens, ',') || '","opcoes":"' || array_to_string(opcoes, ',') || '","nota":null}'
    ELSE '{"id":' || id || ',"imagens":"' || array_to_string(imagens, ',') || '","nota":null}' END AS linha FROM r WHERE len(imagens) > 0""")
def image_book(spark, sf_dir):
    """An image added here, an option's there, a file taken out of all; then the questions with images."""
    k = F.col("id")
    image = lambda path, at: F.struct(F.lit(path).alias("path"), F.lit(at).alias("posicao"), F.lit(None).cast("string").alias("supabase_url"))
    none = F.array().cast("array<struct<path:string,posicao:string,supabase_url:string>>")
    rows = part(spark, sf_dir).select(F.col(K).alias("id"), F.lit(False).alias("tem_imagem"))
    rows = rows.withColumn("imagens", F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(image("a", "antes_1"))).otherwise(F.array(image("a", "antes_1"), image("b", "apos_ultimo"))))
    rows = rows.withColumn("imagens_alternativas", F.when(k % 2 == 0, F.create_map(F.lit("A"), F.lit("a"), F.lit("B"), F.lit("c"))))
    rows = changes.drop_image(changes.set_option_image(changes.add_image(rows, k % 4 == 0, image("c", "antes_1")), k % 5 == 0, F.lit("C"), F.lit("z")), F.lit("a"))
    options = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("imagens_alternativas", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    shown = search.with_images(rows).select("id", F.array_join(F.transform("imagens", lambda i: i["path"]), ",").alias("imagens"), options.alias("opcoes"), F.size(arrays.before_images(F.col("imagens"))).alias("antes"))
    lines = shown.withColumns({"opcoes": F.nullif("opcoes", F.lit("")), "nota": F.lit(None).cast("string")})
    return lines.select("id", "imagens", F.coalesce("opcoes", F.lit("")).alias("opcoes"), "antes", arrays.row_json(["id", "imagens", "opcoes", "nota"], ("nota",)).alias("linha"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 6 >= 3 THEN (p_partkey % 6)::INTEGER ELSE 5 END AS n, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 6 >= 3 THEN 'nova 1' ELSE (p_size)::VARCHAR END AS a FROM part")
def recovered_options(spark, sf_dir):
    """Options read anew replace the old ones where there are three."""
    k = F.col("id")
    old = part(spark, sf_dir).select(F.col(K).alias("id"), F.map_from_arrays(F.array(*map(F.lit, fixed.LETTERS)), F.array(*[said(F.col("p_size") + n) for n in range(5)])).alias("alternativas"))
    read = F.transform(F.sequence(F.lit(1), F.greatest((k % 6).cast("int"), F.lit(1))), lambda i: F.concat(F.lit("nova "), said(i)))
    found = old.where(k % 3 != 0).select("id", arrays.options_map(read).alias("alternativas"))
    return changes.with_recovered(old, found).select("id", F.size("alternativas").alias("n"), F.col("alternativas")["A"].alias("a"))


FILLS = "[[((p_partkey * 7 + q * 13 + p_size * i) % 101) / 100.0::DOUBLE for i in [1, 2, 3, 5, 8]] for q in range(5)]"


@query(f"""WITH f AS (SELECT p_partkey AS id, p_size * 100 AS tamanho, p_partkey % 200 AS n, CASE p_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL ELSE 'image/png' END AS tipo, {FILLS} AS fs FROM part),
  e AS (SELECT *, CASE WHEN coalesce(tipo, '') <> 'image/png' THEN 'tipo de arquivo não suportado' WHEN tamanho < 1000 THEN 'imagem muito pequena' WHEN n NOT BETWEEN 1 AND 180 THEN 'número de questões inválido' END AS erro FROM f),
  q AS (SELECT id, erro, g.i AS i, fs[g.i] AS v FROM e, range(1, 6) g(i) WHERE erro IS NULL), s AS (SELECT *, list_max(v) AS m, list_sort(v, 'DESC')[2] AS z FROM q),
  d AS (SELECT id, i, CASE WHEN m < 0.35 OR m - z < 0.10 THEN NULL ELSE {LETTERS_SQL}[list_position(v, m)] END AS letra, round(CASE WHEN m < 0.35 THEN 0.0 WHEN m - z < 0.10 THEN 0.5 ELSE least(1.0, (m - 0.35) / (1 - 0.35)) END, 3) AS c FROM s),
  r AS (SELECT id, string_agg(coalesce(letra, '-'), '' ORDER BY i) AS respostas, count(letra)::INTEGER AS n_marcadas, (count(*) FILTER (letra IS NOT NULL AND c < 0.8))::INTEGER AS n_ambiguas, round(sum(c) / 5, 3) AS conf_media FROM d GROUP BY id)
  SELECT e.id, e.erro IS NULL AS sucesso, coalesce(respostas, '') AS respostas, coalesce(n_marcadas, 0) AS n_marcadas, coalesce(n_ambiguas, 0) AS n_ambiguas, coalesce(conf_media, 0.0::DOUBLE) AS conf_media, erro FROM e LEFT JOIN r ON r.id = e.id""")
def sheet_summaries(spark, sf_dir):
    """Results of sheets from the fills of their bubbles, and why others are not read."""
    k = F.col(K)
    fill = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda q: F.array(*[((k * 7 + q * 13 + F.col("p_size") * i) % 101) / 100.0 for i in (1, 2, 3, 5, 8)]))
    kind = F.when(k % 5 == 0, "application/pdf").when(k % 5 != 1, "image/png")
    checked = part(spark, sf_dir).select(said(k).alias("id"), (k % 200).cast("int").alias("total_questoes"), fill.alias("f"), sheets.input_error(F.col("p_size") * 100, (k % 200).cast("int"), kind).alias("erro"))
    fills = checked.withColumn("fills", F.when(F.col("erro").isNull(), F.col("f")).otherwise(F.array().cast("array<array<double>>")))
    return sheets.summary(fills).select(F.col("id").cast("long").alias("id"), "sucesso", F.array_join("respostas", "", "-").alias("respostas"), "n_marcadas", "n_ambiguas", "conf_media", "erro")


@query(f"SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE (p_partkey % 9 + 1) || '=' || {LETTERS_SQL}[p_partkey % 5 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',99=' END END AS mapa FROM part")
def told_keys(spark, sf_dir):
    """keys out of a model's words; entries that are none are left out."""
    k = F.col(K)
    letter = F.lower(F.element_at(F.array(*map(F.lit, fixed.LETTERS)), (k % 5 + 1).cast("int")))
    void = F.when(k % 3 == 0, ', "99": "F"').otherwise(', "99": null')
    answer = F.when(k % 4 == 0, F.lit('Aqui: {"gabarito": {"x": "A", "2": "AB"}}')).otherwise(F.concat(F.lit('Pronto: {"gabarito": {"'), said(k % 9 + 1), F.lit('": "'), letter, F.lit('"'), void, F.lit(', "dez": "B"}} fim')))
    got = arrays.key_map(text.json_object(answer))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(got)), lambda e: F.concat(said(e["key"]), F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")
    return part(spark, sf_dir).select(k.alias("id"), shown.alias("mapa"))


@query("""WITH o AS (SELECT p_partkey AS k, 'p/' || p_partkey || '.png' AS path, p_name, p_type FROM part), f AS (SELECT true AS forcado UNION ALL SELECT false)
  SELECT forcado, 'http://h/b/' || path AS url, CASE WHEN k % 3 = 0 AND (forcado OR k % 2 = 1) THEN p_type ELSE p_name END AS conteudo FROM o, f WHERE k % 2 = 0 OR k % 3 = 0""")
def uploaded_objects(spark, sf_dir):
    """K5-K7: objects with new ones, which replace those of their path only by force, and their addresses."""
    rows = part(spark, sf_dir).select(F.col(K).alias("k"), F.concat(F.lit("p/"), said(F.col(K)), F.lit(".png")).alias("path"), "p_name", "p_type")
    old = rows.where("k % 2 = 0").select("path", F.col("p_name").cast("binary").alias("content"))
    new = rows.where("k % 3 = 0").select("path", F.col("p_type").cast("binary").alias("content"))
    out = [sinks.put_objects(old, new, force).withColumn("forcado", F.lit(force)) for force in (True, False)]
    every = reduce(DataFrame.unionByName, out)
    return every.join(sinks.public_urls(every.select("path").distinct(), "http://h/b/"), "path").select("forcado", "url", F.col("content").cast("string").alias("conteudo"))


@query(f"""WITH {QUESTIONS_SQL}, q AS (SELECT 'enem_' || ano || '.json' AS nome, ano FROM questoes WHERE ano IS NOT NULL) SELECT nome, ano AS ano_arquivo, count(*) AS linhas, true AS listado FROM q GROUP BY 1, 2 UNION ALL SELECT 'ruim', NULL, 1, false""")
def exported_files(spark, sf_dir):
    """Files by year, listed and read by a pattern that also meets a broken one, which is named."""
    path = scratch(spark, "years")
    rows = questions(spark, sf_dir).where("ano is not null").select(F.lit("enem").alias("prefixo"), "ano", "numero", "enunciado")
    sinks.write_json_arrays(rows, path, unit=("prefixo", "ano"))
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{path}/enem_ruim")
    name = F.element_at(F.split("arquivo", "/"), -1).alias("nome")
    read = files.read_json(spark, f"{path}/enem_*").select(name, "ano_arquivo").groupBy("nome", "ano_arquivo").agg(F.count("*").alias("linhas"))
    listed = files.list_files(spark, path, ".json").select("nome", F.lit(True).alias("listado"))
    bad = files.bad_files(spark, f"{path}/enem_*").agg(F.count("*").alias("linhas")).select(F.lit("ruim").alias("nome"), F.lit(None).cast("int").alias("ano_arquivo"), "linhas", F.lit(False).alias("listado"))
    return read.join(listed, "nome", "left").select("nome", "ano_arquivo", "linhas", F.coalesce("listado", F.lit(False)).alias("listado")).unionByName(bad)


@query(f"""SELECT p_partkey AS id, n::INTEGER AS numero, {AREAS_SQL}[p_partkey % 4 + 1] AS area, 'Sobre ' || p_name || ', o que vale ' || n || '?' AS comando, p_type AS inicio, CASE WHEN n = 1 THEN 5 ELSE 4 END AS opcoes,
  CASE WHEN (p_partkey + n) % 7 = 0 THEN NULL ELSE {LETTERS_SQL}[(p_partkey + n) % 5 + 1] END AS gabarito, (p_partkey + n) % 7 = 0 AS anulada, 'UFT' AS fonte FROM part, range(1, 3) t(n) WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, 9, 'Linguagens, Codigos e suas Tecnologias', '', 'lida', 1, NULL, false, 'UFT' FROM part WHERE p_partkey % 3 = 0""")
def papers_to_rows(spark, sf_dir):
    """Pages of papers to rows of the table; a third of the pages has too little text and goes to a reader."""
    k = F.col(K)

    def question(n: int):
        lines = [F.lit(f"Questão {n}"), F.col("p_type"), F.concat(F.lit("Sobre "), "p_name", F.lit(f", o que vale {n}?")), *[F.concat(F.lit(f"{x} "), "p_brand", F.lit(f" {x}")) for x in fixed.LETTERS[: 6 - n]]]
        return F.concat_ws("\n", *lines)

    area = F.element_at(F.array(*map(F.lit, fixed.AREAS)), (k % 4 + 1).cast("int"))
    whole = F.concat_ws("\n", area, F.repeat(F.lit("caderno de prova "), F.lit(10)), question(1), question(2), F.lit(""))
    pages = part(spark, sf_dir).select(k.alias("id"), F.lit(0).alias("page"), F.when(k % 3 == 0, "pouco texto").otherwise(whole).alias("texto"))

    def entry(n: int):
        letter = F.when((k + n) % 7 == 0, "ANULADA").otherwise(F.element_at(F.array(*map(F.lit, fixed.LETTERS)), ((k + n) % 5 + 1).cast("int")))
        return F.concat(F.lit(f"{n}. "), letter)

    keys = part(spark, sf_dir).where(k % 3 != 0).select(k.alias("id"), F.lit(0).alias("page"), F.concat_ws("\n", entry(1), entry(2), *[F.lit(f"{n}. A") for n in (50, 51, 52)]).alias("texto"))
    seen = lambda rest: rest.select("id", "page", F.lit(9).alias("numero"), F.array(F.lit("lida")).alias("enunciado"), F.create_map(F.lit("A"), F.lit("z")).alias("alternativas"))
    read = extract.questions_of_papers(pages, ("id", "page"), seen)
    from certame.operators.answer_key import key_rows, with_key

    told = with_key(read, key_rows(keys), ("id", "page", "numero"))
    rows = extract.table_rows(told.withColumn("evento", said(F.col("id"))), "UFT", "PROVA")
    return rows.select(F.col("evento").cast("long").alias("id"), "numero", "area", "comando", F.get("enunciado", F.lit(0)).alias("inicio"), F.size("alternativas").alias("opcoes"), "gabarito", "anulada", "fonte")


@query("""SELECT p_partkey AS id, (p_partkey % 90 + 1)::INTEGER AS numero, p_name AS a, p_type || ' ' || p_brand AS b, CASE WHEN p_partkey % 4 = 1 THEN 2 ELSE 3 END::INTEGER AS pagina FROM part WHERE p_partkey % 4 <> 0""")
def scanned_options(spark, sf_dir):
    """Options of wanted questions from scanned pages; the first page whose block has three of them counts."""
    k = F.col(K)
    n = (k % 90 + 1).cast("int")
    head = lambda word: F.concat(F.lit(f"capa\n{word} "), said(n), F.lit("\nenunciado\n"))
    full = lambda page: F.concat(head("Questão"), F.lit("A) "), "p_name", F.lit("\nB) "), "p_type", F.lit("\n"), "p_brand", F.lit(f"\nC) pagina {page}\nQuestão 200\nA x\nB y\nC z"))
    short = F.concat(head("QUESTAO"), F.lit("A um\nB dois\n"))
    pages = part(spark, sf_dir).select(k.alias("id"), F.posexplode(F.array(short, F.when(k % 4 == 1, full(2)).otherwise(short), full(3))).alias("page", "texto"))
    wanted = part(spark, sf_dir).where(k % 4 != 0).select(k.alias("id"), n.alias("numero"))
    found = extract.options_by_ocr(pages, wanted, ("id",))
    return found.select("id", "numero", F.col("alternativas")["A"].alias("a"), F.col("alternativas")["B"].alias("b"), F.regexp_extract(F.col("alternativas")["C"], r"(\d+)", 1).cast("int").alias("pagina"))


@query("""WITH f AS (SELECT p_partkey AS k, 'f' || p_partkey AS nome, CASE p_partkey % 3 WHEN 0 THEN 'prova' WHEN 1 THEN 'gabarito' END AS tipo FROM part)
  SELECT 'copia' AS que, nome AS chave, CASE tipo WHEN 'prova' THEN 'PROVAS/' ELSE 'GABARITOS/' END || CASE WHEN k % 2 = 0 THEN 'x' || k ELSE nome END AS valor FROM f WHERE tipo IS NOT NULL
  UNION ALL SELECT 'variante', (p_size % 10)::VARCHAR, min(CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN p_brand END) FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 2
  UNION ALL SELECT 'uma', '7', p_name FROM part WHERE p_partkey = 7 UNION ALL SELECT 'padrao', 'f' || p_partkey, coalesce(CASE p_partkey % 3 WHEN 0 THEN 'prova' WHEN 1 THEN 'gabarito' END, 'outro') || '/1' FROM part
  UNION ALL SELECT 'pendente', event_id::VARCHAR, event_type FROM events WHERE event_id % 2 = 1""")
def file_chores(spark, sf_dir):
    """Where files go, the first variant that is there, one row and only one, columns that a table gains, reports that wait."""
    k = F.col(K)
    mapping = part(spark, sf_dir).select(F.concat(F.lit("f"), said(k)).alias("nome"), F.when(k % 3 == 0, "prova").when(k % 3 == 1, "gabarito").alias("tipo"), F.when(k % 2 == 0, F.concat(F.lit("x"), said(k))).alias("nome_pad"))
    shown = lambda rows, what, key, value: rows.select(F.lit(what).alias("que"), said(key).alias("chave"), said(value).alias("valor"))
    there = part(spark, sf_dir).select(said(F.col("p_size") % 10).alias("pasta"), F.col("p_brand").alias("nome"))
    wanted = spark.createDataFrame([("chave", n, f"Brand#{n}") for n in (1, 2, 3)], "alvo string, ordem int, nome string")
    one = inventory.only_one(search.question(part(spark, sf_dir).select(k.alias("id"), "p_name"), 7))
    grown = schemas.evolve(mapping, "nome string, tipo string, versao int", {"tipo": "outro", "versao": 1})
    path = scratch(spark, "reports")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("questao_id"), F.col("event_type").alias("tipo_erro"), F.when(F.col("event_id") % 2 == 0, "resolvido").otherwise("pendente").alias("status"))
    sinks.write_json_arrays(e, path)
    parts = [
        shown(inventory.copy_plan(mapping, {"prova": "PROVAS", "gabarito": "GABARITOS"}), "copia", F.col("origem"), F.col("destino")), shown(inventory.first_existing(wanted, there), "variante", F.col("pasta"), F.col("nome")),
        shown(one, "uma", F.col("id"), F.col("p_name")), shown(grown, "padrao", F.col("nome"), F.concat("tipo", F.lit("/"), said(F.col("versao")))), shown(files.pending_reports(spark, f"{path}/*.json"), "pendente", F.col("questao_id"), F.col("tipo_erro")),
    ]
    return reduce(DataFrame.unionByName, parts)


SKILLS = {"H01": "um", "H02": "dois"}
PROMPT = "length('Classifique a questão com UMA habilidade.' || chr(10) || chr(10) || 'Área: ' || area || chr(10) || 'Enunciado: ' || substr(p_name || ' ' || p_type || ' ' || p_brand, 1, 600) || chr(10) || 'Comando: ' || coalesce(comando, '') || chr(10) || chr(10) || 'Habilidades:' || chr(10) || 'H01: um' || chr(10) || 'H02: dois' || chr(10) || chr(10) || 'Responda APENAS com o código.')"


@query(f"WITH {QUESTIONS_SQL} SELECT id, coalesce(competencia, 'H' || lpad(({PROMPT} % 30 + 1)::VARCHAR, 2, '0')) AS competencia FROM questoes")
def classified_by_model(spark, sf_dir):
    """A skill for each question without one, from the first of some models that answers; here a rule stands for it."""

    def make():
        def busy(prompt):
            raise models.Limited

        return models.first_of(models.patient(busy, tries=2, sleep=lambda s: None), lambda prompt: "", lambda prompt: f"É a h{len(prompt) % 30 + 1:02d}.")

    return models.classify_skills(questions(spark, sf_dir).select("id", "competencia", "area", "enunciado", "comando"), make, SKILLS).select("id", "competencia")


@query(f"""WITH {QUESTIONS_SQL}, s AS (SELECT id FROM questoes WHERE fonte = 'ENEM' AND NOT anulada AND tipo = 'PROVA' AND ano >= 2010 ORDER BY md5('mock-' || id::VARCHAR), id LIMIT 45)
  SELECT 'u1' AS usuario_id, 'online' AS tipo, string_agg(id::VARCHAR, ',' ORDER BY id) AS questoes, count(*)::INTEGER AS total_questoes, 'em_andamento' AS status FROM s""")
def created_mock(spark, sf_dir):
    """A new mock of 45 questions out of what a search finds."""
    pool = questions(spark, sf_dir).where(search.predicate(search.SearchSpec(filters={"tipo": "PROVA"}, year_from=2010, sampling=True)))
    made = exams.create(pool, "u1", 45, "mock", F.current_timestamp())
    return made.select("usuario_id", "tipo", F.array_join(F.transform(F.array_sort("questoes_ids"), said), ",").alias("questoes"), "total_questoes", "status")


@query("SELECT p_partkey::VARCHAR AS chave, p_partkey % 13 <> 0 AS ok, CASE WHEN p_partkey % 13 = 0 THEN 'refused ' || p_name END AS erro FROM part")
def sent_batches(spark, sf_dir):
    """K4: rows in batches of fifty to a sink that refuses some; where a batch fails its rows go one by one."""

    def open_sink():
        def put(rows):
            for r in rows:
                if r["p_partkey"] % 13 == 0:
                    raise ValueError(f"refused {r['p_name']}")

        return put

    return sinks.send(part(spark, sf_dir).select(K, "p_name"), K, open_sink)


@query(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN [p_name] ELSE [p_type, p_brand] END AS termos, CASE WHEN p_partkey % 3 = 0 THEN {AREAS_SQL}[p_partkey % 4 + 1] END AS area, CASE WHEN p_partkey % 5 < 3 THEN 'H' || lpad((p_partkey % 30)::VARCHAR, 2, '0') END AS competencia
  FROM part WHERE p_partkey % 7 <> 0""")
def asked_searches(spark, sf_dir):
    """Questions in words, a model's answer, and the filter that is taken from it; blank questions ask nothing."""
    k = F.col(K)
    asked = part(spark, sf_dir).select(k.alias("id"), F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("pedido"), "p_type", "p_brand")
    area = F.when(F.col("id") % 3 == 0, F.element_at(F.array(*map(F.lit, fixed.AREAS)), (F.col("id") % 4 + 1).cast("int"))).otherwise("outra")
    skill = F.when(F.col("id") % 5 < 3, F.concat(F.lit("H"), F.lpad(said(F.col("id") % 30), 2, "0"))).otherwise("H7")
    terms = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(" "), "p_type"), F.lit(""), F.col("p_brand"), F.lit("quarto")))
    rows = asked.withColumn("resposta", F.concat(F.lit("Claro: "), F.to_json(F.struct(terms.alias("termos"), area.alias("area"), skill.alias("competencia")))))
    told = models.asked(rows.withColumn("pergunta", text.search_prompt(F.col("pedido"), fixed.AREAS)).where("pergunta is not null").withColumn("pergunta", F.concat("pergunta", F.lit("\0"), "resposta")), "pergunta", "dito", lambda: lambda prompt: prompt.split("\0")[1])
    return told.select("id", text.search_answer(text.json_object(F.col("dito")), F.col("pedido")).alias("s")).select("id", "s.termos", "s.area", "s.competencia")
