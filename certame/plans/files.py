"""Queries on files: names, kinds, copies, what is there and what is not."""

from __future__ import annotations

from pyspark.sql import functions as F

from certame import fixed
from certame.functions import text
from certame.operators import inventory
from certame.plans.registry import query

# Names as they are found in folders.
FILES = (
    ("Bernoulli 2023/Simulado 00-2023", "simu 00_2023 - 1º dia - bernoulli.pdf"),
    ("Bernoulli 2023/Simulado 00-2023", "Gab - simu 00_2023 - 1º dia - bernoulli.pdf"),
    ("Bernoulli 2024/00", "1º dia Bernoulli 00 -2024.pdf"),
    ("Bernoulli 2024/00", "gab 1º dia Bernoulli 00 -2024.pdf"),
    ("SAS 2023/SAS 06", "1 SAS 2023 - DIA 1 PROVA.pdf"),
    ("SAS 2023/SAS 06", "1 SAS 2023 - DIA 1 GABARITO.pdf"),
    ("SAS 2023/SAS 06", "1 SAS 2023 - DIA 2 PROVA.pdf"),
    ("SOMOS 2023/SOMOS 03", "DIA 1 SOMOS 02-2023.pdf"),
    ("SOMOS 2023/SOMOS 03", "GAB DIA 1 SOMOS 02-2023.pdf"),
    ("Poliedro 2023/Ciclo 01", "1º_Poliedro_Enem_2023_-_1º_Dia_-_Prova.pdf"),
    ("Poliedro 2023/Ciclo 01", "1º_Poliedro_Enem_2023_-_1º_Dia_-_Resolução.pdf"),
    ("Poliedro 2024/01", "1º Poliedro 2024 - prova d1 - @x.pdf"),
    ("Poliedro 2024/01", "1º Poliedro 2024 - D1 resolução - @x.pdf"),
    ("Farias Brito 2024/FB 01", "Simulado 01 - DIA 1 FARIAS BRITO .pdf"),
    ("Farias Brito 2024/FB 01", "Gabarito Dia 01 - Simulado 01 - FARIAS BRITO .pdf"),
    ("Outros/sem numero", "caderno azul.pdf"),
    ("Outros/sem numero", "caderno verde.pdf"),
    ("Outros/sem numero", "resolu azul.pdf"),
    ("Outros/sem numero", "caderno azul (1).pdf"),
)
FOLDERS = ("2024", "2021 - 1º EDIÇÃO", "2022 - 2º EDIÇÃO", "Bernoulli 2023", "Simulado 00-2023", "FB 01", "Ciclo 01", "SAS 06", "01", "sem numero", "Farias Brito 2024", "xx")
NAMES = ("matemática", "humanas", "LINGUAGENS e Matemática", "arte", "  Ciencias da Natureza e suas Tecnologias ", "Prova de MATEMATICA E SUAS TECNOLOGIAS", "")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, k):
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def files(spark, sf_dir):
    """A file a part: the names above, over and over, in folders of their own."""
    k = F.col("p_partkey")
    lot = F.floor(k / len(FILES)).cast("string")
    return parts(spark, sf_dir).select(F.concat(_pick([f for f, _ in FILES], k), F.lit(" "), lot).alias("pasta"), F.concat(F.lit("x"), lot, F.lit("x "), _pick([n for _, n in FILES], k)).alias("nome"))


FILES_SQL = f"(SELECT {_list(f for f, _ in FILES)}[p_partkey % {len(FILES)} + 1] || ' ' || (p_partkey // {len(FILES)}) AS pasta, 'x' || (p_partkey // {len(FILES)}) || 'x ' || {_list(n for _, n in FILES)}[p_partkey % {len(FILES)} + 1] AS nome FROM part)"
FOLDERS_SQL = f"(SELECT p_partkey AS id, {_list(FOLDERS)}[p_partkey % {len(FOLDERS)} + 1] || ' ' || p_brand AS nome FROM part)"
NAMES_SQL = f"(SELECT p_partkey AS id, {_list(NAMES)}[p_partkey % {len(NAMES)} + 1] || ' ' || p_name AS nome FROM part)"


def labelled(spark, sf_dir, values, column: str):
    k = F.col("p_partkey")
    return parts(spark, sf_dir).select(k.alias("id"), F.concat(_pick(values, k), F.lit(" "), column).alias("nome"))


def _case(column: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{a}') THEN '{b}'" for a, b in pairs) + " END"


@query(f"SELECT id, nome, coalesce({_case('lower(trim(nome))', fixed.AREA_NAMES)}, {_case('lower(trim(nome))', [(a.lower(), a) for a in fixed.AREAS])}) AS area, length(nome) >= 12 AS longo FROM {NAMES_SQL}")
def normalize_area(spark, sf_dir):
    return labelled(spark, sf_dir, NAMES, "p_name").select("id", "nome", text.normalize_area(F.col("nome")).alias("area"), (F.length("nome") >= 12).alias("longo"))


@query(f"SELECT id, nome, {_case('lower(nome)', fixed.VENDORS)} AS provedor, nullif(regexp_extract(nome, '(20[0-9]{{2}})', 1), '')::INTEGER AS ano FROM {FOLDERS_SQL}")
def normalize_vendor(spark, sf_dir):
    return labelled(spark, sf_dir, FOLDERS, "p_brand").select("id", "nome", text.vendor(F.col("nome")).alias("provedor"), text.folder_year(F.col("nome")).alias("ano"))


@query(f"""SELECT id, nome, printf('SIM_%02d', coalesce(nullif(regexp_extract(nome, '\\b0*([0-9]+)\\b', 1), ''), '1')::INTEGER) AS evento,
  nullif(regexp_extract(nome, '^([0-9]{{4}})', 1), '')::INTEGER AS ano, nullif(regexp_extract(nome, '([0-9]+)[°º]', 1), '') || '_EDICAO' AS edicao FROM {FOLDERS_SQL}""")
def normalize_event_year(spark, sf_dir):
    n = F.col("nome")
    return labelled(spark, sf_dir, FOLDERS, "p_brand").select("id", "nome", text.event_code(n).alias("evento"), text.paper_year(n).alias("ano"), text.edition(n).alias("edicao"))


KIND = "CASE WHEN regexp_matches(lower(nome), '\\bgab\\b|gabarito|resolu[cç]') THEN 'gabarito' WHEN regexp_matches(lower(nome), '\\bprova\\b|simu|sim[_\\s]?\\d|\\bdia\\b|poliedro|somos|sas|berno|farias') THEN 'prova' END"
DAY = "CASE " + " ".join(f"WHEN regexp_matches(lower(nome), '{n}[°º\\s]*dia|dia\\s*{n}\\b|d[_\\-\\s]?{n}\\b|{n}[°º\\s]*_?dia') THEN 'simu_dia{n}'" for n in (1, 2)) + " END"
CLASSIFIED = f"c AS (SELECT pasta, nome, {KIND} AS tipo, {DAY} AS dia FROM {FILES_SQL})"


@query(f"WITH {CLASSIFIED} SELECT * FROM c")
def classify_files(spark, sf_dir):
    return inventory.classified(files(spark, sf_dir))


@query(f"""WITH {CLASSIFIED}, k AS (SELECT pasta, tipo, dia, min(nome) AS nome FROM c WHERE tipo IS NOT NULL AND dia IS NOT NULL GROUP BY 1, 2, 3),
  r AS (SELECT pasta, nome, regexp_matches(lower(nome), 'gab|resolu') AS chave FROM c WHERE pasta NOT IN (SELECT pasta FROM k)),
  g AS (SELECT pasta, CASE WHEN chave THEN 'gabarito' ELSE 'prova' END AS tipo, 'simu_dia' || n AS dia, nome FROM (SELECT *, row_number() OVER (PARTITION BY pasta, chave ORDER BY nome) AS n FROM r) WHERE n <= 2),
  e AS (SELECT * FROM k UNION ALL SELECT * FROM g), p AS (SELECT pasta, dia, max(CASE WHEN tipo = 'prova' THEN nome END) AS prova, max(CASE WHEN tipo = 'gabarito' THEN nome END) AS gabarito FROM e GROUP BY 1, 2)
  SELECT * FROM p WHERE prova IS NOT NULL""")
def pair_papers(spark, sf_dir):
    return inventory.papers(files(spark, sf_dir))


@query(f"SELECT nome, (SELECT min(w.nome) FROM {FILES_SQL} w WHERE lower(w.nome) = regexp_replace(lower(v.nome), '\\s*\\(\\d\\)\\.pdf$', '.pdf') AND NOT regexp_matches(lower(w.nome), '\\(\\d\\)\\.pdf$')) AS dup_de FROM {FILES_SQL} v WHERE regexp_matches(lower(nome), '\\(\\d\\)\\.pdf$')")
def copied_files(spark, sf_dir):
    return inventory.originals(files(spark, sf_dir))


@query(f"SELECT nome FROM {FILES_SQL} WHERE contains(lower(nome), 'dia') AND contains(lower(nome), '1') AND NOT contains(lower(nome), 'gab') AND NOT regexp_matches(lower(nome), '\\(\\d\\)\\.pdf$')")
def named_files(spark, sf_dir):
    return files(spark, sf_dir).where(inventory.named(F.col("nome"), ("dia", "1"), ("gab",))).select("nome")


@query("SELECT md5(substr(text, 1, 2000)) AS hash, min(doc_id) AS original, count(*) - 1 AS copias FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_docs(spark, sf_dir):
    return inventory.duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def missing_files(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    o = o.where("o_orderkey % 3 = 0")
    return inventory.missing(c.select(F.col("c_custkey").alias("id")), o.select(F.col("o_custkey").alias("id")), "id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def present_files(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    return inventory.present(c.select(F.col("c_custkey").alias("id")), o.select(F.col("o_custkey").alias("id")), "id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)")
def unmapped_files(spark, sf_dir):
    p, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))  # noqa: E741
    return inventory.unmapped(p.select(F.col("p_partkey").alias("id")), l.where("l_linenumber = 2").select(F.col("l_partkey").alias("id")), "id")


@query("WITH n AS (SELECT DISTINCT user_id AS stem, event_id % 97 % 9 AS n FROM events WHERE event_id % 3 > 0), g AS (SELECT stem, unnest(range(1, 11)) AS i FROM (SELECT DISTINCT stem FROM n)) SELECT g.stem, min(g.i)::INTEGER AS livre FROM g LEFT JOIN n ON n.stem = g.stem AND n.n = g.i WHERE n.n IS NULL GROUP BY 1")
def free_suffixes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 > 0")
    taken = e.select(F.col("user_id").alias("stem"), (F.col("event_id") % 97 % 9).alias("n"))
    # stems whose numbers are all 0 have their first one free
    some = inventory.free_suffix(taken)
    return taken.select("stem").distinct().join(some, "stem", "left").select("stem", F.coalesce("livre", F.lit(1)).cast("int").alias("livre"))


KINDS = ("click", "purchase", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def kind_counts(spark, sf_dir):
    return inventory.kind_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", KINDS)


@query("WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE ['MANHA','TARDE'][p_partkey % 2 + 1] END AS turno, 'E' || p_partkey % 5 AS evento FROM part), k AS (SELECT 'E' || n_nationkey % 5 AS evento, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE ['MANHA','TARDE'][n_nationkey % 2 + 1] END AS turno, n_name AS gabarito FROM nation), j AS (SELECT m.*, max(row(k.turno IS NOT NULL, gabarito)) AS r FROM m LEFT JOIN k ON k.evento = m.evento AND (k.turno IS NULL OR k.turno = m.turno) GROUP BY 1, 2, 3) SELECT p_partkey, turno, evento, r[2] AS gabarito FROM j")
def key_of_mock(spark, sf_dir):
    p, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "nation"))
    shift = lambda k: F.element_at(F.array(F.lit("MANHA"), F.lit("TARDE")), (k % 2 + 1).cast("int"))
    i, k = F.col("p_partkey"), F.col("n_nationkey")
    mocks = p.select("p_partkey", F.when(i % 10 != 0, shift(i)).alias("turno"), F.concat(F.lit("E"), (i % 5).cast("string")).alias("evento"))
    keys = n.select(F.concat(F.lit("E"), (k % 5).cast("string")).alias("evento"), F.when(k % 3 != 0, shift(k)).alias("turno"), F.col("n_name").alias("gabarito"))
    return inventory.with_key(mocks, keys)
