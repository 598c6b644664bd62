"""Faceted search over questions: filters by source, text terms, pages, facets, neighbours."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame import fixed
from certame.operators import ranks

LIGHT = ("id", "numero", "ano", "dia", "area", "competencia", "gabarito")


@dataclass(frozen=True)
class SearchSpec:
    """What a search asks for. Filters that a source doesn't know, and empty ones, are not applied."""

    fonte: str | None = None
    filters: dict[str, object] = field(default_factory=dict)
    terms: tuple[str, ...] = ()
    year_from: int | None = None
    year_to: int | None = None
    page: int = 1
    page_size: int = fixed.PAGE_SIZE
    #: Only these questions (P6); a list too long for a condition is a table for among().
    ids: tuple[int, ...] = ()
    #: Sampling applies tipo to the national exam only; a search applies it to every source.
    sampling: bool = False
    #: % and _ in terms stand for themselves.
    escape: bool = True


def years(column: Column, low: int | None, high: int | None) -> list[Column]:
    """P5: a range of which either end may be open; a bound of 0 is none."""
    return ([column >= low] if low else []) + ([column <= high] if high else [])


def term_predicate(column: Column, terms: tuple[str, ...], escape: bool = True) -> Column:
    """Any paragraph holds any of the terms, in any case."""

    def like(text: Column, term: str) -> Column:
        if escape:
            return F.contains(F.lower(text), F.lower(F.lit(term)))
        return text.ilike(f"%{term}%")

    def held(term: str) -> Column:
        return F.exists(column, lambda p: like(p, term))

    return reduce(lambda a, b: a | b, map(held, terms))


def predicate(spec: SearchSpec) -> Column:
    """All filters of a search in one condition, for Spark to push down."""
    source = spec.fonte or fixed.DEFAULT_SOURCE
    parts = [F.col("fonte") == source, ~F.col("anulada")]
    known = fixed.SOURCE_FILTERS.get(source, ()) + ("area",) + (("tipo",) if not spec.sampling or source == "ENEM" else ())
    parts += [F.col(k) == v for k, v in spec.filters.items() if k in known and v not in (None, "", 0)]
    if spec.ids:
        parts.append(F.col("id").isin(*spec.ids))
    if "ano" in known:
        parts += years(F.col("ano"), spec.year_from, spec.year_to)
    terms = tuple(t.strip() for t in spec.terms if t.strip())
    if terms:
        parts.append(term_predicate(F.col("enunciado"), terms, spec.escape) | reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower("comando"), F.lower(F.lit(t))) if spec.escape else F.col("comando").ilike(f"%{t}%"), F.lit(False)) for t in terms]))
    return reduce(lambda a, b: a & b, parts)


def among(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Questions whose id is in a table of ids; repeated ids count once."""
    return questions.join(ids.select("id").distinct(), "id", "left_semi")


def labelled(rows: DataFrame, labels: DataFrame, code: str, label: str) -> DataFrame:
    """The label of a code (labels from schemas.dimension), or the code itself where it has none."""
    return rows.join(labels, code, "left").withColumn(label, F.coalesce(label, code))


def file_order(questions: DataFrame, dia: str) -> DataFrame:
    """The questions of one day with lugar, their place by number as in the files, from 1; equal numbers by id."""
    rows = ranks.ordered(questions.where(F.col("dia") == dia), [F.col("numero").asc_nulls_last(), F.col("id").asc()], "lugar")
    return rows.withColumn("lugar", F.col("lugar") + 1)


def list_order() -> list[Column]:
    """O1: newest year first, undated ones before, then by number; ids break ties."""
    return [F.col("ano").desc_nulls_first(), F.col("numero").asc_nulls_last(), F.col("id").asc()]


def search(questions: DataFrame, spec: SearchSpec) -> DataFrame:
    """One page of what a search finds; Spark takes it from the top of each task."""
    found = questions.where(predicate(spec)).orderBy(*list_order())
    skip = max(spec.page - 1, 0) * spec.page_size
    return (found.offset(skip) if skip else found).limit(spec.page_size)


def page_counts(questions: DataFrame, by: str, page_size: int = fixed.PAGE_SIZE) -> DataFrame:
    """A2, O3: rows and pages for each value of a facet, without voided questions."""
    return questions.where("not anulada").groupBy(by).agg(F.count("*").alias("total")).withColumn("paginas", F.ceil(F.col("total") / page_size).cast("long"))


def with_badges(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Whether the user got the question right, by year, day and number; the latest answer tells. Undated ones match undated."""
    last = answers.groupBy("ano", "dia", "numero").agg(F.max_by("acertou", F.struct("respondido_em", "questao_id", "seq")).alias("acertou"))
    on = [questions[c].eqNullSafe(last[c]) for c in ("ano", "dia", "numero")]
    return questions.join(last, on, "left").select(*[questions[c] for c in questions.columns], last["acertou"].alias("badge"))


def facets(questions: DataFrame, columns: tuple[str, ...], by: str = "fonte") -> DataFrame:
    """(by, faceta, valor, total) of every value of every facet, in one pass over the rows; nulls don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("faceta"), F.col(c).cast("string").alias("valor")) for c in columns]))
    return questions.select(by, pairs.alias("f")).where("f.valor is not null").groupBy(by, "f.faceta", "f.valor").agg(F.count("*").alias("total"))


def facet_list(questions: DataFrame, column: str, by: str = "fonte", descending: bool = False) -> DataFrame:
    """The sorted values of a facet for each source."""
    return questions.groupBy(by).agg(F.sort_array(F.collect_set(column), asc=not descending).alias("valores"))


def source_counts(questions: DataFrame) -> DataFrame:
    """Sources with questions that are not void."""
    return questions.where("not anulada").groupBy("fonte").agg(F.count("*").alias("total"))


def neighbours(questions: DataFrame, by: str = "fonte") -> DataFrame:
    """Ids of the questions before and after, by year and number within a source."""
    order = [F.col("ano").asc_nulls_last(), F.col("numero").asc_nulls_last(), F.col("id").asc()]
    along = ranks.ordered(questions.select("id", by, "ano", "numero"), [F.col(by), *order])
    return ranks.beside(along, [by], {"anterior": ("id", -1), "proximo": ("id", 1)}).select("id", by, "anterior", "proximo")


def neighbour_ids(questions: DataFrame, year: int, number: int) -> DataFrame:
    """The same for one place, as two limited lookups with a row predicate."""
    at, here = F.struct("ano", "numero"), F.struct(F.lit(year).alias("ano"), F.lit(number).alias("numero"))
    before = questions.where(at < here).orderBy(F.desc("ano"), F.desc("numero"), F.desc("id")).limit(1).select(F.lit("anterior").alias("lado"), "id")
    after = questions.where(at > here).orderBy("ano", "numero", "id").limit(1).select(F.lit("proximo").alias("lado"), "id")
    return before.union(after)


def list_position(questions: DataFrame, by: str = "fonte") -> DataFrame:
    """Place in the list (newest year first); equal places count together."""
    rows = questions.select("id", by, "ano", "numero")
    return ranks.tied(rows, [by], [F.col("ano").desc_nulls_first(), F.col("numero").asc_nulls_last()], ["ano", "numero"], "posicao").select("id", by, "posicao")


def question(questions: DataFrame, id: int) -> DataFrame:
    """S2."""
    return questions.where(F.col("id") == id).limit(1)


def go_to(questions: DataFrame, text: str) -> DataFrame:
    """P25: the first question of a number; nothing for what is no number."""
    return questions.where(F.col("numero") == F.lit(text).try_cast("int")).orderBy("id").limit(1)


def exam_neighbours(questions: DataFrame, first: str, second: str, by: str = "fonte") -> DataFrame:
    """For each exam (two facets) the one before and after, across values of the first facet."""
    order = Window.partitionBy(by).orderBy(F.col(first).asc_nulls_first(), F.col(second).asc_nulls_first())
    exams = questions.select(by, first, second).distinct()
    pair = F.struct(first, second)
    return exams.select(by, first, second, F.lag(pair).over(order).alias("antes"), F.lead(pair).over(order).alias("depois"))


def latest(rows: DataFrame, order: str, limit: int = 500) -> DataFrame:
    """S3, O2: newest first, up to a limit that the caller names."""
    return rows.orderBy(F.col(order).desc_nulls_first()).limit(limit)


def for_user(rows: DataFrame, user: object) -> DataFrame:
    """A user sees their own rows only."""
    return rows.where(F.col("usuario_id") == F.lit(user))


def placeholder_left(questions: DataFrame, mark: str) -> DataFrame:
    """Questions of which a paragraph still holds a placeholder."""
    return questions.where(F.exists("enunciado", lambda p: F.contains(p, F.lit(mark))))


def with_images(questions: DataFrame) -> DataFrame:
    """P15."""
    return questions.where(F.col("tem_imagem") & (F.size("imagens") > 0))


def unclassified(questions: DataFrame, again: bool = False) -> DataFrame:
    """Questions without a skill, or all of them."""
    return questions.where(F.lit(again) | F.coalesce(F.col("competencia") == "", F.lit(True)))


def spec_from_answer(spec: SearchSpec, termos: list[str], area: str | None, competencia: str | None) -> SearchSpec:
    """L3: what a model's answer adds to a search."""
    return replace(spec, terms=tuple(termos), filters=spec.filters | {"area": area, "competencia": competencia})
