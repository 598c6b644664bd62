"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from certame import fixed

_BLANK = r"[\s ]"


def _first_hit(text: Column, names, fallback: Column | None = None) -> Column:
    out = None
    for part, value in names:
        hit = F.contains(text, F.lit(part))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(fallback) if fallback is not None else out


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def area_of_page(c: Column) -> Column:
    """the first known area name that the page contains."""
    return _first_hit(F.lower(c), fixed.AREA_NAMES)


def normalize_area(c: Column) -> Column:
    """canonical area of a name; null if none is in it."""
    low = F.lower(F.trim(c))
    return F.coalesce(_first_hit(low, fixed.AREA_NAMES), _first_hit(low, [(a.lower(), a) for a in fixed.AREAS]))


def vendor(c: Column) -> Column:
    """F3."""
    return _first_hit(F.lower(c), fixed.VENDORS)


def folder_year(c: Column) -> Column:
    """the first 20xx anywhere."""
    return F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit("")).cast("int")


def paper_year(c: Column) -> Column:
    """four digits at the start, else null."""
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")).cast("int")


def edition(c: Column) -> Column:
    """'2 EDICAO' of '2º ...' as 2_EDICAO."""
    n = F.nullif(F.regexp_extract(c, "(\\d+)[°º]", 1), F.lit(""))
    return F.concat(n, F.lit("_EDICAO"))


def event_code(c: Column) -> Column:
    """SIM_NN from the first number that stands alone; SIM_01 without one."""
    n = F.nullif(F.regexp_extract(c, r"(?U)\b0*(\d+)\b", 1), F.lit("")).cast("int")
    return F.when(c.isNotNull(), F.format_string("SIM_%02d", F.coalesce(n, F.lit(1))))


# How file names tell a day and a kind.


def file_day(c: Column, fixed_zeros: bool = False) -> Column:
    """simu_dia1 or simu_dia2 from a file name.

    'Dia 01' is not told by the rule as it stands; with fixed_zeros leading zeros are read too.
    """
    low, zero = F.lower(c), "0?" if fixed_zeros else ""

    def day(n: int) -> Column:
        return low.rlike(rf"(?U){n}[°º\s]*dia|dia\s*{zero}{n}\b|d[_\-\s]?{zero}{n}\b|{n}[°º\s]*_?dia")

    return F.when(day(1), "simu_dia1").when(day(2), "simu_dia2")


def file_kind(c: Column) -> Column:
    """gabarito (which goes first) or prova from a file name."""
    low = F.lower(c)
    return F.when(low.rlike(r"(?U)\bgab\b|gabarito|resolu[cç]"), "gabarito").when(low.rlike(r"(?U)\bprova\b|simu|sim[_\s]?\d|\bdia\b|poliedro|somos|sas|berno|farias"), "prova")


def skill_in(c: Column) -> Column:
    """F8: the first of H00 to H30 that stands alone in any case."""
    return F.nullif(F.regexp_extract(F.upper(c), r"(?U)\b(H(?:[0-2]\d|30))\b", 1), F.lit(""))


def skill_code(c: Column) -> Column:
    """the text itself if it is H and two digits."""
    return F.when(c.rlike(r"^H\d{2}$"), c)


def squeeze(c: Column) -> Column:
    """runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{_BLANK}+", " "))


def strip(c: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def split_clean(c: Column, pattern: str) -> Column:
    """Parts between matches of a pattern, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """between blank lines."""
    return split_clean(c, "\n\n")


def ocr_paragraphs(c: Column) -> Column:
    """between double spaces; the whole text if that leaves none."""
    found = split_clean(c, "  ")
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def search_terms(c: Column) -> Column:
    """between commas."""
    return split_clean(c, ",")


def is_citation(c: Column) -> Column:
    """F16: a short line that names a source."""
    return (F.length(c) < 220) & c.rlike(r"^(Disponível|[A-Z][A-Z]+,\s|[A-Z][a-z]+,\s[A-Z]\.|Acesso em|Fonte:|Adaptado)")


def is_citation_loose(c: Column) -> Column:
    """the exam player's rule."""
    named = c.rlike(r"^(Disponível|[A-Z][A-Z]+,\s|https?:|www\.|BRASIL\.|Fonte:|In:|apud)")
    return named | ((F.length(c) < 60) & c.rlike(r"^[0-9A-Za-z_]") & F.contains(c, F.lit(".")))


MATH = r"(\$\$[\s\S]+?\$\$|(?<![A-Za-z0-9])\$[^$\n]+?\$)"


def math_tokens(c: Column) -> Column:
    """$$...$$ and $...$; a dollar after a letter or digit is money."""
    return F.regexp_extract_all(c, F.lit(MATH), F.lit(1))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_text(c: Column) -> Column:
    """escaped, with line ends as breaks."""
    return F.replace(escape_html(c), F.lit("\n"), F.lit("<br />"))


def _shifted(c: Column, table: tuple[str, str]) -> Column:
    plain, moved = table
    capital = [(a.upper(), b) for a, b in zip(plain, moved, strict=True) if a.isalpha()]
    return F.translate(c, plain + "".join(a for a, _ in capital), moved + "".join(b for _, b in capital))


def _all_in(c: Column, table: tuple[str, str]) -> Column:
    letters = "".join(x for x in table[0] if x.isalnum())
    return c.rlike(rf"(?i)^[\s{letters}+\-=()]*$")


def raised(c: Column) -> Column:
    """characters with a raised form take it, others stay."""
    return _shifted(c, fixed.RAISED)


def lowered(c: Column) -> Column:
    return _shifted(c, fixed.LOWERED)


def raise_or_latex(c: Column) -> Column:
    """raised if every character can be, else as LaTeX."""
    return F.when(_all_in(c, fixed.RAISED), raised(c)).otherwise(F.concat(F.lit("$^{"), c, F.lit("}$")))


def lower_or_latex(c: Column) -> Column:
    return F.when(_all_in(c, fixed.LOWERED), lowered(c)).otherwise(F.concat(F.lit("$_{"), c, F.lit("}$")))


def zero_pad(c: Column, width: int) -> Column:
    """longer numbers stay whole."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def paper_url(base: Column, path: Column, page: Column) -> Column:
    """pages count from 0 in the table and from 1 in the address."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), path, F.coalesce(F.concat(F.lit("#page="), (page + 1).cast("string")), F.lit("")))


def image_path(source: Column, first: Column, second: Column, name: Column) -> Column:
    """the national exam's images lie under its facets, all others under exato, lower-cased."""
    return F.when(source == "ENEM", F.concat_ws("/", first, second, name)).otherwise(F.concat_ws("/", F.lit("exato"), F.lower(first), F.lower(second), name))


def strip_nul(c: Column) -> Column:
    """F23."""
    return F.replace(c, F.lit("\0"), F.lit(""))


def year_of_file(c: Column) -> Column:
    """of .../enem_2019.json."""
    return F.nullif(F.regexp_extract(c, r"enem_(\d+)[^/]*$", 1), F.lit("")).cast("int")


def initials(mail: Column) -> Column:
    """F25."""
    return F.upper(F.substring(mail, 1, 2))


def local_part(mail: Column) -> Column:
    return F.split_part(mail, F.lit("@"), F.lit(1))


def data_uri(c: Column) -> Column:
    """mime type and bytes of data:mime;base64,..."""
    head = F.split_part(c, F.lit(","), F.lit(1))
    mime = F.split_part(F.split_part(head, F.lit(";"), F.lit(1)), F.lit(":"), F.lit(2))
    return F.when(F.contains(c, F.lit(",")), F.struct(mime.alias("mime"), F.unbase64(F.split_part(c, F.lit(","), F.lit(2))).alias("content")))


def query_string(params: Column) -> Column:
    """of a map, in the order of its keys, without null and empty values."""
    kept = F.map_entries(F.map_filter(params, lambda k, v: F.coalesce(v, F.lit("")) != ""))
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def enough_text(c: Column, least: int = 150) -> Column:
    """P23."""
    return F.length(strip(c)) >= least


def prompt(area: Column, stem: Column, task: Column, skills: dict[str, str]) -> Column:
    """asks for one skill code; the stem's and the task's beginnings are quoted."""
    listed = "\n".join(f"{k}: {v}" for k, v in skills.items())
    return F.concat(
        F.lit("Classifique a questão com UMA habilidade.\n\nÁrea: "), F.coalesce(area, F.lit("")),
        F.lit("\nEnunciado: "), F.substring(F.array_join(stem, " "), 1, 600), F.lit("\nComando: "), F.substring(F.coalesce(task, F.lit("")), 1, 200),
        F.lit(f"\n\nHabilidades:\n{listed}\n\nResponda APENAS com o código."),
    )


def explain_prompt(ano: Column, numero: Column, stem: Column, task: Column, options: Column, key: Column) -> Column:
    """Asks for the reasoning behind a key; its parts are titled, the request stands last."""
    from certame.functions.arrays import option_lines

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = {"Letra do gabarito": text(key), "Pergunta": text(task), "Opções": text(option_lines(options)), "Textos de apoio": F.array_join(stem, "\n"), "Origem": F.concat(F.lit("ENEM "), text(ano), F.lit(" nº "), text(numero))}
    titled = [x for title, part in parts.items() for x in (F.lit(f"## {title}\n"), part, F.lit("\n"))]
    return F.concat(*titled, F.lit("## Tarefa\nMostre o raciocínio que leva à letra do gabarito; em seguida aponte, letra a letra, o engano de cada outra opção. Escreva para um aluno do ensino médio."))


def search_prompt(asked: Column, areas: tuple[str, ...]) -> Column:
    """Asks for a filter as JSON (skill, area, terms); null for an empty question."""
    listed = " | ".join(f'"{a}"' for a in areas)
    told = F.concat(
        F.lit(f"Traduza um pedido de estudo em filtro de busca. A saída é um único objeto JSON com três campos.\n- competencia: null ou um código entre H01 e H30\n- area: null ou {listed}\n- termos: lista com no máximo três palavras que apareceriam na questão\n"),
        F.lit('Pedido: "'), strip(asked), F.lit('"'),
    )
    return F.when(strip(asked) != "", told)


def json_object(c: Column) -> Column:
    """from the first { to the last }."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def search_answer(c: Column, asked: Column) -> Column:
    """terms (at most three, the query itself without any), a known area, and a skill code."""
    got = F.from_json(c, "termos array<string>, area string, competencia string")
    terms = F.filter(F.transform(F.slice(got["termos"], 1, 3), strip), lambda x: x != "")
    return F.struct(
        F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, terms).otherwise(F.array(strip(asked))).alias("termos"),
        F.when(got["area"].isin(*fixed.AREAS), got["area"]).alias("area"),
        skill_code(got["competencia"]).alias("competencia"),
    )


def sse_text(chunks: Column) -> Column:
    """What a stream of server-sent events says, from its chunks in order; ends at [DONE], skips lines that hold no data."""
    lines = F.filter(F.split(F.array_join(chunks, ""), "\n"), lambda x: x.startswith("data: "))
    said = F.transform(lines, lambda x: F.trim(F.substring(x, 7, 1 << 30)))
    done = F.array_position(said, "[DONE]")
    said = F.when(done > 0, F.slice(said, F.lit(1), (done - 1).cast("int"))).otherwise(said)
    parts = F.transform(said, lambda x: F.get_json_object(x, "$.choices[0].delta.content"))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "")
