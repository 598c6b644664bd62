"""Secrets in texts: three plain patterns, and character Markov models that tell random strings from identifiers.

Everything is DataFrame expressions; a row's spans are found within the row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""{KEYWORD}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of [0-9a-f]+ or AKIA[A-Z0-9]+ takes its whole run, so asking for the length at once finds the same.
HEX = "[0-9a-f]{32,}"
ACCESS = "AKIA[A-Z0-9]{12,}"
#: Kinds in the order in which they are listed at one start.
KINDS = ("assign", "access", "hex", "markov")
SHORTEST_VALUE = 8

#: Characters of strings that the models judge, and the shortest such string.
TOKEN = "[A-Za-z0-9+/_.=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SHORTEST = 16
#: Stands before a string's first character.
START = "^"
#: Documents that the ordinary side is fitted on, at most: those whose hashed doc_id is smallest.
TRAIN_ROWS = 400
#: Random strings of each alphabet that are made for the random side.
RANDOM_ROWS = 400
#: Length of the rulers.
RULER = 4000
SMOOTH = 0.5
#: Thousandths of a nat for each character, from which a string counts as random.
LEAST_RATIO = 1000
#: Positions of the table: the codes from + to z.
FIRST, WIDTH = ord("+"), ord("z") - ord("+") + 1
#: Spans whose places are summed at a time.
CHUNK = 512


def assigned(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))


def labelled_samples(docs: DataFrame, rows: int = TRAIN_ROWS, random_rows: int = RANDOM_ROWS) -> DataFrame:
    """(token, random) to train on, from at most `rows` rows of docs (doc_id, text) and strings made from hashes.

    Random: values that the plain patterns find, and SHA-256 digests written in six alphabets. Ordinary: strings of four or more
    characters outside of those finds, each document's words joined as identifiers are (camel case with numbers, constants, five marks), numbers, dates, and rulers of one character.
    """
    numbered = docs.where("doc_id is not null").select("doc_id", "text")
    share = min(1.0, 8.0 * rows / max(numbered.count(), 1))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))  # few rows meet in the one task that picks the smallest
    chosen = numbered.select("doc_id").where(part).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = numbered.join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"))
    found = F.concat(F.filter(assigned(F.col("text")), lambda v: F.length(v) >= SHORTEST_VALUE), *[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (HEX, ACCESS)])
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " "), ACCESS, " ")
    words = F.regexp_extract_all(plain, F.lit("[A-Za-z]+"), F.lit(0))
    camel = F.array_join(F.transform(words, lambda w, i: F.concat(F.initcap(w), F.when(i % 5 == 0, (i % 100).cast("string")).otherwise(""))), "")
    joined = [camel, F.upper(F.array_join(words, "_")), *[F.array_join(words, mark) for mark in "_./-="]]
    ordinary = F.concat(F.regexp_extract_all(plain, F.lit(TOKEN + "{4,}"), F.lit(0)), F.array(*joined))
    ours = texts.select(F.explode(found).alias("token"), F.lit(True).alias("random")).unionByName(texts.select(F.explode(ordinary).alias("token"), F.lit(False).alias("random")))
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    sixty_four = F.base64(F.unhex(digest))
    letters = F.regexp_replace(sixty_four, "[+/=]", "")
    alphabets = [digest, F.upper(digest), F.regexp_replace(sixty_four, "=", ""), letters, F.upper(letters), F.lower(letters)]
    made = docs.sparkSession.range(random_rows)
    day = F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(1 << 31)))
    numbers = [F.regexp_replace(F.xxhash64("id", F.lit(k)).cast("string"), "-", "") for k in range(4)]
    dates = [F.date_format(day, form) for form in ("yyyy-MM-dd.HH.mm.ss", "dd.MM.yyyy", "yyyy/MM/dd/HHmm")]
    rulers = docs.sparkSession.range(len(ALPHABET)).select(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)).alias("c")).select(F.repeat("c", F.lit(RULER)).alias("token"))
    told = lambda df, random: df.withColumn("random", F.lit(random))
    parts = [told(made.select(F.explode(F.array(*alphabets)).alias("token")), True), told(made.select(F.explode(F.array(*numbers, *dates)).alias("token")), False), told(rulers, False)]
    return reduce(DataFrame.unionByName, parts, ours)


@dataclass(frozen=True)
class RatioModel:
    """Log of the chance of each character after another in random strings, against that in ordinary ones, in thousandths of a nat."""

    table: tuple[int, ...]

    def column(self) -> Column:
        """The table as one constant."""
        return F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<int>")


def train(samples: DataFrame) -> RatioModel:
    """Fits both models on labelled strings (token, random). Only counts of pairs of characters reach the driver: 2 x 69 x 68 at most."""
    pairs = F.regexp_extract_all(F.concat(F.lit(START), "token"), F.lit(rf"(?=([{re_class(START)}{re_class(ALPHABET)}][{re_class(ALPHABET)}]))"), F.lit(1))
    rows = samples.where("token is not null and random is not null").select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    counts = {(r["random"], r["pair"]): r["count"] for r in rows}
    table = [0] * (WIDTH * WIDTH)
    for a in START + ALPHABET:
        total = {kind: sum(counts.get((kind, a + b), 0) for b in ALPHABET) + SMOOTH * len(ALPHABET) for kind in (True, False)}
        for b in ALPHABET:
            chance = {kind: (counts.get((kind, a + b), 0) + SMOOTH) / total[kind] for kind in (True, False)}
            table[(ord(a) - FIRST) * WIDTH + ord(b) - FIRST] = round(1000 * math.log(chance[True] / chance[False]))
    return RatioModel(tuple(table))


def re_class(characters: str) -> str:
    """Characters as the inside of a pattern's class."""
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in characters)


def log_ratio(token: Column, model: RatioModel) -> Column:
    """Sum of the model's logs over a string's characters, in pieces of 1,024 that share a character, so that a very long one needs no long array."""
    pieces = F.regexp_extract_all(F.concat(F.lit(START), token), F.lit("(?s)(?=(.{1,1025})).{1,1024}"), F.lit(1))

    def of_pair(pair: Column) -> Column:
        return F.get(model.column(), (F.ascii(pair) - FIRST) * WIDTH + F.ascii(F.substring(pair, 2, 1)) - FIRST).cast("long")

    def of_piece(piece: Column) -> Column:
        return F.aggregate(F.regexp_extract_all(piece, F.lit("(?s)(?=(..))"), F.lit(1)), F.lit(0).cast("long"), lambda sum, pair: sum + of_pair(pair))

    return F.aggregate(pieces, F.lit(0).cast("long"), lambda sum, piece: sum + of_piece(piece))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often, and in whatever lambda, body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(steps: Column) -> Column:
    """Sums of an array up to each element: those of CHUNK elements at a time, from the sum of the chunks before."""
    zero = F.lit(0)

    def summed(steps: Column) -> Column:
        chunk = lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK))
        total = lambda array: F.aggregate(array, zero, lambda a, b: a + b)
        within = lambda start, c: F.slice(F.aggregate(chunk(c), F.array(start), lambda sums, step: F.concat(sums, F.array(F.element_at(sums, -1) + step))), F.lit(2), F.lit(CHUNK))
        totals = F.transform(F.sequence(zero, F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: total(chunk(c)))
        return let(totals, lambda totals: F.flatten(F.transform(F.transform(totals, lambda _, c: total(F.slice(totals, F.lit(1), c))), within)))

    return F.when(F.size(steps) > 0, let(steps, summed)).otherwise(F.array().cast("array<int>"))


def places(text: Column, pattern: str) -> Column:
    """(start, end, token, value) of each leftmost match of the pattern, in code points; value is ASSIGN's group, else all of the match.

    The text falls into matches and what lies between them; their lengths add up to the places.
    """
    found = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.struct(found(0).alias("token"), found(int(pattern == ASSIGN)).alias("value"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"))

    def spans(p: Column) -> Column:
        ends = running_sums(F.transform(p["token"], lambda m, i: F.get(p["gap"], i) + F.length(m)))
        one = lambda ends: lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("token"), F.get(p["value"], i).alias("value"))
        return let(ends, lambda ends: F.transform(p["token"], one(ends)))

    none = F.array().cast("array<struct<start:int,end:int,token:string,value:string>>")
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none)


def find_secrets(docs: DataFrame, model: RatioModel, least_ratio: int = LEAST_RATIO) -> DataFrame:
    """(doc_id, found) of each row of docs (doc_id, text): found lists (kind, start, end, value, ratio) by start, then kind.

    Kinds: assign (a value of 8 or more characters after a keyword), access (key ids), hex (32 or more digits), and markov: runs of 16 or more token characters
    whose log-likelihood ratio of random against ordinary is at least least_ratio thousandths of a nat a character, unless a plain find lies in them or
    they are one's value. Places count code points, end exclusive; ratio is null for the plain kinds. Null text is empty and finds nothing. Rows that repeat, or
    have no doc_id, are judged each. Very long texts and strings are read whole. Other columns are left alone; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = f"{TOKEN}{{{SHORTEST},}}"
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": f"{ASSIGN}|{run}"}
    rows = rows.select("doc_id", *[places(F.col("text"), pattern).alias(kind) for kind, pattern in patterns.items()])
    plain = lambda s: s["token"].rlike(f"{HEX}|{ACCESS}|{KEYWORD}[\"']?\\x20*[:=]\\x20*[\"']?{TOKEN}{{{SHORTEST_VALUE},}}")
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= SHORTEST_VALUE))
    rows = rows.withColumn("markov", F.filter("markov", lambda s: s["token"].rlike(f"^{run}$") & ~plain(s)))
    rows = rows.withColumn("markov", F.transform("markov", lambda s: s.withField("ratio", F.floor(log_ratio(s["token"], model) / F.length(s["token"])).cast("int"))))
    rows = rows.withColumn("markov", F.filter("markov", lambda s: s["ratio"] >= least_ratio))

    def listed(k: int, kind: str) -> Column:
        ratio = (lambda s: s["ratio"]) if kind == "markov" else (lambda s: F.lit(None).cast("int"))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), ratio(s).alias("ratio")))

    found = F.sort_array(F.concat(*[listed(k, kind) for k, kind in enumerate(KINDS)]))
    return rows.select("doc_id", F.transform(found, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value", "ratio")])).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets()'s rows: n_assign, n_access, n_hex, n_markov, base_sha256 of the plain finds and spans of all, as kind:start:end."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *map(of_kind, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
