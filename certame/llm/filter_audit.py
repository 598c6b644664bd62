"""How filters of a corpus interact: survivors of every subset of them, and from these every order's steps."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certame.llm.storage import staged

WORD = r"[^\x20\x09-\x0D]+"
#: The filters by letter; filter k is bit k of a document's mask of failures.
LETTERS = "ABCDE"
FULL = (1 << len(LETTERS)) - 1
#: In how many orders of all filters exactly these k stand before a given one: k! * (4 - k)!.
ORDERS_BEFORE = (24, 6, 4, 6, 24)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each row of docs (doc_id, text, source): which of A to D it fails, and its text's SHA-256."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, text = F.size("words").cast("long"), F.col("text")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    tests = (n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n, 100 * capitals > 2 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, all and labelled ones.

    E is failed by a row whose text also stands under a smaller doc_id. A doc_id is good (toxic) if any of its labels says so.
    """
    rows = staged(failures(docs), "failures")
    named = rows.where("doc_id is not null")
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    cell = ["digest", "part", "mask", "good", "toxic"]
    by_id = named.join(told, "doc_id", "left").groupBy("doc_id", *cell).agg(F.count("*").alias("n"))
    # copies of one text meet as a row for each part and label, before they move
    cells = by_id.groupBy(*cell).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("lead"))
    first = F.min("lead.doc_id").over(Window.partitionBy("digest"))
    alone = F.when(F.col("lead.doc_id") == F.col("first"), F.col("lead.n")).otherwise(0)
    both = F.array(F.struct("mask", alone.alias("n")), F.struct((F.col("mask") + (1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - alone).alias("n")))
    split = cells.withColumn("first", first).select("part", "good", "toxic", F.inline(both))
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"), "mask", "n")
    of = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label)
    return split.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def subset_sums(cells: str) -> Column:
    """The zeta transform: of an array by mask, at each mask the sum over all its subsets; a round for each filter."""
    return F.expr(f"aggregate(sequence(0, {len(LETTERS) - 1}), {cells}, (sums, bit) -> transform(sums, (x, i) -> x + if((i & shiftleft(1, bit)) <> 0, get(sums, i ^ shiftleft(1, bit)), 0L)))")


def survivors(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic) from mask_counts(): arrays with, at each set of filters, the documents that pass all of the set.

    Those fail a subset of the other filters only, so they are the subset sum at the set's complement.
    """
    kinds = ("n", "good", "toxic")
    gathered = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*kinds)))).alias("cells"))
    filled = gathered.select("part", *[F.expr(f"transform(sequence(0, {FULL}), m -> coalesce(cells[m].{k}, 0L))").alias(k) for k in kinds])
    summed = filled.select("part", *[subset_sums(k).alias(k) for k in kinds])
    return summed.select("part", *[F.reverse(k).alias(k) for k in kinds])


def steps(passed: DataFrame) -> DataFrame:
    """Every step of every order of the filters, from survivors(): a step is the difference of two neighbouring subsets.

    kept after it, removed here, redundant (failing, but gone before), unique_fails (failing nothing else), good_lost and toxic_lost; shapley
    sums what the step's filter removes over all orders.
    """
    orders = ["".join(p) for p in permutations(LETTERS)]
    rows = passed.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    head = F.expr("substring(filter_order, 1, step - 1)")
    rows = rows.withColumn("before", sum((F.when(F.contains(head, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(LETTERS)), F.lit(0)))
    rows = rows.withColumn("own", F.expr(f"shiftleft(1, instr('{LETTERS}', substring(filter_order, step, 1)) - 1)"))
    weights = ", ".join(f"{n}L" for n in ORDERS_BEFORE)
    shapley = f"aggregate(filter(sequence(0, {FULL}), s -> (s & own) = 0), 0L, (sum, s) -> sum + get(array({weights}), bit_count(s)) * (get(n, s) - get(n, s | own)))"
    lost = lambda of: f"get({of}, before) - get({of}, before | own)"
    return rows.select(
        "part", "filter_order", "step", F.expr("get(n, before | own)").alias("kept"), F.expr(lost("n")).alias("removed"),
        F.expr(f"get(n, 0) - get(n, own) - ({lost('n')})").alias("redundant"), F.expr(f"get(n, {FULL} ^ own) - get(n, {FULL})").alias("unique_fails"),
        F.expr(lost("good")).alias("good_lost"), F.expr(lost("toxic")).alias("toxic_lost"), F.expr(shapley).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order of five filters does in each part (source) of docs (doc_id, text, source).

    Texts are read once, for a mask and a digest a row; from there on sums move. A text with very many copies is summed by part and label
    before its copies meet. Null text is empty (fails A), null source is the part ''; a row without a doc_id has no
    smaller one, no label, and counts in its part. Rows that share a doc_id count each and are no copies of each other. Very long
    texts are read whole. Equal texts are told by SHA-256. An empty table gives no rows; other columns are left alone.
    """
    return steps(survivors(mask_counts(docs, labels)))


#: The same for DuckDB: every order's steps counted from the documents' masks, without subset sums.
SQL = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
lab AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT w.doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN lab USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(string_split('{"".join(LETTERS)}', '')) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(list_aggregate(list_sort(list_distinct([a.x, b.x, c.x, d.x, e.x])), 'string_agg', '')) = 5),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, n, good, toxic, fails, contains(fails, substr(filter_order, step, 1)) AS failing,
    translate(fails, substr(filter_order, 1, step - 1), '') <> fails AS gone FROM c, orders, range(1, 6) r(step)),
t AS (SELECT part, filter_order, step::INTEGER AS step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM t"""
