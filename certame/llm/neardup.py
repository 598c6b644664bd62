"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certame.llm.components import components
from certame.llm.kernels import SMALL_SLICE, list_array, set_digest, shingle_sets, text_slices, word_hashes
from certame.llm.storage import drop_shuffles, staged

WIDTH = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
SKETCH = 64
#: Of two sketches of 64 values from sets of similarity 0.75, fewer than 28 agree once in over a million pairs.
LEAST_SHARED = 28
#: What a list tells of a member: id, size of its set, how much of it others hold, component.
SIDE = (("rep", ""), ("n_shingles", "_n"), ("common", "_s"), ("component", "_c"))
#: By what a centre is chosen: the values of its sketch, then how little it holds alone, then the smallest id.
CONNECTED = "struct(central, common - n_shingles, -rep)"


def _sketches(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch, data, at in text_slices(batches, most=SMALL_SLICE):
        n, digest, low = [], [], []
        for values in shingle_sets(*word_hashes(data, at), width):
            n.append(len(values))
            digest.append(set_digest(values))
            low.append(values[:size])
        flat = np.concatenate(low).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), list_array(flat, np.append(0, np.cumsum([len(x) for x in low])), pa.int64())], ["doc_id", "n_shingles", "digest", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch, data, at in text_slices(batches, most=SMALL_SLICE):
        low = list(shingle_sets(*word_hashes(data, at), width))
        yield pa.record_batch([batch.column(0), list_array(np.concatenate(low).view(np.int64), np.append(0, np.cumsum([len(x) for x in low])), pa.int64())], ["doc_id", "shingles"])


def sketches(docs: DataFrame, width: int = WIDTH, size: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, and its `size` smallest hashes."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: _sketches(b, width, size), "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _estimate(a, b, size: int):
    """Similarity from two sketches: of the `size` smallest values of their union, the share that both hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _fits(percent: int) -> str:
    """Sizes and shared parts of x and y allow a link."""
    return f"least(x_n, y_n) * 100 >= {percent} * greatest(x_n, y_n) and least(x_s, y_s) * {100 + percent} >= {percent} * (x_n + y_n)"


def _confirmed(pairs: DataFrame, sketch_of: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """The links (a, b) among pairs (x, y): the sketches' estimate filters, the full sets decide."""
    margin = 5 * float(np.sqrt(percent / 100 * (1 - percent / 100) / size))
    likely = (
        pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
        .join(sketch_of.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketch_of.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(_estimate(F.col("sa"), F.col("sb"), size) >= percent / 100 - margin)
        .select("a", "b")
    )
    found = (
        staged(likely, "pairs")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("ha")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("hb")), "b")
        .select("a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("both"), (F.size("ha") + F.size("hb")).cast("long").alias("sum"))
        .where(f"both * 100 >= {percent} * (sum - both)")
        .select("a", "b")
    )
    return staged(found, "links")


def _parted(listed: DataFrame, links: DataFrame | None) -> DataFrame:
    """listed, with the component of each member as the links stand."""
    if links is None:
        return listed.withColumn("component", F.col("rep"))
    labels = components(links).select(F.col("node").alias("rep"), "component")
    return listed.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _open(parted: DataFrame) -> DataFrame:
    """Lists within one component have nothing left to find; the others stay."""
    return parted.join(parted.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value"), "value")


def _beyond_centres(parted: DataFrame, sketch_of: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """Links of whoever is not in a list's largest component with the list's other members.

    Lists whose largest component is the same are one, with that component's most connected
    member c as centre. x and y share at most the smaller of |x & c| and |y & c| within c. Where their
    sizes ask for more, they share a value that c lacks, and meet under it (each side lists its rarest
    such values, as many as a partner can't miss all of); where not, they meet by size. Both bounds hold for full sets and any c.
    """
    need = lambda n, m: F.ceil(percent * (n + m) / (100 + percent))  # noqa: E731  what sets of n and m values share if linked
    top = parted.groupBy("value", "component").agg(F.count("*").alias("n")).groupBy("value").agg(F.max_by("component", F.struct("n", "component")).alias("top"))
    parted = parted.join(top, "value")
    centre = parted.where("component = top").groupBy("top").agg(F.max_by("rep", F.expr(CONNECTED)).alias("c"))
    members = parted.select("top", "rep", "n_shingles", "common", "component").distinct().join(centre, "top")
    held = (
        members.join(sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("h")), "rep")
        .join(sets.select(F.col("doc_id").alias("c"), F.col("shingles").alias("hc")), "c")
        .select("top", "c", "rep", "n_shingles", "common", "component", F.array_except("h", "hc").alias("out"), F.size("hc").cast("long").alias("n_c"))
        .withColumn("inside", F.col("n_shingles") - F.size("out"))
    )
    held = staged(held, "held")
    side = (*SIDE, ("inside", "_i"))
    x, y = ([F.col(c).alias(f"{w}{k}") for c, k in side] for w in "xy")
    apart = F.col("component") != F.col("top")
    across = f"x_c <> y_c and {_fits(percent)}"

    # by size: all that a link needs may lie within the centre
    step = float(np.log(1.05))
    size_bin = lambda n: F.floor(F.log(n) / step).cast("int")
    most = F.floor(F.col("inside") * (100 + percent) / percent) - F.col("n_shingles")
    within = held.where(apart & (most * 100 >= percent * F.col("n_shingles"))).select("top", *x, F.explode(F.sequence(size_bin(F.col("n_shingles") * percent / 100), size_bin(most))).alias("bin"))
    by_size = within.join(held.select("top", *y, size_bin(F.col("n_shingles")).alias("bin")), ["top", "bin"]).where(across).where(f"least(x_i, y_i) * {100 + percent} >= {percent} * (x_n + y_n)")

    # by a value beyond the centre
    beyond = held.select("top", "rep", F.explode("out").alias("value"))
    df = beyond.groupBy("top", "value").agg(F.count("*").alias("df")).where("df > 1")
    least = held.groupBy("top").agg(F.min("n_shingles").alias("least"))
    ranked = (
        beyond.join(df, ["top", "value"])
        .groupBy("top", "rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("met"))
        .join(held.select("top", "rep", "n_shingles", "common", "component", "inside", F.size("out").alias("n_out")), ["top", "rep"])
        .join(least, "top")
        .withColumn("asked", F.greatest(F.lit(1), need(F.col("n_shingles"), F.greatest(F.col("least"), F.ceil(F.col("n_shingles") * percent / 100))) - F.col("inside")))
        # what nobody else of the list holds would take the first places
        .withColumn("slots", F.col("n_out") - F.col("asked") + 1 - (F.col("n_out") - F.size("met")))
        .where("slots > 0")
        .select("top", *[c for c, _ in side], F.size("met").alias("shared"), F.explode(F.expr("slice(met, 1, cast(slots as int))")).alias("v"))
        .withColumn("value", F.col("v.value"))
    )
    ranked = staged(ranked.drop("v"), "beyond")
    by_value = ranked.where(apart).select("top", "value", *x, F.col("shared").alias("x_o")).join(ranked.select("top", "value", *y, F.col("shared").alias("y_o")), ["top", "value"])
    by_value = by_value.where(across).where(f"(least(x_i, y_i) + least(x_o, y_o)) * {100 + percent} >= {percent} * (x_n + y_n)")

    with_centre = held.where(apart & F.expr(f"inside * {100 + percent} >= {percent} * (n_shingles + n_c)")).select(F.col("rep").alias("x"), F.col("c").alias("y"))
    return _confirmed(with_centre.union(by_size.select("x", "y")).union(by_value.select("x", "y")), sketch_of, sets, percent, size)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, size: int = SKETCH, least_shared: int = LEAST_SHARED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents whose sets of `width`-word shingles have 100 * intersection >= percent * union
    are linked; component_id is the smallest doc_id reachable, kept marks it. Words are
    lower-cased (A-Z) and parted by ASCII white space. Fewer words than `width`: the whole
    sequence is the one shingle. No words, or null text: an empty set, linked with
    nothing. Repeated rows with one doc_id get the same result each; a null doc_id takes no part and is left out. Texts of any length are read
    whole; an empty table gives no rows; other columns, whatever their names, are left aside.

    Equal sets meet by their digest. Each other set is listed under the rarest of the values
    in its bottom-k sketch, as many as a true partner can't miss all of; values that one set
    alone holds take their places first, so passages common to many documents list nobody
    unless they make up most of the sketch. Of the listed ones the full sets tell how much nobody else
    holds; who shares too little for a partner of any size drops out. A list's members are compared with its most
    connected one (a star, not all pairs), first in each member's largest list, then in all; found links merge. What then still
    stands across components in a list meets by the values that its largest component's centre lacks (_beyond_centres).
    The sketches' estimate filters, the full sets decide.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull())
    known = staged(sketches(docs, width, size), "sketches")
    classes = known.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = staged(known.join(classes, "digest").where("doc_id = rep").select("rep", "n_shingles", "sketch").dropDuplicates(["rep"]), "reps")

    held = reps.select("rep", F.explode("sketch").alias("value"))
    shared = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # ranks among the values that others hold; those held by one set alone come before them (whole numbers: sums of doubles hang on their order, and copies tie)
    ranked = (
        held.join(shared, "value")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("common"), F.sum(F.round(F.log2("df") * 1e6).cast("long")).alias("central"))
        .join(reps.select("rep", "n_shingles", F.size("sketch").alias("s")), "rep")
        .withColumn("need", F.least(F.ceil(F.col("s") * percent / 100), F.lit(least_shared)))
        .withColumn("slots", F.col("s") - F.col("need") + 1 - (F.col("s") - F.size("common")))
        .where("slots > 0")
    )
    listed = staged(ranked.select("rep", "n_shingles", "central", F.explode(F.expr("slice(common, 1, cast(slots as int))")).alias("v")).select("rep", "n_shingles", "central", F.col("v.value").alias("value")), "lists")
    drop_shuffles(spark)

    # sets of all that are listed anywhere: nothing else can have a partner
    wanted = staged(listed.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    sets = staged(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(lambda b: _sets(b, width), "doc_id long, shingles array<long>"), "sets")
    alone = sets.select("doc_id", F.explode("shingles").alias("value")).groupBy("value").agg(F.count("*").alias("df"), F.min("doc_id").alias("rep")).where("df = 1").groupBy("rep").agg(F.count("*").alias("own"))
    # a document shares at most what is not its own: that must be enough for a partner of its list's smallest size
    listed = listed.join(alone, "rep", "left").withColumn("common", F.col("n_shingles") - F.coalesce("own", F.lit(0))).drop("own").where(f"common * 100 >= {percent} * n_shingles")
    least = listed.groupBy("value").agg(F.min("n_shingles").alias("least"))
    listed = staged(listed.join(least, "value").where(f"common * {100 + percent} >= {percent} * (n_shingles + greatest(least, n_shingles * {percent} / 100.0))").drop("least"), "lists")
    # a passage puts the same members under each of its values: one of these lists is enough
    marks = listed.groupBy("value").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("m1"), F.expr("bit_xor(xxhash64(rep, 1))").alias("m2")).where("n > 1")
    listed = staged(listed.join(marks.groupBy("n", "m1", "m2").agg(F.min("value").alias("value")).select("value", F.col("n").alias("members")), "value"), "lists")
    drop_shuffles(spark)

    sketch_of = reps.select(F.col("rep"), F.col("sketch"))
    links = None
    for own_only in (True, False):
        parted = _parted(listed, links)
        if own_only:  # the largest list of each member alone: a large group becomes one star, and the next step passes it over
            parted = parted.groupBy("rep").agg(F.max_by(F.struct(*parted.columns), F.struct("members", "value")).alias("l")).select("l.*")
        parted = staged(_open(parted), "parted")
        if parted.isEmpty():
            continue
        x = parted.select("value", *[F.col(c).alias(f"x{k}") for c, k in SIDE])
        one = F.struct(*[F.col(c).alias(f"y{k}") for c, k in SIDE])
        centre = parted.groupBy("value").agg(F.max_by(one, F.expr(CONNECTED)).alias("c")).select("value", "c.*")
        found = _confirmed(x.join(centre, "value").where("x_c <> y_c").where(_fits(percent)), sketch_of, sets, percent, size)
        links = found if links is None else links.union(found)
        drop_shuffles(spark)
    if links is not None:
        left = staged(_open(_parted(listed, links)), "parted")
        if not left.isEmpty():
            links = links.union(_beyond_centres(left, sketch_of, sets, percent, size))

    member = known.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    if links is not None:
        member = member.join(components(links).select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    return member.select("doc_id", "n_shingles", F.col("rep").alias("component_id"), (F.col("doc_id") == F.col("rep")).alias("kept"))
