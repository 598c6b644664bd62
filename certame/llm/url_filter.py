"""URL verdicts by rules, and for the rest by trust and distrust that spread over links between hosts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certame.llm.storage import staged

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
DAMPING = 0.85
#: Steps between two written states, the mass that may still be to move at the end, and the steps after which that is an error.
STRIDE, TOLERANCE, MOST_STEPS = 8, 1e-6, 1000
#: A host is blocked where distrust is more than this share of trust and distrust.
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does; of equals the first."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (text, verdict) if text is not None else (F.lit(None).cast("string"),) * 2


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = MOST_STEPS) -> DataFrame:
    """Personalised PageRank by power iteration, for all kinds of seeds at once.

    edges (kind, a, b, w): of what a has, the share w goes to b; seeds (kind, node, s); no node is "".
    Returns (kind, node, s) with s = (1 - damping) * seed + damping * what comes in. Nodes without
    edges out keep nothing for others. Every STRIDE steps the state is written, which cuts the lineage, and compared with
    the state before: what is still to come is at most damping**STRIDE / (1 - damping**STRIDE) of the change, as no step
    adds mass. The iteration ends when that is below `tolerance` (summed over all nodes and kinds), and fails if `most` steps don't get there.
    Shares are summed before they move; a hub's many edges are one side of a join whose other side has a row for each node, so Spark splits them.
    """
    root = F.lit("")  # a node that keeps its own mass of 1 and gives every seed its part, so that a step is one join and one sum
    kinds = seeds.select("kind").distinct()
    entry = seeds.select("kind", root.alias("a"), F.col("node").alias("b"), (F.col("s") * (1 - damping) / damping).alias("w"))
    links = staged(edges.select("kind", "a", "b", "w").union(entry).union(kinds.select("kind", root, root, F.lit(1 / damping))), "links")
    now, left = kinds.select("kind", root.alias("node"), F.lit(1.0).alias("s")), damping**STRIDE / (1 - damping**STRIDE)
    for _ in range(0, most, STRIDE):
        after = now
        for _ in range(STRIDE):
            after = after.withColumnRenamed("node", "a").join(links, ["kind", "a"]).groupBy("kind", F.col("b").alias("node")).agg((F.sum(F.col("s") * F.col("w")) * damping).alias("s"))
        after = staged(after, "spread")
        change = after.join(now.withColumnRenamed("s", "old"), ["kind", "node"], "left").agg(F.sum(F.abs(F.col("s") - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        now = after
        if change * left < tolerance:
            return now.where("node <> ''")
    raise RuntimeError(f"trust and distrust did not settle within {most} steps: {change * left} is left, {tolerance} is allowed")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """A verdict for every row of pages (page_id, url, html).

    The longest fitting rule decides. Where none fits, the host's trust and distrust do: trust starts at the hosts of
    allowed pages (by their share of these pages) and follows links between hosts, distrust starts at the hosts of
    blocked pages (by theirs) and goes back along links, to those who link there; each adds up to 1 at most. A host is blocked where
    distrust makes up more than `threshold` of both; one that neither reaches is allowed. Null urls
    and urls without :// have an empty host and path and are allowed; null html has no links, long html is searched whole.
    Repeated rows are judged each, and count each as seeds; equal trust and distrust allow. An empty table gives no rows; other columns,
    whatever their names, are left aside. Returns page_id, host, path, rule, verdict, trust, distrust.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    hosts = rows.where("said is not null and host <> ''").groupBy("host", "said").agg(F.count("*").alias("n"))
    # each kind of seed is a distribution of its own, whichever has more pages
    ruled = {r.said: r.n for r in hosts.groupBy("said").agg(F.sum("n").alias("n")).collect()}
    of_kind = F.when(F.col("said") == "allow", float(ruled.get("allow", 1))).otherwise(float(ruled.get("block", 1)))
    seeds = hosts.select(F.col("said").alias("kind"), F.col("host").alias("node"), (F.col("n") / of_kind).alias("s"))
    links = (
        rows.where("host <> '' and html is not null")
        .select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
        .select("host", F.translate("to", UPPER, SMALL).alias("to"))
        .where("host <> to")
        .groupBy("host", "to")
        .agg(F.count("*").alias("n"))
    )
    links = staged(links, "links")
    if links.isEmpty():
        scores = seeds.withColumn("s", F.col("s") * (1 - damping))
    else:
        out = links.groupBy("host").agg(F.sum("n").alias("all"))
        into = links.groupBy("to").agg(F.sum("n").alias("all"))
        forward = links.join(out, "host").select(F.lit("allow").alias("kind"), F.col("host").alias("a"), F.col("to").alias("b"), (F.col("n") / F.col("all")).alias("w"))
        back = links.join(into, "to").select(F.lit("block").alias("kind"), F.col("to").alias("a"), F.col("host").alias("b"), (F.col("n") / F.col("all")).alias("w"))
        scores = spread(staged(forward.union(back), "edges"), seeds, damping, tolerance)
    by_host = scores.groupBy(F.col("node").alias("host")).agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("s")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "block", F.col("s")).otherwise(0.0)).alias("distrust")
    )
    by_host = staged(by_host, "hosts")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > (trust + distrust) * threshold, "block").otherwise("allow")
    return rows.drop("html").join(by_host, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
