"""URL filters: rules first, then trust and distrust over the graph of hosts.

Pages that a rule fits have its verdict. For the others, hosts where rules
mostly allow pages are trusted seeds and hosts where rules block most pages are
blocked seeds. Personalised PageRank carries trust along links, and distrust
against them, over the edges between hosts. Distrust is divided among all hosts
that link to a blocked one; risk goes the same way undivided, by the share of a
host's own links, so that the many linkers of a popular bad host have it too. A
host is blocked when its distrust or risk reaches a threshold and exceeds its trust.

Every seed starts with a mass of one, and scores are in units of that mass: what
a host has from the seeds near it does not change with the number of others, as
it would if the seeds shared one unit. Rounds go on until all that can still come
to any host is under ``TOLERANCE``. Trust and distrust are divided, so what moves
shrinks by the damping in each round, and its sum bounds what one host can get;
risk comes to a host by the shares of its own links, which sum to one, so there
the largest arrival shrinks by the damping and is the bound. A host with one
link to each of many that have little is reached like any other.

Pages are reduced to hosts and edges are summed before they are shuffled, so
a host with a third of all pages is a few partial sums, and the join that
brings verdicts back moves only narrow rows, which Spark splits when skewed.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; a null html has no links; links to the own
host do not count; without any link only the seeds have scores; repeated rows
are judged one by one; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steppe.llm.shared import materialize

#: (rule, verdict): what stands before the first slash is the host.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DAMPING, THRESHOLD = 0.85, 0.05
#: What may still be missing from a score when rounds end: so little that other seeds, with which rounds go on longer, don't show in it.
TOLERANCE = 2e-7
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, or null. ``rules`` is a short list of literals."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    found = F.lit(None).cast("string")
    for name, verdict in rules:
        found = F.when(rule == name, F.lit(verdict)).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: source, target, links."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?(https?://[^"'\s>]+)"""), F.lit(1))
    ends = pages.select(host_of(F.col("url")).alias("source"), F.explode(links).alias("link"))
    ends = ends.select("source", host_of(F.col("link")).alias("target"))
    ends = ends.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    return ends.groupBy("source", "target").agg(F.count("*").alias("links"))


def seeds(judged: DataFrame) -> DataFrame:
    """Seed hosts: kind (trust or distrust), host, score 1."""
    allowed, blocked = F.count_if(F.col("verdict") == "allow"), F.count_if(F.col("verdict") == "block")
    hosts = judged.filter(F.col("host") != "").groupBy("host").agg(allowed.alias("allowed"), blocked.alias("blocked"), F.count("*").alias("pages"))
    kind = F.when(2 * F.col("blocked") > F.col("pages"), "distrust").when(F.col("allowed") > F.col("blocked"), "trust")
    return hosts.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("kind", "host", F.lit(1.0).alias("score"))


def propagate(edges: DataFrame, start: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, score: trust along the links, distrust and risk against them.

    Each round sends on what arrived in the one before: one join on (kind,
    host) and one sum, written, so that lineage stays short. Scores are the
    sums of all rounds.
    """
    ways = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links")
    ways = ways.unionByName(back)
    total = ways.groupBy("kind", "host").agg(F.sum("links").alias("total"))
    ways = ways.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("total")).alias("share"))
    risk = ways.filter("kind = 'trust'").select(F.lit("risk").alias("kind"), F.col("to").alias("host"), F.col("host").alias("to"), "share")
    ways = ways.unionByName(risk)
    ways = materialize(ways, "url-edges")
    arrived = materialize(start.withColumn("score", F.col("score") * (1 - damping)), "url-seeds")
    scores = arrived
    if ways.isEmpty():
        return scores
    moving = ("trust", "distrust", "risk")
    while moving:  # ends: the bound of each kind shrinks by the damping in every round
        sent = arrived.filter(F.col("kind").isin(*moving)).join(ways, ["kind", "host"])
        sent = sent.select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        arrived = materialize(sent.groupBy("kind", "host").agg(F.sum("score").alias("score")), "url-arrived")
        bound = F.when(F.col("kind") == "risk", F.max("score")).otherwise(F.sum("score")) * damping / (1 - damping)
        left = arrived.groupBy("kind").agg(bound.alias("left")).collect()  # three rows
        if left:
            scores = materialize(scores.unionByName(arrived).groupBy("kind", "host").agg(F.sum("score").alias("score")), "url-scores")
        moving = tuple(r["kind"] for r in left if r["left"] > tolerance)
    return scores


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust and risk for each page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("verdict", verdict_of(F.col("rule"), rules))
    rows = materialize(rows, "url-pages")
    start = materialize(seeds(rows), "url-starts")
    start = start.unionByName(start.filter("kind = 'distrust'").withColumn("kind", F.lit("risk")))
    scores = propagate(host_edges(pages), start, damping)
    hosts = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust", "risk")])
    hosts = materialize(hosts, "url-hosts")
    worst = F.greatest("distrust", "risk")
    bad = (worst >= threshold) & (worst > F.col("trust"))
    method = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    return rows.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", method).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"),
        F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
        F.round(F.coalesce("risk", F.lit(0.0)), 9).alias("risk"),
    )
