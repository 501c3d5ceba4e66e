"""URL filters: list rules first, then trust and distrust spread over the link graph of hosts.

Rules name a host and a path prefix; the longest rule that fits a URL decides. Hosts without a
ruling get one from the graph: a host is a trusted seed by the share of its pages that rules
allow, and a blocked seed by the share that rules block. Trust is the personalised PageRank of
the trusted seeds along links; distrust is that of the blocked seeds along reversed links, so
whoever links to blocked hosts is suspect. A host is blocked if its distrust exceeds its trust
by ``margin`` of what a pure seed holds without any link.

Personalised PageRank divides a blocked host's distrust among all hosts that link to it, so the
more there are, the less each gets. With ``by_own_links`` a linker's distrust is instead the mean
over its own links of what they lead to: whoever links to blocked hosts only is blocked, however
many others do so, and one such link among a thousand counts a thousandth. A mean divides no mass, so
blocked hosts that link to one another would raise each other without end; there, a host takes over
distrust only for the share of it that is no seed, which keeps every score at or below that of a pure
seed, the scale of ``margin``.

Host edges are grouped from the pages' absolute links before they are joined; a round joins one
row per host with the edges and sums by host, so a host with very many pages or links is combined
before each shuffle. Rounds stop when scores move by less than ``tolerance`` in sum.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule;
pages of an empty host share the score of that host; links to the own host and pages without html
add no edge; without edges the seeds alone decide; repeated rows count as pages; an empty table
gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.storage import stored
from docwarden.llm.urls import host_of, path_of

#: An absolute or protocol-relative link target in an href.
LINK = r"""(?is)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    def __str__(self) -> str:
        return self.host + self.path


def ruling(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(
            F.lit(str(rule)).alias("rule"), F.lit("allow" if rule.allow else "block").alias("verdict"),
        )).otherwise(found)
    return found


def host_edges(pages: DataFrame, *, url: str, html: str) -> DataFrame:
    """``src, dst, links`` between different hosts."""
    targets = F.transform(
        F.array_distinct(F.regexp_extract_all(F.col(f"`{html}`"), F.lit(LINK), F.lit(1))),
        lambda t: host_of(F.concat(F.lit("x:"), F.regexp_replace(t, "(?i)^https?:", ""))))
    links = pages.select(host_of(F.col(f"`{url}`")).alias("src"), F.explode(targets).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(
        F.count("*").cast("double").alias("links"))


#: 0.85 ** 400 is below 1e-28.
MAX_ROUNDS = 400


def propagate(
    seeds: DataFrame, edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6,
    shared_by: str = "src",
) -> DataFrame:
    """``host, score``: personalised PageRank of ``seeds`` (host, seed) along ``edges`` (src, dst, links).

    Scores go from ``src`` to ``dst`` by the share of a link among those of ``src``, or among those
    of the column ``shared_by`` names; by those of ``dst``, only for the share of ``dst`` that is no seed,
    so no score exceeds a pure seed's. Rounds go on until scores move by less than ``tolerance`` in
    all. A round multiplies what is left to move by ``damping`` where mass is divided, so after
    ``MAX_ROUNDS`` it is far below any tolerance; scores that still move are an error.
    """
    out = edges.groupBy(shared_by).agg(F.sum("links").alias("all_links"))
    weighted = stored(edges.join(out, shared_by).select("src", "dst", (F.col("links") / F.col("all_links")).alias("w")))
    if shared_by == "dst":
        open_share = seeds.select(F.col("host").alias("dst"), (1 - F.col("seed")).alias("open"))
        weighted = stored(weighted.join(open_share, "dst", "left").select(
            "src", "dst", (F.col("w") * F.coalesce("open", F.lit(1.0))).alias("w")).where("w > 0"))
    start = seeds.select("host", ((1 - damping) * F.col("seed")).alias("start"))
    scores = stored(start.select("host", F.col("start").alias("score")))
    if weighted.isEmpty():
        return scores
    for _ in range(MAX_ROUNDS):
        sent = scores.join(weighted, scores.host == weighted.src).groupBy(F.col("dst").alias("host")).agg(
            (damping * F.sum(F.col("score") * F.col("w"))).alias("got"))
        parts = sent.unionByName(start.select("host", F.col("start").alias("got")))
        new = stored(parts.groupBy("host").agg(F.sum("got").alias("score")))
        old = scores.select("host", F.col("score").alias("old"))
        moved = new.join(old, "host", "full").agg(
            F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        scores = new
        if not moved or moved < tolerance:
            return scores
    raise RuntimeError("host scores did not settle")


def judged(
    pages: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html",
    damping: float = 0.85, margin: float = 0.5, by_own_links: bool = False,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``."""
    u = F.col(f"`{url}`")
    named = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    ruled = named.withColumn("ruling", ruling(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.coalesce((F.col("ruling.verdict") == v).cast("double"), F.lit(0.0)))
    hosts = stored(ruled.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")))
    edges = stored(host_edges(pages, url=url, html=html))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), edges, damping=damping)
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), back, damping=damping,
                         shared_by="dst" if by_own_links else "src")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scores = stored(
        hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .select("host", zero("trust").alias("trust"), zero("distrust").alias("distrust")))
    suspect = F.col("distrust") - F.col("trust") >= margin * (1 - damping)
    verdict = F.coalesce("ruling.verdict", F.when(suspect, "block").otherwise("allow"))
    return ruled.join(scores, "host").select(
        "page_id", "host", "path", F.col("ruling.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
