"""URL filters: rules by host and path, and link-graph propagation for what no rule judges (operator 13).

Method: hosts are the nodes of a graph.  Host a has an edge to host b, weighed by the
pages of a that link to b; a host also has edges to and from the nearest host that it
is a subdomain of, weighed by its pages.  A page that a rule allows is a unit of trust
at its host, a page that a rule blocks a unit of distrust.  Trust is the personalised
PageRank from the trusted seeds along the edges; distrust is that from the blocked
seeds along the reversed edges, as who links to bad hosts shares in the blame.  After
``ITERATIONS`` rounds a host is blocked if distrust is more than ``THRESHOLD`` of the
trust and distrust that reached it, and allowed otherwise, also where neither did.

Each round is a join of hosts and edges and a sum by receiver, combined in each task
first; links are counted by host pair before that, so a hot host is one row for each
host that it links to, and Spark may split those.  All of it is DataFrame functions.

Defined results: a null url or one without ``://`` has host and path '' and, without
a rule, the verdict ``allow`` (host '' is no node); null and empty pages have no links;
links without a host, or to the own host, count for nothing, repeated links of a
page once; repeated rows count each; an empty table gives no rows; of rules that fit, the
longest text wins, then block; other columns are carried along, but for columns named
like the results, which these replace.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep

DAMPING, ITERATIONS, THRESHOLD = 0.85, 20, 0.5
#: Rounds between two checkpoints, and the change below which no further round is needed.
LEG, STILL = 5, 1e-12
_EVEN = 1e-9  # sums that differ by rounding alone are even
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
_UNSEEN = r"(?is)<!--.*?-->|<script[\s>].*?</script|<style[\s>].*?</style"


class Rule(NamedTuple):
    """What urls of a host and its subdomains, whose path begins so, are."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?``, ``#`` or the end, A-Z lowered; the path up to ``?``, ``#`` or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3))
    return tuple(F.coalesce(c, F.lit("")) for c in (_lowered(F.regexp_extract(rest, r"\A[^/?#]*", 0)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else nulls.  The rules become part of the plan: meant for lists of up to some hundreds."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def linked_hosts(html: Column) -> Column:
    """The different hosts that a page links to."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), _UNSEEN, " "), F.lit(_LINK), 1), _lowered))


def host_edges(seen: DataFrame) -> DataFrame:
    """From host and links (array) of each page: a, b and weight of every edge of the host graph."""
    links = (seen.select(F.col("host").alias("a"), F.explode("links").alias("b")).where((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b")))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")))
    hosts = seen.where(F.col("host") != "").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # Every name that a host is below, from the nearest on; hosts have few labels.
    names = F.split("host", r"\.")
    above = hosts.select("host", "pages", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(names), F.lit(2))),
                                                                   lambda k: F.array_join(F.slice(names, k, F.size(names)), "."))).alias("steps", "top"))
    nearest = (above.where(F.col("top") != "").join(hosts.select(F.col("host").alias("top")), "top").groupBy("host")
               .agg(F.min_by("top", "steps").alias("top"), F.max("pages").alias("weight")))
    both = F.explode(F.array(F.struct(F.col("host").alias("a"), F.col("top").alias("b")), F.struct(F.col("top").alias("a"), F.col("host").alias("b"))))
    site = nearest.select(both.alias("e"), "weight").select("e.a", "e.b", "weight")
    return links.unionByName(site).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def propagated(seeds: DataFrame, edges: DataFrame, *, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """From host, trusted and blocked of the seeds and the weighed edges a, b: host, trust and distrust of every host.

    A round sends trust from a to b in proportion to the edges that leave a, and distrust from b to a in proportion to
    those that enter b.  A host without such edges passes nothing on.
    """
    out, into = edges.groupBy("a").agg(F.sum("weight").alias("leaving")), edges.groupBy("b").agg(F.sum("weight").alias("entering"))
    share = edges.join(out, "a").join(into, "b").select("a", "b", (F.col("weight") / F.col("leaving")).alias("forward"), (F.col("weight") / F.col("entering")).alias("back"))
    sent = keep(share.select(F.inline(F.array(
        F.struct(F.col("a").alias("sender"), F.col("b").alias("host"), F.col("forward").alias("trusted"), F.lit(0.0).alias("blamed")),
        F.struct(F.col("b").alias("sender"), F.col("a").alias("host"), F.lit(0.0).alias("trusted"), F.col("back").alias("blamed"))))))
    known = seeds.select("host", F.col("trusted").cast("double").alias("trusted"), F.col("blocked").cast("double").alias("blocked"))
    seeds = keep(sent.select("host", F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked")).unionByName(known).groupBy("host")
                 .agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")))
    ranks = held = seeds.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    for k in range(1, iterations + 1):
        got = (ranks.withColumnRenamed("host", "sender").join(sent, "sender").groupBy("host")
               .agg(F.sum(F.col("trust") * F.col("trusted")).alias("t"), F.sum(F.col("distrust") * F.col("blamed")).alias("d")))
        ranks = seeds.join(got, "host", "left").select(
            "host", ((1 - damping) * F.col("trusted") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("blocked") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        if k % LEG == 0 or k == iterations:
            ranks = keep(ranks)
            was = held.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
            if ranks.join(was, "host").where(F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d"))) > STILL).isEmpty():
                break
            held = ranks
    return ranks


def host_verdicts(pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD,
                  damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """host, trust, distrust and verdict of every host that a page is on or links to."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    seen = keep(pages.select(host.alias("host"), ruled(host, path, rules)[1].alias("verdict"), linked_hosts(F.col(f"`{html_col}`")).alias("links")))
    seeds = seen.where(F.col("host") != "").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("trusted"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    ranks = propagated(seeds, host_edges(seen), damping=damping, iterations=iterations)
    bad = F.col("distrust") > (threshold + _EVEN) * (F.col("trust") + F.col("distrust"))
    return ranks.withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def with_verdicts(pages: DataFrame, hosts: DataFrame, rules: Sequence[Rule], *, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and verdict of each page, given the verdicts of the hosts."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    results = "host", "path", "rule", "verdict"
    key, judged = fresh(pages, "host_key"), fresh(pages, "host_verdict")
    rule, verdict = ruled(F.col(key), path, rules)
    rows = pages.withColumn(key, host).join(hosts.select(F.col("host").alias(key), F.col("verdict").alias(judged)), key, "left")
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns if c not in results], F.col(key).alias("host"), path.alias("path"), rule.alias("rule"),
                       F.coalesce(verdict, F.col(judged), F.lit("allow")).alias("verdict"))
