"""URL filter: rules first, then link-graph propagation of trust and distrust between hosts (DataFrame functions only)."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch

#: (verdict, host, path), fixed by the contract of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://`` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is ``host`` or a parent domain and whose path begins ``path``."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of pages with a host to other hosts, counted. Links within a host say nothing about another."""
    host, _ = host_and_path(F.col("url"))
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lower_ascii(F.regexp_replace("dst", r"^.*@|:\d*$", "")).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, tag: str, damping: float = DAMPING, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank: (host, rank) with rank = (1 - d) seed + d * sum over links of the linking hosts' shares.

    ``seeds`` (host, seed) has every host once. A host's rank is shared out by its link counts; hosts without links
    pass nothing on. Rounds, each a written table, go on until ranks move by less than ``tolerance`` of all seeds in all:
    what moves shrinks by ``damping`` a round, so the number of rounds is known beforehand, whatever the graph.
    """
    mass = seeds.agg(F.sum("seed")).first()[0] or 0.0
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = scratch.write(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), f"{tag}_share")
    rank, k = scratch.write(seeds.select("host", "seed", (F.lit(1 - damping) * F.col("seed")).alias("rank")), f"{tag}_0"), 0
    most = math.ceil(math.log(tolerance) / math.log(damping)) + 2
    while mass:
        k += 1
        given = share.join(rank.select(F.col("host").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("given"))
        new = rank.withColumnRenamed("rank", "old").join(given, "host", "left").select(
            "host", "seed", "old", (F.lit(1 - damping) * F.col("seed") + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("rank"))
        new = scratch.write(new, f"{tag}_{k}")
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = new.drop("old")
        if moved <= tolerance * mass:
            break
        if k > most:
            raise RuntimeError(f"ranks still move by {moved} of {mass} after {k} rounds")
        scratch.drop(f"{tag}_{k - 1}")
    return rank.select("host", "rank")


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.0) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust.

    Where no rule fits, the host decides. Its seeds are the shares of its pages that rules allow (trust) and block
    (distrust); trust flows along links, distrust against them, as linking to a blocked host is what counts against
    one. The verdict is allow if trust - distrust is at least ``threshold``; a host that neither reaches has 0 for
    both, and so is allowed by default.

    Links are counted per pair of hosts before anything else, so work per round follows host pairs, not pages; a hot
    host is pre-aggregated by partial sums and its pages meet its verdict in a join that AQE splits or broadcasts.
    Null urls have empty host and path, no rule, and scores of 0; null html has no links; repeated rows count each;
    an empty table gives no rows. Other columns aren't read.
    """
    scratch = Scratch(pages.sparkSession, "judge_urls")
    host, path = host_and_path(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("page_id", "host", "path", "m.rule", F.col("m.verdict").alias("ruled"))
    edges = scratch.write(host_edges(pages.select("url", "html")), "edges")
    of_pages = ruled.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("good"),
                                                             F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("bad"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = scratch.write(of_pages.join(linked, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")), "hosts")
    trust = propagate(hosts.select("host", F.col("good").alias("seed")), edges, scratch, "trust").withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(hosts.select("host", F.col("bad").alias("seed")), back, scratch, "distrust").withColumnRenamed("rank", "distrust")
    judged = scratch.write(trust.join(distrust, "host"), "judged")
    out = ruled.join(judged, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(trust - distrust >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
