"""URL filters by link-graph propagation, in DataFrame operations only.

Hosts that allow rules name are trusted seeds, hosts that block rules name are distrusted seeds. Trust flows along the
links (personalised PageRank), distrust flows against them: who links to blocked hosts is suspect, by the share of its links
that lead there, however many others link to the same hosts. A url takes the verdict of its longest fitting rule, else block if its host's distrust is over a threshold and over its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Names, discard, scratch, small

#: (action, host, path): the rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 8, 0.05
#: Hosts whose scores are broadcast; beyond, both sides are shuffled.
BROADCAST_HOSTS = 50_000
#: Rules that are one expression; a longer list is joined by host.
MAX_RULES = 500
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, action), or null."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def ruled(df: DataFrame, host: str, path: str, into: str, rules=RULES) -> DataFrame:
    """The rows with the longest fitting rule in column `into`; a long list is joined once per host, and its few rules that fit the host are tried on the path."""
    if len(rules) <= MAX_RULES:
        return df.withColumn(into, matching_rule(F.col(host), F.col(path), rules))
    table = df.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    parts = F.split("_h", r"\.", -1)
    hosts = df.select(F.col(host).alias("_h")).where(F.col("_h") != "").distinct()
    suffixes = hosts.select("_h", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("host"))
    whole = F.concat("host", "path")
    fits = suffixes.join(table, "host").groupBy("_h").agg(F.array_sort(F.collect_set(F.struct((-F.length(whole)).alias("n"), "action", "host", "path"))).alias("_fits"))
    name = Names(df)
    fits = small(scratch(fits.select(F.col("_h").alias(name("_h")), F.col("_fits").alias(name("_fits"))), "url-rules"))
    best = F.try_element_at(F.filter(name("_fits"), lambda r: F.col(path).startswith(r["path"])), F.lit(1))
    out = df.join(fits, F.col(host) == F.col(name("_h")), "left")
    return out.withColumn(into, F.when(best.isNotNull(), F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["action"].alias("action")))).drop(name("_h"), name("_fits"))


def action_share(rule: str, action: str) -> Column:
    """The share of a group's rows that a rule with this action decides."""
    return F.avg(F.coalesce((F.col(rule)["action"] == action).cast("double"), F.lit(0.0)))


def host_links(pages: DataFrame, url: str, html: str, rules=RULES) -> DataFrame:
    """Distinct links between different hosts: src, dst, and the shares t, d of these links that rules allow and block."""
    found = pages.select(host_of(F.col(url)).alias("src"), F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1)), lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))).alias("_to"))
    found = found.where((F.size("_to") > 0) & (F.col("src") != ""))
    edges = found.select("src", F.explode("_to").alias("_to")).select("src", host_of(F.col("_to")).alias("dst"), path_of(F.col("_to")).alias("_path"))
    edges = ruled(edges.where((F.col("dst") != "") & (F.col("src") != F.col("dst"))), "dst", "_path", "_rule", rules)
    return edges.groupBy("src", "dst").agg(action_share("_rule", "allow").alias("t"), action_share("_rule", "block").alias("d"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, t, d) in [0, 1] and links (src, dst).

    score = (1 - damping) * seed + damping * inflow; a host shares its trust evenly among the hosts it links to, and takes
    the mean distrust of those hosts. Both flows go over one edge table, so a round is one join and one sum.
    """
    out_n = links.groupBy("src").agg(F.count(F.lit(1)).alias("_o"))
    full = links.select("src", "dst").join(out_n, "src")
    flows = full.select(F.col("src").alias("a"), F.col("dst").alias("b"), (1 / F.col("_o")).alias("wt"), F.lit(0.0).alias("wd"))
    flows = flows.unionByName(full.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("wt"), (1 / F.col("_o")).alias("wd")))
    flows = scratch(flows, "url-flows")
    base = seeds.select("host", (F.col("t") * (1 - damping)).alias("t0"), (F.col("d") * (1 - damping)).alias("d0"))
    base = scratch(base, "url-seeds")
    rank = base.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    if flows.isEmpty():
        return rank
    for k in range(rounds):
        sent = flows.join(rank, F.col("a") == F.col("host")).groupBy("b").agg(F.sum(F.col("wt") * F.col("trust")).alias("_t"), F.sum(F.col("wd") * F.col("distrust")).alias("_d"))
        rank = base.join(sent, F.col("host") == F.col("b"), "full").select(
            F.coalesce("host", "b").alias("host"),
            (F.coalesce("t0", F.lit(0.0)) + damping * F.coalesce("_t", F.lit(0.0))).alias("trust"),
            (F.coalesce("d0", F.lit(0.0)) + damping * F.coalesce("_d", F.lit(0.0))).alias("distrust"),
        )
        if k % 4 == 3:
            rank = scratch(rank, f"url-rank{k}")
    return rank


def filter_urls(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with `host`, `path`, `rule` (null if none fits), `verdict`, `trust`, `distrust` added.

    Null urls and urls without `://` have empty host and path, fit no rule, have scores 0 and are allowed. Null html has
    no links. Repeated rows are judged alike. Columns of these names in the input are replaced. The scores come from hosts'
    shares of ruled pages, of a host without rows from the ruled links to it, so a hot host is one row of the graph.
    """
    name = Names(pages)
    rule, at, trusted, blocked = map(name, ("rule", "host", "trust", "distrust"))
    judged = pages.drop("trust", "distrust", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = ruled(judged, "host", "path", rule, rules)
    seeds = scratch(judged.where(F.col("host") != "").groupBy("host").agg(action_share(rule, "allow").alias("t"), action_share(rule, "block").alias("d")), "url-own")
    links = scratch(host_links(pages, url, html, rules), "url-links")
    # each linking host counts once for a host without rows
    targets = links.groupBy(F.col("dst").alias("host")).agg(F.avg("t").alias("t"), F.avg("d").alias("d")).where("t > 0 or d > 0")
    scores = scratch(propagate(links, seeds.unionByName(targets.join(seeds.select("host"), "host", "left_anti")), damping, rounds), "url-scores")
    discard(seeds, links)
    side = small(scores.select(F.col("host").alias(at), F.col("trust").alias(trusted), F.col("distrust").alias(blocked)), BROADCAST_HOSTS)
    out = judged.join(side, F.col("host") == F.col(at), "left")
    trust, distrust = F.coalesce(trusted, F.lit(0.0)), F.coalesce(blocked, F.lit(0.0))
    method = F.when((distrust > threshold) & (distrust > trust), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"rule": F.col(rule)["rule"], "verdict": F.coalesce(F.col(rule)["action"], method), "trust": trust, "distrust": distrust}).drop(rule, at, trusted, blocked)
