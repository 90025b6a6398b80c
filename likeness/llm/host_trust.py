"""URL filter: rules for hosts and paths, then trust and distrust propagated over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import stored

DAMPING = 0.85
STEPS = 8
THRESHOLD = 0.5             # of the score of a host all of whose pages are blocked by rules
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _candidates(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host and of the domains above it."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (hosts.select("host", F.explode(domains).alias("domain")).join(rules, "domain").groupBy("host")
            .agg(F.collect_set(F.struct(F.length(F.concat("domain", "prefix")).alias("size"), F.concat("domain", "prefix").alias("rule"),
                                        "prefix", "verdict")).alias("rules")))


def _propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, score) by personalised PageRank; distrust runs against the links.

    Both directions are one frame, so each step is one join and one sum with partial sums.
    """
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links")
    both = forward.unionByName(backward)
    total = both.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    flow = stored(both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("part")))
    score = seeds
    if flow.isEmpty():
        return score.select("kind", "host", F.round((1 - DAMPING) * F.col("score"), 12).alias("score"))
    for step in range(STEPS):
        moved = (score.join(flow, ["kind", "host"]).groupBy("kind", F.col("to").alias("host"))
                 .agg((F.sum(F.col("score") * F.col("part")) * DAMPING).alias("moved")))
        score = seeds.withColumnRenamed("score", "seed").join(moved, ["kind", "host"], "full").select(
            "kind", "host", F.round((1 - DAMPING) * F.coalesce("seed", F.lit(0.0)) + F.coalesce("moved", F.lit(0.0)), 12).alias("score"))
        score = stored(score)
    return score


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Judge every url by ``rules`` (host, path, verdict), and where none fits by its host's standing.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest
    decides. The share of a host's pages that rules allow or block seeds trust and distrust. Trust
    follows links between hosts found in the pages, distrust runs against them, both by
    personalised PageRank. A page without a rule is blocked if its host's distrust exceeds its trust
    and ``threshold`` times the score of a wholly blocked host, else allowed.

    One row per input row: the id, host, path, rule, verdict, trust and distrust. A url that is null or
    has no ``://`` has an empty host and path and no rule, and is allowed; links inside a host do not
    count; pages that repeat count as often as they occur. Pages meet hosts only in joins against
    aggregated hosts, where a hot host can be split.
    """
    spark = pages.sparkSession
    listed = [F.struct(F.lit(h).alias("domain"), F.lit(p).alias("prefix"), F.lit(v).alias("verdict")) for h, p, v in rules]
    table = spark.range(1).select(F.explode(F.array(*listed)).alias("rule")).select("rule.*")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    known = stored(hosts.join(_candidates(hosts, table), "host", "left").select("host", "pages", "rules"))
    fitting = F.filter("rules", lambda r: F.col("path").startswith(r["prefix"]))
    judged = rows.join(known, "host").select("id", "host", "path", "pages", F.array_max(fitting).alias("best"))
    seeds = (judged.where("best is not null").groupBy("host", "best.verdict").agg((F.count(F.lit(1)) / F.first("pages")).alias("score"))
             .select(F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", "score"))
    out = pages.select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("link"))
    to = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    edges = out.select("src", to.alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("links"))
    score = _propagated(edges, stored(seeds))
    standing = score.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
                                         F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"))
    per_host = stored(known.join(standing, "host", "left"))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust > trust) & (distrust >= threshold * (1 - DAMPING))
    best = F.array_max(fitting)
    return rows.join(per_host, "host").select(
        F.col("id").alias(id_col), "host", "path", best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.when(bad, "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
