"""URL filter: host and path rules, and link-graph propagation for the hosts that no rule decides.

Trust starts at hosts with allowed pages and follows the links; distrust starts at hosts with blocked pages and follows them
backwards: who links to a blocked host is suspect. Both are personalised PageRanks over the same host edges, computed in one
iteration on a doubled edge table that goes on until they have converged. Mass is a whole number of billionths of a seed, so every run and engine gives equal sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, lower_ascii, settle

#: Fixed values: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
UNIT = 1_000_000_000  # the mass of one seed; a host can gather that of 5e8 seeds without overflow
WALK, STAY = 17, 3  # twentieths: 0.85 of the mass walks on, 0.15 returns to the seeds


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) of absolute links between different hosts; duplicates are dropped before the shuffle."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))
    links = F.filter(links, lambda x: x.contains("://") | x.startswith("//"))
    links = F.transform(links, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    hosts = F.array_distinct(F.transform(links, host_of))
    edges = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(hosts).alias("dst"))
    return edges.where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: int = UNIT // 20_000, settle_every: int = 4) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust); mass at hosts without links is lost.

    A wave starts with the share of the seeds that stays and walks until all that it can still bring, to all hosts together, is
    under ``tolerance``. Whole numbers let every wave die out."""
    both = edges.select(F.lit(0).alias("kind"), "src", "dst").union(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    both = settle(both.join(degree, ["kind", "src"]))
    start = seeds.select(F.expr("stack(2, 0, host, trust, 1, host, distrust)").alias("kind", "src", "mass")).where("mass > 0")
    mass = settle(start.select("kind", "src", F.expr(f"mass * {STAY} div 20").alias("mass")).withColumn("wave", F.col("mass")))
    left = UNIT
    while left * WALK >= tolerance * (20 - WALK) and left:
        before = mass
        for _ in range(settle_every):
            moved = both.join(mass.where("wave > 0"), ["kind", "src"]).select("kind", F.col("dst").alias("src"), F.expr(f"wave * {WALK} div (20 * degree)").alias("wave"))
            mass = moved.where("wave > 0").select("kind", "src", F.col("wave").alias("mass"), "wave").union(mass.select("kind", "src", "mass", F.lit(0).cast("long")))
            mass = mass.groupBy("kind", "src").agg(F.sum("mass").alias("mass"), F.sum("wave").alias("wave"))
        mass = settle(mass)
        drop_settled(before)
        left = mass.agg(F.sum("wave")).first()[0] or 0
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0))
    return mass.groupBy(F.col("src").alias("host")).agg(pick(0).alias("trust"), pick(1).alias("distrust"))


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with columns host, path, rule, verdict, trust, distrust.

    Without a fitting rule a page is blocked when its host's distrust exceeds its trust by ``threshold`` (1: a host all of
    whose pages a rule blocks, without any links). A host's seeds are the shares of its pages that rules allow and block. A null
    url, or one without '://', has an empty host and path and is allowed. Null html has no links. Repeated rows count as pages
    of their own. An empty table gives no rows. Columns of ``pages`` with these names are replaced."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule = rule_of(host, path, rules)
    ruled = pages.select(host.alias("host"), verdict_of(rule, rules).alias("verdict"))
    share = lambda v: F.expr(f"sum(if(verdict = '{v}', 1, 0)) * {UNIT} div count(*)")
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(host_edges(pages, url_col, html_col), seeds).select(
        F.col("host").alias("_host"), F.col("trust").alias("_trust"), F.col("distrust").alias("_distrust"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    rows = pages.select(F.struct(*own).alias("page"), host.alias("host"), path.alias("path"), rule.alias("rule"))
    joined = rows.join(scores, rows["host"] == scores["_host"], "left").drop("_host")
    unit = UNIT * STAY // 20
    bad = F.coalesce("_distrust", F.lit(0)) - F.coalesce("_trust", F.lit(0)) >= int(threshold * unit)
    return joined.select(
        "page.*", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        (F.coalesce("_trust", F.lit(0)) / unit).alias("trust"), (F.coalesce("_distrust", F.lit(0)) / unit).alias("distrust"))
