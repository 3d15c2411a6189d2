"""URL filter: rules, and a tree of path templates whose labelled purity decides about the rest.

A url is cut into host and path. Rules (host and its subdomains, path prefix; the longest wins) decide where they fit. Their
decisions also label the pages for the method: per host the path's segments are generalised level by level, down to the deepest
one. A segment keeps its own branch if it has a fair share of the pages below its parent, or, whatever its share, if its labelled
pages are blocked at a rate that differs significantly from that of its siblings; others become wildcards by form (number, hex,
slug). Branches of one parent whose rates do not differ from their siblings' are merged into one. A page's template is the branch
it ends up in. A template's block rate is smoothed towards that of the same template over all hosts, and that one towards the
overall rate; above `reject_from` the page is blocked.

The tree is built on distinct urls with counts; a level is one grouping and one join, with map-side combine, and a written table.
Where no segment has `min_pages` pages, or a parent has one url only, no deeper one can branch, and what is left of the paths is
generalised at once. So there are as many levels as different urls share `min_pages` pages.

Defined results: a null url, or one without `://`, has an empty host and path; no rule fits an empty host; equal urls get equal verdicts;
repeated rows count each; without any labelled page everything else is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The given rules.
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Shape:
    min_pages: int = 5
    min_share: float = 0.05
    z: float = 1.96
    weight: float = 4.0  # pages that a prior counts for
    reject_from: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does. Rules are a list of some hundreds at most."""
    ways = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = (host == r.host) | host.endswith("." + r.host)
        ways.append(F.when(fits & path.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*ways) if ways else F.lit(None).cast("struct<rule:string,verdict:string>")


def form(segment: Column) -> Column:
    """The wildcard of a segment; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")
    kind = F.when(stem.rlike("^[0-9]+$"), "{number}").when(stem.rlike("^[0-9a-fA-F-]{8,}$"), "{hex}").otherwise("{slug}")
    return F.concat(kind, ending)


def levels(urls: DataFrame, shape: Shape) -> DataFrame:
    """urls(host, path, n, known, blocked), each once, with `template`; known and blocked: labelled pages, and those of them blocked."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    tree = stored(urls.withColumn("segments", segments).withColumn("template", F.lit("")), "urls")
    sums = ("n", "known", "blocked")
    d = 0
    while True:
        has = F.size("segments") > d
        at = tree.withColumn("segment", F.get("segments", F.lit(d)))
        nodes = at.where(has).groupBy("host", "template", "segment").agg(F.count("*").alias("urls"), *[F.sum(c).alias(c) for c in sums])
        parents = nodes.groupBy("host", "template").agg(F.sum("urls").alias("p_urls"), *[F.sum(c).alias(f"p_{c}") for c in sums])
        both = nodes.join(parents, ["host", "template"]).where((F.col("p_urls") > 1) & (F.col("n") >= shape.min_pages))
        rest, pooled = F.col("p_known") - F.col("known"), F.col("p_blocked") / F.col("p_known")
        gap = F.abs(F.col("blocked") / F.col("known") - (F.col("p_blocked") - F.col("blocked")) / rest)
        spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / F.col("known") + 1 / rest))
        told = (F.col("known") >= shape.min_pages) & (rest > 0)
        differs = F.when(told, gap >= shape.z * spread).otherwise(F.lit(False))
        alike = F.when(told, gap < shape.z * spread).otherwise(F.lit(False))
        kept = both.where(differs | (F.col("n") >= shape.min_share * F.col("p_n")))
        branches = stored(kept.select(
            F.col("host").alias("b_host"), F.col("template").alias("b_template"), F.col("segment").alias("b_segment"),
            F.when(alike, F.lit("{any}")).otherwise(F.col("segment")).alias("branch")), "branches")
        if branches.isEmpty():
            break
        joined = at.join(branches, (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template")) & (F.col("segment") == F.col("b_segment")), "left")
        longer = F.concat("template", F.lit("/"), F.coalesce("branch", form(F.col("segment"))))
        tree = stored(joined.select(*[c for c in tree.columns if c != "template"], F.when(has, longer).otherwise(F.col("template")).alias("template")), "urls")
        d += 1
    left = F.transform(F.slice("segments", F.lit(d + 1), F.greatest(F.size("segments") - d, F.lit(0))), lambda s: F.concat(F.lit("/"), form(s)))
    return tree.withColumn("template", F.concat("template", F.array_join(left, "")))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, shape: Shape = Shape(), url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """pages as `row` with host, path, rule, template, block_rate and verdict."""
    cut = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry or pages.columns]).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    ruled = cut.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    label = F.when(F.col("by_rule.verdict") == "block", 1).when(F.col("by_rule.verdict") == "allow", 0)
    ruled = ruled.withColumn("label", label)
    tree = stored(levels(ruled.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")), shape), "templates")
    nodes = tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("blocked").alias("blocked"))
    over_all = nodes.groupBy(F.col("template").alias("t_template")).agg(F.sum("known").alias("t_n"), F.sum("blocked").alias("t_blocked"))
    prior = tree.agg(F.coalesce(F.try_divide(F.sum("blocked"), F.sum("known")), F.lit(0.0)).alias("prior")).first()[0]
    k = shape.weight
    general = (F.col("t_blocked") + k * F.lit(prior)) / (F.col("t_n") + k)
    own = (F.col("blocked") + k * general) / (F.col("known") + k)
    rates = nodes.join(over_all, F.col("template") == F.col("t_template")).select(F.col("host").alias("r_host"), F.col("template").alias("r_template"), own.alias("block_rate"))
    of = tree.join(rates, (F.col("host") == F.col("r_host")) & (F.col("template") == F.col("r_template"))).select(
        F.col("host").alias("u_host"), F.col("path").alias("u_path"), "template", "block_rate")
    both = ruled.join(of, (F.col("host") == F.col("u_host")) & (F.col("path") == F.col("u_path")))
    verdict = F.coalesce(F.col("by_rule.verdict"), F.when(F.col("block_rate") >= shape.reject_from, "block").otherwise("allow"))
    return both.select("row", "host", "path", F.col("by_rule.rule").alias("rule"), "template", "block_rate", verdict.alias("verdict"))
