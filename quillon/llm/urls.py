"""URL filter: explicit rules first, then a tree of path templates for each host.

A rule names a host and a path prefix; it fits the host, its subdomains, and every path that
begins so; of several the longest wins. What no rule judges goes by its template. Templates
start as the path's segments with their variable parts (numbers, hashes, dates) as wildcards.
Then, at each depth where nodes branch, however deep, each node's rare children become one wildcard
where there are many, and a child merges with the largest one of its kind where neither what follows below nor its labels
tell them apart (two chi-squared tests, depth and width). A merged branch bears the larger one's
name. A template is rejected if the smoothed share of blocked among its labelled URLs is high
enough; URLs without a label smooth it towards even, a tenth of an even one each, so a template
of which little is known is allowed. Labels are the rules' verdicts, and those of a further
column if one is named. Rules whose paths end inside a segment (`shop.net/item/9`) label a part
of a template's URLs, and the template then judges the others.

All of it is joins and aggregations over counts by (host, template); no step holds a host's
tree in one place.

Defined results: a null URL, or one without "://", has an empty host and path and is allowed
unless a rule says otherwise; an empty path has no template segments; repeated rows are judged
alike and count each; a null page_id is judged; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Children of a node beyond which the rare ones are one wildcard, and how rare those are.
CHILDREN, RARE = 12, 0.05
#: Chi-squared of one and of three degrees of freedom at 5 %: below, two branches are alike.
ALIKE_1, ALIKE_3 = 3.84, 7.81
#: Labelled purity that rejects; evidence that smoothing adds, and its part for an unlabelled URL.
REJECT, EVEN, UNLABELLED = 0.75, 3.0, 0.1
#: Rules that one expression may hold.
RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """Of a text like `example.com/de/`."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_column(rules: list[Rule], host: Column, path: Column) -> Column:
    """Text of the longest rule that fits; null if none does."""
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def verdict_column(rules: list[Rule], chosen: Column) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(chosen == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments, all of them, with variable parts as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), "{hash}").when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), "{date}").when(F.length(s) > 40, "{long}").otherwise(F.regexp_replace(s, r"\d+", "{n}")))


def _chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the table ((a, b), (c, d)); 0 where a margin is empty."""
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.coalesce(F.try_divide((a + b + c + d) * (a * d - b * c) * (a * d - b * c), margins), F.lit(0.0))


#: What follows a child below it, as four kinds.
KINDS = ("ends", "number", "wildcard", "literal")
#: Labelled URLs below which a branch's own label class isn't told.
LABELLED = 3


def generalised(counts: DataFrame, depth: int) -> DataFrame:
    """The counts (host, first, segs, n, block, allow) with the children at this depth merged.

    A child is compared with the largest child of its node that has the same label class, and
    where its class isn't told with the largest of all.
    """
    node = F.array_join(F.slice("segs", 1, depth - 1), "/")
    after = F.get("segs", F.lit(depth))
    kind = F.when(after.isNull(), "ends").when(after.startswith("{n}"), "number").when(after.startswith("{") | (after == "*"), "wildcard").otherwise("literal")
    rows = counts.withColumn("node", node).withColumn("child", F.get("segs", F.lit(depth - 1)))
    sums = [F.sum("n").alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow")]
    kinds = [F.sum(F.when(kind == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in KINDS]
    shape = [(F.count_distinct(after) > CHILDREN).alias("wide"), (F.sum(F.size("segs") * F.col("n")) / F.sum("n")).alias("deep")]
    children = rows.filter("child is not null").groupBy("host", "node", "child").agg(*sums, *kinds, *shape)
    labelled = F.col("block") + F.col("allow")
    told = F.when(labelled < LABELLED, "unknown").when(F.col("block") >= REJECT * labelled, "block").when(F.col("allow") >= REJECT * labelled, "allow").otherwise("mixed")
    children = children.withColumn("told", told)
    whole = F.struct("n", "child", "block", "allow", *KINDS, "wide", "deep")
    groups = children.groupBy("host", "node", "told").agg(F.count("*").alias("many"), F.sum("n").alias("total"), F.max(F.when(~F.col("child").startswith("{"), whole)).alias("top"))
    # A node has four groups at most.
    nodes = groups.groupBy("host", "node").agg(F.sum("many").alias("many"), F.sum("total").alias("total"), F.max("top").alias("largest"))
    groups = groups.select("host", "node", "told", "top").join(nodes, ["host", "node"]).withColumn("top", F.when(F.col("told") == "unknown", F.col("largest")).otherwise(F.col("top"))).drop("largest")
    both = children.join(groups, ["host", "node", "told"])
    top = lambda name: F.col(f"top.{name}").cast("double")
    below = sum((_pair(F.col(k), top(k), F.col("n").cast("double"), top("n")) for k in KINDS), F.lit(0.0))
    labels = _chi2(F.col("block").cast("double"), F.col("allow").cast("double"), top("block"), top("allow"))
    literal = ~F.col("child").startswith("{")
    # A rare child whose label class is told keeps its name.
    rare = (F.col("many") > CHILDREN) & (F.col("n") < RARE * F.col("total")) & (F.col("told") == "unknown")
    alike = (below < ALIKE_3) & (labels < ALIKE_1) & (F.col("wide") == F.col("top.wide")) & (F.abs(F.col("deep") - F.col("top.deep")) < 0.5)
    merged = F.when(literal & rare, "*").when(literal & alike, F.col("top.child")).otherwise(F.col("child"))
    names = both.select("host", "node", "child", merged.alias("merged")).filter("merged <> child")
    named = rows.join(names, ["host", "node", "child"], "left")
    whole_path = F.when(F.col("merged").isNull(), F.col("segs")).otherwise(F.concat(F.slice("segs", 1, depth - 1), F.array("merged"), F.slice("segs", F.lit(depth + 1), F.size("segs"))))
    return named.select("host", "first", whole_path.alias("segs"), "n", "block", "allow")


def _pair(a: Column, b: Column, n: Column, m: Column) -> Column:
    """One kind's part in the chi-squared statistic of two histograms with n and m entries."""
    share = F.try_divide(a + b, n + m)
    return F.coalesce(F.try_divide((a - n * share) * (a - n * share), n * share), F.lit(0.0)) + F.coalesce(F.try_divide((b - m * share) * (b - m * share), m * share), F.lit(0.0))


def next_branching(counts: DataFrame, depth: int) -> int | None:
    """The least depth beyond this one at which some node has several children; None if there is none.
    Where each node has one child nothing can merge."""
    below = F.explode(F.sequence(F.lit(depth + 1), F.size("segs"))).alias("depth")
    rows = counts.filter(F.size("segs") > depth).select("host", "segs", below)
    node = F.xxhash64("host", "depth", F.slice("segs", F.lit(1), F.col("depth") - 1)).alias("node")
    child = F.xxhash64(F.get("segs", F.col("depth") - 1)).alias("child")
    nodes = rows.select("depth", node, child).groupBy("depth", "node").agg(F.min("child").alias("least"), F.max("child").alias("most"))
    return nodes.filter("least <> most").agg(F.min("depth")).first()[0]


def templates(urls: DataFrame) -> DataFrame:
    """host, first, template, purity of urls (host, path, label): `first` is the template before
    generalising, by which URLs find theirs."""
    first = F.array_join(segments(F.col("path")), "/")
    counts = urls.select("host", first.alias("first"), "label").groupBy("host", "first").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("block"), F.count_if(F.col("label") == "allow").alias("allow"))
    counts = written(counts.withColumn("segs", F.filter(F.split("first", "/"), lambda s: s != "")))
    depth = next_branching(counts, 0)
    while depth is not None:
        counts = written(generalised(counts, depth))
        depth = next_branching(counts, depth)
    template = F.array_join("segs", "/").alias("template")
    keyed = counts.select("host", "first", template, "n", "block", "allow")
    sums = keyed.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    extra = F.lit(EVEN) + F.lit(UNLABELLED) * (F.col("n") - F.col("block") - F.col("allow"))
    purity = (F.col("block") + 0.5 * extra) / (F.col("block") + F.col("allow") + extra)
    return keyed.select("host", "first", "template").join(sums.select("host", "template", purity.alias("purity")), ["host", "template"])


def judge(pages: DataFrame, rules: list[Rule], label_column: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    label = F.col(label_column) if label_column else F.lit(None).cast("string")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), label.alias("given"))
    rows = rows.withColumn("rule", rule_column(rules, F.col("host"), F.col("path")))
    rows = rows.withColumn("label", F.coalesce("given", verdict_column(rules, F.col("rule"))))
    found = templates(rows.select("host", "path", "label"))
    rows = rows.withColumn("first", F.array_join(segments(F.col("path")), "/"))
    by_method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    out = rows.join(found, ["host", "first"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict_column(rules, F.col("rule")), by_method).alias("verdict"), "template", "purity")
