"""URL filters: written rules first, then a tree of path templates for each host.

Paths of a host form a tree of segments. A segment that looks like an identifier
becomes a wildcard at once. Going down the tree, a node's children are compared
with their siblings by the labels of their URLs (the verdicts of the rules): a
child stays a branch of its own if its share of blocked URLs differs from its
siblings' by a two-proportion test; all others are merged into one wildcard
branch, however rare or many. The leaves of the merged tree are templates, as
deep as the paths are. A template is rejected if its smoothed share of blocked
labels reaches the bound; without labels it only has the prior, and passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landflux.llm.store import Store, other_columns, sets_aside

Z = 2.58  # for the test between a child and its siblings
LEAST_LABELS = 5  # labelled URLs of a template that may be rejected
SMOOTHING = 4.0  # weight of the prior in labels
REJECT = 0.8  # smoothed share of blocked labels
IDENTIFIER = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:[^0-9.]*[0-9]){4}[^.]*)((?:\.[A-Za-z]{1,5})?)$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/?#``, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits ``host`` and ``path``, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits &= F.col("path").startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """All segments of a path, identifiers replaced by a wildcard with their extension."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(IDENTIFIER), F.regexp_replace(s, IDENTIFIER, "*$1")).otherwise(s))


def _different(bad: Column, all_: Column, other_bad: Column, other_all: Column) -> Column:
    """Whether two shares differ by the two-proportion z test, with one half added to each count."""
    a, b = bad + 0.5, other_bad + 0.5
    n, m = all_ + 1.0, other_all + 1.0
    pooled = (a + b) / (n + m)
    return F.abs(a / n - b / m) > Z * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))


def _branch(segment: Column, apart: Column) -> Column:
    return F.when(apart & ~segment.startswith("*"), segment).otherwise(F.lit("*"))


def templates(urls: DataFrame, store: Store) -> DataFrame:
    """(host, shape, template, purity, n_labels) for every shape in ``urls`` (host, path, verdict).

    One row a distinct shape is carried down the levels; a node's children are
    only ever summed, so a host with a third of all URLs is spread over tasks. A
    round passes the segments that all shapes of a node share, then one level
    where they part: rounds follow the branchings on the way to the deepest
    leaf, not the length of paths.
    """
    bad = (F.col("verdict") == "block").cast("long")
    labelled = F.col("verdict").isNotNull().cast("long")
    counts = [F.sum(c).alias(c) for c in ("bad", "labels")]
    shapes = urls.groupBy("host", "shape").agg(F.sum(F.coalesce(bad, F.lit(0))).alias("bad"), F.sum(labelled).alias("labels"))
    shapes = store.keep(shapes.withColumns({"template": F.lit(""), "level": F.lit(0)}))
    total = shapes.agg(*counts).first()
    prior = ((total.bad or 0) + 1.0) / ((total.labels or 0) + 2.0)
    going = F.size("shape") > F.col("level")
    while not shapes.filter(going).isEmpty():
        rest = F.slice("shape", F.col("level") + 1, F.size("shape"))
        nodes = shapes.filter(going).withColumn("rest", rest).groupBy("host", "template", "level").agg(
            *counts, F.min("rest").alias("least"), F.max("rest").alias("most")
        )
        parted = F.array_position(F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b)), False)
        shared = F.when(parted > 0, parted - 1).otherwise(F.size("least")).cast("int")
        alone = (F.col("labels") > 0) & _different(F.col("bad"), F.col("labels"), F.lit(0), F.lit(0))
        nodes = nodes.withColumns({"shared": shared, "alone": alone})
        passed = F.transform(
            F.slice("least", F.lit(1), F.col("shared")), lambda s: F.concat(F.lit("/"), _branch(s, F.col("alone")))
        )
        nodes = nodes.select("host", "template", "shared", F.array_join(passed, "").alias("passed"))
        found = shapes.withColumn("going", going).join(nodes, ["host", "template"], "left")
        here = store.keep(
            found.select(
                "host", "shape", "bad", "labels",
                F.when(F.col("going"), F.concat("template", "passed")).otherwise(F.col("template")).alias("template"),
                F.when(F.col("going"), F.col("level") + F.col("shared")).otherwise(F.col("level")).alias("level"),
            )
        )
        parting = here.filter(going).withColumn("segment", F.try_element_at("shape", F.col("level") + 1))
        children = store.keep(parting.groupBy("host", "template", "segment").agg(*counts))
        parents = children.groupBy("host", "template").agg(F.sum("bad").alias("all_bad"), F.sum("labels").alias("all_labels"))
        apart = (F.col("labels") > 0) & _different(
            F.col("bad"), F.col("labels"), F.col("all_bad") - F.col("bad"), F.col("all_labels") - F.col("labels")
        )
        judged = children.join(parents, ["host", "template"]).select(
            "host", "template", "segment", _branch(F.col("segment"), apart).alias("branch")
        )
        grown = parting.join(judged, ["host", "template", "segment"]).select(
            "host", "shape", "bad", "labels", F.concat("template", F.lit("/"), "branch").alias("template"),
            (F.col("level") + 1).alias("level"),
        )
        following = store.keep(here.filter(~going).unionByName(grown))
        for done in (shapes, here, children):
            store.drop(done)
        shapes = following
    sums = shapes.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("labels").alias("t_labels"))
    purity = (F.col("t_bad") + SMOOTHING * prior) / (F.col("t_labels") + SMOOTHING)
    return store.keep(
        shapes.join(sums, ["host", "template"]).select(
            "host", "shape", "template", purity.alias("purity"), F.col("t_labels").alias("n_labels")
        )
    )


@sets_aside("_rule", "_shape", "n_labels")
def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """The rows of ``pages`` with host, path, rule, verdict, template and purity.

    A null url or one without ``://`` has empty host and path and is judged like
    any other, by its empty template. Columns named like a result are replaced.
    Equal URLs get equal verdicts; no row is dropped; an empty table stays
    empty. Paths of any depth are told apart to their last segment.
    """
    results = ["host", "path", "rule", "verdict", "template", "purity"]
    own = other_columns(pages, results)
    store = Store(pages.sparkSession, "urls")
    address = F.col(f"`{url}`")
    read = pages.select(*own, host_of(address).alias("host"), path_of(address).alias("path"))
    read = read.withColumn("_rule", matching_rule(rules)).withColumn("_shape", shape(F.col("path")))
    urls = store.keep(read.select("host", F.col("_shape").alias("shape"), F.col("_rule.verdict").alias("verdict")))
    known = templates(urls, store).withColumnRenamed("shape", "_shape")
    judged = read.join(known, ["host", "_shape"], "left")
    rejected = (F.col("n_labels") >= LEAST_LABELS) & (F.col("purity") >= REJECT)
    verdict = F.coalesce("_rule.verdict", F.when(rejected, "block").otherwise("allow"))
    return judged.select(
        *own, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity"
    )
