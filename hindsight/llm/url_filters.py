"""URL filters: fixed host rules, and a path-template tree that is judged by labelled purity.

The tree is built from aggregated shapes, not from pages:

1. A path's segments that are variable by form (numbers, hexadecimal and very long ones) become
   ``*``; a file extension stays. Pages are counted by host and resulting shape, with their labels.
2. Level by level, the segments below a node (host and template so far) are compared. Branches
   whose share of bad labels does not differ significantly from all branches of the node are merged
   into the wildcard branch; only those that do differ stay on their own. A node with many and rare
   segments is variable: there the rare ones are merged, too. This goes on to the end of every
   path; a shape that is alone in its node is done, as nothing below it can merge.
3. A template's purity is its share of good labels, smoothed towards its host's, and that towards
   the share of all labels. Templates below ``MIN_PURITY`` are rejected.

Counts are partial aggregates, and decisions come back by joins whose right side is unique, so a
host with a third of all pages is split between tasks.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written

#: A node with more branches than this, on average seen less than ``RARE`` times, is variable: only
#: branches that are seen at least that often can stay on their own.
FAN_OUT = 16
RARE = 4
#: Standard deviations by which a branch has to differ to stay on its own.
DIFFERENT = 1.96
#: Labels that the smoothing counts for.
SMOOTHING = 8.0
MIN_PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits: its host or a subdomain, and its path's start."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The path's segments with those that are variable by form generalised."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(segment: Column) -> Column:
        extension = F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0)
        stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
        variable = stem.rlike(r"^[0-9_.-]*[0-9][0-9_.-]*$") | stem.rlike(r"^[0-9a-fA-F-]{16,}$") | (F.length(stem) > 64)
        return F.when(variable, F.concat(F.lit("*"), extension)).otherwise(segment)

    return F.transform(segments, general)


def _templates(shapes: DataFrame) -> DataFrame:
    """``(host, shape, template)``: each shape with its place in the tree."""
    spark, folder = shapes.sparkSession, shared_path(shapes.sparkSession, "templates")
    tree = written(shapes.withColumn("template", F.lit("")).withColumn("done", F.lit(False)), "shapes")
    schema, level = tree.schema, 0
    while not tree.isEmpty():
        segment = F.get("shape", F.lit(level))
        tree = tree.withColumn("segment", F.coalesce(segment, F.lit("")))
        branches = tree.groupBy("host", "template", "segment").agg(
            F.count("*").alias("shapes"), *[F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]
        )
        nodes = branches.groupBy("host", "template").agg(
            F.count("*").alias("branches"),
            *[F.sum(c).alias(f"all_{c}") for c in ("shapes", "pages", "labelled", "bad")],
        )
        share = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
        spread = F.sqrt(F.col("labelled") * share * (1 - share))
        differs = (F.col("labelled") > 0) & (F.abs(F.col("bad") - F.col("labelled") * share) > DIFFERENT * spread)
        variable = (F.col("branches") > FAN_OUT) & (F.col("all_pages") < RARE * F.col("branches"))
        own = (F.col("segment") == "") | (F.col("branches") == 1) | (differs & (~variable | (F.col("pages") >= RARE)))
        decided = branches.join(nodes, ["host", "template"]).select(
            "host",
            "template",
            "segment",
            F.when(own, F.col("segment")).otherwise("*").alias("kept"),
            (F.col("all_shapes") == 1).alias("alone"),
        )
        step = F.when(F.col("kept") == "", "").otherwise(F.concat(F.lit("/"), "kept"))
        below = F.slice("shape", level + 1, F.greatest(F.size("shape") - level, F.lit(0)))
        whole = F.array_join(F.transform(below, lambda s: F.concat(F.lit("/"), s)), "")
        tree = (
            tree.join(decided, ["host", "template", "segment"])
            .withColumn("template", F.concat("template", F.when(F.col("alone"), whole).otherwise(step)))
            .withColumn("done", F.col("alone") | (F.size("shape") <= level + 1))
        )
        # Each level refers to the one above several times: written, the plan stays small.
        path = f"{folder}/level={level}"
        tree.select(*schema.names).write.parquet(path)
        tree = spark.read.schema(schema).parquet(path).where("not done")
        level += 1
    if not level:
        return tree
    return spark.read.schema(schema).parquet(folder).where("done").select(*schema.names)


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` for each row of ``pages``.

    ``pages`` has ``page_id`` and ``url``. ``labels`` has ``page_id`` and ``bad`` (boolean); several
    labels of one page count as bad if any is, null ones not at all. The verdict is the rule's, else
    ``block`` for rejected templates and ``allow`` for others. Null urls and those without ``://``
    have an empty host and path and share a template. Repeated rows each get their row; without any
    labels nothing is rejected. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    judged = labels.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = pages.select("page_id", "url").select(F.col("page_id"), host.alias("host"), path.alias("path"))
    seen = urls.join(judged, "page_id", "left")
    shapes = (
        seen.withColumn("shape", shape_of(F.col("path")))
        .groupBy("host", "shape")
        .agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    )
    tree = _templates(shapes)

    def counts(*by: str) -> DataFrame:
        return tree.groupBy(*by).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))

    def smoothed(towards: Column) -> Column:
        return (F.col("labelled") - F.col("bad") + SMOOTHING * towards) / (F.col("labelled") + SMOOTHING)

    total, bad = judged.agg(F.count("*"), F.count_if("bad")).first()
    overall = F.lit((total - bad + 1) / (total + 1))
    by_host = counts("host").select("host", smoothed(overall).alias("host_purity"))
    purity = counts("host", "template").join(by_host, "host").select(
        "host", "template", smoothed(F.col("host_purity")).alias("purity")
    )
    by_shape = tree.select("host", "shape", "template").join(purity, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        urls.withColumn("shape", shape_of(F.col("path")))
        .join(by_shape, ["host", "shape"], "left")
        .select(
            "page_id",
            "host",
            "path",
            rule.alias("rule"),
            F.coalesce(verdict, F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")).alias("verdict"),
            "template",
            "purity",
        )
    )
