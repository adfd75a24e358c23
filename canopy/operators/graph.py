"""Closures and chains over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import cut
from .metrics import running


def closure(edges: DataFrame, most: int = 100) -> DataFrame:
    """(child, ancestor, depth): all pairs reachable, with the least depth. edges: child, parent.

    Paths double in length each round, so a chain of n edges takes log2(n) rounds; cycles end because a pair keeps its least depth. Rounds are written to the shared folder.
    """
    e = edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).filter("child is not null and parent is not null").distinct()
    known, known_before, n = e, None, -1
    for _ in range(most):
        far = known.alias("a").join(known.alias("b").hint("merge"), F.col("a.ancestor") == F.col("b.child")).select("a.child", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        known = known.unionByName(far.filter("child != ancestor")).groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))
        known = cut(known, known_before) if known_before is not None else cut(known)
        known_before = known
        m = known.agg(F.count("*"), F.sum("depth")).first()
        if m == n:
            return known
        n = m
    return known


def resolve_chains(links: DataFrame) -> DataFrame:
    """(name, target): the end of each chain name -> to; links: name, to (one per name). Chains that run into a cycle keep their first link."""
    c = closure(links.select(F.col("name").alias("child"), F.col("to").alias("parent")))
    ends = c.join(links.select(F.col("name").alias("ancestor")).hint("merge"), "ancestor", "left_anti").select(F.col("child").alias("name"), F.col("ancestor").alias("target"))
    return links.join(ends.hint("merge"), "name", "left").select("name", F.coalesce("target", "to").alias("target"))


def generic_rollup(support: DataFrame, links: DataFrame) -> DataFrame:
    """(node, clips): distinct clips of each node and of all that are below it. support: node, clip; links: child, parent."""
    up = support.join(closure(links).select(F.col("child").alias("node"), "ancestor").hint("merge"), "node").select(F.col("ancestor").alias("node"), "clip")
    return support.select("node", "clip").unionByName(up).groupBy("node").agg(F.countDistinct("clip").alias("clips"))


def nearest_admitted(links: DataFrame, admitted: DataFrame) -> DataFrame:
    """(node, parent): the nearest ancestor that is admitted. admitted: node."""
    c = closure(links).join(admitted.select(F.col("node").alias("ancestor")).hint("merge"), "ancestor", "left_semi")
    return c.groupBy(F.col("child").alias("node")).agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("parent"))


def generic_ancestors(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): ancestors of a root (node), too generic to be classes."""
    return closure(links).join(roots.select(F.col("node").alias("child")).hint("merge"), "child", "left_semi").select(F.col("ancestor").alias("node")).distinct()


def deepest_root(links: DataFrame, roots: DataFrame, override: dict | None = None) -> DataFrame:
    """(node, root): the root among a node and its ancestors that lies deepest, ties by name; `override` wins. roots: node, depth."""
    c = closure(links).select(F.col("child").alias("node"), F.col("ancestor").alias("root"))
    every = links.select(F.col("child").alias("node")).unionByName(links.select(F.col("parent").alias("node"))).distinct()
    self_ = every.select("node", F.col("node").alias("root"))
    hit = c.unionByName(self_).join(roots.select(F.col("node").alias("root"), "depth").hint("merge"), "root").groupBy("node").agg(F.min_by("root", F.struct(-F.col("depth"), "root")).alias("root"))
    if override:
        m = F.create_map(*[F.lit(x) for kv in override.items() for x in kv])
        hit = hit.withColumn("root", F.coalesce(F.element_at(m, F.col("node")), F.col("root")))
    return hit


def class_support(labels: DataFrame, links: DataFrame, least: int = 20) -> DataFrame:
    """(node, clips, idx): classes and ancestors with at least `least` distinct clips, numbered by name. labels: node, clip. Numbers are counted inside ranges of names, then shifted by the ranges before."""
    r = generic_rollup(labels, links).filter(F.col("clips") >= least).withColumn("one", F.lit(1))
    return running(r, [], [F.col("node")], {"idx": "one"}).select("node", "clips", (F.col("idx") - 1).alias("idx"))
