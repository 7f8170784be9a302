"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktick.session import discard, materialise


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds; each round is written to the shared folder, so an executor's loss costs one
    round at most. A node's links are only counted down to a minimum before they are joined, so hubs are no single task's work.
    Self-links are allowed and make a component of one node; null ends are dropped; no edges give no rows.
    """
    pairs = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "component-nodes")
    links = materialise(
        pairs.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "component-links",
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32))))
    before = links.agg(mark).first()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        )
        small = large.join(_least(large), "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
            .alias("e")
        ).select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        spent, links = links, materialise(small, "component-links")
        discard(spent)
        after = links.agg(mark).first()
        if after == before:
            break
        before = after
    # Now each node but the roots has one link, to its root.
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"),
    )
