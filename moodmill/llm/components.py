"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import discard
from moodmill.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is its least node.

    Every round hangs the neighbours of a node on the least of them, and is stored. Minima
    are aggregated before they meet, and no list of neighbours is ever built. It ends when
    a round changes nothing: then every edge leads to the least node of its component.
    """
    edges = materialize(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u AND v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        before_large, edges = edges, materialize(large, "edges")
        discard(before_large)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            edges.join(least, "u")
            .select(F.inline(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))))
            .where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        before_small, edges = edges, materialize(small, "edges")
        discard(before_small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
