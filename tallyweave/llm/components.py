"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node (``root``) of every ``node`` that has an edge (``src``, ``dst``).

    Large-star and small-star steps (Kiveris and others, 2014) alternate until the edges no
    longer change; then every component is a star around its smallest node. Minima are
    aggregated before the shuffle and joined back, so a node with very many neighbours is
    no single group. Every round is written to the shared folder. Self-loops are ignored;
    no edges give no rows.
    """
    now = stored(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # every larger neighbour of a node goes to the smallest of the node and its neighbours
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.where(F.col("dst") > F.col("src")).join(low, "src")
        large = large.select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # every smaller neighbour, and the node itself, goes to the smallest one
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        small = small.unionByName(low.withColumnRenamed("low", "dst"))
        now = stored(small.where(F.col("src") != F.col("dst")).distinct(), "edges")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())
