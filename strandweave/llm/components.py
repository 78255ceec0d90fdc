"""Connected components of a link table, by alternating star contraction.

Only DataFrame joins and partially aggregated minima: of links and components nothing reaches the driver but
whether another round is needed.  A node with very many links is never gathered in one task: its
minimum is aggregated map-side, and the join that spreads the minimum reads two plain tables, which Spark
can split by skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def _stars(edges: DataFrame, work: Workspace, name: str, rows: int) -> DataFrame:
    """(u, m): the least of u and its neighbours."""
    return work.table(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name, rows)


def components(links: DataFrame, work: Workspace, tag: str = "cc") -> DataFrame:
    """From ``links`` (a, b) the table (node, root) of every linked node; root is the component's least node.

    Self links and nulls are ignored; repeated links are harmless; no links give an empty table.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, turn = work.table(pairs, f"{tag}-0"), 0
    rows = 2 * edges.count()  # contraction never adds edges
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_stars(both, work, f"{tag}-l{turn}", rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.table(large, f"{tag}-a{turn}", rows)
        low = _stars(large, work, f"{tag}-s{turn}", rows)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        edges = work.table(small, f"{tag}-{turn}", rows)
        work.drop(f"{tag}-{turn - 1}", f"{tag}-l{turn}", f"{tag}-a{turn}", f"{tag}-s{turn}")
        several = edges.groupBy("u").count().where("count > 1").select("u").limit(1)
        chained = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").limit(1)
        if several.unionByName(chained).isEmpty():  # every node points at one root, and no root points on
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
