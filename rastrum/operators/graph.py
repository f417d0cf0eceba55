"""Connected components as repeated joins, with lineage cut through the checkpoint folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import checkpointed


def star_edges(df: DataFrame, node: str, keys: Sequence[str]) -> DataFrame:
    """Edges that join every node sharing a non-blank key to the smallest node of that key.

    One row per (node, key), never the pairs of a group; the hub is found by a map-side combined
    minimum and met again in a join that AQE can split when one key is hot.
    """
    out = None
    for k in keys:
        part = df.select(F.col(node).alias("src"), F.col(k).cast("string").alias("v")).where((F.col("v").isNotNull()) & (F.trim("v") != ""))
        hub = part.groupBy("v").agg(F.min("src").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
        e = part.join(hub, "v").where("src <> dst").select("src", "dst")
        out = e if out is None else out.unionByName(e)
    return out


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node", name: str = "component") -> DataFrame:
    """Label every node with the smallest node it is connected to.

    Each round hooks the current root of a node to the smallest grandparent across its edges and
    then shortcuts every path, so the number of rounds grows with the logarithm of the diameter.
    """
    both = checkpointed(edges.select("src", "dst").where("src <> dst")
                        .unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst")).distinct())
    touched = both.select(F.col("src").alias("id")).distinct()
    # nodes without an edge keep themselves and never enter the loop
    f = checkpointed(touched.select("id", F.col("id").alias("f")))
    while True:
        gp = f.alias("a").join(f.alias("b"), F.col("a.f") == F.col("b.id")).select(
            F.col("a.id").alias("id"), F.col("a.f").alias("f"), F.col("b.f").alias("g"))
        near = (both.join(gp.select(F.col("id").alias("dst"), "g"), "dst").groupBy("src").agg(F.min("g").alias("m")))
        step = gp.join(near, gp["id"] == near["src"]).select("id", "f", "g", "m")
        # both proposals of a row at once: a union would plan and run the joins twice
        proposals = step.select(F.explode(F.array(F.struct(F.col("id").alias("x"), F.least("g", "m").alias("y")), F.struct(F.col("f").alias("x"), F.col("m").alias("y")))).alias("p")).select("p.*")
        best = proposals.groupBy("x").agg(F.min("y").alias("y"))
        new = checkpointed(f.join(best, f["id"] == best["x"]).select("id", F.least("f", "y").alias("f"), F.col("f").alias("old")))
        changed = not new.where("f <> old").limit(1).isEmpty()
        f = new.select("id", "f")
        if not changed:
            break
    return (nodes.join(f.withColumnRenamed("id", node), node, "left")
            .withColumn(name, F.coalesce("f", F.col(node))).drop("f"))
