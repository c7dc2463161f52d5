"""Connected components of a link table by label propagation with shortcuts.

Labels and links stay distributed; every round writes its labels to the shared checkpoint folder, and
only the number of changed labels comes to the driver.  Minima are summed map-side, so a node with very
many links is not one task's group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over links, for every node that has one."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = stored(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("m"))
                    .select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = (edges.join(labels, F.col("v") == F.col("node")).groupBy("u")
                .agg(F.min("component").alias("near")))
        own = (labels.join(near, F.col("node") == F.col("u"), "left")
               .select("node", F.col("component").alias("old"),
                       F.least("component", F.coalesce("near", "component")).alias("new")))
        own = stored(own)
        # what any member of a component has found holds for the component, and so does what the
        # found label's own component has found
        moved = own.groupBy(F.col("old").alias("root")).agg(F.min("new").alias("to")).filter("to < root")
        moved = stored(moved)
        if moved.isEmpty():
            return own.select("node", F.col("new").alias("component"))
        second = moved.select(F.col("root").alias("root2"), F.col("to").alias("to2"))
        hop = (moved.join(second, F.col("to") == F.col("root2"), "left")
               .select("root", F.least("to", F.coalesce("to2", "to")).alias("to")))
        labels = stored(own.join(hop, F.col("old") == F.col("root"), "left")
                        .select("node", F.least("new", F.coalesce("to", "new")).alias("component")))
