"""Connected components of a link table, in a few rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_source, materialize


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b) that isn't a root itself.

    The root is the smallest node of the component. Alternates large-star and small-star
    steps; each is a grouped minimum, so a hub costs one row for each task before the
    shuffle, and the join that follows is one that Spark splits if it is skewed. Each
    round is written to the shared folder, which ends its lineage. Null ends, loops and
    repeated links don't matter; no links give no rows.
    """
    edges = materialize(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("hub"), F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("hub")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), "m")
        small = large.join(least, F.col("u") == F.col("hub")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = materialize(small, "small")
        for done in (edges, large):
            drop_source(done)
        edges = small
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
