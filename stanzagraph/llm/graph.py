"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzagraph.llm.common import STAGED, discard, staged

#: Far more rounds than the logarithm of any graph's size asks for.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b long) reaches.

    Alternates large-star and small-star rounds: every node is linked to the smallest of
    its neighbours until each component is a star. Each round's links are written to the
    shared folder, so lineage stays one round long; the links never reach the driver.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    known = None
    for _ in range(MOST_ROUNDS):
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), F.least("v", "m").alias("m"))
        # large-star: neighbours above a node go to its least neighbour
        large = both.filter("u > v").join(least, F.col("v") == F.col("w")).select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        # small-star: a node and its neighbours below it go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w")
        small = large.join(low, F.col("v") == F.col("w")).select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("v <> u").distinct()
        now = staged(small, "links")
        discard(now.sparkSession, STAGED[-2:-1])
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError(f"components are not stars after {MOST_ROUNDS} rounds")
    roots = now.select("u").distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots.select("u", "u"))
