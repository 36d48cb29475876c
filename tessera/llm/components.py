"""Connected components of an edge table, entirely in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


#: Rows of two numbers.
SMALL = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id in edges (a, b): comp is the smallest id that links reach.

    A round hands labels to neighbours and then follows the label's label, so that
    chains shorten to less than half; it is one plan with one cut. Rounds end when no label
    changes. Loops and repeated edges do no harm. Up to SMALL labels are broadcast, more are joined by their keys.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = edges.select("a").union(edges.select(F.col("b").alias("a")))
    sym = cut(both.union(ends.select("a", F.col("a").alias("b"))).distinct())
    labels = sym.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("comp"))

    labels = cut(labels)
    small = labels.limit(SMALL + 1).count() <= SMALL
    side = F.broadcast if small else lambda df: df

    def hook(labels: DataFrame) -> DataFrame:
        return sym.join(side(labels.withColumnRenamed("id", "a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("comp"))

    while True:
        hop = labels.select(F.col("id").alias("c"), F.col("comp").alias("far"))
        far = hook(labels).withColumnRenamed("comp", "c").join(side(hop), "c").select("id", F.least("c", "far").alias("comp"))
        new = cut(far.join(side(labels.withColumnRenamed("comp", "old")), "id"))
        labels = new.select("id", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels
