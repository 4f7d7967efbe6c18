"""Connected components of a stored edge table, by smallest label with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """id, comp (the smallest id reachable) for every id in edges (a, b: long).

    Each round takes the smallest label among the neighbours, then the label's own label, and writes the labels to the
    shared folder; rounds go on until no label changes. Labels only fall, and each round at least halves the depth of
    the label trees, so rounds grow with the logarithm of the longest path.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = stored(both.filter("src != dst").distinct(), "edges")
    labels = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "dst", "comp": "c"}), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        above = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        after = stored(hooked.join(above, "comp", "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        labels = after.select("id", "comp")
        if after.filter("old != comp").isEmpty():
            return labels
