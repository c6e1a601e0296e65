"""Connected components by large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def components(edges: DataFrame) -> DataFrame:
    """h, root of the nodes of edges (h, root), root being the least node that h hangs together with.

    Large-star and small-star by turns until nothing changes; each round is written to the shared folder."""
    now = materialize(edges.where("h != root").select(F.greatest("h", "root").alias("h"), F.least("h", "root").alias("root")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("h", "root")), F.sum(F.xxhash64("root", "h").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("root", "h").toDF("h", "root"))
        least = materialize(both.groupBy("h").agg(F.least("h", F.min("root")).alias("_m"), F.count(F.lit(1)).alias("_n")), "least")
        large = join_hot(both.where("root > h"), least, "h", "_n").select(F.col("root").alias("h"), F.col("_m").alias("root")).where("h != root").distinct()
        large = materialize(large, "large-star")
        smallest = materialize(large.groupBy("h").agg(F.min("root").alias("_m"), F.count(F.lit(1)).alias("_n")), "smallest")
        down = join_hot(large, smallest, "h", "_n").select(F.col("root").alias("h"), F.col("_m").alias("root")).where("h != root")
        small = materialize(down.union(smallest.select("h", F.col("_m").alias("root"))).distinct(), "small-star")
        found = mark(small)
        now = small
        if found == seen:
            break
        seen = found
    return now
