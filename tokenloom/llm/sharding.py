"""Contiguous shards of near equal byte size, cut by global prefix sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def global_prefix(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows with `_rank` (position by key, nulls first) and `_start` (sizes before), both global, and `_total`.

    Rows are range-partitioned; each partition's count and total are summed to offsets (as many rows as
    partitions, hence broadcast), and a window inside the partition adds the rest.  Repeated keys are
    parted by row number, so one key may hold any share of the rows."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col(key).asc_nulls_first(), F.col("_row")]
    kept = materialize(numbered.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = kept.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_b"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
        F.sum("_b").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_pid").orderBy(*order)
    return (
        kept.withColumn("_i", F.row_number().over(inside))
        .withColumn("_c", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(F.broadcast(offsets), "_pid")
        .withColumn("_rank", F.col("_n0") + F.col("_i") - 1)
        .withColumn("_start", F.col("_b0") + F.col("_c") - F.col(size))
        .drop("_pid", "_row", "_n0", "_b0", "_i", "_c")
    )


def balanced_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", per_row: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Documents stand in order of id (null first; rows with one id keep the order of the scan).  A document
    goes to the shard in whose equal share of all bytes its middle byte falls, so shards are contiguous and
    each differs from total / n_shards by less than one document.  A null text counts no bytes, but per_row.
    An empty table gives no rows; other columns are not looked at."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(per_row)).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = global_prefix(rows, "doc_id", "size")
    middle: Column = F.expr(f"((2 * _start + size) * {int(n_shards)}L) div greatest(2 * _total, 1)")
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
