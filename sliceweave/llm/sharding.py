"""Proportional stratified interleaving: shards that all hold the mixture of sources.

Rows are shuffled by a seeded digest within each source and ranked; row r of n gets the fraction (r + 1/2) / n. Ordered
by this fraction the sources interleave in proportion, so equal cuts of the whole order all match the mixture. Only
DataFrame functions are used. Both rankings sort by range, so no source, however large, lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.llm.common import stored


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Global position of every row from 0, in ``order``, by range partitions.

    Partition and row number are taken after a sort by range and written down, so they stay fixed when an executor is
    lost. One count per partition is carried forward; that table has as many rows as there are partitions.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "order")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def interleave(df: DataFrame, shards: int, seed: int = 0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``id_column``, ``source``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``shard`` and ``slot``.

    The law is ``rows``: shard sizes differ by one at most, and each source's share of a shard differs from its share
    of all rows by rounding only. A null text has size 1 and the checksum of the empty text. A null source is a source
    of its own. Null ids and equal rows each get a slot; which of two equal rows comes first makes no difference.
    Fewer rows than shards leave shards empty; an empty table gives an empty result. Other columns are left out.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")))
    ties = [F.col("id"), F.col("text_crc32"), F.col("size")]
    ranked = numbered(rows, [F.col("source"), F.col("draw"), *ties], "_rank")
    sources = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first")).withColumnRenamed("source", "_source")
    ranked = ranked.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    fraction = (2 * (F.col("_rank") - F.col("_first")) + 1) / (2 * F.col("_n"))
    ranked = ranked.withColumn("fraction", fraction).drop("_rank", "_first", "_n", "_source")
    placed = numbered(ranked, [F.col("fraction"), F.col("source"), F.col("draw"), *ties], "_position")
    total = placed.agg(F.count(F.lit(1)).alias("_total"))
    # shard s begins at ceil(s * total / shards)
    shard = F.expr(f"(_position * {shards}L) div _total")
    begin = F.expr(f"((shard * _total) + {shards - 1}L) div {shards}L")
    return (placed.join(F.broadcast(total)).withColumn("shard", shard)
            .select(F.col("id").alias(id_column), "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_position") - begin).alias("slot")))
