"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

_LOW = (1 << 33) - 1


def with_place(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """rows with each one's place, from 0, in the order of some columns; equal rows in any order.

    Rows are sorted by ranges and written, so that places are fixed; a range starts where those before it end. One row
    a range is broadcast: as many as the session has shuffle partitions."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    fixed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    starts = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"))
    placed = fixed.join(F.broadcast(starts), part == F.col("_part"))
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_at", "_part", "_start")


def with_neighbours(placed: DataFrame, reach: int, chunk: int, name: str = "place") -> DataFrame:
    """placed rows dealt to chunks of `chunk` consecutive places (column chunk), each with the `reach` rows before and
    after it, which are not its own (column own). All chunks are of one size, whatever the keys are."""
    c, at = F.floor(F.col(name) / chunk), F.col(name) % chunk
    here = F.array(F.lit(0), F.when(at >= chunk - reach, F.lit(1)), F.when(at < reach, F.lit(-1)))
    out = placed.withColumn("_to", F.explode(F.filter(here, lambda d: d.isNotNull())))
    return out.withColumns({"chunk": (c + F.col("_to")).cast("long"), "own": F.col("_to") == 0}).drop("_to")
