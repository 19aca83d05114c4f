"""Global row numbers without a single-task window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from noticeflow.sources.scratch import stage

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def number_rows(df, order, name="no"):
    """Number rows from 1 in `order`, which must be total.

    Rows are range-partitioned and sorted once and written with their place in their
    partition.  What remains is one offset per partition: the only table that is
    broadcast, and its rows are bounded by the number of partitions.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.col("_offset") + F.col("_place").bitwiseAND(F.lit(_LOCAL_MASK)) + 1
    return numbered.select(number.cast("bigint").alias(name), *df.columns)
