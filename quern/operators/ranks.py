"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import Scratch


def global_rank(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Number all rows 1..n by ``order`` in column ``name``.

    Rows are range-partitioned by the order and numbered inside each partition; the
    partitions' offsets, one row each, are joined back.  No task sees more than its
    range.  ``order`` must be total for a repeatable numbering of unequal rows.
    """
    pid, local, offset = (f"__{name}_{x}" for x in ("pid", "local", "offset"))
    ranged = df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id())
    ranged = scratch.cut(ranged, "ranged")
    local_rank = ranged.withColumn(local, F.row_number().over(Window.partitionBy(pid).orderBy(*order)))
    sizes = ranged.groupBy(pid).count()
    # one row for each partition: as many as the session has shuffle partitions
    before = sizes.withColumn(offset, F.coalesce(F.sum("count").over(
        Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(pid, offset)
    return (
        local_rank.join(F.broadcast(before), pid)
        .withColumn(name, F.col(local) + F.col(offset))
        .drop(pid, local, offset)
    )
