"""Looking back along the lines of a file without gathering the file in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def last_flagged(rows: DataFrame, file: str, line: str, flag: Column, name: str) -> DataFrame:
    """Adds the number of the last line of the file, this one included, for which flag holds.

    Lines are looked at in blocks of line numbers; what a block hands to the next is one row a block."""
    rows = rows.withColumn("_block", F.floor(F.col(line) / BLOCK)).withColumn("_mark", F.when(flag, F.col(line)))
    before = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(file, "_block")
        .agg(F.max("_mark").alias("_last"))
        .select(file, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    )
    inside = Window.partitionBy(file, "_block").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_here", F.last("_mark", ignorenulls=True).over(inside))
        .join(carry, [file, "_block"])
        .withColumn(name, F.coalesce("_here", "_carried"))
        .drop("_block", "_mark", "_here", "_carried")
    )
