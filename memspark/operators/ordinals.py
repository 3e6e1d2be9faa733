"""Positions within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import cut


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """df with out: each row's position from 0 within its group, in the order given, which must tell all rows of a group apart.

    Rows are dealt into ranges of group and order, so a large group is many ranges. Each (group, range) is numbered by itself and
    then moved by how many rows of its group the ranges before it have, a number for each group and range. The ranges are written
    once, so that what is numbered and what is counted are the same rows. Null groups are groups.
    """
    taken = {c.lower() for c in df.columns}
    part, move, count = (next(x for i in range(len(taken) + 1) if (x := f"__{n}{i or ''}") not in taken) for n in ("range", "move", "count"))
    ranges = cut(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    counts = ranges.groupBy(*by, part).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group is in; without groups one for each range
    moves = counts.select(*[F.col(c).alias(f"__{c}_") for c in by], F.col(part).alias(f"{part}_"), F.coalesce(F.sum(count).over(before), F.lit(0)).alias(move))
    at = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)) - 1
    same = F.col(part) == F.col(f"{part}_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}_"))
    return ranges.withColumn(out, at).join(moves, same).withColumn(out, (F.col(out) + F.col(move)).cast("long")).select(*df.columns, out)
