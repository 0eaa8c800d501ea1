"""Places in an order, over a whole table or by group, without a task that sees all rows of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.scratch import Tables


def ranked(df: DataFrame, order: list[Column], rank: str, tables: Tables, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank``: 1 for the first row in ``order``, 2 for the next, and so on; over the whole table, or anew
    for each value of the columns ``by`` (nulls are one value). Rows that the order holds for equal get ranks of their
    own."""
    return summed(df, order, F.lit(1).cast("long"), rank, tables, by)


def summed(df: DataFrame, order: list[Column], value: Column, out: str, tables: Tables, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of the integer ``value`` over the rows up to this one in ``order``, over the whole
    table or by group.

    Rows are dealt by ranges of group and order and written, so that a second reading finds the same ranges, which are
    also the order in which the result's partitions are written. A row's sum is that of its range and that of its group
    before the range. What is added up apart is a row for each range that a group goes on in: no more than there are
    ranges.
    """
    by, held = by or [], "leafmill_range"
    if by:
        dealt = df.repartitionByRange(*by, *order)
    else:
        dealt = df.repartitionByRange(*order)
    dealt = tables.save(dealt.withColumn(held, F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*by).orderBy(held).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*by, held).agg(F.sum(value).alias("leafmill_sum")).withColumn("leafmill_before", F.sum("leafmill_sum").over(earlier))
    # a group that a range begins has none before it
    going_on = tables.save(sizes.where("leafmill_before is not null").select(*(F.col(c).alias(f"leafmill_{c}") for c in by), F.col(held).alias("leafmill_in"), "leafmill_before"), "offsets")
    same = F.col(held) == F.col("leafmill_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"leafmill_{c}"))
    upto = Window.partitionBy(*by, held).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = dealt.withColumn("leafmill_here", F.sum(value).over(upto)).join(F.broadcast(going_on), same, "left")
    return here.withColumn(out, (F.col("leafmill_here") + F.coalesce("leafmill_before", F.lit(0))).cast("long")).select(*df.columns, out)
