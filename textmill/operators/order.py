"""Numbers and running sums over a whole order, without one task for the whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.sources.tables import scratch_dir


def in_ranges(rows: DataFrame, order: list[str], group: tuple[str, ...] = ()) -> DataFrame:
    """rows as a table with __part and __id: the range of group and order that a row lies in, and a number that
    rises with its place. A group of any size is many ranges. Equal places go in any order, the same
    wherever the table is read."""
    keys = [F.col(c) for c in (*group, *order)]
    path = scratch_dir(rows.sparkSession, "ordered")
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())  # many equal places needn't be in one range
    placed = tied.repartitionByRange(*keys, F.col("__tie")).sortWithinPartitions(*keys, "__tie").drop("__tie")
    placed = placed.withColumn("__id", F.monotonically_increasing_id())  # partition and place within it
    placed.write.parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path).withColumn("__part", F.shiftright("__id", 33))


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str, group: tuple[str, ...] = (), least: str | None = None) -> DataFrame:
    """rows with `name`: the sum of value from the first row of the group (of all rows without one) to this one;
    with `least`, also the least of these sums so far.

    The rows are dealt in ranges of the order, so each range is summed by a task of its own. A range's sum and
    its least running sum are all that the ranges behind it need: both combine in order, so a prefix over one
    row for each range and group in it gives what each range starts from. Null groups are one group.
    """
    placed = in_ranges(rows.withColumn("__v", value), order, group)
    inside = Window.partitionBy("__part", *group).orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumn("__own", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    if least:
        here = here.withColumn("__low", F.min("__own").over(inside))
    whole = F.coalesce(F.sum("__v"), F.lit(0)).alias("__sum")
    if least:  # the least running sum of a range needs the rows' own sums
        ranges = here.groupBy("__part", *group).agg(whole, F.min("__own").alias("__min"))
    else:
        ranges = placed.groupBy("__part", *group).agg(whole)
    ranges = ranges.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    bases = ["__base"]
    if least:
        ranges = ranges.withColumn("__before", F.min(F.col("__base") + F.col("__min")).over(before))
        bases.append("__before")
    ranges = ranges.select("__part", *group, *bases).alias("b")
    here = here.alias("a")
    same = F.col("a.__part") == F.col("b.__part")
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    added = [(F.col("__own") + F.col("__base")).alias(name)]
    if least:
        added.append(F.least(F.col("__base") + F.col("__low"), F.col("__before")).alias(least))
    return here.join(ranges, same).select(*(F.col(f"a.{c}") for c in rows.columns), *added)


def numbered(rows: DataFrame, order: list[str], name: str = "number", group: tuple[str, ...] = ()) -> DataFrame:
    """rows with their number from 1 in the order, within the group if one is given."""
    return running_sum(rows, order, F.lit(1).cast("long"), name, group)


def reverse_order(rows: DataFrame, pos: str, name: str = "place") -> DataFrame:
    """rows with their place from 1 when read from the last one to the first."""
    falling = rows.withColumn("__down", -F.col(pos))
    return numbered(falling, ["__down"], name).drop("__down")
