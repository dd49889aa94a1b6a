"""Ordered scans without a task that sees a whole order: rows lie in ranges, and what earlier ranges hold is carried into each.

``in_ranges`` sorts rows into as many ranges of (by, order) as the session has shuffle partitions, and stores them with their range's number.
Numbers, running sums and earlier uses are then window functions within (by, range), plus one row for each (by, range) of what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.sources.storage import stored


def in_ranges(rows: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with part, the number of their range: parts ascend with (by, order)."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *by, *order).withColumn("part", F.spark_partition_id()), "ranges")


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on ``keys`` in which null equals null, as in a grouping."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, same).drop(*(f"_r_{k}" for k in keys))


def carried(parts: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """by, part and for each sum what it is over all earlier parts: no more rows than parts and groups."""
    held = parts.groupBy(*by, "part").agg(*(c.alias(k) for k, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return held.select(*by, "part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums))


def running(parts: DataFrame, by: list[str], order: list[str], number: str, **sums: str) -> DataFrame:
    """``parts`` with ``number``, the place of each row within ``by`` from 1, and the running sum of a column for each of ``sums`` (name=column)."""
    w = Window.partitionBy(*by, "part").orderBy(*order)
    here = parts.withColumn(number, F.row_number().over(w)).withColumns({k: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, c in sums.items()})
    before = carried(parts, by, **{number: F.count("*")}, **{k: F.sum(c) for k, c in sums.items()})
    names = [number, *sums]
    kept = [c for c in here.columns if c not in names]
    return matched(here, before, [*by, "part"]).select(*kept, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in names))


def sizes(parts: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """How many rows each group of ``by`` has."""
    return parts.groupBy(*by).agg(F.count("*").alias(name))


def previous_use(numbered: DataFrame, by: list[str], key: str, number: str) -> DataFrame:
    """``numbered`` (with part) with prev and prev_part: where ``key`` was last before, within ``by``; null the first time.

    A key of very many rows has one row for each range between ranges.
    """
    here = F.lag(number).over(Window.partitionBy(*by, "part", key).orderBy(number))
    found = numbered.withColumn("_here", here)
    over = Window.partitionBy(*by, key).orderBy("part")
    last = numbered.groupBy(*by, key, "part").agg(F.max(number).alias("_last"))
    earlier = last.select(*by, key, "part", F.lag("_last").over(over).alias("_before"), F.lag("part").over(over).alias("_before_part"))
    both = matched(found, earlier, [*by, key, "part"])
    return both.select(*numbered.columns, F.coalesce("_here", "_before").alias("prev"), F.when(F.col("_here").isNotNull(), F.col("part")).otherwise(F.col("_before_part")).alias("prev_part"))
