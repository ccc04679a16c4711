"""Percentiles of very large numeric columns with a bounded relative error.

Method: values are counted in signed logarithmic buckets of a fixed relative
width. Counts of one bucket add up across partitions, days or runs, so any set
of days is answered from the days' counts alone, within the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATIVE_ERROR = 0.005
#: Percentiles that are reported unless others are asked for.
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
# Below this magnitude a value counts as zero; the buckets stay a bounded number.
SMALLEST = 1e-12
# Separates the exponents of either sign: no double's exponent comes near it.
SHIFT = 1 << 20


def bucket(value: Column, relative_error: float = RELATIVE_ERROR) -> Column:
    """The signed bucket as an int that sorts as the values do; 0 holds zero.

    Values of one bucket lie within a factor (1 + e) / (1 - e) of each other.
    """
    width = math.log((1 + relative_error) / (1 - relative_error))
    step = F.ceil(F.log(F.abs(value)) / F.lit(width)).cast("int")
    return F.when(F.abs(value) < SMALLEST, F.lit(0)).otherwise(F.signum(value).cast("int") * (step + F.lit(SHIFT)))


def bucket_value(index: Column, relative_error: float = RELATIVE_ERROR) -> Column:
    """The value that is within relative_error of everything in the bucket."""
    growth = (1 + relative_error) / (1 - relative_error)
    size = F.pow(F.lit(growth), (F.abs(index) - F.lit(SHIFT)).cast("double")) * F.lit(2 / (growth + 1))
    return F.when(index == 0, F.lit(0.0)).otherwise(F.signum(index.cast("double")) * size)


def log_counts(df: DataFrame, groups: Sequence[str], value: str, relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """(groups, bucket, n). Null, NaN and infinite values are not counted; a null
    group is a group. Partial counts are made before the exchange."""
    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return df.where(finite).groupBy(*groups, bucket(number, relative_error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds the counts of matching buckets over everything but groups."""
    return counts.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], wanted: Sequence[float] = PERCENTILES, relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """(groups, n, p.., rel_error): one row per group.

    Each percentile q is within rel_error, relatively, of the value at rank
    ceil(q/100 * n) of the sorted values. A group's window holds its buckets
    (some thousands at most, whatever the number of values), never its values.
    """
    by = Window.partitionBy(*groups)
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(by))
    found = [F.min(F.when(F.col("upto") * 10000 >= F.col("all") * int(round(q * 100)), F.col("bucket"))).alias(_name(q)) for q in wanted]
    rows = ranked.groupBy(*groups).agg(F.max("all").alias("n"), *found)
    return rows.select(*groups, "n", *[bucket_value(F.col(_name(q)), relative_error).alias(_name(q)) for q in wanted], F.lit(relative_error).alias("rel_error"))


def _name(q: float) -> str:
    return f"p{q:02g}".replace(".", "_")
