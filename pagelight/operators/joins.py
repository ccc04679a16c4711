"""Joins with dictionaries: broadcast only what has been measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of at most this many rows is sent to all tasks.
BROADCAST_ROWS = 200_000
SALTS = 16


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """rows joined with a lookup table that has each key once.

    The table is counted (no further than the bound) and broadcast if it is
    small. Beyond that both sides are shuffled, the keys of rows salted, so that
    a key that holds a third of all rows is spread over SALTS tasks. The salt is
    a hash of the row and not random, so that a task run again gives the same.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), list(on), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, k in rows.dtypes if not k.startswith("map")]), F.lit(SALTS)).cast("int"))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")


def bounded_rows(table: DataFrame, most: int = BROADCAST_ROWS) -> list | None:
    """The table's rows if there are at most `most`, else None; no more than one above that are ever fetched."""
    rows = table.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def once_each(df: DataFrame, key: str) -> DataFrame:
    """The rows of a table of files, of repeated keys the first one only; rows without a key all stay.

    Only keys and places are exchanged: the keys that stand more than once are
    looked up, so that the rows' other columns, texts say, stay where they are.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = df.withColumn("_place", place)
    repeated = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")).where("_n > 1").select(key, "_first")
    return lookup_join(rows, repeated, [key]).where(F.col("_first").isNull() | (F.col("_place") == F.col("_first"))).select(df.columns)
