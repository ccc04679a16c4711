"""How often every distinct term occurs, and in how many records.

Method: all distinct terms get dense integer ids (a global dictionary, made by
a range sort of the distinct spellings that the map sides leave), every row is
encoded once, and only integers are shuffled: all of a record's ids meet in one
partition, which counts occurrences and presence in arrays over blocks of ids;
the partitions' arrays are summed by range of ids.

Skew: a term may fill a third of all rows; its rows lie with their records. A
record of more than HOT_ROWS rows is spread over SALTS partitions by its rows'
keys; only of such records the (record, id) pairs are shuffled once more, so
that each counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.functions.chars import fold_text, strip_ws
from pagelight.operators.joins import lookup_join
from pagelight.session import pinned

SALTS = 32
#: A record of more rows than this is spread.
HOT_ROWS = 1_000_000
#: Ids in one count array of 1 MB; arrays that a task holds at once.
BLOCK, BLOCKS = 1 << 16, 64


@dataclass(frozen=True)
class TermField:
    """A column to count: its rows, the record they belong to, the name to report.

    key: columns that, with the record, tell a row from others; rows that agree
    in them are the same row stored again and count once. Without a key every
    row counts.
    """

    rows: DataFrame
    column: str
    record: str
    name: str
    is_array: bool = False
    key: tuple[str, ...] = ()


def normal_term(raw: Column) -> Column:
    """NFKC, stripped at both ends, fully case-folded; null where nothing is left.

    The strip comes between the two, but case folding neither makes nor removes
    white space, so it can be done last.
    """
    return F.nullif(strip_ws(fold_text(raw)), F.lit(""))


def _values(fields: Sequence[TermField]) -> DataFrame:
    """(field_name, raw): the fields' values as they stand."""
    parts = [f.rows.select(F.lit(f.name).alias("field_name"), (F.explode(f.column) if f.is_array else F.col(f.column)).alias("raw")) for f in fields]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where("raw is not null")


def dictionary(fields: Sequence[TermField]) -> tuple[DataFrame, DataFrame]:
    """(field_name, term, id) and the same with every raw spelling: ids are dense from 0 in the order of field and term.

    Repeated values are dropped in the map side of the first exchange. The
    sorted ranges are pinned in the shared folder, so an id can't change when a
    task is run again. Only each range's number of terms comes to the driver.
    """
    spelled = _values(fields).distinct().withColumn("term", normal_term(F.col("raw"))).where("term is not null")
    ranged = spelled.repartitionByRange("field_name", "term").sortWithinPartitions("field_name", "term", "raw")

    def number(parts):
        """place: the number of the row's term within its range; a range holds all spellings of its terms."""
        last, place = None, -1
        for part in parts:
            key = part["field_name"].str.cat(part["term"], sep="\0").to_numpy()
            new = np.append(key[:1] != last, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            places = place + np.cumsum(new)
            if len(key):
                last, place = key[-1], int(places[-1])
            yield part.assign(place=places, first=new)

    numbered = ranged.mapInPandas(number, "field_name string, raw string, term string, place long, first boolean")
    numbered = pinned(numbered.withColumn("part", F.spark_partition_id()))
    begin, total = [], 0
    for row in sorted(numbered.where("first").groupBy("part").count().collect()):
        begin.append((row[0], total))
        total += row[1]
    offsets = numbered.sparkSession.createDataFrame(begin or [(0, 0)], "part int, begin long")
    # One row for each range.
    ids = numbered.join(F.broadcast(offsets), "part").withColumn("id", F.col("begin") + F.col("place"))
    return ids.where("first").select("field_name", "term", "id"), ids.select("field_name", "raw", "id")


def _encoded(fields: Sequence[TermField], spelled: DataFrame) -> DataFrame:
    """(source, record, item, pos, id) of every value that is a term; no strings but for keys that are no integers."""
    whole = ("tinyint", "smallint", "int", "bigint")
    plain = all(len(f.key) <= 1 and all(dict(f.rows.dtypes)[k] in whole for k in f.key) for f in fields)
    parts = []
    for number, field in enumerate(fields):
        if not field.key:
            item = F.monotonically_increasing_id()
        else:
            item = F.col(field.key[0]) if plain else F.to_json(F.struct(*field.key))
        value = F.posexplode(field.column) if field.is_array else F.col(field.column)
        names = ["pos", "raw"] if field.is_array else ["raw"]
        rows = field.rows.select(F.lit(number).alias("source"), F.lit(field.name).alias("field_name"), F.col(field.record).cast("long").alias("record"), item.cast("long" if plain else "string").alias("item"), value.alias(*names))
        parts.append(rows if field.is_array else rows.withColumn("pos", F.lit(0)))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    # Broadcast up to a measured size, joined on salted keys beyond it.
    found = lookup_join(rows.where("raw is not null"), spelled, ["field_name", "raw"], "inner")
    return found.select("source", "record", "item", "pos", "id")


def _hot_records(fields: Sequence[TermField]) -> list[tuple[int, int | None]]:
    """(source, record) of more than HOT_ROWS rows: at most the number of all rows over HOT_ROWS."""
    out = []
    for number, field in enumerate(fields):
        weight = F.greatest(F.size(field.column), F.lit(0)) if field.is_array else F.lit(1)
        many = field.rows.groupBy(F.col(field.record).cast("long").alias("record")).agg(F.sum(weight).alias("n")).where(F.col("n") > HOT_ROWS)
        out += [(number, r["record"]) for r in many.select("record").toLocalIterator()]
    return out


def _sums(blocks: dict[int, np.ndarray]) -> pd.DataFrame:
    parts = [(key, np.flatnonzero(counts.any(axis=0)), counts) for key, counts in sorted(blocks.items())]
    return pd.concat([pd.DataFrame({"id": at + key * BLOCK, "n": counts[0, at], "records": counts[1, at]}) for key, at, counts in parts])


def _count_blocks(parts, in_order: bool = False):
    """Sums of n and records by id, in arrays over blocks of ids.

    At most about BLOCKS arrays are held: rows in the order of their blocks give
    one sum for each id, others sums that are to be added once more.
    """
    blocks: dict[int, np.ndarray] = {}
    for rows in parts:
        ids = rows["id"].to_numpy()
        block = ids // BLOCK
        met = np.unique(block)
        if in_order:
            done = {k: blocks.pop(k) for k in list(blocks) if len(met) and k < met[0]}
        else:
            done, blocks = (blocks, {}) if len(blocks) > BLOCKS else ({}, blocks)
        if done:
            yield _sums(done)
        for key in met:
            mine = block == key
            counts = blocks.setdefault(int(key), np.zeros((2, BLOCK), np.int64))
            at = ids[mine] - key * BLOCK
            for row, column in enumerate(("n", "records")):
                counts[row] += np.bincount(at, weights=rows[column].to_numpy()[mine], minlength=BLOCK).astype(np.int64)
    if blocks:
        yield _sums(blocks)


_COUNTS = "id long, n long, records long"


def term_frequencies(fields: Sequence[TermField], rare_records: int = 2, common_share: float = 0.30) -> DataFrame:
    """(field_name, term, n_occurrences, n_records, mark) of every distinct term.

    mark: `rare` for at most rare_records records; else `common` for at least
    common_share of the records that hold any term of the field; else null.
    Null values, null array elements and values that are empty once stripped
    are no terms. A null record id counts as one record of its own. Rows that
    agree in record and key count once. No row gives no row.
    """
    ids, spelled = dictionary(fields)
    hot = _hot_records(fields)
    rows = _encoded(fields, spelled)
    keyed = ["source", "record", "salt"] if hot else ["source", "record"]
    if hot:
        table = F.broadcast(ids.sparkSession.createDataFrame(hot, "source int, record long").withColumn("hot", F.lit(True)))
        on = (rows["source"] == table["source"]) & rows["record"].eqNullSafe(table["record"])
        rows = rows.join(table, on, "left").select(rows["source"], rows["record"], "item", "pos", "id", "hot")
        rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("item"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    # All rows of a record, or of a salt of a hot one, in one partition; what follows needs no other exchange.
    met = rows.repartition(*keyed)
    once = met.groupBy(*keyed, "id", "item", "pos").agg(*([F.max("hot").alias("hot")] if hot else [F.lit(1).alias("hot")])).groupBy(*keyed, "id").agg(F.count(F.lit(1)).alias("n"), F.max("hot").alias("hot"))
    spread = F.col("hot").isNotNull() if hot else F.lit(False)
    counts = once.select("id", "n", F.when(spread, 0).otherwise(1).cast("long").alias("records"))
    partial = counts.mapInPandas(_count_blocks, _COUNTS)
    held = met.select(*keyed).distinct().select("source", "record").distinct() if hot else met.select(*keyed).distinct()
    if hot:
        pairs = once.where("hot is not null").select("source", "record", "id").distinct()
        partial = partial.unionByName(pairs.groupBy("id").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("records")))
    block = (F.col("id") / BLOCK).cast("long")
    summed = partial.repartition(block).sortWithinPartitions(block).mapInPandas(lambda parts: _count_blocks(parts, in_order=True), _COUNTS)
    names = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(i), F.lit(f.name))])
    held = held.groupBy("source").agg(F.count(F.lit(1)).alias("held")).select(names[F.col("source")].alias("field_name"), "held")
    share = F.round(F.lit(common_share) * 1000).cast("long")
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * 1000 >= share * F.col("held"), "common")
    # held has one row per counted column: as many as there are fields.
    found = ids.join(summed, "id").join(F.broadcast(held), "field_name")
    return found.select("field_name", "term", F.col("n").alias("n_occurrences"), F.col("records").alias("n_records"), mark.alias("mark"))
