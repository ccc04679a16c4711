"""Edit distance in which swapping two neighbours is one edit (optimal string alignment)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def osa(a: str, b: str) -> int:
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def osa_distance(a: Column, b: Column, most: int = 2) -> Column:
    """The distance if it is at most `most`, else null.

    A swap counts two for the built-in distance, so that one is at most twice as
    large: it sorts out all pairs but the few that Python then measures.
    """
    plain = F.levenshtein(a, b, 2 * most)
    doubtful = (plain >= 2) & (plain <= 2 * most)
    exact = _osa(F.when(doubtful, a), F.when(doubtful, b))
    found = F.when((plain >= 0) & (plain < 2), plain).when(doubtful, exact)
    return F.when(found <= most, found)
