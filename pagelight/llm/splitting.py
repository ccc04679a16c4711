"""Cutting oversized texts at natural boundaries, with an overlap.

Method: every boundary of a text gets its farthest legal successor (the cut of
the piece that begins behind it, the overlap included), found for all
boundaries at once; the successor table is then squared again and again
(pointer doubling), so that all cuts of all texts of a batch come out in
log2(pieces) vector steps instead of a walk along each text.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.session import spread

LIMIT, OVERLAP = 5000, 200
# The best kind of boundary is taken that lies in the last (1 - KEEP) of a piece.
KEEP = 0.5

_SENTENCE = re.compile(r"""[.!?…][\])}"'”’»›]*(?=\s)\s*|[。！？｡।॥؟۔]+[\])}"'”’»›」』）】]*\s*|\n\s*""")
_SPACE = re.compile(r"\s+")


def boundaries(text: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end, ascending, and each one's rank.

    Rank 2: a sentence or a line ends; 1: between words; 0: inside a word longer
    than `longest`, but never before a combining mark. The text's end is one.
    """
    rank = {m.end(): 1 for m in _SPACE.finditer(text)}
    rank |= {m.end(): 2 for m in _SENTENCE.finditer(text)}
    rank[len(text)] = 2
    before = 0
    for at in sorted(rank):
        forced = before + longest
        while forced < at:
            while forced < at and unicodedata.category(text[forced])[0] == "M" and forced < before + 2 * longest:
                forced += 1
            if forced < at:
                rank.setdefault(forced, 0)
            forced += longest
        before = at
    rank.pop(0, None)
    places = np.array(sorted(rank), np.int64)
    return places, np.array([rank[x] for x in places.tolist()], np.int8)


def _reached(successor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All nodes on the chains from first; the last node of a chain follows itself."""
    reached = np.zeros(len(successor), bool)
    reached[first] = True
    while True:
        reached[successor[np.flatnonzero(reached)]] = True
        squared = successor[successor]
        if np.array_equal(squared, successor):
            return reached
        successor = squared


def split_batch(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int]]]:
    """(begin, end) of each piece of each text. One empty piece for an empty text.

    Each piece has at most `limit` code points; it begins at a word's begin at
    most `overlap` before the end of the piece before it; together they hold the
    whole text.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    out: list[list[tuple[int, int]]] = [[(0, len(x))] for x in texts]
    long = [i for i, x in enumerate(texts) if len(x) > limit]
    if not long:
        return out
    # All long texts lie on one axis, a gap of more than `limit` between two.
    base, at, rank, owner, ends, cursor = [], [], [], [], [], 0
    for k, i in enumerate(long):
        places, kinds = boundaries(texts[i], max(1, limit // 5))
        base.append(cursor)
        at += [np.array([cursor]), places + cursor]
        rank += [np.array([2], np.int8), kinds]
        owner.append(np.full(len(places) + 1, k))
        ends.append(cursor + len(texts[i]))
        cursor += len(texts[i]) + limit + 1
    at, rank, owner = np.concatenate(at), np.concatenate(rank), np.concatenate(owner)
    base, ends = np.array(base), np.array(ends)
    first = np.searchsorted(at, base)
    # Where the piece after a cut begins: the first word's begin in the overlap, else the cut.
    words = np.flatnonzero(rank >= 1)
    begin = at[words[np.minimum(np.searchsorted(at[words], np.maximum(at - overlap, base[owner])), len(words) - 1)]]
    begin = np.where((begin <= at) & (at > base[owner]), begin, at)
    reach = begin + limit
    successor = np.full(len(at), -1)
    for least, share in ((2, KEEP), (1, KEEP), (0, 0.0)):
        some = np.flatnonzero(rank >= least)
        far = some[np.searchsorted(at[some], reach, side="right") - 1]
        good = (successor < 0) & (at[far] > np.maximum(at, begin + share * limit)) & (owner[far] == owner)
        successor[good] = far[good]
    last = np.searchsorted(at, ends)
    near = reach >= ends[owner]
    successor[near] = last[owner[near]]
    if (successor < 0).any():
        raise AssertionError("a boundary without successor")
    reached = np.flatnonzero(_reached(successor, first))
    for k, i in enumerate(long):
        cuts = reached[owner[reached] == k]
        out[i] = [(int(begin[a] - base[k]), int(at[b] - base[k])) for a, b in zip(cuts, cuts[1:])]
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, start_char, end_char, piece) of every row's text.

    Offsets are code points. A text within the limit is one piece; an empty text
    is one empty piece, a null text none. Boundaries are sought only in texts
    beyond the limit. Repeated rows give repeated pieces. Only the two named
    columns are read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                keys, texts = some.column(0), some.column(1).to_pylist()
                row, number, count, start, end, piece = [], [], [], [], [], []
                for i, pieces in enumerate(split_batch(texts, limit, overlap)):
                    for n, (a, b) in enumerate(pieces):
                        row.append(i)
                        number.append(n)
                        count.append(len(pieces))
                        start.append(a)
                        end.append(b)
                        piece.append(texts[i] if len(pieces) == 1 else texts[i][a:b])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in (number, count, start, end)), pa.array(piece, pa.string())],
                    [key, "piece_no", "n_pieces", "start_char", "end_char", "piece"],
                )

    return spread(df.select(key, text).where(F.col(text).isNotNull())).mapInArrow(run, f"`{key}` {kind}, piece_no int, n_pieces int, start_char int, end_char int, piece string")
