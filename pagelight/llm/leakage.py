"""Evaluation passages inside training texts.

Method: the word n-grams of a test passage are the seeds that lead from a
document to candidate items, each with the weight of its rarity in the whole
corpus, so that rare ones decide; a Smith-Waterman alignment of document and passage then scores
what the document holds. N-grams are three words of four in a row, with and
without a gap, so that seeds survive where every third word is changed. A jump
of any length costs the same in the alignment, so that a passage copied in a
few pieces is one alignment; it keeps rows of scores only, for all candidates
of a batch at once.

The test items are a stated query set: they are taken in blocks of WORDS words,
each block is sent to all tasks (its size is bounded by that) and the documents
are passed once to count and once to search; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.sentences import sentences
from pagelight.session import spread

#: Words of a seed, and their places in it; words of the test passages of one block.
GRAM, SHAPES, WORDS = 3, ((0, 1, 2), (0, 1, 3), (0, 2, 3)), 2_000_000
#: A candidate has this share of the weight of an item's seeds, and this many of them at least.
SEED_SHARE, LEAST_SEEDS = 0.15, 4
#: Share of the passage's words that a document must hold, changed ones included; share of them that must be equal; share of equal ones among those paired.
HELD, SAME, EQUAL = 0.5, 0.45, 0.62
#: First or last sentences of this share of all items (three at least) are standard frames, a word of them left open.
FRAME = 0.02
MATCH, MISMATCH, GAP, JUMP = 2, -3, -4, 14
#: A score, the number of pairs and of equal ones are one number, 21 bits each for the last two; passages have fewer than 2^20 words.
SCORE, PAIR = 1 << 42, 1 << 21
#: Words around n-grams of the passage that are aligned; n-grams that must stand together for it, within as many words: a piece worth a JUMP has more.
REACH, CLOSE, WITHIN = 40, 3, 24
#: Scores of one row of a batch of alignments.
CELLS = 1 << 15
#: Bits of the table that sorts out most n-grams that no passage has.
FILTER = 22

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=\w)[-‐¬­][ \t\r]*\n\s*(?=[^\W\d_])")
_SOFT = re.compile("[­​‌‍⁠﻿]")
_CUES = re.compile(r"^\s*(?:\d+\s*\n\s*)?\d{1,2}:\d\d(?::\d\d)?[,.]\d+\s*-->.*$|<[^<>\n]+>|&(?:[a-z]{2,6}|#\d+);", re.M | re.I)


def words_of(text: str) -> list[str]:
    """Case-folded words; mark-up, subtitle cues and breaks at line ends are taken out."""
    if "-\n" in text or "-\r" in text or "- \n" in text or not text.isascii():
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _SOFT.sub("", text)
    if "<" in text or "-->" in text or "&" in text:
        text = _CUES.sub(" ", text)
    return _WORD.findall(text.casefold())


def _frame_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of each item's outer sentences: their words with one left open."""
    for part in parts:
        out = []
        for item, text in zip(part["eval_id"], part["text"]):
            spans = sentences(text or "")
            for place, span in (("first", spans[:1]), ("last", spans[-1:] if len(spans) > 1 else [])):
                for a, b in span:
                    found = words_of(text[a:b])
                    for k in range(len(found)):
                        out.append((item, place, a if place == "last" else b, " ".join([*found[:k], "*", *found[k + 1 :]])))
        yield pd.DataFrame(out, columns=["eval_id", "place", "at", "key"])


def passages(items: DataFrame) -> DataFrame:
    """(eval_id, passage): each item's text without the standard instruction before and question behind it.

    An instruction or question is standard if, a word left open, it is the first
    or last sentence of many items. Repeated items count once; null texts go.
    """
    rows = items.select(F.col("eval_id").cast("long").alias("eval_id"), "text").where("eval_id is not null and text is not null").dropDuplicates(["eval_id"])
    keys = rows.mapInPandas(_frame_keys, "eval_id long, place string, at int, key string")
    usual = keys.groupBy("place", "key").agg(F.countDistinct("eval_id").alias("n"))
    # One number, of the items.
    least = rows.agg(F.greatest(F.lit(3), F.ceil(F.count(F.lit(1)) * FRAME)).alias("least"))
    usual = usual.crossJoin(F.broadcast(least)).where("n >= least").select("place", "key")
    cut = keys.join(usual, ["place", "key"]).groupBy("eval_id").agg(F.max(F.when(F.col("place") == "first", F.col("at"))).alias("begin"), F.min(F.when(F.col("place") == "last", F.col("at"))).alias("end"))
    begin, end = F.coalesce("begin", F.lit(0)), F.coalesce("end", F.length("text"))
    return rows.join(cut, "eval_id", "left").select("eval_id", F.when(end > begin, F.substring("text", begin + 1, end - begin)).otherwise(F.col("text")).alias("passage"))


@dataclass
class ItemBlock:
    """Test passages as word ids, their n-grams, and which items have each."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    grams: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    seeds: np.ndarray | None = None
    needed: np.ndarray | None = None
    least: np.ndarray | None = None
    filter: np.ndarray | None = None
    #: Each item's n-grams in order, one item behind the other, and where each begins.
    of_item: np.ndarray | None = None
    first: np.ndarray | None = None

    def codes(self, found: np.ndarray) -> np.ndarray:
        """(shape, place): a code of each n-gram, -1 where a word is in no passage or the text ends."""
        size = len(self.vocabulary) + 1
        out = np.full((len(SHAPES), len(found)), -1, np.int64)
        for row, shape in enumerate(SHAPES):
            many = len(found) - shape[-1]
            if many > 0:
                code = np.full(many, row, np.int64)
                known = np.ones(many, bool)
                for k in shape:
                    part = found[k : many + k]
                    code = code * size + part + 1
                    known &= part >= 0
                out[row, :many] = np.where(known, code, -1)
        return out

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of the texts in a row, a foreign word behind each; where each one begins, and the end."""
        words: list[str] = []
        begin = [0]
        for text in texts:
            words += words_of(text)
            words.append("")
            begin.append(len(words))
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words)), np.array(begin)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids_of the texts; and of each n-gram of a passage in them: its place, its text's number, the gram."""
        found, begin = self.ids_of(texts)
        codes = self.codes(found)
        at, gram = [], []
        for row in codes:
            places, held = self.held(row)
            at.append(places)
            gram.append(held)
        at, gram = np.concatenate(at), np.concatenate(gram)
        order = np.argsort(at, kind="stable")
        at, gram = at[order], gram[order]
        return found, begin, at, np.searchsorted(begin, at, side="right") - 1, gram

    def held(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose n-gram is in some passage, and its place among the grams."""
        if not len(codes) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        likely = np.flatnonzero(self.filter[_slot(codes)] & (codes >= 0))
        place = np.minimum(np.searchsorted(self.grams, codes[likely]), len(self.grams) - 1)
        good = self.grams[place] == codes[likely]
        return likely[good], place[good]


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER)).astype(np.int64)


def item_block(rows: list) -> ItemBlock:
    vocabulary: dict[str, int] = {}
    ids, texts = [], []
    for row in rows:
        found = words_of(row["passage"] or "")
        if len(found) >= GRAM:
            ids.append(row["eval_id"])
            texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], np.int64))
    block = ItemBlock(ids, texts, vocabulary, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    codes = [np.unique(c[c >= 0]) for c in map(block.codes, texts)]
    if codes:
        flat, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.lexsort((owner, flat))
        block.grams, first = np.unique(flat[order], return_index=True)
        block.starts, block.owners = np.append(first, len(flat)), owner[order]
        block.of_item = np.repeat(np.arange(len(first)), np.diff(block.starts))[np.argsort(block.owners, kind="stable")]
        block.first = np.append(0, np.cumsum(np.bincount(block.owners, minlength=len(ids))))
        block.filter = np.zeros(1 << FILTER, bool)
        block.filter[_slot(block.grams)] = True
    return block


def choose_seeds(block: ItemBlock, frequency: np.ndarray, documents: int) -> None:
    """Gives each n-gram its weight: the logarithm of how rare it is among the documents.

    Rarity weighs and nothing is cut off by rank or limit: an item whose passage
    is copied into a third of the corpus keeps all seeds, of one weight, and so
    does whatever part or edited form of a passage is copied. N-grams that no
    document holds are no seeds.
    """
    block.seeds = np.where(frequency > 0, np.log1p(documents / np.maximum(frequency, 1)), 0.0)
    weight = np.repeat(block.seeds, np.diff(block.starts))
    block.needed = SEED_SHARE * np.bincount(block.owners, weights=weight, minlength=len(block.ids))
    block.least = np.minimum(LEAST_SEEDS, np.bincount(block.owners, weights=weight > 0, minlength=len(block.ids)))


def aligned_words(passages: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair the words of the passage that the best alignment pairs with a word of the text; how many are equal.

    Pairs within a piece count whether equal or changed. Between two pieces any
    stretch of either may be left out, for JUMP; the order is kept. Of
    alignments of the same score the one of more pairs counts. All pairs are
    aligned row by row of the passages together; only two rows are kept.
    """
    many, n, m = len(texts), max(map(len, passages), default=0), max(map(len, texts), default=0)
    best = np.zeros(many, np.int64)
    if not n or not m:
        return best, best
    # Fillers that equal nothing.
    asked, given = np.full((n, many), -8, np.int64), np.full((many, m), -9, np.int64)
    for k, (a, b) in enumerate(zip(passages, texts)):
        asked[: len(a), k], given[k, : len(b)] = a, b
    down = GAP * SCORE * np.arange(m + 1, dtype=np.int64)
    above, before = np.zeros((many, m + 1), np.int64), np.zeros((many, m + 1), np.int64)
    row = np.zeros((many, m + 1), np.int64)
    for i in range(n):
        inner = row[:, 1:]
        # The best of all cells above and to the left, for a jump.
        np.subtract(before[:, :-1], JUMP * SCORE, out=inner)
        np.maximum(inner, above[:, :-1], out=inner)
        inner += np.where(given == asked[i][:, None], MATCH * SCORE + PAIR + 1, MISMATCH * SCORE + PAIR)
        np.maximum(inner, above[:, 1:] + GAP * SCORE, out=inner)
        row[:, 0] = 0
        np.maximum(row, 0, out=row)
        row -= down
        np.maximum.accumulate(row, axis=1, out=row)
        row += down
        top = np.maximum.accumulate(row, axis=1)
        np.maximum(before, top, out=before)
        np.maximum(best, top[:, -1], out=best, where=asked[i] != -8)
        above, row = row, above
    return best % SCORE // PAIR, best % PAIR


def _near(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words within REACH of the n-grams at; a foreign word stands for each stretch left out."""
    keep = np.zeros(len(found) + 1, np.int64)
    np.add.at(keep, np.maximum(at - REACH, 0), 1)
    np.add.at(keep, np.minimum(at + GRAM + 1 + REACH, len(found)), -1)
    inside = np.cumsum(keep)[:-1] > 0
    out = np.where(inside, found, -2)
    return out[inside | np.append(False, inside[:-1])]


def _candidates(block: ItemBlock, texts: list[str]) -> list[tuple[int, int, np.ndarray]]:
    """(number of the text, item, the words to align) of the texts that hold enough of an item's seeds."""
    found, begin, at, owner, gram = block.hits(texts)
    if not len(at):
        return []
    size, items = len(block.grams), len(block.ids)
    pairs = np.unique(owner * size + gram)
    text, distinct = pairs // size, pairs % size
    first, many = block.starts[distinct], np.diff(block.starts)[distinct]
    place = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    met, which = np.unique(np.repeat(text, many) * items + block.owners[place], return_inverse=True)
    weight = np.bincount(which, weights=np.repeat(block.seeds[distinct], many), minlength=len(met))
    seeds = np.bincount(which, minlength=len(met))
    out = []
    there = np.zeros(len(block.vocabulary) + 2, bool)
    for pair in met[(weight >= block.needed[met % items]) & (seeds >= block.least[met % items])]:
        number, item = divmod(int(pair), items)
        low, high = np.searchsorted(owner, [number, number + 1])
        mine = block.of_item[block.first[item] : block.first[item + 1]]
        mine = mine[np.minimum(np.searchsorted(mine, gram[low:high]), len(mine) - 1)] == gram[low:high]
        places, grams = at[low:high][mine] - begin[number], gram[low:high][mine]
        # Only n-grams that stand together; they must weigh enough by themselves.
        close = np.flatnonzero(places[CLOSE - 1 :] - places[: len(places) - CLOSE + 1] <= WITHIN)
        close = np.unique(close[:, None] + np.arange(CLOSE))
        if block.seeds[np.unique(grams[close])].sum() < block.needed[item]:
            continue
        words = _near(found[begin[number] : begin[number + 1] - 1], places[close])
        # So many of the passage's words must be there to be paired with equal ones.
        there[words] = True
        if there[block.words[item]].sum() >= SAME * len(block.words[item]):
            out.append((number, item, words))
        there[words] = False
    return out


def _search(block: ItemBlock, texts: list[str]) -> list[tuple[int, int, float]]:
    """(number of the text, item, share held) of the texts that hold a passage."""
    asked = []
    for low in range(0, len(texts), 256):
        asked += [(low + number, item, words) for number, item, words in _candidates(block, texts[low : low + 256])]
    # Alignments of about the same size together.
    asked.sort(key=lambda x: (len(x[2]), len(block.words[x[1]])))
    out, low = [], 0
    while low < len(asked):
        high = low + 1
        while high < len(asked) and (high + 1 - low) * (len(asked[high][2]) + 1) <= CELLS:
            high += 1
        some = asked[low:high]
        for (number, item, _), pairs, equal in zip(some, *aligned_words([block.words[x[1]] for x in some], [x[2] for x in some])):
            held = float(pairs) / len(block.words[item])
            if held >= HELD and equal >= max(EQUAL * pairs, SAME * len(block.words[item])):
                out.append((number, block.ids[item], held))
        low = high
    return sorted(out)


def _blocks(rows: Iterator) -> Iterator[list]:
    """Rows of items in blocks of at most WORDS words, or of one item."""
    block, words = [], 0
    for row in rows:
        many = len(row["passage"] or "") // 2 + 1
        if block and words + many > WORDS:
            yield block
            block, words = [], 0
        block.append(row)
        words += many
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, eval_id, held): the items whose passage a document holds to HELD or more of its words.

    Null, empty and blank texts hold nothing, items without GRAM words are
    never found. Repeated documents are searched one by one. Documents are read
    whole; only the two named columns are read.
    """
    spark = documents.sparkSession
    out = None
    kind = documents.schema[key].dataType.simpleString()
    rows = spread(documents.select(key, text).where(F.col(text).isNotNull()))
    many = documents.count()
    # Only a block at a time is held on the driver.
    for some in _blocks(passages(items).orderBy("eval_id").toLocalIterator()):
        found = _find_block(rows, key, kind, spark, item_block(some), many)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"`{key}` {kind}, eval_id long, held double")


def _find_block(rows: DataFrame, key: str, kind: str, spark, block: ItemBlock, documents: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)

    def count(batches):
        block = shared.value
        total = np.zeros(len(block.grams), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                *_, owner, gram = block.hits(batch.column(1).slice(low, 256).to_pylist())
                total += np.bincount(np.unique(owner * len(total) + gram) % max(1, len(total)), minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    # As many numbers as the block has n-grams, whatever the corpus.
    counted = rows.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(block.grams), np.int64)
    frequency[counted["gram"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy()
    choose_seeds(block, frequency, documents)
    ready = spark.sparkContext.broadcast(block)

    def search(batches):
        import pyarrow as pa

        block = ready.value
        for batch in batches:
            found = _search(block, batch.column(1).to_pylist())
            row, item, held = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(held, pa.float64())], [key, "eval_id", "held"])

    return rows.mapInArrow(search, f"`{key}` {kind}, eval_id long, held double")
