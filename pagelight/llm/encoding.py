"""Encoding of a corpus with a public byte-level tokenizer.

Method: a pair of bytes that stands in no vocabulary entry can never be joined
by a merge, so a cut there is certain. Texts are split at all such pairs, each
fragment is encoded by itself and the ids are put together again. Fragments
recur (they are about a word long), so each worker keeps those it has seen.
"""

from __future__ import annotations

import base64
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelight.session import spread

# Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 400_000


def read_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """256 x 256 table: true where a text may be cut between the two bytes.

    A pair found inside an entry is no cut. The pattern's own context must not
    change either: no cut behind white space (its look-ahead), before an
    apostrophe (contractions), or inside a character.
    """
    cut = np.ones((256, 256), dtype=bool)
    for entry in ranks:
        if len(entry) > 1:
            pairs = np.frombuffer(entry, dtype=np.uint8)
            cut[pairs[:-1], pairs[1:]] = False
    space = [*range(9, 14), *range(28, 33), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]
    cut[space, :] = False
    cut[:, ord("'")] = False
    cut[:, 0x80:0xC0] = False
    return cut


class Known(dict):
    """The ids of each fragment met so far; a new one is encoded."""

    def __init__(self, whole):
        self.whole = whole

    def __missing__(self, fragment: bytes) -> list[int]:
        ids = self.whole.encode_ordinary(fragment.decode())
        if len(fragment) <= 64:
            self[fragment] = ids
        return ids


class Encoder:
    """Encodes batches of UTF-8 texts; made once in each task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.whole = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = certain_cuts(ranks)
        self.known = Known(self.whole)

    def batch(self, buffer: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids.

        buffer holds the texts back to back; ends, where each one ends.
        """
        if not buffer:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        data = np.frombuffer(buffer, dtype=np.uint8)
        at = np.flatnonzero(self.cut[data[:-1], data[1:]]) + 1
        at = np.union1d(at, ends)
        at = at[at > 0]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        stops = at.tolist()
        parts = list(map(self.known.__getitem__, [buffer[i:j] for i, j in zip([0, *stops], stops)]))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter(chain.from_iterable(parts), np.int32, int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        upto = upto[np.searchsorted(at, ends, side="right")]
        return ids, np.diff(upto, prepend=0)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids array<int>) for every row of df; only the two columns are read.

    A null and an empty text both give the empty list; repeated rows and null
    keys are kept as they come. Special tokens are never produced: their
    spelling in a text is ordinary text. Long texts are encoded whole.

    The vocabulary file is read on the driver and sent along once (under 1 MB
    for the public vocabularies, whatever the corpus).
    """
    spark = df.sparkSession
    if os.path.getsize(ranks_path) > 64 << 20:
        raise ValueError("a vocabulary file beyond 64 MB is no public tokenizer's")
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = df.schema[key].dataType

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            if texts.null_count:
                texts = texts.fill_null("")
            texts = texts.cast(pa.large_string())
            for low in range(0, max(1, len(texts)), 512):
                some = texts.slice(low, 512)
                if len(some) == 0:
                    continue
                offsets = np.frombuffer(some.buffers()[1], dtype=np.int64)[some.offset : some.offset + len(some) + 1]
                data = some.buffers()[2]
                buffer = memoryview(data)[offsets[0] : offsets[-1]].tobytes() if data is not None else b""
                ids, sizes = encoder.batch(buffer, offsets[1:] - offsets[0])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 512), lists], [key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")
