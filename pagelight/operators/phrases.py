"""Phrases in token sequences: one pass with few phrases, or an n-gram join and then the leftmost longest ones."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.config import TranslationSettings
from pagelight.operators.joins import bounded_rows, lookup_join
from pagelight.operators.tokens import normalized_tokens, text_pass, tokens_of

JOIN = "\u0001"


def phrase_candidates(tokens: DataFrame, phrases: DataFrame, key: str, settings: TranslationSettings = TranslationSettings(), lengths: Sequence[int] | None = None) -> DataFrame:
    """(key, start_idx, n, normalized_tokens): every place where a phrase stands.

    tokens has one row for each text (see normalized_tokens). Only n-grams of
    lengths that phrases have are formed; they are joined with the phrases
    before anything is shuffled, if the phrases are few enough to broadcast.
    Punctuation between tokens doesn't matter.
    """
    wanted = sorted(lengths if lengths is not None else [r[0] for r in phrases.select(F.size("normalized_tokens").alias("n")).where(f"n between 2 and {settings.max_phrase_tokens}").distinct().collect()])
    spark = tokens.sparkSession
    if not wanted:
        return spark.createDataFrame([], f"`{key}` {tokens.schema[key].dataType.simpleString()}, start_idx int, n int, normalized_tokens array<string>")
    words = F.transform("tokens", lambda t: t["normalized"])
    none = F.array().cast("array<struct<start_idx:int,n:int,gram:string>>")

    def grams_of(n: int):
        def gram(i):
            return F.struct(i.alias("start_idx"), F.lit(n).alias("n"), F.array_join(F.slice("words", i + 1, n), JOIN).alias("gram"))

        return F.when(F.col("count") >= n, F.transform(F.sequence(F.lit(0), F.col("count") - n), gram)).otherwise(none)

    rows = tokens.select(key, words.alias("words")).withColumn("count", F.size("words")).select(key, F.inline(F.concat(*map(grams_of, wanted))))
    table = phrases.select(F.array_join("normalized_tokens", JOIN).alias("gram"), "normalized_tokens").dropDuplicates(["gram"])
    return lookup_join(rows, table, ["gram"], "inner").select(key, "start_idx", "n", "normalized_tokens")


def match_at(candidates: DataFrame, key: str, settings: TranslationSettings = TranslationSettings()) -> DataFrame:
    """(key, start_idx, n): of the phrases that start at a token the longest one, or the shortest if the settings say so."""
    best = F.max("n") if settings.longest_match_first else F.min("n")
    return candidates.groupBy(key, "start_idx").agg(best.alias("n"))


def greedy_matches(candidates: DataFrame, key: str, settings: TranslationSettings = TranslationSettings()) -> DataFrame:
    """(key, start_idx, end_idx): matches from left to right; behind a match the search goes on at its end.

    One pass over each text's sorted candidates, not over its tokens.
    """
    spans = match_at(candidates, key, settings).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_idx", "n"))).alias("spans"))
    spans = spans.select(key, F.transform("spans", lambda x: x["start_idx"]).alias("starts"), F.transform("spans", lambda x: x["n"]).alias("sizes"))
    kind = spans.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, begin, end = [], [], []
            for i, (starts, sizes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                free = 0
                for start, n in zip(starts, sizes):
                    if start >= free:
                        free = start + n
                        row.append(i)
                        begin.append(start)
                        end.append(free)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], [key, "start_idx", "end_idx"])

    return spans.mapInArrow(run, f"`{key}` {kind}, start_idx int, end_idx int")


class PhraseTable:
    """A phrase dictionary small enough to be sent to all tasks: for each first token its phrases, longest first (or shortest)."""

    def __init__(self, rows: list, settings: TranslationSettings):
        self.by_first: dict[str, list[tuple[tuple[str, ...], list[str]]]] = {}
        for row in rows:
            words = tuple(row["normalized_tokens"])
            if 2 <= len(words) <= settings.max_phrase_tokens:
                self.by_first.setdefault(words[0], []).append((words, list(row["translations"])))
        for found in self.by_first.values():
            found.sort(key=lambda x: len(x[0]), reverse=settings.longest_match_first)

    def spans(self, words: list[str]) -> list[tuple[int, int, list[str]]]:
        """(begin, end, translations) from left to right; behind a match the search goes on at its end."""
        out, at = [], 0
        get = self.by_first.get
        while at < len(words):
            for phrase, translations in get(words[at], ()):
                if tuple(words[at : at + len(phrase)]) == phrase:
                    out.append((at, at + len(phrase), translations))
                    at += len(phrase)
                    break
            else:
                at += 1
        return out


def find_in_texts(df: DataFrame, key: str, text: str, phrases: DataFrame, settings: TranslationSettings = TranslationSettings(), limited: bool = True) -> DataFrame:
    """(key, start_idx, end_idx, start_char, end_char, normalized_tokens, translations) of the greedy matches in texts.

    Phrases that are few (see joins.BROADCAST_ROWS) are sent to the tasks and
    the texts passed once; more are joined with n-grams (see find_phrases).
    Texts that break a rule have no matches; the key must be unique for the join.
    """
    few = bounded_rows(phrases.select("normalized_tokens", "translations"))
    names = ["start_idx", "end_idx", "start_char", "end_char", "normalized_tokens", "translations"]
    if few is None:
        found = find_phrases(normalized_tokens(df, key, text, settings, limited), phrases.select("normalized_tokens", "translations"), key, settings)
        return found.select(key, *names)
    table = df.sparkSession.sparkContext.broadcast(PhraseTable(few, settings))

    def find(value):
        tokens = tokens_of(value, settings)
        words = [x[1] for x in tokens]
        return [(a, b, tokens[a][2], tokens[b - 1][3], words[a:b], found) for a, b, found in table.value.spans(words)]

    return text_pass(df, key, text, settings.max_input_characters if limited else None, find, dict(zip(names, [pa.int32()] * 4 + [pa.list_(pa.string())] * 2)))


def find_phrases(tokens: DataFrame, phrases: DataFrame, key: str, settings: TranslationSettings = TranslationSettings()) -> DataFrame:
    """(key, start_idx, end_idx, start_char, end_char, normalized_tokens, phrase, translations) of the greedy matches."""
    spans = greedy_matches(phrase_candidates(tokens, phrases, key, settings), key, settings)
    place = spans.join(tokens, key).select(
        key,
        "start_idx",
        "end_idx",
        F.col("tokens")[F.col("start_idx")]["start_char"].alias("start_char"),
        F.col("tokens")[F.col("end_idx") - 1]["end_char"].alias("end_char"),
        F.transform(F.slice("tokens", F.col("start_idx") + 1, F.col("end_idx") - F.col("start_idx")), lambda t: t["normalized"]).alias("normalized_tokens"),
    )
    return lookup_join(place, phrases, ["normalized_tokens"], "inner")
