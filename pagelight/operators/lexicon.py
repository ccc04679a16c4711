"""Word and phrase dictionaries: keyed tables with several translations.

Adding, merging and replacing entries is an aggregation over an ordered log of
entries, so a dictionary of any size is built in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.config import TranslationSettings
from pagelight.functions.chars import strip_ws
from pagelight.operators.joins import lookup_join
from pagelight.operators.tokens import bounded_lemmas, lemmatize, normalized_tokens, with_tokens
from pagelight.session import pinned


def clean_translations(column: Column) -> Column:
    """Stripped, without nulls and empty ones, first occurrences kept in order; null for none."""
    parts = F.array_distinct(F.filter(F.transform(column, strip_ws), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(parts) > 0, parts)


def keyed_entries(entries: DataFrame, source: str, settings: TranslationSettings = TranslationSettings(), lemmas: DataFrame | None = None) -> DataFrame:
    """entries(ord, source, translations, replace) with the stripped source, its tokens and clean translations.

    ord must be unique: it is the order in which entries were added.
    """
    rows = entries.select("ord", strip_ws(F.col(source)).alias(source), clean_translations(F.col("translations")).alias("translations"), F.coalesce("replace", F.lit(False)).alias("replace"))
    forms = bounded_lemmas(lemmas) if lemmas is not None and settings.lemmatize_words else {}
    if forms is not None:
        # One pass in which all columns ride along.
        return with_tokens(rows, source, settings, lemmas=forms)
    flat = lemmatize(with_tokens(rows, source, settings).select("ord", F.inline("tokens")), lemmas)
    tokens = flat.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "normalized", "start_char", "end_char", "token_type"))).alias("tokens"))
    return rows.join(tokens, "ord", "left")


def word_errors(keyed: DataFrame, source: str) -> DataFrame:
    """keyed with error: why an entry is no word entry; null for a good one."""
    one = (F.size("tokens") == 1) & (F.col("tokens")[0]["token_type"] == "word") & (F.char_length(source) == F.col("tokens")[0]["end_char"]) & (F.col("tokens")[0]["start_char"] == 0)
    error = F.when(F.col(source).isNull() | (F.col(source) == ""), "empty_word").when(~F.coalesce(one, F.lit(False)), "not_one_word").when(F.col("translations").isNull(), "no_translation")
    return keyed.withColumn("error", error)


def phrase_errors(keyed: DataFrame, source: str, settings: TranslationSettings = TranslationSettings()) -> DataFrame:
    """keyed with error: why an entry is no phrase entry; null for a good one."""
    count = F.coalesce(F.size("tokens"), F.lit(0))
    error = F.when(F.col(source).isNull() | (F.col(source) == ""), "empty_phrase").when(count < 2, "too_short").when(count > settings.max_phrase_tokens, "too_long").when(F.col("translations").isNull(), "no_translation")
    return keyed.withColumn("error", error)


def merge_entries(keyed: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, translations): the dictionary after all entries in the order of ord.

    A replacing entry drops what came before it; another one keeps the first
    source and appends the translations that are new. Only a key's entries meet
    in one task; the same translation of a key is kept once before they do.
    """
    # Only keys that were replaced; a key may hold a third of all entries.
    last = keyed.where("replace").groupBy(key).agg(F.max("ord").alias("_last"))
    live = lookup_join(keyed, last, [key]).where(F.col("_last").isNull() | (F.col("ord") >= F.col("_last")))
    head = live.groupBy(key).agg(F.min_by(source, "ord").alias(source))
    each = live.select(key, "ord", F.posexplode("translations").alias("pos", "translation")).groupBy(key, "translation").agg(F.min(F.struct("ord", "pos")).alias("first"))
    merged = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "translation"))), lambda x: x["translation"]).alias("translations"))
    return head.join(merged, key)


def word_lexicon(entries: DataFrame, settings: TranslationSettings = TranslationSettings(), lemmas: DataFrame | None = None, source: str = "word") -> DataFrame:
    """(normalized, word, translations) of entries(ord, word, translations, replace).

    Entries that are no single word or have no translation are left out; see
    word_errors for them.
    """
    good = word_errors(keyed_entries(entries, source, settings, lemmas), source).where("error is null")
    return merge_entries(pinned(good.withColumn("normalized", F.col("tokens")[0]["normalized"]).drop("tokens", "error")), "normalized", source)


def phrase_lexicon(entries: DataFrame, settings: TranslationSettings = TranslationSettings(), lemmas: DataFrame | None = None, source: str = "phrase") -> DataFrame:
    """(normalized_tokens, phrase, translations) of entries(ord, phrase, translations, replace)."""
    good = phrase_errors(keyed_entries(entries, source, settings, lemmas), source, settings).where("error is null")
    return merge_entries(pinned(good.withColumn("normalized_tokens", F.transform("tokens", lambda t: t["normalized"])).drop("tokens", "error")), "normalized_tokens", source)


def contains_words(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, present): is each word's normal form in the lexicon?"""
    asked = words.select(F.col(word).alias("asked"), F.col(word).alias("text")).where("asked is not null").distinct()
    one = F.when(F.size("tokens") == 1, F.col("tokens")[0]["normalized"])
    tokens = normalized_tokens(asked, "asked", "text").select(F.col("asked").alias(word), one.alias("normalized"))
    return tokens.join(lexicon.select("normalized", F.lit(True).alias("present")), "normalized", "left").select(word, F.coalesce("present", F.lit(False)).alias("present"))


def get_phrases(phrases: DataFrame, lexicon: DataFrame, phrase: str = "phrase", settings: TranslationSettings = TranslationSettings()) -> DataFrame:
    """(phrase, translations, present): what the lexicon has for each distinct phrase, by its normal tokens; an empty array for none."""
    asked = phrases.select(phrase).where(F.col(phrase).isNotNull()).distinct()
    tokens = with_tokens(asked, phrase, settings).select(phrase, F.transform("tokens", lambda t: t["normalized"]).alias("normalized_tokens"))
    found = lookup_join(tokens, lexicon.select("normalized_tokens", "translations"), ["normalized_tokens"])
    return found.select(phrase, F.coalesce("translations", F.array().cast("array<string>")).alias("translations"), F.col("translations").isNotNull().alias("present"))
