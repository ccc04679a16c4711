"""Literal dictionary translation with an item for each phrase, word, number and unknown token."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.config import TranslationSettings
from pagelight.operators.joins import bounded_rows, lookup_join
from pagelight.operators.phrases import PhraseTable, find_phrases
from pagelight.operators.tokens import bounded_lemmas, lemmatize, normalized_tokens, text_error, text_pass, tokens_of
from pagelight.session import spread


def display_text(translations: Column, source: Column) -> Column:
    """The first translation, or the source where there is none."""
    return F.coalesce(F.nullif(F.try_element_at(translations, F.lit(1)), F.lit("")), source)


def with_lemmas(tokens: DataFrame, key: str, lemmas: DataFrame) -> DataFrame:
    """Token arrays with lemmas in place of the words' normal forms."""
    flat = lemmatize(tokens.select(key, F.inline("tokens")), lemmas)
    return flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "text", "normalized", "start_char", "end_char", "token_type"))).alias("tokens"))


_ITEM = "source_text string, normalized_tokens array<string>, translations array<string>, item_type string, start_token_index int, end_token_index int, start_char int, end_char int"


def _direct_items(df: DataFrame, key: str, text: str, phrases: list, lemmas: dict[str, str], settings: TranslationSettings, limited: bool) -> DataFrame:
    """Items in one pass over the texts, words not yet looked up: item_type is phrase, number or word."""
    table = df.sparkSession.sparkContext.broadcast((PhraseTable(phrases, settings), lemmas))
    kind = df.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in _ITEM.split(", ")]
    types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), *[pa.int32()] * 4]
    good = text_error(F.col(text), settings.max_input_characters if limited else 2**31 - 1).isNull()

    def run(batches):
        many, lemmas = table.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                at, columns = [], [[] for _ in names]
                for i, value in enumerate(some.column(1).to_pylist()):
                    found = tokens_of(value, settings)
                    words = [lemmas.get(n, n) if k == "word" else n for _, n, _, _, k in found] if lemmas else [x[1] for x in found]
                    place, items = 0, []
                    for begin, end, translations in [*many.spans(words), (len(found), len(found), [])]:
                        items += [(found[k][0], [words[k]], [], found[k][4], k, k + 1, found[k][2], found[k][3]) for k in range(place, begin)]
                        if end > begin:
                            first, last = found[begin][2], found[end - 1][3]
                            items.append((value[first:last], words[begin:end], translations, "phrase", begin, end, first, last))
                        place = end
                    at += [i] * len(items)
                    for column, values in zip(columns, zip(*items)):
                        column += values
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, t) for v, t in zip(columns, types)]], [key, *names])

    return spread(df.select(key, text).where(good)).mapInArrow(run, f"`{key}` {kind}, {_ITEM}")


def _joined_items(df: DataFrame, key: str, text: str, phrases: DataFrame, lemmas: DataFrame | None, settings: TranslationSettings, limited: bool) -> DataFrame:
    """What _direct_items gives, by joins: for phrase or lemma tables beyond what may be broadcast."""
    tokens = normalized_tokens(df, key, text, settings, limited)
    if lemmas is not None:
        tokens = with_lemmas(tokens, key, lemmas)
    spans = find_phrases(tokens, phrases.select("normalized_tokens", "translations"), key, settings)
    found = spans.join(df.select(key, F.col(text).alias("_whole")), key)
    items = found.select(
        key,
        F.expr("substring(_whole, start_char + 1, end_char - start_char)").alias("source_text"),
        "normalized_tokens",
        "translations",
        F.lit("phrase").alias("item_type"),
        F.col("start_idx").alias("start_token_index"),
        F.col("end_idx").alias("end_token_index"),
        "start_char",
        "end_char",
    )
    covered = spans.groupBy(key).agg(F.flatten(F.collect_list(F.sequence("start_idx", F.col("end_idx") - 1))).alias("covered"))
    left = tokens.join(covered, key, "left")
    rest = left.select(key, F.inline(F.when(F.col("covered").isNull(), F.col("tokens")).otherwise(F.filter("tokens", lambda t: ~F.array_contains(F.col("covered"), t["idx"])))))
    single = rest.select(
        key,
        F.col("text").alias("source_text"),
        F.array("normalized").alias("normalized_tokens"),
        F.array().cast("array<string>").alias("translations"),
        F.col("token_type").alias("item_type"),
        F.col("idx").alias("start_token_index"),
        (F.col("idx") + 1).alias("end_token_index"),
        "start_char",
        "end_char",
    )
    return items.unionByName(single)


def translation_items(
    df: DataFrame, key: str, text: str, words: DataFrame, phrases: DataFrame, settings: TranslationSettings = TranslationSettings(), lemmas: DataFrame | None = None, limited: bool = True
) -> DataFrame:
    """(key, source_text, normalized_tokens, translations, item_type, start_token_index, end_token_index, start_char, end_char).

    item_type: phrase for the leftmost longest phrases; of the other tokens
    number, word if the dictionary has it, else unknown. words: (normalized,
    translations); phrases: (normalized_tokens, translations); each key once.
    The key must be unique in df. Texts without tokens have no items.

    Phrases and lemmas that are few (see joins.BROADCAST_ROWS) are sent to the
    tasks and the texts passed once, without any exchange; more are joined.
    """
    used = lemmas if settings.lemmatize_words else None
    few = bounded_rows(phrases.select("normalized_tokens", "translations"))
    forms = bounded_lemmas(used) if used is not None else {}
    if few is not None and forms is not None:
        rows = _direct_items(df, key, text, few, forms, settings, limited)
    else:
        rows = _joined_items(df, key, text, phrases, used, settings, limited)
    single = F.col("item_type") == "word"
    asked = rows.withColumn("normalized", F.when(single, F.col("normalized_tokens")[0]))
    found = lookup_join(asked, words.select("normalized", F.col("translations").alias("_found")), ["normalized"])
    return found.select(
        key,
        "source_text",
        "normalized_tokens",
        F.when(single, F.coalesce("_found", F.array().cast("array<string>"))).otherwise(F.col("translations")).alias("translations"),
        F.when(single & F.col("_found").isNull(), "unknown").otherwise(F.col("item_type")).alias("item_type"),
        "start_token_index",
        "end_token_index",
        "start_char",
        "end_char",
    )


def literal_translation(items: DataFrame, key: str) -> DataFrame:
    """(key, literal_translation): the items' display texts in order, a space between two."""
    shown = items.select(key, "start_token_index", display_text(F.col("translations"), F.col("source_text")).alias("shown"))
    ordered = F.array_sort(F.collect_list(F.struct("start_token_index", "shown")))
    return shown.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["shown"]), " ").alias("literal_translation"))


def translate_texts(
    df: DataFrame, key: str, text: str, words: DataFrame, phrases: DataFrame, settings: TranslationSettings = TranslationSettings(), lemmas: DataFrame | None = None, limited: bool = True
) -> DataFrame:
    """(key, literal_translation) of every text that has a token; see translation_items.

    With words, phrases and lemmas that are few the texts are passed once and
    nothing is exchanged; else the items are made, joined and gathered.
    """
    used = lemmas if settings.lemmatize_words else None
    first = display_text(F.col("translations"), F.lit(None).cast("string"))
    shown = bounded_rows(words.select("normalized", first.alias("shown")).where("shown is not null"))
    few = bounded_rows(phrases.select("normalized_tokens", "translations"))
    forms = bounded_lemmas(used) if used is not None else {}
    if shown is None or few is None or forms is None:
        return literal_translation(translation_items(df, key, text, words, phrases, settings, lemmas, limited), key)
    table = df.sparkSession.sparkContext.broadcast((PhraseTable(few, settings), forms, {r["normalized"]: r["shown"] for r in shown}))

    def find(value):
        many, forms, known = table.value
        found = tokens_of(value, settings)
        if not found:
            return []
        normal = [forms.get(n, n) if k == "word" else n for _, n, _, _, k in found] if forms else [x[1] for x in found]
        place, out = 0, []
        for begin, end, translations in [*many.spans(normal), (len(found), len(found), [])]:
            out += [known.get(normal[k], found[k][0]) if found[k][4] == "word" else found[k][0] for k in range(place, begin)]
            if end > begin:
                out.append(translations[0] if translations and translations[0] else value[found[begin][2] : found[end - 1][3]])
            place = end
        return [(" ".join(out),)]

    return text_pass(df, key, text, settings.max_input_characters if limited else None, find, {"literal_translation": pa.string()})


def translate_words(df: DataFrame, key: str, word: str, words: DataFrame, settings: TranslationSettings = TranslationSettings()) -> DataFrame:
    """(key, normalized, translations, item_type, error) of single words or numbers.

    error is not_one_token where the text is not exactly one token.
    """
    tokens = normalized_tokens(df, key, word, settings)
    joined = df.select(key, F.col(word).alias("_word")).join(tokens, key, "left")
    token = F.col("tokens")[0]
    one = F.coalesce((F.size("tokens") == 1) & (token["start_char"] == 0) & (token["end_char"] == F.char_length("_word")), F.lit(False))
    rows = joined.select(key, F.when(one, token["normalized"]).alias("normalized"), F.when(one, token["token_type"]).alias("token_type"), F.when(~one, F.lit("not_one_token")).alias("error"))
    found = lookup_join(rows, words.select("normalized", "translations"), ["normalized"])
    number = F.col("token_type") == "number"
    kind = F.when(F.col("error").isNotNull(), F.lit(None)).when(number, "number").when(F.col("translations").isNull(), "unknown").otherwise("word")
    return found.select(key, "normalized", F.when(~number & F.col("translations").isNotNull(), F.col("translations")).otherwise(F.array().cast("array<string>")).alias("translations"), kind.alias("item_type"), "error")
