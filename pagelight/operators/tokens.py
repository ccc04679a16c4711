"""Tokens with exact character offsets, and their normal forms.

One Arrow pass over the texts: Python's own tables decide what a letter is, so
results are exact for every script, nothing is shuffled, and the same plan
runs on a stream. Counting queries that need no offsets stay in the JVM (see
``token_texts``).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelight.config import TranslationSettings
from pagelight.functions.chars import APOSTROPHES, ASCII_TOKEN, HYPHENS, TOKEN, WS
from pagelight.operators.joins import bounded_rows, lookup_join
from pagelight.session import spread

# Python's own spelling of the token patterns. [^\W\d_] is what chars.WORD lists.
_WORD = "[^\\W\\d_]+(?:['’\\-‐-‒–—−][^\\W\\d_]+)*"
_TOKENS = re.compile(f"(?P<word>{_WORD})|(?P<number>\\d+(?:[.,:/\\-]\\d+)*)")
_ASCII = re.compile(ASCII_TOKEN)

TOKEN_STRUCT = "struct<idx:int,text:string,normalized:string,start_char:int,end_char:int,token_type:string>"


def text_error(text: Column, limit: int) -> Column:
    """The first rule that a text breaks: null_text, nul_character, too_long; null for a good text."""
    return F.when(text.isNull(), "null_text").when(F.instr(text, "\0") > 0, "nul_character").when(F.char_length(text) > limit, "too_long")


def token_error(token: Column, settings: TranslationSettings = TranslationSettings()) -> Column:
    """The first rule that a single token breaks: null_token, empty_token, white_space, too_long; null for a good one."""
    return (
        F.when(token.isNull(), "null_token")
        .when(token == "", "empty_token")
        .when(token.rlike(f"[{WS}]"), "white_space")
        .when(F.char_length(token) > settings.max_token_characters, "too_long")
    )


def normalize_token(token: str, settings: TranslationSettings = TranslationSettings()) -> str:
    """Unicode form, then apostrophes, hyphens and case; lemmas are looked up afterwards."""
    token = unicodedata.normalize(settings.unicode_normalization, token)
    if settings.normalize_apostrophes:
        for c in APOSTROPHES:
            token = token.replace(c, "'")
    if settings.normalize_hyphens:
        for c in HYPHENS:
            token = token.replace(c, "-")
    return token if settings.case_sensitive else token.casefold()


def tokens_of(text: str, settings: TranslationSettings = TranslationSettings()) -> list[tuple[str, str, int, int, str]]:
    """(text, normalized, start, end, type) of each token that the settings keep."""
    out = []
    known: dict[str, str] = {}
    for m in _TOKENS.finditer(text):
        token = m[0]
        number = m.lastgroup == "number"
        if number and not settings.include_numbers or len(token) > settings.max_token_characters:
            continue
        if not number and len(token) == 1 and not settings.include_single_character_words:
            continue
        normal = known.get(token)
        if normal is None:
            normal = known[token] = normalize_token(token, settings)
        out.append((token, normal, m.start(), m.end(), "number" if number else "word"))
    return out


_SQL = {pa.int32(): "int", pa.string(): "string", pa.list_(pa.string()): "array<string>", pa.bool_(): "boolean"}


def text_pass(df: DataFrame, key: str, text: str, limit: int | None, find, columns: dict[str, pa.DataType], numbered: str | None = None) -> DataFrame:
    """Arrow pass that emits find(text)'s rows of the columns with the row's key; texts that break a rule have none.

    numbered: a first column that numbers a text's rows from 0.
    """
    kind = df.schema[key].dataType.simpleString()
    good = text_error(F.col(text), limit if limit is not None else 2**31 - 1).isNull()
    types = ({numbered: pa.int32()} if numbered else {}) | columns

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                at, number, values = [], [], [[] for _ in columns]
                for i, value in enumerate(some.column(1).to_pylist()):
                    found = find(value)
                    at += [i] * len(found)
                    number += range(len(found))
                    for column, part in zip(values, zip(*found)):
                        column += part
                arrays = [pa.array(v, t) for v, t in zip([number] * bool(numbered) + values, types.values())]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int64())), *arrays], [key, *types])

    schema = ", ".join([f"`{key}` {kind}", *(f"{c} {_SQL[t]}" for c, t in types.items())])
    return spread(df.select(key, text).where(good)).mapInArrow(run, schema)


def tokenize(df: DataFrame, key: str, text: str, settings: TranslationSettings = TranslationSettings(), lemmas: DataFrame | None = None, limited: bool = True) -> DataFrame:
    """(key, idx, text, normalized, start_char, end_char, token_type), a row for each token.

    idx is dense within the text, offsets are code points, the end is exclusive.
    Null texts, texts with NUL and, if limited, texts beyond
    max_input_characters have no tokens (see text_error); an empty text has
    none either. Repeated rows give repeated tokens. lemmas(form, lemma) is
    applied to words only, after case folding; forms it lacks stay.
    """
    columns = {"text": pa.string(), "normalized": pa.string(), "start_char": pa.int32(), "end_char": pa.int32(), "token_type": pa.string()}
    out = text_pass(df, key, text, settings.max_input_characters if limited else None, lambda x: tokens_of(x, settings), columns, "idx")
    return out if lemmas is None or not settings.lemmatize_words else lemmatize(out, lemmas)


def lemmatize(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """normalized of words replaced by their lemma where the table has one. Of several lemmas of a form the first in order counts."""
    table = lemmas.where("form is not null and lemma is not null").groupBy(F.col("form").alias("normalized")).agg(F.min("lemma").alias("_lemma"))
    joined = lookup_join(tokens, table, ["normalized"])
    normal = F.when(F.col("token_type") == "word", F.coalesce("_lemma", "normalized")).otherwise(F.col("normalized"))
    return joined.withColumn("normalized", normal).select(tokens.columns)


def bounded_lemmas(lemmas: DataFrame) -> dict[str, str] | None:
    """form -> lemma if there are few; of several lemmas of a form the first in order."""
    rows = bounded_rows(lemmas.where("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma")))
    return None if rows is None else {r["form"]: r["lemma"] for r in rows}


def ascii_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, text, start_char, end_char): the corrector's own tokens, ASCII letters only."""
    columns = {"text": pa.string(), "start_char": pa.int32(), "end_char": pa.int32()}
    return text_pass(df, key, text, None, lambda x: [(m[0], m.start(), m.end()) for m in _ASCII.finditer(x)], columns, "idx")


_TOKEN_FIELDS = {"idx": pa.int32(), "text": pa.string(), "normalized": pa.string(), "start_char": pa.int32(), "end_char": pa.int32(), "token_type": pa.string()}


def with_tokens(df: DataFrame, text: str, settings: TranslationSettings = TranslationSettings(), limited: bool = True, lemmas: dict[str, str] | None = None) -> DataFrame:
    """df with tokens array<struct>, in one pass and with all columns; null where the text breaks a rule.

    Texts without tokens have an empty array. lemmas (few, see
    joins.bounded_rows) replace the words' normal forms. df has no column of
    the name tokens.
    """
    limit = settings.max_input_characters if limited else 2**31 - 1
    struct = pa.list_(pa.struct(list(_TOKEN_FIELDS.items())))
    shared = df.sparkSession.sparkContext.broadcast(lemmas or {})

    def run(batches):
        lemmas = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                rows = []
                for good, value in zip(some.column(some.num_columns - 1).to_pylist(), some.column(some.schema.get_field_index(text)).to_pylist()):
                    found = tokens_of(value, settings) if good else ()
                    rows.append([{"idx": i, "text": a, "normalized": lemmas.get(b, b) if e == "word" else b, "start_char": c, "end_char": d, "token_type": e} for i, (a, b, c, d, e) in enumerate(found)] if good else None)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(rows, struct)], [*some.schema.names[:-1], "tokens"])

    good = text_error(F.col(text), limit).isNull()
    schema = T.StructType([*df.schema.fields, T.StructField("tokens", T._parse_datatype_string(f"array<{TOKEN_STRUCT}>"))])
    return spread(df.withColumn("_good", good)).mapInArrow(run, schema)


def normalized_tokens(df: DataFrame, key: str, text: str, settings: TranslationSettings = TranslationSettings(), limited: bool = True) -> DataFrame:
    """(key, tokens array<struct>): tokenize, one row for each text that breaks no rule; texts without tokens have an empty array."""
    good = text_error(F.col(text), settings.max_input_characters if limited else 2**31 - 1).isNull()
    return with_tokens(df.select(key, text).where(good), text, settings, limited).select(key, "tokens")


def token_counts(df: DataFrame, text: str, settings: TranslationSettings = TranslationSettings(), limited: bool = True) -> DataFrame:
    """(normalized, token_type, n): how often each normal form occurs, added up within each batch of texts only."""
    good = text_error(F.col(text), settings.max_input_characters if limited else 2**31 - 1).isNull()

    def run(batches):
        for batch in batches:
            found = Counter((x[1], x[4]) for value in batch.column(0).to_pylist() for x in tokens_of(value, settings))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array(found.values(), pa.int64())], ["normalized", "token_type", "n"])

    return spread(df.select(text).where(good)).mapInArrow(run, "normalized string, token_type string, n long")


def token_texts(text: Column) -> Column:
    """The texts of all tokens, without offsets, in the JVM."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def token_type(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{Nd}"), "number").otherwise("word")
