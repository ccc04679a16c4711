"""Neural translation: what is done before and after the model."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.config import NeuralSettings
from pagelight.functions.chars import collapse_ws, strip_ws
from pagelight.operators.recognition import predict
from pagelight.operators.tokens import text_error


def prepare(text: Column, settings: NeuralSettings = NeuralSettings()) -> Column:
    """Runs of white space become one space, or only the ends are stripped."""
    return collapse_ws(text) if settings.normalize_whitespace else strip_ws(text)


def model_input(processed: Column, settings: NeuralSettings = NeuralSettings()) -> Column:
    """The text behind the target language's token; a blank token is left out."""
    token = settings.target_language_token.strip()
    return F.concat_ws(" ", F.lit(token), processed) if token else processed


def prepared(df: DataFrame, key: str, text: str, settings: NeuralSettings = NeuralSettings()) -> DataFrame:
    """(key, processed_text, model_input, error): null model input where the model isn't called.

    That is so for texts that break a rule (see text_error) and blank ones.
    """
    error = text_error(F.col(text), settings.max_input_characters)
    rows = df.select(key, error.alias("error"), prepare(F.col(text), settings).alias("processed_text"))
    called = F.col("error").isNull() & (F.col("processed_text") != "")
    return rows.select(key, F.when(F.col("error").isNull(), F.col("processed_text")).alias("processed_text"), F.when(called, model_input(F.col("processed_text"), settings)).alias("model_input"), "error")


def clean_output(text: Column, settings: NeuralSettings = NeuralSettings()) -> Column:
    return prepare(text, settings)


def translate(df: DataFrame, key: str, text: str, factory: Callable[[], Any], settings: NeuralSettings = NeuralSettings()) -> DataFrame:
    """(key, source_text, translated_text, processed_text, error); the key must be unique.

    The model sees only rows with an input; blank texts give empty translations.
    """
    rows = prepared(df, key, text, settings)
    made = predict(rows.where("model_input is not null"), key, ["model_input"], factory)
    joined = df.select(key, F.col(text).alias("source_text")).join(rows, key).join(made, key, "left")
    blank = F.col("error").isNull() & (F.col("processed_text") == "")
    return joined.select(key, "source_text", F.when(blank, F.lit("")).otherwise(clean_output(F.col("payload"), settings)).alias("translated_text"), "processed_text", "error")
