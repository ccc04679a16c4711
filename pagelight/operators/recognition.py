"""Images in, recognised lines out: image rules, model backends, flattened results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.config import LayoutSettings, RecognitionSettings
from pagelight.session import spread

#: OpenCV's number for three channels of eight bits, as Spark's image source gives it.
CV_8UC3 = 16


class Backend(Protocol):
    """A model: made once in each task by its factory, then given batches of rows."""

    def predict(self, rows: pd.DataFrame) -> list[str | None]:
        """A JSON payload for each row."""


def image_error(width: Column, height: Column, channels: Column, mode: Column, settings: RecognitionSettings | LayoutSettings) -> Column:
    """The first rule that an image breaks; null for a good one. Layout tests the width first, recognition the height."""
    narrow, low = F.when(width < settings.min_image_width, "too_narrow"), F.when(height < settings.min_image_height, "too_low")
    sides = [narrow, low] if isinstance(settings, LayoutSettings) else [low, narrow]
    return F.coalesce(
        F.when(width.isNull() | height.isNull(), "no_image"),
        F.when(mode != CV_8UC3, "not_8_bit"),
        F.when(channels != 3, "not_3_channels"),
        *sides,
        F.when(width.cast("long") * height > settings.max_image_pixels, "too_many_pixels"),
    )


def valid_images(df: DataFrame, settings: RecognitionSettings | LayoutSettings, image: str = "image") -> DataFrame:
    """df (of Spark's image source) with error."""
    part = F.col(image)
    return df.withColumn("error", image_error(part["width"], part["height"], part["nChannels"], part["mode"], settings))


def predict(df: DataFrame, key: str, columns: list[str], factory: Callable[[], Any]) -> DataFrame:
    """(key, payload): each row given to a model.

    The model is made once in each task, when the first batch comes; a row that
    it fails on ends the task with its error.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            if model is None:
                model = factory()
            yield pd.DataFrame({key: part[key], "payload": model.predict(part)})

    return spread(df.select(key, *columns)).mapInPandas(run, f"`{key}` {kind}, payload string")


class EchoBackend:
    """A stand-in for a model: gives a column back as the one recognised line."""

    def __init__(self, column: str):
        self.column = column

    def predict(self, rows: pd.DataFrame) -> list[str | None]:
        import json

        return [json.dumps({"res": {"rec_texts": [x], "rec_scores": [1.0], "rec_boxes": [[0, 0, 1, 1]]}}) for x in rows[self.column]]


def recognise(df: DataFrame, key: str, factory: Callable[[], Any], settings: RecognitionSettings = RecognitionSettings(), image: str = "image") -> tuple[DataFrame, DataFrame]:
    """((key, line_no, text, score, box), (key, error)): the lines of the good images, and why the others have none."""
    checked = valid_images(df, settings, image)
    lines = flatten_lines(predict(checked.where("error is null"), key, [image], factory), key, "payload")
    return lines, checked.where("error is not null").select(key, "error")


def flatten_lines(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, line_no, text, score, box): the lines of JSON payloads, with or without res around them.

    The texts set the number of lines; scores and boxes that are missing are null.
    """
    body = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_boxes:array<array<int>>>"
    parsed = F.from_json(payload, f"struct<res:{body},rec_texts:array<string>,rec_scores:array<double>,rec_boxes:array<array<int>>>")
    part = {c: F.coalesce(parsed["res"][c], parsed[c]) for c in ("rec_texts", "rec_scores", "rec_boxes")}
    rows = df.select(key, F.posexplode(part["rec_texts"]).alias("line_no", "text"), part["rec_scores"].alias("_scores"), part["rec_boxes"].alias("_boxes"))
    return rows.select(key, "line_no", "text", F.get("_scores", F.col("line_no")).alias("score"), F.get("_boxes", F.col("line_no")).alias("box"))
