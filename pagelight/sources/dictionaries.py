"""Readers for dictionary files, and writers of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.config import CorrectionSettings


class DictionaryLoadError(RuntimeError):
    """A dictionary can't be read, or holds nothing."""


#: A dictionary file is one JSON document; it is parsed whole, so its size is bounded.
JSON_BYTES = 256 << 20


def read_translation_json(spark: SparkSession, path: str, replace: bool = False) -> DataFrame:
    """(ord, word, translations, replace) of a JSON object word -> string or list of strings.

    Of a key that stands twice the last value counts. ord is the order in the
    file. A root that is no object, and values of another kind, are an error.
    """
    try:
        files = spark.read.format("binaryFile").load(path).where(F.col("length") <= JSON_BYTES).select("content").limit(2).collect()
        if len(files) != 1:
            raise DictionaryLoadError(f"{path} is not one file of at most {JSON_BYTES} bytes")
        found = json.loads(bytes(files[0]["content"]).decode("utf-8"))
    except DictionaryLoadError:
        raise
    except Exception as error:
        raise DictionaryLoadError(f"cannot read {path}") from error
    if not isinstance(found, dict):
        raise DictionaryLoadError(f"{path} is no JSON object")
    rows = []
    for number, (word, value) in enumerate(found.items()):
        values = [value] if isinstance(value, str) else value
        if not isinstance(values, list) or not all(isinstance(x, str) for x in values):
            raise DictionaryLoadError(f"{path}: {word!r} has neither a string nor a list of strings")
        rows.append((number, word, values, replace))
    return spark.createDataFrame(rows, "ord long, word string, translations array<string>, replace boolean")


def read_frequencies(spark: SparkSession, path: str, settings: CorrectionSettings = CorrectionSettings()) -> DataFrame:
    """(term, frequency) of a text file with one term a line; lines without a whole number are left out."""
    try:
        lines = spark.read.option("encoding", settings.encoding).csv(path, sep="\u0000", schema="value string", quote="", escape="")
        parts = F.split("value", f"\\Q{settings.separator}\\E", -1)
        rows = lines.select(F.get(parts, F.lit(settings.term_index)).alias("term"), F.get(parts, F.lit(settings.count_index)).try_cast("long").alias("frequency"))
        rows = rows.where("term is not null and term <> '' and frequency is not null").groupBy("term").agg(F.sum("frequency").alias("frequency"))
        rows = rows.where(F.col("frequency") >= settings.count_threshold)
        empty = rows.isEmpty()
    except Exception as error:
        raise DictionaryLoadError(f"cannot read {path}") from error
    if empty:
        raise DictionaryLoadError(f"{path} holds no term")
    return rows.withColumn("dictionary_source", F.lit(path))


def corpus_frequencies(df: DataFrame, text: str, least: int = 5) -> DataFrame:
    """(term, frequency): the ASCII words of a corpus that occur `least` times, in place of a supplied dictionary."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("frequency")).where(F.col("frequency") >= least)


def load_vocabulary(spark: SparkSession, settings: CorrectionSettings = CorrectionSettings(), supplied: DataFrame | None = None) -> DataFrame:
    """(term, frequency, dictionary_source): the file that the settings name, else the supplied table; an error if it is empty."""
    if settings.dictionary_path is not None:
        return read_frequencies(spark, settings.dictionary_path, settings)
    if supplied is None or supplied.isEmpty():
        raise DictionaryLoadError("no dictionary is named or supplied, or it holds no term")
    return supplied.select("term", "frequency", F.lit("supplied").alias("dictionary_source"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder in Spark's image struct; files that are no image have nulls in it."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def images_of(spark: SparkSession, arrays: list[tuple[int, object]]) -> DataFrame:
    """(id, image) of arrays of height x width x 3 bytes in memory, in Spark's image struct."""
    rows = [(key, ("", a.shape[0], a.shape[1], a.shape[2], 16, bytearray(a.tobytes()))) for key, a in arrays]
    return spark.createDataFrame(rows, "id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def write_images(df: DataFrame, key: str, payload: str, folder: str) -> DataFrame:
    """(key, path): binary images written one file each to a shared folder, as results to look at.

    A task that runs again writes the same files again.
    """
    from pathlib import Path

    kind = df.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            paths = []
            for k, data in zip(part[key], part[payload]):
                target = Path(folder.removeprefix("file://"), f"{k}.png")
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(bytes(data))
                paths.append(str(target))
            yield part[[key]].assign(path=paths)

    return df.where(F.col(payload).isNotNull()).select(key, payload).mapInPandas(run, f"`{key}` {kind}, path string")


def write_results(df: DataFrame, path: str, mode: str = "error") -> None:
    """Region, line and item tables as Parquet."""
    df.write.mode(mode).parquet(path)
