"""Page layout: decoding a detector's boxes, normal boxes and labels, reading order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelight.config import LayoutSettings
from pagelight.functions.chars import strip_ws
from pagelight.operators.recognition import predict, valid_images
from pagelight.session import pinned

RAW_BOX = "struct<label:string,cls_id:string,score:string,coordinate:array<string>>"


_BOXES = f"struct<boxes:array<{RAW_BOX}>>"


def payload_error(payload: Column) -> Column:
    """Why a payload has no boxes to read: no_payload, not_json, bad_result, bad_boxes; null for a good one.

    Where res is there it must hold the boxes; the top level counts only
    without it. No boxes at all are an empty list.
    """
    whole = F.try_parse_json(payload)
    inner = F.variant_get(whole, "$.res", "variant")
    kind = F.schema_of_variant
    has = F.coalesce(F.json_object_keys(payload), F.array())
    body = F.when(F.array_contains(has, "res"), inner).otherwise(whole)
    boxes = F.variant_get(body, "$.boxes", "variant")
    is_object = lambda x: F.coalesce(kind(x).startswith("OBJECT"), F.lit(False))
    return (
        F.when(payload.isNull(), "no_payload")
        .when(whole.isNull() | ~is_object(whole), "not_json")
        .when(~is_object(body), "bad_result")
        .when(boxes.isNotNull() & ~F.coalesce(kind(boxes).startswith("ARRAY"), F.lit(False)), "bad_boxes")
    )


def decode_boxes(df: DataFrame, key: str, payload: str, *keep: str) -> DataFrame:
    """(key, keep.., box_no, label, cls_id, score, coordinate) of JSON payloads with boxes under res, or at the top without res.

    Values stay strings, as lenient as the detector; a payload that has no list
    of boxes to read has no rows (see payload_error).
    """
    has = F.coalesce(F.json_object_keys(payload), F.array())
    boxes = F.when(F.array_contains(has, "res"), F.from_json(payload, f"struct<res:{_BOXES}>")["res"]["boxes"]).otherwise(F.from_json(payload, _BOXES)["boxes"])
    rows = df.select(key, *keep, F.posexplode(boxes).alias("box_no", "box")).where("box is not null")
    return rows.select(key, *keep, "box_no", *[F.col("box")[c].alias(c) for c in ("label", "cls_id", "score", "coordinate")])


def detect(df: DataFrame, key: str, factory: Callable[[], Any], settings: LayoutSettings = LayoutSettings(), image: str = "image") -> tuple[DataFrame, DataFrame]:
    """The regions of Spark images by a model, and (key, error) of the images that have none for an error.

    Regions: key, box_no, x1, y1, x2, y2, label, raw_label, class_id,
    confidence, and pos, the reading order, if the settings sort by position.
    """
    checked = valid_images(df, settings, image)
    sized = checked.where("error is null").select(key, F.col(image)["width"].alias("image_width"), F.col(image)["height"].alias("image_height"))
    found = pinned(predict(checked.where("error is null"), key, [image], factory))
    errors = checked.where("error is not null").select(key, "error").unionByName(found.select(key, payload_error(F.col("payload")).alias("error")).where("error is not null"))
    good = found.where(payload_error(F.col("payload")).isNull())
    boxes = decode_boxes(good, key, "payload").select(key, "box_no", "label", "cls_id", "score", *[F.get("coordinate", F.lit(i)).alias(f"c{i}") for i in range(4)])
    regions = normalize_boxes(boxes.join(sized, key), "label", "cls_id", "score", [f"c{i}" for i in range(4)], "image_width", "image_height", settings).drop("image_width", "image_height")
    return (reading_order(regions, key, "box_no") if settings.sort_regions_by_position else regions), errors


def safe_number(value: Column) -> Column:
    """The finite number, else 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def class_id(value: Column) -> Column:
    """Whole numbers as they are, fractions cut toward zero, anything else -1."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) > 2**31), -1).otherwise(number.cast("int"))


def normalize_label(raw: Column, settings: LayoutSettings = LayoutSettings()) -> Column:
    """The simple label of a raw one; other for unknown ones and null."""
    plain = F.translate(F.lower(strip_ws(raw)), " -", "__")
    table = F.create_map(*[F.lit(x) for pair in settings.label_mapping.items() for x in pair])
    # Most labels are spelled plainly already.
    return F.coalesce(F.try_element_at(table, raw), F.try_element_at(table, plain), F.lit("other"))


def normalize_boxes(df: DataFrame, label: str, cls: str, score: str, coordinates: list[str], width: str, height: str, settings: LayoutSettings = LayoutSettings()) -> DataFrame:
    """df with x1, y1, x2, y2, label, raw_label, class_id, confidence in place of the raw columns; bad boxes dropped.

    Order of the tests: confidence below the threshold, corners that are no
    finite numbers or span nothing, label other (unless kept). Corners are put
    in order, rounded outward and, if so set, clipped to the image. A null label
    reads None, as text.
    """
    raw = [F.col(c).try_cast("double") for c in coordinates]
    keep = [c for c in df.columns if c not in (label, cls, score, *coordinates)]
    # inline() keeps the optimizer from writing each expression out wherever it is used:
    # a projection that large would no longer be compiled.
    parts = F.struct(
        F.coalesce(strip_ws(F.col(label)), F.lit("None")).alias("raw_label"),
        normalize_label(F.col(label), settings).alias("label"),
        class_id(F.col(cls)).alias("class_id"),
        safe_number(F.col(score)).alias("confidence"),
        *[c.alias(f"_{i}") for i, c in enumerate(raw)],
    )
    named = df.select(*keep, F.inline(F.array(parts))).where(F.col("confidence") >= settings.confidence_threshold)
    for i in range(4):
        named = named.where(F.col(f"_{i}").isNotNull() & ~F.isnan(f"_{i}") & (F.abs(f"_{i}") < 2**31))
    corners = {"x1": F.floor(F.least("_0", "_2")), "y1": F.floor(F.least("_1", "_3")), "x2": F.ceil(F.greatest("_0", "_2")), "y2": F.ceil(F.greatest("_1", "_3"))}
    if settings.clip_boxes_to_image:
        corners = {k: F.greatest(F.lit(0), F.least(v, F.col(width if k[0] == "x" else height))) for k, v in corners.items()}
    box = F.inline(F.array(F.struct(*[v.cast("int").alias(k) for k, v in corners.items()])))
    boxed = named.select(*keep, box, "label", "raw_label", "class_id", "confidence").where("x2 > x1 and y2 > y1")
    return boxed if settings.keep_other_regions else boxed.where("label <> 'other'")


def with_sizes(regions: DataFrame) -> DataFrame:
    """regions with width, height and area."""
    width, height = F.greatest(F.lit(0), F.col("x2") - F.col("x1")), F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    return regions.withColumns({"width": width, "height": height, "area": width.cast("long") * height})


def reading_order(regions: DataFrame, page: str, *ties: str) -> DataFrame:
    """regions with pos, from 0: down the page, then to the right, then the surer first, then the ties' columns."""
    order = Window.partitionBy(page).orderBy("y1", "x1", F.desc("confidence"), *ties)
    return regions.withColumn("pos", F.row_number().over(order) - 1)
