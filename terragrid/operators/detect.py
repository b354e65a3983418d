"""Object detections: payload parsing, geo-referencing and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DET = (
    "struct<id:string,`class`:string,label:string,confidence:double,"
    "bbox:array<double>,box_2d:array<double>,polygon:array<array<array<double>>>>"
)
# Defaults for absent fields, and the scale of normalised boxes.
UNKNOWN = "unknown"
DEFAULT_CONFIDENCE = 0.5
BOX_SCALE = 1000.0


def parse_detections(payloads: DataFrame) -> DataFrame:
    """P25: one row per detection of a JSON payload.

    A payload is a list, or an object with ``objects`` (absent: none).  Text that
    is not JSON gives one row with ``is_error``.
    """
    text = F.col("payload")
    listed = F.ltrim(text).startswith("[")
    as_list = F.from_json(text, f"array<{_DET}>")
    as_obj = F.from_json(text, f"struct<objects:array<{_DET}>>")
    # VARIANT parsing is the validity check: it is null exactly for text that is not JSON
    bad = F.try_parse_json(text).isNull()
    none = F.array().cast(f"array<{_DET}>")
    dets = F.when(bad, F.array(F.lit(None).cast(_DET))).when(listed, as_list).otherwise(F.coalesce(as_obj["objects"], none))
    carried = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*carried, bad.alias("is_error"), F.posexplode(dets).alias("position", "d"))
    return rows.select(
        *carried, "position", "is_error",
        F.col("d.id").alias("det_id"),
        F.coalesce(F.nullif("d.class", F.lit("")), F.nullif("d.label", F.lit("")), F.lit(UNKNOWN)).alias("label"),
        # zero counts as absent
        F.coalesce(F.nullif("d.confidence", F.lit(0.0)), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.col("d.bbox").alias("bbox"), F.col("d.box_2d").alias("box_2d"), F.col("d.polygon").alias("polygon"),
    )


def above_confidence(detections: DataFrame, minimum: float) -> DataFrame:
    """detections at or above a confidence."""
    return detections.filter(F.col("confidence") >= minimum)


def detection_rings(image_w: float, image_h: float, bbox: dict) -> Column:
    """Rings in map coordinates: the polygon, else the closed box, else null.

    ``bbox`` is the map box of the image (``west, south, east, north``).  A
    ``box_2d`` is ``y0, x0, y1, x1`` in thousandths of the image.
    """
    span_x, span_y = bbox["east"] - bbox["west"], bbox["north"] - bbox["south"]
    lng = lambda x: F.lit(bbox["west"]) + x / F.lit(float(image_w)) * F.lit(span_x)
    lat = lambda y: F.lit(bbox["north"]) - y / F.lit(float(image_h)) * F.lit(span_y)
    b, n = F.col("bbox"), F.col("box_2d")
    sx, sy = F.lit(image_w / BOX_SCALE), F.lit(image_h / BOX_SCALE)
    box = F.when(F.size(b) >= 4, b).when(F.size(n) >= 4, F.array(n[1] * sx, n[0] * sy, n[3] * sx, n[2] * sy))
    west, south, east, north = lng(box[0]), lat(box[3]), lng(box[2]), lat(box[1])
    ring = F.array(*[F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))])
    poly = F.transform(F.col("polygon"), lambda r: F.transform(r, lambda p: F.array(lng(p[0]), lat(p[1]))))
    return F.when(F.col("polygon").isNotNull(), poly).when(box.isNotNull(), F.array(ring))


def detections_geojson(
    payloads: DataFrame, image_w: float, image_h: float, bbox: dict, min_confidence: float | None = None
) -> DataFrame:
    """Payloads -> detections with their geometry as JSON text."""
    dets = parse_detections(payloads).filter(~F.col("is_error"))
    if min_confidence is not None:
        dets = above_confidence(dets, min_confidence)
    rings = detection_rings(image_w, image_h, bbox)
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("_r").alias("coordinates"))
    carried = [c for c in payloads.columns if c != "payload"]
    return dets.withColumn("_r", rings).select(
        *carried, "det_id", "label", "confidence", F.col("_r").alias("rings"),
        F.when(F.col("_r").isNotNull(), F.to_json(geometry)).alias("geometry_json"),
    )


def feature_lines(detections: DataFrame) -> DataFrame:
    """One GeoJSON feature per detection as text; a missing geometry is ``null``."""
    geometry = F.when(
        F.col("rings").isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    )
    props = F.struct(
        F.col("label").alias("type"), F.col("confidence").alias("confidence"), F.col("det_id").alias("detectionId")
    )
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))
    return detections.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))
