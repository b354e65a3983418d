"""Grid, map and tile coordinates as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half width of the web-mercator square in metres, tile edge in pixels.
MERCATOR_HALF = 20037508.342789244
TILE_SIZE = 256
MERCATOR_RADIUS = MERCATOR_HALF / math.pi


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def latlng_to_pixel(lat: Column, lng: Column, meta: str = "") -> Column:
    """Grid cell of a point as ``struct(x, y)``; null outside the raster.

    The grid comes from columns ``xmin, ymax, pixel_width, pixel_height, width,
    height``, optionally under a struct or alias prefix ``meta``.
    """
    m = lambda n: F.col(f"{meta}.{n}" if meta else n)
    x = F.floor((lng - m("xmin")) / m("pixel_width"))
    y = F.floor((m("ymax") - lat) / m("pixel_height"))
    inside = (x >= 0) & (x < m("width")) & (y >= 0) & (y < m("height"))
    return F.when(inside, F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))


def pixel_to_latlng(y: Column, x: Column, meta: str = "") -> Column:
    """Centre of a grid cell as ``struct(lat, lng)``."""
    m = lambda n: F.col(f"{meta}.{n}" if meta else n)
    return F.struct(
        (m("ymax") - (y + 0.5) * m("pixel_height")).alias("lat"),
        (m("xmin") + (x + 0.5) * m("pixel_width")).alias("lng"),
    )


def bbox_of_corners(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Normalised box and centre of two dragged corners."""
    return F.struct(
        F.greatest(lat1, lat2).alias("north"),
        F.least(lat1, lat2).alias("south"),
        F.greatest(lng1, lng2).alias("east"),
        F.least(lng1, lng2).alias("west"),
        ((lat1 + lat2) / 2).alias("center_lat"),
        ((lng1 + lng2) / 2).alias("center_lng"),
    )


def mercator_y(lat: Column) -> Column:
    """Latitude in degrees -> asinh(tan(lat)), the unit mercator ordinate.

    Taken from the absolute value: asinh of a huge negative number loses all digits.
    """
    t = F.tan(F.radians(lat))
    return F.signum(t) * F.asinh(F.abs(t))


def lonlat_to_tile(lon: Column, lat: Column, z: int | Column) -> Column:
    """Tile of a point as ``struct(x, y)``, clamped to the zoom level; y from north."""
    n = F.pow(F.lit(2.0), _lit(z))
    top = (n - 1).cast("long")
    x = ((lon + 180.0) / 360.0 * n).cast("long")
    y = ((F.lit(1.0) - mercator_y(lat) / F.lit(math.pi)) / 2.0 * n).cast("long")
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(top, c)).cast("int")
    return F.struct(clamp(x).alias("x"), clamp(y).alias("y"))


def tile_resolution(z: int | Column, tile_size: int = TILE_SIZE) -> Column:
    """Metres per pixel at a zoom level."""
    return F.lit(2 * MERCATOR_HALF) / F.pow(F.lit(2.0), _lit(z)) / F.lit(tile_size)


def tile_origin(x: Column, y: Column, z: int | Column, tile_size: int = TILE_SIZE) -> Column:
    """North-west corner of a tile in web-mercator metres."""
    edge = tile_resolution(z, tile_size) * F.lit(tile_size)
    return F.struct(
        (x * edge - F.lit(MERCATOR_HALF)).alias("west"), (F.lit(MERCATOR_HALF) - y * edge).alias("north")
    )


def tiles_for_bbox(areas: DataFrame, z: int | Column) -> DataFrame:
    """Every tile that covers each area (columns ``west, south, east, north``).

    The output keeps the area's columns and adds ``z, x, y``.  Columns of tiles
    are spread over tasks before rows are generated, so one huge area does not
    expand inside a single task.
    """
    nw = lonlat_to_tile(F.col("west"), F.col("north"), z)
    se = lonlat_to_tile(F.col("east"), F.col("south"), z)
    boxed = areas.select("*", _lit(z).cast("int").alias("z"), nw.alias("_a"), se.alias("_b"))
    span = lambda c: F.sequence(F.least(f"_a.{c}", f"_b.{c}"), F.greatest(f"_a.{c}", f"_b.{c}"))
    columns = boxed.withColumn("x", F.explode(span("x")))
    # an explicit count, so that adaptive execution does not merge these tiny rows into one task
    columns = columns.repartition(areas.sparkSession.sparkContext.defaultParallelism, "west", "x")
    return columns.withColumn("y", F.explode(span("y"))).drop("_a", "_b")
