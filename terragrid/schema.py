"""Table layouts and reserved values shared by every operator.

A raster is a *pixel table*: one row per pixel, nodata rows kept.  Everything
else (registries, hierarchies, palettes, labels, tiles) is a dimension table
next to it, and ``raster_key`` tells the rasters of one table apart.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Optional

from pyspark.sql import DataFrame

# Reserved cluster ids.
NODATA = -1
SELECTED = -2
UNLABELED_ID = 9999
SYNTHETIC_START = 10000
FINE_GRAIN_START = 50000
# Composite ids that would fall on the ids above begin here; cluster ids stay below.
COMPOSITE_START = 1_000_000_000

# Path sentinel and reserved raster keys.
UNLABELED = "unlabeled"
SYNTHETIC_KEY = "synthetic_seg"
COMPOSITE_KEY = "composite_seg"
INTERACTIVE_KEY = "interactive_seg"
SPECIAL_KEYS = (SYNTHETIC_KEY, COMPOSITE_KEY, INTERACTIVE_KEY)

# One pixel is 10 m x 10 m unless the caller says otherwise.
PIXEL_AREA_HA = 0.01

PIXELS = "raster_key STRING, y INT, x INT, value INT"
BLOCKS = "raster_key STRING, by INT, bx INT, values ARRAY<INT>"
RASTER_META = (
    "raster_key STRING, k INT, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, "
    "pixel_width DOUBLE, pixel_height DOUBLE, width INT, height INT, nodata INT, epsg INT"
)
REGISTRY = (
    "raster_key STRING, cluster_id INT, pixel_count BIGINT, "
    "classification_path STRING, color STRING, area_ha DECIMAL(18,2)"
)
HIERARCHY = "path STRING, parent_path STRING, name STRING, level INT, description STRING, is_leaf BOOLEAN"
LABELS = "raster_key STRING, cluster_id INT, path STRING, ts TIMESTAMP_NTZ, seq BIGINT"


@dataclass(frozen=True)
class SegmentedRaster:
    """A pixel table with the registry of its clusters.

    Both members are plans, not data: reading both runs their common input
    twice.  ``plans.sizing.stage`` one of them first when that input is costly.
    """

    pixels: DataFrame
    registry: DataFrame
    meta: Optional[DataFrame] = None

    def map_values(self, fn) -> "SegmentedRaster":
        """Rewrite the pixel values with ``fn(y, x, value) -> Column``."""
        from terragrid.operators.registry import map_pixels

        return replace(self, pixels=map_pixels(self.pixels, fn))
