"""Registered queries: every operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions import color as C
from terragrid.functions import geo as G
from terragrid.functions import ids as I
from terragrid.functions import paths as P
from terragrid.operators import blocks, cluster, detect, growth, halo, hierarchy, labels, overlay, region, registry, render, resample, store, tiles, zonal
from terragrid.plans import fixtures as fx
from terragrid.plans.oracles import sql
from terragrid.plans.sizing import scratch_dir, shuffled, stage
from terragrid.sources import manifest, tables
from terragrid.streaming import labels as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# --- counts, registries, lookups ------------------------------------------------------


@query("count_pixels", sql("SELECT * FROM counts", "counts"))
def _(spark, sf):
    return registry.count_pixels(fx.pixels(spark, sf))


@query(
    "count_by_value",
    sql("SELECT raster_key, value AS cluster_id, COUNT(*) AS pixel_count FROM pixels WHERE value NOT IN (0, 3) GROUP BY 1, 2", "pixels"),
)
def _(spark, sf):
    return registry.count_by_value(fx.pixels(spark, sf), exclude=[0, 3])


@query(
    "build_registry",
    sql("SELECT raster_key, cluster_id, pixel_count, path AS classification_path, color, area_ha FROM creg", "creg"),
)
def _(spark, sf):
    return fx.colored_registry(spark, sf)


@query(
    "area_by_class",
    sql(
        """SELECT SPLIT_PART(u.path, '.', 1) AS class, COUNT(*) AS pixel_count, CAST(COUNT(*) * 0.01 AS DECIMAL(18,2)) AS area_ha
           FROM comp c JOIN uids u ON u.uid = c.value GROUP BY 1""",
        "comp", "uids",
    ),
)
def _(spark, sf):
    """Flagship: labelled area of the composite by top-level class."""
    made = overlay.composite(fx.segmented(spark, sf))
    per_class = made.registry.groupBy(P.truncate(F.col("classification_path"), 1).alias("class")).agg(
        F.sum("pixel_count").alias("pixel_count")
    )
    return per_class.filter("pixel_count > 0").select("class", "pixel_count", registry.area_ha(F.col("pixel_count")).alias("area_ha"))


@query(
    "histogram",
    sql(
        """WITH r AS (SELECT raster_key, MIN(value) AS lo, MAX(value) AS hi, (MAX(value) - MIN(value)) / 8.0::DOUBLE AS size FROM pixels GROUP BY 1),
             b AS (SELECT raster_key, lo, size, UNNEST(RANGE(8)) AS bin FROM r),
             h AS (SELECT p.raster_key, LEAST(FLOOR((p.value - r.lo) / r.size), 7) AS bin, COUNT(*) AS n FROM pixels p JOIN r USING (raster_key) GROUP BY 1, 2)
           SELECT b.raster_key, CAST(b.bin AS INT) AS bin, b.lo + b.bin * b.size AS left_edge, COALESCE(h.n, 0) AS count
           FROM b LEFT JOIN h ON h.raster_key = b.raster_key AND h.bin = b.bin""",
        "pixels",
    ),
)
def _(spark, sf):
    return registry.histogram(fx.pixels(spark, sf), bins=8)


@query(
    "lookup_clusters",
    sql(
        """SELECT p.raster_key, y, x, value, COALESCE(path, 'unlabeled') AS path, color,
             COALESCE(path, 'unlabeled') = 'unlabeled' AS is_unlabeled
           FROM pixels p LEFT JOIN creg r ON r.raster_key = p.raster_key AND r.cluster_id = p.value""",
        "pixels", "creg",
    ),
)
def _(spark, sf):
    seg = fx.segmented(spark, sf, colored=True)
    found = registry.lookup_clusters(seg.pixels, seg.registry, derived=False)
    return found.withColumn("is_unlabeled", ~I.is_labeled(F.col("path")))


@query(
    "palette_colors",
    sql(
        """SELECT c.raster_key, c.cluster_id, COALESCE(CONCAT('rgb(', r, ', ', g, ', ', b, ')'), 'rgb(128, 128, 128)') AS color
           FROM counts c LEFT JOIN (SELECT raster_key, cluster_id, CAST(r AS VARCHAR) AS r, CAST(g AS VARCHAR) AS g, CAST(b AS VARCHAR) AS b FROM pal) p
             ON p.raster_key = c.raster_key AND p.cluster_id = c.cluster_id""".replace(
            "CONCAT('rgb(', r, ', ', g, ', ', b, ')')", "'rgb(' || r || ', ' || g || ', ' || b || ')'"
        ),
        "counts", "pal",
    ),
)
def _(spark, sf):
    return registry.palette_colors(registry.count_pixels(fx.pixels(spark, sf)), fx.palette(spark, sf))


@query(
    "filter_clusters",
    sql(
        """SELECT p.raster_key, y, x, CASE WHEN l.cluster_id IS NOT NULL THEN value ELSE -1 END AS value
           FROM pixels p LEFT JOIN labels_fx l ON l.raster_key = p.raster_key AND l.cluster_id = p.value""",
        "pixels", "labels_fx",
    ),
)
def _(spark, sf):
    return registry.filter_clusters(fx.segmented(spark, sf), fx.labels(spark, sf)).pixels


@query(
    "filter_clusters_registry",
    sql(
        """SELECT raster_key, cluster_id, pixel_count, path AS classification_path, color, area_ha FROM creg
           WHERE (raster_key, cluster_id) IN (SELECT (raster_key, cluster_id) FROM labels_fx)""",
        "creg", "labels_fx",
    ),
)
def _(spark, sf):
    return registry.filter_clusters(fx.segmented(spark, sf, colored=True), fx.labels(spark, sf)).registry


@query(
    "build_registry_by_function",
    sql(
        """SELECT raster_key, cluster_id, pixel_count, CASE WHEN cluster_id % 2 = 0 THEN 'class.c' || cluster_id ELSE 'unlabeled' END AS classification_path,
             'rgb(' || cluster_id || ', 0, 0)' AS color, CAST(pixel_count * 0.01 AS DECIMAL(18,2)) AS area_ha FROM counts""",
        "counts",
    ),
)
def _(spark, sf):
    def attributes(i):
        path = F.when(i % 2 == 0, F.concat(F.lit("class.c"), i.cast("string")))
        return path, F.concat(F.lit("rgb("), i.cast("string"), F.lit(", 0, 0)"))

    return registry.build_registry(fx.pixels(spark, sf), attributes)


@query("labeled_clusters", sql("SELECT raster_key, cluster_id, path FROM reg WHERE path <> 'unlabeled'", "reg"))
def _(spark, sf):
    return registry.labeled_clusters(fx.registry(spark, sf))


@query("labeled_paths", sql("SELECT DISTINCT path FROM reg WHERE path <> 'unlabeled'", "reg"))
def _(spark, sf):
    return registry.labeled_paths(fx.registry(spark, sf))


@query(
    "progress",
    sql("SELECT raster_key, COUNT(*) FILTER (path <> 'unlabeled') AS labeled, COUNT(*) AS total FROM reg GROUP BY 1", "reg"),
)
def _(spark, sf):
    return registry.progress(fx.registry(spark, sf))


@query(
    "restore_labels",
    sql(
        """SELECT r.raster_key, r.cluster_id, r.pixel_count, COALESCE(e.path, r.path) AS classification_path, r.color, r.area_ha
           FROM creg r LEFT JOIN edits_now e ON e.raster_key = r.raster_key AND e.cluster_id = r.cluster_id""",
        "creg", "edits_now",
    ),
)
def _(spark, sf):
    return registry.restore_labels(fx.colored_registry(spark, sf), labels.latest_labels(fx.label_events(spark, sf)))


@query(
    "set_labels",
    sql(
        """SELECT r.raster_key, r.cluster_id, r.pixel_count, COALESCE(e.path, r.path) AS classification_path,
             CASE WHEN e.path IS NULL THEN r.color WHEN e.path = 'unlabeled' THEN NULL
                  ELSE 'rgb(' || CAST('0x' || SUBSTR(h.hex, 2, 2) AS INT) || ',' || CAST('0x' || SUBSTR(h.hex, 4, 2) AS INT)
                       || ',' || CAST('0x' || SUBSTR(h.hex, 6, 2) AS INT) || ')' END AS color, r.area_ha
           FROM creg r LEFT JOIN edits_now e ON e.raster_key = r.raster_key AND e.cluster_id = r.cluster_id
             LEFT JOIN path_hex h ON h.path = e.path""",
        "creg", "edits_now", "path_hex",
    ),
)
def _(spark, sf):
    edits = labels.latest_labels(fx.label_events(spark, sf))
    return registry.set_labels(fx.colored_registry(spark, sf), edits, fx.hierarchy_colors(spark, sf))


@query("raster_order", sql("SELECT DISTINCT raster_key, CAST(SUBSTR(raster_key, 2) AS INT) AS k FROM pixels", "pixels"))
def _(spark, sf):
    return registry.raster_order(fx.pixels(spark, sf).select("raster_key").distinct())


@query("map_pixels", sql("SELECT raster_key, y, x, CAST(CASE WHEN value = -1 THEN -1 ELSE value * 100 + (x + y) % 7 END AS INT) AS value FROM pixels", "pixels"))
def _(spark, sf):
    return registry.map_pixels(fx.pixels(spark, sf), lambda y, x, v: F.when(v == -1, v).otherwise(v * 100 + (x + y) % 7))


@query(
    "remap_ids",
    sql(
        """SELECT p.raster_key, y, x, CAST(COALESCE(l.cluster_id + 100, p.value) AS INT) AS value
           FROM pixels p LEFT JOIN labels_fx l ON l.raster_key = p.raster_key AND l.cluster_id = p.value""",
        "pixels", "labels_fx",
    ),
)
def _(spark, sf):
    mapping = fx.labels(spark, sf).select("raster_key", F.col("cluster_id").alias("value"), (F.col("cluster_id") + 100).alias("new_value"))
    return registry.remap(fx.pixels(spark, sf), mapping)


@query(
    "aggregate_by_key",
    sql(
        """WITH k AS (SELECT p.raster_key, y, x, value, CASE WHEN r.path = 'unlabeled' THEN 'none' ELSE SPLIT_PART(r.path, '.', 1) END AS key
                      FROM pixels p JOIN reg r ON r.raster_key = p.raster_key AND r.cluster_id = p.value),
             ids AS (SELECT raster_key, key, ROW_NUMBER() OVER (PARTITION BY raster_key ORDER BY MIN(y * 50 + x)) AS id FROM k GROUP BY 1, 2)
           SELECT p.raster_key, p.y, p.x, CAST(COALESCE(ids.id, p.value) AS INT) AS value, p.value AS source_id
           FROM pixels p LEFT JOIN k ON k.raster_key = p.raster_key AND k.y = p.y AND k.x = p.x
             LEFT JOIN ids ON ids.raster_key = k.raster_key AND ids.key = k.key""",
        "pixels", "reg",
    ),
)
def _(spark, sf):
    return registry.aggregate_by_key(fx.segmented(spark, sf), _top_class).pixels


def _top_class(cluster_id, path, color):
    return F.when(I.is_labeled(path), P.truncate(path, 1)).otherwise(F.lit("none"))


@query(
    "aggregate_by_key_registry",
    sql(
        """WITH k AS (SELECT p.raster_key, y * 50 + x AS pos, r.path, r.color, CASE WHEN r.path = 'unlabeled' THEN 'none' ELSE SPLIT_PART(r.path, '.', 1) END AS key
                      FROM pixels p JOIN creg r ON r.raster_key = p.raster_key AND r.cluster_id = p.value)
           SELECT raster_key, CAST(ROW_NUMBER() OVER (PARTITION BY raster_key ORDER BY MIN(pos)) AS INT) AS cluster_id, COUNT(*) AS pixel_count,
             ARG_MIN(path, pos) AS classification_path, ARG_MIN(COALESCE(color, '-'), pos) AS color,
             CAST(COUNT(*) * 0.01 AS DECIMAL(18,2)) AS area_ha, key AS source_key FROM k GROUP BY raster_key, key""",
        "pixels", "creg",
    ),
)
def _(spark, sf):
    out = registry.aggregate_by_key(fx.segmented(spark, sf, colored=True), _top_class).registry
    return out.withColumn("color", F.coalesce("color", F.lit("-")))


@query(
    "pack_blocks",
    sql("SELECT raster_key, y, x, value FROM pixels", "pixels"),
)
def _(spark, sf):
    """Pixels through block storage and back; padding cells are dropped by the grid."""
    packed = blocks.blocks_from_pixels(fx.pixels(spark, sf), 16)
    cells = blocks.pixels_from_blocks(packed, 16)
    grid = fx.raster_meta(spark, sf).select("raster_key", "width", "height")
    return cells.join(grid, "raster_key").filter("x < width AND y < height").select("raster_key", "y", "x", "value")


# --- scalar functions ---------------------------------------------------------------------


@query(
    "latlng_to_pixel",
    sql(
        """SELECT point_id, CASE WHEN gx < 50 AND gy < m.height THEN CAST(gx AS INT) END AS x,
             CASE WHEN gx < 50 AND gy < m.height THEN CAST(gy AS INT) END AS y FROM pts, (SELECT MAX(height) AS height FROM meta) m""",
        "pts", "meta",
    ),
)
def _(spark, sf):
    grid = fx.raster_meta(spark, sf).filter("k = 5").drop("raster_key").withColumn("raster_key", F.lit("k5"))
    pts = fx.points(spark, sf).withColumn("raster_key", F.lit("k5")).join(grid, "raster_key")
    p = pts.select("point_id", G.latlng_to_pixel(F.col("lat"), F.col("lng")).alias("p"))
    return p.select("point_id", "p.x", "p.y")


@query(
    "pixel_to_latlng",
    sql("SELECT raster_key, y, x, 12 - (y + 0.5::DOUBLE) * 0.0625 AS lat, 80 + (x + 0.5::DOUBLE) * 0.0625 AS lng FROM pixels", "pixels"),
)
def _(spark, sf):
    joined = fx.pixels(spark, sf).join(fx.raster_meta(spark, sf), "raster_key")
    c = joined.select("raster_key", "y", "x", G.pixel_to_latlng(F.col("y"), F.col("x")).alias("c"))
    return c.select("raster_key", "y", "x", "c.lat", "c.lng")


@query(
    "id_ranges",
    """SELECT id, id = -1 AS nodata, id = -2 AS selected, id = 9999 AS unlabeled, id >= 10000 AND id < 50000 AS synthetic,
         id >= 50000 AS fine_grain, id >= 0 AND id < 10000 AS regular FROM (SELECT CAST(o_orderkey * 7 % 60009 - 2 AS INT) AS id FROM orders)""",
)
def _(spark, sf):
    ids = fx.table(spark, sf, "orders").select((F.col("o_orderkey") * 7 % 60009 - 2).cast("int").alias("id"))
    v = F.col("id")
    return ids.select(
        "id", I.is_nodata(v).alias("nodata"), I.is_selected(v).alias("selected"), I.is_unlabeled_id(v).alias("unlabeled"),
        I.is_synthetic(v).alias("synthetic"), I.is_fine_grain(v).alias("fine_grain"), I.is_regular(v).alias("regular"),
    )


@query(
    "k_of_key",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS k FROM part""",
)
def _(spark, sf):
    key = F.when(F.col("p_partkey") % 5 == 0, F.lit("synthetic_seg")).otherwise(F.concat(F.lit("k"), F.col("p_size").cast("string"), F.lit("_segmentation")))
    return fx.table(spark, sf, "part").select("p_partkey", I.k_of(key).alias("k"))


def _rgb_texts(spark, sf):
    k = F.col("c_custkey")
    css = F.concat(F.lit("rgb("), (k % 256).cast("string"), F.lit(", "), (k * 3 % 256).cast("string"), F.lit(","), (k * 7 % 256).cast("string"), F.lit(")"))
    text = F.when(k % 10 == 3, F.lit("#aabbcc")).when(k % 10 != 7, css)
    return fx.table(spark, sf, "customer").select("c_custkey", text.alias("css"))


_RGB_SQL = """(SELECT c_custkey, c_custkey % 256 AS r, c_custkey * 3 % 256 AS g, c_custkey * 7 % 256 AS b,
    CASE WHEN c_custkey % 10 = 3 THEN 'bad' WHEN c_custkey % 10 = 7 THEN 'null' ELSE 'ok' END AS kind FROM customer)"""


@query(
    "grayscale",
    f"""SELECT c_custkey, CASE kind WHEN 'bad' THEN '#aabbcc' WHEN 'ok' THEN 'rgba(' || v || ', ' || v || ', ' || v || ', 0.3)' END AS grey
        FROM (SELECT *, CAST(FLOOR(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INT) AS v FROM {_RGB_SQL})""",
)
def _(spark, sf):
    return _rgb_texts(spark, sf).select("c_custkey", C.grayscale(F.col("css"), 0.3).alias("grey"))


@query(
    "parse_rgb",
    f"""SELECT c_custkey, CASE kind WHEN 'bad' THEN 0.5 WHEN 'ok' THEN ROUND(r / 255.0::DOUBLE, 6) END AS r,
          CASE kind WHEN 'bad' THEN 0.5 WHEN 'ok' THEN ROUND(g / 255.0::DOUBLE, 6) END AS g,
          CASE kind WHEN 'bad' THEN 0.5 WHEN 'ok' THEN ROUND(b / 255.0::DOUBLE, 6) END AS b FROM {_RGB_SQL}""",
)
def _(spark, sf):
    u = _rgb_texts(spark, sf).select("c_custkey", C.rgb_unit(F.col("css")).alias("u"))
    return u.select("c_custkey", *[F.round(F.col("u")[i], 6).alias(n) for i, n in enumerate("rgb")])


@query(
    "rgb_to_hex",
    f"""SELECT c_custkey, CASE WHEN kind = 'ok' THEN PRINTF('#%02x%02x%02x', r, g, b) END AS hex,
          CASE WHEN kind = 'ok' THEN r || ',' || g || ',' || b END AS rgb FROM {_RGB_SQL}""",
)
def _(spark, sf):
    """Colour text to hex and back."""
    h = _rgb_texts(spark, sf).select("c_custkey", C.rgb_to_hex(F.col("css")).alias("hex"))
    return h.select("c_custkey", "hex", C.hex_to_rgb(F.col("hex")).alias("rgb"))


@query(
    "truncate_path",
    sql(
        """SELECT seq, CASE WHEN path = 'unlabeled' THEN path ELSE SPLIT_PART(path, '.', 1) END AS level1, path AS level2, path AS level5 FROM edits""",
        "edits",
    ),
)
def _(spark, sf):
    e, p = fx.label_events(spark, sf), F.col("path")
    return e.select("seq", P.truncate(p, 1).alias("level1"), P.truncate(p, 2).alias("level2"), P.truncate(p, 5).alias("level5"))


@query(
    "color_fallback",
    sql(
        """SELECT e.seq, e.path, h.hex, CASE WHEN h.hex IS NOT NULL THEN 'rgb(' || CAST('0x' || SUBSTR(h.hex, 2, 2) AS INT) || ','
             || CAST('0x' || SUBSTR(h.hex, 4, 2) AS INT) || ',' || CAST('0x' || SUBSTR(h.hex, 6, 2) AS INT) || ')' END AS css
           FROM edits e LEFT JOIN path_hex h USING (path)""",
        "edits", "path_hex",
    ),
)
def _(spark, sf):
    e = fx.label_events(spark, sf).select("seq", "path")
    shade = hierarchy.path_colors(e, fx.hierarchy_colors(spark, sf))
    return e.join(shade, "path", "left").select("seq", "path", "hex", "css")


@query(
    "kebab_case",
    """SELECT doc_id, TRIM(REGEXP_REPLACE(LOWER(text), '[^a-z0-9]+', '-', 'g'), '-') AS kebab FROM documents""",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", P.kebab(F.col("text")).alias("kebab"))


@query(
    "display_names",
    """SELECT c_custkey, REPLACE(n, '_', ' ') AS name, REPLACE(p, '.', ' > ') AS display_path FROM
         (SELECT c_custkey, LOWER(c_mktsegment) || '.n_' || c_nationkey || '.c_' || c_custkey AS p, 'c_' || c_custkey AS n FROM customer)""",
)
def _(spark, sf):
    c = fx.table(spark, sf, "customer")
    path = F.concat_ws(".", F.lower("c_mktsegment"), F.concat(F.lit("n_"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c_"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", P.display_name(path).alias("name"), P.display_path(path).alias("display_path"))


_LONLAT_SQL = "(SELECT event_id, CAST(event_id * 37 % 3600 / 10.0 - 180 AS DOUBLE) AS lon, CAST(event_id * 53 % 1800 / 10.0 - 90 AS DOUBLE) AS lat, CAST(event_id % 20 AS INT) AS z FROM events)"


def _lonlat(spark, sf):
    e = F.col("event_id")
    return fx.table(spark, sf, "events").select(
        "event_id", (e * 37 % 3600 / 10.0 - 180).alias("lon"), (e * 53 % 1800 / 10.0 - 90).alias("lat"), (e % 20).cast("int").alias("z")
    )


@query(
    "lonlat_to_tile",
    f"""SELECT event_id, z, CAST(GREATEST(0, LEAST(n - 1, TRUNC((lon + 180) / 360 * n))) AS INT) AS x,
          CAST(GREATEST(0, LEAST(n - 1, TRUNC((1.0 - ASINH(TAN(RADIANS(lat))) / PI()) / 2.0 * n))) AS INT) AS y
        FROM (SELECT *, POW(2.0, z) AS n FROM {_LONLAT_SQL})""",
)
def _(spark, sf):
    t = _lonlat(spark, sf).select("event_id", "z", G.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z")).alias("t"))
    return t.select("event_id", "z", "t.x", "t.y")


@query(
    "tile_origin",
    f"""SELECT event_id, ROUND(x * e - 20037508.342789244::DOUBLE, 4) AS west, ROUND(20037508.342789244::DOUBLE - y * e, 4) AS north, ROUND(e / 256, 6) AS resolution
        FROM (SELECT event_id, z, event_id % 64 AS x, event_id % 32 AS y, 2 * 20037508.342789244::DOUBLE / POW(2.0, z) AS e FROM {_LONLAT_SQL})""",
)
def _(spark, sf):
    e = _lonlat(spark, sf)
    o = G.tile_origin(F.col("event_id") % 64, F.col("event_id") % 32, F.col("z"))
    return e.select("event_id", F.round(o["west"], 4).alias("west"), F.round(o["north"], 4).alias("north"), F.round(G.tile_resolution(F.col("z")), 6).alias("resolution"))


def _areas(spark, sf):
    """Map box of every feature."""
    v = fx.features(spark, sf).select("feature_id", F.explode(F.flatten("rings")).alias("v"))
    return v.groupBy("feature_id").agg(
        F.min("v.lng").alias("west"), F.min("v.lat").alias("south"), F.max("v.lng").alias("east"), F.max("v.lat").alias("north"))


_NEED_SQL = """SELECT feature_id, 12 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM
    (SELECT *, UNNEST(RANGE(ya, yb + 1)) AS y FROM (SELECT *, UNNEST(RANGE(xa, xb + 1)) AS x FROM
      (SELECT feature_id, CAST(TRUNC((80 + (x0 + 0.25::DOUBLE) * 0.0625 + 180) / 360 * 4096) AS BIGINT) AS xa,
         CAST(TRUNC((80 + (x0 + w + 0.25::DOUBLE) * 0.0625 + 180) / 360 * 4096) AS BIGINT) AS xb,
         CAST(TRUNC((1.0 - ASINH(TAN(RADIANS(12 - (y0 + 0.25::DOUBLE) * 0.0625))) / PI()) / 2.0 * 4096) AS BIGINT) AS ya,
         CAST(TRUNC((1.0 - ASINH(TAN(RADIANS(12 - (y0 + h + 0.25::DOUBLE) * 0.0625))) / PI()) / 2.0 * 4096) AS BIGINT) AS yb FROM feat)))
    WHERE x <= 4095"""


@query("tiles_for_bbox", sql(_NEED_SQL, "feat"))
def _(spark, sf):
    return G.tiles_for_bbox(_areas(spark, sf), 12).select("feature_id", "z", "x", "y")


@query(
    "bbox_of_corners",
    """SELECT l_orderkey, l_linenumber, l_partkey, GREATEST(l_quantity, l_discount * 100) AS north, LEAST(l_quantity, l_discount * 100) AS south,
         GREATEST(l_tax * 100, l_quantity / 2) AS east, LEAST(l_tax * 100, l_quantity / 2) AS west,
         (l_quantity + l_discount * 100) / 2 AS center_lat, (l_tax * 100 + l_quantity / 2) / 2 AS center_lng FROM lineitem""",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    return li.select("l_orderkey", "l_linenumber", "l_partkey", G.bbox_of_corners(q, t, d, q / 2).alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")


# --- hierarchies ------------------------------------------------------------------------------


@query(
    "flatten_hierarchy",
    """SELECT c_custkey, path, display_path, level, name, is_leaf, order_key FROM (
         SELECT c_custkey, LOWER(c_mktsegment) AS path, LOWER(c_mktsegment) AS display_path, 0 AS level, LOWER(c_mktsegment) AS name, FALSE AS is_leaf, '0' AS order_key FROM customer
         UNION ALL SELECT c_custkey, LOWER(c_mktsegment) || '.n' || c_nationkey, LOWER(c_mktsegment) || ' > n' || c_nationkey, 1, 'n' || c_nationkey, c_custkey % 3 <> 0, '0,0' FROM customer
         UNION ALL SELECT c_custkey, LOWER(c_mktsegment) || '.n' || c_nationkey || '.deep', LOWER(c_mktsegment) || ' > n' || c_nationkey || ' > deep', 2, 'deep', TRUE, '0,0,0' FROM customer WHERE c_custkey % 3 = 0
         UNION ALL SELECT c_custkey, LOWER(c_mktsegment) || '.b', LOWER(c_mktsegment) || ' > b', 1, 'b', TRUE, '0,1' FROM customer
         UNION ALL SELECT c_custkey, 'other', 'other', 0, 'other', TRUE, '1' FROM customer)""",
)
def _(spark, sf):
    """One small document per customer."""
    c = fx.table(spark, sf, "customer")
    deep = F.when(F.col("c_custkey") % 3 == 0, F.lit(',"deep":{}')).otherwise(F.lit(""))
    doc = F.concat(
        F.lit('{"'), F.lower("c_mktsegment"), F.lit('":{"_name":"x","n'), F.col("c_nationkey").cast("string"),
        F.lit('":{"_description":"d"'), deep, F.lit('},"b":{}},"other":{"_name":"o"},"_note":"n"}'),
    )
    flat = hierarchy.flatten_hierarchy(c.select("c_custkey", doc.alias("hierarchy")))
    return flat.withColumn("order_key", F.concat_ws(",", F.col("order_key").cast("array<string>")))


@query(
    "selectable_options",
    """SELECT path, level, description, is_leaf FROM (
         SELECT 'unlabeled' AS path, 0 AS level, 'Not yet classified' AS description, TRUE AS is_leaf
         UNION ALL SELECT 'parts', 0, 'parts', FALSE
         UNION ALL SELECT DISTINCT 'parts.' || LOWER(p_type), 1, LOWER(p_type), TRUE FROM part)""",
)
def _(spark, sf):
    kinds = fx.table(spark, sf, "part").agg(F.sort_array(F.collect_set(F.lower("p_type"))).alias("t"))
    members = F.array_join(F.transform("t", lambda t: F.concat(F.lit('"'), t, F.lit('":{}'))), ",")
    doc = kinds.select(F.concat(F.lit('{"parts":{'), members, F.lit("}}")).alias("hierarchy"))
    return hierarchy.selectable_options(hierarchy.flatten_hierarchy(doc)).select("path", "level", "description", "is_leaf")


def _brand_paths(spark, sf):
    """Hierarchy rows ``type`` and ``type.brand`` from the parts."""
    p = fx.table(spark, sf, "part").select(P.kebab(F.col("p_type")).alias("t"), P.kebab(F.col("p_brand")).alias("b"))
    return p.select(F.concat_ws(".", "t", "b").alias("path")).unionByName(p.select(F.col("t").alias("path"))).distinct()


_BRANDS_SQL = """(SELECT DISTINCT LOWER(p_type) || '.' || REPLACE(LOWER(p_brand), '#', '-') AS path FROM part UNION SELECT DISTINCT LOWER(p_type) FROM part)"""


@query("paths_by_prefix", f"SELECT path FROM {_BRANDS_SQL} WHERE path LIKE 'economy.brand-1%'")
def _(spark, sf):
    return hierarchy.by_prefix(_brand_paths(spark, sf), "economy.brand-1")


@query(
    "items_at_level",
    f"""SELECT path, SPLIT_PART(path, '.', 2) AS name, REPLACE(path, '.', ' > ') AS display_path, '#0000' || SUBSTR(MD5(SPLIT_PART(path, '.', 1)), 1, 2) AS hex
        FROM {_BRANDS_SQL} WHERE path LIKE '%.%'""",
)
def _(spark, sf):
    rows = _brand_paths(spark, sf)
    colors = rows.filter(~F.col("path").contains(".")).select("path", F.concat(F.lit("0000"), F.substring(F.md5("path"), 1, 2)).alias("hex"))
    return hierarchy.items_at_level(rows, colors, 2)


@query(
    "hierarchy_rollup",
    sql(
        """WITH used AS (SELECT path, SUM(area_ha) AS a FROM reg WHERE path <> 'unlabeled' GROUP BY 1),
             steps AS (SELECT path AS p, path, a FROM used UNION ALL SELECT SPLIT_PART(path, '.', 1), path, a FROM used),
             nodes AS (SELECT p AS path, COUNT(*) AS n_paths, CAST(SUM(a) AS DECIMAL(18,2)) AS area_ha, MAX(p = path) AS has_direct FROM steps GROUP BY 1)
           SELECT n.path, CASE WHEN n.path LIKE '%.%' THEN SPLIT_PART(n.path, '.', 1) END AS parent_path, SPLIT_PART(n.path, '.', -1) AS name,
             CASE WHEN n.path LIKE '%.%' THEN 2 ELSE 1 END AS level, n_paths, area_ha, has_direct, COALESCE(h.hex, c.hex) AS hex
           FROM nodes n LEFT JOIN path_hex h ON h.path = n.path LEFT JOIN colors c ON c.path = n.path""",
        "reg", "path_hex",
    ),
)
def _(spark, sf):
    return hierarchy.hierarchy_rollup(fx.registry(spark, sf), 2, fx.hierarchy_colors(spark, sf))


_PROP_SQL = """(SELECT feature_id, 'segment' AS field, segment AS value FROM feat UNION ALL SELECT feature_id, 'nation', nation FROM feat
    UNION ALL SELECT feature_id, 'code', code FROM feat WHERE code IS NOT NULL)"""


@query(
    "field_profile",
    sql(
        f"""WITH v AS (SELECT field, value, COUNT(*) AS n, MIN(feature_id) AS f FROM {_PROP_SQL} GROUP BY 1, 2),
              r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY f) AS rn FROM v)
            SELECT field, CAST(SUM(n) AS BIGINT) AS n_values, COUNT(*) AS n_distinct, STRING_AGG(value, '|' ORDER BY rn) FILTER (rn <= 5) AS samples FROM r GROUP BY 1""",
        "feat",
    ),
)
def _(spark, sf):
    return hierarchy.field_profile(fx.features(spark, sf)).withColumn("samples", F.array_join("samples", "|"))


@query(
    "flat_hierarchy",
    sql("SELECT LOWER(REPLACE(TRIM(nation), ' ', '-')) AS path, ARG_MAX(TRIM(nation), feature_id) AS name, 1 AS level, TRUE AS is_leaf FROM feat GROUP BY 1", "feat"),
)
def _(spark, sf):
    return hierarchy.flat_hierarchy(fx.features(spark, sf), "nation").drop("parent_path")


@query(
    "two_level_hierarchy",
    sql(
        """WITH p AS (SELECT LOWER(segment) AS pk, LOWER(code) AS ck, ARG_MIN(segment, feature_id) AS pn, ARG_MIN(code, feature_id) AS cn FROM feat WHERE code IS NOT NULL GROUP BY 1, 2)
           SELECT pk || '.' || ck AS path, pk AS parent_path, cn AS name, 2 AS level, TRUE AS is_leaf, 0::BIGINT AS n_children FROM p
           UNION ALL SELECT pk, NULL, ANY_VALUE(pn), 1, FALSE, COUNT(*) FROM p GROUP BY pk""",
        "feat",
    ),
)
def _(spark, sf):
    return hierarchy.two_level_hierarchy(fx.features(spark, sf), "segment", "code")


# --- overlays ---------------------------------------------------------------------------------


@query("constant_raster", sql("SELECT raster_key, y, x, 7 AS value FROM pixels", "pixels"))
def _(spark, sf):
    return overlay.constant_raster(fx.raster_meta(spark, sf), 7)


@query("synthetic_raster", sql("SELECT 'synthetic_seg' AS raster_key, y, x, CASE WHEN value = -1 THEN -1 ELSE 9999 END AS value FROM pixels WHERE raster_key = 'k10'", "pixels"))
def _(spark, sf):
    return overlay.synthetic_raster(fx.pixels(spark, sf), "k10").pixels


@query(
    "synthetic_registry",
    sql(
        """SELECT 'synthetic_seg' AS raster_key, 9999 AS cluster_id, COUNT(*) AS pixel_count, 'unlabeled' AS classification_path,
             CAST(COUNT(*) * 0.01 AS DECIMAL(18,2)) AS area_ha FROM pixels WHERE raster_key = 'k10' AND value <> -1""",
        "pixels",
    ),
)
def _(spark, sf):
    return overlay.synthetic_raster(fx.pixels(spark, sf), "k10").registry.drop("color")


@query("composite_placeholder", sql("SELECT 'composite_seg' AS raster_key, y, x, 9999 AS value FROM pixels WHERE raster_key = 'k10'", "pixels"))
def _(spark, sf):
    return overlay.composite_placeholder(fx.pixels(spark, sf), "k10")


def _with_synthetic(spark, sf):
    """Registry with labelled synthetic rows next to the regular rasters."""
    reg = fx.registry(spark, sf)
    own = reg.filter("raster_key = 'k5'").withColumn("raster_key", F.lit(S.SYNTHETIC_KEY)).withColumn("cluster_id", F.col("cluster_id") + 10000)
    return stage(reg.unionByName(own).unionByName(own.withColumn("raster_key", F.lit(S.COMPOSITE_KEY))), "registry")


@query("composite_inputs", sql("SELECT raster_key, CAST(ROW_NUMBER() OVER (ORDER BY k DESC) AS INT) AS prio FROM (SELECT DISTINCT raster_key, CAST(SUBSTR(raster_key, 2) AS INT) AS k FROM reg UNION ALL SELECT 'synthetic_seg', 99)", "reg"))
def _(spark, sf):
    return overlay.composite_inputs(_with_synthetic(spark, sf))


@query("composite_ids", sql("SELECT raster_key, cluster_id, path AS classification_path, uid FROM uids", "uids"))
def _(spark, sf):
    return overlay.composite_ids(fx.registry(spark, sf)).select("raster_key", "cluster_id", "classification_path", "uid")


@query("composite", sql("SELECT 'composite_seg' AS raster_key, y, x, value FROM comp", "comp"))
def _(spark, sf):
    return overlay.composite(fx.segmented(spark, sf)).pixels


@query("composite_blocks", sql("SELECT 'composite_seg' AS raster_key, y, x, value FROM comp", "comp"))
def _(spark, sf):
    """The composite on block storage: one row and one shuffled array per block."""
    seg = fx.segmented(spark, sf)
    packed = blocks.blocks_from_pixels(seg.pixels, 16)
    out = blocks.pixels_from_blocks(blocks.composite_blocks(packed, seg.registry), 16)
    grid = _grid(spark, sf).select("width", "height").first()
    return out.filter((F.col("x") < grid["width"]) & (F.col("y") < grid["height"]))


@query("count_pixels_blocks", sql("SELECT * FROM counts", "counts"))
def _(spark, sf):
    return blocks.count_pixels_blocks(blocks.blocks_from_pixels(fx.pixels(spark, sf), 16))


@query(
    "composite_lowest_k",
    sql(
        """WITH u AS (SELECT raster_key, cluster_id, ROW_NUMBER() OVER (ORDER BY k, cluster_id) AS uid FROM reg JOIN ks USING (raster_key) WHERE path <> 'unlabeled')
           SELECT y, x, CAST(CASE WHEN MAX(CASE WHEN p.raster_key = 'k5' THEN value END) = -1 THEN -1 ELSE COALESCE(MIN(uid), 9999) END AS INT) AS value
           FROM pixels p LEFT JOIN u ON u.raster_key = p.raster_key AND u.cluster_id = p.value GROUP BY y, x""",
        "pixels", "reg",
    ),
)
def _(spark, sf):
    return overlay.composite(fx.segmented(spark, sf), "lowest_k").pixels.select("y", "x", "value")


@query(
    "composite_registry",
    sql(
        """SELECT 'composite_seg' AS raster_key, c.cluster_id, pixel_count, c.path AS classification_path,
             'rgb(' || CAST('0x' || SUBSTR(h.hex, 2, 2) AS INT) || ',' || CAST('0x' || SUBSTR(h.hex, 4, 2) AS INT)
                       || ',' || CAST('0x' || SUBSTR(h.hex, 6, 2) AS INT) || ')' AS color, area_ha, source_raster, source_id
           FROM comp_reg c JOIN path_hex h USING (path)""",
        "comp_reg", "path_hex",
    ),
)
def _(spark, sf):
    return overlay.composite(fx.segmented(spark, sf), colors=fx.hierarchy_colors(spark, sf)).registry


@query(
    "merge_rasters",
    sql(
        """SELECT a.y, a.x, CAST(CASE WHEN a.value = -1 OR (a.x + a.y) % 4 = 0 THEN b.value ELSE a.value * 100 + b.value END AS INT) AS value
           FROM pixels a JOIN pixels b ON b.y = a.y AND b.x = a.x WHERE a.raster_key = 'k5' AND b.raster_key = 'k20'""",
        "pixels",
    ),
)
def _(spark, sf):
    px, meta = fx.pixels(spark, sf), fx.raster_meta(spark, sf)
    metas = meta.filter("k = 5"), meta.filter("k = 20")
    decide = lambda a, b, y, x: F.when((a == -1) | ((x + y) % 4 == 0), b).otherwise(a * 100 + b)
    return overlay.merge(px.filter("raster_key = 'k5'"), px.filter("raster_key = 'k20'"), decide, metas=metas).select("y", "x", "value")


def _interactive(spark, sf):
    seg = fx.segmented(spark, sf)
    made = overlay.composite(seg)
    current = S.SegmentedRaster(seg.pixels.filter("raster_key = 'k10'"), seg.registry.filter("raster_key = 'k10'"))
    return overlay.interactive(made, current, fx.hierarchy_colors(spark, sf), level=1)


@query(
    "interactive",
    sql(
        """SELECT 'interactive_seg' AS raster_key, r.y, r.x, COALESCE(i.id, -1) AS value, CAST(r.value AS INT) AS source_id
           FROM inter_raw r LEFT JOIN inter_keys k ON k.y = r.y AND k.x = r.x LEFT JOIN inter_ids i ON i.key = k.key""",
        "inter_raw", "inter_ids",
    ),
)
def _(spark, sf):
    return _interactive(spark, sf).pixels


@query(
    "interactive_registry",
    sql(
        """SELECT id AS cluster_id, n AS pixel_count, i.path AS classification_path,
             'rgb(' || CAST('0x' || SUBSTR(h.hex, 2, 2) AS INT) || ',' || CAST('0x' || SUBSTR(h.hex, 4, 2) AS INT)
                       || ',' || CAST('0x' || SUBSTR(h.hex, 6, 2) AS INT) || ')' AS color, i.key AS source_key
           FROM inter_ids i LEFT JOIN colors h ON h.path = SPLIT_PART(i.path, '.', 1)""",
        "inter_ids", "colors",
    ),
)
def _(spark, sf):
    return _interactive(spark, sf).registry.select("cluster_id", "pixel_count", "classification_path", "color", "source_key")


@query(
    "registry_union",
    sql(
        """SELECT cluster_id, pixel_count, path AS classification_path FROM comp_reg
           UNION ALL SELECT cluster_id + 50000, pixel_count, 'unlabeled' FROM reg WHERE raster_key = 'k10'""",
        "comp_reg", "reg",
    ),
)
def _(spark, sf):
    seg = fx.segmented(spark, sf)
    both = overlay.interactive_registry(overlay.composite(seg).registry, seg.registry.filter("raster_key = 'k10'"))
    return both.select("cluster_id", "pixel_count", "classification_path")


_MAP_SQL = """map1 AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY path) - 1 AS INT) AS id, path FROM
      (SELECT DISTINCT SPLIT_PART(u.path, '.', 1) AS path FROM comp c JOIN uids u ON u.uid = c.value)
    UNION ALL SELECT DISTINCT 9999, 'unlabeled' FROM comp WHERE value = 9999)"""


def _composite_staged(spark, sf):
    made = overlay.composite(fx.segmented(spark, sf))
    return S.SegmentedRaster(stage(made.pixels, "composite"), made.registry)


@query("pixel_mapping", sql(f"WITH {_MAP_SQL} SELECT m.id, m.path, c.hex FROM map1 m LEFT JOIN colors c ON c.path = m.path", "comp", "uids", "colors"))
def _(spark, sf):
    return overlay.pixel_mapping(_composite_staged(spark, sf), 1, fx.hierarchy_colors(spark, sf))


@query(
    "color_mapping",
    sql(
        f"""WITH {_MAP_SQL} SELECT m.id, m.path, c.hex FROM map1 m JOIN colors c ON c.path = m.path
            UNION ALL SELECT -1, NULL, '#000000' UNION ALL SELECT 9999, 'unlabeled', NULL""",
        "comp", "uids", "colors",
    ),
)
def _(spark, sf):
    return overlay.color_mapping(overlay.pixel_mapping(_composite_staged(spark, sf), 1), fx.hierarchy_colors(spark, sf))


@query(
    "classification_raster",
    sql(
        f"""WITH {_MAP_SQL} SELECT 'composite_seg' AS raster_key, y, x, CASE WHEN c.value = -1 THEN -1 ELSE COALESCE(m.id, 9999) END AS class_id
            FROM comp c LEFT JOIN uids u ON u.uid = c.value LEFT JOIN map1 m ON m.path = SPLIT_PART(u.path, '.', 1)""",
        "comp", "uids",
    ),
)
def _(spark, sf):
    return overlay.classification_raster(_composite_staged(spark, sf), 1)


@query(
    "land_cover_export",
    sql(
        f"""WITH {_MAP_SQL} SELECT 'composite_seg' AS raster_key, y, x, CASE WHEN c.value = -1 THEN -1 ELSE COALESCE(m.id, 9999) END AS class_id
            FROM comp c LEFT JOIN uids u ON u.uid = c.value LEFT JOIN map1 m ON m.path = SPLIT_PART(u.path, '.', 1)""",
        "comp", "uids",
    ),
)
def _(spark, sf):
    """The export of mapping, colours and narrowed class raster, read back."""
    folder = f"{scratch_dir(spark)}/land-cover-{uuid.uuid4().hex}"
    seg, colors = _composite_staged(spark, sf), fx.hierarchy_colors(spark, sf)
    mapping = stage(overlay.pixel_mapping(seg, 1), "mapping")
    tables.export_land_cover(overlay.classification_raster(seg, 1), mapping, overlay.color_mapping(mapping, colors), folder)
    return spark.read.parquet(f"{folder}/land-cover").withColumn("class_id", F.col("class_id").cast("int"))


# --- colours of pixels --------------------------------------------------------------------------


_GREY = "CAST(FLOOR(0.299::DOUBLE * (cluster_id * 9 % 256) + 0.587::DOUBLE * (cluster_id * 5 % 256) + 0.114::DOUBLE * (cluster_id * 12 % 256) + 0.5) AS INT)"


@query(
    "cluster_colors",
    sql(
        f"""WITH g AS (SELECT *, {_GREY} AS v FROM creg)
            SELECT p.raster_key, p.y, p.x, p.value, CASE WHEN p.value = -1 THEN NULL WHEN p.value = 4 THEN 'rgba(0, 0, 0, 1)' WHEN g.color IS NULL THEN NULL
              WHEN g.cluster_id % 5 = 1 THEN 'rgba(' || v || ', ' || v || ', ' || v || ', 0.3)'
              WHEN g.path <> 'unlabeled' THEN 'rgba(' || v || ', ' || v || ', ' || v || ', 1)' ELSE g.color END AS color
            FROM pixels p LEFT JOIN g ON g.raster_key = p.raster_key AND g.cluster_id = p.value""",
        "pixels", "creg",
    ),
)
def _(spark, sf):
    seg = fx.segmented(spark, sf, colored=True)
    return render.cluster_colors(seg, selected=4, shown=seg.registry.filter("cluster_id % 5 <> 1"), grayscale_labeled=True)


_CSS = "'rgb(' || CAST('0x' || SUBSTR(h.hex, 2, 2) AS INT) || ',' || CAST('0x' || SUBSTR(h.hex, 4, 2) AS INT) || ',' || CAST('0x' || SUBSTR(h.hex, 6, 2) AS INT) || ')'"


@query(
    "class_colors",
    sql(
        f"""SELECT p.raster_key, p.y, p.x, p.value, CASE WHEN p.value = -1 THEN NULL WHEN p.value = 3 THEN 'rgba(0, 0, 0, 1)'
              WHEN r.path = 'unlabeled' THEN r.color ELSE {_CSS} END AS color
            FROM pixels p LEFT JOIN creg r ON r.raster_key = p.raster_key AND r.cluster_id = p.value LEFT JOIN colors h ON h.path = SPLIT_PART(r.path, '.', 1)""",
        "pixels", "creg", "colors",
    ),
)
def _(spark, sf):
    return render.class_colors(fx.segmented(spark, sf, colored=True), fx.hierarchy_colors(spark, sf), 1, selected=3)


@query(
    "composite_colors",
    sql(
        f"""SELECT 'composite_seg' AS raster_key, c.y, c.x, c.value, {_CSS} AS color
            FROM comp c LEFT JOIN uids u ON u.uid = c.value LEFT JOIN path_hex h ON h.path = u.path""",
        "comp", "uids", "path_hex",
    ),
)
def _(spark, sf):
    return render.composite_colors(_composite_staged(spark, sf), fx.hierarchy_colors(spark, sf))


def _export(spark, sf):
    """Classes at level 2 with colours of some regions taken away."""
    seg = _composite_staged(spark, sf)
    colors = fx.hierarchy_colors(spark, sf).filter(~F.col("path").isin("africa", "asia"))
    return overlay.classification_raster(seg, 2), overlay.pixel_mapping(seg, 2), colors


_MAP2_SQL = """map2 AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY path) - 1 AS INT) AS id, path FROM (SELECT DISTINCT u.path FROM comp c JOIN uids u ON u.uid = c.value)),
    col2 AS (SELECT * FROM colors WHERE path NOT IN ('africa', 'asia')),
    px2 AS (SELECT c.y, c.x, CASE WHEN c.value = -1 THEN -1 ELSE COALESCE(m.id, 9999) END AS class_id, m.path, COALESCE(a.hex, b.hex, '#888888') AS hex
            FROM comp c LEFT JOIN uids u ON u.uid = c.value LEFT JOIN map2 m ON m.path = u.path
              LEFT JOIN col2 a ON a.path = m.path LEFT JOIN col2 b ON b.path = SPLIT_PART(m.path, '.', 1))"""


@query("export_colors", sql(f"WITH {_MAP2_SQL} SELECT y, x, class_id, CASE WHEN class_id <> -1 THEN hex END AS hex FROM px2", "comp", "uids", "colors"))
def _(spark, sf):
    return render.export_colors(*_export(spark, sf)).select("y", "x", "class_id", "hex")


@query(
    "render_image",
    sql(
        f"""WITH {_MAP2_SQL}, im AS (SELECT *, CASE WHEN class_id = -1 THEN NULL WHEN class_id = 9999 THEN '#000000' ELSE hex END AS h FROM px2)
            SELECT CAST(y * 2 + dy AS INT) AS y, CAST(x * 2 + dx AS INT) AS x, COALESCE(CAST(CONCAT('0x', SUBSTR(h, 2, 2)) AS INT), 0) AS r,
              COALESCE(CAST(CONCAT('0x', SUBSTR(h, 4, 2)) AS INT), 0) AS g, COALESCE(CAST(CONCAT('0x', SUBSTR(h, 6, 2)) AS INT), 0) AS b,
              CASE WHEN h IS NULL THEN 0 ELSE 255 END AS a
            FROM im, (SELECT UNNEST([0, 1]) AS dy), (SELECT UNNEST([0, 1]) AS dx)""".replace("CONCAT('0x', SUBSTR(h, 2, 2))", "'0x' || SUBSTR(h, 2, 2)")
        .replace("CONCAT('0x', SUBSTR(h, 4, 2))", "'0x' || SUBSTR(h, 4, 2)").replace("CONCAT('0x', SUBSTR(h, 6, 2))", "'0x' || SUBSTR(h, 6, 2)"),
        "comp", "uids", "colors",
    ),
)
def _(spark, sf):
    return render.render_image(*_export(spark, sf), scale=2).select("y", "x", "r", "g", "b", "a")


# --- polygons and points --------------------------------------------------------------------------


def _grid(spark, sf):
    return fx.raster_meta(spark, sf).filter("k = 5")


@query("rasterize", sql("SELECT * FROM burn", "burn"))
def _(spark, sf):
    return zonal.rasterize(fx.features(spark, sf), _grid(spark, sf))


@query(
    "rasterize_filled",
    sql("SELECT p.y, p.x, COALESCE(b.feature_id, 0) AS feature_id FROM pixels p LEFT JOIN burn b ON b.y = p.y AND b.x = p.x WHERE raster_key = 'k5'", "pixels", "burn"),
)
def _(spark, sf):
    return zonal.rasterize(fx.features(spark, sf), _grid(spark, sf), fill=True)


def _zonal(spark, sf, min_pct=zonal.MIN_PCT):
    return zonal.zonal_intersection(fx.pixels(spark, sf), zonal.burn(fx.features(spark, sf), _grid(spark, sf)), min_pct)


@query("zonal_intersection", sql("SELECT raster_key, feature_id, cluster_id, pct, pixel_count, passes FROM zonal", "zonal"))
def _(spark, sf):
    return _zonal(spark, sf)


_Z = "z AS (SELECT raster_key, feature_id, cluster_id, pct, pixel_count, pct_raw >= 0.1 AS passes FROM zonal)"


@query(
    "feature_filter",
    sql(
        f"""WITH {_Z} SELECT z.raster_key, feature_id, z.cluster_id, pct, z.pixel_count, r.pixel_count AS cluster_size
            FROM z JOIN reg r ON r.raster_key = z.raster_key AND r.cluster_id = z.cluster_id WHERE passes AND pct >= 0.2""",
        "zonal", "reg",
    ),
)
def _(spark, sf):
    return zonal.filter_by_feature(_zonal(spark, sf, 0.1), fx.registry(spark, sf), 0.2, min_pct=0.1)


@query(
    "feature_coverage",
    sql(
        f"""WITH {_Z} SELECT raster_key, feature_id, COUNT(*) FILTER (pct >= 0.2) AS n_clusters,
              ROUND(COALESCE(SUM(pixel_count) FILTER (pct >= 0.2), 0) / SUM(pixel_count) * 100, 6) AS coverage_pct FROM z WHERE passes GROUP BY 1, 2""",
        "zonal",
    ),
)
def _(spark, sf):
    return zonal.feature_coverage(_zonal(spark, sf, 0.1), 0.2, min_pct=0.1).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query(
    "cluster_list",
    sql(
        f"""WITH {_Z} SELECT r.raster_key, r.cluster_id, r.path, r.pixel_count, z.pct, z.pixel_count AS inside_count, z.pct IS NOT NULL AS is_filtered
            FROM reg r LEFT JOIN z ON z.raster_key = r.raster_key AND z.cluster_id = r.cluster_id AND z.feature_id = 7 AND z.passes AND z.pct >= 0.2""",
        "zonal", "reg",
    ),
)
def _(spark, sf):
    out = zonal.cluster_list(fx.registry(spark, sf), _zonal(spark, sf, 0.1), 7, 0.2, min_pct=0.1)
    return out.select("raster_key", "cluster_id", F.col("classification_path").alias("path"), "pixel_count", "pct", "inside_count", "is_filtered")


@query(
    "intersections_by_feature",
    sql(f"WITH {_Z} SELECT raster_key, feature_id, cluster_id, pct, pixel_count FROM z WHERE passes", "zonal"),
)
def _(spark, sf):
    return zonal.by_feature(_zonal(spark, sf, 0.1)).drop("passes")


@query("intersections_by_cluster", sql("SELECT raster_key, feature_id, cluster_id, pct, pixel_count FROM zonal", "zonal"))
def _(spark, sf):
    return zonal.by_cluster(_zonal(spark, sf)).drop("passes")


@query(
    "attach_properties",
    sql("SELECT raster_key, z.feature_id, cluster_id, pixel_count, segment, nation, code FROM zonal z JOIN feat f ON f.feature_id = z.feature_id", "zonal", "feat"),
)
def _(spark, sf):
    out = zonal.attach_properties(_zonal(spark, sf), fx.features(spark, sf))
    return out.select("raster_key", "feature_id", "cluster_id", "pixel_count", *[F.col("properties")[c].alias(c) for c in ("segment", "nation", "code")])


_SAMPLE_SQL = """s AS (SELECT t.point_id, m.raster_key, CASE WHEN gx < 50 AND gy < m.height THEN CAST(gx AS INT) END AS x,
      CASE WHEN gx < 50 AND gy < m.height THEN CAST(gy AS INT) END AS y FROM pts t CROSS JOIN meta m),
    sv AS (SELECT s.*, p.value AS cluster_id, CASE WHEN p.value IS NOT NULL THEN COALESCE(r.path, 'unlabeled') END AS path FROM s
      LEFT JOIN pixels p ON p.raster_key = s.raster_key AND p.y = s.y AND p.x = s.x LEFT JOIN reg r ON r.raster_key = s.raster_key AND r.cluster_id = p.value)"""


@query("sample_points", sql(f"WITH {_SAMPLE_SQL} SELECT point_id, raster_key, x, y, cluster_id, path FROM sv", "pts", "meta", "pixels", "reg"))
def _(spark, sf):
    return zonal.sample_points(fx.points(spark, sf), fx.raster_meta(spark, sf), fx.segmented(spark, sf))


@query("select_clusters", sql(f"WITH {_SAMPLE_SQL} SELECT point_id, raster_key, CASE WHEN cluster_id >= 0 THEN cluster_id END AS cluster_id FROM sv", "pts", "meta", "pixels", "reg"))
def _(spark, sf):
    return zonal.select_clusters(zonal.sample_points(fx.points(spark, sf), fx.raster_meta(spark, sf), fx.segmented(spark, sf)))


@query("feature_bounds", sql("SELECT 80 + (MIN(x0) + 0.25::DOUBLE) * 0.0625 AS west, 12 - (MAX(y0 + h) + 0.25::DOUBLE) * 0.0625 AS south, 80 + (MAX(x0 + w) + 0.25::DOUBLE) * 0.0625 AS east, 12 - (MIN(y0) + 0.25::DOUBLE) * 0.0625 AS north FROM feat", "feat"))
def _(spark, sf):
    return zonal_bounds(spark, sf)


def zonal_bounds(spark, sf):
    return tiles.feature_bounds(fx.features(spark, sf))


# --- regions ------------------------------------------------------------------------------------


_OFF = "off8 AS (SELECT UNNEST([-1, 0, 1]) AS dy), off AS (SELECT a.dy, b.dy AS dx FROM off8 a, off8 b WHERE a.dy <> 0 OR b.dy <> 0)"


@query(
    "neighbors",
    sql(
        """SELECT p.raster_key, p.y, p.x, n.y AS ny, n.x AS nx, n.value AS neighbor_value FROM pixels p
           JOIN (SELECT a.d AS dy, b.d AS dx FROM (SELECT UNNEST([-1, 0, 1]) AS d) a, (SELECT UNNEST([-1, 0, 1]) AS d) b WHERE a.d <> 0 OR b.d <> 0) o ON TRUE
           JOIN pixels n ON n.raster_key = p.raster_key AND n.y = p.y + o.dy AND n.x = p.x + o.dx""",
        "pixels",
    ),
)
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return region.neighbors(px.select("raster_key", "y", "x"), px, diagonal=True).drop("offset")


def _feature_regions(spark, sf):
    """Regions of known shape: pixels by the feature that covers them."""
    burnt = zonal.rasterize(fx.features(spark, sf), _grid(spark, sf))
    return burnt.select(F.col("feature_id").cast("long").alias("region_id"), F.lit("k10").alias("raster_key"), "y", "x")


_VOTES_SQL = """v AS (SELECT b.feature_id AS region_id, r.path, COUNT(*) AS votes FROM burn b, off
      JOIN pixels p ON p.raster_key = 'k10' AND p.y = b.y + off.dy AND p.x = b.x + off.dx
      JOIN reg r ON r.raster_key = 'k10' AND r.cluster_id = p.value AND r.path <> 'unlabeled' GROUP BY 1, 2)"""


@query(
    "neighbor_votes",
    sql(
        f"""WITH {_OFF}, {_VOTES_SQL.replace('FROM burn b, off', 'FROM burn b CROSS JOIN off')}
            SELECT CAST(region_id AS BIGINT) AS region_id, path, votes, CAST(ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY votes DESC, path) AS INT) AS rank FROM v""",
        "burn", "pixels", "reg",
    ),
)
def _(spark, sf):
    return region.neighbor_votes(_feature_regions(spark, sf), fx.segmented(spark, sf))


# smallest position per component: labels spread along neighbours until nothing changes
_COMP_SQL = """c AS (SELECT raster_key, y, x, value, y * 50 + x AS pos FROM pixels WHERE raster_key IN ({keys})),
    e AS (SELECT a.raster_key, a.pos AS a, b.pos AS b FROM c a CROSS JOIN ({offs}) o
          JOIN c b ON b.raster_key = a.raster_key AND b.y = a.y + o.dy AND b.x = a.x + o.dx AND b.value = a.value),
    walk(raster_key, pos, root) USING KEY (raster_key, pos) AS (
      SELECT raster_key, pos, pos FROM c
      UNION
      SELECT e.raster_key, e.b, MIN(w.root) FROM walk w JOIN e ON e.raster_key = w.raster_key AND e.a = w.pos
        JOIN recurring.walk r ON r.raster_key = e.raster_key AND r.pos = e.b WHERE w.root < r.root GROUP BY 1, 2)"""
_OFFS8 = "SELECT a.d AS dy, b.d AS dx FROM (SELECT UNNEST([-1, 0, 1]) AS d) a, (SELECT UNNEST([-1, 0, 1]) AS d) b WHERE a.d <> 0 OR b.d <> 0"
_OFFS4 = "SELECT UNNEST([-1, 1, 0, 0]) AS dy, UNNEST([0, 0, -1, 1]) AS dx"


def _comp_sql(keys: str, diagonal: bool, tail: str, *needs: str) -> str:
    return sql("WITH " + _COMP_SQL.format(keys=keys, offs=_OFFS8 if diagonal else _OFFS4) + " " + tail, "pixels", *needs, recursive=True)


@query("components", _comp_sql("'k5', 'k10', 'k20'", True, "SELECT raster_key, CAST(FLOOR(pos / 50) AS INT) AS y, CAST(pos % 50 AS INT) AS x, CAST(root AS BIGINT) AS component_id FROM walk"))
def _(spark, sf):
    return region.components(fx.pixels(spark, sf), fx.raster_meta(spark, sf)).drop("value")


@query("components_4", _comp_sql("'k5', 'k10', 'k20'", False, "SELECT raster_key, CAST(FLOOR(pos / 50) AS INT) AS y, CAST(pos % 50 AS INT) AS x, CAST(root AS BIGINT) AS component_id FROM walk"))
def _(spark, sf):
    """4-neighbour components over blocks of 16, so many borders are crossed."""
    return region.components(fx.pixels(spark, sf), fx.raster_meta(spark, sf), diagonal=False, block=16).drop("value")


@query("component_sizes", _comp_sql("'k5', 'k10', 'k20'", True, "SELECT w.raster_key, CAST(root AS BIGINT) AS component_id, c.value, COUNT(*) AS pixel_count FROM walk w JOIN c ON c.raster_key = w.raster_key AND c.pos = w.pos GROUP BY 1, 2, 3"))
def _(spark, sf):
    return region.component_sizes(region.components(fx.pixels(spark, sf), fx.raster_meta(spark, sf)))


def _seeds(spark, sf):
    """One seed per supplier, spread over the three rasters and a little beyond them."""
    s = F.col("s_suppkey")
    key = F.element_at(F.array(F.lit("k5"), F.lit("k10"), F.lit("k20")), (s % 3 + 1).cast("int"))
    return fx.table(spark, sf, "supplier").select(
        s.alias("region_id"), key.alias("raster_key"), (s * 3).cast("int").alias("y"), ((s * 7) % 53).cast("int").alias("x")
    )


_SEED_SQL = "s AS (SELECT s_suppkey AS region_id, ['k5', 'k10', 'k20'][s_suppkey % 3 + 1] AS raster_key, s_suppkey * 3 AS y, (s_suppkey * 7) % 53 AS x FROM supplier)"


@query(
    "grow_regions",
    _comp_sql("'k5', 'k10', 'k20'", True, f""", {_SEED_SQL}
        SELECT s.region_id, CAST(FLOOR(w.pos / 50) AS INT) AS y, CAST(w.pos % 50 AS INT) AS x
        FROM s JOIN walk h ON h.raster_key = s.raster_key AND s.x < 50 AND h.pos = s.y * 50 + s.x JOIN walk w ON w.raster_key = h.raster_key AND w.root = h.root"""),
)
def _(spark, sf):
    return region.grow_regions(_seeds(spark, sf), fx.pixels(spark, sf)).select("region_id", "y", "x")


@query(
    "grow_regions_capped",
    _comp_sql("'k5', 'k10', 'k20'", True, f""", {_SEED_SQL}
        SELECT s.region_id, LEAST(COUNT(*), 30) AS pixel_count FROM s JOIN walk h ON h.raster_key = s.raster_key AND s.x < 50 AND h.pos = s.y * 50 + s.x
        JOIN walk w ON w.raster_key = h.raster_key AND w.root = h.root GROUP BY 1"""),
)
def _(spark, sf):
    """Growth that stops at 30 pixels; the order is tested on small grids."""
    grown = region.grow_regions(_seeds(spark, sf), fx.pixels(spark, sf), max_pixels=30)
    return grown.groupBy("region_id").agg(F.count(F.lit(1)).alias("pixel_count"))


def _picks(spark, sf):
    """Map points of the seeds."""
    s = _seeds(spark, sf)
    return s.select(
        F.col("region_id").alias("point_id"), "raster_key",
        (F.lit(80.0) + (F.col("x") + 0.5) * fx.PIXEL).alias("lng"), (F.lit(12.0) - (F.col("y") + 0.5) * fx.PIXEL).alias("lat"),
    )


_PICK_TAIL = f""", {_SEED_SQL},
    pick AS (SELECT s.region_id, s.raster_key, h.root FROM s JOIN walk h ON h.raster_key = s.raster_key AND s.x < 50 AND h.pos = s.y * 50 + s.x
             JOIN c ON c.raster_key = h.raster_key AND c.pos = h.pos
             LEFT JOIN reg r ON r.raster_key = c.raster_key AND r.cluster_id = c.value WHERE COALESCE(r.path, 'unlabeled') = 'unlabeled'),
    area AS (SELECT p.region_id, p.raster_key, c.y, c.x FROM pick p JOIN walk w ON w.raster_key = p.raster_key AND w.root = p.root
             JOIN c ON c.raster_key = w.raster_key AND c.pos = w.pos)"""


@query("pick_regions", _comp_sql("'k5', 'k10', 'k20'", True, _PICK_TAIL + " SELECT region_id, raster_key, COUNT(*) AS pixel_count FROM area GROUP BY 1, 2", "reg"))
def _(spark, sf):
    return region.pick_regions(_picks(spark, sf), fx.raster_meta(spark, sf), fx.segmented(spark, sf))[0]


@query(
    "pick_regions_suggestions",
    _comp_sql("'k5', 'k10', 'k20'", True, _PICK_TAIL + f""" SELECT region_id, path, votes, CAST(ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY votes DESC, path) AS INT) AS rank
        FROM (SELECT a.region_id, r.path, COUNT(*) AS votes FROM area a CROSS JOIN ({_OFFS8}) o JOIN c ON c.raster_key = a.raster_key AND c.y = a.y + o.dy AND c.x = a.x + o.dx
              JOIN reg r ON r.raster_key = c.raster_key AND r.cluster_id = c.value AND r.path <> 'unlabeled' GROUP BY 1, 2)""", "reg"),
)
def _(spark, sf):
    return region.pick_regions(_picks(spark, sf), fx.raster_meta(spark, sf), fx.segmented(spark, sf))[1]


def _region_labels(spark, sf):
    """A class for every feature region, and the synthetic raster they are written to."""
    base = overlay.synthetic_raster(fx.pixels(spark, sf), "k10")
    n = fx.nations(spark, sf).select("n_nationkey", "path")
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    named = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    paths = named.select((F.col("c_custkey") + 1).alias("region_id"), "path", (-F.col("c_custkey")).alias("seq"))
    # regions overlap here: spans before the burn
    spans = zonal.polygon_spans(fx.features(spark, sf), _grid(spark, sf))
    cells = spans.select(F.col("feature_id").cast("long").alias("region_id"), "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return cells, paths, base


_LABEL_SQL = """lp AS (SELECT c_custkey + 1 AS region_id, k.path, -c_custkey AS seq FROM customer JOIN classes k ON k.n_nationkey = c_nationkey),
    li AS (SELECT path, CAST(9999 + ROW_NUMBER() OVER (ORDER BY MIN(seq), path) AS INT) AS id FROM lp GROUP BY 1),
    lc AS (SELECT y, x, ARG_MAX(li.id, lp.seq) AS id FROM
        (SELECT f.*, UNNEST(RANGE(x0, x0 + w)) AS x FROM feat f) a, LATERAL (SELECT UNNEST(RANGE(y0, y0 + h)) AS y) b, lp, li
      WHERE lp.region_id = a.feature_id AND li.path = lp.path AND (NOT tri OR (4 * (x - x0) + 1) * h + (4 * (y - y0) + 1) * w < 4 * w * h) GROUP BY 1, 2),
    lx AS (SELECT p.y, p.x, COALESCE(lc.id, CASE WHEN p.value = -1 THEN -1 ELSE 9999 END) AS value FROM pixels p
      LEFT JOIN lc ON lc.y = p.y AND lc.x = p.x WHERE p.raster_key = 'k10')"""


@query("synthetic_ids", sql(f"WITH {_LABEL_SQL.split(',' + chr(10) + '    lc AS')[0]} SELECT path, id AS synthetic_id FROM li", "classes"))
def _(spark, sf):
    cells, paths, base = _region_labels(spark, sf)
    return region.synthetic_ids(paths, base.registry)


@query("label_regions", sql(f"WITH {_LABEL_SQL} SELECT 'synthetic_seg' AS raster_key, y, x, value FROM lx", "classes", "feat", "pixels"))
def _(spark, sf):
    return region.label_regions(*_region_labels(spark, sf)).pixels


@query(
    "label_regions_registry",
    sql(
        f"""WITH {_LABEL_SQL}, n AS (SELECT value, COUNT(*) AS n FROM lx GROUP BY 1), r AS (SELECT id, path FROM li UNION ALL SELECT 9999, 'unlabeled')
            SELECT 'synthetic_seg' AS raster_key, r.id AS cluster_id, COALESCE(n.n, 0) AS pixel_count, r.path AS classification_path,
              CAST(COALESCE(n.n, 0) * 0.01 AS DECIMAL(18,2)) AS area_ha, {_CSS} AS color
            FROM r LEFT JOIN n ON n.value = r.id LEFT JOIN colors h ON h.path = SPLIT_PART(r.path, '.', 1)""",
        "classes", "feat", "pixels", "colors",
    ),
)
def _(spark, sf):
    return region.label_regions(*_region_labels(spark, sf), colors=fx.hierarchy_colors(spark, sf), level=1).registry


@query("fill_region", sql("SELECT p.raster_key, p.y, p.x, CASE WHEN p.raster_key = 'k10' AND b.feature_id IS NOT NULL THEN 77 ELSE p.value END AS value FROM pixels p LEFT JOIN burn b ON b.y = p.y AND b.x = p.x", "pixels", "burn"))
def _(spark, sf):
    return region.fill_region(fx.pixels(spark, sf), _feature_regions(spark, sf), 77)


# --- tiles ------------------------------------------------------------------------------------


def _inventory(spark, sf):
    return fx.tile_pixels(spark, sf).select("z", "x", "y").distinct()


@query("mosaic_extent", sql(
    """SELECT z, MIN(x) AS min_x, MIN(y) AS min_y, COUNT(*) AS n_tiles, CAST((MAX(x) - MIN(x) + 1) * 10 AS INT) AS width, CAST((MAX(y) - MIN(y) + 1) * 10 AS INT) AS height,
         ROUND(MIN(x) * e - 20037508.342789244::DOUBLE, 4) AS west, ROUND(20037508.342789244::DOUBLE - MIN(y) * e, 4) AS north, ROUND(e / 10, 6) AS resolution
       FROM (SELECT *, 2 * 20037508.342789244::DOUBLE / POW(2.0, z) AS e FROM inv) GROUP BY z, e""", "inv"))
def _(spark, sf):
    out = tiles.mosaic_extent(_inventory(spark, sf), fx.TILE)
    return out.withColumn("west", F.round("west", 4)).withColumn("north", F.round("north", 4)).withColumn("resolution", F.round("resolution", 6))


@query("mosaic", sql("SELECT z, y * 10 + py AS y, x * 10 + px AS x, r, g, b FROM tp", "tp"))
def _(spark, sf):
    return tiles.mosaic(fx.tile_pixels(spark, sf), fx.TILE)


@query("parent_tiles", sql(
    """SELECT c.z, c.x, c.y, CAST(FLOOR(c.x / 2) AS INT) AS parent_x, CAST(FLOOR(c.y / 2) AS INT) AS parent_y, c.x % 2 AS qx, c.y % 2 AS qy, p.z IS NOT NULL AS has_parent
       FROM inv c LEFT JOIN inv p ON p.z = c.z - 1 AND p.x = FLOOR(c.x / 2) AND p.y = FLOOR(c.y / 2)""", "inv"))
def _(spark, sf):
    inv = _inventory(spark, sf)
    return tiles.parent_tiles(inv, inv)


_SPREAD = """spread AS (SELECT z, x, y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY z ORDER BY x, y) - 1 AS rn, COUNT(*) OVER (PARTITION BY z) AS n FROM inv)
    WHERE rn % GREATEST(1, FLOOR(n / 40)) = 0 AND rn / GREATEST(1, FLOOR(n / 40)) < 40)"""


@query("spread_sample", sql(f"WITH {_SPREAD} SELECT z, x, y FROM spread", "inv"))
def _(spark, sf):
    return tiles.spread_sample(_inventory(spark, sf), 40)


_TAPS_SQL = """raw AS (SELECT d AS dst, CAST(FLOOR(d / 2) AS INT) + o AS src, w FROM (SELECT UNNEST(RANGE(10)) AS d),
      (VALUES (0, -2, -3), (0, -1, 29), (0, 0, 111), (0, 1, -9), (1, -1, -9), (1, 0, 111), (1, 1, 29), (1, 2, -3)) t(odd, o, w) WHERE odd = d % 2),
    taps AS (SELECT dst, src, CAST(CASE WHEN k >= 0 THEN FLOOR(k + 0.5) ELSE CEIL(k - 0.5) END AS BIGINT) AS w FROM
      (SELECT dst, src, w / CAST(SUM(w) OVER (PARTITION BY dst) AS DOUBLE) * 4194304 AS k FROM raw WHERE src BETWEEN 0 AND 4))"""


def _up_sql(source: str) -> str:
    b = lambda c: f"CAST(GREATEST(0, LEAST(255, FLOOR((SUM(q.{c} * t.w) + 2097152) / 4194304))) AS INT) AS {c}"
    return f"""quad AS ({source}),
      wide AS (SELECT q.x, q.y, q.py, t.dst AS px, {b('r')}, {b('g')}, {b('b')} FROM quad q JOIN taps t ON t.src = q.px GROUP BY 1, 2, 3, 4),
      up AS (SELECT q.x, q.y, t.dst AS py, q.px, {b('r')}, {b('g')}, {b('b')} FROM wide q JOIN taps t ON t.src = q.py GROUP BY 1, 2, 3, 4)"""


_PAIRS = """pairs AS (SELECT c.x, c.y FROM inv c JOIN inv p ON p.z = 5 AND p.x = FLOOR(c.x / 2) AND p.y = FLOOR(c.y / 2) WHERE c.z = 6),
    """ + _TAPS_SQL + ", " + _up_sql(
    """SELECT c.x, c.y, t.py % 5 AS py, t.px % 5 AS px, t.r, t.g, t.b FROM pairs c JOIN tp t ON t.z = 5 AND t.x = FLOOR(c.x / 2) AND t.y = FLOOR(c.y / 2)
       AND FLOOR(t.px / 5) = c.x % 2 AND FLOOR(t.py / 5) = c.y % 2"""
)


def _lap_sql(name: str, source: str) -> str:
    return f"""{name}_g AS (SELECT x, y, py, px, CAST(FLOOR((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536) AS INT) AS v FROM {source}),
      {name} AS (SELECT x, y, (COUNT(*) * SUM(l * l) - SUM(l) * SUM(l)) / (COUNT(*) * COUNT(*)) AS lap FROM (SELECT c.x, c.y, 4 * c.v - n.v - s.v - w.v - e.v AS l FROM {name}_g c
        JOIN {name}_g n ON n.x = c.x AND n.y = c.y AND n.py = c.py - 1 AND n.px = c.px JOIN {name}_g s ON s.x = c.x AND s.y = c.y AND s.py = c.py + 1 AND s.px = c.px
        JOIN {name}_g w ON w.x = c.x AND w.y = c.y AND w.py = c.py AND w.px = c.px - 1 JOIN {name}_g e ON e.x = c.x AND e.y = c.y AND e.py = c.py AND e.px = c.px + 1) GROUP BY 1, 2)"""


_AUDIT = f"""{_PAIRS}, kids AS (SELECT t.* FROM tp t JOIN pairs c ON c.x = t.x AND c.y = t.y WHERE t.z = 6),
    {_lap_sql('lc', 'kids')}, {_lap_sql('lp', 'up')},
    mae AS (SELECT k.x, k.y, SUM(ABS(k.r - u.r) + ABS(k.g - u.g) + ABS(k.b - u.b)) / (COUNT(*) * 3.0::DOUBLE) AS mae FROM kids k
            JOIN up u ON u.x = k.x AND u.y = k.y AND u.py = k.py AND u.px = k.px GROUP BY 1, 2),
    audit AS (SELECT x, y, mae, lc.lap AS lap_child, lp.lap AS lap_parent, CASE WHEN lp.lap > 0 THEN lc.lap / lp.lap ELSE 'inf'::DOUBLE END AS detail_ratio
              FROM mae JOIN lc USING (x, y) JOIN lp USING (x, y))"""


def _audit(spark, sf):
    return tiles.tile_audit(stage(fx.tile_pixels(spark, sf), "tiles"), 6, tile_size=fx.TILE)


@query("upsample_quadrant", sql(f"WITH {_PAIRS} SELECT x, y, CAST(py AS INT) AS py, CAST(px AS INT) AS px, r, g, b FROM up", "tp", "inv"))
def _(spark, sf):
    tp = stage(fx.tile_pixels(spark, sf), "tiles")
    inv = tp.select("z", "x", "y").distinct()
    pairs = tiles.parent_tiles(inv.filter("z = 6"), inv).filter("has_parent")
    up = tp.filter("z = 5").select(
        F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.floor(F.col("px") / 5).cast("int").alias("qx"),
        F.floor(F.col("py") / 5).cast("int").alias("qy"), (F.col("py") % 5).alias("py"), (F.col("px") % 5).alias("px"), "r", "g", "b")
    quads = pairs.select("parent_x", "parent_y", "qx", "qy", "x", "y").join(up, ["parent_x", "parent_y", "qx", "qy"])
    return tiles.upsample_quadrant(quads.select("x", "y", "py", "px", "r", "g", "b"), 5, ["x", "y"], ["r", "g", "b"])


@query("tile_audit", sql(
    f"""WITH {_AUDIT} SELECT x, y, ROUND(mae, 6) AS mae, lap_child, lap_parent,
        ROUND(detail_ratio, 6) AS detail_ratio, detail_ratio < 3.0 AS suspect FROM audit""", "tp", "inv"))
def _(spark, sf):
    a = _audit(spark, sf)
    return a.select("x", "y", F.round("mae", 6).alias("mae"), "lap_child", "lap_parent",
                    F.round("detail_ratio", 6).alias("detail_ratio"), "suspect")


@query("audit_summary", sql(
    f"""WITH {_AUDIT} SELECT COUNT(*) AS n_tiles, ROUND(MIN(mae), 6) AS mae_min, ROUND(MEDIAN(mae), 6) AS mae_median, ROUND(MAX(mae), 6) AS mae_max,
        ROUND(MIN(detail_ratio), 6) AS ratio_min, ROUND(MEDIAN(detail_ratio), 6) AS ratio_median, ROUND(MAX(detail_ratio), 6) AS ratio_max,
        COUNT(*) FILTER (detail_ratio < 3.0) AS n_suspect, COUNT(*) FILTER (detail_ratio < 3.0) > COUNT(*) * 0.05 AS bad FROM audit""", "tp", "inv"))
def _(spark, sf):
    s = tiles.audit_summary(_audit(spark, sf))
    return s.select(*[F.round(c, 6).alias(c) if c.startswith(("mae", "ratio")) else F.col(c) for c in s.columns])


@query("weakest_tiles", sql(f"WITH {_AUDIT} SELECT x, y, ROUND(detail_ratio, 6) AS detail_ratio FROM audit ORDER BY audit.detail_ratio, x, y LIMIT 5", "tp", "inv"))
def _(spark, sf):
    return tiles.weakest_tiles(_audit(spark, sf)).select("x", "y", F.round("detail_ratio", 6).alias("detail_ratio"))


@query("suspect_tiles", sql(f"WITH {_AUDIT} SELECT x, y, ROUND(mae, 6) AS mae FROM audit WHERE detail_ratio < 3.0 ORDER BY x, y LIMIT 12", "tp", "inv"))
def _(spark, sf):
    return tiles.suspect_tiles(_audit(spark, sf)).select("x", "y", F.round("mae", 6).alias("mae"))


_FILES_SQL = """(SELECT CAST(10 + o_orderkey % 3 AS INT) AS z, CAST(FLOOR(o_orderkey / 100) AS INT) AS x, CAST(o_orderkey % 100 AS INT) AS y,
    CASE WHEN o_custkey % 2 = 0 THEN 'jpg' ELSE 'png' END AS ext, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey END AS size FROM orders
    UNION ALL SELECT CAST(10 + o_orderkey % 3 AS INT), CAST(FLOOR(o_orderkey / 100) AS INT), CAST(o_orderkey % 100 AS INT),
    CASE WHEN o_custkey % 2 = 0 THEN 'png' ELSE 'jpg' END, o_custkey + 5 FROM orders WHERE o_custkey % 3 = 0)"""


def _files(spark, sf):
    """Tile file names from orders; every third tile exists with both extensions."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stem = F.concat(F.lit("/data/tile_"), (10 + k % 3).cast("string"), F.lit("_"), F.floor(k / 100).cast("string"), F.lit("_"), (k % 100).cast("string"), F.lit("."))
    first = o.select(F.concat(stem, F.when(c % 2 == 0, F.lit("jpg")).otherwise(F.lit("png"))).alias("path"), F.when(c % 7 == 0, F.lit(0)).otherwise(c).cast("long").alias("length"))
    second = o.filter(c % 3 == 0).select(F.concat(stem, F.when(c % 2 == 0, F.lit("png")).otherwise(F.lit("jpg"))).alias("path"), (c + 5).alias("length"))
    other = o.select(F.concat(F.lit("/data/readme_"), k.cast("string"), F.lit(".txt")).alias("path"), k.alias("length"))
    return first.unionByName(second).unionByName(other)


@query("tile_inventory", f"SELECT z, x, y, ext, size FROM {_FILES_SQL} QUALIFY ROW_NUMBER() OVER (PARTITION BY z, x, y ORDER BY ext) = 1")
def _(spark, sf):
    return tables.tile_inventory(_files(spark, sf))


@query("tile_inventory_audit", f"SELECT z, x, y, ext, size FROM {_FILES_SQL} QUALIFY ROW_NUMBER() OVER (PARTITION BY z, x, y ORDER BY ext DESC) = 1")
def _(spark, sf):
    return tables.tile_inventory(_files(spark, sf), tables.AUDIT_ORDER)


@query("missing_tiles", f"""SELECT DISTINCT CAST(10 + o_orderkey % 3 AS INT) AS z, CAST(FLOOR(o_orderkey / 100) AS INT) AS x, CAST(o_orderkey % 100 AS INT) AS y FROM orders
    EXCEPT SELECT z, x, y FROM (SELECT * FROM {_FILES_SQL} QUALIFY ROW_NUMBER() OVER (PARTITION BY z, x, y ORDER BY ext) = 1) WHERE size > 0""")
def _(spark, sf):
    k = F.col("o_orderkey")
    needed = fx.table(spark, sf, "orders").select((10 + k % 3).cast("int").alias("z"), F.floor(k / 100).cast("int").alias("x"), (k % 100).cast("int").alias("y"))
    return tiles.missing_tiles(needed, tables.tile_inventory(_files(spark, sf)))


def _tile_arrays(spark, sf):
    """Tiles as arrays; every fifth has lost its last pixel."""
    tp = fx.tile_pixels(spark, sf)
    vals = F.transform(F.sort_array(F.collect_list(F.struct("py", "px", "r"))), lambda s: s["r"])
    packed = tp.groupBy("z", "x", "y").agg(vals.alias("v"))
    return packed.select("z", "x", "y", F.when((F.col("x") + F.col("y")) % 5 == 4, F.slice("v", 1, 99)).otherwise(F.col("v")).alias("values"))


@query("drop_bad_tiles", sql(
    """SELECT z, x, y, py, px, r AS v FROM tp
       WHERE (x + y) % 5 <> 4 AND (z, x, y) IN (SELECT (z, x, y) FROM tp GROUP BY z, x, y HAVING COUNT(*) = 100)""", "tp"))
def _(spark, sf):
    good, _ = tiles.drop_bad_tiles(_tile_arrays(spark, sf), fx.TILE)
    return tiles.tile_pixels_from_arrays(good, fx.TILE)


@query("bad_tile_count", sql("SELECT COUNT(*) AS n_bad FROM (SELECT z, x, y, COUNT(*) AS n FROM tp GROUP BY 1, 2, 3) WHERE (x + y) % 5 = 4 OR n <> 100", "tp"))
def _(spark, sf):
    return tiles.drop_bad_tiles(_tile_arrays(spark, sf), fx.TILE)[1]


# --- resampling -----------------------------------------------------------------------------------


def _images(spark, sf):
    """Overlapping dated images: orders of one day form an image over a small area."""
    o = fx.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("source"), F.col("o_orderdate").alias("ts"),
        F.floor(k % 900 / 30).cast("int").alias("y"), (k % 30).cast("int").alias("x"), F.when(c % 5 == 0, F.lit(-1)).otherwise(c).cast("int").alias("value"), k.alias("seq"),
    )


_IMAGES_SQL = """im AS (SELECT STRFTIME(o_orderdate, '%Y-%m-%d') AS source, o_orderdate AS ts, CAST(FLOOR(o_orderkey % 900 / 30) AS INT) AS y, CAST(o_orderkey % 30 AS INT) AS x,
    CAST(CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE o_custkey END AS INT) AS value, o_orderkey AS seq FROM orders)"""


@query("filter_collection", f"WITH {_IMAGES_SQL} SELECT source, y, x, value, seq FROM im WHERE ts >= '1997-01-01' AND ts < '1997-12-31'")
def _(spark, sf):
    return resample.filter_collection(_images(spark, sf), 1997).drop("ts")


@query("merge_first", f"WITH {_IMAGES_SQL} SELECT y, x, MIN(value) AS value FROM (SELECT *, RANK() OVER (PARTITION BY y, x ORDER BY source) AS rn FROM im WHERE value <> -1) WHERE rn = 1 GROUP BY 1, 2")
def _(spark, sf):
    # two orders of one day at one pixel: the smaller value stands for the image
    one = _images(spark, sf).groupBy("source", "y", "x").agg(F.min(F.when(F.col("value") != -1, F.col("value"))).alias("value")).filter("value IS NOT NULL")
    return resample.merge_first(one)


@query("merge_last", f"WITH {_IMAGES_SQL} SELECT y, x, MIN(value) AS value FROM (SELECT *, RANK() OVER (PARTITION BY y, x ORDER BY source DESC) AS rn FROM im WHERE value <> -1) WHERE rn = 1 GROUP BY 1, 2")
def _(spark, sf):
    one = _images(spark, sf).groupBy("source", "y", "x").agg(F.min(F.when(F.col("value") != -1, F.col("value"))).alias("value")).filter("value IS NOT NULL")
    return resample.merge_first(one, last=True)


@query("clip_to_features", sql("SELECT p.raster_key, p.y, p.x, p.value FROM pixels p JOIN burn b ON b.y = p.y AND b.x = p.x", "pixels", "burn"))
def _(spark, sf):
    return resample.clip(fx.pixels(spark, sf), zonal.rasterize(fx.features(spark, sf), _grid(spark, sf))).select("raster_key", "y", "x", "value")


@query("coarsen_nearest", sql("SELECT raster_key, CAST(FLOOR(y / 4) AS INT) AS y, CAST(FLOOR(x / 4) AS INT) AS x, value FROM pixels JOIN (SELECT raster_key AS k, MAX(y) AS my, MAX(x) AS mx FROM pixels GROUP BY 1) e ON e.k = raster_key WHERE y = LEAST(FLOOR(y / 4) * 4 + 2, my) AND x = LEAST(FLOOR(x / 4) * 4 + 2, mx)", "pixels"))
def _(spark, sf):
    return resample.coarsen(fx.pixels(spark, sf), 4)


@query("coarsen_mean", sql("SELECT raster_key, CAST(FLOOR(y / 4) AS INT) AS y, CAST(FLOOR(x / 4) AS INT) AS x, ROUND(AVG(value), 6) AS value FROM pixels WHERE value <> -1 GROUP BY 1, 2, 3", "pixels"))
def _(spark, sf):
    return resample.coarsen(fx.pixels(spark, sf), 4, "mean").withColumn("value", F.round("value", 6))


# a mercator mosaic near 12 degrees north, one unit pixel of 1 km
_SRC = {"west": 8905000.0, "north": 1345000.0, "resolution": 1000.0}


def _source_grid(spark, sf):
    top = fx.table(spark, sf, "orders").agg(F.max("o_orderkey").alias("m")).first()["m"]
    return {**_SRC, "width": fx.WIDTH, "height": top // fx.WIDTH + 1}


_DST_SQL = """src AS (SELECT 8905000.0::DOUBLE AS west, 1345000.0::DOUBLE AS north, 1000.0::DOUBLE AS res, 50 AS w, CAST(FLOOR(MAX(o_orderkey) / 50) + 1 AS INT) AS h,
      20037508.342789244::DOUBLE / PI() AS rad FROM orders),
    ext AS (SELECT *, DEGREES(west / rad) AS wd, DEGREES((west + w * res) / rad) AS ed, DEGREES(ATAN(SINH(north / rad))) AS nd, DEGREES(ATAN(SINH((north - h * res) / rad))) AS sd FROM src),
    grid AS (SELECT *, SQRT((ed - wd) * (ed - wd) + (nd - sd) * (nd - sd)) / SQRT(w * w + h * h) AS px FROM ext),
    cell AS (SELECT y, x, wd + (x + 0.5::DOUBLE) * px AS lng, nd - (y + 0.5::DOUBLE) * px AS lat, west, north, res, rad FROM
      (SELECT *, UNNEST(RANGE(CAST(FLOOR((nd - sd) / px + 0.5) AS BIGINT))) AS y FROM (SELECT *, UNNEST(RANGE(CAST(FLOOR((ed - wd) / px + 0.5) AS BIGINT))) AS x FROM grid))),
    loc AS (SELECT y, x, (RADIANS(lng) * rad - west) / res - 0.5 AS sx, (north - ASINH(TAN(RADIANS(lat))) * rad) / res - 0.5 AS sy FROM cell),
    im AS (SELECT CAST(FLOOR(o_orderkey / 50) AS INT) AS y, CAST(o_orderkey % 50 AS INT) AS x, CAST(o_custkey % 256 AS INT) AS v FROM orders WHERE o_custkey % 13 <> 0)"""


def _image_band(spark, sf):
    o = fx.table(spark, sf, "orders").filter("o_custkey % 13 <> 0")
    return o.select(F.floor(F.col("o_orderkey") / 50).cast("int").alias("y"), (F.col("o_orderkey") % 50).cast("int").alias("x"), (F.col("o_custkey") % 256).cast("int").alias("v"))


@query("reproject_bilinear",
    f"""WITH {_DST_SQL}, tap AS (SELECT l.y, l.x, FLOOR(sy) + dy AS ty, FLOOR(sx) + dx AS tx,
              (CASE dy WHEN 1 THEN sy - FLOOR(sy) ELSE 1 - (sy - FLOOR(sy)) END) * (CASE dx WHEN 1 THEN sx - FLOOR(sx) ELSE 1 - (sx - FLOOR(sx)) END) AS w
            FROM loc l, (SELECT UNNEST([0, 0, 1, 1]) AS dy, UNNEST([0, 1, 0, 1]) AS dx))
        SELECT CAST(t.y AS INT) AS y, CAST(t.x AS INT) AS x, ROUND(SUM(w * v) / SUM(w), 4) AS v FROM tap t JOIN im ON im.y = t.ty AND im.x = t.tx GROUP BY 1, 2 HAVING SUM(w) > 0""")
def _(spark, sf):
    src = _source_grid(spark, sf)
    return resample.reproject(_image_band(spark, sf), src, resample.target_grid(src)).withColumn("v", F.round("v", 4))


@query("reproject_nearest", f"WITH {_DST_SQL} SELECT CAST(l.y AS INT) AS y, CAST(l.x AS INT) AS x, v FROM loc l JOIN im ON im.y = FLOOR(sy + 0.5) AND im.x = FLOOR(sx + 0.5)")
def _(spark, sf):
    src = _source_grid(spark, sf)
    return resample.reproject(_image_band(spark, sf), src, resample.target_grid(src), method="nearest")


# --- clustering -------------------------------------------------------------------------------------


@query("valid_embeddings", "SELECT COUNT(*) AS n_total, COUNT(*) FILTER (LEN(LIST_FILTER(embedding, lambda v: v IS NULL OR ISNAN(v))) = 0) AS n_valid FROM embeddings")
def _(spark, sf):
    return cluster.valid_count(fx.table(spark, sf, "embeddings"))


@query("flatten_bands", """SELECT vec_id, GENERATE_SUBSCRIPTS(embedding, 1) - 1 AS band,
      ROUND(CASE WHEN vec_id % 10 = 3 AND GENERATE_SUBSCRIPTS(embedding, 1) = 5 THEN NULL ELSE CAST(UNNEST(embedding) AS DOUBLE) END, 6) AS value, vec_id % 10 <> 3 AS is_valid FROM embeddings""")
def _(spark, sf):
    """Embeddings taken apart into bands and put together again, all bands; some lose band 4."""
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "value"))
    flat = cluster.flatten_bands(e.filter("NOT (vec_id % 10 = 3 AND band = 4)"), 64)
    rows = flat.select("vec_id", cluster.is_valid_embedding(F.col("embedding")).alias("is_valid"), F.posexplode("embedding").alias("band", "v"))
    value = F.when(~F.isnan("v"), F.round(F.col("v").cast("double"), 6))
    return rows.select("vec_id", F.col("band").cast("long").alias("band"), value.alias("value"), "is_valid")


@query("nearest_centroid_invalid", """SELECT vec_id, vec_id % 10 = 3 AS is_nodata FROM embeddings""")
def _(spark, sf):
    """Embeddings with a missing band stay nodata."""
    e = fx.table(spark, sf, "embeddings")
    nan = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") % 10 == 3) & (i == 4), F.lit(float("nan"))).otherwise(v).cast("float"))
    out = cluster.nearest_centroid(e.select("vec_id", nan.alias("embedding")), stage(_centroids(spark, sf), "centroids"))
    return out.select("vec_id", (F.col("cluster_id") == S.NODATA).alias("is_nodata"))


def _centroids(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = e.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    return means.groupBy(F.col("label").alias("cluster_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid")
    )


@query("nearest_centroid",
    """WITH v AS (SELECT vec_id, label, GENERATE_SUBSCRIPTS(embedding, 1) AS i, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings),
         c AS (SELECT label, i, ROUND(AVG(v), 6) AS v FROM v GROUP BY 1, 2),
         d AS (SELECT v.vec_id, c.label, SUM((v.v - c.v) * (v.v - c.v)) AS dist FROM v JOIN c ON c.i = v.i GROUP BY 1, 2)
       SELECT vec_id, ARG_MIN(label, dist) AS cluster_id, ROUND(MIN(dist), 6) AS dist FROM d GROUP BY 1""")
def _(spark, sf):
    out = cluster.nearest_centroid(fx.table(spark, sf, "embeddings"), stage(_centroids(spark, sf), "centroids"))
    return out.withColumn("dist", F.round("dist", 6))


@query("kmeans_range", """SELECT k.k AS raster_key, vec_id, vec_id % 10 = 3 AS is_nodata, TRUE AS below_k, TRUE AS is_nearest
    FROM embeddings CROSS JOIN (SELECT UNNEST(['k5', 'k10']) AS k) k""")
def _(spark, sf):
    """What holds for any right clustering: nodata where a band is missing, ids below k, the nearest of the returned centroids."""
    e = fx.table(spark, sf, "embeddings")
    nan = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") % 10 == 3) & (i == 4), F.lit(float("nan"))).otherwise(v).cast("float"))
    e = e.select("vec_id", nan.alias("embedding"))
    found, centers = cluster.kmeans_range(e, (5, 10))
    near = [
        cluster.nearest_centroid(e, centers.filter(F.col("raster_key") == f"k{k}")).select(F.lit(f"k{k}").alias("raster_key"), "vec_id", F.col("cluster_id").alias("near"))
        for k in (5, 10)
    ]
    both = found.join(near[0].unionByName(near[1]), ["raster_key", "vec_id"])
    k = F.substring("raster_key", 2, 3).cast("int")
    return both.select("raster_key", "vec_id", (F.col("cluster_id") == S.NODATA).alias("is_nodata"), (F.col("cluster_id") < k).alias("below_k"),
                       (F.col("cluster_id") == F.col("near")).alias("is_nearest"))


@query("cluster_palette", """SELECT k.k AS raster_key, CAST(c.c AS INT) AS cluster_id, TRUE AS family_ok, TRUE AS rgb_ok, COUNT(*) > 0 AS own_colour FROM embeddings
    CROSS JOIN (SELECT UNNEST(['k6', 'k12']) AS k) k JOIN (SELECT UNNEST(RANGE(12)) AS c) c ON c.c < CAST(SUBSTRING(k.k, 2) AS INT) GROUP BY 1, 2""")
def _(spark, sf):
    """What holds for any right palette: a family below 3, channels in range, no colour twice in a raster."""
    _, centers = cluster.kmeans_range(fx.table(spark, sf, "embeddings"), (6, 12))
    made = stage(cluster.cluster_palette(centers, 3), "palette")
    rgb = ["r", "g", "b"]
    alone = made.groupBy("raster_key", *rgb).agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("r").between(0, 255) & F.col("g").between(0, 255) & F.col("b").between(0, 255)
    return made.join(alone, ["raster_key", *rgb]).select(
        "raster_key", "cluster_id", F.col("family").between(0, 2).alias("family_ok"), inside.alias("rgb_ok"), (F.col("n") == 1).alias("own_colour"))


# --- detections -----------------------------------------------------------------------------------


_BOX = {"west": 80.0, "south": 10.0, "east": 82.0, "north": 12.0}


@query("parse_detections",
    sql("SELECT k AS payload_id, label, confidence, FALSE AS is_error FROM det WHERE k % 9 <> 4 AND k % 9 <> 5 UNION ALL SELECT k, 'unknown', 0.5, TRUE FROM det WHERE k % 9 = 4", "det"))
def _(spark, sf):
    """Some payloads are cut short, some are objects without detections."""
    p = fx.detection_payloads(spark, sf)
    k = F.col("payload_id")
    text = F.when(k % 9 == 4, F.substring("payload", 1, 12)).when(k % 9 == 5, F.lit('{"note":1}')).otherwise(F.col("payload"))
    return detect.parse_detections(p.select("payload_id", text.alias("payload"))).select("payload_id", "label", "confidence", "is_error")


_DET_SQL = """SELECT k AS payload_id, label, confidence, ROUND(80 + x1 / 64 * 2, 6) AS west, ROUND(12 - y2 / 64 * 2, 6) AS south,
    ROUND(80 + x2 / 64 * 2, 6) AS east, ROUND(12 - y1 / 64 * 2, 6) AS north, 5 AS n_points FROM det"""


def _located(dets):
    ring = F.col("rings")[0]
    r = lambda c: F.round(c, 6)
    return dets.select(
        "payload_id", "label", "confidence", r(ring[0][0]).alias("west"), r(ring[0][1]).alias("south"),
        r(ring[2][0]).alias("east"), r(ring[2][1]).alias("north"), F.size(ring).alias("n_points"))


@query("detections_geojson", sql(_DET_SQL, "det"))
def _(spark, sf):
    return _located(detect.detections_geojson(fx.detection_payloads(spark, sf), 64, 64, _BOX))


@query("detections_above_confidence", sql(_DET_SQL + " WHERE confidence >= 0.6", "det"))
def _(spark, sf):
    return _located(detect.detections_geojson(fx.detection_payloads(spark, sf), 64, 64, _BOX, min_confidence=0.6))


@query("detection_features", sql("SELECT CAST(k AS VARCHAR) AS id, 'Feature' AS kind, label, confidence FROM det", "det"))
def _(spark, sf):
    """GeoJSON lines, read back."""
    lines = detect.feature_lines(detect.detections_geojson(fx.detection_payloads(spark, sf), 64, 64, _BOX))
    spec = "struct<type:string,properties:struct<type:string,confidence:double,detectionId:string>>"
    f = lines.select(F.from_json("value", spec).alias("f"))
    return f.select(F.col("f.properties.detectionId").alias("id"), F.col("f.type").alias("kind"), F.col("f.properties.type").alias("label"), F.col("f.properties.confidence").alias("confidence"))


# --- labels -----------------------------------------------------------------------------------------


@query("latest_labels", sql("SELECT * FROM edits_now", "edits_now"))
def _(spark, sf):
    return labels.latest_labels(fx.label_events(spark, sf))


@query("label_store", sql("SELECT * FROM edits_now", "edits_now"))
def _(spark, sf):
    """Labels saved in two parts and loaded again."""
    store = f"{scratch_dir(spark)}/label-store-{uuid.uuid4().hex}"
    e = fx.label_events(spark, sf)
    for odd in (0, 1):
        tables.save_labels(e.filter(f"seq % 2 = {odd}"), store)
    return tables.load_labels(spark, store)


@query("merge_labels", sql("SELECT * FROM edits_now", "edits_now"))
def _(spark, sf):
    e = fx.label_events(spark, sf)
    older = labels.latest_labels(e.filter("seq % 3 <> 1"))
    return labels.merge_labels(older, e.filter("seq % 3 = 1"))


@query("replace_labels", sql(
    "SELECT raster_key, cluster_id, path, ts, seq FROM edits_now WHERE raster_key <> 'k20' UNION ALL SELECT raster_key, cluster_id, path, ts, seq FROM edits_now WHERE raster_key = 'k20' AND cluster_id < 7", "edits_now"))
def _(spark, sf):
    now = stage(labels.latest_labels(fx.label_events(spark, sf)), "labels")
    return labels.replace_labels(now, now.filter("raster_key = 'k20'"), now.filter("cluster_id < 7"))


@query("label_documents", sql(
    """SELECT raster_key, '{' || STRING_AGG('"' || cluster_id || '":"' || path || '"', ',' ORDER BY cluster_id) FILTER (path <> 'unlabeled') || '}' AS labels FROM reg GROUP BY 1""", "reg"))
def _(spark, sf):
    return tables.label_documents(fx.registry(spark, sf))


@query("parse_labels",
    """SELECT c_custkey, raster_key, cluster_id, path, is_valid FROM (
         SELECT c_custkey, 'k5' AS raster_key, CAST(c_nationkey AS INT) AS cluster_id, LOWER(c_mktsegment) AS path, TRUE AS is_valid FROM customer WHERE c_custkey % 6 <> 2
         UNION ALL SELECT c_custkey, 'k9', 1, 'unlabeled', TRUE FROM customer WHERE c_custkey % 6 <> 2
         UNION ALL SELECT c_custkey, NULL, NULL, NULL, FALSE FROM customer WHERE c_custkey % 6 = 2)""")
def _(spark, sf):
    c = fx.table(spark, sf, "customer")
    second = F.when(F.col("c_custkey") % 6 == 2, F.lit('["x"]')).otherwise(F.lit('{"1":"unlabeled"}'))
    doc = F.concat(F.lit('{"k5":{"'), F.col("c_nationkey").cast("string"), F.lit('":"'), F.lower("c_mktsegment"), F.lit('"},"k9":'), second, F.lit("}"))
    return tables.parse_labels(c.select("c_custkey", doc.alias("labels")))


@query("label_stream", sql("SELECT * FROM edits_now", "edits_now"))
def _(spark, sf):
    """The edit log as a stream of files, folded into the label table."""
    root = f"{scratch_dir(spark)}/label-stream-{uuid.uuid4().hex}"
    fx.label_events(spark, sf).repartition(4, "seq").write.parquet(f"{root}/log")
    edits = stream.read_label_stream(spark, f"{root}/log", files_per_trigger=2)
    stream.fold_label_stream(edits, f"{root}/labels", f"{root}/checkpoint").awaitTermination()  # of files that are there: ends by itself
    return stream.current_labels(spark, f"{root}/labels")


@query("progress_stream", sql("SELECT raster_key, COUNT(*) FILTER (path <> 'unlabeled') AS labeled, COUNT(*) AS total FROM edits_now GROUP BY 1", "edits_now"))
def _(spark, sf):
    """Progress per raster over the edit stream; each trigger replaces the whole, small, result."""
    root = f"{scratch_dir(spark)}/progress-stream-{uuid.uuid4().hex}"
    fx.label_events(spark, sf).repartition(4, "seq").write.parquet(f"{root}/log")
    edits = stream.read_label_stream(spark, f"{root}/log", files_per_trigger=2)
    stream.write_progress(edits, f"{root}/progress", f"{root}/checkpoint").awaitTermination()  # of files that are there: ends by itself
    return spark.read.parquet(f"{root}/progress")


# --- documents of a data set ------------------------------------------------------------------------


def _manifests(spark, sf):
    """One manifest per customer, some of them broken in different ways."""
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    keys = F.when(k % 11 == 1, F.lit("[]")).when(k % 11 == 2, F.lit('"k5"')).otherwise(F.lit('["k10","k5","base"]'))
    files = F.when(k % 11 == 3, F.lit('["a.tif"]')).otherwise(F.concat(F.lit('["a_'), k.cast("string"), F.lit('.tif","b.tif","c.tif"]')))
    bounds = F.when(k % 11 == 4, F.lit("[1,2,3]")).when(k % 11 == 5, F.lit('"x"')).otherwise(F.concat(F.lit("["), (k % 90).cast("string"), F.lit(",2,3,4]")))
    colors = F.when(k % 11 == 6, F.lit(',"color_mapping":{"colors_rgb":5}')).when(k % 11 == 7, F.lit(',"color_mapping":{"colors_rgb":[[1,0,0]]}')).otherwise(F.lit(""))
    meta = F.when(k % 11 == 8, F.lit("")).otherwise(F.concat(F.lit(',"metadata":{"bounds":'), bounds, F.lit(',"shape":[30,50]}')))
    doc = F.concat(F.lit('{"segmentation_keys":'), keys, F.lit(',"files":'), files, meta, colors,
                   F.lit(',"processing_stats":[{"file_size_mb":1.5},{"file_size_mb":2.5}]}'))
    return c.select("c_custkey", F.when(k % 11 == 9, F.lit("{nope")).otherwise(doc).alias("manifest"))


@query("manifest_violations",
    """SELECT c_custkey, CASE c_custkey % 11 WHEN 1 THEN 'segmentation_keys must be a non-empty array' WHEN 2 THEN 'segmentation_keys must be a non-empty array'
         WHEN 3 THEN 'segmentation_keys and files arrays must have same length' WHEN 4 THEN 'metadata.bounds must have exactly 4 values [minx, miny, maxx, maxy]'
         WHEN 5 THEN 'metadata.bounds must be an array [minx, miny, maxx, maxy]' WHEN 6 THEN 'color_mapping.colors_rgb must be an array'
         WHEN 8 THEN 'Missing required field: metadata' WHEN 9 THEN 'not a JSON document' END AS message FROM customer WHERE c_custkey % 11 IN (1, 2, 3, 4, 5, 6, 8, 9)""")
def _(spark, sf):
    return manifest.manifest_violations(_manifests(spark, sf))


_ENTRY_SQL = """en AS (SELECT c_custkey, p AS position, ['k10', 'k5', 'base'][p + 1] AS raster_key, [10, 5, NULL][p + 1] AS k,
    CASE p WHEN 0 THEN 'a_' || c_custkey || '.tif' WHEN 1 THEN 'b.tif' ELSE 'c.tif' END AS filename, CAST(c_custkey % 90 AS DOUBLE) AS xmin,
    [1.5::DOUBLE, 2.5, NULL][p + 1] AS file_size_mb FROM customer, (SELECT UNNEST([0, 1, 2]) AS p) WHERE c_custkey % 11 IN (0, 7, 10))"""


def _good_manifests(spark, sf):
    made = _manifests(spark, sf)
    return made.join(shuffled(manifest.manifest_violations(made).select("c_custkey")), "c_custkey", "left_anti")


@query("manifest_entries", f"WITH {_ENTRY_SQL} SELECT c_custkey, position, raster_key, k, filename, xmin, 4.0::DOUBLE AS ymax, 30 AS height, 50 AS width, file_size_mb FROM en")
def _(spark, sf):
    e = manifest.manifest_entries(_good_manifests(spark, sf))
    return e.select("c_custkey", "position", "raster_key", "k", "filename", "xmin", "ymax", "height", "width", "file_size_mb")


@query("manifest_k_values", "SELECT c_custkey, '5,10' AS ks FROM customer WHERE c_custkey % 11 IN (0, 7, 10)")
def _(spark, sf):
    return manifest.k_values(_good_manifests(spark, sf)).select("c_custkey", F.concat_ws(",", F.col("k_values").cast("array<string>")).alias("ks"))


@query("missing_files", f"WITH {_ENTRY_SQL} SELECT DISTINCT filename, c_custkey FROM en WHERE position = 0 AND c_custkey % 2 = 1")
def _(spark, sf):
    e = manifest.manifest_entries(_good_manifests(spark, sf))
    even = fx.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("a_"), F.col("c_custkey").cast("string"), F.lit(".tif")).alias("filename"))
    files = even.unionByName(e.filter("position > 0").select("filename").distinct())
    return manifest.missing_files(e, files).select("filename", "c_custkey").distinct()


@query("scan_rasters", sql("SELECT raster_key, y, x, value FROM pixels", "pixels"))
def _(spark, sf):
    named = fx.pixels(spark, sf).select(F.concat(F.col("raster_key"), F.lit("_segmentation.tif")).alias("filename"), "y", "x", "value")
    meta = fx.raster_meta(spark, sf).select("raster_key", F.concat(F.col("raster_key"), F.lit("_segmentation.tif")).alias("filename"))
    return manifest.scan_rasters(meta, named)


@query("projection_issues",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'invalid ModelPixelScale|not WGS84 (got 3857)'
         WHEN 2 THEN 'missing projection metadata|missing geoKeys|invalid ModelPixelScale|invalid ModelTiepoint|not WGS84 (got undefined)|not geographic model (got undefined)|not pixel area (got undefined)'
         WHEN 3 THEN 'not geographic model (got 1)|not pixel area (got 2)' ELSE 'invalid ModelTiepoint' END AS issues FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey") % 5
    arr = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double"))
    known = lambda v: F.when(k != 2, v)
    meta = fx.table(spark, sf, "customer").select(
        "c_custkey", known(F.when(k == 1, arr(2)).otherwise(arr(3))).alias("pixel_scale"), known(F.when(k == 4, arr(5)).otherwise(arr(6))).alias("tiepoint"),
        known(F.when(k == 1, F.lit(3857)).otherwise(F.lit(4326))).alias("geographic_type"), known(F.when(k == 3, F.lit(1)).otherwise(F.lit(2))).alias("model_type"),
        known(F.when(k == 3, F.lit(2)).otherwise(F.lit(1))).alias("raster_type"))
    return manifest.projection_issues(meta).withColumn("issues", F.array_join("issues", "|"))


@query("palette_legend", sql("SELECT raster_key, cluster_id, r, g, b, ROUND(r / 255.0::DOUBLE, 6) AS r_unit, -1 AS nodata FROM pal", "pal"))
def _(spark, sf):
    """Palette written as legend documents and scanned again."""
    lines = tables.legend_lines(fx.palette(spark, sf))
    doc = lines.select(F.to_json(F.struct(F.create_map("raster_key", F.struct("clusters")).alias("segmentations"))).alias("legend"))
    out = manifest.palette(doc)
    return out.select("raster_key", "cluster_id", "r", "g", "b", F.round("r_unit", 6).alias("r_unit"), "nodata")


@query("hierarchy_color_documents", "SELECT p_partkey, 'forest' AS path, PRINTF('#%06x', p_partkey) AS hex FROM part UNION ALL SELECT p_partkey, 'forest.' || LOWER(p_type), '#0000ff' FROM part")
def _(spark, sf):
    p = fx.table(spark, sf, "part")
    doc = F.concat(F.lit('{"forest":"#'), F.lpad(F.lower(F.hex("p_partkey")), 6, "0"), F.lit('","forest.'), F.lower("p_type"), F.lit('":"#0000ff"}'))
    return manifest.hierarchy_colors(p.select("p_partkey", doc.alias("colors")))


@query("parse_features",
    """SELECT s_suppkey, feature_id, n_rings, n_points, name, lng FROM (
         SELECT s_suppkey, 1 AS feature_id, 1 AS n_rings, 5 AS n_points, s_name AS name, CAST(s_nationkey AS DOUBLE) AS lng FROM supplier
         UNION ALL SELECT s_suppkey, 2, 2, 8, NULL, 7.5 FROM supplier UNION ALL SELECT s_suppkey, 3, NULL, NULL, 'p', NULL FROM supplier)""")
def _(spark, sf):
    s = fx.table(spark, sf, "supplier")
    n = F.col("s_nationkey").cast("string")
    ring = F.concat(F.lit("[["), n, F.lit(",1],[9,1],[9,2],[0,2],["), n, F.lit(",1]]"))
    tri = "[[7.5,1],[2,2],[3,1],[7.5,1]]"
    doc = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":['), ring, F.lit(']},"properties":{"name":"'), F.col("s_name"),
        F.lit('"}},{"geometry":{"type":"MultiPolygon","coordinates":[[' + tri + "],[" + tri + ']]},"properties":{"name":null}},'),
        F.lit('{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"p"}}]}'))
    out = tables.parse_features(s.select("s_suppkey", doc.alias("geojson")))
    first = F.get("rings", F.lit(0))
    return out.select("s_suppkey", "feature_id", F.when(F.col("rings").isNotNull(), F.size("rings")).alias("n_rings"),
                      F.when(F.col("rings").isNotNull(), F.size(F.flatten("rings"))).alias("n_points"), F.col("properties")["name"].alias("name"), F.get(first, F.lit(0))["lng"].alias("lng"))


@query("intersection_documents", sql(
    f"""WITH {_Z} SELECT 'feature_to_clusters' AS direction, raster_key, feature_id AS id, 0 AS part, STRING_AGG(cluster_id || ':' || pixel_count, ',' ORDER BY pct DESC, cluster_id) AS items FROM z WHERE passes GROUP BY 2, 3
        UNION ALL SELECT 'cluster_to_features', raster_key, cluster_id, CAST(FLOOR(feature_id / 65536) AS INT) AS part, STRING_AGG(feature_id || ':' || pixel_count, ',' ORDER BY pct DESC, feature_id) FROM z GROUP BY 2, 3, 4""", "zonal"))
def _(spark, sf):
    out = tables.intersection_documents(_zonal(spark, sf, 0.1), fx.features(spark, sf), 0.1)
    items = F.transform("items", lambda i: F.concat_ws(":", i["id"].cast("string"), i["pixel_count"].cast("string")))
    return out.select("direction", "raster_key", "id", "part", F.array_join(items, ",").alias("items"))


@query("intersection_index", sql(f"WITH {_Z} SELECT raster_key, feature_id, cluster_id, pct, pixel_count, passes, 0.1::DOUBLE AS min_pct FROM z", "zonal"))
def _(spark, sf):
    """Nested index documents, one per raster and block of 256 features, scanned back into rows."""
    z = _zonal(spark, sf, 0.1).withColumn("_block", F.floor(F.col("feature_id") / 256))
    triple = lambda c: F.array(F.col(c).cast("double"), F.col("pct"), F.col("pixel_count").cast("double"))

    def side(rows, by, other, name):
        lists = rows.groupBy("raster_key", "_block", by).agg(F.collect_list(triple(other)).alias("_l"))
        return lists.groupBy("raster_key", "_block").agg(F.map_from_entries(F.collect_list(F.struct(F.col(by).cast("string"), "_l"))).alias(name))

    f2c = side(z.filter("passes"), "feature_id", "cluster_id", "feature_to_clusters")
    nested = side(z, "cluster_id", "feature_id", "cluster_to_features").join(f2c, ["raster_key", "_block"], "left")
    config = F.struct(F.lit(0.1).alias("min_intersection_pct")).alias("config")
    index = F.to_json(F.struct(F.col("raster_key").alias("segmentation_key"), config, "feature_to_clusters", "cluster_to_features"))
    return tables.parse_intersection_documents(nested.select(index.alias("index")))


@query("narrow_type", sql("SELECT raster_key, CASE WHEN MAX(value) < 127 THEN 'tinyint' ELSE 'smallint' END AS type, COUNT(*) FILTER (value = -1) AS n_nodata FROM pixels GROUP BY 1", "pixels"))
def _(spark, sf):
    return tables.narrow_types(fx.pixels(spark, sf), "value")


@query("raster_round_trip", sql("SELECT raster_key, y, x, value FROM pixels WHERE raster_key IN ('k5', 'k20') AND y >= 3 AND y < 200 AND x >= 5 AND x < 40", "pixels"))
def _(spark, sf):
    """Write rasters by key, read two keys and a window."""
    folder = f"{scratch_dir(spark)}/rasters-{uuid.uuid4().hex}"
    tables.write_rasters(fx.pixels(spark, sf), folder)
    return tables.read_rasters(spark, folder, ["k5", "k20"], (3, 5, 200, 40))


# --- blocks: growth with a match function, halos, store, summaries ------------------------------------

_BLOCK = 8
_LEVELS = 3


def _packed(spark, sf):
    return store.pack_blocks(fx.pixels(spark, sf), _BLOCK)


def _stored(spark, sf) -> str:
    """The rasters as a store of 24 files."""
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    store.write_store(_packed(spark, sf), path, 24)
    return path


@query(
    "grow_regions_matched",
    sql(
        f"""WITH {_SEED_SQL}, o AS ({_OFFS8}), v AS (SELECT s.region_id, s.raster_key, p.y, p.x, p.value AS seed FROM s JOIN pixels p ON p.raster_key = s.raster_key AND p.y = s.y AND p.x = s.x),
        grown(region_id, raster_key, y, x, seed) AS (
          SELECT * FROM v
          UNION
          SELECT g.region_id, g.raster_key, p.y, p.x, g.seed FROM grown g CROSS JOIN o JOIN pixels p ON p.raster_key = g.raster_key AND p.y = g.y + o.dy AND p.x = g.x + o.dx AND ABS(p.value - g.seed) <= 1)
        SELECT region_id, raster_key, y, x FROM grown""",
        "pixels", recursive=True,
    ),
)
def _(spark, sf):
    """Values that differ from the seed's by one at most, over blocks of 16."""
    return growth.grow_regions_matched(_seeds(spark, sf), fx.pixels(spark, sf), lambda seed, v: F.abs(v - seed) <= 1, block=16)


@query("neighbor_votes_blocks", ORACLES["neighbor_votes"])
def _(spark, sf):
    padded = halo.with_halo(_packed(spark, sf), _BLOCK)
    return halo.neighbor_votes_blocks(_feature_regions(spark, sf), padded, stage(fx.registry(spark, sf), "registry"), _BLOCK)


@query(
    "majority_filter",
    sql(
        f"""WITH o AS ({_OFFS8} UNION ALL SELECT 0, 0), t AS (SELECT p.raster_key, p.y, p.x, n.value, COUNT(*) AS n FROM pixels p CROSS JOIN o
              JOIN pixels n ON n.raster_key = p.raster_key AND n.y = p.y + o.dy AND n.x = p.x + o.dx WHERE p.value <> -1 AND n.value <> -1 GROUP BY ALL)
            SELECT raster_key, y, x, value FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY raster_key, y, x ORDER BY n DESC, value) = 1
            UNION ALL SELECT raster_key, y, x, value FROM pixels WHERE value = -1""",
        "pixels",
    ),
)
def _(spark, sf):
    smooth = halo.majority(halo.with_halo(_packed(spark, sf), _BLOCK), _BLOCK)
    return blocks.pixels_from_blocks(smooth, _BLOCK).filter("value IS NOT NULL")


@query("sample_points_stored", ORACLES["sample_points"])
def _(spark, sf):
    return store.sample_points_stored(fx.points(spark, sf), fx.raster_meta(spark, sf), fx.registry(spark, sf), _stored(spark, sf), _BLOCK)


@query("block_pyramid", sql(f"""SELECT level, raster_key, CAST(FLOOR(y / ({_BLOCK} * side)) AS INT) AS by, CAST(FLOOR(x / ({_BLOCK} * side)) AS INT) AS bx, value, COUNT(*) AS n
    FROM pixels CROSS JOIN (SELECT 0 AS level, 1 AS side UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 4) WHERE value <> -1 GROUP BY ALL""", "pixels"))
def _(spark, sf):
    return store.pyramid(_packed(spark, sf), _LEVELS)


@query("zonal_intersection_stored", ORACLES["zonal_intersection"])
def _(spark, sf):
    """The pyramid stands on blocks of two here, for the polygons of the tables are small."""
    packed = stage(store.pack_blocks(fx.pixels(spark, sf), 2), "blocks")
    return store.zonal_intersection_stored(fx.features(spark, sf), fx.raster_meta(spark, sf), store.pyramid(packed, _LEVELS), lambda wanted: packed.join(wanted, store.PLACE, "left_semi"), 2, _LEVELS)
