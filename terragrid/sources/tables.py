"""Reading and writing labels, features, intersections, rasters, tiles and detections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions.ids import is_labeled
from terragrid.operators.detect import feature_lines
from terragrid.operators.labels import latest_labels

_PROPS = "map<string,string>"


# Fixed value: message for a label document of another shape.
LABEL_FORMAT_ERROR = "Invalid label file format"

# --- labels ---------------------------------------------------------------------------


def parse_labels(docs: DataFrame) -> DataFrame:
    """Label documents (JSON column ``labels``) -> ``raster_key, cluster_id, path, is_valid``.

    Every value must be an object; the rows of a document with another value
    have ``is_valid`` false.
    """
    carried = [c for c in docs.columns if c != "labels"]
    raw = docs.select(*carried, F.from_json("labels", "map<string,string>").alias("_m"))
    objects = F.transform(F.map_values("_m"), lambda t: F.coalesce(F.ltrim(t).startswith("{"), F.lit(False)))
    raw = raw.withColumn("is_valid", F.coalesce(F.forall(objects, lambda o: o), F.lit(False)))
    bad = raw.filter("NOT is_valid").select(
        *carried, F.lit(None).cast("string").alias("raster_key"), F.lit(None).cast("int").alias("cluster_id"),
        F.lit(None).cast("string").alias("path"), "is_valid",
    )
    sets = raw.filter("is_valid").select(*carried, "is_valid", F.explode("_m").alias("raster_key", "_t"))
    rows = sets.select(*carried, "raster_key", F.explode(F.from_json("_t", _PROPS)).alias("_id", "path"), "is_valid")
    return rows.select(*carried, "raster_key", F.col("_id").cast("int").alias("cluster_id"), "path", "is_valid").unionByName(bad)


def import_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a file; an error when its form is wrong."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("labels"))
    parsed = parse_labels(docs)
    if not parsed.filter("NOT is_valid").isEmpty():
        raise ValueError(LABEL_FORMAT_ERROR)
    return parsed.select("raster_key", "cluster_id", "path")


def label_documents(registry: DataFrame) -> DataFrame:
    """Per raster the map of its labelled clusters as JSON, ``{}`` without any.

    A map holds one entry per cluster of a raster, which the id type bounds.
    """
    entry = F.when(
        is_labeled(F.col("classification_path")),
        F.struct(F.col("cluster_id").alias("k"), F.col("classification_path").alias("v")),
    )
    maps = registry.groupBy("raster_key").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    pairs = F.transform("_e", lambda e: F.struct(e["k"].cast("string"), e["v"]))
    return maps.select("raster_key", F.to_json(F.map_from_entries(pairs)).alias("labels"))


def export_labels(registry: DataFrame, folder: str, day: date | None = None) -> str:
    """Write one document with all rasters to ``folder/cluster-labels-<date>.json``."""
    target = f"{folder}/cluster-labels-{(day or date.today()).isoformat()}.json"
    docs = label_documents(registry)
    member = F.concat(F.to_json(F.array("raster_key")).substr(F.lit(2), F.length(F.to_json(F.array("raster_key"))) - 2), F.lit(":"), F.col("labels"))
    # one short text per raster
    whole = docs.agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("_t"))
    whole.select(F.concat(F.lit("{"), F.col("_t"), F.lit("}")).alias("value")).write.mode("overwrite").text(target)
    return target


def save_labels(labels: DataFrame, table: str) -> None:
    """Append labels (``raster_key, cluster_id, path, ts, seq``) to the label table."""
    labels.select("raster_key", "cluster_id", "path", "ts", "seq").write.mode("append").parquet(table)


def load_labels(spark: SparkSession, table: str) -> DataFrame:
    """Current labels; an empty table when nothing was saved."""
    try:
        saved = spark.read.schema(S.LABELS).parquet(table)
        return latest_labels(saved)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], S.LABELS)
        raise


# --- polygons and intersections ---------------------------------------------------------


def parse_features(docs: DataFrame) -> DataFrame:
    """GeoJSON collections (JSON column ``geojson``) -> features numbered from 1.

    Polygons and multi-polygons become one list of rings; other geometries have none.
    """
    carried = [c for c in docs.columns if c != "geojson"]
    spec = f"struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:{_PROPS}>>>"
    d = docs.select(*carried, F.posexplode(F.from_json("geojson", spec)["features"]).alias("_i", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = lambda p: F.struct(p[0].alias("lng"), p[1].alias("lat"))
    single = F.from_json(text, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multi)
    return d.select(
        *carried, (F.col("_i") + 1).alias("feature_id"),
        F.transform(rings, lambda r: F.transform(r, point)).alias("rings"), F.col("f.properties").alias("properties"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of one GeoJSON file."""
    return parse_features(spark.read.text(path, wholetext=True).select(F.col("value").alias("geojson")))


def write_intersections(intersections: DataFrame, path: str) -> None:
    """Native form, one partition per raster."""
    intersections.write.mode("overwrite").partitionBy("raster_key").parquet(path)


def write_index_config(rasters: DataFrame, path: str, features_name: str, min_pct: float, generated: str) -> None:
    """The document next to the index: version, polygons, threshold, raster keys."""
    keys = rasters.select("raster_key").distinct().agg(F.sort_array(F.collect_list("raster_key")).alias("segmentations"))
    keys.select(
        F.lit(1).alias("version"), F.lit(features_name).alias("shapefile"), F.lit(generated).alias("generated"),
        F.lit(float(min_pct)).alias("min_intersection_pct"), "segmentations",
    ).write.mode("overwrite").json(path)


def read_intersections(spark: SparkSession, path: str) -> DataFrame:
    """The native form."""
    return spark.read.parquet(path)


# Fixed value: feature ids of one part of a cluster's list, the range of a 16-bit id.
PART = 65536


def intersection_documents(intersections: DataFrame, features: DataFrame | None, min_pct: float) -> DataFrame:
    """One row per raster and feature or cluster with its list, largest share first.

    A nested document of a whole raster would be one value; rows keep each list on
    its own (``direction, id, part, items``).  A cluster may touch any number of
    features: its list is cut by feature id into parts of a 16-bit id range, so
    no group grows without bound.
    """
    items = lambda other: F.transform(
        F.sort_array(F.collect_list(F.struct(-F.col("pct"), F.col(other).alias("o"), F.col("pct").alias("p"), F.col("pixel_count").alias("n")))),
        lambda s: F.struct(s["o"].alias("id"), s["p"].alias("pct"), s["n"].alias("pixel_count")),
    ).alias("items")
    part = lambda c: F.floor(F.col(c) / PART).cast("int").alias("part")
    to_clusters = intersections.filter("passes").groupBy("raster_key", F.col("feature_id").alias("id"), part("cluster_id")).agg(items("cluster_id"))
    to_features = intersections.groupBy("raster_key", F.col("cluster_id").alias("id"), part("feature_id")).agg(items("feature_id"))
    out = to_clusters.withColumn("direction", F.lit("feature_to_clusters")).unionByName(
        to_features.withColumn("direction", F.lit("cluster_to_features"))
    )
    out = out.withColumn("min_intersection_pct", F.lit(float(min_pct)))
    if features is None:
        return out
    props = features.select(F.col("feature_id").alias("id"), F.lit("feature_to_clusters").alias("direction"), "properties")
    return out.join(props, ["direction", "id"], "left")


def parse_intersection_documents(docs: DataFrame) -> DataFrame:
    """Nested index documents (JSON column ``index``) -> intersection rows.

    The pairs come from the cluster side, which is complete; ``passes`` marks
    those that the feature side lists.
    """
    lists = "map<string,array<array<double>>>"
    spec = f"struct<segmentation_key:string,config:struct<min_intersection_pct:double>,feature_to_clusters:{lists},cluster_to_features:{lists}>"
    d = docs.select(F.from_json("index", spec).alias("d")).select(
        F.col("d.segmentation_key").alias("raster_key"), F.col("d.config.min_intersection_pct").alias("min_pct"),
        F.col("d.feature_to_clusters").alias("f2c"), F.col("d.cluster_to_features").alias("c2f"),
    )
    full = d.select("raster_key", "min_pct", F.explode("c2f").alias("c", "items")).select(
        "raster_key", "min_pct", F.col("c").cast("int").alias("cluster_id"), F.explode("items").alias("i")
    )
    full = full.select(
        "raster_key", F.col("i")[0].cast("int").alias("feature_id"), "cluster_id", F.col("i")[1].alias("pct"),
        F.col("i")[2].cast("long").alias("pixel_count"), "min_pct",
    )
    listed = d.select("raster_key", F.explode("f2c").alias("f", "items")).select(
        "raster_key", F.col("f").cast("int").alias("feature_id"), F.explode("items").alias("i")
    ).select("raster_key", "feature_id", F.col("i")[0].cast("int").alias("cluster_id"), F.lit(True).alias("_p"))
    joined = full.join(listed, ["raster_key", "feature_id", "cluster_id"], "left")
    return joined.withColumn("passes", F.coalesce("_p", F.lit(False))).drop("_p")


def read_intersection_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All index files of a folder but ``config.json``."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    docs = raw.filter(F.col("_metadata.file_name") != "config.json").select(F.col("value").alias("index"))
    return parse_intersection_documents(docs)


# --- rasters -----------------------------------------------------------------------------


def narrow_types(classes: DataFrame, column: str = "class_id") -> DataFrame:
    """Smallest type that holds the values of each raster, and its -1 pixels.

    tinyint below 127, smallint up to 32767, otherwise int.
    """
    top = F.coalesce(F.max(F.when(F.col(column) >= 0, F.col(column))), F.lit(-1))
    kind = F.when(top < 127, F.lit("tinyint")).when(top <= 32767, F.lit("smallint")).otherwise(F.lit("int"))
    return classes.groupBy("raster_key").agg(kind.alias("type"), F.count_if(F.col(column) == S.NODATA).alias("n_nodata"))


def narrow_type(classes: DataFrame, column: str = "class_id") -> tuple[str, int]:
    """One type for all rasters of a table, and the number of -1 pixels."""
    got = narrow_types(classes, column).collect()  # one row per raster
    order = ("tinyint", "smallint", "int")
    widest = max((order.index(r["type"]) for r in got), default=0)
    return order[widest], sum(r["n_nodata"] for r in got)


def write_class_raster(classes: DataFrame, path: str, column: str = "class_id", block: int = 256) -> tuple[str, int]:
    """Class raster as Parquet, narrowed, rows of a block side by side.

    Blocks are the unit of the range split, so bounding-box reads skip files by
    their column statistics.
    """
    kind, lost = narrow_type(classes, column)
    by, bx = F.floor(F.col("y") / block), F.floor(F.col("x") / block)
    narrowed = classes.withColumn(column, F.col(column).cast(kind))
    narrowed.repartitionByRange("raster_key", by, bx).sortWithinPartitions("raster_key", by, bx, "y", "x").write.mode(
        "overwrite"
    ).parquet(path)
    return kind, lost


def export_land_cover(classes: DataFrame, mapping: DataFrame, colors: DataFrame, folder: str) -> None:
    """Pixel mapping, colours and class raster below one folder."""
    mapping.select("id", "path").write.mode("overwrite").json(f"{folder}/pixel-mapping")
    colors.select("id", "path", "hex").write.mode("overwrite").option("ignoreNullFields", "false").json(
        f"{folder}/land-cover-colors"
    )
    write_class_raster(classes, f"{folder}/land-cover")


def write_rasters(pixels: DataFrame, folder: str, block: int = 256) -> None:
    """One folder per raster key, clustered by block."""
    by, bx = F.floor(F.col("y") / block), F.floor(F.col("x") / block)
    pixels.repartitionByRange("raster_key", by, bx).sortWithinPartitions("raster_key", by, bx, "y", "x").write.mode(
        "overwrite"
    ).partitionBy("raster_key").parquet(folder)


def read_rasters(spark: SparkSession, folder: str, keys: list[str] | None = None, window: tuple | None = None) -> DataFrame:
    """Pixels of some rasters, optionally of a window ``(y0, x0, y1, x1)``, ends excluded.

    Keys prune folders, the window is pushed into the scan.
    """
    pixels = spark.read.schema(S.PIXELS).parquet(folder)
    if keys is not None:
        pixels = pixels.filter(F.col("raster_key").isin(*keys))
    if window is not None:
        y0, x0, y1, x1 = window
        pixels = pixels.filter((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return pixels.select("raster_key", "y", "x", "value")


def write_manifest(meta: DataFrame, folder: str) -> None:
    """Manifest document of a set of rasters, ordered by k.

    One entry per raster.
    """
    rows = F.sort_array(F.collect_list(F.struct("k", "raster_key", "filename", "file_size_mb")))
    got = meta.agg(
        rows.alias("e"), F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"),
        F.max("ymax").alias("y1"), F.max("height").alias("h"), F.max("width").alias("w"),
    )
    got.select(
        F.transform("e", lambda r: r["raster_key"]).alias("segmentation_keys"),
        F.transform("e", lambda r: r["filename"]).alias("files"),
        F.struct(F.array("x0", "y0", "x1", "y1").alias("bounds"), F.array("h", "w").alias("shape")).alias("metadata"),
        F.transform("e", lambda r: F.struct(r["file_size_mb"].alias("file_size_mb"))).alias("processing_stats"),
    ).write.mode("overwrite").json(folder)


def legend_lines(palette: DataFrame) -> DataFrame:
    """Colour legend, one JSON line per raster.

    The clusters of one raster are bounded by the id type.
    """
    entry = F.struct(
        F.col("cluster_id").cast("string").alias("k"), F.struct(F.array("r", "g", "b").alias("rgb_255")).alias("v")
    )
    clusters = F.map_from_entries(F.sort_array(F.collect_list(F.struct("cluster_id", entry.alias("e"))))["e"])
    return palette.groupBy("raster_key").agg(clusters.alias("clusters"))


# --- tiles and detections -----------------------------------------------------------------

# Tile file names and the order in which extensions are taken.
TILE_PATTERN = r"tile_(\d+)_(\d+)_(\d+)\.(jpg|png)$"
MOSAIC_ORDER = ("jpg", "png")
AUDIT_ORDER = ("png", "jpg")


def tile_inventory(files: DataFrame, prefer: tuple = MOSAIC_ORDER) -> DataFrame:
    """``z, x, y, ext, size`` of tile files (``path, length``), one row per tile.

    When both extensions exist the first of ``prefer`` is taken.
    """
    part = lambda i: F.regexp_extract("path", TILE_PATTERN, i)
    named = files.filter(F.col("path").rlike(TILE_PATTERN)).select(
        part(1).cast("int").alias("z"), part(2).cast("int").alias("x"), part(3).cast("int").alias("y"),
        part(4).alias("ext"), F.col("length").alias("size"),
    )
    rank = F.array_position(F.array(*[F.lit(e) for e in prefer]), F.col("ext"))
    picked = named.groupBy("z", "x", "y").agg(F.min_by(F.struct("ext", "size"), rank).alias("_t"))
    return picked.select("z", "x", "y", "_t.ext", "_t.size")


def read_tile_inventory(spark: SparkSession, folder: str, prefer: tuple = MOSAIC_ORDER) -> DataFrame:
    """Inventory of a folder; file contents are not read.

    Spark does not list empty files, so an empty tile counts as absent.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tile_*").load(folder).select("path", "length")
    return tile_inventory(files, prefer)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Pixel embeddings ``vec_id`` (or ``y, x``) and ``embedding``."""
    return spark.read.parquet(path)


def write_detections(detections: DataFrame, path: str) -> None:
    """GeoJSON features, one per line."""
    feature_lines(detections).write.mode("overwrite").text(path)
