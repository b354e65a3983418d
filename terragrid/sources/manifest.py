"""Data-set manifests, projection metadata, palettes and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.functions.ids import k_of
from terragrid.plans.sizing import Dim, shuffled, spread_rows

# Messages of the projection checks, in the order of the rules; the last three name what was found.
PROJECTION_RULES = (
    "missing projection metadata",
    "missing geoKeys",
    "invalid ModelPixelScale",
    "invalid ModelTiepoint",
    "not WGS84 (got ",
    "not geographic model (got ",
    "not pixel area (got ",
)
# Messages of the manifest checks.
MANIFEST_RULES = (
    ("no_keys", "Missing required field: segmentation_keys"),
    ("no_files", "Missing required field: files"),
    ("no_metadata", "Missing required field: metadata"),
    ("bad_keys", "segmentation_keys must be a non-empty array"),
    ("bad_files", "files must be a non-empty array"),
    ("length", "segmentation_keys and files arrays must have same length"),
    ("bounds_size", "metadata.bounds must have exactly 4 values [minx, miny, maxx, maxy]"),
    ("bounds_type", "metadata.bounds must be an array [minx, miny, maxx, maxy]"),
    ("colors", "color_mapping.colors_rgb must be an array"),
)
WGS84, GEOGRAPHIC_MODEL, PIXEL_IS_AREA = 4326, 2, 1


def read_documents(spark: SparkSession, path: str, name: str = "manifest") -> DataFrame:
    """Whole text files as ``path, <name>``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(name))


def manifest_violations(docs: DataFrame) -> DataFrame:
    """The first broken rule of each manifest that has one.

    ``docs`` has a JSON text column ``manifest``; other columns are carried along.
    """
    # parsed once a document, in a projection of its own
    docs = spread_rows(docs).withColumn("_v", F.try_parse_json("manifest"))
    v = F.col("_v")
    part = lambda p: F.try_variant_get(v, p, "variant")
    kind = lambda p: F.coalesce(F.schema_of_variant(part(p)), F.lit("VOID"))
    is_array = lambda p: kind(p).startswith("ARRAY")
    # absent, null, "", 0 and false all count as missing
    absent = lambda p: (kind(p) == "VOID") | F.coalesce(
        F.try_variant_get(v, p, "string").isin("", "0", "false"), F.lit(False)
    )
    size = lambda p: F.coalesce(F.size(F.try_variant_get(v, p, "array<variant>")), F.lit(0))
    empty = lambda p: ~is_array(p) | (size(p) <= 0)
    keys, files, bounds = "$.segmentation_keys", "$.files", "$.metadata.bounds"
    broken = {
        "no_keys": absent(keys),
        "no_files": absent(files),
        "no_metadata": absent("$.metadata"),
        "bad_keys": empty(keys),
        "bad_files": empty(files),
        "length": size(keys) != size(files),
        "bounds_size": is_array(bounds) & (size(bounds) != 4),
        "bounds_type": ~is_array(bounds),
        "colors": ~absent("$.color_mapping") & ~is_array("$.color_mapping.colors_rgb"),
    }
    rule = F.when(v.isNull(), F.lit("not a JSON document"))
    for name, message in MANIFEST_RULES:
        rule = rule.when(broken[name], F.lit(message))
    carried = [c for c in docs.columns if c not in ("manifest", "_v")]
    return docs.select(*carried, rule.alias("message")).filter("message IS NOT NULL")


def validate_manifest(docs: DataFrame) -> DataFrame:
    """The manifests themselves; an error when one breaks a rule."""
    first = manifest_violations(docs).first()
    if first is not None:
        raise ValueError(first["message"])
    return docs


def manifest_entries(docs: DataFrame) -> DataFrame:
    """One row per raster: key, k, file, bounds and size in MB."""
    fields = (
        "segmentation_keys array<string>, files array<string>, "
        "metadata struct<bounds:array<double>,shape:array<int>>, processing_stats array<struct<file_size_mb:double>>"
    )
    carried = [c for c in docs.columns if c != "manifest"]
    m = docs.select(*carried, F.from_json("manifest", f"struct<{_struct_of(fields)}>").alias("m"))
    rows = m.select("*", F.posexplode(F.arrays_zip(F.col("m.segmentation_keys"), F.col("m.files"))).alias("position", "e"))
    b, shape = F.col("m.metadata.bounds"), F.col("m.metadata.shape")
    return rows.select(
        *carried, "position",
        F.col("e.segmentation_keys").alias("raster_key"), k_of(F.col("e.segmentation_keys")).alias("k"),
        F.col("e.files").alias("filename"),
        b[0].alias("xmin"), b[1].alias("ymin"), b[2].alias("xmax"), b[3].alias("ymax"),
        shape[0].alias("height"), shape[1].alias("width"),
        F.get(F.col("m.processing_stats"), F.col("position"))["file_size_mb"].alias("file_size_mb"),
    )


def _struct_of(ddl: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def k_values(docs: DataFrame) -> DataFrame:
    """Sorted k of the keys that have one."""
    carried = [c for c in docs.columns if c != "manifest"]
    keys = F.from_json("manifest", "struct<segmentation_keys:array<string>>")["segmentation_keys"]
    ks = F.filter(F.transform(keys, k_of), lambda k: k.isNotNull())
    return docs.select(*carried, F.sort_array(ks).alias("k_values"))


def missing_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries whose file is not among ``files(filename)``."""
    return entries.join(shuffled(files.select("filename")), "filename", "left_anti")


def scan_rasters(entries: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of the manifest's files with their raster key.

    ``pixels`` has ``filename, y, x, value``; a file that is named but absent is
    an error.
    """
    lost = missing_files(entries, pixels.select("filename").distinct()).first()
    if lost is not None:
        raise FileNotFoundError(f"Required file not found: {lost['filename']}")
    keys = Dim(entries.select("filename", "raster_key"), derived=False)
    return keys.join(pixels, ["filename"], how="inner").select("raster_key", "y", "x", "value")


def projection_issues(meta: DataFrame) -> DataFrame:
    """All problems of a raster's projection metadata, in rule order.

    ``meta`` has ``pixel_scale, tiepoint`` (arrays), ``geographic_type,
    model_type, raster_type`` (ints, null when absent) and identifying columns.
    """
    got = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("undefined"))
    no_keys = F.col("geographic_type").isNull() & F.col("model_type").isNull() & F.col("raster_type").isNull()
    short = lambda c, n: F.coalesce(F.size(c) < n, F.lit(True)) | F.col(c).isNull()
    other = lambda c, v: F.coalesce(F.col(c) != v, F.lit(True))
    plain = [no_keys & F.col("pixel_scale").isNull() & F.col("tiepoint").isNull(), no_keys, short("pixel_scale", 3), short("tiepoint", 6)]
    named = [("geographic_type", WGS84), ("model_type", GEOGRAPHIC_MODEL), ("raster_type", PIXEL_IS_AREA)]
    checks = [(c, F.lit(m)) for c, m in zip(plain, PROJECTION_RULES)]
    checks += [(other(c, v), F.concat(F.lit(m), got(c), F.lit(")"))) for (c, v), m in zip(named, PROJECTION_RULES[len(plain):])]
    used = ("pixel_scale", "tiepoint", "geographic_type", "model_type", "raster_type")
    issues = F.array_compact(F.array(*[F.when(c, m) for c, m in checks]))
    return meta.select(*[c for c in meta.columns if c not in used], issues.alias("issues"))


def validate_projection(meta: DataFrame) -> DataFrame:
    """``meta`` itself; an error that lists all problems of the first bad row."""
    bad = projection_issues(meta).filter(F.size("issues") > 0).first()
    if bad is not None:
        raise ValueError("Invalid source raster: " + ", ".join(bad["issues"]))
    return meta


def palette(docs: DataFrame) -> DataFrame:
    """S3: colour legend documents -> ``raster_key, cluster_id, r, g, b`` and unit channels.

    ``docs`` has a JSON text column ``legend``; ``nodata_value`` is -1 when absent.
    """
    carried = [c for c in docs.columns if c != "legend"]
    spec = (
        "struct<segmentations:map<string,struct<clusters:map<string,struct<rgb_255:array<int>>>>>,nodata_value:int>"
    )
    d = docs.select(*carried, F.from_json("legend", spec).alias("d"))
    per_key = d.select(*carried, F.col("d.nodata_value").alias("_n"), F.explode("d.segmentations").alias("raster_key", "_s"))
    rows = per_key.select(*carried, "_n", "raster_key", F.explode("_s.clusters").alias("_id", "_c"))
    ch = [F.col("_c.rgb_255")[i] for i in range(3)]
    return rows.select(
        *carried, "raster_key", F.col("_id").cast("int").alias("cluster_id"),
        *[c.alias(n) for c, n in zip(ch, "rgb")],
        *[(c / F.lit(255.0)).alias(f"{n}_unit") for c, n in zip(ch, "rgb")],
        F.coalesce("_n", F.lit(-1)).alias("nodata"),
    )


def keys_without_palette(entries: DataFrame, colors: DataFrame) -> DataFrame:
    """S3: raster keys of the manifest that the legend does not mention."""
    return entries.select("raster_key").distinct().join(colors.select("raster_key"), "raster_key", "left_anti")


def hierarchy_colors(docs: DataFrame) -> DataFrame:
    """Colour documents (JSON column ``colors``) -> ``path, hex``."""
    carried = [c for c in docs.columns if c != "colors"]
    return docs.select(*carried, F.explode(F.from_json("colors", "map<string,string>")).alias("path", "hex"))


def load_hierarchy(spark: SparkSession, hierarchy_path: str, colors_path: str) -> tuple[DataFrame, DataFrame]:
    """Hierarchy rows and colours from two files."""
    from terragrid.operators.hierarchy import flatten_hierarchy

    rows = flatten_hierarchy(read_documents(spark, hierarchy_path, "hierarchy").select("hierarchy"))
    colors = hierarchy_colors(read_documents(spark, colors_path, "colors").select("colors"))
    return rows, colors
