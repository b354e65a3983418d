"""Counts, registries, overlays and colours on hand-made grids."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terragrid import schema as S
from terragrid.functions import color as C
from terragrid.functions import ids as I
from terragrid.functions import paths as P
from terragrid.operators import hierarchy, overlay, registry, render, zonal


def grid(spark, **rasters):
    rows = [(k, y, x, v) for k, g in rasters.items() for y, line in enumerate(g) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, S.PIXELS)


def back(df, value="value"):
    rows = df.collect()
    h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
    out = [[None] * w for _ in range(h)]
    for r in rows:
        out[r["y"]][r["x"]] = r[value]
    return out


K2 = [[0, 0, 1, 1], [0, 0, 1, 1], [0, 0, 0, 0], [-1, 0, 0, 1]]
K4 = [[-1, 1, 2, 2], [1, 1, 2, 3], [0, 0, 3, 3], [0, 0, 3, -1]]


@pytest.fixture(scope="module")
def seg(spark):
    px = grid(spark, k2=K2, k4=K4)
    attrs = spark.createDataFrame(
        [("k2", 0, "water.lake", None), ("k4", 2, "forest.oak", "rgb(1, 2, 3)"), ("k4", 3, "forest.pine", None), ("k4", 9, "gone", None)],
        "raster_key string, cluster_id int, path string, color string",
    )
    return S.SegmentedRaster(px, registry.build_registry(px, attrs))


@pytest.fixture(scope="module")
def colors(spark):
    return spark.createDataFrame([("water", "#0000ff"), ("forest", "#00ff00"), ("forest.pine", "#112233")], "path string, hex string")


def test_registry(seg):
    rows = {(r["raster_key"], r["cluster_id"]): r for r in seg.registry.collect()}
    assert len(rows) == 6 and ("k4", 9) not in rows
    assert rows["k2", 0]["pixel_count"] == 10 and rows["k2", 0]["area_ha"] == Decimal("0.10")
    assert rows["k2", 1]["classification_path"] == "unlabeled"


def test_counts_and_nodata_sum_to_the_grid(seg):
    lost = seg.pixels.filter("value = -1").count()
    assert registry.count_pixels(seg.pixels).agg(F.sum("pixel_count")).first()[0] + lost == 32


def test_nodata_of_zero_is_honoured(spark):
    got = registry.count_pixels(grid(spark, k1=[[0, 0, 5], [-1, 5, -999]]), nodata=0).collect()
    assert {(r["cluster_id"], r["pixel_count"]) for r in got} == {(5, 2), (-1, 1), (-999, 1)}


def test_histogram_of_a_constant_raster_is_in_bin_0(spark):
    got = registry.histogram(grid(spark, k1=[[4, 4], [4, 4]]), bins=3).orderBy("bin").collect()
    assert [r["count"] for r in got] == [4, 0, 0] and {r["left_edge"] for r in got} == {4.0}


def test_composite(seg):
    made = overlay.composite(seg)
    # 1 = k4/2, 2 = k4/3, 3 = k2/0; k4 decides where there is no data
    assert back(made.pixels) == [[-1, 3, 1, 1], [3, 3, 1, 2], [3, 3, 2, 2], [9999, 3, 2, -1]]
    reg = {r["cluster_id"]: r for r in made.registry.collect()}
    assert [reg[i]["pixel_count"] for i in (1, 2, 3)] == [3, 4, 6]
    assert (reg[3]["source_raster"], reg[3]["source_id"]) == ("k2", 0)


def test_composite_priorities(seg):
    low = overlay.composite(seg, "lowest_k")
    # k2 leads: 1 = k2/0, 2 = k4/2, 3 = k4/3
    assert back(low.pixels) == [[1, 1, 2, 2], [1, 1, 2, 3], [1, 1, 1, 1], [-1, 1, 1, 9999]]
    with pytest.raises(ValueError):
        overlay.composite(seg, "random")


def test_composite_most_specific(spark):
    px = grid(spark, k2=[[0, 0]], k4=[[1, 2]])
    attrs = spark.createDataFrame([("k2", 0, "a.b.c"), ("k4", 1, "a"), ("k4", 2, "x.y.z")], "raster_key string, cluster_id int, path string")
    made = overlay.composite(S.SegmentedRaster(px, registry.build_registry(px, attrs)), "most_specific")
    paths = {r["cluster_id"]: r["classification_path"] for r in made.registry.collect()}
    assert [paths[v] for v in back(made.pixels)[0]] == ["a.b.c", "x.y.z"]


def test_composite_keeps_clusters_that_win_no_pixel(spark):
    px = grid(spark, k2=[[0, 0]], k4=[[1, 1]])
    attrs = spark.createDataFrame([("k2", 0, "a"), ("k4", 1, "b")], "raster_key string, cluster_id int, path string")
    reg = overlay.composite(S.SegmentedRaster(px, registry.build_registry(px, attrs))).registry.collect()
    assert {(r["cluster_id"], r["pixel_count"]) for r in reg} == {(1, 2), (2, 0)}


def test_composite_of_one_raster_is_its_labelled_mask(seg):
    one = S.SegmentedRaster(seg.pixels.filter("raster_key = 'k2'"), seg.registry.filter("raster_key = 'k2'"))
    assert back(overlay.composite(one).pixels) == [[{0: 1, 1: 9999, -1: -1}[v] for v in row] for row in K2]


def test_composite_needs_a_raster(seg):
    with pytest.raises(ValueError):
        overlay.composite(S.SegmentedRaster(seg.pixels, seg.registry.limit(0)))


def test_synthetic_leads_only_with_labels(spark, seg):
    reg = seg.registry.select("raster_key", "cluster_id", "classification_path")
    extra = lambda path: spark.createDataFrame([(S.SYNTHETIC_KEY, 10000, path)], reg.schema)
    order = lambda r: [x["raster_key"] for x in overlay.composite_inputs(r).orderBy("prio").collect()]
    assert order(reg.unionByName(extra("unlabeled"))) == ["k4", "k2"]
    assert order(reg.unionByName(extra("a"))) == [S.SYNTHETIC_KEY, "k4", "k2"]


def test_interactive(seg, colors):
    current = S.SegmentedRaster(seg.pixels.filter("raster_key = 'k2'"), seg.registry.filter("raster_key = 'k2'"))
    out = overlay.interactive(overlay.composite(seg), current, colors, level=1)
    # (3,0) is unlabelled in the composite and has no data in the current raster
    assert back(out.pixels) == [[-1, 1, 2, 2], [1, 1, 2, 3], [1, 1, 3, 3], [-1, 1, 3, -1]]
    rows = {r["cluster_id"]: (r["source_key"], r["color"]) for r in out.registry.collect()}
    assert rows == {1: ("water.lake", "rgb(0,0,255)"), 2: ("forest.oak", "rgb(0,255,0)"), 3: ("forest.pine", "rgb(0,255,0)")}


def test_interactive_keeps_free_clusters_apart(spark):
    px = grid(spark, k2=[[0, 1, 1]], k4=[[3, 3, 3]])
    attrs = spark.createDataFrame([("k2", 0, "a")], "raster_key string, cluster_id int, path string")
    both = S.SegmentedRaster(px, registry.build_registry(px, attrs))
    current = S.SegmentedRaster(px.filter("raster_key = 'k4'"), both.registry.filter("raster_key = 'k4'"))
    out = overlay.interactive(overlay.composite(both), current)
    assert back(out.pixels) == [[1, 2, 2]] and back(out.pixels, "source_id") == [[1, 50003, 50003]]
    assert {r["source_key"] for r in out.registry.collect()} == {"a", "unlabeled_50003"}


def test_merge_needs_equal_grids(spark):
    meta = spark.createDataFrame([(4, 3)], "width int, height int")
    overlay.check_same_grid(meta, meta)
    with pytest.raises(ValueError):
        overlay.check_same_grid(meta, spark.createDataFrame([(4, 4)], "width int, height int"))


def test_export(seg, colors):
    made = overlay.composite(seg)
    mapping = overlay.pixel_mapping(made, 1, colors)
    assert {(r["id"], r["path"], r["hex"]) for r in mapping.collect()} == {
        (0, "forest", "#00ff00"), (1, "water", "#0000ff"), (9999, "unlabeled", None)}
    assert back(overlay.classification_raster(made, 1), "class_id") == [[-1, 1, 0, 0], [1, 1, 0, 0], [1, 1, 0, 0], [9999, 1, 0, -1]]
    assert {(r["id"], r["hex"]) for r in overlay.color_mapping(mapping.select("id", "path"), colors).collect()} == {
        (0, "#00ff00"), (1, "#0000ff"), (-1, "#000000"), (9999, None)}


def test_render(seg, colors):
    classes = overlay.classification_raster(overlay.composite(seg), 1)
    mapping = overlay.pixel_mapping(overlay.composite(seg), 1)
    image = render.render_image(classes, mapping, colors.filter("path <> 'water'"), scale=2)
    got = {(r["y"], r["x"]): tuple(r[c] for c in "rgba") for r in image.collect()}
    assert len(got) == 64
    assert got[0, 0] == got[1, 1] == (0, 0, 0, 0)  # nodata
    assert got[0, 2] == (0x88, 0x88, 0x88, 255)  # no colour known
    assert got[0, 4] == (0, 255, 0, 255) and got[6, 0] == (0, 0, 0, 255)  # unlabelled


def test_set_labels_clears_the_colour_of_unlabelled(spark, seg, colors):
    edits = spark.createDataFrame([("k4", 2, "unlabeled"), ("k2", 1, "forest.elm")], "raster_key string, cluster_id int, path string")
    rows = {(r["raster_key"], r["cluster_id"]): r for r in registry.set_labels(seg.registry, edits, colors).collect()}
    assert rows["k4", 2]["color"] is None and rows["k4", 2]["classification_path"] == "unlabeled"
    assert rows["k2", 1]["color"] == "rgb(0,255,0)" and len(rows) == 6


def test_aggregate_by_key_takes_the_first_known_cluster(spark):
    px = grid(spark, k1=[[7, 5, 6], [-1, 6, 7]])
    reg = registry.build_registry(px, spark.createDataFrame([("k1", 6, "p", "rgb(1, 1, 1)")], "raster_key string, cluster_id int, path string, color string"))
    out = registry.aggregate_by_key(S.SegmentedRaster(px, reg.filter("cluster_id <> 7")), lambda i, p, c: F.when(i >= 6, F.lit("high")).otherwise(F.lit("low")))
    assert back(out.pixels) == [[1, 2, 1], [-1, 1, 1]]
    rows = {r["source_key"]: (r["classification_path"], r["color"], r["pixel_count"]) for r in out.registry.collect()}
    assert rows == {"high": ("p", "rgb(1, 1, 1)", 4), "low": ("unlabeled", None, 1)}


def test_paths(spark):
    df = spark.createDataFrame([(None,), ("unlabeled",), ("a",), ("a.b.c",), ("",)], "p string")
    got = df.select(P.truncate(F.col("p"), 2), P.parent(F.col("p")), I.is_labeled(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [
        (None, None, False), ("unlabeled", None, False), ("a", None, True), ("a.b", "a.b", True), ("", None, False)]
    one = spark.range(1)
    assert one.select(P.kebab(F.lit("  Dry -- Forest (N)!"))).first()[0] == "dry-forest-n"
    assert one.select(P.display_name(F.lit("a.b_c"))).first()[0] == "b c"


def test_path_colors(spark, colors):
    paths = spark.createDataFrame([("forest.oak.x",), ("forest.pine",), ("desert",), ("unlabeled",)], "path string")
    got = {r["path"]: r["hex"] for r in hierarchy.path_colors(paths, colors, strict=False, fallback="#888888").collect()}
    assert got == {"forest.oak.x": "#00ff00", "forest.pine": "#112233", "desert": "#888888", "unlabeled": None}
    with pytest.raises(Exception, match="No color mapping found for path: desert"):
        hierarchy.path_colors(paths, colors, strict=True).collect()
    shown = hierarchy.path_colors(paths.filter("path = 'forest.pine'"), colors, level=1).first()
    assert shown["css"] == "rgb(0,255,0)"


def test_colors(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(C.hex_to_rgb(F.lit("0A0b0C"))) == "10,11,12"
    with pytest.raises(Exception, match="Invalid hex color"):
        value(C.hex_to_rgb(F.lit("#12")))
    assert value(C.hex_to_rgb(F.lit("#12"), strict=False)) is None
    assert value(C.rgb_to_hex(F.lit("rgb(0, 15,255)"))) == "#000fff"
    assert value(C.rgb_to_hex(F.lit("rgba(1,2,3)"))) is None
    assert value(C.grayscale(F.lit("rgb(10, 20, 30)"))) == "rgba(18, 18, 18, 1)"
    assert value(C.grayscale(F.lit("#fff"), 0.3)) == "#fff"


def test_flatten_hierarchy(spark):
    doc = '{"b":{"_name":"B","y":{"_d":"t"},"x":{"deep":{}}},"a":{},"_note":"n"}'
    flat = hierarchy.flatten_hierarchy(spark.createDataFrame([(doc,)], "hierarchy string"))
    rows = [(r["path"], r["level"], r["is_leaf"]) for r in flat.orderBy("order_key").collect()]
    assert rows == [("b", 0, False), ("b.y", 1, True), ("b.x", 1, False), ("b.x.deep", 2, True), ("a", 0, True)]
    assert hierarchy.selectable_options(flat).first()["path"] == "unlabeled"
    deep = '{"a{}\\"":' * 12 + "{}" + "}" * 12  # braces and a quote inside the names
    flat = hierarchy.flatten_hierarchy(spark.createDataFrame([(deep,)], "hierarchy string"))
    assert flat.select("path").count() == 12 and flat.filter("is_leaf").first()["level"] == 11


def test_composite_ids_stay_out_of_the_reserved_ones(spark):
    reg = spark.range(12_000).select(
        F.lit("k3").alias("raster_key"), F.col("id").cast("int").alias("cluster_id"), F.lit("a").alias("classification_path"), F.lit(None).cast("string").alias("color"))
    ids = overlay.composite_ids(reg).cache()
    assert ids.filter((F.col("uid") >= 9999) & (F.col("uid") < S.COMPOSITE_START)).count() == 0
    rows = [r["uid"] for r in ids.orderBy("cluster_id").collect()]
    assert rows == sorted(set(rows)) and len(rows) == 12_000


def test_merge_refuses_other_sizes_and_fills_gaps(spark):
    a, b = grid(spark, a=[[1, 2], [3, 4]]), grid(spark, b=[[1, 2, 3], [3, 4, 5]])
    plus = lambda u, v, y, x: u + v
    with pytest.raises(ValueError, match="different dimensions"):
        overlay.merge(a, b, plus)
    assert back(overlay.merge(a, a.filter("NOT (y = 0 AND x = 1)"), plus)) == [[2, 1], [6, 8]]


def test_merge_by_metadata_takes_a_raster_without_its_last_row(spark):
    a = grid(spark, a=[[1, 2], [3, 4]])
    plus = lambda u, v, y, x: u + v
    size = spark.createDataFrame([(2, 2)], "width int, height int")
    other = spark.createDataFrame([(2, 3)], "width int, height int")
    assert back(overlay.merge(a, a.filter("y = 0"), plus, metas=(size, size))) == [[2, 4], [2, 3]]
    with pytest.raises(ValueError, match="different dimensions"):
        overlay.merge(a, a, plus, metas=(size, other))
    reg = spark.createDataFrame([], S.REGISTRY)
    top, now = S.SegmentedRaster(a.filter("y = 0"), reg, size), S.SegmentedRaster(a, reg, size)
    merged = overlay.interactive_pixels(top.pixels, now.pixels, (top.meta, now.meta))
    assert back(merged) == [[1, 2], [-1, -1]]


def test_hierarchy_from_attributes(spark):
    feats = spark.createDataFrame(
        [(1, {"B": "Wet Land", "E": "Big  Lake"}), (2, {"B": "wet land", "E": None}), (3, {"B": "Dry", "E": "Sand"}), (4, {"B": "WET LAND", "E": "big lake"})],
        "feature_id int, properties map<string,string>")
    flat = {r["path"]: r["name"] for r in hierarchy.flat_hierarchy(feats, "B").collect()}
    assert flat == {"wet-land": "WET LAND", "dry": "Dry"}  # last spelling
    two = {r["path"]: (r["name"], r["n_children"]) for r in hierarchy.two_level_hierarchy(feats, "B", "E").collect()}
    assert two == {"wet-land": ("Wet Land", 1), "wet-land.big-lake": ("Big  Lake", 0), "dry": ("Dry", 1), "dry.sand": ("Sand", 0)}
    prof = {r["field"]: (r["n_values"], r["n_distinct"], r["samples"]) for r in hierarchy.field_profile(feats, samples=2).collect()}
    assert prof == {"B": (4, 4, ["Wet Land", "wet land"]), "E": (3, 3, ["Big  Lake", "Sand"])}
    later = feats.unionByName(spark.createDataFrame([(5, {"Z": "new"})], feats.schema))
    assert {r["field"] for r in hierarchy.field_profile(later).collect()} == {"B", "E", "Z"}
    assert {r["field"] for r in hierarchy.field_profile(later, of_first=True).collect()} == {"B", "E"}


def test_degenerate_rings(spark):
    ring = lambda *p: [(float(a), float(b)) for a, b in p]
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    rows = [(1, [ring(), ring((1, 1)), ring((0, 0), (1, 1))]), (2, [ring(*square)]), (3, [ring((2, 0), (4, 0), (4, 2), (2, 2), (2, 0))]), (4, [])]
    feats = spark.createDataFrame(rows, "feature_id int, rings array<array<struct<lng:double,lat:double>>>")
    g = spark.createDataFrame([(0.0, 2.0, 1.0, 1.0, 4, 2)], "xmin double, ymax double, pixel_width double, pixel_height double, width int, height int")
    got = {(r["y"], r["x"]): r["feature_id"] for r in zonal.rasterize(feats, g).collect()}
    assert got == {(y, x): 2 if x < 2 else 3 for y in range(2) for x in range(4)}
    wide = spark.createDataFrame([(5, [ring((0, 0), (200, 0), (200, 1), (0, 1), (0, 0))]), (6, [ring((60, 0), (70, 0), (70, 1), (60, 1), (60, 0))])], feats.schema)
    long = spark.createDataFrame([(0.0, 1.0, 1.0, 1.0, 200, 1)], g.schema)
    got = {r["x"]: r["feature_id"] for r in zonal.rasterize(wide, long).collect()}
    assert got == {x: 6 if 60 <= x < 70 else 5 for x in range(200)}


def test_class_and_group_ids_stay_outside_reserved_ones(spark):
    """10,050 classes: none gets 9999, which means unlabelled, nor a synthetic id."""
    n = 10_050
    px = spark.range(n).select(F.lit("k1").alias("raster_key"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), (F.col("id") + S.COMPOSITE_START // 2).cast("int").alias("value"))
    reg = registry.build_registry(px, lambda c: (F.concat(F.lit("c"), F.lpad(c.cast("string"), 12, "0")), F.lit(None).cast("string")))
    seg = S.SegmentedRaster(px, reg)
    for ids, first in (
        (sorted(r["id"] for r in overlay.pixel_mapping(seg).collect()), 0),
        (sorted(r["cluster_id"] for r in registry.aggregate_by_key(seg, lambda c, path, color: path).registry.collect()), 1),
    ):
        want = list(range(first, first + n))
        assert ids == [i if i < S.UNLABELED_ID else i + S.COMPOSITE_START for i in want]
    assert overlay.classification_raster(seg).filter(F.col("class_id") == S.UNLABELED_ID).count() == 0
