"""Files in and out, polygons, detections, clustering and streams."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from test_rasters import back, grid

from terragrid import schema as S
from terragrid.functions import geo as G
from terragrid.operators import cluster, detect, labels, registry, zonal
from terragrid.sources import manifest, tables
from terragrid.streaming import labels as stream

GOOD = {"segmentation_keys": ["k10", "k5"], "files": ["a.tif", "b.tif"], "metadata": {"bounds": [0, 0, 2, 1], "shape": [1, 2]}}


def docs(spark, *values, name="manifest"):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], f"{name} string")


@pytest.mark.parametrize(
    ("change", "message"),
    [({}, None), ({"files": None}, "Missing required field: files"), ({"files": []}, "files must be a non-empty array"),
     ({"files": ["a"]}, "same length"), ({"metadata": {}}, "must be an array"), ({"metadata": {"bounds": [1]}}, "exactly 4"),
     ({"color_mapping": {}}, "colors_rgb must be an array"), ({"color_mapping": {"colors_rgb": []}}, None), ({"segmentation_keys": 3}, "segmentation_keys must be")],
)
def test_manifest_rules(spark, change, message):
    d = docs(spark, {**GOOD, **change})
    if message is None:
        assert manifest.validate_manifest(d).count() == 1
    else:
        with pytest.raises(ValueError, match=message):
            manifest.validate_manifest(d)


def test_manifest_files(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps(GOOD, indent=2))
    entries = manifest.manifest_entries(manifest.read_documents(spark, str(tmp_path / "manifest.json")))
    assert {(r["raster_key"], r["k"], r["xmax"]) for r in entries.collect()} == {("k10", 10, 2.0), ("k5", 5, 2.0)}
    px = spark.createDataFrame([("a.tif", 0, 0, 1), ("b.tif", 0, 1, 2)], "filename string, y int, x int, value int")
    assert {(r["raster_key"], r["value"]) for r in manifest.scan_rasters(entries, px).collect()} == {("k10", 1), ("k5", 2)}
    with pytest.raises(FileNotFoundError, match="b.tif"):
        manifest.scan_rasters(entries, px.filter("filename = 'a.tif'"))


def test_palette(spark):
    legend = {"segmentations": {"k5": {"clusters": {"0": {"rgb_255": [255, 0, 51]}}}}}
    colors = manifest.palette(docs(spark, legend, name="legend"))
    r = colors.first()
    assert (r["cluster_id"], r["r_unit"], r["b_unit"], r["nodata"]) == (0, 1.0, 0.2, -1)
    lost = manifest.keys_without_palette(manifest.manifest_entries(docs(spark, GOOD)), colors).collect()
    assert [r["raster_key"] for r in lost] == ["k10"]


def test_hierarchy_files(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"a": {"b": {"_description": "x"}}}')
    (tmp_path / "c.json").write_text('{"a": "#010203"}')
    rows, colors = manifest.load_hierarchy(spark, str(tmp_path / "h.json"), str(tmp_path / "c.json"))
    assert {r["path"] for r in rows.collect()} == {"a", "a.b"} and tuple(colors.first()) == ("a", "#010203")


def test_projection(spark):
    ok = spark.createDataFrame([("k", [1.0] * 3, [0.0] * 6, 4326, 2, 1)], "key string, pixel_scale array<double>, tiepoint array<double>, geographic_type int, model_type int, raster_type int")
    assert manifest.validate_projection(ok).count() == 1
    with pytest.raises(ValueError, match="not WGS84 .got 3857., not pixel area"):
        manifest.validate_projection(ok.withColumn("geographic_type", F.lit(3857)).withColumn("raster_type", F.lit(2)))


def reg(spark):
    return spark.createDataFrame([("k5", 0, 3, "a.b", None), ("k5", 1, 2, "unlabeled", None), ("k9", 0, 1, "unlabeled", None)],
                                 "raster_key string, cluster_id int, pixel_count long, classification_path string, color string")


def test_label_files(spark, tmp_path):
    target = tables.export_labels(reg(spark), str(tmp_path), date(2024, 5, 6))
    assert target.endswith("cluster-labels-2024-05-06.json")
    text = "".join(r["value"] for r in spark.read.text(target).collect())
    assert json.loads(text) == {"k5": {"0": "a.b"}, "k9": {}}
    assert [tuple(r) for r in tables.import_labels(spark, target).collect()] == [("k5", 0, "a.b")]
    (tmp_path / "bad.json").write_text('{"k5": ["x"]}')
    with pytest.raises(ValueError, match="Invalid label file"):
        tables.import_labels(spark, str(tmp_path / "bad.json"))


def edits(spark, *rows):
    return spark.createDataFrame([(k, c, p, datetime(2024, 1, d), s) for k, c, p, d, s in rows], S.LABELS)


def test_label_table(spark, tmp_path):
    table = str(tmp_path / "labels")
    assert tables.load_labels(spark, table).count() == 0
    tables.save_labels(edits(spark, ("k5", 0, "a", 1, 1), ("k5", 1, "b", 1, 2)), table)
    tables.save_labels(edits(spark, ("k5", 0, "c", 2, 3)), table)
    assert {(r["cluster_id"], r["path"]) for r in tables.load_labels(spark, table).collect()} == {(0, "c"), (1, "b")}


def test_label_edits(spark):
    now = edits(spark, ("k5", 0, "a", 3, 1), ("k9", 0, "z", 1, 1))
    later = edits(spark, ("k5", 0, "old", 2, 9), ("k9", 0, "new", 1, 2))
    assert {(r["raster_key"], r["path"]) for r in labels.merge_labels(now, later).collect()} == {("k5", "a"), ("k9", "new")}
    swapped = labels.replace_labels(now, now.filter("raster_key = 'k9'"), edits(spark, ("k9", 4, "q", 1, 1)))
    assert {(r["raster_key"], r["cluster_id"]) for r in swapped.collect()} == {("k5", 0), ("k9", 4)}
    assert labels.clear_labels(now).count() == 0


def test_stream_equals_batch_and_survives_a_repeat(spark, tmp_path):
    log = edits(spark, *[("k5", i % 3, f"p{i}", 1 + i % 9, i) for i in range(40)]).select("seq", "ts", "raster_key", "cluster_id", "path")
    log.repartition(5).write.parquet(str(tmp_path / "log"))
    source = stream.read_label_stream(spark, str(tmp_path / "log"), files_per_trigger=1)
    run = lambda ck: stream.fold_label_stream(source, str(tmp_path / "table"), str(tmp_path / ck)).awaitTermination()
    rows = lambda df: {tuple(r) for r in df.select("raster_key", "cluster_id", "path").collect()}
    run("ck")
    want = rows(labels.latest_labels(log))
    assert rows(stream.current_labels(spark, str(tmp_path / "table"))) == want
    run("ck")  # nothing new
    run("other")  # the whole log once more
    assert rows(stream.current_labels(spark, str(tmp_path / "table"))) == want
    stream.compact_labels(spark, str(tmp_path / "table"), str(tmp_path / "small"))
    assert rows(stream.current_labels(spark, str(tmp_path / "small"))) == want


def meta(spark, n):
    return spark.createDataFrame([("k", 0.0, float(n), 1.0, 1.0, n, n)], "raster_key string, xmin double, ymax double, pixel_width double, pixel_height double, width int, height int")


def feature(spark, *rings):
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(rings)], "feature_id int, rings array<array<struct<lng:double,lat:double>>>")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_polygon_burn(spark):
    with_hole = [box(0.2, 0.2, 5.8, 5.8), box(2.2, 2.2, 3.8, 3.8)]
    triangle = [[(0.0, 6.0), (3.2, 6.0), (0.0, 2.8), (0.0, 6.0)]]
    burnt = zonal.rasterize(feature(spark, with_hole, triangle), meta(spark, 6), fill=True)
    # row 0 is the north; the later feature wins; the hole stays empty
    assert back(burnt, "feature_id") == [
        [2, 2, 2, 1, 1, 1], [2, 2, 1, 1, 1, 1], [2, 1, 0, 0, 1, 1], [1, 1, 0, 0, 1, 1], [1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1]]


def test_polygon_edges_share_pixels_once(spark):
    left, right = [box(0.5, 0.0, 2.5, 4.0)], [box(2.5, 0.0, 9.0, 4.0)]
    spans = zonal.polygon_spans(feature(spark, left, right), meta(spark, 4))
    assert {(r["feature_id"], r["x0"], r["x1"]) for r in spans.collect()} == {(1, 0, 1), (2, 2, 3)} and spans.count() == 8


def test_zonal_counts(spark):
    px = grid(spark, k=[[0, 0, 1, -1], [0, 0, 1, 1], [2, 2, 1, 1], [2, 2, 2, 2]])
    burnt = zonal.rasterize(feature(spark, [box(0.0, 2.0, 3.0, 4.0)]), meta(spark, 4))
    got = {r["cluster_id"]: (r["pct"], r["pixel_count"], r["passes"]) for r in zonal.zonal_intersection(px, burnt, 50).collect()}
    assert got == {0: (100.0, 4, True), 1: (40.0, 2, False)}
    z = zonal.zonal_intersection(px, burnt, 30)
    reg_ = registry.build_registry(px)
    listed = zonal.cluster_list(reg_, z, 1, 50, min_pct=30).collect()
    assert [(r["cluster_id"], r["is_filtered"]) for r in listed] == [(0, True), (1, False), (2, False)]
    assert zonal.feature_coverage(z, 50, min_pct=30).first()["coverage_pct"] == pytest.approx(400 / 6)
    with pytest.raises(ValueError):
        zonal.filter_by_feature(z, reg_, 20, min_pct=30)
    with pytest.raises(ValueError):
        zonal.zonal_intersection(px, burnt, 101)


def test_intersection_files(spark, tmp_path):
    index = {"segmentation_key": "k5", "config": {"min_intersection_pct": 50}, "feature_to_clusters": {"1": [[0, 80.5, 9]]},
             "cluster_to_features": {"0": [[1, 80.5, 9], [2, 3.25, 1]]}, "feature_properties": {}}
    (tmp_path / "k5.json").write_text(json.dumps(index))
    (tmp_path / "config.json").write_text('{"version": 1}')
    rows = tables.read_intersection_documents(spark, str(tmp_path)).collect()
    assert {(r["feature_id"], r["pct"], r["pixel_count"], r["passes"]) for r in rows} == {(1, 80.5, 9, True), (2, 3.25, 1, False)}
    tables.write_intersections(tables.read_intersection_documents(spark, str(tmp_path)), str(tmp_path / "native"))
    native = tables.read_intersections(spark, str(tmp_path / "native"))
    assert native.count() == 2
    tables.write_index_config(native, str(tmp_path / "cfg"), "f.zip", 50, "2024-01-01")
    assert spark.read.json(str(tmp_path / "cfg")).first()["segmentations"] == ["k5"]


def test_feature_file(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "f.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"n": "x", "v": 3}}]}))
    f = tables.read_features(spark, str(tmp_path / "f.geojson")).first()
    assert f["feature_id"] == 1 and f["properties"] == {"n": "x", "v": "3"} and len(f["rings"][0]) == 4


def test_class_raster_types(spark, tmp_path):
    px = lambda v: spark.createDataFrame([("k", 0, 0, v), ("k", 0, 1, -1)], "raster_key string, y int, x int, class_id int")
    assert [tables.narrow_type(px(v)) for v in (126, 127, 32767, 50000)] == [("tinyint", 1), ("smallint", 1), ("smallint", 1), ("int", 1)]
    assert tables.write_class_raster(px(9999), str(tmp_path / "c")) == ("smallint", 1)
    read = spark.read.parquet(str(tmp_path / "c"))
    assert read.schema["class_id"].dataType.simpleString() == "smallint" and {r["class_id"] for r in read.collect()} == {9999, -1}


def test_export_folder(spark, tmp_path):
    classes = spark.createDataFrame([("k", 0, 0, 0)], "raster_key string, y int, x int, class_id int")
    mapping = spark.createDataFrame([(0, "a")], "id int, path string")
    tables.export_land_cover(classes, mapping, spark.createDataFrame([(0, "a", "#000001"), (9999, "unlabeled", None)], "id int, path string, hex string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/pixel-mapping")).first()["path"] == "a"
    assert spark.read.json(str(tmp_path / "out/land-cover-colors")).count() == 2


def test_manifest_and_legend_output(spark, tmp_path):
    m = spark.createDataFrame([("k10", 10, "b.parquet", 2.0, 0.0, 0.0, 4.0, 3.0, 3, 4), ("k5", 5, "a.parquet", 1.0, 0.0, 0.0, 4.0, 3.0, 3, 4)],
                              "raster_key string, k int, filename string, file_size_mb double, xmin double, ymin double, xmax double, ymax double, height int, width int")
    tables.write_manifest(m, str(tmp_path / "m"))
    d = spark.read.text(str(tmp_path / "m")).select(F.col("value").alias("manifest"))
    assert manifest.validate_manifest(d).count() == 1
    assert [r["raster_key"] for r in manifest.manifest_entries(d).orderBy("position").collect()] == ["k5", "k10"]


def test_tile_folder(spark, tmp_path):
    for name, size in (("tile_3_1_2.jpg", 5), ("tile_3_1_2.png", 7), ("tile_3_4_5.png", 0), ("notes.txt", 3)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {(r["x"], r["y"], r["ext"], r["size"]) for r in tables.read_tile_inventory(spark, str(tmp_path)).collect()}
    assert got == {(1, 2, "jpg", 5)}
    audit = tables.read_tile_inventory(spark, str(tmp_path), tables.AUDIT_ORDER)
    assert audit.filter("x = 1").first()["ext"] == "png"


def test_detections(spark, tmp_path):
    payloads = [
        [{"class": "tree", "confidence": 0.9, "id": "1", "bbox": [0, 0, 10, 5]}],
        {"objects": [{"label": "road", "id": "2", "polygon": [[[0, 0], [10, 0], [10, 10], [0, 0]]]}, {"id": "3"}]},
        {"other": 1}, [], [{"class": "x", "box_2d": [0, 500, 1000, 1000], "id": "4"}],
    ]
    df = docs(spark, *payloads, "not json", name="payload")
    assert detect.parse_detections(df).filter("is_error").count() == 1
    out = detect.detections_geojson(df, 10, 10, {"west": 0.0, "south": 0.0, "east": 100.0, "north": 50.0})
    rows = {r["det_id"]: r for r in out.collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert rows["1"]["rings"] == [[[0.0, 25.0], [100.0, 25.0], [100.0, 50.0], [0.0, 50.0], [0.0, 25.0]]]
    assert rows["2"]["rings"] == [[[0.0, 50.0], [100.0, 50.0], [100.0, 0.0], [0.0, 50.0]]] and rows["2"]["confidence"] == 0.5
    assert rows["3"]["geometry_json"] is None and rows["3"]["label"] == "unknown"
    assert rows["4"]["rings"][0][0] == [50.0, 0.0] and rows["4"]["rings"][0][2] == [100.0, 50.0]
    tables.write_detections(out, str(tmp_path / "d"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "d")).collect()]
    assert {f["properties"]["detectionId"]: f["geometry"] is None for f in lines} == {"1": False, "2": False, "3": True, "4": False}


def test_dragged_box(spark):
    b = spark.range(1).select(G.bbox_of_corners(F.lit(1.0), F.lit(9.0), F.lit(3.0), F.lit(5.0)).alias("b")).first()["b"]
    assert tuple(b) == (3.0, 1.0, 9.0, 5.0, 2.0, 7.0)


def vectors(spark):
    rows = [(i, [float(i % 3) * 10 + (i % 7) * 0.01, float(i % 3)]) for i in range(90)] + [(900, [float("nan"), 0.0]), (901, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_kmeans_separates_and_skips_invalid(spark):
    found, centers = cluster.kmeans_range(vectors(spark), (2, 3), sample=0.8)
    assert found.count() == 2 * 92 and centers.count() == 5
    k3 = {r["vec_id"]: r["cluster_id"] for r in found.filter("raster_key = 'k3'").collect()}
    assert k3[900] == k3[901] == -1
    assert len({(i % 3, c) for i, c in k3.items() if i < 90}) == 3
    again = cluster.nearest_centroid(vectors(spark), centers.filter("raster_key = 'k3'"))
    assert {r["vec_id"]: r["cluster_id"] for r in again.collect()} == k3
    shades = cluster.cluster_palette(centers, 2).collect()
    assert len(shades) == 5 and all(0 <= r[c] <= 255 for r in shades for c in "rgb")
    with pytest.raises(ValueError):
        cluster.kmeans_range(vectors(spark), ())
    with pytest.raises(ValueError):
        cluster.cluster_palette(centers, 1)
    assert tuple(cluster.valid_count(vectors(spark)).first()) == (92, 90)


def test_centroids_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BROADCAST_MAX_BYTES", 32)
    c = spark.createDataFrame([(i, [i * 10.0, float(i)]) for i in range(3)], "cluster_id int, centroid array<double>")
    got = {r["vec_id"]: r["cluster_id"] for r in cluster.nearest_centroid(vectors(spark), c).collect()}
    assert all(got[i] == i % 3 for i in range(90)) and got[900] == -1


@pytest.mark.parametrize("name", ["label_stream", "progress_stream"])
def test_stream_queries_wait_for_all_batches(spark, monkeypatch, name):
    from terragrid.plans import queries

    monkeypatch.setattr(queries, "STREAM_SECONDS", 0.001, raising=False)  # no limit may end them early
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    edits = queries.fx.label_events(spark, "/root/testdata/sf0.001")
    assert got == edits.select("raster_key", *(["cluster_id"] if name == "label_stream" else [])).distinct().count()
