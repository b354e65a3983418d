"""Land-cover raster analytics on pixel tables."""

from terragrid.operators.blocks import blocks_from_pixels, composite_blocks, count_pixels_blocks, pixels_from_blocks
from terragrid.operators.cluster import cluster_palette, kmeans_range, nearest_centroid, valid_count
from terragrid.operators.detect import above_confidence, detections_geojson, parse_detections
from terragrid.operators.hierarchy import (
    by_prefix,
    field_profile,
    flat_hierarchy,
    flatten_hierarchy,
    hierarchy_rollup,
    items_at_level,
    path_colors,
    selectable_options,
    two_level_hierarchy,
)
from terragrid.operators.labels import clear_labels, latest_labels, merge_labels, replace_labels
from terragrid.operators.overlay import (
    classification_raster,
    color_mapping,
    composite,
    composite_ids,
    composite_inputs,
    composite_placeholder,
    constant_raster,
    interactive,
    merge,
    pixel_mapping,
    synthetic_raster,
)
from terragrid.operators.growth import grow_regions_matched
from terragrid.operators.halo import majority, neighbor_votes_blocks, stencil, with_halo
from terragrid.operators.region import (
    components,
    fill_region,
    grow_regions,
    label_regions,
    neighbor_votes,
    neighbors,
    pick_regions,
    synthetic_ids,
)
from terragrid.operators.registry import (
    aggregate_by_key,
    build_registry,
    count_by_value,
    count_pixels,
    filter_clusters,
    histogram,
    labeled_clusters,
    labeled_paths,
    lookup_clusters,
    map_pixels,
    palette_colors,
    progress,
    raster_order,
    remap,
    restore_labels,
    set_labels,
)
from terragrid.operators.render import class_colors, cluster_colors, composite_colors, export_colors, render_image
from terragrid.operators.resample import clip, coarsen, filter_collection, merge_first, reproject, target_grid
from terragrid.operators.store import pack_blocks, pyramid, read_store, sample_points_stored, write_store, zonal_intersection_stored
from terragrid.operators.tiles import (
    audit_summary,
    drop_bad_tiles,
    feature_bounds,
    missing_tiles,
    mosaic,
    mosaic_extent,
    parent_tiles,
    spread_sample,
    suspect_tiles,
    tile_audit,
    upsample_quadrant,
    weakest_tiles,
)
from terragrid.operators.zonal import (
    attach_properties,
    cluster_list,
    feature_coverage,
    filter_by_feature,
    rasterize,
    sample_points,
    select_clusters,
    zonal_intersection,
)
from terragrid.schema import SegmentedRaster
from terragrid.streaming.labels import current_labels, fold_label_stream, write_progress

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("operators", "schema", "streaming", "functions", "plans", "sources")]
