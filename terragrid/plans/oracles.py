"""SQL twins of the registered queries.

``FIXTURES`` holds the derived tables as SQL text; :func:`sql` puts those a
query needs in front of it.
"""

from __future__ import annotations

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "ks": ((), "SELECT 'k5' AS raster_key, 5 AS k UNION ALL SELECT 'k10', 10 UNION ALL SELECT 'k20', 20"),
    "pixels": (
        ("ks",),
        """SELECT ks.raster_key, CAST(FLOOR(o_orderkey / 50) AS INT) AS y, CAST(o_orderkey % 50 AS INT) AS x,
             CAST(CASE WHEN o_custkey % 13 = 0 THEN -1
                       WHEN ks.k = 20 AND o_custkey % 17 = 0 THEN -1
                       WHEN o_custkey % 11 = 0 THEN o_custkey % ks.k
                       ELSE (FLOOR((o_orderkey % 50) / 5) + 3 * FLOOR(o_orderkey / 250)) % ks.k END AS INT) AS value
           FROM orders CROSS JOIN ks""",
    ),
    "meta": (
        ("ks",),
        """SELECT ks.raster_key, ks.k, 80.0::DOUBLE AS xmin, 12.0::DOUBLE AS ymax, 0.0625::DOUBLE AS pw, 50 AS width,
             (SELECT CAST(FLOOR(MAX(o_orderkey) / 50) + 1 AS INT) FROM orders) AS height FROM ks""",
    ),
    "classes": (
        (),
        """SELECT n_nationkey, r_regionkey, n_name, r_name,
             CONCAT(LOWER(REPLACE(r_name, ' ', '-')), '.', LOWER(REPLACE(n_name, '_', '-'))) AS path
           FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "hier": (
        ("classes",),
        """SELECT LOWER(REPLACE(r_name, ' ', '-')) AS path, r_name AS name, 1 AS level FROM region
           UNION ALL SELECT path, n_name, 2 FROM classes""",
    ),
    "colors": (
        ("classes",),
        """SELECT LOWER(REPLACE(r_name, ' ', '-')) AS path, CONCAT('#', CAST(10 + r_regionkey AS VARCHAR), '4080') AS hex FROM region
           UNION ALL SELECT path, CONCAT('#', CAST(40 + n_nationkey AS VARCHAR), '2060') FROM classes WHERE n_nationkey % 3 <> 0""",
    ),
    "labels_fx": (
        ("classes", "ks"),
        """SELECT ks.raster_key, CAST(n_nationkey AS INT) AS cluster_id, path FROM classes CROSS JOIN ks
           WHERE n_nationkey < ks.k AND (n_nationkey + FLOOR(ks.k / 10)) % 2 = 0""",
    ),
    "counts": (
        ("pixels",),
        "SELECT raster_key, value AS cluster_id, COUNT(*) AS pixel_count FROM pixels WHERE value <> -1 GROUP BY 1, 2",
    ),
    "reg": (
        ("counts", "labels_fx"),
        """SELECT c.raster_key, c.cluster_id, c.pixel_count, COALESCE(l.path, 'unlabeled') AS path,
             CAST(c.pixel_count * 0.01 AS DECIMAL(18,2)) AS area_ha
           FROM counts c LEFT JOIN labels_fx l ON l.raster_key = c.raster_key AND l.cluster_id = c.cluster_id""",
    ),
    "creg": (
        ("reg",),
        """SELECT *, CASE WHEN cluster_id % 4 <> 3 THEN CONCAT('rgb(', (cluster_id * 9) % 256, ', ', (cluster_id * 5) % 256, ', ',
             (cluster_id * 12) % 256, ')') END AS color FROM reg""",
    ),
    "pal": (
        ("counts",),
        """SELECT raster_key, cluster_id, CAST((pixel_count + cluster_id * 31) % 256 AS INT) AS r,
             CAST((pixel_count * 3 + cluster_id * 31) % 256 AS INT) AS g, CAST((pixel_count * 7 + cluster_id * 31) % 256 AS INT) AS b
           FROM counts WHERE cluster_id % 3 <> 2""",
    ),
    # best colour of a class path: its own, else its region's
    "path_hex": (
        ("classes", "colors"),
        """SELECT c.path, COALESCE(a.hex, b.hex) AS hex FROM classes c LEFT JOIN colors a ON a.path = c.path
           LEFT JOIN colors b ON b.path = SPLIT_PART(c.path, '.', 1)""",
    ),
    # composite: uid of labelled clusters in priority k20, k10, k5
    "uids": (
        ("reg", "ks"),
        """SELECT raster_key, cluster_id, path, CAST(ROW_NUMBER() OVER (ORDER BY k DESC, cluster_id) AS INT) AS uid
           FROM reg JOIN ks USING (raster_key) WHERE path <> 'unlabeled'""",
    ),
    "comp": (
        ("pixels", "uids"),
        """SELECT y, x, CAST(CASE WHEN MAX(CASE WHEN p.raster_key = 'k20' THEN value END) = -1 THEN -1
                    ELSE COALESCE(MIN(uid), 9999) END AS INT) AS value
           FROM pixels p LEFT JOIN uids u ON u.raster_key = p.raster_key AND u.cluster_id = p.value GROUP BY y, x""",
    ),
    "comp_reg": (
        ("comp", "uids"),
        """SELECT u.uid AS cluster_id, CAST(COALESCE(n, 0) AS BIGINT) AS pixel_count, u.path,
             CAST(COALESCE(n, 0) * 0.01 AS DECIMAL(18,2)) AS area_ha, u.raster_key AS source_raster, u.cluster_id AS source_id
           FROM uids u LEFT JOIN (SELECT value, COUNT(*) AS n FROM comp GROUP BY 1) c ON c.value = u.uid""",
    ),
    "inter_raw": (
        ("comp", "pixels"),
        """SELECT c.y, c.x, CASE WHEN c.value = -1 OR (c.value = 9999 AND p.value = -1) THEN -1 WHEN c.value <> 9999 THEN c.value
             ELSE p.value + 50000 END AS value
           FROM comp c JOIN pixels p ON p.raster_key = 'k10' AND p.y = c.y AND p.x = c.x""",
    ),
    "inter_keys": (
        ("inter_raw", "uids"),
        """SELECT r.y, r.x, r.value AS source_id, COALESCE(u.path, CONCAT('unlabeled_', r.value)) AS key, COALESCE(u.path, 'unlabeled') AS path
           FROM inter_raw r LEFT JOIN uids u ON u.uid = r.value WHERE r.value <> -1""",
    ),
    "inter_ids": (
        ("inter_keys",),
        """SELECT key, ANY_VALUE(path) AS path, COUNT(*) AS n,
             CAST(ROW_NUMBER() OVER (ORDER BY MIN(y * 50 + x)) AS INT) AS id FROM inter_keys GROUP BY key""",
    ),
    "feat": (
        (),
        """SELECT CAST(c_custkey + 1 AS INT) AS feature_id, c_custkey % 3 = 0 AS tri, (c_custkey * 7) % 45 AS x0,
             CAST(FLOOR(c_custkey / 5) AS BIGINT) AS y0, 4 + 2 * (c_custkey % 4) AS w, 3 + 2 * (c_custkey % 3) AS h,
             c_mktsegment AS segment, CONCAT(' Nation ', c_nationkey) AS nation,
             CASE WHEN c_custkey % 4 <> 1 THEN CONCAT('C', c_custkey % 97) END AS code FROM customer""",
    ),
    "burn": (
        ("feat", "meta"),
        """SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, MAX(feature_id) AS feature_id FROM
             (SELECT f.*, UNNEST(RANGE(x0, x0 + w)) AS x FROM feat f) a,
             LATERAL (SELECT UNNEST(RANGE(y0, y0 + h)) AS y) b
           WHERE x < 50 AND y < (SELECT MAX(height) FROM meta)
             AND (NOT tri OR (4 * (x - x0) + 1) * h + (4 * (y - y0) + 1) * w < 4 * w * h)
           GROUP BY 1, 2""",
    ),
    "zonal": (
        ("pixels", "burn"),
        """SELECT *, pct_raw >= 62.5 AS passes, ROUND_EVEN(pct_raw, 2) AS pct FROM (
             SELECT raster_key, cluster_id, feature_id, n AS pixel_count,
               n / SUM(n) OVER (PARTITION BY raster_key, cluster_id) * 100 AS pct_raw
             FROM (SELECT p.raster_key, p.value AS cluster_id, b.feature_id, COUNT(*) AS n FROM pixels p
                   LEFT JOIN burn b ON b.y = p.y AND b.x = p.x WHERE p.value <> -1 GROUP BY 1, 2, 3))
           WHERE feature_id IS NOT NULL""",
    ),
    "pts": (
        (),
        """SELECT event_id AS point_id, (user_id * 7) % 60 AS gx, (event_id * 11) % 40 AS gy,
             CAST(80 + ((user_id * 7) % 60 + 0.5) * 0.0625 AS DOUBLE) AS lng, CAST(12 - ((event_id * 11) % 40 + 0.5) * 0.0625 AS DOUBLE) AS lat
           FROM events""",
    ),
    "edits": (
        ("classes",),
        """SELECT e.event_id AS seq, e.ts, CASE WHEN e.event_id % 2 = 0 THEN 'k10' ELSE 'k20' END AS raster_key,
             CAST(e.user_id % 20 AS INT) AS cluster_id, CASE WHEN e.event_type = 'view' THEN 'unlabeled' ELSE h.path END AS path
           FROM events e JOIN classes h ON h.n_nationkey = e.event_id % 25""",
    ),
    "edits_now": (
        ("edits",),
        """SELECT raster_key, cluster_id, path, ts, seq FROM edits
           QUALIFY ROW_NUMBER() OVER (PARTITION BY raster_key, cluster_id ORDER BY ts DESC, seq DESC) = 1""",
    ),
    "tp": (
        (),
        """SELECT 6 AS z, CAST(FLOOR(gx / 10) AS INT) AS x, CAST(FLOOR(gy / 10) AS INT) AS y, CAST(gy % 10 AS INT) AS py, CAST(gx % 10 AS INT) AS px,
             CASE WHEN fake THEN pr ELSE r END AS r, CASE WHEN fake THEN pg ELSE g END AS g, CASE WHEN fake THEN pb ELSE b END AS b
           FROM (SELECT *, (FLOOR(gx / 10) + FLOOR(gy / 10)) % 7 = 3 AS fake,
                   CAST(FLOOR(AVG(r) OVER w + 0.5) AS INT) AS pr, CAST(FLOOR(AVG(g) OVER w + 0.5) AS INT) AS pg, CAST(FLOOR(AVG(b) OVER w + 0.5) AS INT) AS pb
                 FROM (SELECT CAST(o_orderkey % 50 AS INT) AS gx, CAST(FLOOR(o_orderkey / 50) AS INT) AS gy, CAST(o_custkey % 256 AS INT) AS r,
                         CAST(o_custkey * 3 % 256 AS INT) AS g, CAST(o_custkey * 7 % 256 AS INT) AS b FROM orders)
                 WINDOW w AS (PARTITION BY FLOOR(gx / 2), FLOOR(gy / 2)))
           UNION ALL
           SELECT 5, CAST(FLOOR(gx / 10) AS INT), CAST(FLOOR(gy / 10) AS INT), CAST(gy % 10 AS INT), CAST(gx % 10 AS INT), r, g, b
           FROM (SELECT CAST(FLOOR((o_orderkey % 50) / 2) AS INT) AS gx, CAST(FLOOR(FLOOR(o_orderkey / 50) / 2) AS INT) AS gy,
                   CAST(FLOOR(AVG(o_custkey % 256) + 0.5) AS INT) AS r, CAST(FLOOR(AVG(o_custkey * 3 % 256) + 0.5) AS INT) AS g,
                   CAST(FLOOR(AVG(o_custkey * 7 % 256) + 0.5) AS INT) AS b FROM orders GROUP BY 1, 2)""",
    ),
    "inv": (("tp",), "SELECT DISTINCT z, x, y FROM tp"),
    "det": (
        (),
        """SELECT p_partkey AS k, LOWER(p_type) AS label, CASE WHEN p_size % 10 = 0 THEN 0.5 ELSE CAST(CONCAT(p_size % 10, 'e-1') AS DOUBLE) END AS confidence,
             CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 32 ELSE p_partkey % 400 * 0.064::DOUBLE END AS x1,
             CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 16 ELSE p_partkey % 500 * 0.064::DOUBLE END AS y1,
             CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 32 + 8 ELSE (p_partkey % 400 + 125) * 0.064::DOUBLE END AS x2,
             CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 16 + 4 ELSE (p_partkey % 500 + 250) * 0.064::DOUBLE END AS y2
           FROM part""",
    ),
}


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """``body`` behind the fixture tables it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in FIXTURES[name][0]:
            add(dep)
        order.append(name)

    for n in needs:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({FIXTURES[n][1]})" for n in order]
    extra = body.lstrip()
    if not parts:
        return extra
    head = "WITH RECURSIVE " if recursive else "WITH "
    if extra.upper().startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + extra[5:]
    return head + ",\n".join(parts) + "\n" + extra
