"""Registered queries: graphs, meshes, voxel tables and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import graph, joins, spatial, volume
from ..operators import windows as win
from .places import EDGES, SIZES, knn_sql
from .registry import query
from .scores import rounded, smooth_sql


def edges(v):
    return spatial.knn_graph(v("fx_points3"), ["x", "y", "z"], "point_id")


HOPS = f"{EDGES}, w AS (SELECT a AS u, b AS v FROM g UNION ALL SELECT b, a FROM g), r AS (SELECT point_id AS source, point_id AS node, 0 AS hop FROM fx_points3 WHERE point_id % 100 = 0 UNION SELECT source, v, hop + 1 FROM r JOIN w ON u = node WHERE hop < 4), hops AS (SELECT source, node, min(hop) AS hop FROM r GROUP BY 1, 2)"


def sources(v):
    return v("fx_points3").where("point_id % 100 = 0").select(F.col("point_id").alias("source"), F.col("point_id").alias("node"))


@query("H02_bfs_hops", f"WITH RECURSIVE {HOPS} SELECT source, node, hop FROM hops")
def h02(v):
    return graph.bfs(edges(v), sources(v), 4)


@query("D23_ring_summary", f"WITH RECURSIVE {HOPS} SELECT hop, count(*) AS n, round(avg(abs(value)), 6) AS mean_error FROM hops JOIN fx_points3 ON point_id = node GROUP BY 1")
def d23(v):
    rings = graph.bfs(edges(v), sources(v), 4).join(v("fx_points3").select(F.col("point_id").alias("node"), "value"), "node")
    return rings.groupBy("hop").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("value")), 6).alias("mean_error"))


@query("H06_nested_masks", f"WITH RECURSIVE {HOPS} SELECT source, radius, count(*) AS nodes FROM hops, (VALUES (1), (2), (3)) t(radius) WHERE hop <= radius GROUP BY 1, 2")
def h06(v):
    hops = graph.bfs(edges(v), sources(v), 3)
    return hops.select("source", "hop", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("radius")).where("hop <= radius").groupBy("source", "radius").agg(F.count("*").alias("nodes"))


@query("H03_shortest_paths")
def h03(v):
    return graph.shortest_paths(edges(v), sources(v), "length", 1.0)


@query("H03_nearest_visible")
def h03b(v):
    block = F.col("region") % 5 == 0  # a hidden part
    p = v("fx_points3").select(F.col("point_id").alias("node"), "region")
    return graph.nearest_visible(edges(v), p.where(~block), "length", 4, p.where(block))


@query("H04_boundary_nodes", f"WITH {EDGES}, w AS (SELECT a AS u, b AS v FROM g UNION ALL SELECT b, a FROM g), t AS (SELECT u, atan2(q.y - p.y, q.x - p.x) AS t FROM w JOIN fx_points3 p ON p.point_id = u JOIN fx_points3 q ON q.point_id = v), l AS (SELECT u, coalesce(lead(t) OVER (PARTITION BY u ORDER BY t), min(t) OVER (PARTITION BY u) + 2 * pi()) - t AS gap FROM t), m AS (SELECT u AS node, count(*) AS neighbours, max(gap) AS g FROM l GROUP BY 1) SELECT node, neighbours, round(degrees(g), 4) AS gap FROM m WHERE neighbours < 3 OR degrees(g) > 125")
def h04(v):
    at = lambda n: v("fx_points3").select(F.col("point_id").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}"))
    w = graph.both_ways(edges(v)).join(at("u"), "u").join(at("v"), "v").withColumn("t", F.atan2(F.col("y_v") - F.col("y_u"), F.col("x_v") - F.col("x_u")))
    out = win.angular_gap(w, ["u"], "t").withColumn("gap", F.degrees("max_gap"))
    return out.where("neighbours < 3 OR gap > 125").select(F.col("u").alias("node"), "neighbours", F.round("gap", 4).alias("gap"))


@query("H05_separated_seeds")
def h05(v):
    boundary = v("fx_points3").where("point_id % 100 = 7").select(F.col("point_id").alias("node"))
    return graph.separated_seeds(edges(v), boundary, 3, 2, 2)


@query("H07_connected_components")
def h07(v):
    return graph.connected_components(edges(v).where("length < 0.6"))


@query("H07_component_sizes")
def h07b(v):
    return graph.connected_components(v("fx_face").select("a", "b")).groupBy("root").agg(F.count("*").alias("nodes"))


@query("H08_harmonic")
def h08(v):
    known = v("fx_points3").where("point_id % 2 = 0").select(F.col("point_id").alias("node"), "value")
    weight = F.coalesce(F.try_divide(F.lit(1.0), F.col("length") * F.col("length")), F.lit(float("inf")))  # points at one place
    return graph.harmonic(edges(v), known, weight)


@query("H09_interior_nodes", f"WITH {EDGES}, w AS (SELECT a AS u, b AS v FROM g UNION ALL SELECT b, a FROM g), d AS (SELECT u, count(DISTINCT v) AS d FROM w GROUP BY 1) SELECT w.u AS node FROM w JOIN d x ON x.u = w.u JOIN d y ON y.u = w.v GROUP BY 1 HAVING min(x.d) >= 6 AND bool_and(y.d >= 6)")
def h09(v):
    return graph.interior(edges(v))


@query("H10_grown_patches")
def h10(v):
    starts = v("fx_points3").where("point_id % 50 = 0").select(F.col("point_id").alias("attempt"), F.col("point_id").alias("node"))
    return graph.grown_patches(edges(v), starts, 5, "s")


P2 = "s AS (SELECT * FROM fx_points2)"


@query("H11_radius_clusters", f"WITH RECURSIVE {P2}, e AS (SELECT p.point_id AS a, q.point_id AS b FROM s p JOIN s q ON p.point_id <> q.point_id AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) < 1.25), r AS (SELECT point_id AS node, point_id AS root FROM s UNION SELECT e.b, root FROM r JOIN e ON e.a = node WHERE root < e.b) SELECT node AS point_id, min(root) AS cluster FROM r GROUP BY 1")
def h11(v):
    s = v("fx_points2")
    return graph.radius_clusters(spatial.range_join(s, s, 1.25, ["x", "y"], "point_id", "point_id", exclude_self=True), s, "point_id")


DIRECTED = "d AS (SELECT a AS s, b AS t FROM fx_face UNION ALL SELECT b, c FROM fx_face UNION ALL SELECT c, a FROM fx_face), e AS (SELECT least(s, t) AS lo, greatest(s, t) AS hi, count(*) AS faces, sum(CASE WHEN s < t THEN 1 ELSE -1 END) AS turn FROM d GROUP BY 1, 2)"


@query("H14_mesh_audit", f"WITH {DIRECTED} SELECT count(*) AS edges, count(*) FILTER (faces = 1) AS boundary, count(*) FILTER (faces > 2) AS non_manifold, count(*) FILTER (faces = 2 AND turn <> 0) AS inconsistent FROM e")
def h14(v):
    return graph.mesh_audit(v("fx_face"))


@query("H14_edge_incidence", f"WITH {DIRECTED} SELECT lo, hi, faces, CAST(turn AS BIGINT) AS turn FROM e")
def h14b(v):
    return graph.edge_incidence(v("fx_face"))


@query("B14_plane_section", "WITH p AS (SELECT n AS id, sin(n * 0.7) AS y, n * 0.01 AS x FROM range(0, 211) t(n)), d AS (SELECT a, b, c, a AS s, b AS t FROM fx_face UNION ALL SELECT a, b, c, b, c FROM fx_face UNION ALL SELECT a, b, c, c, a FROM fx_face), h AS (SELECT a, b, c, p.x + (q.x - p.x) * p.y / (p.y - q.y) AS x FROM d JOIN p ON p.id = s JOIN p q ON q.id = t WHERE p.y * q.y < 0) SELECT a, b, c, round(min(x), 6) AS x0, round(max(x), 6) AS x1 FROM h GROUP BY 1, 2, 3 HAVING count(*) = 2")
def b14(v):
    at = lambda n: v.spark.range(211).select(F.col("id").alias(n), F.sin(F.col("id") * 0.7).alias(f"y_{n}"), (F.col("id") * 0.01).alias(f"x_{n}"))
    sides = F.explode(F.array(*[F.struct(F.col(p).alias("s"), F.col(q).alias("t")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    e = v("fx_face").select("a", "b", "c", sides.alias("e")).select("a", "b", "c", "e.*").join(at("s"), "s").join(at("t"), "t").where("y_s * y_t < 0")
    x = F.col("x_s") + (F.col("x_t") - F.col("x_s")) * F.col("y_s") / (F.col("y_s") - F.col("y_t"))
    return e.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.round(F.min(x), 6).alias("x0"), F.round(F.max(x), 6).alias("x1")).where("n = 2").drop("n")


@query("H17_grid_components")
def h17(v):
    lin = F.col("lin")
    voxels = v("fx_label").select("region", "label", F.floor(lin / 1000).alias("i"), F.floor(lin % 1000 / 10).alias("j"), (lin % 10).alias("k"))
    return graph.grid_components(voxels, ["region", "label"])


@query("H20_duplicate_objects", f"WITH {SIZES}, d AS (SELECT region_a AS region, label_a AS label FROM m WHERE overlap / least(n_a, n_b) >= 0.4 UNION SELECT region_b, label_b FROM m WHERE overlap / least(n_a, n_b) >= 0.4) SELECT s.region, s.label, d.region IS NOT NULL AS duplicate FROM s LEFT JOIN d USING (region, label)")
def h20(v):
    pairs = joins.label_overlap(v("fx_label"), "region", "label", "lin")
    bad = pairs.where(geo.overlap_measures(F.col("overlap"), F.col("n_a"), F.col("n_b"), 0.4)["duplicate"])
    twice = bad.select(F.col("region_a").alias("region"), F.col("label_a").alias("label")).union(bad.select("region_b", "label_b")).distinct().withColumn("hf", F.lit(True))
    return v("fx_label").select("region", "label").distinct().join(twice, ["region", "label"], "left").select("region", "label", F.col("hf").isNotNull().alias("duplicate"))


@query("K01_height_map", "WITH n AS (SELECT *, lead(value) OVER (PARTITION BY i, j ORDER BY k) AS nx FROM fx_voxel), h AS (SELECT i, j, t AS threshold, max(k) AS k FROM n, (VALUES (23.0), (25.0), (28.0)) x(t) WHERE value >= t GROUP BY 1, 2, 3) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS columns, round(avg(h.k + CASE WHEN value > nx THEN (value - threshold) / (value - nx) ELSE 0 END), 6) AS height FROM h JOIN n ON n.i = h.i AND n.j = h.j AND n.k = h.k GROUP BY 1")
def k01(v):
    out = volume.height_map(v("fx_voxel"), ["i", "j"], "k", "value", [23.0, 25.0, 28.0])
    return out.groupBy("threshold").agg(F.count("*").alias("columns"), F.round(F.avg("surface"), 6).alias("height"))


def masked(v):
    key = (F.col("i") * 1000 + F.col("j") * 10 + F.col("k")).alias("id")
    return v("fx_voxel").select(key, "i", "j", "k", F.when((F.col("i") * 7 + F.col("j") * 3) % 5 != 0, F.col("value")).alias("value"))


@query("K02_fill_missing", "WITH c AS (SELECT i * 1000 + j * 10 + k AS id, i, j, k, CASE WHEN (i * 7 + j * 3) % 5 <> 0 THEN value END AS value FROM fx_voxel), n AS (SELECT a.id, b.value FROM c a, c b WHERE a.value IS NULL AND b.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.i - b.i, 2) + pow(a.j - b.j, 2) + pow(a.k - b.k, 2)), b.id) = 1) SELECT c.id, c.i, c.j, c.k, round(coalesce(c.value, n.value), 6) AS value FROM c LEFT JOIN n USING (id)")
def k02(v):
    return rounded(volume.fill_missing(masked(v), "id", ["i", "j", "k"], "value"), "value")


@query("K03_relief", f"WITH {smooth_sql(1.5)} SELECT f.i, f.j, f.k, round(f.value - smooth, 6) AS relief FROM fx_voxel f JOIN s USING (i, j, k)")
def k03(v):
    return rounded(volume.relief(v("fx_voxel"), ["j", "k"], "i", "value", 1.5), "relief").select("i", "j", "k", "relief")


CELLS = "c AS (SELECT i * 1000 + j * 10 + k AS id, i, j, k, value FROM fx_voxel)"


@query("K07_interior_gate", f"WITH {CELLS} SELECT id FROM c a WHERE value >= 20 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.value < 20 AND sqrt(pow(a.i - b.i, 2) + pow(a.j - b.j, 2) + pow(a.k - b.k, 2)) <= 2)")
def k07(v):
    c = v("fx_voxel").withColumn("id", F.col("i") * 1000 + F.col("j") * 10 + F.col("k"))
    return volume.interior_gate(c.where("value >= 20"), c.where("value < 20"), "id", ["i", "j", "k"], 2.0).select("id")


@query("K07_erosion", "WITH a AS (SELECT i, j, k FROM fx_voxel WHERE value >= 22), d(x, y, z) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) SELECT a.i, a.j, a.k FROM a, d JOIN a b ON b.i = a.i + x AND b.j = a.j + y AND b.k = a.k + z GROUP BY 1, 2, 3 HAVING count(*) = 6")
def k07b(v):
    return volume.eroded(v("fx_voxel").where("value >= 22"), ["i", "j", "k"], 1)


@query("K08_mask_surfaces", "SELECT i, j, min(k) AS \"inner\", max(k) AS \"outer\", count(*) AS n, max(k) - min(k) + 1 = count(*) AS continuous FROM fx_voxel WHERE value >= 24 GROUP BY 1, 2")
def k08(v):
    return volume.mask_surfaces(v("fx_voxel").where("value >= 24"), ["i", "j"], "k")


@query("K11_patches", "WITH u AS (SELECT point_id, CAST(point_id % 24 AS BIGINT) AS ci, CAST(point_id % 20 AS BIGINT) AS cj FROM fx_points3) SELECT point_id, count(*) AS cells, count(*) FILTER (pow(i - ci, 2) + pow(j - cj, 2) <= 4) AS disk_cells, round(avg(value), 6) AS mean FROM u JOIN fx_voxel ON i BETWEEN ci - 2 AND ci + 2 AND j BETWEEN cj - 2 AND cj + 2 GROUP BY 1")
def k11(v):
    u = v("fx_points3").select("point_id", (F.col("point_id") % 24).alias("ci"), (F.col("point_id") % 20).alias("cj"))
    out = volume.patches(u, v("fx_voxel"), "point_id", ("ci", "cj"), ("i", "j"), 2)
    return out.groupBy("point_id").agg(F.count("*").alias("cells"), F.count_if("disk").alias("disk_cells"), F.round(F.avg("value"), 6).alias("mean"))


@query("K13_label_clouds", "SELECT region, label, count(*) AS n, round(avg(lin // 1000), 6) AS ci, round(avg((lin % 1000) // 10), 6) AS cj, round(avg(lin % 10), 6) AS ck FROM fx_label GROUP BY 1, 2")
def k13(v):
    lin = F.col("lin")
    return v("fx_label").groupBy("region", "label").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(n) for n, c in (("ci", F.floor(lin / 1000)), ("cj", F.floor(lin % 1000 / 10)), ("ck", lin % 10))])


@query("K15_painted_labels", "WITH p AS (SELECT track_id, depth, CAST(round_even(r, 0) AS BIGINT) AS ci, CAST(c AS BIGINT) AS cj FROM fx_track), d AS (SELECT track_id, depth, ci + a AS i, cj + b AS j FROM p, range(-2, 3) x(a), range(-2, 3) y(b) WHERE a * a + b * b <= 4) SELECT depth, i, j, max(track_id) AS label FROM d GROUP BY 1, 2, 3")
def k15(v):
    return volume.painted(v("fx_track"), "track_id", "depth", ("r", "c"), F.col("track_id"), 2)


@query("C13_trilinear")
def c13(v):
    q = v("fx_points3").select("point_id", (F.pmod(F.col("x") * 7, F.lit(22.0))).alias("a"), (F.pmod(F.col("y") * 5, F.lit(18.0))).alias("b"), (1 + F.pmod(F.col("z") * 3, F.lit(5.0))).alias("c"))
    return volume.gather(q, v("fx_voxel"), "point_id", ["a", "b", "c"], ["i", "j", "k"], "value")


@query("E06_local_maxima")
def e06(v):
    c = v("fx_voxel").withColumn("id", F.col("i") * 1000 + F.col("j") * 10 + F.col("k"))
    return volume.local_maxima(c, "id", ["i", "j", "k"], "value", 1.5, 25.0, 4.0)


@query("E07_path_resample")
def e07(v):
    nodes = v("fx_track").select("track_id", (F.col("depth") * 3).alias("d"), "r", "c")
    return volume.resample_path(nodes, "track_id", "d", ["r", "c"])


@query("E14_support_decay", f"WITH {knn_sql(1, ids='q.point_id % 2 = 0 AND p.point_id % 2 = 1', by='', key='q.point_id')} SELECT query_id, round(exp(-0.5 * pow(distance / 0.4, 2)), 6) AS weight FROM n")
def e14(v):
    p = v("fx_points3")
    near = spatial.nearest(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), ["x", "y", "z"], "point_id", "point_id")
    return near.select("query_id", F.round(F.exp(-0.5 * F.pow(F.col("distance") / 0.4, 2)), 6).alias("weight"))
