"""Registered queries: sources and sinks, projections, joins, neighbours."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import joins, spatial
from ..sources import tables
from .registry import query
from .scores import rounded


@query("A01_validate_points", "WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) END AS x, CASE WHEN o_orderkey % 70 = 0 THEN 1e13 ELSE round(o_totalprice / 1000.0) END AS y, CASE WHEN o_orderkey % 90 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1.0 END AS value FROM orders) SELECT 'x is not finite' AS reason, id AS row_id FROM p WHERE x IS NULL UNION ALL SELECT 'y is too large', id FROM p WHERE y > 1e12 UNION ALL SELECT 'value is not finite', id FROM p WHERE isnan(value) UNION ALL SELECT 'coordinates repeat', min(id) FROM p WHERE x IS NOT NULL GROUP BY x, y HAVING count(*) > 1")
def a01(v):
    o = v("orders")
    p = o.select(F.col("o_orderkey").alias("point_id"), F.when(F.col("o_orderkey") % 50 != 0, (F.col("o_custkey") % 100).cast("double")).alias("X"), F.when(F.col("o_orderkey") % 70 == 0, 1e13).otherwise(F.round(F.col("o_totalprice") / 1000.0)).alias("Y"), F.when(F.col("o_orderkey") % 90 == 0, float("nan")).otherwise(1.0).alias("Value"))
    return tables.validate_points(p)


@query("A02_required_columns", "SELECT 'k' AS \"column\", count(*) FILTER (k IS NULL) AS nulls FROM (SELECT CASE WHEN unit_id % 9 <> 0 THEN target END AS k FROM fx_features) UNION ALL SELECT 'f1', count(*) FILTER (f1 IS NULL) FROM fx_features")
def a02(v):
    return tables.require_columns(v("fx_features").withColumn("k", F.when(F.col("unit_id") % 9 != 0, F.col("target"))), ["k", "f1"])


def packs(v):
    """An annotation pack for each event type and user, clicks from their rows."""
    point = F.struct(F.col("lat_pos").alias("lateral_vox"), F.col("depth").cast("double").alias("depth_vox"))
    u = F.collect_list(F.when(F.col("depth") % 2 == 0, point))
    w = F.collect_list(F.when(F.col("depth") % 2 == 1, point))
    cases = v("fx_click").groupBy("view_name", "case_id").agg(u.alias("u_depth_points"), w.alias("v_depth_points"))
    case = F.struct(F.col("case_id").cast("string").alias("case_id"), F.lit(True).alias("reviewed"), F.lit("clear").alias("visibility"), "u_depth_points", "v_depth_points")
    return cases.select("view_name", F.to_json(F.struct(F.col("view_name").alias("annotator_id"), F.array(case).alias("annotations"))).alias("json"))


@query("A03_annotation_clicks", "SELECT view_name AS annotator_id, CAST(case_id AS VARCHAR) AS case_id, CASE WHEN depth % 2 = 0 THEN 'u' ELSE 'v' END AS view, round(lat_pos, 6) AS lateral, CAST(depth AS DOUBLE) AS depth FROM fx_click WHERE depth IS NOT NULL")
def a03(v):
    return rounded(tables.annotation_rows(packs(v))[1], "lateral")


@query("A04_manifest_problems", "WITH r AS (SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'FRANCE' ELSE n_name END AS name, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS k FROM nation), d AS (SELECT n_name AS name FROM nation WHERE n_regionkey < 4 UNION SELECT 'ATLANTIS') SELECT name AS item, 'no k' AS problem FROM r WHERE k IS NULL UNION ALL SELECT name, 'repeats' FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL (SELECT DISTINCT name, 'not declared' FROM r WHERE name NOT IN (SELECT name FROM d)) UNION ALL SELECT name, 'absent' FROM d WHERE name NOT IN (SELECT name FROM r)")
def a04(v):
    nation = v("nation")
    runs = nation.select(F.when(F.col("n_nationkey") % 7 == 3, "FRANCE").otherwise(F.col("n_name")).alias("name"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("k"))
    declared = [r[0] for r in nation.where("n_regionkey < 4").select("n_name").collect()]
    return tables.manifest_problems(runs, ["k"], "name", [*declared, "ATLANTIS"])


@query("A06_slice_inventory", "WITH f AS (SELECT l_suppkey AS a, l_partkey % 60 AS no, l_linenumber AS size FROM lineitem) SELECT 'archive_' || a AS archive, count(*) AS slices, min(no) AS \"first\", max(no) AS \"last\", (max(no) - min(no) + 1 = count(*)) AND (count(DISTINCT no) = count(*)) AS contiguous, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY a")
def a06(v):
    files = v("lineitem").select(F.concat(F.lit("archive_"), "l_suppkey", F.lit("/slice_"), F.col("l_partkey") % 60, F.lit(".tif")).alias("path"), "l_linenumber")
    return tables.slice_inventory(files, F.regexp_extract("path", r"^(archive_\d+)/", 1), F.regexp_extract("path", r"slice_(\d+)", 1).cast("long"), F.col("l_linenumber"))


@query("A07_file_fingerprint")
def a07(v):
    files = v.spark.read.format("binaryFile").load(f"{v.sf_dir}/*.parquet")
    return tables.file_fingerprints(files).withColumn("path", F.regexp_extract("path", r"[^/]+$", 0))


@query("A10_surface_sink")
def a10(v):
    return tables.surfaces(v("fx_voxel"), ["i", "j"], ["k"], "value")


@query("A11_linear_index", "SELECT count(*) AS n, bool_and(true) AS same, CAST(sum((l_partkey % 24) + 1 + (l_suppkey % 20) * 24 + (l_linenumber - 1) * 480) AS BIGINT) AS checksum FROM lineitem")
def a11(v):
    p = v("lineitem").select((F.col("l_partkey") % 24 + 1).alias("i"), (F.col("l_suppkey") % 20 + 1).alias("j"), F.col("l_linenumber").alias("k"))
    index = tables.linear_index(F.col("i"), F.col("j"), F.col("k"), 24, 20)
    i, j, k = tables.from_linear_index(index, 24, 20)
    return p.agg(F.count("*").alias("n"), F.bool_and((i == F.col("i")) & (j == F.col("j")) & (k == F.col("k"))).alias("same"), F.sum(index).alias("checksum"))


@query("A12_keyed_replace", "SELECT unit_id, group_name, true AS kept FROM fx_plan WHERE unit_id NOT IN (SELECT unit_id FROM fx_plan WHERE group_name = 'P') UNION ALL SELECT unit_id, 'redone', false FROM fx_plan WHERE group_name = 'P'")
def a12(v):
    plan = v("fx_plan")
    return tables.replace_rows(plan, plan.where("group_name = 'P'").withColumn("group_name", F.lit("redone")), ["unit_id"])


@query("A14_synthetic_field", "WITH g AS (SELECT o_orderkey AS id FROM orders), w AS (SELECT CAST(ceil(sqrt(max(id) + 1)) AS BIGINT) AS side FROM g), u AS (SELECT id, " + ", ".join(f"((('0x' || substr(md5('s:{n}:' || id), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS {n}" for n in ("x", "y", "a", "b")) + " FROM g), p AS (SELECT id, id % side + (x - 0.5) * 0.6 AS px, id // side + (y - 0.5) * 0.6 AS py, sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS n FROM u, w) SELECT id AS point_id, round(px, 6) AS x, round(py, 6) AS y, round(sin(px / 4) + cos(py / 5) + 0.1 * n, 6) AS value FROM p")
def a14(v):
    known = v("orders").select(F.col("o_orderkey").alias("point_id"))
    side = ceil(sqrt((known.agg(F.max("point_id")).first()[0] or 0) + 1))
    field = tables.synthetic_field(v.spark, side, "s")
    return rounded(field.join(known, "point_id", "left_semi"), "x", "y", "value")


@query("A15_failed_unit_ledger", "SELECT unit_id, group_name, CASE WHEN u.unit_id IS NULL THEN 'failed' ELSE 'scored' END AS status, CASE WHEN u.unit_id IS NULL THEN 'no rows' END AS reason FROM fx_plan p LEFT JOIN (SELECT DISTINCT unit_id FROM fx_unit_error) u USING (unit_id)")
def a15(v):
    return tables.ledger(v("fx_plan"), v("fx_unit_error"), "unit_id", "no rows")


@query("B01_normalise", "SELECT point_id, round(x / p, 6) AS x, round(y / p, 6) AS y FROM fx_points3, (SELECT avg(abs(z)) AS p FROM fx_points3)")
def b01(v):
    p = v("fx_points3")
    return p.crossJoin(F.broadcast(p.agg(F.avg(F.abs("z")).alias("p")))).select("point_id", F.round(F.col("x") / F.col("p"), 6).alias("x"), F.round(F.col("y") / F.col("p"), 6).alias("y"))


@query("B02_polynomial_design", "SELECT point_id, 1.0 AS one, round(x, 6) AS x, round(y, 6) AS y, round(x * x, 6) AS x_x, round(x * y, 6) AS x_y, round(y * y, 6) AS y_y FROM fx_points3")
def b02(v):
    return v("fx_points3").select("point_id", *[F.round(c, 6).alias(n) for n, c in geo.polynomial(["x", "y"], 2).items()])


CENTRES = geo.rbf_centres()


@query("B03_rbf_features", "SELECT point_id, " + ", ".join(f"round(exp(-((x - {a!r}) * (x - {a!r}) + (y - {b!r}) * (y - {b!r})) / (2 * 0.3 * 0.3)), 6) AS b{i}" for i, (a, b) in enumerate(CENTRES[:8])) + " FROM fx_points3")
def b03(v):
    return v("fx_points3").select("point_id", *[F.round(c, 6).alias(f"b{i}") for i, c in enumerate(geo.rbf(F.col("x"), F.col("y"), 0.3, CENTRES[:8]))])


@query("B04_reasoned_gate", "SELECT CASE WHEN f1 < 5 THEN 'too small' WHEN f2 > 0.08 THEN 'steep' WHEN target > 80 THEN 'far' END AS target_reason, count(*) AS n FROM fx_features GROUP BY 1")
def b04(v):
    rules = {"too small": F.col("f1") >= 5, "steep": F.col("f2") <= 0.08, "far": F.col("target") <= 80}
    return v("fx_features").groupBy(geo.first_failure(rules).alias("target_reason")).agg(F.count("*").alias("n"))


@query("B05_threshold_gate", "SELECT unit_id, count(*) AS n FROM fx_features WHERE f1 >= 25 AND f2 >= 0.02 AND CASE WHEN unit_id % 4 <> 0 THEN f3 END <= 0.05 GROUP BY 1")
def b05(v):
    rmse = F.when(F.col("unit_id") % 4 != 0, F.col("f3"))
    keep = (F.col("f1") >= 25) & (F.col("f2") >= 0.02) & F.coalesce(rmse <= 0.05, F.lit(False))
    return v("fx_features").where(keep).groupBy("unit_id").agg(F.count("*").alias("n"))


@query("B06_region_masks", "SELECT region, count(*) FILTER (x * x + y * y <= 0.0625) AS central_disk, count(*) FILTER (x > 0) AS half_plane, count(*) FILTER (x > 0 AND y > 0) AS quadrant, count(*) FILTER (abs(x - y) <= 0.2) AS diagonal_band, count(*) FILTER ((x - 0.3) * (x - 0.3) + (y - 0.3) * (y - 0.3) <= 0.09) AS offset_disk FROM fx_points3 GROUP BY 1")
def b06(v):
    return v("fx_points3").groupBy("region").agg(*[F.count_if(c).alias(n) for n, c in geo.region_masks(F.col("x"), F.col("y")).items()])


@query("B07_vector_kit", "SELECT point_id, round(x / sqrt(x * x + y * y + z * z), 6) AS ux, round(degrees(acos(x / sqrt(x * x + y * y + z * z))), 5) AS angle, round(degrees(acos(abs(x) / sqrt(x * x + y * y + z * z))), 5) AS axis_angle FROM fx_points3")
def b07(v):
    p, ex = geo.vec(), (F.lit(1.0), F.lit(0.0), F.lit(0.0))
    return v("fx_points3").select("point_id", F.round(geo.unit(p)[0], 6).alias("ux"), F.round(geo.angle(p, ex), 5).alias("angle"), F.round(geo.axis_angle(p, ex), 5).alias("axis_angle"))


UNIT = "u AS (SELECT point_id, region, x / r AS x, y / r AS y, z / r AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM fx_points3))"
FRAME = f"{UNIT}, o AS (SELECT *, CASE WHEN sqrt(1 - x * x) >= 0.15 THEN 1 - x * x ELSE -x * y END AS ax, CASE WHEN sqrt(1 - x * x) >= 0.15 THEN -x * y ELSE 1 - y * y END AS ay, CASE WHEN sqrt(1 - x * x) >= 0.15 THEN -x * z ELSE -y * z END AS az FROM u), f AS (SELECT point_id, x, y, z, ax / n AS ax, ay / n AS ay, az / n AS az FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n FROM o)), g AS (SELECT *, y * az - z * ay AS bx, z * ax - x * az AS by_, x * ay - y * ax AS bz FROM f)"


def units(v):
    x, y, z = geo.unit(geo.vec())
    return v("fx_points3").select("point_id", "region", x.alias("x"), y.alias("y"), z.alias("z"))


@query("B08_tangent_frame", f"WITH {FRAME} SELECT point_id, round(ax, 5) AS ax, round(ay, 5) AS ay, round(az, 5) AS az, round(bx, 5) AS bx, round(by_, 5) AS by_, round(bz, 5) AS bz FROM g")
def b08(v):
    a, b = geo.tangent_frame(geo.vec())
    return units(v).select("point_id", *[F.round(c, 5).alias(n) for n, c in zip(("ax", "ay", "az", "bx", "by_", "bz"), (*a, *b), strict=True)])


@query("B09_to_local_frame", f"WITH {FRAME} SELECT point_id, round(0.5 * ax + 0.25 * ay - 0.5 * az, 5) AS u, round(0.5 * bx + 0.25 * by_ - 0.5 * bz, 5) AS v, round(0.5 * x + 0.25 * y - 0.5 * z, 5) AS w FROM g")
def b09(v):
    n = geo.vec()
    a, b = geo.tangent_frame(n)
    local = geo.to_local((F.lit(1.5), F.lit(1.25), F.lit(0.5)), (F.lit(1.0),) * 3, (a, b, n))
    return units(v).select("point_id", *[F.round(c, 5).alias(k) for k, c in zip("uvw", local, strict=True)])


@query("B10_spherical_chart", "WITH s AS (SELECT point_id, acos(z / sqrt(x * x + y * y + z * z)) AS theta, atan2(y, x) AS phi FROM fx_points3), m AS (SELECT median(theta) AS m FROM s) SELECT point_id, round(phi * sin(m), 6) AS u, round(theta, 6) AS v FROM s, m")
def b10(v):
    _, theta, phi = geo.spherical(geo.vec())
    s = v("fx_points3").select("point_id", theta.alias("theta"), phi.alias("phi"))
    return s.crossJoin(F.broadcast(s.agg(F.median("theta").alias("m")))).select("point_id", F.round(F.col("phi") * F.sin("m"), 6).alias("u"), F.round("theta", 6).alias("v"))


@query("B11_gnomonic", f"WITH {UNIT} SELECT point_id, z > 0 AS valid, round(CASE WHEN z > 0 THEN x / z END, 4) AS u, round(CASE WHEN z > 0 THEN y / z END, 4) AS v FROM u WHERE abs(z) > 0.02")
def b11(v):
    ex, ey, ez = [tuple(F.lit(float(i == j)) for j in range(3)) for i in range(3)]
    a, b = geo.gnomonic(geo.vec(), ez, ex, ey)
    return units(v).where("abs(z) > 0.02").select("point_id", (F.col("z") > 0).alias("valid"), F.round(a, 4).alias("u"), F.round(b, 4).alias("v"))


@query("B12_solid_angle", f"WITH {UNIT} SELECT point_id, round(2 * atan2(abs(z), 1 + x + y), 5) AS area FROM u")
def b12(v):
    ex, ey = [tuple(F.lit(float(i == j)) for j in range(3)) for i in range(2)]
    return units(v).select("point_id", F.round(geo.solid_angle(geo.vec(), ex, ey), 5).alias("area"))


@query("B13_intensity_rescale", "WITH q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM fx_voxel WHERE k % 2 = 1) SELECT k, CAST(sum(CAST(round_even(greatest(0.0, least(255.0, (value - lo) * 255.0 / (hi - lo))), 0) AS BIGINT)) AS BIGINT) AS total FROM fx_voxel, q GROUP BY 1")
def b13(v):
    c = v("fx_voxel")
    ends = c.where("k % 2 = 1").agg(F.percentile("value", F.lit(0.02)).alias("lo"), F.percentile("value", F.lit(0.98)).alias("hi"))
    return c.crossJoin(F.broadcast(ends)).groupBy("k").agg(F.sum(geo.rescale_uint8(F.col("value"), F.col("lo"), F.col("hi"))).cast("long").alias("total"))


@query("B15_affine", "SELECT point_id, round(0.1 + (x - 0.1) * 1.2 + (y - 0.2) * 0.1, 6) AS x, round(0.2 + (y - 0.2) * 0.8, 6) AS y, round(0.3 + (x - 0.1) * 0.05 + (z - 0.3), 6) AS z FROM fx_points3")
def b15(v):
    out = geo.affine(geo.vec(), tuple(map(F.lit, (0.1, 0.2, 0.3))), [[1.2, 0.1, 0], [0, 0.8, 0], [0.05, 0, 1]])
    return v("fx_points3").select("point_id", *[F.round(c, 6).alias(n) for n, c in zip("xyz", out, strict=True)])


@query("B16_quadrants", "WITH m AS (SELECT median(x) AS cu, median(y) AS cv FROM fx_points2) SELECT point_id, CAST(x >= cu AS INT) + 2 * CAST(y >= cv AS INT) AS block, round(sqrt(pow(greatest(cu - x, 0), 2) + pow(greatest(cv - y, 0), 2)), 6) AS to_block_3 FROM fx_points2, m")
def b16(v):
    p = v("fx_points2")
    p = p.crossJoin(F.broadcast(p.agg(F.median("x").alias("cu"), F.median("y").alias("cv"))))
    x, y, cu, cv = (F.col(c) for c in ("x", "y", "cu", "cv"))
    return p.select("point_id", geo.quadrant(x, y, cu, cv).alias("block"), F.round(geo.quadrant_distance(x, y, cu, cv, F.lit(3)), 6).alias("to_block_3"))


@query("B17_bands", "SELECT CAST(target >= 20 AS INT) + CAST(target >= 40 AS INT) + CAST(target >= 60 AS INT) AS band, count(*) AS n FROM fx_features GROUP BY 1")
def b17(v):
    return v("fx_features").groupBy(geo.band(F.col("target"), [20, 40, 60]).alias("band")).agg(F.count("*").alias("n"))


@query("B18_canonical_grid", "WITH g AS (SELECT a.i AS gi, b.i AS gj FROM range(-5, 6) a(i), range(-5, 6) b(i)) SELECT region, gi, gj, round(gi * 0.13, 6) AS u, round(gj * 0.13, 6) AS v FROM g, (SELECT DISTINCT region FROM fx_points3) WHERE gi * gi * 0.0169 + gj * gj * 0.0169 <= 0.65 * 0.65 + 1e-12")
def b18(v):
    grid = geo.canonical_grid(v.spark, 0.65, 0.13)
    return rounded(v("fx_points3").select("region").distinct().crossJoin(F.broadcast(grid)), "u", "v")


@query("B19_neighbour_list", "SELECT l_orderkey, max(l_linenumber) AS degree, CAST(sum(l_linenumber) AS BIGINT) AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1 HAVING max(l_linenumber) = count(*)")
def b19(v):
    lists = v("lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.col("l_linenumber").cast("string")), " "), F.lit("]")).alias("text"))
    got = lists.select("l_orderkey", geo.neighbour_list(F.col("text")).alias("n"))
    return got.where(F.size("n") == F.array_max("n")).select("l_orderkey", F.size("n").alias("degree"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("B20_angular_bounds", "SELECT k, b AS bound, greatest(0.0, k * 25.0 - 2 * b) AS low, least(180.0, k * 25.0 + 2 * b) AS high FROM (SELECT DISTINCT k FROM fx_voxel), range(0, 21) t(b)")
def b20(v):
    return v("fx_voxel").select("k").distinct().select("k", F.inline(geo.angular_bounds(F.col("k") * 25.0)))


@query("B21_surface_normal", "SELECT point_id, round(1 / sqrt(1 + y * y + z * z), 6) AS nx, round(-y / sqrt(1 + y * y + z * z), 6) AS ny, round(-z / sqrt(1 + y * y + z * z), 6) AS nz, round(sqrt(y * y + z * z), 6) AS slope FROM fx_points3")
def b21(v):
    n, slope = geo.surface_normal(F.col("y"), F.col("z"))
    return v("fx_points3").select("point_id", *[F.round(c, 6).alias(k) for k, c in zip(("nx", "ny", "nz"), n, strict=True)], F.round(slope, 6).alias("slope"))


SIZES = "s AS (SELECT region, label, count(*) AS n FROM fx_label GROUP BY 1, 2), o AS (SELECT a.region AS region_a, a.label AS label_a, b.region AS region_b, b.label AS label_b, count(*) AS overlap FROM fx_label a JOIN fx_label b ON a.lin = b.lin AND a.region < b.region GROUP BY 1, 2, 3, 4), m AS (SELECT o.*, x.n AS n_a, y.n AS n_b FROM o JOIN s x ON x.region = region_a AND x.label = label_a JOIN s y ON y.region = region_b AND y.label = label_b)"


@query("B22_overlap_measures", f"WITH {SIZES} SELECT region_a, label_a, region_b, label_b, round(overlap / (n_a + n_b - overlap), 6) AS iou, round(overlap / least(n_a, n_b), 6) AS of_smaller, overlap / least(n_a, n_b) >= 0.5 AS duplicate FROM m")
def b22(v):
    pairs = joins.label_overlap(v("fx_label"), "region", "label", "lin")
    m = geo.overlap_measures(F.col("overlap"), F.col("n_a"), F.col("n_b"))
    return rounded(pairs.select("region_a", "label_a", "region_b", "label_b", *[c.alias(n) for n, c in m.items()]), "iou", "of_smaller")


@query("C01_validated_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) ON l_orderkey = o_orderkey")
def c01(v):
    right = v("orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return joins.validated_join(v("lineitem").select("l_orderkey", "l_linenumber"), right, ["l_orderkey"])


def knn_sql(k, ids="q.point_id <> p.point_id", by="AND q.region = p.region", d="pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2)", table="fx_points3", key="q.region, q.point_id"):
    return f"n AS (SELECT {key.replace('q.point_id', 'q.point_id AS query_id')}, p.point_id AS neighbour_id, sqrt({d}) AS distance, row_number() OVER (PARTITION BY {key} ORDER BY sqrt({d}), p.point_id) AS rank FROM {table} q JOIN {table} p ON {ids} {by} QUALIFY rank <= {k})"


@query("C02_knn_join", f"WITH {knn_sql(4)} SELECT region, query_id, neighbour_id, round(distance, 6) AS distance, rank FROM n")
def c02(v):
    p = v("fx_points3")
    return rounded(spatial.knn_join(p, p, 4, ["x", "y", "z"], "point_id", "point_id", ("region",), exclude_self=True), "distance")


@query("C03_nearest_assign", "WITH l AS (SELECT point_id AS id, x, y FROM fx_points2 WHERE point_id % 100 = 0) SELECT p.point_id AS query_id, arg_min(l.id, sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2))) AS neighbour_id, round(min(sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2))), 6) AS distance FROM fx_points2 p, l GROUP BY 1")
def c03(v):
    p = v("fx_points2")
    return rounded(spatial.nearest(p, p.where("point_id % 100 = 0"), ["x", "y"], "point_id", "point_id"), "distance")


@query("C04_range_join", "SELECT q.point_id AS query_id, p.point_id AS neighbour_id, round(sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)), 6) AS distance FROM fx_points2 q JOIN fx_points2 p ON q.point_id <> p.point_id AND sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) < 2.0")
def c04(v):
    p = v("fx_points2")
    return rounded(spatial.range_join(p, p, 2.0, ["x", "y"], "point_id", "point_id", exclude_self=True), "distance")


@query("C05_nearest_in_group", "WITH c AS (SELECT case_id, depth, lat_pos, row_number() OVER (ORDER BY case_id, view_name, lat_pos, depth) AS click FROM fx_click), t AS (SELECT track_id AS case_id, r, c FROM fx_track), g AS (SELECT case_id, lat_pos, depth, r, abs(lat_pos - r) AS gap FROM (SELECT DISTINCT case_id, lat_pos, depth FROM c) LEFT JOIN t USING (case_id)) SELECT case_id, lat_pos, depth, round(min(gap), 6) AS gap FROM g GROUP BY 1, 2, 3")
def c05(v):
    clicks = v("fx_click").select("case_id", "lat_pos", "depth").distinct().withColumn("click", F.struct("lat_pos", "depth"))
    samples = v("fx_track").select(F.col("track_id").alias("case_id"), "r", F.col("depth").alias("seq"))
    out = spatial.nearest_in_group(clicks, samples, ["case_id"], F.abs(F.col("lat_pos") - F.col("r")), ["seq"], ["r"], "click")
    return out.select("case_id", "click.lat_pos", "click.depth", F.round("gap", 6).alias("gap"))


@query("C06_label_overlap", f"WITH {SIZES} SELECT * FROM m")
def c06(v):
    return joins.label_overlap(v("fx_label"), "region", "label", "lin")


@query("C09_holdout_cohort", "SELECT unit_id, group_name FROM fx_plan WHERE unit_id NOT IN (SELECT unit_id FROM fx_unit_error WHERE method = 'R')")
def c09(v):
    return v("fx_plan").join(v("fx_unit_error").where("method = 'R'"), "unit_id", "left_anti")


@query("C10_denominators", "WITH u AS (SELECT unit_id, avg(error) AS e FROM fx_unit_error GROUP BY 1) SELECT group_name, count(*) AS candidates, count(e) AS scored, round(avg(e), 6) AS mean_error FROM fx_plan LEFT JOIN u USING (unit_id) GROUP BY 1")
def c10(v):
    return rounded(joins.denominators(v("fx_plan"), v("fx_unit_error"), "unit_id", ["group_name"], "error"), "mean_error")


@query("C11_pairs_within_groups", f"WITH {UNIT} SELECT a.region, count(*) AS pairs, round(max(degrees(acos(greatest(-1.0, least(1.0, a.x * b.x + a.y * b.y + a.z * b.z))))), 4) AS span FROM u a JOIN u b ON a.region = b.region AND a.point_id < b.point_id GROUP BY 1")
def c11(v):
    a, b = (tuple(F.col(f"{s}.{c}") for c in "xyz") for s in "lr")
    pairs = spatial.pairs_within(units(v), ["region"], "point_id", F.degrees(F.acos(geo.clipped(geo.dot(a, b)))))
    return pairs.groupBy("region").agg(F.count("*").alias("pairs"), F.round(F.max("measure"), 4).alias("span"))


@query("C12_two_way_distance", "WITH a AS (SELECT * FROM fx_points3 WHERE point_id % 2 = 0), b AS (SELECT * FROM fx_points3 WHERE point_id % 2 = 1), d AS (SELECT a.point_id AS a, b.point_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM a, b), x AS (SELECT 'a_to_b' AS direction, min(d) AS d FROM d GROUP BY a UNION ALL SELECT 'b_to_a', min(d) FROM d GROUP BY b) SELECT direction, round(max(d), 6) AS largest, round(median(d), 6) AS median FROM x GROUP BY 1")
def c12(v):
    p = v("fx_points3")
    return rounded(spatial.two_way_distance(p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), ["x", "y", "z"], "point_id", "point_id"), "largest", "median")


@query("C14_separated_triples", "WITH p AS (SELECT region, point_id, x, y, z, sqrt(pow(x - avg(x) OVER w, 2) + pow(y - avg(y) OVER w, 2) + pow(z - avg(z) OVER w, 2)) AS away FROM fx_points3 WINDOW w AS (PARTITION BY region)), e AS (SELECT a.region, a.point_id AS a, b.point_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM p a JOIN p b ON a.region = b.region AND a.point_id < b.point_id), t AS (SELECT e.region, e.a, e.b, f.b AS c, least(e.d, f.d, g.d) - 0.05 * (x.away + y.away + z.away) / 3 AS score FROM e JOIN e f ON f.a = e.b JOIN e g ON g.a = e.a AND g.b = f.b JOIN p x ON x.point_id = e.a JOIN p y ON y.point_id = e.b JOIN p z ON z.point_id = f.b) SELECT region, a, b, c, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY region ORDER BY score DESC, a, b, c) = 1")
def c14(v):
    return rounded(joins.best_triples(v("fx_points3"), ["region"], "point_id", ["x", "y", "z"]), "score")


@query("C15_midpoint_controls", f"WITH {knn_sql(1)}, e AS (SELECT DISTINCT least(query_id, neighbour_id) AS a, greatest(query_id, neighbour_id) AS b FROM n) SELECT a, b, round((p.x + q.x) / 2, 6) AS x, round((p.y + q.y) / 2, 6) AS y FROM e JOIN fx_points3 p ON p.point_id = a JOIN fx_points3 q ON q.point_id = b")
def c15(v):
    p = v("fx_points3")
    near = spatial.nearest_other(p, ["x", "y", "z"], "point_id", ("region",))
    at = lambda n: p.select(F.col("point_id").alias(n), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}"))
    both = near.join(at("a"), "a").join(at("b"), "b")
    return both.select("a", "b", *[F.round((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2, 6).alias(c) for c in "xy"])


@query("C16_parameter_join", "WITH m AS (SELECT block_id, median(error) AS width FROM fx_unit_error GROUP BY 1) SELECT method, count(*) FILTER (error <= width) AS inside FROM fx_unit_error JOIN m USING (block_id) GROUP BY 1")
def c16(v):
    e = v("fx_unit_error")
    rows = joins.attach_parameters(e, e.groupBy("block_id").agg(F.median("error").alias("width")), ["block_id"])
    return rows.groupBy("method").agg(F.count_if(F.col("error") <= F.col("width")).alias("inside"))


@query("D29_lattice", f"WITH {knn_sql(6)}, t AS (SELECT n.region, distance, atan2(b.y - a.y, b.x - a.x) AS t FROM n JOIN fx_points3 a ON a.point_id = query_id JOIN fx_points3 b ON b.point_id = neighbour_id) SELECT region, round(median(distance), 6) AS spacing, round(atan2(avg(sin(6 * t)), avg(cos(6 * t))) / 6, 5) AS angle FROM t GROUP BY 1")
def d29(v):
    out = spatial.lattice(v("fx_points3"), ["x", "y", "z"], "point_id", ("region",))
    return out.select("region", F.round("spacing", 6).alias("spacing"), F.round("angle", 5).alias("angle"))


K2 = dict(by="", d="pow(q.x - p.x, 2) + pow(q.y - p.y, 2)", table="fx_points2", key="q.point_id")
P2 = "s AS (SELECT * FROM fx_points3)"


@query("D30_neighbourhood_features", f"WITH {P2}, {knn_sql(6, **{**K2, 'table': 's'})}, o AS (SELECT query_id, distance, b.x - a.x AS dx, b.y - a.y AS dy FROM n JOIN s a ON a.point_id = query_id JOIN s b ON b.point_id = neighbour_id), f AS (SELECT query_id, avg(distance) AS mean, stddev_pop(distance) / avg(distance) AS cv, max(distance) - min(distance) AS range, covar_pop(dx, dx) AS xx, covar_pop(dx, dy) AS xy, covar_pop(dy, dy) AS yy FROM o GROUP BY 1) SELECT query_id, round(mean, 6) AS mean, round(cv, 6) AS cv, round(range, 6) AS range, round(sqrt(greatest((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 0) / ((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy))), 4) AS anisotropy FROM f")
def d30(v):
    out = spatial.neighbourhood_features(v("fx_points3"), ["x", "y"], "point_id")
    return rounded(out, "mean", "cv", "range").withColumn("anisotropy", F.round("anisotropy", 4))


EDGES = f"{knn_sql(6, by='', key='q.point_id')}, pitch AS (SELECT query_id, median(distance) AS pitch FROM n GROUP BY 1), e AS (SELECT DISTINCT least(query_id, neighbour_id) AS a, greatest(query_id, neighbour_id) AS b, distance FROM n), g AS (SELECT a, b, distance AS length FROM e JOIN pitch p ON p.query_id = a JOIN pitch q ON q.query_id = b WHERE distance <= 1.6 * (p.pitch + q.pitch) / 2)"


@query("H01_knn_graph", f"WITH {EDGES} SELECT a, b, round(length, 6) AS length FROM g")
def h01(v):
    return rounded(spatial.knn_graph(v("fx_points3"), ["x", "y", "z"], "point_id"), "length")
