"""Registered queries: matching, holes, local surfaces and aligned volumes. SQL can't express these: tests hold
them against hand-made cases and invariants."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import holes, matching, predict, spatial, surfaces
from ..sources import tables
from ..storage import shared_dir
from .registry import query


def folder(v) -> str:
    from uuid import uuid4

    return f"{shared_dir(v.spark)}/sink-{uuid4().hex}"


@query("A05_voxel_table", "SELECT k // 4 AS slab, count(*) AS n, round(sum(value), 5) AS total FROM fx_voxel GROUP BY 1")
def a05(v):
    path = folder(v)
    v("fx_voxel").withColumn("slab", F.floor(F.col("k") / 4).cast("int")).write.partitionBy("slab").parquet(path)
    return v.spark.read.parquet(path).groupBy("slab").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@query("A08_new_result", "SELECT method, count(*) AS n FROM fx_unit_error GROUP BY 1")
def a08(v):
    path = folder(v)
    tables.write_new(v("fx_unit_error").groupBy("method").agg(F.count("*").alias("n")), path)
    return v.spark.read.parquet(path)


@query("A09_frozen_model", "SELECT 'slope' AS term, round(regr_slope(target, f1), 6) AS value FROM fx_features UNION ALL SELECT 'one', round(regr_intercept(target, f1), 6) FROM fx_features")
def a09(v):
    f = v("fx_features")
    fit = f.agg(F.regr_slope("target", "f1").alias("slope"), F.regr_intercept("target", "f1").alias("one"))
    model = fit.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.round(t, 6).alias("value")) for t in ("slope", "one")])))
    path = folder(v)
    tables.freeze_model(model, ["term"], "value", path)
    return tables.load_frozen(v.spark, path, ["term"], "value")


def flat(v):
    return v("fx_points3").select("point_id", "region", "x", "y", "z", "value")


@query("C07_one_to_one_match")
def c07(v):
    p = flat(v)
    a, b, dims = p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1"), ["x", "y", "z"]
    gate = spatial.nearest(a, b, dims, "point_id", "point_id").agg(F.median("distance")).first()[0]  # follows the density: components stay small
    return matching.one_to_one(spatial.range_join(a, b, gate or 1.0, dims, "point_id", "point_id", strict=False))


@query("C07_match_then_gate")
def c07b(v):
    line = v("lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice") / 1000).cast("double").alias("b"))
    return matching.match_then_gate(line.where("id % 2 = 0"), line.where("id % 2 = 1"), ["unit_id"], "id", ["a", "b"], 20.0)


@query("C08_shift_association")
def c08(v):
    p = flat(v)
    return matching.best_shift(p.where("region % 2 = 0"), p.where("region % 2 = 1"), "point_id", ("x", "y"), 10, 0.05, 40)


@query("H12_hole_candidates")
def h12(v):
    return holes.hole_candidates(flat(v), "point_id", ("region",), 12)


@query("H13_greedy_insertion")
def h13(v):
    return holes.greedy_insertion(flat(v), "point_id", "region", 8)


@query("H15_triangulation_edges")
def h15(v):
    return holes.triangulation_edges(flat(v), "point_id", ("region",))


@query("H16_hull_area")
def h16(v):
    return holes.hull_area(flat(v), ["region"], "x", "y")


@query("H18_track_linking")
def h18(v):
    t = v("fx_track").select(F.col("track_id").alias("region"), (F.col("depth") % 7).cast("int").alias("frame"), F.col("depth").alias("id"), "r", "c")
    return matching.link_tracks(t, "region", "frame", "id", ["r", "c"], 3, 1.5)


@query("H19_torn_edges")
def h19(v):
    p = flat(v).select("point_id", "x", "y")
    ways = [F.max_by("point_id", F.struct(F.col("x") * cos(i * pi / 4) + F.col("y") * sin(i * pi / 4), "point_id")) for i in range(8)]
    ring = p.agg(F.array(*ways).alias("n")).select(F.posexplode("n").alias("place", "node")).groupBy("node").agg(F.min("place").alias("place"))
    return holes.torn_edges(p, "point_id", ring, 2)


@query("I16_mapping_choice")
def i16(v):
    return predict.mapping_choice(flat(v), ["region"], ["x", "y"], ["z", "value"])


@query("I17_direction_ridge")
def i17(v):
    p = flat(v)
    out = predict.direction_ridge(p, "region", [F.col("x"), F.col("y"), F.col("x") * F.col("y")], ["x", "y", "z"])
    return out.select("point_id", "region", "p_x", "p_y", "p_z")


@query("I17_direction_predictors")
def i17b(v):
    p = flat(v).select("point_id", "region", "x", "y", "z")
    p = p.join(surfaces.local_normals(p, "point_id", 8).drop("curvature"), "point_id")
    out = predict.direction_predictors(p, "region", [F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y"), F.col("y") * F.col("y")], ["nx", "ny", "nz"], ["x", "y", "z"])
    return predict.direction_angles(out, "point_id", "region", ["x", "y", "z"])


@query("I19_thin_plate")
def i19(v):
    p = flat(v)
    return surfaces.thin_plate(p.where("point_id % 5 = 0"), p.where("point_id % 5 <> 0"), "point_id", "value", 64)


@query("I19_tuned_thin_plate")
def i19b(v):
    return surfaces.tuned_thin_plate(flat(v).withColumn("block", (F.col("region") % 4).cast("int")), "point_id", "value", "block", 64)


def surface_cells(v):
    return v("fx_voxel").select(F.col("k").alias("unit"), F.col("i").alias("gi"), F.col("j").alias("gj"), ((F.col("i") - 12) / 12.0).alias("u"), ((F.col("j") - 10) / 10.0).alias("v"), "value")


@query("I25_gap_fill")
def i25(v):
    return surfaces.gap_fill(surface_cells(v).withColumn("block", F.col("unit") % 3), "unit", "block", geo.region_masks(F.col("u"), F.col("v")), "value")


@query("I29_scribble_classifier")
def i29(v):
    voxels = v("fx_voxel")
    marks = voxels.where((F.col("i") + F.col("j") + F.col("k")) % 3 == 0).select("i", "j", "k", (F.col("value") > 26).cast("int").alias("label"))
    features = predict.scribble_features(voxels, "value", 50.0)
    return predict.scribble_classifier(features, marks, ["i", "j", "k"], ["raw", "smooth1", "smooth2", "smooth4", "band", "edge"])


@query("I30_residual_template", "WITH c AS (SELECT k AS unit, k % 2 AS fold, i AS gi, j AS gj, value FROM fx_voxel), o AS (SELECT unit, median(value) AS background, greatest(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 1.0) AS contrast FROM c GROUP BY 1), s AS (SELECT c.*, background, contrast, (value - background) / contrast AS r FROM c JOIN o USING (unit)), t AS (SELECT h AS fold, gi, gj, median(r) AS template FROM s JOIN (SELECT DISTINCT fold AS h FROM c) f ON s.fold <> f.h GROUP BY 1, 2, 3) SELECT unit, gi, gj, round(background + contrast * template, 4) AS prediction FROM s JOIN t USING (fold, gi, gj)")
def i30(v):
    out = surfaces.residual_template(surface_cells(v).withColumn("fold", F.col("unit") % 2), "fold", "unit", ["gi", "gj"], "value")
    return out.select("unit", "gi", "gj", F.round("prediction", 4).alias("prediction"))


@query("I32_local_normals")
def i32(v):
    return surfaces.local_normals(flat(v), "point_id", 16)


def in_volume(v):
    """Points with unit normals, their coordinates scaled into the voxel table."""
    n = geo.unit(geo.vec())
    ends = flat(v).agg(*[f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))])
    p = flat(v).crossJoin(F.broadcast(ends))
    at = {c: lo + size * (F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) for c, lo, size in (("x", 4, 15), ("y", 4, 11), ("z", 3, 1))}
    return p.select("point_id", *[c.alias(f"n{k}") for k, c in zip("xyz", n, strict=True)], *[c.alias(k) for k, c in at.items()])


@query("J13_offset_scan")
def j13(v):
    return surfaces.offset_scan(in_volume(v), v("fx_voxel"), "point_id", [(a, b, 0.0) for a in (-1, 0, 1) for b in (-1, 0, 1)], 1.0)


@query("J14_registration_check")
def j14(v):
    a = flat(v)
    b = a.select("point_id", (2 * F.col("x") + F.col("y") + 1).alias("x"), (F.col("y") - F.col("z")).alias("y"), (F.col("z") * 0.5 - 3).alias("z"))
    return surfaces.registration_check(a, b, "point_id", 1e-5)


@query("K04_derivative_maps")
def k04(v):
    return surfaces.derivative_maps(v("fx_voxel"), "value", (1.0, 2.0), ("k",))


@query("K05_aligned_volume")
def k05(v):
    return surfaces.aligned_volume(in_volume(v), v("fx_voxel"), "point_id", geo.canonical_grid(v.spark, 1.0, 0.5), [0.0, 0.5, 1.0])


@query("K06_shell_features")
def k06(v):
    return surfaces.shell_features(k05(v), "point_id")


@query("K09_automatic_crop")
def k09(v):
    return surfaces.automatic_crop(v("fx_voxel").where("value >= 22"), 1.0, (8, 8))


@query("K10_unfolded_patch")
def k10(v):
    return surfaces.unfolded_patch(flat(v), "point_id", 0, 1.0)


@query("K10_unfolded_stack")
def k10b(v):
    cells = v("fx_voxel").withColumn("label", F.when(F.col("value") > 26, 3).otherwise(1))
    first = in_volume(v).agg(F.min("point_id")).first()[0]
    return surfaces.unfolded_stack(in_volume(v), cells, "point_id", first, 6.0, 4.0, 0.5, 8, "label", 3)


@query("K12_turned_patches")
def k12(v):
    c = surface_cells(v).select(F.col("unit").cast("long").alias("unit"), (F.col("gi") - 12).alias("da"), (F.col("gj") - 10).alias("db"), "value")
    return surfaces.turned_patches(c, "unit", "value", [(0.0, 1.0, 0.0, 0.0), (0.5, 1.1, 0.25, -0.5)])


@query("K14_edge_region")
def k14(v):
    lowest = v("fx_voxel").agg(F.min_by(F.struct("i", "j", "k"), F.struct("value", "i", "j", "k"))).first()[0]
    return surfaces.edge_region(v("fx_voxel"), 24.0, tuple(lowest))
