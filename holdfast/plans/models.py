"""Registered queries: moments, holdouts, predictors, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import holdout, learners, moments, predict, ranks, spatial, stats
from ..operators import windows as win
from .places import knn_sql
from .registry import query
from .scores import UNITS, rounded


@query("D12_principal_axes")
def d12(v):
    return moments.principal_axes(v("fx_points3"), ["region"], ["x", "y", "z"])


@query("D13_rigid_rotation")
def d13(v):
    p = v("fx_points3").withColumns({"a": F.col("y"), "b": -F.col("x"), "c": F.col("z")})
    return moments.kabsch(p, ["region"], ["x", "y", "z"], ["a", "b", "c"])


@query("D14_least_squares", "SELECT block_id, CAST(count(*) AS DOUBLE) AS n, round(regr_intercept(target, f1), 5) AS intercept, round(regr_slope(target, f1), 6) AS slope, round(sqrt(regr_syy(target, f1) * (1 - regr_r2(target, f1)) / count(*)), 5) AS rmse FROM fx_features GROUP BY 1")
def d14(v):
    f = v("fx_features")
    beta = moments.coefficients(moments.statistics(f, ["block_id"], [F.lit(1.0), F.col("f1")], [F.col("target")]), ["block_id"], moments.least_squares, 2)
    e = f.join(F.broadcast(beta), "block_id").withColumn("e", F.col("target") - moments.predicted([F.col("f1")]))
    return e.groupBy("block_id").agg(F.first("n").alias("n"), F.round(F.first(F.get("beta", F.lit(0))), 5).alias("intercept"), F.round(F.first(F.get("beta", F.lit(1))), 6).alias("slope"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 5).alias("rmse"))


@query("D26_huber")
def d26(v):
    return moments.huber(v("fx_features"), ["block_id"], [F.col("f1"), F.col("f2")], F.col("target"))


@query("D27_two_layers")
def d27(v):
    return moments.two_layers(v("fx_points3"), ["region"], "z")


H, W = "('0x' || substr(md5('42:' || point_id), 1, 12))::BIGINT", "SELECT count(*) AS n, CAST(floor(count(*) * 0.25 + 0.5) AS BIGINT) AS c, 0.12 * greatest(max(x) - min(x), max(y) - min(y)) AS r FROM fx_points3"
SPLITS = f"w AS ({W}), h AS (SELECT point_id, x, y, value, row_number() OVER (ORDER BY {H}, point_id) AS hr FROM fx_points3), a AS (SELECT x AS ax, y AS ay FROM h WHERE hr = 1), d AS (SELECT h.*, row_number() OVER (ORDER BY sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)), point_id) AS dr FROM h, a), t AS (SELECT * FROM d, w WHERE dr <= c), m AS (SELECT d.point_id, min(sqrt(pow(d.x - t.x, 2) + pow(d.y - t.y, 2))) AS near FROM d, t GROUP BY 1), s AS (SELECT 'random' AS strategy, point_id, CASE WHEN hr <= c THEN 'test' ELSE 'train' END AS assignment FROM d, w UNION ALL SELECT 'spatial', point_id, CASE WHEN dr <= c THEN 'test' ELSE 'train' END FROM d, w UNION ALL SELECT 'buffered', d.point_id, CASE WHEN dr <= c THEN 'test' WHEN near < r THEN 'excluded' ELSE 'train' END FROM d JOIN m USING (point_id), w)"


@query("I01_splits", f"WITH {SPLITS} SELECT * FROM s")
def i01(v):
    return holdout.make_splits(v("fx_points3"), "point_id", "x", "y")


SCORED = f"{SPLITS}, tr AS (SELECT s.strategy, d.* FROM s JOIN d USING (point_id) WHERE assignment = 'train'), te AS (SELECT s.strategy, d.* FROM s JOIN d USING (point_id) WHERE assignment = 'test'), n AS (SELECT te.strategy, te.point_id, te.value AS y, tr.value AS v, sqrt(pow(te.x - tr.x, 2) + pow(te.y - tr.y, 2)) AS dist FROM te JOIN tr ON te.strategy = tr.strategy QUALIFY row_number() OVER (PARTITION BY te.strategy, te.point_id ORDER BY sqrt(pow(te.x - tr.x, 2) + pow(te.y - tr.y, 2)), tr.point_id) <= 6), p AS (SELECT strategy, point_id, y, CASE WHEN min(dist) = 0 THEN avg(v) FILTER (dist = 0) ELSE sum(v / dist) / sum(1 / dist) END AS p, min(dist) AS near FROM n GROUP BY 1, 2, 3), b AS (SELECT strategy, avg(value) AS m, count(*) AS train FROM tr GROUP BY 1)"


@query("I11_compare_splits", f"WITH {SCORED} SELECT strategy, train, count(*) AS test, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg(pow(m - y, 2))), 6) AS mean_rmse, round(avg(near), 6) AS mean_nearest FROM p JOIN b USING (strategy) GROUP BY 1, 2")
def i11(v):
    scores, _ = predict.compare_splits(v("fx_points3"), "point_id", "x", "y", "value")
    return rounded(scores, "rmse", "mae", "mean_rmse", "mean_nearest").withColumn("r2", F.round("r2", 5))


@query("A13_assignment_export", f"WITH {SCORED} SELECT strategy, point_id, assignment, round(p.p, 6) AS prediction, round(p.p - d.value, 6) AS residual, round(near, 6) AS nearest FROM s JOIN d USING (point_id) LEFT JOIN p USING (strategy, point_id)")
def a13(v):
    from ..sources.tables import export_assignments

    p = v("fx_points3")
    _, predictions = predict.compare_splits(p, "point_id", "x", "y", "value")
    out = export_assignments(p.select("point_id", "value"), "point_id", holdout.make_splits(p, "point_id", "x", "y"), predictions, ["random", "spatial", "buffered"])
    return rounded(out, "prediction", "residual", "nearest").select("strategy", "point_id", "assignment", "prediction", "residual", "nearest")


@query("I02_leave_block_out", "WITH f AS (SELECT DISTINCT block_id AS fold FROM fx_features) SELECT fold, CASE WHEN block_id = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(target), 6) AS mean FROM fx_features, f GROUP BY 1, 2")
def i02(v):
    return holdout.leave_block_out(v("fx_features"), "block_id").groupBy("fold", "role").agg(F.count("*").alias("n"), F.round(F.avg("target"), 6).alias("mean"))


@query("I02_train_means", "WITH f AS (SELECT DISTINCT block_id AS fold FROM fx_features) SELECT fold AS block_id, round(avg(target), 6) AS train_mean FROM fx_features JOIN f ON block_id <> fold GROUP BY 1")
def i02b(v):
    return rounded(moments.fold_means(v("fx_features"), "block_id", "target"), "train_mean")


@query("I03_kmeans_blocks")
def i03(v):
    return learners.kmeans_blocks(v("fx_points2"), "point_id", ["x", "y"])


@query("I04_balanced_folds", "WITH RECURSIVE g AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS i FROM (SELECT l_suppkey % 9 AS k, count(*) AS n FROM lineitem GROUP BY 1)), r AS (SELECT 0::BIGINT AS i, -1::BIGINT AS grp, -1 AS fold, [0::BIGINT, 0, 0] AS load UNION ALL SELECT g.i, g.k, list_position(load, list_min(load)) - 1, [load[1] + CASE WHEN list_position(load, list_min(load)) = 1 THEN n ELSE 0 END, load[2] + CASE WHEN list_position(load, list_min(load)) = 2 THEN n ELSE 0 END, load[3] + CASE WHEN list_position(load, list_min(load)) = 3 THEN n ELSE 0 END] FROM r JOIN g ON g.i = r.i + 1) SELECT grp, fold FROM r WHERE i > 0")
def i04(v):
    groups = v("lineitem").groupBy((F.col("l_suppkey") % 9).alias("grp")).agg(F.count("*").alias("n"))
    return holdout.balanced_folds(groups, "grp", "n", 3)


@query("I05_buffered_quadrants", "WITH m AS (SELECT median(x) AS cu, median(y) AS cv FROM fx_points2) SELECT CASE WHEN x >= cu AND y >= cv THEN 'test' WHEN sqrt(pow(greatest(cu - x, 0), 2) + pow(greatest(cv - y, 0), 2)) > 80 THEN 'train' ELSE 'buffer' END AS role, count(*) AS n, round(avg(value), 6) AS mean FROM fx_points2, m GROUP BY 1")
def i05(v):
    from ..functions import geometry as geo

    p = v("fx_points2")
    p = p.crossJoin(F.broadcast(p.agg(F.median("x").alias("cu"), F.median("y").alias("cv"))))
    x, y, cu, cv = (F.col(c) for c in ("x", "y", "cu", "cv"))
    role = F.when(geo.quadrant(x, y, cu, cv) == 3, "test").when(geo.quadrant_distance(x, y, cu, cv, F.lit(3)) > 80, "train").otherwise("buffer")
    return p.groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("I06_guarded_bands", "WITH b AS (SELECT * FROM (VALUES (0, 100.0, 200.0), (1, 200.0, 300.0)) t(band, lo, hi)) SELECT band, CASE WHEN y >= lo AND y < hi THEN 'test' WHEN y >= lo - 30 AND y < hi + 30 THEN 'guard' ELSE 'train' END AS role, count(*) AS n FROM fx_points2, b GROUP BY 1, 2")
def i06(v):
    return holdout.guarded_bands(v("fx_points2"), F.col("y"), [(100, 200), (200, 300)], 30).groupBy("band", "role").agg(F.count("*").alias("n"))


def ridge_sql(x, y, alpha, scaled=True, per_n=False, table="fx_features"):
    """One predictor: slope = Sxy / (Sxx + penalty * d^2), d the population deviation or 1."""
    d2 = f"regr_sxx({y}, {x}) / count(*)" if scaled else "1.0"
    return f"SELECT f.b AS block_id, regr_sxy({y}, {x}) / (regr_sxx({y}, {x}) + {alpha}{' * count(*)' if per_n else ''} * {d2}) AS slope, avg({x}) AS mx, avg({y}) AS my FROM {table}, (SELECT DISTINCT block_id AS b FROM {table}) f WHERE block_id <> f.b GROUP BY 1"


@query("I07_ridge", f"WITH m AS ({ridge_sql('f1', 'target', 5.0)}) SELECT block_id, count(*) AS n, round(avg(abs(my + slope * (f1 - mx) - target)), 6) AS mae FROM fx_features JOIN m USING (block_id) GROUP BY 1")
def i07(v):
    out = moments.block_ridge(v("fx_features"), "block_id", [F.col("f1")], F.col("target"), 5.0)
    return out.groupBy("block_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("target"))), 6).alias("mae"))


@query("I08_ridge_n_scaled", f"WITH m AS ({ridge_sql('f2', 'target', 0.001, False, True)}) SELECT block_id, count(*) AS n, round(avg(abs(my + slope * (f2 - mx) - target)), 6) AS mae FROM fx_features JOIN m USING (block_id) GROUP BY 1")
def i08(v):
    out = moments.block_ridge(v("fx_features"), "block_id", [F.col("f2")], F.col("target"), 0.001, scaled=False, per_n=True)
    return out.groupBy("block_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("target"))), 6).alias("mae"))


@query("I09_leave_one_out_alpha")
def i09(v):
    return moments.leave_one_out(v("fx_features"), [F.col("f1"), F.col("f2")], F.col("target"), [10 ** (-2 + 5 * i / 11) for i in range(12)])


@query("I10_nested_tuning")
def i10(v):
    return predict.tuned_ridge(v("fx_features"), "block_id", "unit_id", [F.col("f1"), F.col("f2")], "target", [0.1, 10.0, 1000.0])


@query("I10_nested_tuning_one", "WITH p AS (SELECT a.block_id AS o, b.block_id AS i FROM (SELECT DISTINCT block_id FROM fx_features) a, (SELECT DISTINCT block_id FROM fx_features) b WHERE a.block_id <> b.block_id), m AS (SELECT o, i, alpha, regr_sxy(target, f1) / (regr_sxx(target, f1) * (1 + alpha / count(*))) AS s, avg(f1) AS mx, avg(target) AS my FROM fx_features JOIN p ON block_id <> o AND block_id <> i, (VALUES (1.0), (20000.0), (1000000.0)) t(alpha) GROUP BY 1, 2, 3), u AS (SELECT o, alpha, block_id, unit_id, avg(abs(my + s * (f1 - mx) - target)) AS e FROM fx_features JOIN m ON block_id = i GROUP BY 1, 2, 3, 4), b AS (SELECT o, alpha, block_id, median(e) AS e FROM u GROUP BY 1, 2, 3) SELECT o AS \"outer\", CAST(alpha AS DOUBLE) AS alpha, round(median(e), 6) AS score FROM b GROUP BY 1, 2")
def i10b(v):
    return rounded(predict.tuned_ridge(v("fx_features"), "block_id", "unit_id", [F.col("f1")], "target", [1.0, 20000.0, 1000000.0]), "score")


UNITS3 = "s AS (SELECT point_id, x, y, z, value FROM fx_points3)"
KS = dict(by="", key="q.point_id", table="s")


@query("I12_depth_and_shape", f"WITH {UNITS3}, {knn_sql(6, **KS)}, c AS (SELECT point_id, cell, v FROM (SELECT point_id, unnest([0, 1, 2]) AS cell, unnest([x, y, z]) AS v FROM s)), l AS (SELECT point_id, median(v) AS l FROM c GROUP BY 1), sh AS (SELECT cell, median(v - l) AS shape FROM c JOIN l USING (point_id) GROUP BY 1), u AS (SELECT query_id, sum(l / pow(distance, 2)) / sum(1 / pow(distance, 2)) AS level FROM n JOIN l ON l.point_id = neighbour_id GROUP BY 1) SELECT query_id, cell, round(level + shape, 6) AS prediction FROM u, sh")
def i12(v):
    s = v("fx_points3")
    cells = s.select("point_id", F.posexplode(F.array("x", "y", "z")).alias("cell", "v"))
    near = spatial.knn_join(s, s, 6, ["x", "y", "z"], "point_id", "point_id", exclude_self=True)
    return rounded(predict.depth_and_shape(near, cells, "point_id", "cell", "v"), "prediction")


@query("I13_surface_from_neighbours", f"WITH {UNITS3}, {knn_sql(3, **KS)}, c AS (SELECT point_id, unnest([0, 1, 2]) AS cell, unnest([x, y, z]) AS v FROM s) SELECT query_id, cell, round(sum(v / pow(distance, 2)) / sum(1 / pow(distance, 2)), 6) AS prediction FROM n JOIN c ON c.point_id = neighbour_id GROUP BY 1, 2")
def i13(v):
    s = v("fx_points3")
    cells = s.select("point_id", F.posexplode(F.array("x", "y", "z")).alias("cell", "v"))
    near = spatial.knn_join(s, s, 3, ["x", "y", "z"], "point_id", "point_id", exclude_self=True)
    return rounded(predict.surface_from_neighbours(near, cells, "point_id", ["cell"], "v"), "prediction")


@query("I14_ellipsoid_cap", "WITH c AS (SELECT k, value, sqrt(greatest(0.0, 1 - (pow(i - 12, 2) + pow(j - 10, 2)) / 400.0)) AS s FROM fx_voxel) SELECT k, round(regr_intercept(value, s), 5) AS base, round(regr_slope(value, s), 5) AS height FROM c GROUP BY 1")
def i14(v):
    cap = F.sqrt(F.greatest(F.lit(0.0), 1 - (F.pow(F.col("i") - 12, 2) + F.pow(F.col("j") - 10, 2)) / 400.0))
    beta = moments.coefficients(moments.statistics(v("fx_voxel"), ["k"], [F.lit(1.0), cap], [F.col("value")]), ["k"], moments.least_squares, 2)
    return beta.select("k", F.round(F.get("beta", F.lit(0)), 5).alias("base"), F.round(F.get("beta", F.lit(1)), 5).alias("height"))


@query("I15_two_stage", f"WITH a AS ({ridge_sql('f1', 'target', 1.0)}), q AS (SELECT f.b AS fold, f1, f2, target - (my + slope * (f1 - mx)) AS r FROM fx_features JOIN (SELECT block_id AS b, slope, mx, my FROM a) f ON block_id <> f.b), b AS (SELECT fold AS block_id, regr_sxy(r, f2) / (regr_sxx(r, f2) * (1 + 1.0 / count(*))) AS s2, avg(f2) AS m2, avg(r) AS mr FROM q GROUP BY 1) SELECT block_id, round(avg(abs(my + slope * (f1 - mx) + mr + s2 * (f2 - m2) - target)), 5) AS mae FROM fx_features JOIN a USING (block_id) JOIN b USING (block_id) GROUP BY 1")
def i15(v):
    out = predict.two_stage(v("fx_features"), "block_id", [F.col("f1")], [F.col("f2")], "target")
    return out.groupBy("block_id").agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("target"))), 5).alias("mae"))


@query("I18_vector_idw", "WITH s AS (SELECT * FROM fx_points3 WHERE point_id % 3 <> 0), n AS (SELECT q.point_id AS query_id, s.y, s.z, sqrt(pow(q.x - s.x, 2) + pow(q.value - s.value, 2)) AS d FROM fx_points3 q, s WHERE q.point_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY sqrt(pow(q.x - s.x, 2) + pow(q.value - s.value, 2)), s.point_id) <= 16), w AS (SELECT query_id, sum(y / (d * d)) AS y, sum(z / (d * d)) AS z FROM n GROUP BY 1) SELECT query_id, round(y / sqrt(y * y + z * z), 5) AS y, round(z / sqrt(y * y + z * z), 5) AS z FROM w")
def i18(v):
    p = v("fx_points3")
    out = predict.vector_idw(p.where("point_id % 3 = 0"), p.where("point_id % 3 <> 0"), ["x", "value"], "point_id", ["y", "z"])
    return out.select("query_id", F.round("y", 5).alias("y"), F.round("z", 5).alias("z"))


@query("I20_regional_field", "WITH r AS (SELECT region, median(z) AS skew, avg(x) AS x, avg(y) AS y FROM fx_points3 GROUP BY 1) SELECT a.region, round(sum(b.skew / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) / sum(1 / (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS prediction FROM r a JOIN r b ON a.region <> b.region GROUP BY 1")
def i20(v):
    from ..operators.joins import weighted_cross

    r = v("fx_points3").groupBy("region").agg(F.median("z").alias("skew"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    d2 = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    own = F.col("region") == F.col("site")
    out = weighted_cross(r, r.select(F.col("region").alias("site"), F.col("skew").alias("s_skew"), F.col("x").alias("sx"), F.col("y").alias("sy")), F.when(own, 0.0).otherwise(1 / F.when(own, 1.0).otherwise(d2)), F.col("s_skew"), ["region"])
    return rounded(out, "prediction")


@query("I21_path_fits", "WITH t AS (SELECT track_id, r, c, depth, CASE WHEN max(depth) OVER w > min(depth) OVER w THEN (depth - min(depth) OVER w) * 1.0 / (max(depth) OVER w - min(depth) OVER w) ELSE 0 END AS t, count(*) OVER w AS n FROM fx_track WINDOW w AS (PARTITION BY track_id)) SELECT track_id, count(*) AS nodes, round(sqrt((regr_syy(r, t) * (1 - regr_r2(r, t)) + regr_syy(c, t) * (1 - regr_r2(c, t))) / count(*)), 5) AS rmse FROM t WHERE n > 2 GROUP BY 1")
def i21(v):
    return predict.path_fits(v("fx_track"), "track_id", "depth", "r", "c", 1).select("track_id", "nodes", F.round("rmse", 5).alias("rmse"))


@query("I21_path_scores")
def i21b(v):
    fits = [predict.path_fits(v("fx_track"), "track_id", "depth", "r", "c", d).withColumn("degree", F.lit(d)) for d in (1, 2)]
    return fits[0].unionByName(fits[1])


@query("I22_blocked_path_cv")
def i22(v):
    return predict.path_cv(v("fx_track"), "track_id", "depth", "r", "c")


@query("I23_frozen_transfer", "SELECT block_id, count(*) AS n, round(avg(abs(1.5 + 1.4 * f1 - 20 * f2 - target)), 6) AS mae FROM fx_features GROUP BY 1")
def i23(v):
    model = v.spark.createDataFrame([("one", 1.5), ("f1", 1.4), ("f2", -20.0)], "term string, value double")
    out = predict.apply_frozen(v("fx_features"), model, {"one": F.lit(1.0), "f1": F.col("f1"), "f2": F.col("f2")})
    return out.groupBy("block_id").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("target"))), 6).alias("mae"))


@query("I24_leave_unit_out", "WITH u AS (SELECT unit_id, sum(target) AS s, count(target) AS n FROM fx_features GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM u) SELECT unit_id, round((t.s - u.s) / (t.n - u.n), 6) AS train_mean FROM u, t")
def i24(v):
    own = v("fx_features").groupBy("unit_id").agg(F.sum("target").alias("s"), F.count("target").alias("n"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return own.crossJoin(F.broadcast(total)).select("unit_id", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 6).alias("train_mean"))


@query("I26_tree_regressors")
def i26(v):
    return learners.tree_regressors(v("fx_features"), "block_id", ["f1", "f2", "f3"], "target")


@query("I27_count_classifier")
def i27(v):
    rows = v("fx_features").withColumn("label", F.least(F.floor(F.col("target") / 35), F.lit(2)).cast("double"))
    return learners.count_classifier(rows, "block_id", ["f1", "f2", "f3"], "label").select("unit_id", "block_id", "label", "prediction")


@query("I28_penalised_choice", "WITH l AS (SELECT l_orderkey AS case_id, l_linenumber AS k, min(l_extendedprice) / 10000 AS loss FROM lineitem GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY penalty, case_id ORDER BY loss + penalty * (k - 3), k) AS n FROM l, (VALUES (0.0), (0.5), (2.0)) t(penalty)) SELECT CAST(penalty AS DOUBLE) AS penalty, case_id, k AS choice FROM g WHERE n = 1")
def i28(v):
    losses = v("lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("k")).agg((F.min("l_extendedprice") / 10000).alias("loss"))
    return predict.penalised_choice(losses, "case_id", "k", "loss", [0.0, 0.5, 2.0])


@query("I31_offset_calibration", "WITH s AS (SELECT f.b, median(error) AS shift FROM fx_unit_error, (SELECT DISTINCT block_id AS b FROM fx_unit_error) f WHERE block_id <> f.b GROUP BY 1) SELECT block_id, round(avg(abs(error)), 6) AS before, round(avg(abs(error - shift)), 6) AS after FROM fx_unit_error JOIN s ON b = block_id GROUP BY 1")
def i31(v):
    return predict.offset_calibration(v("fx_unit_error"), "block_id", "error").groupBy("block_id").agg(F.round(F.avg("before"), 6).alias("before"), F.round(F.avg("after"), 6).alias("after"))


@query("I33_sphere_fit")
def i33(v):
    x = [F.col(c) for c in "xyz"]
    squares = x[0] * x[0] + x[1] * x[1] + x[2] * x[2]
    beta = moments.coefficients(moments.statistics(v("fx_points3"), ["region"], [F.lit(1.0), *(2 * c for c in x)], [squares]), ["region"], moments.least_squares, 4)
    b = [F.get("beta", F.lit(i)) for i in range(4)]
    return beta.select("region", *[b[i + 1].alias(f"c{n}") for i, n in enumerate("xyz")], F.sqrt(b[0] + b[1] * b[1] + b[2] * b[2] + b[3] * b[3]).alias("radius"))


@query("I33_circle_fit", "WITH m AS (SELECT region, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, x * x + y * y) AS xs, covar_pop(y, x * x + y * y) AS ys, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS ms FROM fx_points3 GROUP BY 1), c AS (SELECT *, (xs * yy - ys * xy) / (2 * (xx * yy - xy * xy)) AS cx, (ys * xx - xs * xy) / (2 * (xx * yy - xy * xy)) AS cy FROM m) SELECT region, round(cx, 5) AS cx, round(cy, 5) AS cy, round(sqrt(ms - 2 * cx * mx - 2 * cy * my + cx * cx + cy * cy), 5) AS radius FROM c")
def i33b(v):
    x, y = F.col("x"), F.col("y")
    beta = moments.coefficients(moments.statistics(v("fx_points3"), ["region"], [F.lit(1.0), 2 * x, 2 * y], [x * x + y * y]), ["region"], moments.least_squares, 3)
    b = [F.get("beta", F.lit(i)) for i in range(3)]
    return beta.select("region", F.round(b[1], 5).alias("cx"), F.round(b[2], 5).alias("cy"), F.round(F.sqrt(b[0] + b[1] * b[1] + b[2] * b[2]), 5).alias("radius"))


@query("I34_cross_group_holdout", "WITH m AS (SELECT f.g, regr_slope(target, f1) AS s, regr_intercept(target, f1) AS i FROM fx_features, (VALUES (0), (1)) f(g) WHERE unit_id % 2 <> f.g GROUP BY 1) SELECT g AS eye, count(*) AS n, round(median(abs(i + s * f1 - target)), 5) AS median_error FROM fx_features JOIN m ON g = unit_id % 2 GROUP BY 1")
def i34(v):
    f = v("fx_features").withColumn("eye", (F.col("unit_id") % 2).cast("int"))
    out = moments.block_ridge(f, "eye", [F.col("f1")], F.col("target"), 0.0).withColumn("error", F.abs(F.col("prediction") - F.col("target")))
    middle = ranks.quantiles(out, ["eye"], "error", {"median_error": 0.5}).drop("n")
    both = ranks.beside(out.groupBy("eye").agg(F.count("*").alias("n")), middle, ["eye"], "left")
    return both.select("eye", "n", F.round("median_error", 5).alias("median_error"))


@query("I35_nearest_block", "WITH c AS (SELECT region, avg(x) AS x, avg(y) AS y FROM fx_points3 WHERE point_id % 4 <> 0 GROUP BY 1) SELECT p.point_id, arg_min(c.region, sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2))) AS region FROM fx_points3 p, c WHERE p.point_id % 4 = 0 GROUP BY 1")
def i35(v):
    p = v("fx_points3")
    return holdout.nearest_block(p.where("point_id % 4 = 0"), p.where("point_id % 4 <> 0"), "point_id", ["x", "y"], "region")


@query("I36_baseline_pair", f"WITH a AS ({ridge_sql('f1', 'target', 1.0)}), b AS ({ridge_sql('f2', 'target', 1.0)}), e AS (SELECT block_id, avg(abs(a.my + a.slope * (f1 - a.mx) - target)) AS full_mae, avg(abs(b.my + b.slope * (f2 - b.mx) - target)) AS radial_mae FROM fx_features JOIN a USING (block_id) JOIN b USING (block_id) GROUP BY 1) SELECT block_id, round(full_mae, 5) AS full_mae, round(radial_mae, 5) AS radial_mae, round(100 * (radial_mae - full_mae) / radial_mae, 4) AS improvement FROM e")
def i36(v):
    f = v("fx_features")
    mae = lambda x, n: moments.block_ridge(f, "block_id", [F.col(x)], F.col("target"), 1.0).groupBy("block_id").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias(n))
    both = mae("f1", "full_mae").join(mae("f2", "radial_mae"), "block_id")
    return both.select("block_id", F.round("full_mae", 5).alias("full_mae"), F.round("radial_mae", 5).alias("radial_mae"), F.round(100 * (F.col("radial_mae") - F.col("full_mae")) / F.col("radial_mae"), 4).alias("improvement"))


BLOCKS = f"{UNITS}, b AS (SELECT method, block_id, median(e) AS e FROM u GROUP BY 1, 2)"


def block_medians(v):
    units = agg.unit_means(v("fx_unit_error"), ["method", "block_id", "unit_id"])
    return units.groupBy("method", "block_id").agg(F.median("error").alias("e"))


@query("J01_bootstrap_median", f"WITH {BLOCKS}, r AS (SELECT method, e, row_number() OVER (PARTITION BY method ORDER BY block_id) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM b), d AS (SELECT r.method, t.d, x.e FROM r, range(1, 4001) t(d), r x WHERE x.method = r.method AND x.i = ('0x' || substr(md5('b:' || t.d || ':' || r.i), 1, 12))::BIGINT % r.n), m AS (SELECT method, d, median(e) AS m FROM d GROUP BY 1, 2) SELECT method, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1")
def j01(v):
    return rounded(stats.bootstrap_median(block_medians(v), ["method"], "block_id", "e", 4000, "b"), "low", "high")


DIFFS = f"{BLOCKS}, d AS (SELECT x.block_id, x.e - y.e AS d FROM b x JOIN b y USING (block_id) WHERE x.method = 'A' AND y.method = 'R')"


def differences(v):
    b = block_medians(v)
    return b.where("method = 'A'").select("block_id", F.col("e").alias("ea")).join(b.where("method = 'R'").select("block_id", F.col("e").alias("er")), "block_id").withColumn("d", F.col("ea") - F.col("er"))


@query("J02_sign_flip", f"WITH {DIFFS}, i AS (SELECT d, row_number() OVER (ORDER BY block_id) - 1 AS i FROM d), p AS (SELECT t.p, avg(CASE WHEN (t.p >> i) & 1 = 1 THEN -d ELSE d END) AS m FROM i, range(0, 32) t(p) GROUP BY 1), o AS (SELECT avg(d) AS o, count(*) AS n FROM d) SELECT n, 1 << n AS patterns, round(o, 6) AS observed, round(avg(CASE WHEN abs(m) >= abs(o) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM p, o GROUP BY 1, 2, 3")
def j02(v):
    return rounded(stats.sign_flip(differences(v).withColumn("one", F.lit(1)), ["one"], "d"), "observed", "p").drop("one")


@query("J03_sign_test", "WITH c AS (SELECT region, count(*) AS n, count(*) FILTER (value > 0) AS wins FROM fx_points3 WHERE value <> 0 GROUP BY 1) SELECT region, n, wins, round(least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))) FROM range(0, 500) t(i) WHERE i <= least(wins, n - wins))), 6) AS p FROM c")
def j03(v):
    return rounded(stats.sign_test(v("fx_points3"), ["region"], "value"), "p")


@query("J04_fisher", "WITH t AS (SELECT region, count(*) FILTER (x > 0 AND y > 0) AS a, count(*) FILTER (x > 0 AND y <= 0) AS b, count(*) FILTER (x <= 0 AND y > 0) AS c, count(*) FILTER (x <= 0 AND y <= 0) AS d FROM fx_points3 GROUP BY 1), m AS (SELECT t.*, i, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1)) AS p FROM t, range(0, 500) r(i) WHERE i >= greatest(0, a - d) AND i <= least(a + b, a + c)), o AS (SELECT region, p AS own FROM m WHERE i = a) SELECT region, round(CASE WHEN b * c <> 0 THEN a * d / (b * c) END, 6) AS odds, round(least(1.0, sum(p) FILTER (p <= own * (1 + 1e-7))), 6) AS p FROM m JOIN o USING (region) GROUP BY region, a, b, c, d")
def j04(v):
    x, y = F.col("x") > 0, F.col("y") > 0
    t = v("fx_points3").groupBy("region").agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    return rounded(stats.fisher(t, ["region"]), "odds", "p")


@query("J05_rank_sum", "WITH r AS (SELECT block_id, f1 > 25 AND f2 > 0.03 AS g, count(*) OVER (PARTITION BY block_id, f1) AS t, rank() OVER (PARTITION BY block_id ORDER BY f1) + (count(*) OVER (PARTITION BY block_id, f1) - 1) / 2.0 AS r FROM fx_features), s AS (SELECT block_id, count(*)::DOUBLE AS n, (count(*) FILTER (g))::DOUBLE AS n1, sum(r) FILTER (g) AS r1, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1) SELECT block_id, round((r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS auc, round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 5) AS z FROM s")
def j05(v):
    out = stats.rank_sum(v("fx_features"), ["block_id"], "f1", (F.col("f1") > 25) & (F.col("f2") > 0.03))
    return out.select("block_id", F.round("auc", 6).alias("auc"), F.round("z", 5).alias("z"))


@query("J06_signed_rank")
def j06(v):
    return stats.signed_rank(v("fx_points3"), ["region"], "value")


@query("J07_method_comparison", f"WITH {UNITS}, w AS (SELECT block_id, unit_id, max(e) FILTER (method = 'A') AS a, max(e) FILTER (method = 'N') AS n, max(e) FILTER (method = 'R') AS r FROM u GROUP BY 1, 2), d AS (SELECT 'N' AS method, block_id, a - n AS d FROM w UNION ALL SELECT 'R', block_id, a - r FROM w), k AS (SELECT * FROM d WHERE d IS NOT NULL), pb AS (SELECT method, block_id, median(d) AS d, row_number() OVER (PARTITION BY method ORDER BY block_id) - 1 AS i FROM k GROUP BY 1, 2), f AS (SELECT method, t.p, avg(CASE WHEN (t.p >> i) & 1 = 1 THEN -d ELSE d END) AS m FROM pb, range(0, 32) t(p) GROUP BY 1, 2), o AS (SELECT method, avg(d) AS o, count(*) AS blocks, count(*) FILTER (d > 0) AS favour, median(d) AS bm FROM pb GROUP BY 1), pv AS (SELECT method, avg(CASE WHEN abs(m) >= abs(o) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM f JOIN o USING (method) GROUP BY 1), un AS (SELECT method, count(*) AS units, median(d) AS med FROM k GROUP BY 1) SELECT method, units, round(med, 6) AS median, blocks, favour, round(bm, 6) AS block_median, round(p, 6) AS p FROM un JOIN o USING (method) JOIN pv USING (method)")
def j07(v):
    out = stats.method_comparison(v("fx_unit_error"), ["block_id", "unit_id"], "method", "error", "A", ["N", "R"], "block_id")
    return rounded(out, "median", "block_median", "p")


@query("J08_translation_invariance", "SELECT prediction, round(max(abs(abs(v + 7 - (target + 7)) - abs(v - target))), 9) AS largest_change FROM (SELECT target, 'f1' AS prediction, f1 AS v FROM fx_features UNION ALL SELECT target, 'f2', f2 FROM fx_features) GROUP BY 1")
def j08(v):
    return stats.translation_change(v("fx_features"), "target", ["f1", "f2"], 7.0).withColumn("largest_change", F.round("largest_change", 9))


@query("J09_target_invariance", f"WITH m AS ({ridge_sql('f1', 'target', 5.0)}) SELECT count(*) AS rows, 0.0 AS largest_change FROM fx_features JOIN m USING (block_id) WHERE block_id = 2")
def j09(v):
    f = v("fx_features").select("unit_id", "block_id", "f1", "f2", "f3", "target")
    hidden = f.withColumn("target", F.when(F.col("block_id") == 2, -1000.0).otherwise(F.col("target")))
    key = ["unit_id", "f1", "f2", "f3"]
    run = lambda df, n: moments.block_ridge(df, "block_id", [F.col("f1")], F.col("target"), 5.0).where("block_id = 2").groupBy(*key).agg(F.count("*").alias("n"), F.first("prediction").alias(n))
    both = run(f, "a").join(run(hidden, "b").drop("n"), key)
    return both.agg(F.sum("n").alias("rows"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 9).alias("largest_change"))


@query("J10_confidence_strata", "WITH m AS (SELECT block_id, median(f1) AS m FROM fx_features GROUP BY 1) SELECT block_id, CASE WHEN f1 <= m THEN 'confident' ELSE 'unsure' END AS stratum, count(*) AS n, round(median(target), 6) AS median_error FROM fx_features JOIN m USING (block_id) GROUP BY 1, 2")
def j10(v):
    return rounded(stats.confidence_strata(v("fx_features"), ["block_id"], "f1", "target"), "median_error")


@query("J11_observer_agreement", "WITH p AS (SELECT case_id, view_name, median(lat_pos) AS ma, median(depth) AS mb FROM fx_click GROUP BY 1, 2), c AS (SELECT case_id, median(ma) AS a, median(mb) AS b, max(ma) - min(ma) AS view_gap FROM p GROUP BY 1) SELECT case_id, round(a, 6) AS a, round(b, 6) AS b, round(view_gap, 6) AS view_gap, round(a - b, 6) AS signed, round(abs(a - b), 6) AS absolute FROM c")
def j11(v):
    return rounded(stats.observer_agreement(v("fx_click"), "case_id", "view_name", F.col("lat_pos"), F.col("depth")), "a", "b", "view_gap", "signed", "absolute")


@query("J12_persistence", "WITH b AS (SELECT * FROM fx_points3 WHERE region = 0), o AS (SELECT * FROM fx_points3 WHERE region <> 0) SELECT b.point_id, count(DISTINCT o.region) AS hits FROM b JOIN o ON sqrt(pow(b.x - o.x, 2) + pow(b.y - o.y, 2)) <= 0.3 GROUP BY 1 HAVING count(DISTINCT o.region) >= 4")
def j12(v):
    p = v("fx_points3")
    return stats.persistence(p.where("region = 0").drop("region"), p.where("region <> 0"), ["x", "y"], "point_id", "region", 0.3, 4)


@query("J15_lattice_depth", f"WITH {knn_sql(1)}, g AS (SELECT region, count(*) AS points, median(distance) AS spacing, stddev_pop(distance) / avg(distance) AS cv FROM n GROUP BY 1) SELECT region, points, round(spacing, 6) AS spacing, round(cv, 6) AS cv, row_number() OVER (ORDER BY cv, region) AS place FROM g QUALIFY place <= 3")
def j15(v):
    p = v("fx_points3")
    near = spatial.knn_join(p, p, 1, ["x", "y", "z"], "point_id", "point_id", ("region",), exclude_self=True)
    out = near.groupBy("region").agg(F.count("*").alias("points"), F.median("distance").alias("spacing"), (F.stddev_pop("distance") / F.avg("distance")).alias("cv"))
    return rounded(win.top_k(out.withColumn("one", F.lit(1)), ["one"], ["cv", "region"], 3, "place").drop("one"), "spacing", "cv")


@query("J16_component_decomposition", "WITH u AS (SELECT method, block_id, unit_id, avg(error) AS m, stddev_pop(error) AS s FROM fx_unit_error GROUP BY 1, 2, 3) SELECT method, round(stddev_pop(m), 6) AS between_units, round(sqrt(avg(s * s)), 6) AS within_units FROM u GROUP BY 1")
def j16(v):
    u = v("fx_unit_error").groupBy("method", "block_id", "unit_id").agg(F.avg("error").alias("m"), F.stddev_pop("error").alias("s"))
    return u.groupBy("method").agg(F.round(F.stddev_pop("m"), 6).alias("between_units"), F.round(F.sqrt(F.avg(F.col("s") * F.col("s"))), 6).alias("within_units"))


@query("J17_quantile_table", " UNION ALL ".join(f"SELECT block_id, '{c}' AS measure, round(quantile_cont({c}, 0.05), 6) AS q05, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.95), 6) AS q95 FROM fx_features GROUP BY 1" for c in ("f1", "target")))
def j17(v):
    return rounded(stats.quantile_table(v("fx_features"), ["block_id"], ["f1", "target"]), "q05", "q50", "q95")


@query("J18_consistency", "SELECT 'finite' AS \"check\", bool_and(isfinite(x) AND isfinite(y)) AS holds FROM fx_points2 UNION ALL SELECT 'ids differ', count(*) = count(DISTINCT point_id) FROM fx_points2 UNION ALL SELECT 'positive', bool_and(y > 1) FROM fx_points2")
def j18(v):
    finite = lambda c: ~(F.isnan(c) | (F.abs(c) == float("inf")))
    return stats.consistency(v("fx_points2"), {"finite": F.bool_and(finite("x") & finite("y")), "ids differ": F.count("*") == F.count_distinct("point_id"), "positive": F.bool_and(F.col("y") > 1)})


