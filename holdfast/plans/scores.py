"""Registered queries: aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import windows as win
from .registry import query


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("D01_method_summary", "SELECT method, count(error) AS n, round(avg(error), 6) AS mean_error, round(quantile_cont(error, 0.5), 6) AS median_error, round(quantile_cont(error, 0.9), 6) AS p90_error FROM fx_unit_error GROUP BY 1")
def d01(v):
    return rounded(agg.method_summary(v("fx_unit_error"), ["method"]), "mean_error", "median_error", "p90_error")


@query("D02_pooled_rollup", "SELECT CASE WHEN grouping(block_id) = 1 THEN 'pooled' ELSE CAST(block_id AS VARCHAR) END AS block_id, method, count(error) AS n, round(avg(error), 6) AS mean_error, round(median(error), 6) AS median_error FROM fx_unit_error GROUP BY GROUPING SETS ((block_id, method), (method))")
def d02(v):
    return rounded(agg.pooled_rollup(v("fx_unit_error"), "block_id", "method"), "mean_error", "median_error")


UNITS = "u AS (SELECT method, block_id, unit_id, avg(error) AS e FROM fx_unit_error GROUP BY 1, 2, 3)"


@query("D03_hierarchical_reduction", f"WITH {UNITS}, b AS (SELECT method, block_id, median(e) AS e, count(*) AS units FROM u GROUP BY 1, 2) SELECT method, round(median(e), 6) AS median_error, count(*) AS blocks, CAST(sum(units) AS BIGINT) AS units FROM b GROUP BY 1")
def d03(v):
    return rounded(agg.hierarchical(v("fx_unit_error"), "unit_id", "block_id", "method"), "median_error")


@query("D04_distinct_key_counts", "SELECT method, count(DISTINCT unit_id) AS n_units, count(DISTINCT (block_id, cell_id)) AS n_patches FROM fx_unit_error GROUP BY 1")
def d04(v):
    return agg.distinct_keys(v("fx_unit_error"), ["method"], n_units=["unit_id"], n_patches=["block_id", "cell_id"])


WIDE = f"{UNITS}, w AS (SELECT block_id, unit_id, max(e) FILTER (method = 'A') AS a, max(e) FILTER (method = 'N') AS n, max(e) FILTER (method = 'R') AS r FROM u GROUP BY 1, 2)"


def wide(v):
    units = agg.unit_means(v("fx_unit_error"), ["method", "block_id", "unit_id"])
    return agg.pivoted(units, ["block_id", "unit_id"], "method", ["A", "N", "R"], F.max("error"))


@query("D05_win_rate", f"WITH {WIDE} SELECT block_id, count(*) AS n, count(*) FILTER (r < a) AS wins, round(avg(CASE WHEN r < a THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(*) FILTER (abs(a - r) <= 0.1 * abs(a)) AS within_10, count(*) FILTER (abs(a - r) <= 0.2 * abs(a)) AS within_20, count(*) FILTER (abs(a - r) <= 0.3 * abs(a)) AS within_30 FROM w WHERE a IS NOT NULL AND r IS NOT NULL GROUP BY 1")
def d05(v):
    return rounded(agg.win_rate(wide(v), ["block_id"], "A", "R"), "win_rate")


@query("D06_value_count_map", "WITH c AS (SELECT group_name, o_orderpriority AS p, count(*) AS n FROM fx_plan JOIN orders ON o_orderkey = unit_id GROUP BY 1, 2) SELECT group_name, string_agg(p || '=' || n, ',' ORDER BY p) AS counts FROM c GROUP BY 1")
def d06(v):
    rows = v("fx_plan").join(v("orders").select(F.col("o_orderkey").alias("unit_id"), "o_orderpriority"), "unit_id")
    out = agg.value_counts(rows, ["group_name"], "o_orderpriority")
    return out.select("group_name", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("counts"))


@query("D07_pivot", f"WITH {WIDE} SELECT block_id, unit_id, round(a, 6) AS A, round(n, 6) AS N, round(r, 6) AS R FROM w")
def d07(v):
    return rounded(wide(v), "A", "N", "R")


@query("D07_crosstab", "SELECT view_name, count(*) FILTER (depth < 10) AS shallow, count(*) FILTER (depth BETWEEN 10 AND 49) AS middle, count(*) FILTER (depth >= 50) AS deep, 0 AS absent FROM fx_click GROUP BY 1")
def d07b(v):
    rows = v("fx_click").withColumn("band", F.when(F.col("depth") < 10, "shallow").when(F.col("depth") < 50, "middle").when(F.col("depth") >= 50, "deep"))
    return agg.pivoted(rows, ["view_name"], "band", ["shallow", "middle", "deep", "absent"], F.count(F.lit(1)), 0)


@query("D08_weighted_mean", "SELECT method, round(sum(error * cell_id) / sum(cell_id), 6) AS weighted_mean FROM fx_unit_error GROUP BY 1")
def d08(v):
    return rounded(agg.weighted_mean(v("fx_unit_error"), ["method"], "error", "cell_id"), "weighted_mean")


@query("D09_robust_dispersion", "WITH c AS (SELECT region, median(value) AS median, stddev_pop(value) / avg(value) AS cv FROM fx_points3 GROUP BY 1), a AS (SELECT region, median(abs(value - median)) AS mad FROM fx_points3 JOIN c USING (region) GROUP BY 1) SELECT region, round(median, 6) AS median, round(mad, 6) AS mad, round(mad * 1.4826, 6) AS scale, round(cv, 4) AS cv FROM c JOIN a USING (region)")
def d09(v):
    return agg.dispersion(v("fx_points3"), ["region"], "value").select("region", *[F.round(c, 6).alias(c) for c in ("median", "mad", "scale")], F.round("cv", 4).alias("cv"))


@query("D10_pearson", "SELECT region, round(corr(x, value), 6) AS pearson FROM fx_points3 GROUP BY 1")
def d10(v):
    return rounded(agg.pearson(v("fx_points3"), ["region"], "x", "value"), "pearson")


def ranked(col, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0"


@query("D10_spearman", f"WITH r AS (SELECT block_id, {ranked('f1', 'block_id')} AS a, {ranked('target', 'block_id')} AS b FROM fx_features) SELECT block_id, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def d10b(v):
    return rounded(agg.spearman(v("fx_features"), ["block_id"], "f1", "target"), "spearman")


@query("D11_group_moments", "SELECT region, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in "xyz") + ", " + ", ".join(f"round(covar_samp({a}, {b}), 6) AS cov_{a}_{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM fx_points3 GROUP BY 1")
def d11(v):
    out = agg.moments(v("fx_points3"), ["region"], ["x", "y", "z"])
    return rounded(out, *[c for c in out.columns if c not in ("region", "n")])


@query("D15_calibration_quantile", "WITH r AS (SELECT method, error, row_number() OVER (PARTITION BY method ORDER BY error) - 1 AS i, count(*) OVER (PARTITION BY method) AS n FROM fx_unit_error) SELECT method, round(error, 6) AS width, n FROM r WHERE i = ceil((n - 1) * 0.9 - 1e-12)")
def d15(v):
    return rounded(agg.higher_quantile(v("fx_unit_error"), ["method"], "error", 0.9, "width"), "width")


@query("D16_conformal_quantile", "WITH s AS (SELECT block_id, abs(target) / (0.2 + f2) AS s FROM fx_features), r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY block_id) AS n FROM s) SELECT block_id, round(s, 6) AS q, n FROM r WHERE i = ceil((n - 1) * least(ceil((n + 1) * 0.9) / n, 1.0) - 1e-12)")
def d16(v):
    return rounded(agg.conformal_quantile(v("fx_features"), ["block_id"], "target", 0.2 + F.col("f2"), 0.9), "q")


@query("D17_interval_coverage", "WITH u AS (SELECT method, unit_id, count(*) AS n, count(*) FILTER (abs(error) <= 30.0) AS inside FROM fx_unit_error GROUP BY 1, 2) SELECT method, round(sum(inside) / sum(n), 6) AS point_coverage, count(*) AS units, count(*) FILTER (inside >= 0.9 * n) AS units_covered FROM u GROUP BY 1")
def d17(v):
    return rounded(agg.coverage(v("fx_unit_error"), ["method"], "unit_id", "error", F.lit(30.0)), "point_coverage")


@query("D18_best_row", "WITH m AS (SELECT block_id, method, avg(error) AS score FROM fx_unit_error GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score, method) AS k FROM m) SELECT block_id, method, round(score, 6) AS score FROM r WHERE k = 1")
def d18(v):
    scores = v("fx_unit_error").groupBy("block_id", "method").agg(F.avg("error").alias("score"))
    return rounded(agg.best_row(scores, ["block_id"], [F.col("score"), F.col("method")], ["method", "score"]), "score")


@query("D19_template_stack", "WITH f AS (SELECT DISTINCT block_id AS held_out FROM fx_unit_error) SELECT held_out, cell_id, round(median(error), 6) AS template FROM fx_unit_error JOIN f ON block_id <> held_out GROUP BY 1, 2")
def d19(v):
    return rounded(agg.template_stack(v("fx_unit_error"), "block_id", ["cell_id"], "error"), "template")


@query("D20_radial_profile", "WITH r AS (SELECT *, CAST(round_even(sqrt((i - 12) * (i - 12) + (j - 10) * (j - 10)), 0) AS INT) AS ring FROM fx_voxel), m AS (SELECT k, ring, median(value) AS profile FROM r GROUP BY 1, 2) SELECT i, j, k, ring, round(profile, 6) AS profile FROM r JOIN m USING (k, ring)")
def d20(v):
    out = agg.radial_profile(v("fx_voxel"), ["k"], F.col("i") - 12, F.col("j") - 10, "value")
    return rounded(out, "profile").select("i", "j", "k", "ring", "profile")


@query("D21_depth_profile", "SELECT k, round(avg(value) FILTER (r <= 4), 6) AS disk_mean, round(median(value) FILTER (r > 6 AND r <= 9), 6) AS ring_median FROM (SELECT *, sqrt((i - 12) * (i - 12) + (j - 10) * (j - 10)) AS r FROM fx_voxel) GROUP BY 1")
def d21(v):
    r = F.hypot(F.col("i") - 12, F.col("j") - 10)
    return v("fx_voxel").groupBy("k").agg(F.round(F.avg(F.when(r <= 4, F.col("value"))), 6).alias("disk_mean"), F.round(F.median(F.when((r > 6) & (r <= 9), F.col("value"))), 6).alias("ring_median"))


@query("D22_block_sum", "WITH p AS (SELECT i // 4 AS bi, j // 4 AS bj, k, floor(sum(round(value, 4))) AS s FROM fx_voxel GROUP BY 1, 2, 3) SELECT CAST(bi AS INT) AS bi, CAST(bj AS INT) AS bj, CAST(k // 4 AS INT) AS bk, CAST(sum(s) AS BIGINT) AS total FROM p GROUP BY 1, 2, 3")
def d22(v):
    return agg.block_sum(v("fx_voxel").withColumn("value", F.round("value", 4)), 4, "value")


@query("D24_sweep_envelope", "SELECT method, cell_id, round(min(error), 6) AS low, round(max(error), 6) AS high, round(quantile_cont(error, 0.95), 6) AS p95 FROM fx_unit_error GROUP BY 1, 2")
def d24(v):
    return rounded(agg.sweep_envelope(v("fx_unit_error"), ["method", "cell_id"], "error"), "low", "high", "p95")


LIN = "lin // 1000 AS i, (lin % 1000) // 10 AS j, lin % 10 AS k"


@query("D25_object_measures", f"WITH p AS (SELECT region, label, {LIN} FROM fx_label) SELECT region, label, count(*) AS voxels, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(avg({c}), 6) AS mean_{c}" for c in "ijk") + ", bool_or(i = 0 OR i = 23 OR j = 0 OR j = 19) AS border FROM p GROUP BY 1, 2")
def d25(v):
    coords = {"i": F.floor(F.col("lin") / 1000), "j": F.floor(F.col("lin") % 1000 / 10), "k": F.col("lin") % 10}
    return rounded(agg.object_measures(v("fx_label"), ["region", "label"], coords, {"i": (0, 23), "j": (0, 19)}), "mean_i", "mean_j", "mean_k")


@query("D28_binned_extremes", "WITH f AS (SELECT region, quantile_cont(x, 0.02) AS x0, quantile_cont(x, 0.98) AS x1, quantile_cont(y, 0.02) AS y0, quantile_cont(y, 0.98) AS y1 FROM fx_points3 GROUP BY 1), p AS (SELECT region, z, CAST(floor((x - x0) / (x1 - x0) * 4) AS BIGINT) AS ix, CAST(floor((y - y0) / (y1 - y0) * 4) AS BIGINT) AS iy FROM fx_points3 JOIN f USING (region)), b AS (SELECT region, ix, iy, count(*) AS n, max(z) AS top, min(z) AS bottom FROM p WHERE ix BETWEEN 0 AND 3 AND iy BETWEEN 0 AND 3 GROUP BY 1, 2, 3 HAVING count(*) >= 2), c AS (SELECT *, count(*) OVER (PARTITION BY region) AS bins FROM b) SELECT * FROM c WHERE bins >= 5")
def d28(v):
    return agg.extreme_pairs(v("fx_points3"), "region", 4, 5)


@query("D31_contrast", "SELECT block_id, round(greatest(quantile_cont(target, 0.95) - quantile_cont(target, 0.05), 1.0), 6) AS contrast, round(avg(f1), 6) AS mae, round(avg(f1) / greatest(quantile_cont(target, 0.95) - quantile_cont(target, 0.05), 1.0), 6) AS normalised FROM fx_features GROUP BY 1")
def d31(v):
    return rounded(agg.contrast_error(v("fx_features"), ["block_id"], "target", "f1"), "contrast", "mae", "normalised")


@query("D32_shape_features", "SELECT k, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS span, round(stddev_pop(value), 6) AS std, round(avg(value) FILTER (r <= 4) - avg(value) FILTER (r >= 8), 6) AS core_minus_rim FROM (SELECT *, sqrt((i - 12) * (i - 12) + (j - 10) * (j - 10)) AS r FROM fx_voxel) GROUP BY 1")
def d32(v):
    return rounded(agg.shape_features(v("fx_voxel"), ["k"], "value", F.hypot(F.col("i") - 12, F.col("j") - 10), 4, 8), "span", "std", "core_minus_rim")


@query("D33_first_row", "SELECT l_suppkey, arg_min(l_returnflag, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS l_returnflag FROM lineitem GROUP BY 1")
def d33(v):
    return agg.first_row(v("lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"], ["l_returnflag"])


@query("E01_top_k", "WITH r AS (SELECT method, unit_id, cell_id, error, row_number() OVER (PARTITION BY method, cell_id ORDER BY error, unit_id) AS rank FROM fx_unit_error) SELECT method, cell_id, rank, round(error, 6) AS error FROM r WHERE rank <= 5")
def e01(v):
    return rounded(win.top_k(v("fx_unit_error"), ["method", "cell_id"], ["error", "unit_id"], 5), "error").select("method", "cell_id", "rank", "error")


STEPS = "d AS (SELECT *, depth - lag(depth) OVER w AS gap, sqrt(pow(r - lag(r) OVER w, 2) + pow(c - lag(c) OVER w, 2)) AS step FROM fx_track WINDOW w AS (PARTITION BY track_id ORDER BY depth, r, c))"


@query("E02_path_audit", f"WITH {STEPS}, f AS (SELECT track_id, count(*) AS nodes, round(max(step), 6) AS max_step, coalesce(bool_or(gap <= 0), false) AS flat, coalesce(bool_or(step > greatest(5.0, 2.5 * gap)), false) AS jump FROM d GROUP BY 1) SELECT track_id, nodes, max_step, NOT (flat OR jump OR nodes < 6) AS passes, concat_ws('; ', CASE WHEN flat THEN 'depth does not rise' END, CASE WHEN jump THEN 'step too long' END, CASE WHEN nodes < 6 THEN 'too few nodes' END) AS note FROM f")
def e02(v):
    return rounded(win.path_audit(v("fx_track"), "track_id", "depth", "r", "c"), "max_step")


@query("E03_angular_gap", "WITH a AS (SELECT region, atan2(y, x) AS a FROM fx_points3), g AS (SELECT region, coalesce(lead(a) OVER (PARTITION BY region ORDER BY a), min(a) OVER (PARTITION BY region) + 2 * pi()) - a AS gap FROM a) SELECT region, count(*) AS neighbours, round(max(gap), 6) AS max_gap FROM g GROUP BY 1")
def e03(v):
    return rounded(win.angular_gap(v("fx_points3").withColumn("a", F.atan2("y", "x")), ["region"], "a"), "max_gap")


@query("E04_gradient", "SELECT i, j, k, round((coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value)) / (coalesce(lead(k) OVER w, k) - coalesce(lag(k) OVER w, k)), 6) AS gradient FROM fx_voxel WINDOW w AS (PARTITION BY i, j ORDER BY k)")
def e04(v):
    return rounded(win.gradient(v("fx_voxel"), ["i", "j"], "k", "value"), "gradient").select("i", "j", "k", "gradient")


def smooth_sql(sigma):
    w = win.gaussian_weights(sigma)
    r = len(w) // 2
    taps = ", ".join(f"({i - r}, {x!r})" for i, x in enumerate(w))
    return f"w(s, w) AS (VALUES {taps}), t AS (SELECT a.j, a.k, a.i, ((a.i + s) % 48 + 48) % 48 AS p, w FROM fx_voxel a, w), s AS (SELECT t.i, t.j, t.k, sum(w * b.value) AS smooth FROM t JOIN fx_voxel b ON b.j = t.j AND b.k = t.k AND b.i = CASE WHEN p < 24 THEN p ELSE 47 - p END GROUP BY 1, 2, 3)"


@query("E05_gaussian_smooth", f"WITH {smooth_sql(1.5)} SELECT i, j, k, round(smooth, 6) AS smooth FROM s")
def e05(v):
    return rounded(win.gaussian_smooth(v("fx_voxel"), ["j", "k"], "i", "value", 1.5), "smooth")


@query("E08_threshold_crossing", "WITH n AS (SELECT *, lead(value) OVER (PARTITION BY i, j ORDER BY k) AS nx FROM fx_voxel), h AS (SELECT i, j, t AS threshold, max(k) AS k FROM n, (VALUES (24.0), (27.0)) x(t) WHERE value >= t GROUP BY 1, 2, 3) SELECT h.i, h.j, CAST(threshold AS DOUBLE) AS threshold, round(h.k + CASE WHEN value > nx THEN (value - threshold) / (value - nx) ELSE 0 END, 6) AS surface FROM h JOIN n ON n.i = h.i AND n.j = h.j AND n.k = h.k")
def e08(v):
    return rounded(win.threshold_crossing(v("fx_voxel"), ["i", "j"], "k", "value", [24.0, 27.0]), "surface")


@query("E09_steepest_edge", "WITH g AS (SELECT i, j, k, (coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value)) / (coalesce(lead(k) OVER w, k) - coalesce(lag(k) OVER w, k)) AS g FROM fx_voxel WINDOW w AS (PARTITION BY i, j ORDER BY k)), r AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY g, k) AS n FROM g WHERE k BETWEEN 2 AND 6) SELECT i, j, k AS edge, round(-g, 6) AS strength FROM r WHERE n = 1")
def e09(v):
    return rounded(win.steepest_edge(v("fx_voxel"), ["i", "j"], "k", "value", 2, 6), "strength")


@query("E10_contiguous_folds", "SELECT track_id, depth, CAST(floor(5 * (row_number() OVER (PARTITION BY track_id ORDER BY depth) - 1) / count(*) OVER (PARTITION BY track_id)) AS BIGINT) AS fold FROM fx_track")
def e10(v):
    return win.contiguous_folds(v("fx_track"), ["track_id"], "depth").select("track_id", "depth", "fold")


@query("E11_blinded_sample", "WITH r AS (SELECT group_name, unit_id, row_number() OVER (PARTITION BY group_name ORDER BY sha256('s1:' || unit_id)) AS rank FROM fx_plan) SELECT group_name, unit_id, rank, sha256('s1-case:' || unit_id) AS case_hash FROM r WHERE rank <= 20")
def e11(v):
    return win.hashed_sample(v("fx_plan"), "group_name", "unit_id", "s1", 20)


@query("E12_systematic_sample", "WITH r AS (SELECT group_name, unit_id, row_number() OVER (PARTITION BY group_name ORDER BY unit_id) - 1 AS place FROM fx_plan) SELECT group_name, unit_id, place, CASE WHEN (place // 5) % 2 = 0 THEN 'fit' ELSE 'holdout' END AS role FROM r WHERE place % 5 = 0")
def e12(v):
    return win.systematic_sample(v("fx_plan"), ["group_name"], ["unit_id"], 5)


@query("E13_group_centred", "WITH m AS (SELECT unit_id, median(target) AS m, count(*) AS n FROM fx_features GROUP BY 1), t AS (SELECT count(*) AS g, sum(n) AS rows FROM m) SELECT unit_id, round(target - m, 6) AS centred, round(rows / g / n, 6) AS weight FROM fx_features JOIN m USING (unit_id), t")
def e13(v):
    return rounded(win.group_centred(v("fx_features"), "unit_id", "target"), "centred", "weight").select("unit_id", "centred", "weight")


@query("E15_cyclic_windows", "WITH r AS (SELECT region, point_id, row_number() OVER (PARTITION BY region ORDER BY point_id) - 1 AS p, count(*) OVER (PARTITION BY region) AS n FROM fx_points3) SELECT a.region, a.p AS start, s.step, b.point_id AS member FROM r a, (VALUES (0), (1), (2)) s(step), r b WHERE b.region = a.region AND b.p = (a.p + s.step) % a.n")
def e15(v):
    return win.cyclic_windows(v("fx_points3"), ["region"], "point_id", "point_id", 3)


@query("F01_deterministic_order", "SELECT point_id, dense_rank() OVER (PARTITION BY region ORDER BY x, y, z) AS rank FROM fx_points3")
def f01(v):
    from pyspark.sql import Window

    return v("fx_points3").select("point_id", F.dense_rank().over(Window.partitionBy("region").orderBy("x", "y", "z")).alias("rank"))


@query("F02_nearest_fraction", "WITH d AS (SELECT point_id, sqrt(pow(x - 700, 2) + pow(y - 150, 2)) AS d FROM fx_points2) SELECT point_id, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (ORDER BY d, point_id) <= (SELECT CAST(floor(count(*) * 0.25 + 0.5) AS BIGINT) FROM d)")
def f02(v):
    d = F.sqrt(F.pow(F.col("x") - 700, 2) + F.pow(F.col("y") - 150, 2))
    return rounded(win.nearest_fraction(v("fx_points2"), "point_id", d, 0.25), "distance").select("point_id", "distance")


@query("F03_best_candidates", "SELECT unit_id, cell_id, round(error, 6) AS error FROM fx_unit_error QUALIFY row_number() OVER (ORDER BY error, unit_id, cell_id) <= 12")
def f03(v):
    return rounded(v("fx_unit_error").orderBy("error", "unit_id", "cell_id").limit(12).select("unit_id", "cell_id", "error"), "error")


@query("F04_representative_unit", f"WITH {UNITS}, q AS (SELECT method, quantile_cont(e, 0.9) AS q FROM u GROUP BY 1), r AS (SELECT method, unit_id, row_number() OVER (PARTITION BY method ORDER BY abs(e - q), unit_id) AS k FROM u JOIN q USING (method)) SELECT method, unit_id AS unit FROM r WHERE k = 1")
def f04(v):
    return win.representative(agg.unit_means(v("fx_unit_error"), ["method", "block_id", "unit_id"]), ["method"], "unit_id", "error", 0.9)


@query("G01_union_with_tag", "SELECT 'low' AS part, point_id, round(x, 6) AS x FROM fx_points3 WHERE z < 0 UNION ALL SELECT 'high', point_id, round(x, 6) FROM fx_points3 WHERE z >= 0")
def g01(v):
    p = v("fx_points3").select("point_id", F.round("x", 6).alias("x"), "z")
    return win.tagged_union({"low": p.where("z < 0").drop("z"), "high": p.where("z >= 0").drop("z")}, "part")


@query("G02_intersect", "SELECT lin FROM fx_label WHERE region = 'A' INTERSECT SELECT lin FROM fx_label WHERE region = 'R'")
def g02(v):
    voxels = v("fx_label")
    return voxels.where("region = 'A'").select("lin").intersect(voxels.where("region = 'R'").select("lin"))


@query("G03_except", "SELECT lin FROM fx_label WHERE region = 'N' EXCEPT SELECT lin FROM fx_label WHERE region = 'R'")
def g03(v):
    voxels = v("fx_label")
    return voxels.where("region = 'N'").select("lin").distinct().join(voxels.where("region = 'R'"), "lin", "left_anti")


@query("G04_exact_cover", "SELECT region, lin, count(*) AS times FROM fx_label GROUP BY 1, 2 HAVING count(*) <> 1")
def g04(v):
    return win.multiply_assigned(v("fx_label"), ["region"], "lin")


@query("G05_equality_audit", "WITH a AS (SELECT unit_id, cell_id, method, max(error) AS error FROM fx_unit_error GROUP BY 1, 2, 3), o AS (SELECT * FROM a WHERE unit_id % 7 <> 0), n AS (SELECT unit_id, cell_id, method, CASE WHEN unit_id % 11 = 0 THEN error + 1 ELSE error END AS error FROM a WHERE unit_id % 13 <> 0) SELECT count(*) FILTER (n.error IS NULL) AS only_old, count(*) FILTER (o.error IS NULL) AS only_new, count(*) FILTER (abs(o.error - n.error) > 1e-7) AS differ_error, round(max(abs(o.error - n.error)), 6) AS max_error FROM o FULL JOIN n USING (unit_id, cell_id, method)")
def g05(v):
    keys = ["unit_id", "cell_id", "method"]
    rows = v("fx_unit_error").groupBy(*keys).agg(F.max("error").alias("error"))
    new = rows.where("unit_id % 13 <> 0").withColumn("error", F.when(F.col("unit_id") % 11 == 0, F.col("error") + 1).otherwise(F.col("error")))
    return rounded(win.equality_audit(rows.where("unit_id % 7 <> 0"), new, keys, ["error"]), "max_error")


@query("G06_unique_sites", "SELECT f1, f2, round(avg(target), 6) AS target, count(*) AS n FROM fx_features GROUP BY 1, 2")
def g06(v):
    return v("fx_features").groupBy("f1", "f2").agg(F.round(F.avg("target"), 6).alias("target"), F.count("*").alias("n"))
