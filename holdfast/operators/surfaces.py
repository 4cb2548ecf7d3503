"""Local surfaces and aligned volumes (inventory I19, I25, I30, I32, J13, J14, K04-K06, K09, K10, K12, K14)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..storage import materialise
from . import moments
from .boxes import box_search
from .matching import batched_solve
from .spatial import knn_join, nearest, searched, tree_of
from .volume import gather
from .ranks import numbered
from .windows import gaussian_smooth, gradient


def local_normals(points: DataFrame, key: str, k: int) -> DataFrame:
    """(key, nx, ny, nz, curvature): the direction of least spread among k nearest points, away from the centroid
    of all; curvature is the least eigenvalue's share. Each point's neighbourhood is reduced to its moments."""
    near = knn_join(points, points, k, ["x", "y", "z"], key, key)
    at = points.select(F.col(key).alias("neighbour_id"), "x", "y", "z")
    stats = moments.statistics(near.join(at, "neighbour_id"), ["query_id"], [F.col(c) for c in "xyz"], [F.lit(0.0)])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, m = rows["n"].to_numpy(), np.stack(rows["sx"]) / rows["n"].to_numpy()[:, None]
        upper = np.zeros((len(rows), 3, 3))
        upper[:, *np.triu_indices(3)] = np.stack(rows["xx"]) / n[:, None]
        whole = upper + np.triu(upper, 1).transpose(0, 2, 1) - m[:, :, None] * m[:, None]
        values, vectors = np.linalg.eigh(whole)
        own = {f"n{c}": vectors[:, i, 0] for i, c in enumerate("xyz")}
        return pd.DataFrame({"id": rows["query_id"], **own, "curvature": np.maximum(values[:, 0], 0) / np.maximum(values.sum(1), 1e-300)})

    kind = dict(points.dtypes)[key]
    found = batched_solve(stats, f"id {kind}, nx double, ny double, nz double, curvature double", solve).withColumnRenamed("id", key)
    centre = points.agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    out = found.join(points.select(key, "x", "y", "z"), key).crossJoin(F.broadcast(centre))
    side = geo.dot((F.col("nx"), F.col("ny"), F.col("nz")), geo.minus(geo.vec(), (F.col("cx"), F.col("cy"), F.col("cz"))))
    sign = F.when(side < 0, -1.0).otherwise(1.0)
    return out.select(key, *[(F.col(f"n{c}") * sign).alias(f"n{c}") for c in "xyz"], "curvature")


def thin_plate(queries: DataFrame, sites: DataFrame, key: str, value: str, k: int = 64, smoothing: float = 1e-3) -> DataFrame:
    """(query_id, prediction): a thin-plate spline with a linear part over the k nearest sites of each query, one
    small solve for each."""
    near = knn_join(queries, sites, k, ["x", "y"], key, key)
    at = sites.select(F.col(key).alias("neighbour_id"), "x", "y", F.col(value).alias("v"))
    place = queries.select(F.col(key).alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    rows = near.join(at, "neighbour_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "v"))).alias("s")).join(place, "query_id")
    rows = rows.select("query_id", "qx", "qy", *[F.col(f"s.{c}").alias(c) for c in ("x", "y", "v")])
    kernel = lambda d2: 0.5 * d2 * np.log(np.maximum(d2, 1e-300))

    def stacked(rows: pd.DataFrame) -> np.ndarray:
        """Predictions of queries with equally many sites: their systems are solved side by side."""
        p, v = np.stack([np.stack(rows["x"]), np.stack(rows["y"])], -1), np.stack(rows["v"])
        centre = p.mean(1, keepdims=True)
        scale = np.maximum(np.abs(p - centre).max((1, 2), keepdims=True), 1e-12)
        q = (rows[["qx", "qy"]].to_numpy()[:, None] - centre) / scale
        p = (p - centre) / scale
        b, n, _ = p.shape
        a = np.zeros((b, n + 3, n + 3))
        a[:, :n, :n] = kernel(((p[:, :, None] - p[:, None]) ** 2).sum(-1)) + smoothing * np.eye(n)
        a[:, :n, n], a[:, :n, n + 1 :] = 1, p
        a[:, n:, :n] = a[:, :n, n:].transpose(0, 2, 1)
        w = (np.linalg.pinv(a) @ np.concatenate([v, np.zeros((b, 3))], 1)[:, :, None])[:, :, 0]  # sites in one line leave the plane undetermined
        return (kernel(((p - q) ** 2).sum(-1)) * w[:, :n]).sum(1) + w[:, n] + (q[:, 0] * w[:, n + 1 :]).sum(1)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, out = rows["v"].map(len).to_numpy(), np.zeros(len(rows))
        for size in np.unique(sizes):
            places = (sizes == size).nonzero()[0]
            for at in range(0, len(places), 200):
                some = places[at : at + 200]
                out[some] = stacked(rows.iloc[some])
        return pd.DataFrame({"query_id": rows["query_id"], "prediction": out})

    return batched_solve(rows, f"query_id {dict(queries.dtypes)[key]}, prediction double", solve)


def tuned_thin_plate(points: DataFrame, key: str, value: str, block: str, k: int = 64, smoothings: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """(block, smoothing, query_id, truth, prediction): each block predicted by thin-plate splines with a linear part over the
    k nearest points of the other blocks. Its smoothing is the one with the least mean absolute error when the other
    blocks predict each other in turn (means to nine digits; ties to the smaller), without the block itself.

    One neighbour search serves all folds: the k nearest of every other block (at least), from which each fold leaves out its own. What a box
    of points has for a query is one row, so no pair is moved as a row of its own. A
    neighbourhood is decomposed once for all smoothings. Sites fewer than six give no loss; without any loss the
    least smoothing is taken. Rows with a null or NaN column are left out; a single block has no predictions. Keys are unique."""
    named = {"id": F.col(key), "own": F.col(block), "x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "v": F.col(value).cast("double")}
    p = materialise(points.select(*[c.alias(n) for n, c in named.items()]).dropna())
    others = p.select(F.col("own").alias("other")).distinct()  # folds: few by their meaning
    asks = p.select("id", "own", "x", "y").crossJoin(F.broadcast(others)).where("other <> own").drop("own")
    q = asks.select("other", F.col("id").alias("query_id"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    sites = p.select(F.col("own").alias("other"), F.col("id").alias("neighbour_id"), *[F.col(c).alias(f"p_{c}") for c in "xyv"])
    tree = tree_of(sites, k, ["x", "y"], ["other"])
    if len(tree) == 2:
        found = box_search(q, tree, k, ["x", "y"], ["other"], False, ["v"])
        site = lambda e: F.struct(e["distance"].alias("distance"), e["neighbour_id"].alias("neighbour_id"), F.col("other").alias("other"), *[e[c].alias(c) for c in "xyv"])
        lists = found.select("query_id", F.transform("s", site).alias("s")).groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    else:  # very many blocks
        near = searched(q, tree, k, ["x", "y"], ["other"], False).join(p.select(F.col("id").alias("neighbour_id"), "x", "y", "v"), "neighbour_id")
        lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id", "other", "x", "y", "v"))).alias("s"))
    rows = lists.join(p.select(F.col("id").alias("query_id"), "own", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("v").alias("truth")), "query_id")
    folds = F.array_distinct(F.concat(F.array("own"), F.col("s.other")))
    each = rows.select("query_id", "own", "truth", "qx", "qy", F.explode(folds).alias("fold"), "s").withColumn("s", F.slice(F.filter("s", lambda e: e["other"] != F.col("fold")), 1, k))
    each = each.where(F.size("s") > 0).select("query_id", "own", "truth", "qx", "qy", "fold", *[F.col(f"s.{c}").alias(c) for c in "xyv"])
    kinds = dict(each.dtypes)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(rows), len(smoothings)), np.nan)
        sizes = rows["v"].map(len).to_numpy()
        for size in np.unique(sizes):
            places = (sizes == size).nonzero()[0]
            for at in range(0, len(places), 200):
                some = rows.iloc[places[at : at + 200]]
                p = np.stack([np.stack(some["x"]), np.stack(some["y"])], -1)
                out[places[at : at + 200]] = plates(p, np.stack(some["v"]), some[["qx", "qy"]].to_numpy(), smoothings)
        return rows[["query_id", "own", "fold", "truth"]].assign(n=sizes, guess=list(out))

    schema = f"query_id {kinds['query_id']}, own {kinds['own']}, fold {kinds['fold']}, truth double, n long, guess array<double>"
    guessed = materialise(batched_solve(each, schema, solve))
    losses = guessed.where("fold <> own AND n >= 6").select("fold", "truth", F.posexplode("guess").alias("place", "g"))
    mean = losses.groupBy("fold", "place").agg(F.round(F.avg(F.abs(F.col("g") - F.col("truth"))), 9).alias("loss"))
    chosen = mean.groupBy("fold").agg(F.min(F.struct("loss", "place"))["place"].alias("place"))
    out = guessed.where("fold = own").join(chosen, "fold", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    pick = F.get(F.array(*map(F.lit, smoothings)), F.col("place"))
    return out.select(F.col("fold").alias("block"), pick.alias("smoothing"), "query_id", "truth", F.get("guess", F.col("place")).alias("prediction"))


def plates(p: np.ndarray, v: np.ndarray, q: np.ndarray, smoothings: tuple[float, ...]) -> np.ndarray:
    """(queries, smoothings): smoothed thin-plate splines of stacked sites p with values v at q. Weights are free of the
    linear part, so one decomposition of the kernel beside it serves every smoothing; lengths are in units of the sites' reach."""
    kernel = lambda d2: 0.5 * d2 * np.log(np.maximum(d2, 1e-300))
    centre = p.mean(1, keepdims=True)
    scale = np.maximum(np.abs(p - centre).max((1, 2), keepdims=True), 1e-12)
    q, p = (q[:, None] - centre) / scale, (p - centre) / scale
    one = np.ones((*p.shape[:2], 1))
    line = np.concatenate([one, p], 2)
    back = np.linalg.pinv(line, rcond=1e-9)
    free = np.eye(p.shape[1]) - line @ back
    k = kernel(((p[:, :, None] - p[:, None]) ** 2).sum(-1))
    e, u = np.linalg.eigh(free @ k @ free)
    part = (u.transpose(0, 2, 1) @ (free @ v[:, :, None]))[:, :, 0]
    to = kernel(((p - q) ** 2).sum(-1))
    here = np.concatenate([np.ones((len(q), 1)), q[:, 0]], 1)
    out = []
    for s in smoothings:
        w = (u @ (part / (np.maximum(e, 0) + s))[:, :, None])[:, :, 0]
        c = (back @ (v - (k @ w[:, :, None])[:, :, 0] - s * w)[:, :, None])[:, :, 0]
        out.append((to * w).sum(1) + (here * c).sum(1))
    return np.stack(out, 1)


def derivative_maps(surface: DataFrame, value: str, sigmas: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sigma, i, j, smooth, slope, laplacian, determinant, anisotropy) of height maps at several scales."""
    out = []
    for s in sigmas:
        a = gaussian_smooth(gaussian_smooth(surface, [*by, "j"], "i", value, s), [*by, "i"], "j", "smooth", s, "f")
        a = materialise(a)
        gi = gradient(a, [*by, "j"], "i", "f").withColumnRenamed("gradient", "fi")
        g = gradient(gi, [*by, "i"], "j", "f").withColumnRenamed("gradient", "fj")
        h = gradient(g, [*by, "j"], "i", "fi").withColumnRenamed("gradient", "fii")
        h = gradient(h, [*by, "i"], "j", "fi").withColumnRenamed("gradient", "fij")
        h = gradient(h, [*by, "i"], "j", "fj").withColumnRenamed("gradient", "fjj")
        mid, gap = (F.col("fii") + F.col("fjj")) / 2, F.sqrt(F.pow((F.col("fii") - F.col("fjj")) / 2, 2) + F.pow("fij", 2))
        out.append(h.select(*by, F.lit(float(s)).alias("sigma"), "i", "j", F.col("f").alias("smooth"), F.hypot("fi", "fj").alias("slope"), (F.col("fii") + F.col("fjj")).alias("laplacian"), (F.col("fii") * F.col("fjj") - F.col("fij") * F.col("fij")).alias("determinant"), (gap / F.when(F.abs(mid) + gap > 0, F.abs(mid) + gap)).alias("anisotropy")))
    return reduce(DataFrame.unionByName, out)


def aligned_volume(units: DataFrame, cells: DataFrame, key: str, grid: DataFrame, depths: list[float], value: str = "value") -> DataFrame:
    """(key, gi, gj, depth, value): interpolated samples along each unit's own frame: u and v across its unit
    normal (nx, ny, nz), depth against it. grid: gi, gj, u, v."""
    n = (F.col("nx"), F.col("ny"), F.col("nz"))
    a, b = geo.tangent_frame(n)
    frames = units.select(key, *[F.col(c) for c in "xyz"], *[c.alias(f"a{k}") for k, c in zip("xyz", a, strict=True)], *[c.alias(f"b{k}") for k, c in zip("xyz", b, strict=True)], "nx", "ny", "nz")
    spread = frames.crossJoin(F.broadcast(grid)).select("*", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    place = [(F.col(c) + F.col("u") * F.col(f"a{c}") + F.col("v") * F.col(f"b{c}") - F.col("depth") * F.col(f"n{c}")).alias(f"p{c}") for c in "xyz"]
    samples = spread.select(F.struct(key, "gi", "gj", "depth").alias("at"), *place)
    out = gather(samples, cells, "at", ["px", "py", "pz"], ["i", "j", "k"], value)
    return out.select("at.*", "value")


def shell_features(samples: DataFrame, key: str) -> DataFrame:
    """Mean and deviation at each depth of an aligned volume, and the profile's steps between depths."""
    d = samples.groupBy(key, "depth").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    w = Window.partitionBy(key).orderBy("depth")
    step = F.col("mean") - F.lag("mean").over(w)
    d = d.withColumn("step", step)
    return d.withColumn("bend", F.col("step") - F.lag("step").over(w))


def unfolded_patch(points: DataFrame, key: str, centre: int, radius: float) -> DataFrame:
    """(key, u, v, height, fitted) of the points around one: their own principal chart, and the quadratic surface
    over it."""
    c = points.where(F.col(key) == centre).select(*[F.col(d).alias(f"o{d}") for d in "xyz"])
    near = points.crossJoin(F.broadcast(c)).where(F.sqrt(sum(((F.col(d) - F.col(f"o{d}")) * (F.col(d) - F.col(f"o{d}")) for d in "xyz"), F.lit(0.0))) <= radius).withColumn("one", F.lit(1))
    near = materialise(near)
    axes = {r["axis"]: r["direction"] for r in moments.principal_axes(near, ["one"], ["x", "y", "z"]).collect()}
    mean = near.agg(*[F.avg(d) for d in "xyz"]).first()
    local = [sum(((F.col(d) - float(m)) * float(a) for d, m, a in zip("xyz", mean, axes[k], strict=True)), F.lit(0.0)) for k in range(3)]
    chart = near.select(key, "one", local[0].alias("u"), local[1].alias("v"), local[2].alias("height"))
    terms = list(geo.polynomial(["u", "v"], 2).values())
    beta = moments.coefficients(moments.statistics(chart, ["one"], terms, [F.col("height")]), ["one"], moments.least_squares, len(terms)).drop("n")
    return chart.join(F.broadcast(beta), "one").select(key, "u", "v", "height", moments.predicted(terms, intercept=False).alias("fitted"))


def unfolded_stack(points: DataFrame, cells: DataFrame, key: str, centre: int, half: float, margin: float, step: float, depth: int, label: str, inner: int) -> DataFrame:
    """(gu, gv, depth, value, label): the voxels (i, j, k, value, label) along the normals of a surface, in layers 0 to
    `depth` steps deep. The surface is a quadratic over the principal chart of the points within half + margin of one
    point, gridded from -half to half. Inward is the side on which the normal of the middle meets label `inner` more often
    (equal: the negative side). Values are interpolated, 0 where a corner has no voxel; labels are those of the
    nearest voxel, 0 where there is none. An unknown point, or fewer than six around it, is an error."""
    seed = points.where(F.col(key) == centre).select("x", "y", "z").orderBy("x", "y", "z").first()
    if seed is None:
        raise ValueError(f"no point {centre}")
    away = sum(((F.col(d) - seed[d]) * (F.col(d) - seed[d]) for d in "xyz"), F.lit(0.0))
    near = materialise(points.where(F.sqrt(away) < half + margin).select("x", "y", "z").withColumn("one", F.lit(1)))
    axes = {r["axis"]: r["direction"] for r in moments.principal_axes(near, ["one"], ["x", "y", "z"]).collect()}
    local = [sum(((F.col(d) - seed[d]) * float(a) for d, a in zip("xyz", axes[k], strict=True)), F.lit(0.0)).alias(n) for k, n in enumerate("uvw")]
    chart = near.select("one", *local).where((F.abs("u") <= half + 0.4 * margin) & (F.abs("v") <= half + 0.4 * margin))
    terms = geo.polynomial(["u", "v"], 2)
    fit = moments.coefficients(moments.statistics(chart, ["one"], list(terms.values()), [F.col("w")]), ["one"], moments.least_squares, len(terms)).first()
    if fit is None or fit["n"] < len(terms):
        raise ValueError(f"too few points around point {centre}")
    c = dict(zip(terms, map(float, fit["beta"]), strict=True))
    reach = int(half / step + 1e-9)
    grid = near.sparkSession.range((2 * reach + 1) ** 2).select((F.floor(F.col("id") / (2 * reach + 1)) - reach).alias("gu"), (F.col("id") % (2 * reach + 1) - reach).alias("gv"))
    grid = grid.select("gu", "gv", (F.col("gu") * step).alias("u"), (F.col("gv") * step).alias("v"))
    w = sum((c[n] * t for n, t in terms.items()), F.lit(0.0))
    du = c["u"] + 2 * c["u_u"] * F.col("u") + c["u_v"] * F.col("v")
    dv = c["v"] + c["u_v"] * F.col("u") + 2 * c["v_v"] * F.col("v")
    ax = [dict(zip("xyz", map(float, axes[k]), strict=True)) for k in range(3)]
    long = F.sqrt(1 + du * du + dv * dv)  # the axes are orthonormal
    surface = grid.select("gu", "gv", *[(seed[d] + F.col("u") * ax[0][d] + F.col("v") * ax[1][d] + w * ax[2][d]).alias(d) for d in "xyz"], *[((ax[2][d] - du * ax[0][d] - dv * ax[1][d]) / long).alias(f"n{d}") for d in "xyz"])
    labels = cells.select(*[F.col(i).cast("long").alias(f"c{d}") for d, i in zip("xyz", "ijk", strict=True)], F.col(label).alias("hf_label"))

    def along(rows: DataFrame, signed: Column) -> DataFrame:
        return rows.select("gu", "gv", "deep", *[(F.col(d) + signed * F.col(f"n{d}")).alias(f"p{d}") for d in "xyz"])

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"c{d}": F.floor(F.col(f"p{d}") + 0.5) for d in "xyz"}).join(labels, ["cx", "cy", "cz"], "left")

    middle = surface.where("gu = 0 AND gv = 0").select("*", F.explode(F.sequence(F.lit(-depth), F.lit(depth))).alias("deep")).where("deep <> 0")
    met = labelled(along(middle, F.col("deep") * step)).where(F.col("hf_label") == inner)
    sides = met.agg(F.count_if(F.col("deep") > 0), F.count_if(F.col("deep") < 0)).first()
    sign = 1.0 if sides[0] > sides[1] else -1.0
    layers = along(surface.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("deep")), F.col("deep") * (sign * step))
    kept = materialise(labelled(layers).withColumn("at", F.struct("gu", "gv", "deep")))
    values = gather(kept.select("at", "px", "py", "pz"), cells, "at", ["px", "py", "pz"], ["i", "j", "k"], "value")
    return kept.join(values, "at").select("gu", "gv", F.col("deep").alias("depth"), F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("hf_label", F.lit(0)).alias("label"))


def turned_patches(patches: DataFrame, key: str, value: str, settings: list[tuple[float, float, float, float]]) -> DataFrame:
    """(setting, key, da, db, value): patches resampled under (angle, scale, shift a, shift b) around their centre;
    beyond the edge the nearest cell counts."""
    names = patches.sparkSession.createDataFrame([(i, *map(float, s)) for i, s in enumerate(settings)], "setting int, angle double, scale double, sa double, sb double")
    ends = Window.partitionBy(key)
    p = patches.select(key, "da", "db", *[f("d" + c).over(ends).cast("double").alias(f"{n}{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))]).crossJoin(F.broadcast(names))
    ca, sa = F.cos("angle") / F.col("scale"), F.sin("angle") / F.col("scale")
    a, b = F.col("da") - F.col("sa"), F.col("db") - F.col("sb")
    clamp = lambda x, c: F.greatest(F.col(f"lo{c}"), F.least(F.col(f"hi{c}"), x))
    q = p.select(F.struct("setting", key, "da", "db").alias("at"), F.col(key).cast("double").alias("unit"), clamp(ca * a + sa * b, "a").alias("pa"), clamp(ca * b - sa * a, "b").alias("pb"))
    return gather(q, patches, "at", ["unit", "pa", "pb"], [key, "da", "db"], value).select("at.*", "value")


def offset_scan(surface: DataFrame, cells: DataFrame, key: str, offsets: list[tuple[float, float, float]], depth: float) -> DataFrame:
    """(offset, gradient, contrast, score): for each shift of a surface (x, y, z, normal), the mean step of values
    across it and their inside-outside contrast; score adds both as robust z."""
    names = surface.sparkSession.createDataFrame([(i, *map(float, o)) for i, o in enumerate(offsets)], "offset int, dx double, dy double, dz double")
    spread = surface.crossJoin(F.broadcast(names)).select("*", F.explode(F.array(*map(F.lit, (-depth, 0.0, depth)))).alias("along"))
    q = spread.select(F.struct("offset", key, "along").alias("at"), *[(F.col(c) + F.col(f"d{c}") + F.col("along") * F.col(f"n{c}")).alias(f"p{c}") for c in "xyz"])
    got = gather(q, cells, "at", ["px", "py", "pz"], ["i", "j", "k"], "value").select("at.*", "value")
    wide = got.groupBy("offset", key).pivot("along", [-depth, 0.0, depth]).agg(F.first("value")).toDF("offset", key, "inside", "on", "outside")
    each = wide.groupBy("offset").agg(F.avg(F.abs(F.col("outside") - F.col("inside")) / (2 * depth)).alias("gradient"), (F.avg("inside") - F.avg("outside")).alias("contrast")).withColumn("one", F.lit(1))
    whole = each.groupBy("one").agg(*[F.median(c).alias(f"m_{c}") for c in ("gradient", "contrast")])
    off = each.join(F.broadcast(whole), "one")
    mad = off.groupBy("one").agg(*[F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"d_{c}") for c in ("gradient", "contrast")])
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / (1.4826 * F.col(f"d_{c}") + 1e-9)
    return off.join(F.broadcast(mad), "one").select("offset", "gradient", "contrast", (z("gradient") + z("contrast")).alias("score"))


def registration_check(a: DataFrame, b: DataFrame, key: str, most: float) -> DataFrame:
    """(fitted, error): an affine map from landmarks a to b by every other one, its largest error on those and on
    the rest. An error over `most` on the rest fails when the row is computed."""
    rows = a.join(b.select(key, *[F.col(c).alias(f"b{c}") for c in "xyz"]), key).withColumn("one", F.lit(1))
    rows = numbered(rows, ["one"], [key], "hf_i").withColumn("fitted", F.col("hf_i") % 2 == 1)
    terms = [F.lit(1.0), *map(F.col, "xyz")]
    beta = moments.coefficients(moments.statistics(rows.where("fitted"), ["one"], terms, [F.col(f"b{c}") for c in "xyz"]), ["one"], moments.least_squares, 4, 3).drop("n")
    off = [F.col(f"b{c}") - moments.predicted(terms, intercept=False, target=i, targets=3) for i, c in enumerate("xyz")]
    e = rows.join(F.broadcast(beta), "one").groupBy("fitted").agg(F.sqrt(F.max(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])).alias("error"))
    return e.withColumn("error", F.when(F.col("fitted") | (F.col("error") <= most), F.col("error")).otherwise(F.raise_error(F.lit("registration error is too large")).cast("double")))


def automatic_crop(mask: DataFrame, radius: float, size: tuple[int, int], sigma: float = 2.0) -> DataFrame:
    """(ci, cj, lo_i, lo_j): the highest smoothed envelope among columns whose distance to an empty column is over
    `radius`, with a crop of a size around it that stays inside."""
    top = mask.groupBy("i", "j").agg(F.max("k").alias("top"))
    ends = mask.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    spark = mask.sparkSession
    around = spark.range(ends[0] - 1, ends[1] + 2).withColumnRenamed("id", "i").crossJoin(spark.range(ends[2] - 1, ends[3] + 2).withColumnRenamed("id", "j"))
    grid = around.join(top, ["i", "j"], "left").withColumn("id", F.struct("i", "j"))
    empty = grid.where("top is null")
    far = nearest(grid.where("top is not null"), empty, ["i", "j"], "id", "id").where(F.col("distance") > radius).select(F.col("query_id").alias("id"))
    full = grid.withColumn("top", F.coalesce("top", F.lit(0)).cast("double"))
    smooth = gaussian_smooth(gaussian_smooth(full, ["j"], "i", "top", sigma), ["i"], "j", "smooth", sigma, "f").withColumn("id", F.struct("i", "j"))
    best = smooth.join(far, "id").agg(F.max(F.struct("f", (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))).alias("m")).select((-F.col("m.ni")).alias("ci"), (-F.col("m.nj")).alias("cj"))
    lo = lambda c, n, a, b: F.greatest(F.lit(a), F.least(F.col(c) - n // 2, F.lit(b - n + 1)))
    return best.select("ci", "cj", lo("ci", size[0], ends[0], ends[1]).alias("lo_i"), lo("cj", size[1], ends[2], ends[3]).alias("lo_j"))


def edge_region(cells: DataFrame, threshold: float, centre: tuple[int, int, int]) -> DataFrame:
    """(i, j, top): the component below a threshold through a cell, and its first place in each column."""
    from .graph import grid_components

    low = cells.where(F.col("value") < threshold).select(F.lit(1).alias("one"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"))
    parts = materialise(grid_components(low, ["one"]))
    own = parts.where((F.col("i") == centre[0]) & (F.col("j") == centre[1]) & (F.col("k") == centre[2])).select("component")
    return parts.join(F.broadcast(own), "component", "left_semi").groupBy("i", "j").agg(F.min("k").alias("top"))


FILLS = ("uncalibrated", "quadratic", "rbf", "template", "template_residual", "guarded")


def gap_predictions(
    cells: DataFrame, unit: str, block: str, masks: dict[str, Column], value: str, u: str = "u", v: str = "v", cell: tuple[str, str] = ("gi", "gj"), least_masked: int = 12, least_visible: int = 20,
    sigma: float = 0.25, alphas: tuple[float, float, float] = (0.1, 10.0, 0.1), centres: list[tuple[float, float]] | None = None, most: int = 20_000,
) -> DataFrame:
    """(unit, mask, cell, value, visible, and six fills) of every hidden cell of each unit and mask with enough hidden
    and visible cells. uncalibrated: the median of the cell over the units of other blocks; quadratic and rbf: ridge
    over the unit's own visible cells, of quadratic terms, and of these with Gaussian bumps; template: the uncalibrated
    one scaled and shifted by ridge on the visible cells; template_residual: that with an rbf ridge of its visible
    residuals; guarded: the same correction kept near the median visible residual (three robust deviations) and
    fading with the distance to the nearest visible cell. alphas: of quadratic, rbf, calibration.

    Nothing that is hidden is read for its own unit and mask: templates come from other blocks, the rest from visible
    cells. Cells that no other block has are left out. A unit's grid of over `most` cells is an error: one
    unit and mask is one small solve."""
    from .aggregates import template_stack

    template = template_stack(cells, block, list(cell), value).withColumnRenamed("held_out", block)
    flags = F.explode(F.array(*[F.struct(F.lit(n).alias("mask"), c.alias("hidden")) for n, c in masks.items()]))
    rows = cells.select(unit, block, *cell, F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"), F.col(value).cast("double").alias("y"), flags.alias("m"))
    rows = rows.join(template, [block, *cell]).select(unit, *cell, "u", "v", "y", "m.*", F.col("template").cast("double").alias("t"))
    bumps = np.array(geo.rbf_centres() if centres is None else centres)
    kinds = dict(rows.dtypes)

    def ridge(x: np.ndarray, y: np.ndarray, alpha: float, scaled: bool = True):
        m, d = x.mean(0), x.std(0) if scaled else np.ones(x.shape[1])
        d = np.where(d < 1e-12, 1.0, d)
        z = (x - m) / d
        b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
        return lambda q: y.mean() + (q - m) / d @ b

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most:
            raise ValueError(f"a unit has over {most} cells")
        frame = frame.sort_values(list(cell), ignore_index=True)  # sums don't depend on how rows were dealt
        hidden = frame["hidden"].to_numpy(bool)
        own = frame.loc[hidden, [unit, "mask", *cell]].assign(value=frame.loc[hidden, "y"], visible=int((~hidden).sum()))
        if hidden.sum() < least_masked or (~hidden).sum() < least_visible:
            return own.iloc[:0].assign(**dict.fromkeys(FILLS, 0.0))
        at, y, t = frame[["u", "v"]].to_numpy(), frame["y"].to_numpy()[~hidden], frame[["t"]].to_numpy()
        quadratic = np.c_[at, at**2, at[:, :1] * at[:, 1:]]
        flexible = np.c_[quadratic, np.exp(-((at[:, None] - bumps) ** 2).sum(2) / (2 * sigma**2))]
        calibrated = ridge(t[~hidden], y, alphas[2], False)(t)
        residual = y - calibrated[~hidden]
        correction = ridge(flexible[~hidden], residual, alphas[1])(flexible[hidden])
        middle = np.median(residual)
        reach = max(3 * 1.4826 * np.median(np.abs(residual - middle)), 0.05)
        gap = np.array([((at[~hidden] - q) ** 2).sum(1).min() for q in at[hidden]])
        found = (
            t[hidden, 0], ridge(quadratic[~hidden], y, alphas[0])(quadratic[hidden]), ridge(flexible[~hidden], y, alphas[1])(flexible[hidden]), calibrated[hidden],
            calibrated[hidden] + correction, calibrated[hidden] + np.exp(-0.5 * gap / sigma**2) * np.clip(correction, middle - reach, middle + reach),
        )
        return own.assign(**dict(zip(FILLS, found, strict=True)))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (unit, "mask", *cell)), "value double, visible long", *(f"{f} double" for f in FILLS)])
    return rows.groupBy(unit, "mask").applyInPandas(solve, schema)


def gap_fill(cells: DataFrame, unit: str, block: str, masks: dict[str, Column], value: str, **settings) -> DataFrame:
    """(unit, mask, hidden, visible, mean absolute errors of the six fills on hidden cells); see gap_predictions."""
    rows = gap_predictions(cells, unit, block, masks, value, **settings)
    return rows.groupBy(unit, "mask").agg(F.count("*").alias("hidden"), F.first("visible").alias("visible"), *[F.avg(F.abs(F.col(f) - F.col("value"))).alias(f) for f in FILLS])


def residual_template(cells: DataFrame, fold: str, unit: str, cell: list[str], value: str) -> DataFrame:
    """Each cell with the unit's own background (median), contrast (p95 - p5, 1 at least) and the prediction
    background + contrast * median scaled residual of the other folds' units."""
    own = cells.groupBy(unit).agg(F.median(value).alias("background"), F.greatest(F.percentile(value, F.lit(0.95)) - F.percentile(value, F.lit(0.05)), F.lit(1.0)).alias("contrast"))
    scaled = cells.join(own, unit).withColumn("hf_r", (F.col(value) - F.col("background")) / F.col("contrast"))
    from .aggregates import template_stack

    t = template_stack(scaled, fold, cell, "hf_r").withColumnRenamed("held_out", fold)
    return scaled.join(t, [fold, *cell]).withColumn("prediction", F.col("background") + F.col("contrast") * F.col("template")).drop("hf_r")
