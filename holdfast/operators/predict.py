"""Predictors and their scores (inventory I11-I36)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from . import holdout, moments
from .ranks import quantiles
from .spatial import idw, knn_join


def compare_splits(points: DataFrame, key: str, x: str, y: str, value: str, k: int = 6, share: float = 0.25, buffer: float = 0.12, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(scores, predictions): inverse-distance means of k training neighbours for the three holdouts, against the
    training mean. All strategies run in one plan, keyed by strategy. A strategy without training rows keeps its
    row with null scores; r2 is null where the target is constant."""
    roles = materialise(holdout.make_splits(points, key, x, y, share, buffer, seed))
    rows = roles.join(points.select(key, x, y, value), key)
    test, train = rows.where("assignment = 'test'"), rows.where("assignment = 'train'")
    found = idw(knn_join(test, train, k, [x, y], key, key, ("strategy",)), train, key, value, by=("strategy",)).withColumnRenamed("query_id", key)
    base = train.groupBy("strategy").agg(F.avg(value).alias("hf_mean"), F.count("*").alias("train"))
    scored = test.join(found, ["strategy", key], "left").join(F.broadcast(base), "strategy", "left")
    e, b = F.col("prediction") - F.col(value), F.col("hf_mean") - F.col(value)
    ss = F.var_pop(value) * F.count(value)
    scores = scored.groupBy("strategy").agg(
        F.first("train").alias("train"), F.count("*").alias("test"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(ss > 0, 1 - F.sum(e * e) / ss).alias("r2"), F.sqrt(F.avg(b * b)).alias("mean_rmse"), F.avg("nearest").alias("mean_nearest"),
    )
    return scores, scored.select("strategy", key, "prediction", "nearest")


def surface_from_neighbours(neighbours: DataFrame, surfaces: DataFrame, key: str, cell: list[str], value: str, power: float = 2.0) -> DataFrame:
    """Weighted mean of whole neighbouring surfaces, cell by cell."""
    s = surfaces.select(F.col(key).alias("neighbour_id"), *cell, F.col(value).alias("hf_v"))
    w = 1 / F.pow(F.greatest("distance", F.lit(1e-12)), F.lit(power))
    return neighbours.join(s, "neighbour_id").groupBy("query_id", *cell).agg((F.sum(w * F.col("hf_v")) / F.sum(w)).alias("prediction"))


def depth_and_shape(neighbours: DataFrame, cells: DataFrame, key: str, cell: str, value: str) -> DataFrame:
    """Unit level by inverse-square mean of neighbours' medians, plus the shared median residual shape."""
    level = cells.groupBy(key).agg(F.median(value).alias("level"))
    shape = cells.join(level, key).groupBy(cell).agg(F.median(F.col(value) - F.col("level")).alias("shape"))
    units = idw(neighbours, level, key, "level", 2.0).select("query_id", F.col("prediction").alias("level"))
    return units.crossJoin(F.broadcast(shape)).select("query_id", cell, (F.col("level") + F.col("shape")).alias("prediction"))


def vector_idw(queries: DataFrame, sites: DataFrame, dims: list[str], key: str, values: list[str], k: int = 16) -> DataFrame:
    """Inverse-square means of the k nearest sites' vectors, normalised; a query on a site is an error. Sites that
    share coordinates are averaged first."""
    merged = sites.groupBy(*dims).agg(F.min(key).alias(key), *[F.avg(v).alias(v) for v in values])
    near = knn_join(queries, merged, k, dims, key, key)
    w = F.when(F.col("distance") > 0, 1 / (F.col("distance") * F.col("distance"))).otherwise(F.raise_error(F.lit("a query lies on a site")).cast("double"))
    n = near.withColumn("hf_w", w).join(merged.select(F.col(key).alias("neighbour_id"), *values), "neighbour_id")
    out = n.groupBy("query_id").agg(*[F.sum(F.col("hf_w") * F.col(v)).alias(v) for v in values])
    size = F.sqrt(reduce(lambda a, b: a + b, [F.col(v) * F.col(v) for v in values]))
    return out.select("query_id", *[(F.col(v) / size).alias(v) for v in values])


def two_stage(df: DataFrame, block: str, spatial: list[Column], family: list[Column], target: str, alpha: float = 1.0) -> DataFrame:
    """Ridge on spatial terms, then ridge of its residual on a feature family, both from the other blocks. The
    second stage's residuals are those of the first stage fitted on the same training blocks; they follow from
    joint statistics, so no row is read again for each fold."""
    terms, y = [*spatial, *family], F.col(target)
    p, q = len(spatial), len(family)
    stats = moments.without_own(materialise(moments.statistics(df, [block], terms, [y])), block)

    def both(row: dict, n_terms: int, t: int):
        import numpy as np

        square = moments._square(row["xx"], n_terms)
        part = lambda i: {"n": row["n"], "s": row["s"], "sx": list(np.array(row["sx"])[i]), "sy": row["sy"], "xx": square[np.ix_(i, i)][np.triu_indices(len(i))], "xy": np.array(row["xy"])[i]}
        first = list(range(p))
        b = moments.ridge(alpha)(part(first), p, 1).ravel()
        last = list(range(p, p + q))
        r = part(last)
        sx = np.array(row["sx"])
        r["sy"] = [row["sy"][0] - b[0] * row["s"] - float(b[1:] @ sx[:p])]
        r["xy"] = np.array(row["xy"])[last] - b[0] * sx[last] - square[np.ix_(last, first)] @ b[1:]
        return np.concatenate([b, moments.ridge(alpha)(r, q, 1).ravel()])[:, None]

    beta = moments.coefficients(stats, [block], both, p + q).drop("n")
    out = df.join(beta, block)
    second = moments.predicted(family, "hf_tail")
    return out.withColumn("hf_tail", F.slice("beta", p + 2, q + 1)).withColumns({"stage1": moments.predicted(spatial), "stage2": second}).withColumn("prediction", F.col("stage1") + F.col("stage2")).drop("hf_tail", "beta")


def tuned_ridge(df: DataFrame, block: str, unit: str, xs: list[Column], target: str, alphas: list[float]) -> DataFrame:
    """(outer, alpha, score): for each outer fold and alpha the median over inner blocks of the mean unit error.
    Statistics of every pair of left-out blocks come from one block table; rows are read once more, for the
    predictions of all candidates together."""
    stats = materialise(moments.statistics(df, [block], xs, [F.col(target)]))
    names = [r[0] for r in stats.select(block).orderBy(block).collect()]
    inner = None
    for outer in names:
        part = moments.without_own(stats.where(F.col(block) != outer), block).withColumn("outer", F.lit(outer))
        inner = part if inner is None else inner.unionByName(part)
    fitted = [moments.coefficients(inner, ["outer", block], moments.ridge(a), len(xs)).withColumn("alpha", F.lit(float(a))) for a in alphas]
    models = materialise(reduce(DataFrame.unionByName, fitted).drop("n"))
    each = models.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("outer", "alpha", "beta"))).alias("hf_m"))  # a row for each block
    errors = [F.abs(moments.predicted(xs, F.get("hf_m", F.lit(i))["beta"]) - F.col(target)) for i in range((len(names) - 1) * len(alphas))]
    units = df.join(F.broadcast(each), block).groupBy(block, unit).agg(*[F.avg(e).alias(f"hf_e{i}") for i, e in enumerate(errors)])
    units = materialise(units).join(F.broadcast(each), block)
    long = F.explode(F.array(*[F.struct(F.get("hf_m", F.lit(i))["outer"].alias("outer"), F.get("hf_m", F.lit(i))["alpha"].alias("alpha"), F.col(f"hf_e{i}").alias("e")) for i in range(len(errors))]))
    blocks = quantiles(units.select(block, long.alias("s")).select(block, "s.*"), ["outer", "alpha", block], "e", {"e": 0.5})
    scores = blocks.groupBy("outer", "alpha").agg(F.median("e").alias("score"))
    return models.select("outer", "alpha").distinct().join(scores, ["outer", "alpha"], "left")


def offset_calibration(cases: DataFrame, block: str, offset: str) -> DataFrame:
    """Each case with the median offset of the other blocks, before and after."""
    shift = quantiles(holdout.dealt(cases, block, "hf_fold", False), ["hf_fold"], offset, {"shift": 0.5}).drop("n")
    out = cases.join(F.broadcast(shift), F.col(block) == F.col("hf_fold"), "left").drop("hf_fold")  # a row for each fold
    return out.withColumns({"before": F.abs(offset), "after": F.abs(F.col(offset) - F.col("shift"))})


def penalised_choice(losses: DataFrame, case: str, k: str, loss: str, lambdas: list[float], centre: int = 3) -> DataFrame:
    """(penalty, case, choice): the count with the smallest loss + penalty * (k - centre), smallest on ties."""
    best = [F.min_by(k, F.struct(F.col(loss) + F.lit(x) * (F.col(k) - centre), F.col(k))).alias(f"hf_{i}") for i, x in enumerate(lambdas)]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("penalty"), F.col(f"hf_{i}").alias("choice")) for i, x in enumerate(lambdas)]))
    return losses.groupBy(case).agg(*best).select(case, each.alias("hf_s")).select("hf_s.penalty", case, "hf_s.choice")


def lambda_choice(chosen: DataFrame, truth: str) -> DataFrame:
    """Penalties by accuracy (down), mean absolute error, and size."""
    return chosen.groupBy("penalty").agg(F.avg((F.col("choice") == F.col(truth)).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("choice") - F.col(truth))).alias("mae")).orderBy(F.col("accuracy").desc(), "mae", "penalty")


def apply_frozen(df: DataFrame, model: DataFrame, terms: dict[str, Column], term: str = "term", value: str = "value") -> DataFrame:
    """df with the dot product of named terms and a frozen model's small table. Nothing is fitted, so df may also
    be a stream."""
    weights = {r[0]: r[1] for r in model.select(term, value).collect()}
    if unknown := sorted(weights.keys() - terms.keys()):
        raise ValueError(f"model has terms that the data hasn't: {', '.join(unknown)}")
    total = F.lit(0.0)
    for name, w in sorted(weights.items()):
        total = total + terms[name] * F.lit(float(w))
    return df.withColumn("prediction", total)


def path_fits(tracks: DataFrame, track: str, depth: str, r: str, c: str, degree: int) -> DataFrame:
    """Root mean square and end-point error of polynomial fits of both coordinates over each path's own depth,
    scaled to 0..1."""
    w = Window.partitionBy(track)
    lo, hi = F.min(depth).over(w), F.max(depth).over(w)
    t = tracks.withColumns({"t": F.when(hi > lo, (F.col(depth) - lo) / (hi - lo)).otherwise(0.0), "hf_end": F.col(depth) == hi, "hf_n": F.count("*").over(w)}).where(F.col("hf_n") > degree + 1)
    xs = [F.pow("t", F.lit(float(i))) for i in range(degree + 1)]
    beta = moments.coefficients(moments.statistics(t, [track], xs, [F.col(r), F.col(c)]), [track], moments.least_squares, degree + 1, 2).drop("n")
    off = [F.col(v) - moments.predicted(xs, intercept=False, target=i, targets=2) for i, v in enumerate((r, c))]
    e = t.join(beta, track).withColumn("hf_e", off[0] * off[0] + off[1] * off[1])
    return e.groupBy(track).agg(F.count("*").alias("nodes"), F.sqrt(F.avg("hf_e")).alias("rmse"), F.sqrt(F.max(F.when(F.col("hf_end"), F.col("hf_e")))).alias("end_error"))


def path_cv(tracks: DataFrame, track: str, depth: str, r: str, c: str, degrees: tuple[int, ...] = (1, 2), folds: int = 5) -> DataFrame:
    """(track, degree, error): median error over contiguous folds, each predicted by a fit of the others (total
    minus own statistics)."""
    w = Window.partitionBy(track)
    t = tracks.withColumns({"hf_n": F.count("*").over(w), "hf_i": F.row_number().over(w.orderBy(depth)) - 1}).where(F.col("hf_n") >= 2 * folds)
    t = t.withColumns({"fold": F.floor(folds * F.col("hf_i") / F.col("hf_n")), "t": F.col("hf_i") / F.col("hf_n")})
    parts = []
    for d in degrees:
        xs = [F.pow("t", F.lit(float(i))) for i in range(d + 1)]
        stats = moments.without_own(materialise(moments.statistics(t, [track, "fold"], xs, [F.col(r), F.col(c)])), "fold", (track,))
        beta = moments.coefficients(stats, [track, "fold"], moments.least_squares, d + 1, 2).drop("n")
        off = [F.col(v) - moments.predicted(xs, intercept=False, target=i, targets=2) for i, v in enumerate((r, c))]
        e = t.join(beta, [track, "fold"]).groupBy(track).agg(F.median(F.sqrt(off[0] * off[0] + off[1] * off[1])).alias("error"))
        parts.append(e.withColumn("degree", F.lit(d)))
    return reduce(DataFrame.unionByName, parts)


def mapping_choice(df: DataFrame, by: list[str], xs: list[str], ys: list[str]) -> DataFrame:
    """(by, translation, affine, choice): median leave-one-out errors of a median offset and of an affine map, and
    the smaller one's name. Leave-one-out medians take the shifted rank; affine residuals are e / (1 - h)."""
    w = Window.partitionBy(*by)
    rows = materialise(df.withColumn("hf_id", F.monotonically_increasing_id()))
    off = rows
    for x, y in zip(xs, ys, strict=True):
        d = F.col(y) - F.col(x)
        off = off.withColumns({"hf_d": d, "hf_r": F.row_number().over(Window.partitionBy(*by).orderBy(d, "hf_id")), "hf_n": F.count("*").over(w)})
        lo, hi = F.floor((F.col("hf_n") - 2) / 2), F.ceil((F.col("hf_n") - 2) / 2)  # places, from 0, of the other rows' middle
        middle = F.floor((F.col("hf_n") - 2) / 2)
        near = [F.max(F.when(F.col("hf_r") == middle + i, F.col("hf_d"))).over(w) for i in (1, 2, 3)]  # the three values that can be in the middle
        off = materialise(off.withColumns({f"hf_m{i}": c for i, c in enumerate(near)}))
        at = lambda i: F.get(F.array("hf_m0", "hf_m1", "hf_m2"), (i - middle + F.when(i + 1 >= F.col("hf_r"), 1).otherwise(0)).cast("int"))  # noqa: B023, E731
        off = off.withColumn(f"t_{y}", F.col("hf_d") - (at(lo) + at(hi)) / 2)
    translation = off.groupBy(*by).agg(F.median(F.sqrt(sum((F.col(f"t_{y}") * F.col(f"t_{y}") for y in ys), F.lit(0.0)))).alias("translation"))
    terms, p = [F.lit(1.0), *map(F.col, xs)], len(xs) + 1

    def solve(row: dict, n_terms: int, t: int):
        import numpy as np

        square = moments._square(row["xx"], n_terms)
        inverse = np.linalg.pinv(square)
        return np.hstack([inverse @ np.array(row["xy"]).reshape(n_terms, t), inverse])

    beta = moments.coefficients(moments.statistics(rows, by, terms, [F.col(y) for y in ys]), by, solve, p, len(ys)).drop("n")
    wide = len(ys) + p
    item = lambda i, j: F.get("beta", F.lit(i * wide + j))
    h = sum((terms[i] * terms[j] * item(i, len(ys) + j) for i in range(p) for j in range(p)), F.lit(0.0))
    e2 = sum(((F.col(y) - sum((terms[i] * item(i, k) for i in range(p)), F.lit(0.0))) ** 2 for k, y in enumerate(ys)), F.lit(0.0))
    affine = rows.join(beta, by).groupBy(*by).agg(F.median(F.sqrt(e2) / F.greatest(1 - h, F.lit(1e-9))).alias("affine"))
    return translation.join(affine, by).withColumn("choice", F.when(F.col("affine") < F.col("translation"), "affine").otherwise("translation"))


def direction_ridge(df: DataFrame, block: str, xs: list[Column], axis: list[str], alpha: float = 0.001) -> DataFrame:
    """df with a unit direction (p_<axis>) predicted by n-scaled ridge of each component on the other blocks."""
    stats = moments.without_own(materialise(moments.statistics(df, [block], xs, [F.col(a) for a in axis])), block)
    beta = moments.coefficients(stats, [block], moments.ridge(alpha, scaled=False, per_n=True), len(xs), len(axis)).drop("n")
    p = [moments.predicted(xs, target=i, targets=len(axis)) for i in range(len(axis))]
    out = df.join(beta, block).withColumns({f"p_{a}": c for a, c in zip(axis, p, strict=True)})
    size = F.sqrt(sum((F.col(f"p_{a}") * F.col(f"p_{a}") for a in axis), F.lit(0.0)))
    return out.withColumns({f"p_{a}": F.col(f"p_{a}") / size for a in axis}).drop("beta")


DIRECTIONS = ("surface_normal", "position_only", "surface_plus_tilt", "surface_global_rotation")


def direction_predictors(df: DataFrame, block: str, xs: list[Column], normal: list[str], axis: list[str], alpha: float = 0.001) -> DataFrame:
    """df with hf_<method> (array of three, unit length; null where it can't be predicted) for the methods of DIRECTIONS, each fitted on the
    other blocks: the normal as it is; a ridge of the axis on xs; the normal plus a ridge of (axis - normal) on xs; the normal turned by
    the one rotation that takes the other blocks' normals next to their axes. Rows with a null in a term teach nothing.

    All folds share one pass: cross products of each block are sums, a fold's are the total minus its own."""
    n, a = [F.col(c) for c in normal], [F.col(c) for c in axis]
    fits = materialise(moments.statistics(df, [block], xs, [*a, *[y - x for y, x in zip(a, n, strict=True)]]))
    beta = moments.coefficients(moments.without_own(fits, block), [block], moments.ridge(alpha, scaled=False, per_n=True), len(xs), 6).drop("n")
    turns = moments.rotations(moments.without_own(materialise(moments.statistics(df, [block], n, a)), block), [block])
    ridge = [moments.predicted(xs, target=i, targets=6) for i in range(6)]
    turned = [sum((F.get("rotation", F.lit(3 * i + j)) * n[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    ways = dict(zip(DIRECTIONS, (n, ridge[:3], [x + t for x, t in zip(n, ridge[3:], strict=True)], turned), strict=True))
    size = lambda v: F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    found = {f"hf_{m}": F.when(size(v) > 0, F.array(*[c / size(v) for c in v])) for m, v in ways.items()}
    return df.join(beta, block, "left").join(turns, block, "left").withColumns(found).drop("beta", "rotation")


def direction_angles(predicted: DataFrame, key: str, block: str, axis: list[str]) -> DataFrame:
    """(key, block, method, angle): degrees between each method's direction and the axis; a null direction keeps its row."""
    a = [F.col(c) for c in axis]
    size = F.sqrt(sum((c * c for c in a), F.lit(0.0)))
    cos = lambda m: sum((F.get(f"hf_{m}", F.lit(i)) * a[i] for i in range(3)), F.lit(0.0)) / size
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos(m))))).alias("angle")) for m in DIRECTIONS])
    whole = F.when(F.col(f"hf_{DIRECTIONS[0]}").isNotNull() & (size > 0), F.lit(True))
    return predicted.withColumn("hf_e", F.explode(each)).select(key, block, "hf_e.method", F.when(whole & F.col("hf_e.angle").isNotNull(), F.col("hf_e.angle")).alias("angle"))


def scribble_features(cells: DataFrame, value: str, scale: float = 255.0) -> DataFrame:
    """(i, j, k, raw, smooth1, smooth2, smooth4, band, edge) of every voxel: its value over `scale`; that smoothed with
    deviations 1, 2 and 4 (half of it along k); the first minus the last; the gradient's length after smoothing with
    deviation 1 on all axes. Voxels that aren't there have no weight."""
    from .windows import gaussian_smooth, gradient

    dims = ("i", "j", "k")
    raw = materialise(cells.select(*dims, (F.col(value) / scale).alias("raw")))

    def smooth(deviations: tuple[float, float, float], name: str) -> DataFrame:
        out, last = raw, "raw"
        for d, s in zip(dims, deviations, strict=True):
            out, last = materialise(gaussian_smooth(out, [x for x in dims if x != d], d, last, s, name)), name
        return out

    edges = smooth((1.0, 1.0, 1.0), "even")
    for d in dims:
        edges = gradient(edges, [x for x in dims if x != d], d, "even").withColumnRenamed("gradient", f"g{d}")
    out = raw.join(edges.select(*dims, F.sqrt(sum((F.coalesce(F.col(f"g{d}"), F.lit(0.0)) ** 2 for d in dims), F.lit(0.0))).alias("edge")), list(dims))
    for s in (1.0, 2.0, 4.0):
        out = out.join(smooth((s, s, s / 2), f"smooth{s:.0f}"), list(dims))
    return out.select(*dims, "raw", "smooth1", "smooth2", "smooth4", (F.col("smooth1") - F.col("smooth4")).alias("band"), "edge")


def scribble_classifier(features: DataFrame, labels: DataFrame, keys: list[str], cols: list[str], per_class: int = 15_000, least: int = 25, trees: int = 160, depth: int = 16, seed: int = 1) -> DataFrame:
    """(keys, probability) of class 1 for every row, from a forest on about per_class labelled rows of each class at
    most, chosen by a hash of the keys, with weights that balance the classes. labels: keys, label (0 or 1); of a row
    marked twice the higher label counts. A class with under `least` marks is an error."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(features)
    marks = materialise(labels.groupBy(*keys).agg(F.max(F.col("label").cast("double")).alias("label")))
    counts = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < least:
        raise ValueError(f"each class needs {least} marks")
    place = F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 63) - 1))
    drawn = [marks.where((F.col("label") == c) & (place <= F.lit(min((1 << 63) - 1, (per_class << 63) // n)))).withColumn("weight", F.lit(1.0 / min(n, per_class))) for c, n in sorted(counts.items())]
    train = rows.join(reduce(DataFrame.unionByName, drawn), keys)
    train = materialise(train.coalesce(1).sortWithinPartitions(*keys).select("features", "label", "weight"))  # a bounded sample, in one order
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, weightCol="weight", seed=seed).fit(train)
    return model.transform(rows).select(*keys, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))


def mask_quality(probabilities: DataFrame, threshold: float = 0.5, broadest: float = 0.2) -> DataFrame:
    """(fraction, status) of the rows at or over a threshold: a mask over `broadest` fails."""
    out = probabilities.agg(F.avg((F.col("probability") >= threshold).cast("double")).alias("fraction"))
    return out.withColumn("status", F.when(F.col("fraction") <= broadest, "pass").otherwise("fail: implausibly broad mask"))
