"""Least squares from sufficient statistics (inventory D12-D14, D26, D27 and the linear models of I).

Rows are read once: a group's X'X, X'y, y'y and n are sums. Statistics of a training set are the total minus
the held-out block's, exactly. What is solved is one small matrix for each row of statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .ranks import quantiles


def statistics(df: DataFrame, by: list[str], xs: list[Column], ys: list[Column], weight: Column | None = None) -> DataFrame:
    """n, s (weighted: sum of weights), sx, sy, xx (upper triangle), xy (x by y) and yy for each group, as arrays.
    Rows with a null in any term are left out."""
    w = F.lit(1.0) if weight is None else weight
    p, t = len(xs), len(ys)
    cols = {f"hf_x{i}": x.cast("double") for i, x in enumerate(xs)} | {f"hf_y{i}": y.cast("double") for i, y in enumerate(ys)} | {"hf_w": w.cast("double")}
    rows = df.select(*by, *[c.alias(n) for n, c in cols.items()]).dropna(subset=list(cols))
    s = lambda *names: F.sum(_product([F.col("hf_w"), *map(F.col, names)]))
    x, y = [f"hf_x{i}" for i in range(p)], [f"hf_y{i}" for i in range(t)]
    return rows.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), s().alias("s"), F.array(*[s(a) for a in x]).alias("sx"), F.array(*[s(a) for a in y]).alias("sy"),
        F.array(*[s(x[i], x[j]) for i in range(p) for j in range(i, p)]).alias("xx"), F.array(*[s(a, b) for a in x for b in y]).alias("xy"), F.array(*[s(a, a) for a in y]).alias("yy"),
    )


def _product(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return out


PARTS = ("n", "s", "sx", "sy", "xx", "xy", "yy")


def without_own(stats: DataFrame, block: str, within: tuple[str, ...] = ()) -> DataFrame:
    """For each block the statistics of all other blocks: the total minus its own."""
    size = {c: len(r) if (r := stats.select(c).first()[0]) is not None else 0 for c in ("sx", "sy", "xx", "xy", "yy")}
    item = lambda c, i: F.get(c, F.lit(i))
    sums = [F.sum(c).alias(f"t_{c}") for c in ("n", "s")] + [F.array(*[F.sum(item(c, i)) for i in range(k)]).alias(f"t_{c}") for c, k in size.items()]
    total = stats.groupBy(*within).agg(*sums)
    joined = stats.join(total, list(within)) if within else stats.crossJoin(F.broadcast(total))
    rest = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "s")} | {c: F.zip_with(f"t_{c}", c, lambda a, b: a - b) for c in size}
    return joined.select(*within, block, *[e.alias(c) for c, e in rest.items()])


def _square(upper, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = upper
    return m + np.triu(m, 1).T


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def least_squares(row: dict, p: int, t: int) -> np.ndarray:
    """Coefficients by term and target, without an intercept of their own."""
    return _solved(_square(row["xx"], p), np.array(row["xy"]).reshape(p, t))


def ridge(alpha: float, scaled: bool = True, per_n: bool = False) -> Callable[[dict, int, int], np.ndarray]:
    """Ridge with a free intercept (the first row of the result): terms are scaled by their population deviation
    (under 1e-12: by 1) if asked for; the penalty is alpha, or alpha * n."""

    def solve(row: dict, p: int, t: int) -> np.ndarray:
        n, mx, my = row["s"], np.array(row["sx"]) / row["s"], np.array(row["sy"]) / row["s"]
        xx = _square(row["xx"], p) - n * np.outer(mx, mx)
        xy = np.array(row["xy"]).reshape(p, t) - n * np.outer(mx, my)
        d = np.sqrt(np.maximum(np.diag(xx) / n, 0)) if scaled else np.ones(p)
        d = np.where(d < 1e-12, 1.0, d)
        b = _solved(xx / np.outer(d, d) + (alpha * n if per_n else alpha) * np.eye(p), xy / d[:, None]) / d[:, None]
        return np.vstack([my - mx @ b, b])

    return solve


def coefficients(stats: DataFrame, by: list[str], solve: Callable[[dict, int, int], np.ndarray], p: int, t: int = 1) -> DataFrame:
    """(by, n, beta): one small solve for each row of statistics; beta is terms by targets, row after row."""
    kinds = dict(stats.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[[*by, "n"]].copy()
            out["beta"] = [solve(r, p, t).ravel() if r["n"] > 0 else None for r in rows.to_dict("records")]
            yield out

    return stats.mapInPandas(run, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "n double, beta array<double>"]))


def predicted(xs: list[Column], beta: str | Column = "beta", intercept: bool = True, target: int = 0, targets: int = 1) -> Column:
    at = lambda i: F.get(beta, F.lit(i * targets + target))
    out = at(0) if intercept else F.lit(0.0)
    for i, x in enumerate(xs):
        out = out + at(i + intercept) * x
    return out


def block_ridge(df: DataFrame, block: str, xs: list[Column], y: Column, alpha: float, **how) -> DataFrame:
    """df with each row's prediction by a ridge model of all other blocks."""
    stats = without_own(materialise(statistics(df, [block], xs, [y])), block)
    return df.join(coefficients(stats, [block], ridge(alpha, **how), len(xs)).drop("n"), block).withColumn("prediction", predicted(xs)).drop("beta")


def principal_axes(df: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """(by, axis 0..d-1, direction, share): eigenvectors of each group's covariance, largest first, signed so that
    the largest component is positive; only moments leave the rows."""
    kinds = dict(df.dtypes)
    stats = statistics(df, by, [F.col(c) for c in dims], [F.lit(0.0)])
    p = len(dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            m = np.stack(rows["sx"]) / rows["n"].to_numpy()[:, None]
            upper = np.zeros((len(rows), p, p))
            upper[:, *np.triu_indices(p)] = np.stack(rows["xx"]) / rows["n"].to_numpy()[:, None]
            values, vectors = np.linalg.eigh(upper + np.triu(upper, 1).transpose(0, 2, 1) - m[:, :, None] * m[:, None])
            values, axes = values[:, ::-1], vectors.transpose(0, 2, 1)[:, ::-1]  # largest first; a row for each axis
            top = np.take_along_axis(axes, np.abs(axes).argmax(2)[:, :, None], 2)
            out = rows[by].loc[rows.index.repeat(p)].reset_index(drop=True)
            out["axis"], out["direction"] = np.tile(np.arange(p), len(rows)), list((axes * np.sign(top)).reshape(-1, p))
            out["share"] = (np.maximum(values, 0) / np.maximum(values.sum(1, keepdims=True), 1e-300)).ravel()
            yield out

    return stats.mapInPandas(run, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), "axis int, direction array<double>, share double"]))


def kabsch(df: DataFrame, by: list[str], a: list[str], b: list[str]) -> DataFrame:
    """(by, rotation): the rotation that takes directions a next to b, row by row, determinant 1."""
    return rotations(statistics(df, by, [F.col(c) for c in a], [F.col(c) for c in b]), by)


def rotations(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, rotation) from statistics of three xs and three ys; null where no row counts."""
    kinds = dict(stats.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            u, _, vt = np.linalg.svd(np.stack(rows["xy"]).astype(float).reshape(-1, 3, 3))
            v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
            flip = np.ones((len(rows), 1, 3))
            flip[:, 0, 2] = np.sign(np.linalg.det(v @ ut))
            out, n = rows[by].copy(), rows["n"].to_numpy()
            out["rotation"] = [r if some > 0 else None for r, some in zip(((v * flip) @ ut).reshape(-1, 9), n, strict=True)]
            yield out

    return stats.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "rotation array<double>"]))


def huber(df: DataFrame, by: list[str], xs: list[Column], y: Column, rounds: int = 8) -> DataFrame:
    """(by, beta, rmse): rounds of weighted least squares from unit weights; weights 1 within 1.345 robust scales
    (1.4826 * MAD + 1e-6) of zero, falling as 1 over the residual beyond."""
    rows = materialise(df.select(*by, *[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)], y.cast("double").alias("y")).dropna())
    cols, weight, beta = [F.col(f"x{i}") for i in range(len(xs))], F.lit(1.0), None
    for _ in range(rounds):
        known = rows if beta is None else rows.join(beta.join(scale, by), by)  # noqa: F821
        beta = materialise(coefficients(statistics(known.withColumn("hf_w", weight), by, [F.lit(1.0), *cols], [F.col("y")], F.col("hf_w")), by, least_squares, len(xs) + 1).drop("n"))
        off = rows.join(beta, by).withColumn("hf_r", F.col("y") - predicted(cols))
        middle = quantiles(off, by, "hf_r", {"m": 0.5}).drop("n")
        away = quantiles(off.join(F.broadcast(middle), by).withColumn("hf_a", F.abs(F.col("hf_r") - F.col("m"))), by, "hf_a", {"mad": 0.5})  # few groups
        scale = materialise(away.select(*by, (1.4826 * F.col("mad") + 1e-6).alias("scale")))
        far = F.abs(F.col("y") - predicted(cols)) / (1.345 * F.col("scale"))
        weight = F.when(far <= 1, 1.0).otherwise(1 / far)
    return off.groupBy(*by).agg(F.first("beta").alias("beta"), F.sqrt(F.avg(F.col("hf_r") * F.col("hf_r"))).alias("rmse"))


def two_layers(df: DataFrame, by: list[str], value: str, rounds: int = 100) -> DataFrame:
    """(by, low, high): two 1-D means for each group from its 20% and 80% quantiles on; a group that no longer
    moves leaves the loop. Groups that still move after all rounds are an error."""
    at = F.percentile(value, F.array(F.lit(0.2), F.lit(0.8)))
    state = materialise(df.groupBy(*by).agg(at.alias("q")).select(*by, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.lit(False).alias("done")))
    for _ in range(rounds):
        near_high = F.abs(F.col(value) - F.col("high")) < F.abs(F.col(value) - F.col("low"))
        open_ = state.where("not done")
        new = df.join(open_, by).groupBy(*by, "low", "high").agg(F.avg(F.when(~near_high, F.col(value))).alias("a"), F.avg(F.when(near_high, F.col(value))).alias("b"))
        new = new.select(*by, F.coalesce("a", "low").alias("na"), F.coalesce("b", "high").alias("nb"), "low", "high")
        new = new.select(*by, F.col("na").alias("low"), F.col("nb").alias("high"), ((F.abs(F.col("na") - F.col("low")) < 1e-12) & (F.abs(F.col("nb") - F.col("high")) < 1e-12)).alias("done"))
        state = materialise(state.where("done").unionByName(new))
        if state.where("not done").isEmpty():
            return state.select(*by, "low", "high")
    raise RuntimeError(f"layers did not settle in {rounds} rounds")


def leave_one_out(df: DataFrame, xs: list[Column], y: Column, alphas: list[float]) -> DataFrame:
    """(alpha, score): mean absolute leave-one-out residual e / (1 - h) of ridge (scaled, free intercept)."""
    row = statistics(df, [], xs, [y]).first().asDict()
    p = len(xs)
    n, mx = row["n"], np.array(row["sx"]) / row["n"]
    xx = _square(row["xx"], p) - n * np.outer(mx, mx)
    d = np.sqrt(np.maximum(np.diag(xx) / n, 0))
    d = np.where(d < 1e-12, 1.0, d)
    scores = []
    for a in alphas:
        b = ridge(a)(row, p, 1).ravel()
        g = np.linalg.inv(xx / np.outer(d, d) + a * np.eye(p)) / np.outer(d, d)
        z = [x - float(m) for x, m in zip(xs, mx, strict=True)]
        h = F.lit(1 / n)
        for i in range(p):
            for j in range(p):
                h = h + z[i] * z[j] * float(g[i, j])
        e = y - float(b[0])
        for x, c in zip(xs, b[1:], strict=True):
            e = e - x * float(c)
        scores.append(F.avg(F.abs(e / (1 - h))).alias(f"a{len(scores)}"))
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"a{i}").alias("score")) for i, a in enumerate(alphas)])
    return df.agg(*scores).select(F.inline(pairs))


def fold_means(df: DataFrame, block: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of all other blocks for each block (and group), total minus own."""
    own = df.groupBy(*by, block).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return own.select(*by, block, ((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))).alias("train_mean"))
