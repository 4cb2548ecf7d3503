"""Learners of Spark's own library under the holdout rules (inventory I03, I26, I27): every row is predicted by models
that have not seen its block."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import exp

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .stats import poisson_one, uniform


def kmeans_blocks(points: DataFrame, key: str, dims: list[str], k: int = 5, seed: int = 1) -> DataFrame:
    """(key, block): spatial blocks as clusters of the coordinates, numbered 0 to k - 1."""
    rows = VectorAssembler(inputCols=dims, outputCol="hf_features").transform(points)
    return KMeans(k=k, seed=seed, featuresCol="hf_features", predictionCol="block").fit(rows).transform(rows).select(key, "block")


def folds_of(df: DataFrame, block: str) -> list:
    """The blocks in order: a few, by their meaning."""
    return [r[0] for r in df.select(block).distinct().orderBy(block).collect()]


class Forest:
    """A random forest of which every tree has its own sample of rows, with replacement: a row's number in tree t is its Poisson number, already
    in the weights and means of the rows marked hf_tree = t (see `profiles`). Each tree is one of Spark's, without a sample of its own."""

    def __init__(self, trees: int, seed: int, **both):
        self.trees, self.learners = range(1, trees + 1), [RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", seed=seed + t, **both) for t in range(trees)]

    def setPredictionCol(self, name: str) -> Forest:
        self.name = name
        return self

    def setWeightCol(self, name: str) -> Forest:
        self.learners = [x.setWeightCol(name) for x in self.learners]
        return self

    def fit(self, rows: DataFrame) -> Forest:
        drawn = {r[0] for r in rows.select("hf_tree").distinct().collect()}  # of very few rows a tree may have drawn none
        self.models = [x.setPredictionCol(f"hf_p{t}").fit(rows.where(F.col("hf_tree") == (t if t in drawn else 0))) for t, x in zip(self.trees, self.learners, strict=True)]
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        out = reduce(lambda d, m: m.transform(d), self.models, rows)
        each = [F.col(f"hf_p{t}") for t in self.trees]
        return out.withColumn(self.name, sum(each[1:], each[0]) / len(each)).drop(*[f"hf_p{t}" for t in self.trees])


TREES = 10


def regressors(target: str, seed: int) -> dict:
    """Name to learner."""
    both = {"featuresCol": "hf_features", "labelCol": target}
    return {"ridge": LinearRegression(regParam=0.1, **both), "forest": Forest(TREES, seed, **both), "boosted": GBTRegressor(maxIter=5, seed=seed, **both)}


def profiles(rows: DataFrame, block: str, xs: list[str], target: str, seed: int) -> DataFrame:
    """(block, xs, hf_tree, hf_w, target, hf_sd): rows of a block with equal xs as one, with their number, the mean of their target and its deviation; for
    hf_tree 1 to TREES the number and mean of what a sample with replacement holds of them, each row counted as often as its Poisson number says.
    Squared losses see no more of a row than these, as no split parts equal xs."""
    y = F.col(target).cast("double")
    y = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit(f"{target} is null or NaN")).cast("double")).otherwise(y)
    number = F.monotonically_increasing_id().alias("hf_id")
    draws = [F.struct(F.lit(t).alias("hf_tree"), uniform(f"tree:{seed}:{t}", "hf_id").alias("hf_u")) for t in range(TREES + 1)]
    each = rows.select(block, *xs, y.alias("hf_y"), number).select(block, *xs, "hf_y", F.inline(F.array(*draws)))
    each = each.withColumn("hf_n", F.when(F.col("hf_tree") == 0, 1).otherwise(poisson_one(F.col("hf_u"))).cast("double")).where(f"hf_tree = 0 OR hf_u >= {exp(-1)!r}")
    sums = each.groupBy(block, *xs, "hf_tree").agg(F.sum("hf_n").alias("hf_w"), F.sum(F.col("hf_n") * F.col("hf_y")).alias("hf_s"), F.stddev_pop(F.when(F.col("hf_tree") == 0, F.col("hf_y"))).alias("hf_sd"))
    return sums.select(block, *xs, "hf_tree", "hf_w", (F.col("hf_s") / F.col("hf_w")).alias(target), "hf_sd")


def moments_kept(few: DataFrame, target: str) -> DataFrame:
    """Two rows for each profile, a deviation over and under its mean, so that sums of the target's squares are those of all rows too."""
    both = F.when(F.col("hf_sd") > 0, F.array(*[F.struct((F.col("hf_w") / 2).alias("w"), (F.col(target) + s * F.col("hf_sd")).alias("y")) for s in (1, -1)])).otherwise(F.array(F.struct(F.col("hf_w").alias("w"), F.col(target).alias("y"))))
    split = few.where("hf_tree = 0").select("*", F.explode(both).alias("hf_b"))
    return split.withColumns({"hf_w": F.col("hf_b.w"), target: F.col("hf_b.y")}).drop("hf_b")


PER_TASK = 100_000  # profiles: a fit over few of them is many jobs, each as short as its tasks are few
FITS = 8  # fits that run side by side: each is many short jobs, which alone leave cores idle


def side_by_side(spark: SparkSession, run: Callable, tasks: list) -> list:
    """run(task) of every task, FITS at once."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), tasks))


def tree_regressors(df: DataFrame, block: str, xs: list[str], target: str, inner: int = 3, seed: int = 1) -> DataFrame:
    """df with p_ridge, p_forest and p_boosted, each from models of the other blocks; disagreement (the three's
    deviation); choice, the name of the learner with the least mean absolute error over `inner` parts of the training
    blocks, and prediction, its value. Learners are fitted on, and predict, profiles (different values of xs in a block), not rows. Parts are whole blocks (by their place modulo `inner`), so the choice never
    sees the row's block. Folds often leave the same blocks for a part's models: each set of blocks is fitted once."""
    rows = materialise(df)
    few = materialise(VectorAssembler(inputCols=xs, outputCol="hf_features").transform(profiles(rows, block, xs, target, seed)))
    plain = materialise(moments_kept(few, target))
    few, plain = (d.coalesce(max(1, d.count() // PER_TASK)) for d in (few, plain))
    spark, names, learned, parts = df.sparkSession, folds_of(few, block), list(regressors(target, seed)), []
    for fold in names:
        rest = [b for b in names if b != fold]
        parts += [(fold, p, tuple(b for b in rest if b not in p)) for i in range(min(inner, len(rest))) if (p := rest[i::inner]) and len(p) < len(rest)]
    whole = [(fold, [fold], tuple(b for b in names if b != fold)) for fold in names]
    fits = [(blocks, n) for blocks in dict.fromkeys([t for *_, t in (*whole, *parts)]) for n in reversed(learned)]  # the longest first

    def fit(task: tuple):
        learner = regressors(target, seed)[task[1]].setPredictionCol(f"p_{task[1]}").setWeightCol("hf_w")
        return learner.fit((few if isinstance(learner, Forest) else plain).where(F.col(block).isin(list(task[0]))))

    models = dict(zip(fits, side_by_side(spark, fit, fits), strict=True))
    places = few.where("hf_tree = 0").select(block, *xs, "hf_features")

    def predicted(task: tuple) -> DataFrame:
        """Predictions for the profiles of held-out blocks by the models of others."""
        fold, held, blocks = task
        out = reduce(lambda d, n: models[blocks, n].transform(d), learned, places.where(F.col(block).isin(held)))
        return materialise(out.select(block, *xs, F.lit(fold).alias("hf_fold"), *[f"p_{n}" for n in learned]))

    guesses = lambda tasks: reduce(DataFrame.unionByName, side_by_side(spark, predicted, tasks))
    errors = {fold: [0.0] * len(learned) for fold in names}
    if parts:
        off = rows.join(materialise(guesses(parts)), [block, *xs]).groupBy("hf_fold").agg(*[F.sum(F.abs(F.col(f"p_{n}") - F.col(target))) for n in learned])
        errors |= {fold: [s or 0.0 for s in sums] for fold, *sums in off.collect()}  # a row for each fold
    best = {fold: learned[errors[fold].index(min(errors[fold]))] for fold in names}
    pick = lambda f: reduce(lambda c, fold: c.when(F.col(block) == fold, f(best[fold])), names[1:], F.when(F.col(block) == names[0], f(best[names[0]])))
    p = [F.col(f"p_{n}") for n in learned]
    mean = sum(p[1:], p[0]) / len(p)
    spread = F.sqrt(sum(((x - mean) * (x - mean) for x in p), F.lit(0.0)) / len(p))
    out = rows.join(materialise(guesses(whole)).drop("hf_fold"), [block, *xs])
    return out.select(*df.columns, *p, pick(F.lit).alias("choice"), pick(lambda n: F.col(f"p_{n}")).alias("prediction"), spread.alias("disagreement"))


def count_classifier(df: DataFrame, block: str, xs: list[str], label: str, rounds: int = 50) -> DataFrame:
    """df with prediction: the class by a multinomial logistic regression of the other blocks."""
    rows = materialise(VectorAssembler(inputCols=xs, outputCol="hf_features").transform(df))
    learner = LogisticRegression(family="multinomial", maxIter=rounds, featuresCol="hf_features", labelCol=label, probabilityCol="hf_p", rawPredictionCol="hf_raw")
    return reduce(DataFrame.unionByName, [learner.fit(rows.where(F.col(block) != f)).transform(rows.where(F.col(block) == f)) for f in folds_of(df, block)]).drop("hf_features", "hf_p", "hf_raw")
