"""Joins that check or keep what they should (inventory C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], one_to_one: bool = False) -> DataFrame:
    """Left join; a repeated right key (or left key, for one_to_one) is an error when the rows are computed."""
    def guarded(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("hf_once", F.when(n == 1, True).otherwise(F.raise_error(F.lit(f"repeated key on the {side}")).cast("boolean"))).where("hf_once").drop("hf_once")

    return (guarded(left, "left") if one_to_one else left).join(guarded(right, "right"), keys, "left")


def label_overlap(labels: DataFrame, region: str, label: str, at: str) -> DataFrame:
    """For each pair of regions a < b, voxels that a label of one shares with a label of the other, with both
    labels' sizes. Voxels carry few labels, so the self-join on the voxel is bounded."""
    sizes = labels.groupBy(region, label).agg(F.count("*").alias("n"))
    side = lambda s: labels.select(at, F.col(region).alias(f"region_{s}"), F.col(label).alias(f"label_{s}"))
    pairs = side("a").join(side("b"), at).where(F.col("region_a") < F.col("region_b"))
    pairs = pairs.groupBy("region_a", "label_a", "region_b", "label_b").agg(F.count("*").alias("overlap"))
    for s in "ab":
        pairs = pairs.join(sizes.toDF(f"region_{s}", f"label_{s}", f"n_{s}"), [f"region_{s}", f"label_{s}"])
    return pairs


def denominators(plan: DataFrame, scored: DataFrame, key: str, by: list[str], error: str) -> DataFrame:
    """Candidates and scored units of each group: planned units stay in the count when they have no score."""
    units = scored.groupBy(key).agg(F.avg(error).alias("hf_e"))
    return plan.join(units, key, "left").groupBy(*by).agg(F.count("*").alias("candidates"), F.count("hf_e").alias("scored"), F.avg("hf_e").alias("mean_error"))


def attach_parameters(rows: DataFrame, parameters: DataFrame, by: list[str]) -> DataFrame:
    """Per-group parameters joined to every row; Spark broadcasts the small side by its size."""
    return rows.join(parameters, by, "left")


def best_triples(points: DataFrame, by: list[str], key: str, dims: list[str], weight: float = 0.05, most: int = 5_000_000, rounds: int = 20) -> DataFrame:
    """(by, a, b, c, score): of all triples in a group that with the largest smallest distance minus weight * mean
    distance to the group's centre, smallest keys on ties; exact, by branch and bound.

    Points are put into cells, first four along each axis. A triple of cells can't score more than its boxes' largest
    distances say; triples of cells under the best score that single points have shown are given up, the cells of the
    others are halved, and so on until at most `most` triples of points are left to be compared (an error after all
    rounds, which only very many points that tie can bring about). Of points at one place three are enough."""
    from ..storage import materialise

    square = lambda parts: F.sqrt(sum((x * x for x in parts), F.lit(0.0)))
    centre = points.groupBy(*by).agg(*[F.avg(d).alias(f"hf_m{d}") for d in dims], *[F.min(d).alias(f"hf_l{d}") for d in dims], F.greatest(F.lit(1e-300), *[F.max(d) - F.min(d) for d in dims]).alias("hf_size"))
    p = points.withColumn("hf_n", F.row_number().over(Window.partitionBy(*by, *dims).orderBy(key))).where(F.col("hf_n") <= 3).join(centre, by)
    away = square([F.col(d) - F.col(f"hf_m{d}") for d in dims])
    left = materialise(p.select(*by, F.struct(F.col(key).alias("id"), *[F.col(d).cast("double").alias(d) for d in dims], away.alias("away")).alias("p"), *[((F.col(d) - F.col(f"hf_l{d}")) / F.col("hf_size")).alias(f"hf_{d}") for d in dims]))
    gap = lambda x, y: square([F.col(f"{x}.{d}") - F.col(f"{y}.{d}") for d in dims])
    score = lambda a, b, c: F.least(gap(a, b), gap(b, c), gap(a, c)) - weight * (F.col(f"{a}.away") + F.col(f"{b}.away") + F.col(f"{c}.away")) / 3
    widest = lambda x, y: square([F.greatest(F.abs(F.col(f"{x}.hi_{d}") - F.col(f"{y}.lo_{d}")), F.abs(F.col(f"{y}.hi_{d}") - F.col(f"{x}.lo_{d}"))) for d in dims])
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, *keys: df.repartition(n, *by, *keys)  # tables of cells are small files: left to their sizes, one task would form all triples
    triples, best = None, None
    for level in range(rounds):
        steps = 4 << level
        place = lambda n: F.struct(*[F.least(F.floor(F.col(f"hf_{d}") * n), F.lit(n - 1)).alias(d) for d in dims])  # noqa: B023, E731
        placed = left.withColumns({"cell": place(steps), "parent": place(max(1, steps // 2))})
        cells = materialise(placed.groupBy(*by, "parent", "cell").agg(F.count("*").cast("double").alias("n"), F.min("p.away").alias("away"), F.min("p").alias("one"), *[f(f"p.{d}").alias(f"{e}_{d}") for d in dims for e, f in (("lo", F.min), ("hi", F.max))]))
        side = lambda t: cells.select(*by, F.col("parent").alias(f"p{t}"), F.struct(*cells.columns[len(by) + 1 :]).alias(t))  # noqa: B023, E731
        if triples is None:
            two = side("a").join(side("b"), by).where(F.col("a.cell") <= F.col("b.cell"))
            three = dealt(two, "a.cell", "b.cell").join(side("c"), by).where(F.col("b.cell") <= F.col("c.cell"))
        else:
            three = dealt(triples, "pa", "pb", "pc").join(side("a"), [*by, "pa"]).join(side("b"), [*by, "pb"]).join(side("c"), [*by, "pc"])
            three = three.where(((F.col("pa") != F.col("pb")) | (F.col("a.cell") <= F.col("b.cell"))) & ((F.col("pb") != F.col("pc")) | (F.col("b.cell") <= F.col("c.cell"))))
        apart = F.size(F.array_distinct(F.array("a.one.id", "b.one.id", "c.one.id"))) == 3
        three = three.select(*by, "a", "b", "c", (F.least(widest("a", "b"), widest("b", "c"), widest("a", "c")) - weight * (F.col("a.away") + F.col("b.away") + F.col("c.away")) / 3).alias("upper"), F.when(apart, score("a.one", "b.one", "c.one")).alias("lower"))
        three = materialise(three)
        shown = three.groupBy(*by).agg(F.max("lower").alias("lower"))
        best = materialise(shown if best is None else shown.unionByName(best).groupBy(*by).agg(F.max("lower").alias("lower")))
        three = three.drop("lower").join(best, by).where(F.col("lower").isNull() | (F.col("upper") >= F.col("lower") - 1e-9))
        triples = materialise(three.select(*by, *[F.col(f"{t}.cell").alias(f"p{t}") for t in "abc"], (F.col("a.n") * F.col("b.n") * F.col("c.n")).alias("n")))
        used = triples.select(*by, F.explode(F.array("pa", "pb", "pc")).alias("cell")).distinct()
        left = materialise(placed.join(used, [*by, "cell"], "left_semi").drop("cell", "parent"))
        if (triples.agg(F.sum("n")).first()[0] or 0) <= most:
            break
        triples = triples.drop("n")
    else:
        raise RuntimeError(f"over {most} triples tie for the best score")
    own = left.withColumn("cell", place(steps))
    side = lambda t: own.select(*by, F.col("cell").alias(f"p{t}"), F.col("p").alias(t))
    three = dealt(triples.drop("n"), "pa", "pb", "pc").join(side("a"), [*by, "pa"]).join(side("b"), [*by, "pb"]).join(side("c"), [*by, "pc"])
    ids = F.array_sort(F.array("a.id", "b.id", "c.id"))
    three = three.select(*by, ids.alias("ids"), score("a", "b", "c").alias("score")).where(F.size(F.array_distinct("ids")) == 3)
    top = F.max(F.struct(F.round("score", 12).alias("r"), *[(-F.get("ids", F.lit(i))).alias(f"n{i}") for i in range(3)], "score"))
    return three.groupBy(*by).agg(top.alias("m")).select(*by, *[(-F.col(f"m.n{i}")).alias(t) for i, t in enumerate("abc")], F.col("m.score").alias("score"))



def weighted_cross(rows: DataFrame, sites: DataFrame, weight: Column, value: Column, by: list[str]) -> DataFrame:
    """Mean of few sites' values for every row, by a weight over both; sites are a declared small table."""
    both = rows.crossJoin(F.broadcast(sites))
    return both.groupBy(*by).agg((F.sum(weight * value) / F.sum(weight)).alias("prediction"))
