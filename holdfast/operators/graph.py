"""Graphs as edge tables (inventory H): hops, components, separated seeds, interpolation, meshes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise
from .ranks import beside


def both_ways(edges: DataFrame, a: str = "a", b: str = "b", *more: str) -> DataFrame:
    way = lambda s, t: F.struct(F.col(s).alias("u"), F.col(t).alias("v"), *more)
    return edges.select(F.inline(F.array(way(a, b), way(b, a))))  # edges are computed once


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's smallest node.

    Alternating large stars and small stars: every node's neighbours are linked to the smallest of them.
    Minima are partial aggregates and the rest are joins, which Spark splits where one node has very many
    edges; no neighbour list is ever gathered, nor a side of a join in the driver. Rounds grow with the logarithm of the longest path. Each
    round's edges are written to the shared folder."""
    lo, hi = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    now = materialise(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct())
    before = None
    for _ in range(rounds):
        n, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == before or not n:
            break
        before = n, mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))


def bfs(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, hop) of all nodes that sources (source, node) reach, all sources at once."""
    return levels(materialise(both_ways(edges)), sources, most)


def levels(around: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """bfs over edges of both ways (u, v). A node's neighbours are at its own hop or one beside it, so what is new is found by
    comparing with the last two hops, not with all nodes seen."""
    front = materialise(sources.select("source", "node", F.lit(0).alias("hop")).distinct())
    seen, last, hop = [], [front], 0
    while most is None or hop < most:
        hop += 1
        new = front.join(around, F.col("node") == F.col("u")).select("source", F.col("v").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, last[-2:]).select("source", "node")
        front = materialise(new.join(known, ["source", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        last.append(front)
        if len(last) == 10:  # few tables in the plan
            seen.append(materialise(reduce(DataFrame.unionByName, last[:8])))
            last = last[8:]
    return reduce(DataFrame.unionByName, [*seen, *last])


def shortest_paths(edges: DataFrame, sources: DataFrame, length: str, limit: float, rounds: int = 200) -> DataFrame:
    """(source, node, distance) of all nodes within a limit: relaxation rounds until nothing changes."""
    around = materialise(both_ways(edges, "a", "b", length))
    best = materialise(sources.select("source", "node", F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")))
    for _ in range(rounds):
        step = best.where("fresh").join(around, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("distance") + F.col(length)).alias("distance")).where(F.col("distance") <= limit)
        step = step.groupBy("source", "node").agg(F.min("distance").alias("new"))
        both = best.drop("fresh").join(step, ["source", "node"], "full")
        better = F.col("distance").isNull() | (F.col("new") < F.col("distance"))
        best = materialise(both.select("source", "node", F.coalesce(F.least("distance", "new"), "new").alias("distance"), F.coalesce(better, F.lit(False)).alias("fresh")))
        if best.where("fresh").isEmpty():
            return best.drop("fresh")
    raise RuntimeError("paths did not settle")


def nearest_visible(edges: DataFrame, visible: DataFrame, length: str, k: int, hidden: DataFrame | None = None, rounds: int = 1000) -> DataFrame:
    """(node, source, distance, rank): the k visible nodes nearest by path to each node (only to those of `hidden` if it is given), ties by
    the smaller source; fewer where fewer are reached. visible: node. Lengths below zero are an error; edges with nulls are left out.

    All visible nodes send labels at once, and a node keeps and passes on only its k best: on a shortest path to one of a
    node's k best, every node has that source among its own k best. So there are never more than k labels a node, and a round
    looks only at labels that are new."""
    around = both_ways(edges.dropna(subset=["a", "b", length]), "a", "b", length)
    around = materialise(around.select("u", "v", F.when(F.col(length) >= 0, F.col(length).cast("double")).otherwise(F.raise_error(F.lit("length below zero")).cast("double")).alias("hf_l")))
    own = Window.partitionBy("node").orderBy("distance", "source")
    best = materialise(visible.dropna(subset=["node"]).select("node").distinct().select("node", F.col("node").alias("source"), F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")))
    for _ in range(rounds):
        sent = best.where("fresh").join(around, F.col("node") == F.col("u")).select(F.col("v").alias("node"), "source", (F.col("distance") + F.col("hf_l")).alias("distance"), F.lit(True).alias("fresh"))
        each = best.withColumn("fresh", F.lit(False)).unionByName(sent).groupBy("node", "source").agg(F.min(F.struct("distance", "fresh")).alias("m"))  # of equal lengths the old one
        best = materialise(each.select("node", "source", "m.*").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("rank"))
        if best.where("fresh").isEmpty():
            break
    else:
        raise RuntimeError(f"paths did not settle in {rounds} rounds")
    if hidden is not None:
        best = best.join(hidden.select("node").distinct(), "node", "left_semi")
    return best.select("node", "source", "distance", F.row_number().over(own).alias("rank"))


def separated_seeds(edges: DataFrame, boundary: DataFrame, n: int, from_boundary: int = 5, apart: int = 7) -> DataFrame:
    """(node, seed): farthest-first seeds at least some hops from the boundary and from each other; ties by the
    distance to the boundary, then the smallest node. Fewer than n is an error."""
    around = materialise(both_ways(edges))
    inner = levels(around, boundary.select(F.lit(0).alias("source"), "node"))
    inner = materialise(inner.where(F.col("hop") >= from_boundary).select("node", F.col("hop").alias("depth"), F.lit(1 << 30).alias("gap")))
    seeds: list = []
    for i in range(n):
        best = inner.where(F.col("gap") >= apart).orderBy(F.col("gap").desc(), F.col("depth").desc(), "node").select("node").first()
        if best is None:
            raise ValueError(f"only {i} seeds")
        seeds.append((best[0], i))
        if i == n - 1:
            break  # no seed follows that would have to keep away from this one
        hops = levels(around, edges.sparkSession.createDataFrame([(0, best[0])], "source int, node long")).select("node", "hop")
        inner = materialise(inner.join(hops, "node", "left").select("node", "depth", F.least("gap", F.coalesce("hop", F.col("gap"))).alias("gap")))
    return edges.sparkSession.createDataFrame(seeds, "node long, seed int")


def interior(edges: DataFrame, degree: int = 6) -> DataFrame:
    """Nodes of a degree whose neighbours all have it."""
    around = both_ways(edges)
    degrees = around.groupBy("u").agg(F.count_distinct("v").alias("d"))
    inner = around.join(degrees.toDF("v", "dv"), "v").groupBy("u").agg(F.count_distinct("v").alias("d"), F.bool_and(F.col("dv") >= degree).alias("all"))
    return inner.where((F.col("d") >= degree) & F.col("all")).select(F.col("u").alias("node"))


def harmonic(edges: DataFrame, known: DataFrame, weight: Column, rounds: int = 200, enough: float = 1e-9) -> DataFrame:
    """(node, value): unknown nodes take the weighted mean of their neighbours (known ones fixed), by conjugate
    gradients over the edge table with the diagonal as preconditioner; 0 where no path leads to a known node. Not reaching `enough` (the residual's share of the
    first one) within the rounds is an error.

    A weight may be infinite (nodes at one place): values are the limit of ever larger ones. Unknown nodes that such edges join to known ones
    are settled by these edges alone, others that they join have one value."""
    w = materialise(both_ways(edges.withColumn("w", weight), "a", "b", "w").where("u <> v"))
    tight = w.where(F.col("w") == float("inf"))
    if tight.isEmpty():
        return relaxed(w, known, rounds, enough)
    tight = materialise(tight.join(known.select(F.col("node").alias("u")), "u", "left_anti").select("u", "v").distinct().withColumn("w", F.lit(1.0)))
    told = tight.join(known.select(F.col("node").alias("v")), "v", "left_semi").select("u").distinct()
    roots = connected_components(tight.join(known.select(F.col("node").alias("v")), "v", "left_anti"), "u", "v")
    nodes = tight.select(F.col("u").alias("node")).distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = materialise(nodes.join(told.select(F.col("u").alias("node"), F.lit(True).alias("told")), "node", "left"))
    settled = nodes.groupBy("root").agg(F.max("told").alias("told"))
    nodes = materialise(nodes.drop("told").join(settled, "root"))
    near = materialise(relaxed(tight.join(nodes.where("told").select(F.col("node").alias("u")), "u", "left_semi"), known, rounds, enough))
    names = nodes.where("told IS NULL").select("node", "root")
    loose = w.where(F.col("w") < float("inf"))
    for c in "uv":
        loose = loose.join(names.toDF(c, f"root_{c}"), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
    loose = materialise(loose.where("u <> v").groupBy("u", "v").agg(F.sum("w").alias("w")))
    far = relaxed(loose, known.select("node", F.col("value").cast("double").alias("value")).unionByName(near), rounds, enough)
    of_names = names.join(far.select(F.col("node").alias("root"), "value"), "root", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value"))
    return near.unionByName(of_names).unionByName(far.join(names, "node", "left_anti"))


def relaxed(w: DataFrame, known: DataFrame, rounds: int, enough: float) -> DataFrame:
    """harmonic over finite weights w (u, v, w) of both ways."""
    fixed = known.select(F.col("node").alias("k"), F.col("value").cast("double").alias("kv"))
    free = w.join(fixed, F.col("u") == F.col("k"), "left_anti")
    diagonal = free.groupBy("u").agg(F.sum("w").alias("d"))
    right = free.join(fixed, F.col("v") == F.col("k")).groupBy("u").agg(F.sum(F.col("w") * F.col("kv")).alias("b"))
    inner = materialise(free.join(fixed, F.col("v") == F.col("k"), "left_anti"))
    x = diagonal.join(right, "u", "left").select("u", "d", F.coalesce("b", F.lit(0.0)).alias("r"), F.lit(0.0).alias("x"))
    state = materialise(x.withColumn("p", F.col("r") / F.col("d")))
    rz, start = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0, None
    for _ in range(rounds):
        start = rz if start is None else start
        if rz <= enough * enough * start or rz == 0:
            break
        off = inner.join(state.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v").groupBy("u").agg(F.sum(F.col("w") * F.col("pv")).alias("o"))
        ap = materialise(state.join(off, "u", "left").withColumn("ap", F.col("d") * F.col("p") - F.coalesce("o", F.lit(0.0))).drop("o"))
        pap = ap.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        if not pap:
            break
        a = rz / pap
        moved = ap.select("u", "d", (F.col("r") - a * F.col("ap")).alias("r"), (F.col("x") + a * F.col("p")).alias("x"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]
        state = moved.withColumn("p", F.col("r") / F.col("d") + (new / rz) * F.col("p"))  # row by row from the table just written
        rz = new
    else:
        if rz > enough * enough * start:
            raise RuntimeError(f"values did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("x").alias("value"))


def radius_clusters(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, cluster) of all nodes: those joined by pairs (query_id, neighbour_id) share the smallest key."""
    found = connected_components(pairs, "query_id", "neighbour_id").toDF(key, "root")
    return nodes.select(key).join(found.hint("merge"), key, "left").select(key, F.coalesce("root", key).alias("cluster"))


def edge_incidence(faces: DataFrame) -> DataFrame:
    """Per undirected edge: faces on it and the sum of their directions (0 where two faces agree in winding)."""
    directed = faces.select(F.explode(F.array(*[F.struct(F.col(p).alias("s"), F.col(q).alias("t")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")).select("e.*")
    return directed.groupBy(F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi")).agg(F.count("*").alias("faces"), F.sum(F.when(F.col("s") < F.col("t"), 1).otherwise(-1)).alias("turn"))


def mesh_audit(faces: DataFrame) -> DataFrame:
    """Edges on one face, on more than two, and on two faces that wind against each other."""
    e = edge_incidence(faces)
    return e.agg(F.count("*").alias("edges"), F.count_if(F.col("faces") == 1).alias("boundary"), F.count_if(F.col("faces") > 2).alias("non_manifold"), F.count_if((F.col("faces") == 2) & (F.col("turn") != 0)).alias("inconsistent"))


TILE = 16  # cells along each side of a tile


def tile_labels(cells: np.ndarray) -> np.ndarray:
    """The first cell (row of cells: i, j, k within one tile) of each one's 26-connected part, by spreading the lowest number."""
    grid = np.full((TILE + 2,) * 3, len(cells), np.int64)
    place = tuple(cells[:, d] + 1 for d in range(3))
    grid[place] = np.arange(len(cells))[::-1]  # of repeated cells one number counts
    inside = np.zeros(grid.shape, bool)
    inside[place] = True
    while True:
        low = grid
        for axis in range(3):
            low = np.minimum(low, np.minimum(np.roll(low, 1, axis), np.roll(low, -1, axis)))
        new = np.where(inside, low, len(cells))
        if (new == grid).all():
            return grid[place]
        grid = new


def grid_components(voxels: DataFrame, by: list[str], coords: tuple[str, str, str] = ("i", "j", "k")) -> DataFrame:
    """Voxels with their 26-connected component. Each tile of TILE cells a side is labelled as an array; only cells at the tiles'
    faces look for neighbours in other tiles, and components run over pairs of tile parts, which follow the tiles' surfaces."""
    size = [F.floor(F.col(c) / TILE).alias(f"hf_t{d}") for d, c in enumerate(coords)]
    tile = [f"hf_t{d}" for d in range(3)]
    rows = voxels.select("*", *size)
    schema = T.StructType([*[rows.schema[c] for c in (*by, *coords, *tile)], T.StructField("hf_part", T.LongType())])

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        cells = np.stack([frame[c].to_numpy() % TILE for c in coords], axis=1).astype(np.int64)
        return frame.assign(hf_part=tile_labels(cells))

    parts = rows.select(*by, *coords, *tile).distinct().groupBy(*by, *tile).applyInPandas(label, schema)
    parts = materialise(parts.select(*by, *coords, F.xxhash64(*by, *tile, "hf_part").alias("hf_id")))
    i, j, k = coords
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    face = reduce(lambda a, b: a | b, [F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1) for c in coords])
    border = parts.where(face)
    around = border.select(*by, F.col("hf_id").alias("a"), F.explode(F.array(*[F.struct((F.col(i) + x).alias(i), (F.col(j) + y).alias(j), (F.col(k) + z).alias(k)) for x, y, z in steps])).alias("s")).select(*by, "a", "s.*")
    edges = beside(around, border.withColumnRenamed("hf_id", "b"), [*by, *coords]).where("a <> b").select("a", "b").distinct()
    found = connected_components(edges).toDF("hf_id", "root")
    named = parts.join(found, "hf_id", "left").select(*by, *coords, F.coalesce("root", "hf_id").alias("component"))
    return beside(voxels, named, [*by, *coords])


def grown_patches(edges: DataFrame, starts: DataFrame, size: int, seed: str) -> DataFrame:
    """(attempt, node): patches of `size` connected nodes; each round adds to every attempt the frontier node with
    the smallest md5(seed:attempt:node). Of attempts that end with one set of nodes the lowest stays. Patches are small
    by their meaning."""
    around = materialise(both_ways(edges))
    patch = materialise(starts.select("attempt", "node"))
    for _ in range(size - 1):
        near = patch.join(around, F.col("node") == F.col("u")).select("attempt", F.col("v").alias("node")).distinct().join(patch, ["attempt", "node"], "left_anti")
        pick = near.groupBy("attempt").agg(F.min_by("node", F.md5(F.concat_ws(":", F.lit(seed), "attempt", "node"))).alias("node"))
        patch = materialise(patch.unionByName(pick))
    sets = patch.groupBy("attempt").agg(F.array_sort(F.collect_list("node")).alias("nodes")).groupBy("nodes").agg(F.min("attempt").alias("attempt"))
    return patch.join(sets.select("attempt"), "attempt", "left_semi")


