"""Soft-membership mixing: document rates that bring expected domain totals to targets.

1. A classifier that is fitted on a table of labelled rows gives every document a posterior over domains.
2. A document with t tokens and posterior p counts as t * p[d] tokens of domain d. Rates r >= 0 are sought
   whose totals, sum of r * t * p[d], are next to the targets in least squares (each domain's gap relative to
   its size), near 1: accelerated projected gradient descent from r = 1. In the metric that weighs documents by their
   tokens, a step is r <- max(0, r - step * p . gradient), and the gradient is one sum for each domain: each
   round is one distributed aggregate. The rounds' gradients are all the state there is (a few numbers); a document's rate
   is a column expression over them, so nothing is cached and no lineage grows. Sums are of whole numbers (1 / 1024 of a
   token), so rates depend neither on the order nor on the partitions of the rows.
3. Without a cap, targets are shares of the input's tokens. With a cap (rows may be dropped but not repeated at will) that total
   can be out of reach, so targets are shares of the largest total that keeps to them (less SLACK of it). That total is
   found over sums of documents by rounded posterior, of which there are MOST_CELLS at most.

Null and empty texts have no token; they get a rate by their posterior and don't change any total. Domains
without a labelled row have posterior 0. With no labelled row at all posteriors are alike and every document gets the same
rate, so targets can't be met. Of a doc_id with two domains the first by name counts; rows that share a labelled id
are all learnt from; null ids aren't. Repeated rows count as often as they occur and get equal rates (`resample` draws them
alike). An empty table gives an empty result. Only doc_id, text and the columns in `keep` are read; names hf_* are
this module's own, and columns tokens, posterior and rate in `keep` are kept as <name>_input.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_sample, materialise, one_order, set_aside, small_batches
from .stats import distinct_words, text_stats

RANKS = "byte_bpe_multi_50k.tiktoken"
MOST_LABELS = 8_000  # labelled rows that the classifier is fitted on
LEAST_DOCS, LEAST_Z = 5, 6.0  # documents and z that a word of a domain's lexicon needs
ROUNDS, STEP, ENOUGH = 120, 1.0, 1e-4
UNITS = 1024  # of a token, for exact sums
MOST_CELLS, SLACK = 4_000, 0.005

#: Domains of the table `labels`, and the share of the token total that each is to have.
TARGETS = {"clean": 0.85, "toxic": 0.05, "low": 0.10}


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "clean")


def learn_lexicons(rows: DataFrame, domains: list[str]) -> dict[str, list[str]]:
    """For each domain all words that its documents surely have more often than the others (by the z of the two
    shares). rows: (domain, text), a bounded sample, which bounds what the driver gets."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, seen = [], []
            for domain, raw in zip(batch.column("domain").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = distinct_words((raw or b"").split()) - {b""}
                names += [domain] * len(own)
                seen += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seen, pa.binary())], names=["domain", "word"])

    sizes = {r[0]: r[1] for r in rows.groupBy("domain").agg(F.count("*")).collect()}
    seen = rows.select("domain", F.col("text").cast("binary").alias("text")).mapInArrow(words, "domain string, word binary").groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)])
    seen = seen.where(sum((F.col(f"d{i}") for i in range(len(domains))), F.lit(0)) >= LEAST_DOCS)
    found: dict[str, list[str]] = {}
    for i, d in enumerate(domains):
        own, rest = sizes.get(d, 0), sum(sizes.values()) - sizes.get(d, 0)
        if not own or not rest:
            continue
        others = sum((F.col(f"d{j}") for j in range(len(domains)) if j != i), F.lit(0))
        both = (F.col(f"d{i}") + others) / (own + rest)
        z = (F.col(f"d{i}") / own - others / rest) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / own + 1 / rest))
        found[d] = [bytes(r[0]).decode("utf-8", "ignore") for r in seen.where(z >= LEAST_Z).orderBy("word").select("word").collect()]
    return {d: [w for w in ws if w] for d, ws in found.items() if ws}


def token_counter(docs: DataFrame) -> Callable[[str, int], int]:
    """Tokens of a text: the number of its byte-level BPE ids."""
    source = bpe.shipped(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return lambda text, longest: len(bpe.token_ids(source, text, longest))


def domain_posteriors(docs: DataFrame, known: DataFrame, domains: list[str], keep: list[str], most: int = MOST_LABELS) -> DataFrame:
    """keep, tokens and posterior (array in the order of domains) of every row. known: (doc_id, domain); at
    most about `most` of its rows are learnt from."""
    known = known.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("hf_id")).agg(F.min("domain").alias("domain"))
    known = bounded_sample(known, most, "hf_id")
    rows = materialise(docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("hf_id")).select("domain", "text"))
    lexicons = learn_lexicons(rows, domains)
    named = {f"d{domains.index(d)}": w for d, w in lexicons.items()}
    measure = text_stats(F.col("text"), named)
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    train = rows.select(place.cast("double").alias("label"), measure.alias("stats"))
    names = train.schema["stats"].dataType.names
    train = one_order(train.select("label", *[F.col(f"stats.{n}").alias(n) for n in names]))
    seen = [r[0] for r in train.select("label").distinct().collect()]
    measured = docs.select(*keep, text_stats(F.col("text"), named, token_counter(docs)).alias("stats")).select(*keep, F.col("stats.tokens").alias("tokens"), "stats")
    if len(seen) < 2:
        alone = F.array(*[F.lit(1.0 if i in seen else 0.0 if seen else 1.0 / len(domains)) for i in range(len(domains))])
        with small_batches(docs.sparkSession):
            return materialise(measured.select(*keep, "tokens", alone.alias("posterior")))
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60).fit(VectorAssembler(inputCols=names, outputCol="features").transform(train))
    apart = measured.select(*keep, "tokens", *[F.col(f"stats.{n}").alias(f"hf_{n}") for n in names])
    scored = VectorAssembler(inputCols=[f"hf_{n}" for n in names], outputCol="hf_features").transform(apart)
    model.setFeaturesCol("hf_features").setProbabilityCol("hf_p").setRawPredictionCol("hf_raw").setPredictionCol("hf_label")
    p = vector_to_array("hf_p")
    whole = F.array(*[F.get(p, F.lit(i)) if i < model.numClasses else F.lit(0.0) for i in range(len(domains))])
    with small_batches(docs.sparkSession):
        return materialise(model.transform(scored).select(*keep, "tokens", whole.alias("posterior")))


def rate(posterior: Column, gradients: list[list[float]], step: float = STEP, cap: float | None = None) -> Column:
    """The rate after the rounds whose gradients are given; never over cap."""
    if not gradients:
        return F.lit(1.0)
    rounds = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(momentum(i)).alias("m")) for i, g in enumerate(gradients)])
    dot = lambda g: F.aggregate(F.zip_with(g, posterior, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)

    def turn(state: Column, x: Column) -> Column:
        r = boxed(state["y"] - step * dot(x["g"]), cap)
        return F.struct(r.alias("r"), (r + x["m"] * (r - state["r"])).alias("y"))

    return F.aggregate(rounds, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), turn, lambda state: state["r"])


def momentum(i: int) -> float:
    """Of the accelerated method: the next round starts that far beyond the last change."""
    return i / (i + 3.0)


def boxed(r: Column, cap: float | None) -> Column:
    return F.greatest(F.lit(0.0), r if cap is None else F.least(F.lit(cap), r))


def whole_units(tokens: Column) -> Column:
    """Tokens as a whole number of units, whose sums are exact."""
    return F.round(tokens * UNITS).cast("long")


def fit_rates(documents: DataFrame, shares: list[float], cap: float | None = None, rounds: int = ROUNDS, step: float = STEP, enough: float = ENOUGH, grid: int | None = None) -> tuple[list[list[float]], list[float]]:
    """Gradients of all rounds, and the totals reached, both as shares of the input's tokens. documents: tokens and
    posterior. The target of a domain is its share of the input's tokens. Every round is one aggregate over all documents. With `grid`, documents
    are first summed by their posterior rounded to 1 / grid, and rounds run over those sums: faster, but the totals
    are then met only as closely as the rounding lets them."""
    d = len(shares)
    cells = documents.where("tokens > 0")
    if grid:
        cell = F.transform("posterior", lambda x: F.round(x * grid).cast("int"))
        cells = cells.groupBy(cell.alias("cell")).agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.get("posterior", F.lit(i))).alias(f"m{i}") for i in range(d)])
        cells = cells.select("tokens", F.array(*[F.col(f"m{i}") / F.col("tokens") for i in range(d)]).alias("posterior"))
        cells = materialise(cells)
    cells = cells.select("tokens", F.col("posterior").alias("p"))
    total = cells.agg(F.sum(whole_units(F.col("tokens")))).first()[0]
    if not total:
        return [], []
    target, gradients, first = np.array(shares), [], None
    moving = cells.withColumns({"r": F.lit(1.0), "y": F.lit(1.0)})
    sums = [F.sum(whole_units(F.col(at) * F.col("tokens") * F.get("p", F.lit(j)))) for at in ("r", "y") for j in range(d)]
    for i in range(rounds + 1):
        both = np.array(list(moving.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()), float) / total
        reached, ahead = both[:d], both[d:]
        first = np.maximum(reached, 1e-9) if first is None else first
        if i == rounds or np.abs(reached - target).max() < enough * target.sum():
            break
        gradients.append(((ahead - target) / first).tolist())
        change = sum((F.get("p", F.lit(j)) * float(gradients[-1][j] * step) for j in range(d)), F.lit(0.0))
        moving = moving.withColumn("hf_r", boxed(F.col("y") - change, cap))
        moving = moving.select("tokens", "p", F.col("hf_r").alias("r"), (F.col("hf_r") + momentum(i) * (F.col("hf_r") - F.col("r"))).alias("y"))
        if i % 8 == 7:
            moving = materialise(moving)
    return gradients, reached.tolist()


def largest_total(documents: DataFrame, shares: list[float], cap: float) -> float:
    """The largest share of the input's tokens that rates of 0 to cap can keep with the domains at `shares` of it, but for
    SLACK; 1 where a domain has no token, so that targets can't be met at all. Documents are summed by their posterior, rounded so
    that there are MOST_CELLS sums at most; those are what the driver gets."""
    d, grid = len(shares), 1
    while comb(grid + 1 + d, d - 1) <= MOST_CELLS and grid < 4096:  # rounded parts sum up to grid, give or take d / 2
        grid += 1
    cell = F.transform("posterior", lambda x: F.round(x * grid).cast("int"))
    sums = documents.where("tokens > 0").groupBy(cell.alias("cell")).agg(*[F.sum(whole_units(F.col("tokens") * F.get("posterior", F.lit(i)))) for i in range(d)])
    mass = np.array([r[1:] for r in sums.orderBy("cell").collect()], float).reshape(-1, d)
    if not len(mass) or (mass.sum(axis=0) <= 0).any():
        return 1.0
    mass, share = mass / mass.sum(), np.array(shares)
    low, high = 0.0, float((cap * mass.sum(axis=0) / share).min())
    for _ in range(12):
        middle = (low + high) / 2
        low, high = (middle, high) if attainable(mass, middle * share, cap) else (low, middle)
    return low * (1 - SLACK)


def attainable(mass: np.ndarray, target: np.ndarray, cap: float, rounds: int = 1_500) -> bool:
    """Whether rates of 0 to cap bring the cells' sums next to the target. By the same descent, over cells."""
    tokens = mass.sum(axis=1)
    p, first, r, y = mass / tokens[:, None], mass.sum(axis=0), np.ones(len(mass)), np.ones(len(mass))
    for i in range(rounds):
        new = np.clip(y - p @ ((y @ mass - target) / first), 0, cap)
        r, y = new, new + momentum(i) * (new - r)
        if i % 50 == 49 and np.abs(r @ mass - target).max() < ENOUGH / 10 * target.sum():
            return True
    return False


def mix(docs: DataFrame, known: DataFrame, targets: dict[str, float] = TARGETS, keep: tuple[str, ...] = ("doc_id",), cap: float | None = None) -> DataFrame:
    """keep, tokens, posterior and rate of every row of docs. Rates whose totals are over ENOUGH away from a target
    are logged as a warning, with the shares that the rows reach."""
    domains = sorted(targets)
    whole = sum(targets.values())
    aside = set_aside(docs, "tokens", "posterior", "rate")
    scored = domain_posteriors(aside, known, domains, [aside.columns[docs.columns.index(k)] for k in keep])
    shares = [targets[d] / whole for d in domains]
    total = 1.0 if cap is None else largest_total(scored, shares, cap)
    gradients, _ = fit_rates(scored, [total * x for x in shares], cap)
    mixed = scored.withColumn("rate", rate(F.col("posterior"), gradients, cap=cap))
    reached = reached_shares(mixed, len(domains), cap is not None)
    if reached and max(abs(a - b) for a, b in zip(reached, shares, strict=True)) > ENOUGH:
        logging.getLogger(__name__).warning("shares reached (target): %s", ", ".join(f"{d} {a:.5f} ({b:.5f})" for d, a, b in zip(domains, reached, shares, strict=True)))
    return mixed


def reached_shares(mixed: DataFrame, d: int, of_kept: bool = False) -> list[float]:
    """The domains' totals under the rows' rates, as shares of all tokens, or of those that are kept; none where there is no token."""
    total, *sums = mixed.agg(F.sum(whole_units(F.col("tokens"))), *[F.sum(whole_units(F.col("rate") * F.col("tokens") * F.get("posterior", F.lit(i)))) for i in range(d)]).first()
    total = sum(sums) if of_kept and total else total
    return [x / total for x in sums] if total else []


def resample(docs: DataFrame, known: DataFrame, targets: dict[str, float] = TARGETS, cap: float | None = None) -> DataFrame:
    """docs, each row as often as its rate says: the whole part, and once more with the rest as probability,
    drawn from a hash of id and text. With cap 1 no row is repeated."""
    cols = docs.columns
    mixed = mix(docs.withColumns({"hf_key": F.xxhash64("doc_id", "text")}), known, targets, ("doc_id", "hf_key"), cap).dropDuplicates(["doc_id", "hf_key"])
    draw = F.pmod(F.xxhash64(F.lit("mix"), "hf_key"), F.lit(1 << 20)) / float(1 << 20)
    mixed = mixed.select(F.col("doc_id").alias("hf_id"), "hf_key", F.floor(F.col("rate") + draw).cast("int").alias("hf_n")).where("hf_n > 0")
    joined = docs.join(mixed, (F.xxhash64("doc_id", "text") == F.col("hf_key")) & F.col("doc_id").eqNullSafe(F.col("hf_id")))
    return joined.select(*cols, F.explode(F.array_repeat(F.lit(0), F.col("hf_n"))).alias("hf")).select(cols)
