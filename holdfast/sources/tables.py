"""Sources and sinks (inventory A): validation, inventories, fingerprints, frozen models, careful writes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate_points(df: DataFrame, x: str = "x", y: str = "y", value: str = "value", key: str = "point_id", least: int = 20, largest: float = 1e12) -> DataFrame:
    """Violations as rows (reason, row_id): missing or non-finite numbers, numbers beyond `largest`, repeated
    coordinates, no extent, too few rows. Column names are matched without case; other columns are allowed.
    An empty result means that the table is valid; row_id is null for reasons that concern the table."""
    names = {c.lower(): c for c in df.columns}
    if missing := sorted({x, y, value} - names.keys()):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    p = df.select(F.col(names.get(key, key)).alias("row_id"), *[F.col(names[c]).cast("double").alias(c) for c in (x, y, value)])
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    reasons = F.array_compact(F.array(*[F.when(bad(c), F.lit(f"{c} is not finite")).when(F.abs(c) > largest, F.lit(f"{c} is too large")) for c in (x, y, value)]))
    rows = p.select(F.explode(reasons).alias("reason"), "row_id")
    good = p.where(~(bad(x) | bad(y)))
    twice = good.groupBy(x, y).agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")).where("n > 1").select(F.lit("coordinates repeat").alias("reason"), "row_id")
    whole = good.agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("dx"), (F.max(y) - F.min(y)).alias("dy"))
    table = F.array_compact(F.array(F.when(F.col("n") < least, F.lit("too few rows")), F.when((F.col("dx") == 0) | (F.col("dy") == 0), F.lit("no extent"))))
    whole = whole.select(F.explode(table).alias("reason"), F.lit(None).cast(dict(p.dtypes)["row_id"]).alias("row_id"))
    return rows.unionByName(twice).unionByName(whole)


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, nulls) of every required column; missing ones are an error, reported sorted."""
    if missing := sorted(set(cols) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])).alias("s")).select("s.*")


ANNOTATIONS = "annotator_id string, annotations array<struct<case_id:string,reviewed:boolean,visibility:string,u_depth_points:array<struct<lateral_vox:double,depth_vox:double>>,v_depth_points:array<struct<lateral_vox:double,depth_vox:double>>>>"


def annotation_rows(packs: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Cases and clicks of annotation packs held as JSON text. A case without clicks is in the case table only."""
    parsed = packs.select(F.from_json(column, ANNOTATIONS).alias("a")).select("a.annotator_id", F.explode("a.annotations").alias("c"))
    cases = parsed.select("annotator_id", "c.case_id", "c.reviewed", "c.visibility")
    clicks = [parsed.select("annotator_id", "c.case_id", F.lit(view).alias("view"), F.inline(f"c.{view}_depth_points")) for view in ("u", "v")]
    return cases, clicks[0].unionByName(clicks[1]).toDF("annotator_id", "case_id", "view", "lateral", "depth")


def manifest_problems(runs: DataFrame, required: list[str], label: str, declared: list[str]) -> DataFrame:
    """Problems of a run list: required keys that are null, labels that repeat, or differ from the declared set."""
    missing = runs.select(F.col(label).alias("item"), F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in required]))).alias("problem"))
    twice = runs.groupBy(F.col(label).alias("item")).agg(F.count("*").alias("n")).where("n > 1").select("item", F.lit("repeats").alias("problem"))
    known = runs.sparkSession.createDataFrame([(d,) for d in declared], "item string")
    names = runs.select(F.col(label).alias("item")).distinct()
    extra = names.join(known, "item", "left_anti").select("item", F.lit("not declared").alias("problem"))
    gone = known.join(names, "item", "left_anti").select("item", F.lit("absent").alias("problem"))
    return missing.unionByName(twice).unionByName(extra).unionByName(gone)


def slice_inventory(files: DataFrame, archive: Column, number: Column, size: Column) -> DataFrame:
    """For each archive: slices, first, last, whether numbers run without gap or repetition, bytes."""
    rows = files.select(archive.alias("archive"), number.alias("no"), size.alias("size"))
    out = rows.groupBy("archive").agg(F.count("*").alias("slices"), F.min("no").alias("first"), F.max("no").alias("last"), F.count_distinct("no").alias("different"), F.sum("size").alias("bytes"))
    return out.select("archive", "slices", "first", "last", ((F.col("last") - F.col("first") + 1 == F.col("slices")) & (F.col("different") == F.col("slices"))).alias("contiguous"), "bytes")


WHOLE = 128 << 20  # bytes: larger files are read in pieces
PIECE = 8 << 20


def opened(path: str):
    """A stream of the file that Spark names so (paths are not percent-encoded)."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_stream(re.sub("^//+", "/", rest), compression=None)
    host, place = re.fullmatch(r"//([^/]*)(/.*)", rest, re.S).groups()
    system, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system.open_input_stream(f"{root.rstrip('/')}{place}", compression=None)


def piecewise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, bytes, sha256) of files, of which PIECE bytes are held at once."""
    for frame in frames:
        for path, length in zip(frame["path"], frame["length"], strict=True):
            seen, digest = 0, hashlib.sha256()
            with opened(path) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    seen += len(piece)
            if seen != length:
                raise OSError(f"{path} had {length} bytes when it was listed, and {seen} when it was read")
            yield pd.DataFrame({"path": [path], "bytes": [seen], "sha256": [digest.hexdigest()]})


def file_fingerprints(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of rows that spark.read.format("binaryFile") gives. Files of over WHOLE bytes are not taken as a row's content, which holds
    2 GB at most, but streamed where the task runs: from local or mounted folders, and from the object stores and HDFS that pyarrow opens by their URI."""
    small = files.where(F.col("length") <= WHOLE).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > WHOLE).select("path", "length").mapInPandas(piecewise, "path string, bytes long, sha256 string")
    return small.unionByName(large)


def write_new(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a result; an earlier one at the path is an error."""
    df.write.mode("errorifexists").format(form).save(path)


def fingerprint(model: DataFrame, keys: list[str], value: str) -> str:
    """sha256 over a small model's rows in key order."""
    text = F.concat_ws("|", *keys, F.format_number(value, 12))
    return model.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256)).first()[0]


def freeze_model(model: DataFrame, keys: list[str], value: str, path: str, status: str = "frozen") -> str:
    """Write a model once, with its fingerprint and status in every row."""
    mark = fingerprint(model, keys, value)
    write_new(model.withColumns({"model_hash": F.lit(mark), "model_status": F.lit(status)}).coalesce(1), path)
    return mark


def load_frozen(spark, path: str, keys: list[str], value: str) -> DataFrame:
    """A frozen model; an error if its rows don't have the stored fingerprint or it isn't frozen."""
    stored = spark.read.parquet(path)
    told = [tuple(r) for r in stored.select("model_hash", "model_status").distinct().collect()]
    model = stored.drop("model_hash", "model_status")
    if told != [(fingerprint(model, keys, value), "frozen")]:
        raise ValueError(f"model at {path} is not what was frozen: {told}")
    return model


def surfaces(cells: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """One row for each unit: the grid in order as an array of structs."""
    return cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("surface"))


def linear_index(i: Column, j: Column, k: Column, width: int, height: int) -> Column:
    """1-based index of 1-based row, column and slice, first axis fastest."""
    return i + (j - 1) * width + (k - 1) * width * height


def from_linear_index(index: Column, width: int, height: int) -> tuple[Column, Column, Column]:
    zero = index - 1
    return zero % width + 1, F.floor(zero / width) % height + 1, F.floor(zero / (width * height)) + 1


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new's keys taken from new; `kept` says which are old."""
    keep = old.join(new.select(*keys).distinct(), keys, "left_anti").withColumn("kept", F.lit(True))
    return keep.unionByName(new.withColumn("kept", F.lit(False)))


def export_assignments(points: DataFrame, key: str, assignments: DataFrame, predictions: DataFrame, strategies: list[str]) -> DataFrame:
    """Every strategy and point: its assignment, and prediction and residual where it is a test row."""
    names = points.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")
    rows = points.crossJoin(F.broadcast(names)).join(assignments, ["strategy", key], "left")
    return rows.join(predictions, ["strategy", key], "left").withColumn("residual", F.col("prediction") - F.col("value"))


def hash_unit(*parts: Column) -> Column:
    """A uniform number in (0, 1) from the md5 of joined parts, the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def synthetic_field(spark, size: int, seed: str, preset: str = "field", noise: float = 0.1) -> DataFrame:
    """size x size jittered grid with a closed-form signal and Gaussian noise, the same for a seed and row."""
    g = spark.range(size * size).select(F.col("id").alias("point_id"), (F.col("id") % size).alias("gx"), F.floor(F.col("id") / size).alias("gy"))
    u = lambda name: hash_unit(F.lit(seed), F.lit(name), F.col("point_id"))
    g = g.withColumns({"x": F.col("gx") + (u("x") - 0.5) * 0.6, "y": F.col("gy") + (u("y") - 0.5) * 0.6})
    signal = {
        "field": F.sin(F.col("x") / 4) + F.cos(F.col("y") / 5),
        "facets": F.exp(-(F.pow(F.col("gx") % 4 - 1.5, 2) + F.pow(F.col("gy") % 4 - 1.5, 2)) / 2),
        "noise": F.lit(0.0),
    }[preset]
    gauss = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * F.pi() * u("b"))
    return g.select("point_id", "x", "y", (signal + noise * gauss).alias("value"))


def ledger(plan: DataFrame, scored: DataFrame, key: str, reason: str) -> DataFrame:
    """Every planned unit with a status; units without a scored row keep the reason."""
    marked = scored.select(key).distinct().withColumn("hf_ok", F.lit(True))
    out = plan.join(marked, key, "left")
    return out.withColumns({"status": F.when(F.col("hf_ok"), "scored").otherwise("failed"), "reason": F.when(F.col("hf_ok").isNull(), F.lit(reason))}).drop("hf_ok")
