"""Views over the given tables that the registered queries run on, in both dialects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "fx_points3": "SELECT vec_id AS point_id, label AS region, CAST(embedding[0] AS DOUBLE) AS x, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS z, CAST(embedding[3] AS DOUBLE) AS value FROM {embeddings}",
    "fx_points2": "SELECT o_orderkey AS point_id, CAST(o_custkey AS DOUBLE) AS x, o_totalprice / 1000.0D AS y, CAST(o_orderkey % 97 AS DOUBLE) + o_totalprice / 5000.0D AS value FROM {orders}",
    "fx_unit_error": "SELECT l_orderkey AS unit_id, l_orderkey % 5 AS block_id, l_returnflag AS method, l_linenumber AS cell_id, abs(l_extendedprice - 50000.0D) / 1000.0D AS error FROM {lineitem}",
    "fx_features": "SELECT l_orderkey AS unit_id, l_orderkey % 5 AS block_id, l_quantity AS f1, l_discount AS f2, l_tax AS f3, l_extendedprice / 1000.0D AS target FROM {lineitem}",
    "fx_track": "SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS depth, value AS r, CAST(event_id % 50 AS DOUBLE) AS c FROM {events}",
    "fx_click": "SELECT user_id AS case_id, event_type AS view_name, value AS lat_pos, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) AS depth FROM {events}",
    "fx_voxel": "SELECT l_partkey % 24 AS i, l_suppkey % 20 AS j, l_linenumber AS k, avg(l_quantity) AS value FROM {lineitem} GROUP BY 1, 2, 3",
    "fx_label": "SELECT DISTINCT l_returnflag AS region, l_suppkey % 8 AS label, (l_partkey % 24) * 1000 + (l_suppkey % 20) * 10 + l_linenumber AS lin FROM {lineitem}",
    "fx_face": "SELECT DISTINCT l_orderkey % 211 AS a, l_partkey % 211 AS b, l_suppkey % 211 AS c FROM {lineitem} WHERE l_orderkey % 211 <> l_partkey % 211 AND l_partkey % 211 <> l_suppkey % 211 AND l_orderkey % 211 <> l_suppkey % 211",
    "fx_plan": "SELECT o_orderkey AS unit_id, o_orderstatus AS group_name FROM {orders}",
}
#: DuckDB counts list items from 1 and has no D suffix.
DUCK = {k: re.sub(r"\{(\w+)\}", r"\1", re.sub(r"embedding\[(\d)\]", lambda m: f"embedding[{int(m[1]) + 1}]", s)).replace("0D", "0") for k, s in SPARK.items()}


class Views:
    """view(name): a fixture view, or one of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in SPARK:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        used = set(re.findall(r"\{(\w+)\}", SPARK[name]))
        return self.spark.sql(SPARK[name], **{t: self(t) for t in used})


def with_views(sql: str) -> str:
    """sql with the fixture views that it names put in front as common table expressions."""
    used = [k for k in DUCK if re.search(rf"\b{k}\b", sql)]
    if not used:
        return sql
    front = ", ".join(f"{k} AS ({DUCK[k]})" for k in used)
    rest = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    return f"WITH {'RECURSIVE ' if rest and rest[1] else ''}{front}, {sql[rest.end() :]}" if rest else f"WITH {front} {sql}"
