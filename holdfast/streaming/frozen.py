"""Scoring a stream with a frozen model (inventory I23): a stateless projection, exactly as on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.predict import apply_frozen


def score_stream(stream: DataFrame, model: DataFrame, terms: dict[str, Column], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append a stream's rows with their prediction to a Parquet table; all that is there is processed, then the
    query ends. Restarted with the same checkpoint it goes on where it was, without repeating rows."""
    scored = apply_frozen(stream, model, terms)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).outputMode("append").trigger(availableNow=True).start()
