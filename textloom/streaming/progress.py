"""Running totals per run from a stream of progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textloom.operators.runs import run_totals


def progress_totals(events: DataFrame) -> DataFrame:
    """(run_id, total, done, failed, tokens_in, tokens_out); for outputMode complete or update. State is one row per run."""
    return run_totals(events).drop("cost")
