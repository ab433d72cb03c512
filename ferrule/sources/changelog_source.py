"""A streaming source of change events kept as Parquet files, read in windows of commit numbers.

The offset is the last commit number read; a batch ends at the smaller of the safe number and the checkpoint
plus the window, and never beyond the safe number seen one poll earlier, which the offset carries so
that restarts keep it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ferrule.operators import changelog


def next_offset(held: dict, current: int, oldest_open: int | None, span: int = 100_000) -> dict:
    """The next offset {scn, seen}: a pure function, so that every restart decides alike."""
    safe = max(0, min(current, current if oldest_open is None else oldest_open - 1))
    end = max(held["scn"], min(safe, held["seen"] if held["seen"] is not None else safe, held["scn"] + span))
    return {"scn": end, "seen": current}


def read_window(spark: SparkSession, path: str, held: dict, upto: dict, start: int = 0):
    """Events between two offsets, with the overlap that catches late commits; the ledger drops what was applied."""
    return changelog.window(spark.read.parquet(path), held["scn"], upto["scn"], max(1, upto["scn"] - held["scn"]), start)
