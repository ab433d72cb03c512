"""Full loads: existing-target rules, partition layout, phases with failure rules."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed order of phases.
PHASES = ("sequences", "tables", "partitioned_tables", "views")


@dataclass(frozen=True)
class TablePlan:
    name: str
    source: DataFrame
    path: str
    phase: str = "tables"
    policy: str = "fail"
    content: str = "structure_and_data"
    create: bool = True
    partition_by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.policy not in ("fail", "append", "truncate", "drop_and_create"):
            raise ValueError(f"unknown policy {self.policy!r}")
        if self.content not in ("structure_and_data", "structure_only", "data_only"):
            raise ValueError(f"unknown content {self.content!r}")
        if self.content == "data_only" and self.policy not in ("append", "truncate"):
            raise ValueError("data_only needs append or truncate")
        if self.phase not in PHASES:
            raise ValueError(f"unknown phase {self.phase!r}")


@dataclass
class LoadResult:
    name: str
    status: str
    rows: int = 0
    error: str | None = None
    notes: list[str] = field(default_factory=list)
    bytes: int = 0
    seconds: float = 0.0


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; 0 if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def is_partitioned(spark: SparkSession, path: str) -> bool:
    """Whether a target's folder really is laid out by partition columns."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any("=" in x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory())


def _write_structure(plan: TablePlan) -> None:
    """An empty table. Where it has partition columns, its file stands in their null partition, as a reader must find
    both the file's columns and the folders' names."""
    spark = plan.source.sparkSession
    if plan.policy != "append" and exists(spark, plan.path):
        p = spark._jvm.org.apache.hadoop.fs.Path(plan.path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    path = "/".join([plan.path, *(f"{c}=__HIVE_DEFAULT_PARTITION__" for c in plan.partition_by)])
    plan.source.drop(*plan.partition_by).limit(0).write.mode("append").parquet(path)


def load_table(plan: TablePlan) -> LoadResult:
    """Write one table as Parquet under its rules; rows are counted while they are written, bytes are those it adds."""
    from pyspark.sql import Observation

    began, spark = time.perf_counter(), plan.source.sparkSession
    there = exists(spark, plan.path)
    if there and plan.policy == "fail":
        raise FileExistsError(f"{plan.name}: the target exists")
    if not there and not plan.create:
        raise FileNotFoundError(f"{plan.name}: the target does not exist")
    before, seen, notes = stored_bytes(spark, plan.path) if plan.policy == "append" else 0, Observation(), []
    if plan.content == "structure_only":
        _write_structure(plan)
        rows = 0
        notes.append("structure only")
    else:
        writer = plan.source.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append" if plan.policy == "append" else "overwrite")
        (writer.partitionBy(*plan.partition_by) if plan.partition_by else writer).parquet(plan.path)
        rows = seen.get["rows"]
    if plan.partition_by and rows and not is_partitioned(spark, plan.path):
        notes.append("the target is not partitioned")
    if plan.phase == "views":
        notes.append("a view, written as a table")
    return LoadResult(plan.name, "completed", rows, None, notes, stored_bytes(spark, plan.path) - before, round(time.perf_counter() - began, 3))


def run(plans: list[TablePlan], concurrency: int = 4, stop_on_error: bool = True, cancel: threading.Event | None = None) -> list[LoadResult]:
    """Phase after phase, tables of one at once; with stop_on_error the rest is cancelled after a failure.

    Once ``cancel`` is set no further table begins, and the jobs of those under way are cancelled by their tag; what such a
    table had not committed is not there.
    """
    out, failed, over = [], False, threading.Event()
    sc, tag = (plans[0].source.sparkSession.sparkContext if plans else None), f"load-{uuid.uuid4().hex}"
    stopped = lambda: cancel is not None and cancel.is_set()

    def one(plan: TablePlan) -> LoadResult:
        nonlocal failed
        if stopped() or failed and stop_on_error:
            return LoadResult(plan.name, "cancelled")
        sc.addJobTag(tag)
        try:
            return load_table(plan)
        except Exception as e:  # a table's failure is its result
            if stopped():
                return LoadResult(plan.name, "cancelled")
            failed = True
            return LoadResult(plan.name, "failed", error=str(e).splitlines()[0])
        finally:
            sc.removeJobTag(tag)

    def watch():
        while not over.wait(0.2):
            if stopped():
                sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    if cancel is not None and plans:
        watcher.start()
    try:
        for phase in PHASES:
            todo = [p for p in plans if p.phase == phase]
            if todo:
                with ThreadPoolExecutor(1 if phase == "sequences" else min(concurrency, len(todo))) as pool:
                    out += pool.map(one, todo)
    finally:
        over.set()
    return out


def range_bucket(c: Column, bounds: list) -> Column:
    """Index of the first bound above the value; values beyond all, and nulls at 0, as range partitions have it."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(c < F.lit(bounds[i]), i).otherwise(out)
    return F.when(c.isNull(), 0).otherwise(out)


def list_bucket(c: Column, groups: list[list]) -> Column:
    """Index of the group that holds the value; -1 for none."""
    out = F.lit(-1)
    for i, g in enumerate(groups):
        out = F.when(c.isin(g), i).otherwise(out)
    return out


def partition_clause(kind: str, columns: list[str], parts: list[tuple[str, str]] | int, primary_key: list[str] = (), quote: str = "`") -> str:
    """DDL text of a RANGE, LIST or HASH layout; key columns must be part of the primary key, if any."""
    lacking = [c for c in columns if primary_key and c.lower() not in {k.lower() for k in primary_key}]
    if lacking:
        raise ValueError(f"primary key lacks partition column {', '.join(lacking)}")
    cols = ", ".join(f"{quote}{c}{quote}" for c in columns)
    if kind == "HASH":
        return f"PARTITION BY HASH ({cols}) PARTITIONS {parts}"
    word = {"RANGE": "LESS THAN", "LIST": "IN"}[kind]
    body = ", ".join(f"PARTITION {quote}{n}{quote} VALUES {word} ({v})" for n, v in parts)
    return f"PARTITION BY {kind} COLUMNS ({cols}) ({body})"
