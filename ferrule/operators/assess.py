"""Assessment: catalog facts, size and duration estimates, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the cost model.
BATCH_SECONDS, ROW_SECONDS, LOW, HIGH = 0.05, 0.00002, 0.8, 1.6
GIB = 1 << 30


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row: null 0, text and bytes their length, decimals their text, else 8."""
    def one(f: T.StructField) -> Column:
        c = F.col(f.name)
        size = F.octet_length(c if isinstance(f.dataType, (T.StringType, T.BinaryType)) else c.cast("string")) if isinstance(f.dataType, (T.StringType, T.BinaryType, T.DecimalType)) else F.lit(8)
        return F.when(c.isNull(), 0).otherwise(size)

    total = F.lit(0)
    for f in df.schema:
        total = total + one(f)
    return total.cast("long")


def estimate(rows: Column, size: Column, mbps: float = 50, batch: int = 2000, concurrency: int = 1) -> dict[str, Column]:
    """Seconds to transfer and copy, with a low and a high bound."""
    transfer = size * 8 / (mbps * 1_000_000)
    copy = F.greatest(F.lit(1), F.floor(rows / batch)) * BATCH_SECONDS + rows * ROW_SECONDS
    total = (transfer + copy) / concurrency
    return {"seconds": F.round(total, 4), "seconds_low": F.round(total * LOW, 4), "seconds_high": F.round(total * HIGH, 4)}


def load_pressure(rows: Column, size: Column) -> Column:
    """high, medium or low by the largest table's bytes, else by rows."""
    return F.when(size > 50 * GIB, "high").when(size > 10 * GIB, "medium").when(rows > 50_000_000, "high").when(rows > 10_000_000, "medium").otherwise("low")


def readiness(risks: DataFrame) -> DataFrame:
    """(score, ready) of risks (level): 25 points off a blocking one, 4 off a warning."""
    b, w = F.count_if(F.col("level") == "blocking"), F.count_if(F.col("level") == "warning")
    return risks.agg(F.greatest(F.lit(0), 100 - 25 * b - 4 * w).cast("long").alias("score"), (b == 0).alias("ready"))


def conclusion_score(risks: DataFrame) -> DataFrame:
    """(score): 40 points off a blocking risk and 8 off a warning, between 0 and 100."""
    b, w = F.count_if(F.col("level") == "blocking"), F.count_if(F.col("level") == "warning")
    return risks.agg(F.least(F.lit(100), F.greatest(F.lit(0), 100 - 40 * b - 8 * w)).cast("long").alias("score"))


def catalog(spark: SparkSession, schemas: dict[str, T.StructType], keys: dict[str, list[str]], foreign: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Catalog frames of described tables: tables, columns, keys, foreign_keys."""
    cols = [(t, f.name, i, f.dataType.simpleString()) for t, s in schemas.items() for i, f in enumerate(s, 1)]
    return {
        "tables": spark.createDataFrame([(t,) for t in schemas], "table_name string"),
        "columns": spark.createDataFrame(cols, "table_name string, column_name string, position int, type string"),
        "keys": spark.createDataFrame([(t, c, i) for t, k in keys.items() for i, c in enumerate(k, 1)], "table_name string, column_name string, position int"),
        "foreign_keys": spark.createDataFrame(foreign, "child string, child_column string, parent string, parent_column string"),
    }


def objects(cat: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_columns, primary_key): the key's columns in order, joined by commas."""
    n = cat["columns"].groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    k = cat["keys"].groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]), ",").alias("primary_key"))
    return cat["tables"].join(n, "table_name", "left").join(k, "table_name", "left").select("table_name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("primary_key", F.lit("")).alias("primary_key"))


def phase_progress(results: DataFrame) -> DataFrame:
    """(phase, total, completed, failed, cancelled, running, pending, percent) of results (phase, status)."""
    count = lambda s: F.count_if(F.col("status") == s)
    done = count("completed") + count("failed") + count("cancelled")
    held = [count(s).alias(s) for s in ("completed", "failed", "cancelled", "running", "pending")]
    return results.groupBy("phase").agg(F.count(F.lit(1)).alias("total"), *held, F.round(100 * done / F.count(F.lit(1)), 1).alias("percent"))
