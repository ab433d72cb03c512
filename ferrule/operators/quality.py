"""Data-quality checks before a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_rate(c: Column) -> Column:
    """The share of nulls as an aggregate; 0 for an empty table."""
    return F.coalesce((F.count(F.lit(1)) - F.count(c)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def suspicious_nulls(df: DataFrame, nullable: list[str], keys: list[str], most: float = 0.30) -> DataFrame:
    """(column_name, null_rate) of nullable columns outside the key that are null in more than ``most`` of the rows."""
    names = [c for c in nullable if c.lower() not in {k.lower() for k in keys}]
    return null_rates(df, names).where(F.col("null_rate") > most) if names else df.sparkSession.createDataFrame([], "column_name string, null_rate double")


def first_duplicates(df: DataFrame, primary: list[str], uniques: list[list[str]]) -> tuple[list[str], int]:
    """The first key, the primary one and then the unique ones, that has repeated values, and how many; nothing and 0 without."""
    for key in filter(None, [primary, *uniques]):
        n = duplicate_keys(df.dropna(subset=key), key).count()
        if n:
            return key, n
    return [], 0


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, null_rate): all columns in one aggregate, rounded to 2 decimals; 0 for an empty table."""
    names = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(names)))
    rate = lambda i: F.round(F.coalesce((F.col("n") - F.col(f"c{i}")) / F.nullif("n", F.lit(0)), F.lit(0.0)), 2)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), rate(i).alias("null_rate")) for i, c in enumerate(names)))).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def overlong(df: DataFrame, most: int) -> DataFrame:
    """(column_name, longest) of text columns that hold more than ``most`` characters."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    one = df.agg(*(F.max(F.length(c)).alias(c) for c in texts))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("longest")) for c in texts))).alias("r")).select("r.*").where(F.col("longest") > most)


def encoding_issues(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys and the first column, in order, with a control character other than tab and line ends."""
    bad = lambda c: F.col(c).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return df.select(*keys, F.coalesce(*(F.when(bad(c), F.lit(c)) for c in columns)).alias("column_name")).where("column_name IS NOT NULL")


def fractional(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, has_fraction): whether numbers have digits after the point, all columns in one pass."""
    one = df.agg(*(F.coalesce(F.max(F.col(c) % 1 != 0), F.lit(False)).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("has_fraction")) for c in columns))).alias("r")).select("r.*")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key, if any, is in no parent row."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
