"""Values on their way into a target: what a column's type makes of them, and what its columns become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.canonical import interval_text
from ferrule.functions.portable import SourceType, portable_type


def _field(name: str, c: Column) -> Column:
    return F.extract(F.lit(name), c)


def span_text(c: Column) -> Column:
    """An interval of days and seconds as ``1 day, 2:03:04.500000``: days only if there are any, below zero counted down from
    the day before, a fraction only if there is one."""
    whole = (_field("day", c).cast("long") * 86400 + _field("hour", c).cast("long") * 3600 + _field("minute", c).cast("long") * 60) * 1_000_000
    micros = whole + (_field("second", c) * 1_000_000).cast("long")
    rest = F.pmod(micros, F.lit(86_400_000_000))
    days = ((micros - rest) / 86_400_000_000).cast("long")
    part = lambda size, most: (F.floor(rest / size) % most).cast("string")
    clock = F.concat(part(3_600_000_000, 24), F.lit(":"), F.lpad(part(60_000_000, 60), 2, "0"), F.lit(":"), F.lpad(part(1_000_000, 60), 2, "0"))
    fraction = F.when(rest % 1_000_000 == 0, "").otherwise(F.concat(F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0")))
    lead = F.when(days == 0, "").otherwise(F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")))
    return F.when(c.isNotNull(), F.concat(lead, clock, fraction))


def adapted_value(c: Column, kind: T.DataType, target: T.DataType) -> Column:
    """A value as the target's type takes it. Text columns take times as ISO text with a space, a fraction only if there is
    one, and intervals in their fixed forms; others are cast. Null stays null."""
    if not isinstance(target, T.StringType) or isinstance(kind, T.StringType):
        return c if kind == target else c.cast(target)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(kind, T.DayTimeIntervalType):
        return span_text(c)
    if isinstance(kind, T.YearMonthIntervalType):
        return interval_text(_field("year", c).cast("int") * 12 + _field("month", c).cast("int"))
    return c.cast("string")


def adapted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a target's schema, met by folded name, with adapted values; a column that df lacks is an error."""
    held = {f.name.lower(): f for f in df.schema}
    lacking = [f.name for f in schema if f.name.lower() not in held]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)}")
    return df.select(*(adapted_value(F.col(held[f.name.lower()].name), held[f.name.lower()].dataType, f.dataType).alias(f.name) for f in schema))


def type_text(t: SourceType) -> str:
    """A source type as it is written: NUMBER(10,2), VARCHAR2(40), DATE."""
    if t.precision is not None:
        return f"{t.name}({t.precision}{f',{t.scale}' if t.scale else ''})"
    return f"{t.name}({t.length})" if t.length else t.name


def column_mapping(spark: SparkSession, tables: dict[str, list[tuple[str, SourceType]]], target: str) -> DataFrame:
    """(table_name, position, column_name, source_type, target_type, degraded, degradation) of described tables' columns."""
    rows = []
    for name, columns in tables.items():
        for i, (column, kind) in enumerate(columns, 1):
            m = portable_type(kind, target)
            rows.append((name, i, column, type_text(kind), m.target, m.degraded is not None, m.degraded))
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, source_type string, target_type string, degraded boolean, degradation string")
