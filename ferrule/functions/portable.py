"""Portable column types: what a source type becomes in a target dialect and in Spark, and what is lost."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class SourceType:
    name: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    timezone: bool = False
    identity: bool = False


@dataclass(frozen=True)
class Mapping:
    target: str
    spark: T.DataType
    degraded: str | None = None


#: Integer types by the digits they hold.
INTEGERS = ((3, "TINYINT", T.ByteType()), (5, "SMALLINT", T.ShortType()), (10, "INT", T.IntegerType()), (19, "BIGINT", T.LongType()))
FLOATS = {"BINARY_FLOAT", "BINARY_DOUBLE", "DOUBLE", "FLOAT", "REAL", "DOUBLE PRECISION"}
TEXTS = {"CLOB", "NCLOB", "TEXT", "TINYTEXT", "MEDIUMTEXT", "LONGTEXT", "LONG", "XMLTYPE"}
SPATIAL = {"GEOMETRY", "SDO_GEOMETRY", "GEOGRAPHY", "POINT", "LINESTRING", "POLYGON"}


def _decimal(p: int, s: int) -> T.DataType:
    return T.DecimalType(p, s) if p <= 38 and s <= p else T.StringType()


def _number(t: SourceType, mysql: bool) -> Mapping:
    if t.identity:
        return Mapping("BIGINT", T.LongType())
    if t.precision is None:
        return Mapping("NUMERIC(65,0)" if mysql else "NUMERIC", T.DecimalType(38, 0))
    scale = t.scale or 0
    if t.name == "NUMBER" and mysql:
        if scale <= 0:
            digits = t.precision - scale
            for most, target, kind in INTEGERS:
                if digits < most:
                    return Mapping(target, kind)
            return Mapping(f"NUMERIC({digits},0)", _decimal(digits, 0)) if digits <= 65 else Mapping("VARCHAR(128)", T.StringType(), "number beyond 65 digits becomes text")
        p = max(t.precision, scale)
        return Mapping(f"NUMERIC({p},{scale})", _decimal(p, scale)) if p <= 65 and scale <= 30 else Mapping("VARCHAR(128)", T.StringType(), "number beyond 65 digits becomes text")
    return Mapping(f"NUMERIC({t.precision},{scale})", _decimal(t.precision, max(scale, 0)))


def portable_type(t: SourceType, target: str) -> Mapping:
    """The first rule that fits; target is a dialect name, of which mysql and tdsql differ most."""
    mysql, postgres, oracle = target in ("mysql", "tdsql"), target == "postgresql", target == "oracle"
    name, n = t.name.upper(), t.length
    if name in FLOATS:
        return Mapping("DOUBLE" if mysql else "FLOAT", T.DoubleType())
    if name in ("NUMERIC", "NUMBER", "DECIMAL", "MONEY"):
        return _number(SourceType(name, t.precision, t.scale, identity=t.identity), mysql)
    if name == "BIGINT":
        return Mapping("BIGINT", T.LongType())
    if name in ("INT", "INTEGER", "SMALLINT", "TINYINT", "MEDIUMINT"):
        return Mapping("INT", T.IntegerType())
    if name == "BOOLEAN" or name == "BIT" and (n or 1) == 1:
        return Mapping("BOOLEAN", T.BooleanType())
    if name == "BIT":
        return Mapping(f"BLOB({-(-n // 8)})", T.BinaryType(), "bit string becomes bytes")
    if "TIMESTAMP" in name or name == "DATETIME":
        if t.timezone or "TIME ZONE" in name and "LOCAL" not in name:
            return Mapping("VARCHAR(48)", T.StringType(), "time zone kept as text") if mysql else Mapping("TIMESTAMP WITH TIME ZONE", T.TimestampType())
        return Mapping("DATETIME(6)" if mysql else "TIMESTAMP", T.TimestampNTZType())
    if name == "DATE":
        return Mapping("DATE", T.DateType())
    if name in ("RAW", "VARBINARY"):
        return Mapping(f"VARBINARY({n or 2000})" if mysql else "BLOB", T.BinaryType(), "raw bytes change type" if name == "RAW" else None)
    if name in ("BLOB", "BINARY", "BYTEA", "LONG RAW", "BFILE"):
        small = n and n <= 65535
        return Mapping(f"BLOB({n})" if small else "LONGBLOB" if mysql else "BLOB", T.BinaryType(), "external file is not copied" if name == "BFILE" else None)
    if name in TEXTS:
        return Mapping("LONGTEXT" if mysql else "TEXT", T.StringType(), "XML becomes text" if name == "XMLTYPE" else None)
    if name in ("JSON", "JSONB"):
        return Mapping("JSON" if mysql else "TEXT", T.StringType())
    national = None if oracle or not name.startswith("N") else "national text becomes plain text"
    if name in ("CHAR", "NCHAR"):
        return Mapping(f"CHAR({n or 1})" if (n or 1) <= 255 else "LONGTEXT" if mysql else "TEXT", T.StringType(), national)
    if re.fullmatch(r"N?VARCHAR2?|STRING", name):
        return Mapping(f"VARCHAR({n})" if n and n <= 65535 else "LONGTEXT" if mysql else "TEXT", T.StringType(), national)
    if name in SPATIAL:
        return Mapping("GEOMETRY", T.BinaryType()) if mysql else Mapping("TEXT", T.StringType(), "shape becomes text")
    if name in ("ENUM", "SET"):
        return Mapping(name, T.StringType()) if mysql else Mapping(f"VARCHAR({n or (255 if name == 'ENUM' else 1024)})", T.StringType(), f"{name} becomes text")
    if name == "UUID":
        return Mapping("UUID", T.StringType()) if postgres else Mapping("CHAR(36)" if oracle else "VARCHAR(36)", T.StringType(), "UUID becomes text")
    if name == "ARRAY":
        return Mapping("TEXT", T.StringType(), "array becomes text")
    if name.startswith("INTERVAL"):
        return Mapping("VARCHAR(48)", T.StringType(), "interval becomes text")
    return Mapping("TEXT", T.StringType(), f"{name} has no counterpart")


def target_schema(columns: list[tuple[str, SourceType, bool]], target: str, keys: tuple[str, ...] = (), surrogate: str | None = None) -> T.StructType:
    """A Spark schema with source and target types as metadata; a surrogate key leads where there is no key."""
    fields = []
    if surrogate and not keys:
        fields.append(T.StructField(surrogate, T.LongType(), False, {"target": "BIGINT AUTO_INCREMENT"}))
    for name, kind, nullable in columns:
        m = portable_type(kind, target)
        meta = {"source": kind.name, "target": m.target} | ({"degraded": m.degraded} if m.degraded else {}) | ({"char_length": kind.length} if kind.name.upper() in ("CHAR", "NCHAR") and kind.length else {})
        fields.append(T.StructField(name, m.spark, nullable and name not in keys, meta))
    return T.StructType(fields)
