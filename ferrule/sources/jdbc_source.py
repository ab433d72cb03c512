"""Relational sources through Spark's JDBC reader: options of a connection, whole and partitioned scans, samples."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession

#: Seconds until a connection is given up.
CONNECT_SECONDS = 10
DRIVERS = {"oracle": "oracle.jdbc.OracleDriver", "mysql": "com.mysql.cj.jdbc.Driver", "tdsql": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver"}


@dataclass(frozen=True)
class Connection:
    """A database by its dialect (oracle, mysql, tdsql, postgresql), place and account."""

    dialect: str
    host: str
    port: int
    database: str
    user: str
    password: str
    schema: str | None = None

    def __post_init__(self):
        if self.dialect not in DRIVERS:
            raise ValueError(f"unknown dialect {self.dialect!r}")
        for name in ("host", "database", "user", "schema"):
            if any(ord(ch) < 32 for ch in getattr(self, name) or ""):
                raise ValueError(f"{name} holds control characters")
        if not 1 <= self.port <= 65535:
            raise ValueError(f"{self.port} is not a port")


def default_schema(c: Connection) -> str | None:
    """The schema that is named; else the user in upper case, ``public``, or none, as the dialect has it."""
    return c.schema or {"oracle": c.user.upper(), "postgresql": "public"}.get(c.dialect)


def options(c: Connection, fetch_rows: int = 2000) -> dict[str, str]:
    """Options of Spark's JDBC reader and writer. The account travels beside the URL, not in it."""
    host = c.host.strip("[]")
    host = f"[{host}]" if ":" in host else host
    if c.dialect == "oracle":
        url, wait = f"jdbc:oracle:thin:@//{host}:{c.port}/{quote_plus(c.database)}", {"oracle.net.CONNECT_TIMEOUT": str(CONNECT_SECONDS * 1000)}
    elif c.dialect == "postgresql":
        url, wait = f"jdbc:postgresql://{host}:{c.port}/{quote_plus(c.database)}", {"connectTimeout": str(CONNECT_SECONDS)}
    else:
        url, wait = f"jdbc:mysql://{host}:{c.port}/{quote_plus(c.database)}?characterEncoding=UTF-8&useCursorFetch=true", {"connectTimeout": str(CONNECT_SECONDS * 1000)}
    return {"url": url, "driver": DRIVERS[c.dialect], "user": c.user, "password": c.password, "fetchsize": str(fetch_rows)} | wait


def quoted(c: Connection, name: str) -> str:
    """A table's name in the dialect's quotes, with its schema."""
    mark = "`" if c.dialect in ("mysql", "tdsql") else '"'
    owner, _, bare = name.rpartition(".")
    owner = owner or default_schema(c)
    return ".".join(mark + x.replace(mark, mark * 2) + mark for x in (owner, bare) if x)


def sample_query(c: Connection, name: str, rows: int = 1000) -> str:
    """A query of the first rows of a table, in no order."""
    limit = f"FETCH FIRST {rows} ROWS ONLY" if c.dialect == "oracle" else f"LIMIT {rows}"
    return f"SELECT * FROM {quoted(c, name)} {limit}"


def read_table(spark: SparkSession, c: Connection, name: str, split: str | None = None, low=None, high=None, parts: int = 1) -> DataFrame:
    """A table as a frame; filters and columns reach the database. With ``split``, a numeric or time column, and its least and
    greatest value, ``parts`` connections read a range of it each; rows outside the two values are in the first and last range."""
    reader = spark.read.format("jdbc").options(**options(c)).option("dbtable", quoted(c, name))
    if split is not None:
        if low is None or high is None:
            raise ValueError("a split needs the least and the greatest value of its column")
        reader = reader.options(partitionColumn=split, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def bounds_query(c: Connection, name: str, column: str) -> str:
    """The query of a split column's least and greatest value."""
    mark = "`" if c.dialect in ("mysql", "tdsql") else '"'
    return f"SELECT MIN({mark}{column}{mark}) AS low, MAX({mark}{column}{mark}) AS high FROM {quoted(c, name)}"


def write_table(df: DataFrame, c: Connection, name: str, batch: int = 2000, parts: int = 8) -> None:
    """Appends rows in batches over at most ``parts`` connections; Spark merges partitions, it does not shuffle for that."""
    df.write.format("jdbc").options(**options(c)).option("dbtable", quoted(c, name)).option("batchsize", str(batch)).option("numPartitions", str(parts)).mode("append").save()
