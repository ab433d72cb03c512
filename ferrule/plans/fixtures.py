"""Derived inputs: a second side, a change log and a catalog, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators.assess import row_bytes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}
FOREIGN = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]

#: Columns of the tables: text, and all others.
TEXTS = {"region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name", "part": "p_name p_brand p_type", "orders": "o_orderstatus o_orderpriority", "lineitem": "l_returnflag l_linestatus", "events": "event_type props", "documents": "text lang source", "embeddings": "", "pages": "url html", "benchmark": "text", "labels": "", "conversations": "role text"}
OTHERS = {"region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey c_acctbal", "supplier": "s_suppkey s_nationkey s_acctbal", "part": "p_partkey p_size p_retailprice", "orders": "o_orderkey o_custkey o_totalprice o_orderdate", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_shipdate", "events": "event_id ts user_id value", "documents": "doc_id n_chars", "embeddings": "vec_id embedding label", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id quality toxic", "conversations": "conv_id turn"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})


def orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money(table(spark, sf_dir, "orders"), "o_totalprice")


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders without every 101st key, with changed prices and states, and five new keys."""
    src = orders_source(spark, sf_dir)
    kept = src.where("o_orderkey % 101 <> 0").withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"),
        "o_orderstatus": F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")),
    })
    new = src.agg(F.max("o_orderkey").alias("m")).select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"), "m").select((F.col("m") + F.col("i")).alias("o_orderkey"), F.lit(0).cast("bigint").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.lit(1).cast("decimal(18,2)").alias("o_totalprice"), F.expr("timestamp_ntz'1999-01-01'").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    return kept.unionByName(new)


ORDERS_SQL = """s AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, o_orderdate, o_orderpriority FROM orders),
t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM s WHERE o_orderkey % 101 <> 0
      UNION ALL SELECT (SELECT max(o_orderkey) FROM s) + i, 0, 'N', 1, TIMESTAMP '1999-01-01', '1-URGENT' FROM range(1, 6) r(i))"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as change events of users, five to a transaction."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    xid = F.floor(F.col("event_id") / 5).cast("bigint")
    base = e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("scn"), xid.alias("xid"), op.alias("operation"), F.col("value").cast("decimal(18,2)").alias("value"), "event_type")
    commits = base.groupBy("xid").agg(F.max("scn").alias("commit_scn"))
    return base.join(commits, "xid").select("commit_scn", "xid", "key", "scn", "operation", "value", "event_type")


CHANGES_SQL = """c0 AS (SELECT user_id AS key, event_id + 1 AS scn, event_id // 5 AS xid, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation, CAST(value AS DECIMAL(18,2)) AS value, event_type FROM events),
changes AS (SELECT max(scn) OVER (PARTITION BY xid) AS commit_scn, * FROM c0)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, n_rows, bytes) of all tables, measured."""
    out = None
    for t in TABLES:
        df = table(spark, sf_dir, t).select(*TEXTS[t].split(), *OTHERS[t].split())
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).select(F.lit(t).alias("table_name"), "n_rows", "bytes")
        out = one if out is None else out.unionAll(one)
    return out


def bytes_sql(t: str) -> str:
    """SQL of a row's bytes."""
    return " + ".join([f"coalesce(strlen({c}), 0)" for c in TEXTS[t].split()] + [f"CASE WHEN {c} IS NULL THEN 0 ELSE 8 END" for c in OTHERS[t].split()])


FACTS_SQL = "facts AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, coalesce(sum({bytes_sql(t)}), 0)::BIGINT AS bytes FROM {t}" for t in TABLES) + ")"
