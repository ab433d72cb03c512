"""Named queries and their SQL about jobs: states, progress, owners, errors, parameters, accounts, copied values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import adapt
from ferrule.functions.portable import SourceType
from ferrule.operators import jobs
from ferrule.plans.fixtures import table
from ferrule.plans.registry import _values, query

_STATES = ("queued", "running", "catching_up", "syncing", "completed", "failed", "cancelled")


@query(f"""WITH j AS (SELECT event_id AS job_id, ([{', '.join(f"'{s}'" for s in _STATES)}])[event_id % 7 + 1] AS status, CASE WHEN event_id % 3 = 0 THEN 'full_only' WHEN event_id % 3 = 1 THEN 'full_and_incremental' END AS sync_mode FROM events),
a AS (SELECT *, CASE WHEN status IN ('catching_up', 'syncing') AND sync_mode IS DISTINCT FROM 'full_only' THEN 'resume' WHEN status IN ('queued', 'running') THEN 'fail' ELSE 'none' END AS action FROM j)
SELECT job_id, action, CASE action WHEN 'resume' THEN 'queued' WHEN 'fail' THEN 'failed' ELSE status END AS status FROM a""")
def recovered_jobs(spark, d):
    """What becomes of each job after a restart."""
    status = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 7 + 1).cast("int"))
    mode = F.when(F.col("event_id") % 3 == 0, "full_only").when(F.col("event_id") % 3 == 1, "full_and_incremental")
    j = table(spark, d, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), mode.alias("sync_mode"))
    return jobs.recovered(j).select("job_id", "action", "status")


@query("""WITH s AS (SELECT p_brand AS phase, CASE WHEN p_size % 5 = 0 THEN 'completed' WHEN p_size % 5 = 1 THEN 'failed' WHEN p_size % 5 = 2 THEN 'cancelled' WHEN p_partkey % 2 = 0 THEN 'running' ELSE 'pending' END AS state FROM part)
SELECT phase, count(*) AS total, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'cancelled') AS cancelled,
count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'pending') AS pending, round(100 * count(*) FILTER (state IN ('completed', 'failed', 'cancelled')) / count(*), 2) AS percent FROM s GROUP BY phase""")
def planned_progress(spark, d):
    """Progress of planned objects, some without a result, some active; results of others do not count."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("phase"), F.col("p_partkey").cast("string").alias("name"), "p_partkey", "p_size")
    r = F.col("p_size") % 5
    results = p.where(r < 3).select("phase", "name", F.when(r == 0, "success").when(r == 1, "failed").when(F.col("p_partkey") % 2 == 0, "skipped").otherwise("cancelled").alias("status"))
    stray = p.select(F.lit("other").alias("phase"), "name", F.lit("success").alias("status"))
    return jobs.planned_progress(p, results.unionAll(stray), p.where("p_partkey % 2 = 0"))


@query("SELECT (SELECT count(DISTINCT p_type) FROM part) + (SELECT count(DISTINCT p_brand) FROM part) AS total")
def object_total(spark, d):
    p = table(spark, d, "part")
    return jobs.object_total(p.select(F.col("p_type").alias("name")), p.select(F.col("p_brand").alias("name")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'sales' WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'stock' ELSE 'main' END ELSE 'main' END AS target_owner FROM part""")
def target_owners(spark, d):
    """Owners from the table's own name, or else from the source, through the mapping."""
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Shop."), "p_brand")).when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("none."), "p_brand")).otherwise(F.col("p_brand"))
    owner = F.when(F.col("p_size") % 2 == 0, "Depot").otherwise("OTHER")
    return p.select("p_partkey", jobs.target_owner(name, owner, {"SHOP": "sales", "depot": "stock"}, "main").alias("target_owner"))


_ERRORS = ("ORA-01017: refused", "DPY-4001: none given", "ORA-12514: no service", "ORA-12541: nobody listens", "it Timed Out", "ORA-28000: locked", "ORA-28001: expired", "disk is FULL", "error (1205, wait)", "ORA-00942: no table")
_KINDS = ("credentials", "credentials", "unknown_service", "listener_down", "timeout", "locked_account", "expired_password", "other", "other", "other")
_CODES = tuple(x.split(":")[0] if x.startswith(("ORA", "DPY")) else "CONNECTION_ERROR" for x in _ERRORS)
_FAILURES = ("other",) * 7 + ("no_space", "lock_timeout", "other")


@query(f"""WITH {_values('e', [(i, *x) for i, x in enumerate(zip(_CODES, _KINDS, _FAILURES, strict=True))], 'i, code, kind, failure')}
SELECT event_id, code, kind, CASE WHEN failure = 'other' AND event_id % 4 = 1 THEN 'metadata' ELSE failure END AS failure FROM events JOIN e ON event_id % 10 = i""")
def error_kinds(spark, d):
    """Codes and meanings of connection errors, and kinds of failures, by their messages."""
    text = F.concat(F.lit("first line\n"), F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 10 + 1).cast("int")))
    code, kind = jobs.connection_error(text)
    return table(spark, d, "events").select("event_id", code.alias("code"), kind.alias("kind"), jobs.failure_kind(text, F.when(F.col("event_id") % 4 == 1, "KeyError").otherwise("RuntimeError")).alias("failure"))


@query("SELECT event_id, event_id % 2 = 0 AND event_id % 3 > 0 AND (event_id % 5 <> 0 OR event_id % 7 = 0) AS ready FROM events")
def log_readiness(spark, d):
    n = lambda k: F.col("event_id") % k
    mode = F.when(n(2) == 0, "ArchiveLog").otherwise("NOARCHIVELOG")
    least = F.when(n(3) == 0, F.when(n(2) == 0, "NO")).when(n(3) == 1, "yes").otherwise("IMPLICIT")
    root = F.when(n(7) == 0, "cdb$root").otherwise("PDB1")
    return table(spark, d, "events").select("event_id", jobs.log_ready(mode, least, root, F.when(n(5) == 0, "YES").otherwise("NO")).alias("ready"))


@query("""WITH p AS (SELECT lower(n_name) AS name, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey::VARCHAR END AS v FROM nation)
SELECT 'first' AS parameter, coalesce((SELECT v FROM p WHERE name = 'nation_8'), (SELECT v FROM p WHERE name = 'nation_9'), (SELECT v FROM p WHERE name = 'nation_3')) AS value
UNION ALL SELECT 'second', coalesce((SELECT v FROM p WHERE name = 'nation_12'), (SELECT v FROM p WHERE name = 'nation_16')) UNION ALL SELECT 'third', NULL""")
def first_parameters(spark, d):
    """The first alias that has a value; the second parameter's aliases have none, the third's is no name at all."""
    p = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey").cast("string")).alias("value"))
    return jobs.first_parameter(p, {"first": ["Nation_8", "nation_9", "NATION_3"], "second": ["nation_12", "nation_16"], "third": ["nowhere"]})


@query("SELECT p_type AS role, count(*) AS grants FROM part GROUP BY p_type ORDER BY grants DESC, role LIMIT 20")
def role_grants(spark, d):
    return jobs.grants(table(spark, d, "part").select(F.col("p_type").alias("role")), "role")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'SyStem' ELSE 'Mgmt_View' END AS account FROM supplier WHERE s_suppkey % 3 < 2")
def sensitive_accounts(spark, d):
    k = F.col("s_suppkey") % 3
    return jobs.sensitive_accounts(table(spark, d, "supplier").select("s_suppkey", F.when(k == 0, "SyStem").when(k == 1, "Mgmt_View").otherwise(F.col("s_name")).alias("account")), "oracle")


_COPIED = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("O_ORDERDATE", T.StringType()), T.StructField("age", T.StringType()), T.StructField("span", T.StringType()), T.StructField("o_totalprice", T.DecimalType(18, 2))])


@query("""WITH v AS (SELECT *, o_orderdate + to_microseconds(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000000 ELSE 0 END) AS stamp, o_orderkey % 200000 AS s, (o_orderkey % 4000 - 2000)::BIGINT AS m FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 1000000 <> 0 THEN strftime(stamp, '%Y-%m-%d %H:%M:%S.%f') ELSE strftime(stamp, '%Y-%m-%d %H:%M:%S') END AS O_ORDERDATE,
CASE WHEN s >= 172800 THEN (s // 86400) || ' days, ' WHEN s >= 86400 THEN '1 day, ' ELSE '' END || (s % 86400 // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS age,
CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad((abs(m) // 12)::VARCHAR, 4, '0') || '-' || lpad((abs(m) % 12)::VARCHAR, 2, '0') AS span, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS o_totalprice FROM v""")
def adapted_values(spark, d):
    """Times, spans of days and spans of months as the text that a text column of the target holds."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(secs=F.when(k % 3 == 0, k % 1000000 / 1000000).otherwise(0).cast("decimal(18,6)"))).alias("o_orderdate"), F.make_dt_interval(secs=(k % 200000).cast("decimal(18,6)")).alias("age"), F.make_ym_interval(F.lit(0), (k % 4000 - 2000).cast("int")).alias("span"), "o_totalprice")
    return adapt.adapted(o, _COPIED).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


_TYPES = (("NUMBER", 5, 0, None), ("VARCHAR2", None, None, 40), ("DATE", None, None, None), ("CLOB", None, None, None), ("NUMBER", 70, 0, None))


@query(f"""WITH {_values('k', [('customer', 'C0', 'NUMBER(5)', 'INT', 'false'), ('customer', 'C1', 'NUMBER(70)', 'VARCHAR(128)', 'true'), ('part', 'P0', 'VARCHAR2(40)', 'VARCHAR(40)', 'false'), ('part', 'P1', 'CLOB', 'LONGTEXT', 'false')], 'table_name, column_name, source_type, target_type, lossy')}
SELECT table_name, column_name, source_type, target_type, lossy = 'true' AS degraded FROM k""")
def column_mapping(spark, d):
    """What the columns of the largest tables become; a fixed catalog, whose answer is fixed."""
    number, big, text, large = (SourceType(n, precision=p, scale=s, length=w) for n, p, s, w in (_TYPES[0], _TYPES[4], _TYPES[1], _TYPES[3]))
    found = adapt.column_mapping(spark, {"customer": [("C0", number), ("C1", big)], "part": [("P0", text), ("P1", large)]}, "mysql")
    return found.select("table_name", "column_name", "source_type", "target_type", "degraded")
