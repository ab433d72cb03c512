"""Further named queries and their SQL: apply rules, statements, validation runs, catalogs, assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import naming, redo
from ferrule.operators import assess, catalog, changelog, compare, quality, report, validate
from ferrule.plans.fixtures import CHANGES_SQL, FACTS_SQL, FOREIGN, KEYS, ORDERS_SQL, OTHERS, TABLES, TEXTS, bytes_sql, changes, facts, orders_source, orders_target, table
from ferrule.plans.registry import MAX_HASHED_ROWS, _snapshot, _values, query

_C = f"WITH {CHANGES_SQL}"
_TABLES = _values("tb", [(t,) for t in TABLES], "table_name")

# ---------------------------------------------------------------- change log

_BASE = "base AS (SELECT c_custkey AS user_id, CAST(c_acctbal AS DECIMAL(18,2)) AS value FROM customer)"
_LAST = f"""{_C}, l AS (SELECT key, operation, value FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_scn DESC, scn DESC) = 1), {_BASE}
SELECT user_id, value::DOUBLE AS value FROM base ANTI JOIN l ON user_id = key UNION ALL SELECT key, value::DOUBLE FROM l WHERE operation <> 'delete'"""


def _shown(state):
    return changelog.visible(state, "user_id", ["value"]).withColumn("value", F.col("value").cast("double"))


@query(_LAST)
def late_commits(spark, d):
    """The later half of the log is applied first, then the earlier one, then all of it again."""
    c, state = changes(spark, d), changelog.versioned(_snapshot(spark, d), "user_id", ["value"])
    for part in (c.where("xid % 2 = 1"), c.where("xid % 2 = 0"), c):
        state = changelog.merge_events(state, part, "user_id", ["value"])
    return _shown(state)


_MOVED = f"""{_C}, e AS (SELECT commit_scn, scn, operation, value, key AS old_key, CASE WHEN operation = 'update' AND scn % 11 = 0 THEN key + 100000 ELSE key END AS key FROM changes),
x AS (SELECT key, commit_scn, scn, 1 AS sub, operation = 'delete' AS gone, value FROM e UNION ALL SELECT old_key, commit_scn, scn, 0, true, value FROM e WHERE operation = 'update' AND old_key <> key),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_scn DESC, scn DESC, sub DESC) = 1), {_BASE}
SELECT user_id, value::DOUBLE AS value FROM base ANTI JOIN l ON user_id = key UNION ALL SELECT key, value::DOUBLE FROM l WHERE NOT gone"""


def _moves(spark, d):
    new = F.when((F.col("operation") == "update") & (F.col("scn") % 11 == 0), F.col("key") + 100000).otherwise(F.col("key"))
    return changes(spark, d).drop("event_type").withColumn("old_key", F.col("key")).withColumn("key", new)


@query(_MOVED)
def key_change_chain(spark, d):
    """Updates that change their key delete the row of the old one, in two batches out of order."""
    state, e = changelog.versioned(_snapshot(spark, d), "user_id", ["value"]), _moves(spark, d)
    for part in (e.where("xid % 3 = 1"), e.where("xid % 3 <> 1")):
        state = changelog.merge_events(state, part, "user_id", ["value"])
    return _shown(state)


@query(f"""{_C}, l AS (SELECT key, operation FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_scn DESC, scn DESC) = 1), {_BASE}, src AS (SELECT user_id, value + 1 AS value FROM base WHERE user_id % 5 <> 0),
u AS (SELECT DISTINCT key FROM changes WHERE operation <> 'delete'), x AS (SELECT l.key, l.operation FROM l),
ev AS (SELECT c.key, c.commit_scn, c.scn, c.operation FROM changes c WHERE c.operation = 'delete' OR c.key IN (SELECT user_id FROM src)),
k AS (SELECT key, operation FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_scn DESC, scn DESC) = 1)
SELECT user_id, value::DOUBLE AS value FROM base ANTI JOIN k ON user_id = key UNION ALL SELECT src.user_id, src.value::DOUBLE FROM src JOIN k ON src.user_id = k.key WHERE k.operation <> 'delete'""")
def refresh_from_source(spark, d):
    """Events bring in the source's present rows; keys that the source no longer has are skipped."""
    base = _snapshot(spark, d)
    source = base.where("user_id % 5 <> 0").withColumn("value", (F.col("value") + 1).cast("decimal(18,2)"))
    return _shown(changelog.refresh_rows(changelog.versioned(base, "user_id", ["value"]), changes(spark, d).drop("event_type"), source, "user_id", ["value"]))


@query("SELECT CASE event_id % 8 WHEN 1 THEN 'insert' WHEN 2 THEN 'delete' WHEN 3 THEN 'update' WHEN 5 THEN 'ddl' ELSE 'unsupported' END AS operation, count(*) AS n_events FROM events GROUP BY 1")
def decoded_operations(spark, d):
    return table(spark, d, "events").groupBy(changelog.decoded(F.col("event_id") % 8).alias("operation")).agg(F.count(F.lit(1)).alias("n_events"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id % 3 = 1")
def selected_events(spark, d):
    """Only events of the selected (owner, table) pairs, whatever their case; a view is never selected."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Own"), (F.col("user_id") % 3).cast("string")).alias("owner"), F.col("event_type").alias("table_name"))
    chosen = spark.createDataFrame([("OWN1", "View", "table"), ("own1", "CLICK", "partitioned_table"), ("own1", "signup", "view")], "owner string, table_name string, object_type string")
    return changelog.selected(e, chosen).select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN user_id || ' -> ' || (user_id + 1) ELSE user_id::VARCHAR END AS summary FROM events")
def event_summaries(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", changelog.key_summary(F.col("user_id"), F.when(F.col("event_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))).alias("summary"))


# ---------------------------------------------------------------- statements


def _statements(spark, d):
    """Statements of the log about customers, with quotes, commas and the keyword AND within text."""
    c = table(spark, d, "customer").withColumn("note", F.concat(F.lit("it''s (a, b) and WHERE "), "c_mktsegment"))
    k, name = F.col("c_custkey").cast("string"), F.col("c_name")
    update = F.concat(F.lit('update "SHOP"."CUSTOMER" set "C_NOTE" = \''), "note", F.lit("', \"C_CUSTKEY\" = '"), (F.col("c_custkey") + 1000000).cast("string"), F.lit("' where \"C_CUSTKEY\" = '"), k, F.lit("' and \"C_NAME\" = '"), name, F.lit('\' and "C_GONE" IS NULL and ROWID = \'AAA\';'))
    insert = F.concat(F.lit('insert into "SHOP"."CUSTOMER"("C_CUSTKEY","C_NOTE","C_NAME","C_AT") values ('), k, F.lit(", '"), "note", F.lit("', N'"), name, F.lit("', TO_DATE('2024-01-02', 'YYYY-MM-DD'));"))
    delete = F.concat(F.lit('delete from "SHOP"."CUSTOMER" where "C_NAME" = \''), name, F.lit("' and \"C_CUSTKEY\" = '"), k, F.lit("';"))
    kind = F.col("c_custkey") % 3
    return c.select("c_custkey", F.when(kind == 0, update).when(kind == 1, insert).otherwise(delete).alias("sql"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN c_custkey::VARCHAR || '/' || c_name END AS old_key,
CASE c_custkey % 3 WHEN 0 THEN (c_custkey + 1000000)::VARCHAR ELSE c_custkey::VARCHAR END || '/' || c_name AS new_key FROM customer""")
def redo_keys(spark, d):
    keys = ["C_CUSTKEY", "C_NAME"]
    text = lambda m: F.when(m.isNotNull(), F.concat_ws("/", m["C_CUSTKEY"], m["C_NAME"]))
    s = _statements(spark, d)
    found = s.select("c_custkey", redo.old_key_column(F.col("sql"), keys).alias("o"), redo.new_key_column(F.col("sql"), keys).alias("n"))
    return found.select("c_custkey", text(F.col("o")).alias("old_key"), text(F.col("n")).alias("new_key"))


@query("SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def redo_dates(spark, d):
    at = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    text = F.upper(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(at, "dd-MMM-yy hh.mm.ss a")).otherwise(F.date_format(at, "dd-MMM-yyyy HH.mm.ss")))
    return table(spark, d, "orders").select("o_orderkey", redo.date_text_column(text).alias("at"))


@query("SELECT p_partkey, p_name || '''s' AS text_value, p_size::VARCHAR AS number_value, upper(p_brand) AS raw_value FROM part")
def redo_literals(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", redo.literal_column(F.concat(F.lit("N'"), "p_name", F.lit("''s'"))).alias("text_value"), redo.literal_column(F.concat(F.col("p_size").cast("string"), F.lit(".00"))).alias("number_value"), redo.literal_column(F.concat(F.lit("HEXTORAW('"), F.lower("p_brand"), F.lit("')"))).alias("raw_value"))


# ---------------------------------------------------------------- validation

_PAIRS = ("orders", "nation", "region", "lineitem")


def _pairs(spark, d):
    n, r, li = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "lineitem")
    return [
        validate.Pair("orders", orders_source(spark, d), orders_target(spark, d).withColumnRenamed("o_custkey", "O_CUSTKEY"), primary=("o_orderkey",)),
        validate.Pair("nation", n, n, primary=("n_nationkey",), target_name="Nation"),
        validate.Pair("region", r, r.where("r_regionkey <> 0"), business=("r_regionkey",), not_null=("r_regionkey",)),
        validate.Pair("lineitem", li, li),
        validate.Pair("nation", n, None),
    ]


def _run_sql(most: int, beyond: str) -> str:
    mode = f"CASE WHEN key_kind <> 'none' AND greatest(s, t) <= {most} THEN 'full' ELSE '{beyond}' END"
    return f"""WITH {ORDERS_SQL}, o AS (SELECT count(*) FILTER (s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.o_orderstatus <> t.o_orderstatus OR s.o_totalprice <> t.o_totalprice) AS n FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey),
r AS (SELECT 'orders' AS requested, 'primary' AS key_kind, (SELECT count(*) FROM s) AS s, (SELECT count(*) FROM t) AS t, (SELECT n FROM o) AS n, true AS named
UNION ALL SELECT 'nation', 'primary', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), 0, false
UNION ALL SELECT 'region', 'business', (SELECT count(*) FROM region), (SELECT count(*) FROM region WHERE r_regionkey <> 0), 1, true
UNION ALL SELECT 'lineitem', 'none', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem), 0, true),
m AS (SELECT *, {mode} AS hash_mode FROM r)
SELECT requested, key_kind, s AS source_rows, t AS target_rows, hash_mode, CASE WHEN hash_mode = 'count_only' OR key_kind = 'none' AND n > 0 THEN -1 ELSE n END AS difference_rows, named AND s = t AND (hash_mode = 'count_only' OR n = 0) AS passed FROM m"""


def _run(spark, d, **options):
    return validate.validate(spark, _pairs(spark, d), **options).select("requested", "key_kind", "source_rows", "target_rows", "hash_mode", F.coalesce("difference_rows", F.lit(-1)).cast("long").alias("difference_rows"), "passed")


@query(_run_sql(MAX_HASHED_ROWS, "count_only"))
def validate_run(spark, d):
    return _run(spark, d)


@query(_run_sql(1000, "fingerprint"))
def validate_run_beyond_cap(spark, d):
    """Beyond the cap tables are compared by a fingerprint that needs no order and has no limit."""
    return _run(spark, d, most=1000, beyond="fingerprint")


@query(f"""WITH {ORDERS_SQL} SELECT 'o_orderstatus' AS column_name, count(*) FILTER (s.o_orderstatus <> t.o_orderstatus) AS differing_rows FROM s JOIN t ON s.o_orderkey = t.o_orderkey
UNION ALL SELECT 'o_totalprice', count(*) FILTER (s.o_totalprice <> t.o_totalprice) FROM s JOIN t ON s.o_orderkey = t.o_orderkey""")
def key_diff_folded_names(spark, d):
    """Column names that differ in case are the same columns."""
    t = orders_target(spark, d)
    return compare.diff_columns(compare.key_diff(orders_source(spark, d), t.select(*(F.col(c).alias(c.upper()) for c in t.columns)), ["o_orderkey"], check=True))


_RUNS_SQL = "runs AS (SELECT user_id, count(*) AS tables, bool_and(event_type <> 'error') AS passed FROM events GROUP BY user_id)"


@query(f"WITH {_RUNS_SQL}, f AS (SELECT * FROM runs WHERE NOT passed), p AS (SELECT greatest(1, ceil(count(*) / 10.0))::BIGINT AS pages FROM f) SELECT user_id, tables, (SELECT pages FROM p) AS page FROM f ORDER BY user_id LIMIT 10 OFFSET (SELECT (pages - 1) * 10 FROM p)")
def validation_history_page(spark, d):
    """The last page of failed runs, asked for beyond the end."""
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("tables"), F.every(F.col("event_type") != "error").alias("passed"))
    rows, number, _ = validate.page(validate.with_status(runs, "failed"), ["user_id"], 1_000_000, 10)
    return rows.select("user_id", "tables", F.lit(number).cast("long").alias("page"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT upper(p_type) FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
r AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT DISTINCT '-' || p_brand FROM part UNION SELECT DISTINCT p_type || '' FROM part),
f AS (SELECT lower(name) AS low, count(*) AS n, min(name) AS one FROM a GROUP BY 1)
SELECT r.name AS requested, coalesce(a.name, CASE WHEN n = 1 THEN one END) AS name, CASE WHEN a.name IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'folded' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS how
FROM r LEFT JOIN a ON r.name = a.name LEFT JOIN f ON lower(r.name) = f.low""")
def name_resolution(spark, d):
    p = table(spark, d, "part")
    only = lambda *cs: [p.select(c.alias("name")) for c in cs]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionAll(union(xs[1:]))
    brand, kind = F.col("p_brand"), F.col("p_type")
    return validate.resolve_names(union(only(brand, F.lower(brand), F.concat(F.lit("-"), brand), kind)), union(only(brand, F.upper(kind), F.lower(kind))))


# ---------------------------------------------------------------- catalogs

_SEGMENTS = f"""seg AS (SELECT 'lineitem' AS table_name, l_returnflag AS segment, sum({bytes_sql('lineitem')})::BIGINT AS bytes FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'orders', o_orderstatus, sum({bytes_sql('orders')})::BIGINT FROM orders GROUP BY o_orderstatus)"""


def _segments(spark, d):
    out = []
    for t, by in (("lineitem", "l_returnflag"), ("orders", "o_orderstatus")):
        df = table(spark, d, t).select(*TEXTS[t].split(), *OTHERS[t].split())
        out.append(df.groupBy(F.col(by).alias("segment")).agg(F.sum(assess.row_bytes(df)).alias("bytes")).select(F.lit(t).alias("table_name"), "segment", "bytes"))
    return out[0].unionAll(out[1])


def _names(spark):
    return spark.createDataFrame([(t,) for t in TABLES], "table_name string")


@query(f"WITH {_TABLES}, {_SEGMENTS} SELECT table_name, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM tb LEFT JOIN seg USING (table_name) GROUP BY table_name")
def table_sizes(spark, d):
    return catalog.sizes(_names(spark), _segments(spark, d))


_CONSTRAINTS = [(f"pk_{t}", "P", t, None) for t in KEYS] + [(f"fk_{c}_{col}", "R", c, f"pk_{p}") for c, col, p, _ in FOREIGN]
_CON_SQL = _values("con", _CONSTRAINTS, "name, kind, table_name, refers_to")


def _constraints(spark):
    return spark.createDataFrame(_CONSTRAINTS, "name string, kind string, table_name string, refers_to string")


@query(f"WITH {_CON_SQL} SELECT c.table_name AS child, p.table_name AS parent, c.name FROM con c JOIN con p ON c.refers_to = p.name WHERE c.kind = 'R' AND p.kind IN ('P', 'U') ORDER BY c.name LIMIT 20")
def fk_self_join(spark, d):
    return catalog.foreign_keys(_constraints(spark))


@query(f"""WITH {_TABLES}, {_CON_SQL}, col AS (SELECT table_name, column_name, data_type FROM information_schema.columns)
SELECT table_name, EXISTS (SELECT 1 FROM con WHERE con.table_name = tb.table_name AND kind = 'P') AS has_key, EXISTS (SELECT 1 FROM col WHERE col.table_name = tb.table_name AND data_type LIKE '%[]') AS has_large,
(SELECT count(*) FROM con WHERE con.table_name = tb.table_name AND kind = 'R') AS n_indexes FROM tb""")
def marked_tables(spark, d):
    con = _constraints(spark)
    large = [(t,) for t in TABLES if "array" in dict(table(spark, d, t).dtypes).__str__()]
    return catalog.marked(_names(spark), con.where("kind = 'P'"), spark.createDataFrame(large, "table_name string"), con.where("kind = 'R'"))


@query("SELECT event_id, concat_ws(' OR ', CASE WHEN event_id & 4 <> 0 THEN 'INSERT' END, CASE WHEN event_id & 8 <> 0 THEN 'DELETE' END, CASE WHEN event_id & 16 <> 0 THEN 'UPDATE' END, CASE WHEN event_id & 32 <> 0 THEN 'TRUNCATE' END) AS fires_on FROM events")
def trigger_events(spark, d):
    return table(spark, d, "events").select("event_id", catalog.trigger_events(F.col("event_id")).alias("fires_on"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM part) > 100 AS truncated FROM part ORDER BY p_name, p_partkey LIMIT 100")
def truncated_detail(spark, d):
    return catalog.truncated(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type")
def ordered_distinct(spark, d):
    return catalog.ordered_distinct(table(spark, d, "events"), "event_type", "event_id")


@query("SELECT count(DISTINCT (p_brand, p_type)) AS pairs FROM part")
def distinct_pairs(spark, d):
    return table(spark, d, "part").agg(F.count_distinct("p_brand", "p_type").alias("pairs"))


@query("SELECT column_name FROM information_schema.columns WHERE table_name = 'customer' AND column_name NOT IN (SELECT replace(column_name, 's_', 'c_') FROM information_schema.columns WHERE table_name = 'supplier')")
def missing_columns(spark, d):
    names = lambda t: spark.createDataFrame([(c,) for c in table(spark, d, t).columns], "column_name string")
    return names("customer").subtract(names("supplier").select(F.replace("column_name", F.lit("s_"), F.lit("c_")).alias("column_name")))


@query("SELECT DISTINCT 'O' || (p_size % 7) AS owner FROM part WHERE 'O' || (p_size % 7) NOT IN ('O1') AND 'O' || (p_size % 7) NOT LIKE '%5'")
def owners(spark, d):
    return catalog.owners(table(spark, d, "part").select(F.concat(F.lit("O"), (F.col("p_size") % 7).cast("string")).alias("owner")), ["O1"], ["%5"])


_KEY_ROWS = [(t, c, i) for t, k in KEYS.items() for i, c in enumerate(k, 1)]


@query(f"""WITH {_TABLES}, {_values('k', _KEY_ROWS, 'name, column_name, position')}, n AS (SELECT table_name, count(*) AS n FROM information_schema.columns GROUP BY table_name), pk AS (SELECT name, string_agg(column_name, ',' ORDER BY position) AS primary_key FROM k GROUP BY name)
SELECT CASE WHEN tb.table_name IN ('orders', 'lineitem') THEN 'partitioned_table' ELSE 'table' END AS object_type, tb.table_name AS name, n.n AS n_columns, coalesce(primary_key, '') AS primary_key FROM tb JOIN n USING (table_name) LEFT JOIN pk ON pk.name = tb.table_name
UNION ALL SELECT 'view', 'v_orders', 0, '' UNION ALL SELECT 'sequence', 's_orders', 0, ''""")
def bulk_objects(spark, d):
    cols = [(t, c) for t in TABLES for c in table(spark, d, t).columns]
    one = lambda name: spark.createDataFrame([(name,)], "name string")
    parts = spark.createDataFrame([("orders",), ("lineitem",), ("orders",)], "name string")
    return catalog.bulk_objects(_names(spark).withColumnRenamed("table_name", "name"), parts, one("v_orders"), spark.createDataFrame(cols, "name string, column_name string"), spark.createDataFrame(_KEY_ROWS, "name string, column_name string, position int"), one("s_orders"))


@query("SELECT p_type AS object_type, count(*) AS n_objects FROM part GROUP BY p_type UNION ALL SELECT 'total', count(*) FROM part")
def object_counts(spark, d):
    return catalog.object_counts(table(spark, d, "part").select(F.col("p_type").alias("object_type")))


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN 'RANGE' ELSE 'LIST' END || CASE WHEN p_size % 2 = 0 THEN '-HASH' ELSE '' END AS layout, count(*) AS n_tables, sum(p_size)::BIGINT AS n_partitions FROM part GROUP BY 1""")
def partition_distribution(spark, d):
    sub = F.when(F.col("p_size") % 2 == 0, "HASH").when(F.col("p_size") % 5 == 0, "NONE")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("table_name"), F.when(F.col("p_size") % 3 == 0, "RANGE").otherwise("LIST").alias("kind"), sub.alias("sub_kind"), F.col("p_size").alias("partitions"))
    return catalog.partition_distribution(p)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'me' END AS owner, p_name AS object FROM (SELECT p_partkey, p_brand, replace(replace(p_name, '.', '_'), '"', '') AS p_name FROM part)""")
def name_parts(spark, d):
    p = table(spark, d, "part").withColumn("n", F.regexp_replace("p_name", "[.\"]", "_"))
    p = p.withColumn("n", F.replace(F.replace("p_name", F.lit("."), F.lit("_")), F.lit('"'), F.lit("")))
    full = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"."'), "n", F.lit('"'))).otherwise(F.col("n"))
    owner, name = naming.name_parts(full, "me")
    return p.select("p_partkey", owner.alias("owner"), name.alias("object"))


# ---------------------------------------------------------------- assessment

_LARGE_TEXT = ("documents", "pages", "benchmark", "conversations")
_N_FOREIGN = {t: sum(1 for f in FOREIGN if f[0] == t) for t in TABLES}
_FACT_ROWS = [(t, t in KEYS, t in _LARGE_TEXT, _N_FOREIGN[t]) for t in TABLES]
_RISK_SQL = f"""{FACTS_SQL}, {_values('known', [(t, str(k).lower(), str(big).lower(), n) for t, k, big, n in _FACT_ROWS], 'table_name, has_key, has_large, n_foreign')},
f AS (SELECT * FROM facts JOIN known USING (table_name)),
risks AS (SELECT 'warning' AS level, 'data' AS category, 'NO_PRIMARY_KEY' AS code, table_name AS object FROM f WHERE has_key = 'false' UNION ALL SELECT 'warning', 'data', 'LEGACY_LOB', table_name FROM f WHERE has_large = 'true'
UNION ALL SELECT 'warning', 'data', 'LARGE_TABLE', table_name FROM f WHERE n_rows > 50000000 UNION ALL SELECT 'info', 'objects', 'FOREIGN_KEYS', table_name FROM f WHERE n_foreign > 0),
checks AS (SELECT 'events' AS table_name, 'null_rate' AS ck, (count(*) - count(CASE WHEN event_id % 3 <> 0 THEN value END)) / count(*) AS v FROM events
UNION ALL SELECT 'lineitem', 'duplicates', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'documents', 'overlong', count(*) FROM documents WHERE length(text) > 16383 UNION ALL SELECT 'nation', 'null_rate', (count(*) - count(n_name)) / count(*) FROM nation),
quality AS (SELECT CASE ck WHEN 'duplicates' THEN 'blocking' ELSE 'warning' END AS level, 'quality' AS category, CASE ck WHEN 'null_rate' THEN 'QUALITY_NULL_RATE' WHEN 'duplicates' THEN 'QUALITY_DUPLICATES' ELSE 'QUALITY_OVERLONG' END AS code, table_name AS object FROM checks WHERE v > CASE ck WHEN 'null_rate' THEN 0.3 ELSE 0 END)"""


def _known_facts(spark, d):
    known = spark.createDataFrame(_FACT_ROWS, "table_name string, has_key boolean, has_large boolean, n_foreign int")
    return facts(spark, d).join(known, "table_name")


def _checks(spark, d):
    e, li, docs, n = (table(spark, d, t) for t in ("events", "lineitem", "documents", "nation"))
    rate = quality.null_rate
    found = [
        e.agg(rate(F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("value")).select(F.lit("events").alias("table_name"), F.lit("null_rate").alias("check"), "value"),
        quality.duplicate_keys(li, ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("lineitem"), F.lit("duplicates"), "value"),
        docs.agg(F.count_if(F.length("text") > report.LONG_TEXT).cast("double").alias("value")).select(F.lit("documents"), F.lit("overlong"), "value"),
        n.agg(rate(F.col("n_name")).alias("value")).select(F.lit("nation"), F.lit("null_rate"), "value"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def _risks(spark, d):
    return report.table_risks(_known_facts(spark, d)).unionByName(report.quality_risks(_checks(spark, d)))


@query(f"WITH {_RISK_SQL} SELECT level, category, code, object FROM risks UNION ALL SELECT level, category, code, object FROM quality")
def derived_risks(spark, d):
    return _risks(spark, d)


@query(f"""WITH {_RISK_SQL}, a AS (SELECT level FROM risks UNION ALL SELECT level FROM quality) SELECT greatest(0, 100 - 25 * count(*) FILTER (level = 'blocking') - 4 * count(*) FILTER (level = 'warning'))::BIGINT AS score, count(*) FILTER (level = 'blocking') = 0 AS ready FROM a""")
def derived_score(spark, d):
    return assess.readiness(_risks(spark, d))


@query(f"""WITH {_RISK_SQL}, a AS (SELECT code FROM risks), x AS (SELECT sum(bytes) AS b, max(n_rows) AS r FROM facts)
SELECT 'SPLIT_BY_SIZE' AS code FROM x WHERE b > 10737418240 UNION ALL SELECT 'RAISE_CONCURRENCY' FROM x WHERE r > 5000000 UNION ALL SELECT 'ADD_KEYS' WHERE EXISTS (SELECT 1 FROM a WHERE code = 'NO_PRIMARY_KEY')
UNION ALL SELECT 'SMALLER_BATCHES' WHERE EXISTS (SELECT 1 FROM a WHERE code = 'LEGACY_LOB') UNION ALL SELECT 'CONSTRAINTS_LAST' WHERE EXISTS (SELECT 1 FROM a WHERE code = 'FOREIGN_KEYS')
UNION ALL SELECT 'CLEAR_BLOCKERS' WHERE EXISTS (SELECT 1 FROM quality WHERE level = 'blocking')""")
def suggestions(spark, d):
    return report.suggestions(_known_facts(spark, d), _risks(spark, d))


_PARAM_SQL = """src AS (SELECT lower(n_name) AS name, n_regionkey::VARCHAR AS v FROM nation WHERE n_nationkey % 5 <> 0), tgt AS (SELECT lower(n_name) AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE n_regionkey::VARCHAR END AS v FROM nation WHERE n_nationkey % 7 <> 0),
params AS (SELECT coalesce(src.name, tgt.name) AS name, src.v AS source_value, tgt.v AS target_value, CASE WHEN src.v IS NULL OR tgt.v IS NULL THEN 'unknown' WHEN lower(src.v) = lower(tgt.v) THEN 'ok' WHEN regexp_matches(coalesce(src.name, tgt.name), 'char|collat|case|sql_mode|isolation|zone') THEN 'warning' ELSE 'info' END AS risk FROM src FULL JOIN tgt ON src.name = tgt.name)"""


def _parameters(spark, d):
    n = table(spark, d, "nation")
    value = F.col("n_regionkey").cast("string")
    return report.compare_parameters(n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), value.alias("value")), n.where("n_nationkey % 7 <> 0").select(F.upper("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise(value).alias("value")))


@query(f"WITH {_PARAM_SQL} SELECT name, source_value, target_value, risk FROM params")
def parameter_comparison(spark, d):
    return _parameters(spark, d)


@query(f"""WITH {_RISK_SQL}, {_PARAM_SQL}, a AS (SELECT category, level FROM risks UNION ALL SELECT category, level FROM quality UNION ALL SELECT 'parameters', 'warning' FROM params WHERE risk = 'warning'),
b AS (SELECT category, level FROM a UNION ALL SELECT 'overall', level FROM a), n AS (SELECT category, count(*) FILTER (level = 'blocking') AS n_blocking, count(*) FILTER (level = 'warning') AS n_warning FROM b GROUP BY category)
SELECT v.d AS dimension, CASE WHEN coalesce(n_blocking, 0) > 0 THEN 'blocked' WHEN coalesce(n_warning, 0) > 0 THEN 'attention' ELSE 'ok' END AS status, coalesce(n_blocking, 0)::BIGINT AS n_blocking, coalesce(n_warning, 0)::BIGINT AS n_warning
FROM (VALUES ('parameters'), ('objects'), ('data'), ('quality'), ('overall')) v(d) LEFT JOIN n ON v.d = n.category""")
def conclusion(spark, d):
    return report.conclusion(_risks(spark, d), _parameters(spark, d))


@query(f"""WITH {FACTS_SQL}, e AS (SELECT round(bytes::DOUBLE * 8 / 50000000 + greatest(1, floor(n_rows / 2000)) * 0.05::DOUBLE + n_rows * 0.00002::DOUBLE, 4) AS x FROM facts ORDER BY bytes DESC, table_name LIMIT 5)
SELECT count(*) AS tables, round(sum(x) / 4, 4) AS seconds, round(sum(x) / 4 * 0.8, 4) AS seconds_low, round(sum(x) / 4 * 1.6, 4) AS seconds_high FROM e""")
def total_estimate(spark, d):
    return report.total_estimate(facts(spark, d), concurrency=4, top=5)


@query(f"WITH {FACTS_SQL} SELECT table_name, n_rows FROM facts WHERE n_rows <= 200000 ORDER BY n_rows DESC, table_name LIMIT 20")
def quality_candidates(spark, d):
    return report.candidates(facts(spark, d).select("table_name", "n_rows"))


_COLUMN_ROWS = [(t, c, "large" if c in ("text", "html", "embedding") else "date" if c.endswith(("date", "ts")) else "text" if c in TEXTS[t].split() else "number", 40 if c.endswith("_name") else None) for t in TABLES for c in (*TEXTS[t].split(), *OTHERS[t].split())]


@query(f"""WITH {FACTS_SQL}, {_values('col', _COLUMN_ROWS, 'table_name, column_name, kind, len')}, p AS (SELECT table_name, sum(CASE WHEN len IS NOT NULL THEN least(len, 4096) WHEN kind = 'large' THEN 4096 WHEN kind = 'date' THEN 32 WHEN kind = 'number' THEN 16 ELSE 64 END)::BIGINT AS r FROM col GROUP BY table_name)
SELECT table_name, n_rows, r AS row_estimate, (n_rows * r)::BIGINT AS bytes_estimate FROM facts JOIN p USING (table_name)""")
def quick_sizes(spark, d):
    cols = spark.createDataFrame(_COLUMN_ROWS, "table_name string, column_name string, kind string, length int")
    return report.quick_sizes(cols, facts(spark, d).select("table_name", "n_rows"))


@query("""WITH f AS (SELECT p_partkey, p_size % 2 = 0 AS has_key, p_size % 11 = 0 AS is_view, p_size % 13 = 0 AS renamed, p_size % 17 = 0 AS ext, p_size % 3 = 0 AS lob, p_size % 19 = 0 AS tz, p_size % 4 = 1 AS sur, p_size % 7 = 0 AS ex, p_size % 5 = 0 AS cs FROM part)
SELECT p_partkey::VARCHAR AS table_name, 'warning' AS level, 'VIEW_MATERIALIZED' AS code FROM f WHERE is_view UNION ALL SELECT p_partkey::VARCHAR, 'info', 'NAME_TRANSFORM' FROM f WHERE renamed UNION ALL SELECT p_partkey::VARCHAR, 'blocking', 'BFILE_EXTERNAL' FROM f WHERE ext
UNION ALL SELECT p_partkey::VARCHAR, 'warning', 'LEGACY_LOB' FROM f WHERE lob UNION ALL SELECT p_partkey::VARCHAR, 'warning', 'TIMEZONE_TO_TEXT' FROM f WHERE tz UNION ALL SELECT p_partkey::VARCHAR, 'warning', 'NO_PRIMARY_KEY' FROM f WHERE NOT has_key AND NOT is_view AND NOT sur
UNION ALL SELECT p_partkey::VARCHAR, 'warning', 'SYNTHETIC_PRIMARY_KEY' FROM f WHERE NOT has_key AND NOT is_view AND sur UNION ALL SELECT p_partkey::VARCHAR, 'blocking', 'TARGET_EXISTS' FROM f WHERE ex UNION ALL SELECT p_partkey::VARCHAR, 'warning', 'NAME_CASE' FROM f WHERE cs AND NOT ex""")
def quick_risks(spark, d):
    n = lambda k, r=0: F.col("p_size") % k == r
    t = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("table_name"), n(11).alias("is_view"), n(13).alias("renamed"), n(17).alias("has_external"), n(3).alias("has_large"), n(19).alias("has_zoned"), n(2).alias("has_key"), n(4, 1).alias("takes_surrogate"), n(7).alias("target_exists"), n(5).alias("target_case"))
    return report.quick_risks(t)


@query("""WITH v AS (SELECT o_orderkey, o_orderkey * 977 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 60 THEN n || ' s' WHEN n < 3600 THEN (n // 60) || ' min ' || (n % 60) || ' s' WHEN n < 86400 THEN (n // 3600) || ' h ' || (n % 3600 // 60) || ' min' ELSE (n // 86400) || ' d ' || (n % 86400 // 3600) || ' h' END AS took FROM v""")
def human_durations(spark, d):
    return table(spark, d, "orders").select("o_orderkey", report.human_duration(F.col("o_orderkey") * 977).alias("took"))
