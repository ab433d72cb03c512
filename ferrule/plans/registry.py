"""All named queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import naming
from ferrule.operators import assess, catalog, changelog, compare, load, quality
from ferrule.plans.fixtures import CHANGES_SQL, FACTS_SQL, FOREIGN, KEYS, ORDERS_SQL, TABLES, changes, facts, money, orders_source, orders_target, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _values(name: str, rows: list[tuple], cols: str) -> str:
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows) + ")"


# ---------------------------------------------------------------- comparison

_ORDER_KEY = ["o_orderkey"]
_JOINED = f"""WITH {ORDERS_SQL}, j AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
  CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target' WHEN s.o_orderkey IS NULL THEN 'missing_in_source'
       WHEN s.o_custkey IS DISTINCT FROM t.o_custkey OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus OR s.o_totalprice IS DISTINCT FROM t.o_totalprice OR s.o_orderdate IS DISTINCT FROM t.o_orderdate OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'changed' ELSE 'equal' END AS diff_class,
  s.o_orderstatus IS DISTINCT FROM t.o_orderstatus AS d1, s.o_totalprice IS DISTINCT FROM t.o_totalprice AS d2 FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey)"""


def _orders_diff(spark, d) -> DataFrame:
    return compare.key_diff(orders_source(spark, d), orders_target(spark, d), _ORDER_KEY)


@query(f"{_JOINED} SELECT diff_class, count(*) AS n_rows FROM j GROUP BY diff_class")
def key_diff_classes(spark, d):
    return _orders_diff(spark, d).groupBy("diff_class").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"{_JOINED} SELECT o_orderkey, diff_class FROM j WHERE diff_class <> 'equal'")
def key_diff_rows(spark, d):
    return _orders_diff(spark, d).where("diff_class <> 'equal'").select("o_orderkey", "diff_class")


@query(f"""{_JOINED} SELECT 'o_orderstatus' AS column_name, count(*) AS differing_rows FROM j WHERE diff_class = 'changed' AND d1
UNION ALL SELECT 'o_totalprice', count(*) FROM j WHERE diff_class = 'changed' AND d2""")
def key_diff_columns(spark, d):
    return compare.diff_columns(_orders_diff(spark, d))


@query(f"""{_JOINED} SELECT o_orderkey, diff_class, concat_ws(',', CASE WHEN d1 AND diff_class = 'changed' THEN 'o_orderstatus' END, CASE WHEN d2 AND diff_class = 'changed' THEN 'o_totalprice' END) AS differing
FROM j WHERE diff_class <> 'equal' ORDER BY o_orderkey LIMIT 20""")
def key_diff_samples(spark, d):
    bad = _orders_diff(spark, d).where("diff_class <> 'equal'").orderBy("o_orderkey").limit(20)
    return bad.select("o_orderkey", "diff_class", F.array_join("differ", ",").alias("differing"))


_POSITION = """WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, * FROM customer), t AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, * FROM (SELECT * FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer))),
j AS (SELECT coalesce(s.i, t.i) AS row_index, s.c_custkey IS DISTINCT FROM t.c_custkey AS d1, s.c_nationkey IS DISTINCT FROM t.c_nationkey AS d2, s.c_mktsegment IS DISTINCT FROM t.c_mktsegment AS d3 FROM s FULL JOIN t ON s.i = t.i)"""


def _positional(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    least = c.agg(F.min("c_custkey").alias("m"))
    return compare.positional_diff(c, c.join(least, F.col("c_custkey") > F.col("m")).drop("m"), ["c_custkey"])


@query(f"{_POSITION} SELECT row_index, (d1::INT + d2::INT + d3::INT)::BIGINT AS n_columns FROM j WHERE d1 OR d2 OR d3")
def positional_diff_rows(spark, d):
    return _positional(spark, d).select("row_index", F.size("differ").cast("long").alias("n_columns"))


@query(f"{_POSITION} SELECT 'c_custkey' AS column_name, count(*) FILTER (d1) AS differing_rows FROM j UNION ALL SELECT 'c_nationkey', count(*) FILTER (d2) FROM j UNION ALL SELECT 'c_mktsegment', count(*) FILTER (d3) FROM j")
def positional_diff_columns(spark, d):
    return _positional(spark, d).select(F.explode("differ").alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("differing_rows"))


_CUSTOMER_TEXT = "concat_ws('|', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR, c_mktsegment)"


def _customer(spark, d):
    c = money(table(spark, d, "customer"), "c_acctbal")
    return c, F.concat_ws("|", *(F.col(x).cast("string") for x in c.columns))


@query(f"SELECT c_custkey, sha256({_CUSTOMER_TEXT}) AS row_hash FROM customer")
def row_hash(spark, d):
    c, text = _customer(spark, d)
    return c.select("c_custkey", F.sha2(text, 256).alias("row_hash"))


@query(f"WITH r AS (SELECT c_custkey, {_CUSTOMER_TEXT} AS t FROM customer) SELECT sha256(string_agg(lpad(strlen(t)::VARCHAR, 8, '0') || t, '|' ORDER BY c_custkey)) AS digest FROM r")
def ordered_digest(spark, d):
    c, text = _customer(spark, d)
    return compare.ordered_digest(c, ["c_custkey"], text)


@query(f"SELECT count(*) AS row_count, sum(('0x' || substr(sha256({_CUSTOMER_TEXT}), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS hash_sum FROM customer")
def fingerprint(spark, d):
    return compare.fingerprint(*_customer(spark, d))


@query(f"""WITH {ORDERS_SQL} SELECT 'orders' AS table_name, (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, NOT EXISTS ((SELECT * FROM s EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM s)) AS passed
UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), true UNION ALL SELECT 'region', (SELECT count(*) FROM region), (SELECT count(*) FROM region WHERE r_regionkey <> 0), false""")
def validate_summary(spark, d):
    """Counts and content of each pair of tables; the fingerprint needs neither order nor a limit on rows."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    out = None
    for name, source, target in (("orders", orders_source(spark, d), orders_target(spark, d)), ("nation", n, n), ("region", r, r.where("r_regionkey <> 0"))):
        s, t = (compare.fingerprint(x, compare.record(x)).select(F.col("row_count").alias(f"{side}_rows"), F.col("hash_sum").alias(f"{side}_hash")) for side, x in (("source", source), ("target", target)))
        same = F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_hash").eqNullSafe(F.col("target_hash"))
        one = s.join(t, F.lit(True)).select(F.lit(name).alias("table_name"), "source_rows", "target_rows", same.alias("passed"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""WITH t AS (SELECT * FROM nation WHERE n_nationkey % 7 <> 0 UNION ALL SELECT * FROM nation WHERE n_nationkey = 3),
b AS (SELECT n_nationkey, n_name, n_regionkey, 1 AS s, 0 AS t FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 0, 1 FROM t)
SELECT '[["number","' || n_nationkey || '"],["text","' || n_name || '"],["number","' || n_regionkey || '"]]' AS record, sum(s)::BIGINT AS source_rows, sum(t)::BIGINT AS target_rows FROM b GROUP BY n_nationkey, n_name, n_regionkey HAVING sum(s) <> sum(t)""")
def multiset_diff(spark, d):
    n = table(spark, d, "nation")
    return compare.multiset_diff(n, n.where("n_nationkey % 7 <> 0").unionAll(n.where("n_nationkey = 3")))


@query("SELECT r_regionkey, '[[\"number\",\"' || r_regionkey || '\"],[\"text\",\"' || r_name || '\"]]' AS record FROM region")
def canonical_records(spark, d):
    r = table(spark, d, "region")
    return r.select("r_regionkey", compare.record(r).alias("record"))


@query(f"WITH {ORDERS_SQL} SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, (SELECT count(*) FROM s) = (SELECT count(*) FROM t) AS equal_counts")
def row_count_compare(spark, d):
    s = orders_source(spark, d).agg(F.count(F.lit(1)).alias("source_rows"))
    t = orders_target(spark, d).agg(F.count(F.lit(1)).alias("target_rows"))
    return s.join(t, F.lit(True)).withColumn("equal_counts", F.col("source_rows") == F.col("target_rows"))


def _small(spark, d, name):
    return table(spark, d, name)


#: Fixed value: rows of a table beyond which only counts are compared.
MAX_HASHED_ROWS = 100_000
_MODE_TABLES = ("orders", "customer", "part", "supplier", "lineitem")
_MODES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, CASE WHEN {'true' if t in KEYS else 'false'} AND count(*) <= {MAX_HASHED_ROWS} THEN 'full' ELSE 'count_only' END AS hash_mode FROM {t}" for t in _MODE_TABLES)


@query(_MODES_SQL)
def validate_modes(spark, d):
    """full where a key exists and the table is small enough, else counts only."""
    out = None
    for name in _MODE_TABLES:
        df = table(spark, d, name)
        kind, _ = compare.choose_key([(c, False) for c in df.columns], KEYS.get(name, []), [])
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.when(F.lit(kind != "none") & (F.col("n_rows") <= MAX_HASHED_ROWS), "full").otherwise("count_only").alias("hash_mode"))
        out = one if out is None else out.unionAll(one)
    return out


@query("""SELECT 'pair' AS proposal, 0::BIGINT AS null_rows, count(*) AS duplicate_groups FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'four', 0, count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber HAVING count(*) > 1)""")
def key_policy(spark, d):
    li = table(spark, d, "lineitem")
    two = compare.check_key(li, ["l_orderkey", "l_linenumber"]).select(F.lit("pair").alias("proposal"), "*")
    return two.unionAll(compare.check_key(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]).select(F.lit("four").alias("proposal"), "*"))


# ---------------------------------------------------------------- quality


@query("""WITH n AS (SELECT CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 4 <> 0 THEN props END AS props, user_id FROM events)
SELECT 'value' AS column_name, round((count(*) - count(value)) / count(*), 2) AS null_rate FROM n UNION ALL SELECT 'props', round((count(*) - count(props)) / count(*), 2) FROM n UNION ALL SELECT 'user_id', round((count(*) - count(user_id)) / count(*), 2) FROM n""")
def null_rates(spark, d):
    e = table(spark, d, "events")
    return quality.null_rates(e.select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("props"), "user_id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'text' AS column_name, max(length(text)) AS longest FROM documents HAVING max(length(text)) > 16383")
def overlong_strings(spark, d):
    return quality.overlong(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), 16383)


@query(r"SELECT doc_id, 'text' AS column_name FROM documents WHERE doc_id % 50 = 0 OR regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')")
def encoding_issues(spark, d):
    docs = table(spark, d, "documents")
    return quality.encoding_issues(docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("\x01"))).otherwise(F.col("text"))), ["doc_id"], ["source", "text"])


@query("SELECT 'value' AS column_name, coalesce(bool_or(CAST(value AS DECIMAL(18,2)) % 1 <> 0), false) AS has_fraction FROM events UNION ALL SELECT 'user_id', coalesce(bool_or(user_id % 1 <> 0), false) FROM events")
def fractional_probe(spark, d):
    return quality.fractional(money(table(spark, d, "events"), "value").select("value", "user_id"), ["value", "user_id"])


@query("SELECT lower(p_brand) AS target_name, count(DISTINCT p_brand) AS sources FROM (SELECT p_brand FROM part UNION ALL SELECT upper(p_brand) FROM part UNION ALL SELECT lower(p_brand) FROM part) GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def name_collisions(spark, d):
    p = table(spark, d, "part").select("p_brand")
    return naming.collisions(p.unionAll(p.select(F.upper("p_brand"))).unionAll(p.select(F.lower("p_brand"))), "p_brand", "lower")


@query("SELECT p_partkey, 'Shop.' || lower(replace(p_name, '.', '_')) AS target_name FROM part")
def name_map(spark, d):
    return table(spark, d, "part").select("p_partkey", naming.apply_policy(F.concat(F.lit("Shop."), F.replace("p_name", F.lit("."), F.lit("_"))), "lower").alias("target_name"))


@query("SELECT l.l_orderkey, count(*) AS n_rows FROM lineitem l ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey")
def orphan_fk_rows(spark, d):
    return quality.orphans(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", table(spark, d, "orders").where("o_orderkey % 10 <> 3"), "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT c_custkey AS new_key FROM customer WHERE c_custkey % 5 = 0 AND c_custkey IN (SELECT s_suppkey FROM supplier)")
def unique_conflicts(spark, d):
    return table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("new_key")).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("new_key")), "new_key", "left_semi")


# ---------------------------------------------------------------- catalog and assessment


def _catalog(spark, d):
    schemas = {t: T.StructType([f for f in table(spark, d, t).schema if f.name != "__index_level_0__"]) for t in TABLES}
    return assess.catalog(spark, schemas, KEYS, FOREIGN)


_KEY_SQL = _values("k", [(t, ",".join(c)) for t, c in KEYS.items()], "table_name, primary_key")
_TABLE_SQL = _values("tb", [(t,) for t in TABLES], "table_name")
_FK_SQL = _values("fk", FOREIGN, "child, child_column, parent, parent_column")


@query(f"WITH {_KEY_SQL}, {_TABLE_SQL} SELECT table_name, (SELECT count(*) FROM information_schema.columns c WHERE c.table_name = tb.table_name) AS n_columns, coalesce(primary_key, '') AS primary_key FROM tb LEFT JOIN k USING (table_name)")
def catalog_objects(spark, d):
    return assess.objects(_catalog(spark, d))


@query(f"WITH {_KEY_SQL}, {_TABLE_SQL} SELECT table_name FROM tb ANTI JOIN k USING (table_name)")
def no_pk_tables(spark, d):
    cat = _catalog(spark, d)
    return cat["tables"].join(cat["keys"], "table_name", "left_anti")


@query(f"WITH {_FK_SQL} SELECT child, parent, count(*) AS n_keys FROM fk GROUP BY child, parent")
def fk_pairs(spark, d):
    return _catalog(spark, d)["foreign_keys"].groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n_keys"))


@query(f"""WITH RECURSIVE {_FK_SQL}, tree(root, node, depth) AS (SELECT DISTINCT parent, parent, 0 FROM fk WHERE parent NOT IN (SELECT child FROM fk)
UNION ALL SELECT root, child, depth + 1 FROM tree JOIN (SELECT DISTINCT child, parent FROM fk) ON parent = node WHERE depth < 32)
SELECT root, node, min(depth) AS depth, (SELECT count(DISTINCT child) FROM fk WHERE parent = node) AS n_children FROM tree GROUP BY root, node""")
def fk_tree(spark, d):
    return catalog.fk_tree(_catalog(spark, d)["foreign_keys"])


@query(f"WITH {_TABLE_SQL} SELECT DISTINCT c.table_name, c.column_name FROM information_schema.columns c SEMI JOIN tb USING (table_name) WHERE c.data_type LIKE '%[]'")
def array_columns(spark, d):
    return _catalog(spark, d)["columns"].where("type LIKE 'array%'").select("table_name", "column_name")


@query(f"WITH {_TABLE_SQL} SELECT c.table_name, string_agg(c.column_name, ',' ORDER BY c.column_name) AS text_columns, count(*) AS n_columns FROM information_schema.columns c SEMI JOIN tb USING (table_name) WHERE c.data_type = 'VARCHAR' GROUP BY c.table_name")
def lob_columns(spark, d):
    """Columns of unbounded text, listed by table."""
    text = _catalog(spark, d)["columns"].where("type = 'string'")
    return text.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("text_columns"), F.count(F.lit(1)).alias("n_columns"))


@query(f"WITH {_TABLE_SQL} SELECT c.table_name, count(*) AS n_columns FROM information_schema.columns c SEMI JOIN tb USING (table_name) GROUP BY c.table_name")
def column_counts(spark, d):
    return _catalog(spark, d)["columns"].groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))


_ROWS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows" for t in TABLES)


def _row_counts(spark, d):
    out = None
    for t in TABLES:
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"SELECT table_name, n_rows FROM ({_ROWS_SQL}) ORDER BY n_rows DESC, table_name LIMIT 10")
def top_tables(spark, d):
    return _row_counts(spark, d).orderBy(F.desc("n_rows"), "table_name").limit(10)


@query(f"SELECT table_name FROM ({_ROWS_SQL}) WHERE n_rows = 0 UNION ALL SELECT 'region_left' WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey < 0)")
def empty_tables(spark, d):
    left = table(spark, d, "region").where("r_regionkey < 0").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("region_left").alias("table_name"), "n_rows")
    return _row_counts(spark, d).unionAll(left).where("n_rows = 0").select("table_name")


@query(f"WITH {FACTS_SQL} SELECT table_name, scale, CASE WHEN bytes * scale > 53687091200 THEN 'high' WHEN bytes * scale > 10737418240 THEN 'medium' WHEN n_rows * scale > 50000000 THEN 'high' WHEN n_rows * scale > 10000000 THEN 'medium' ELSE 'low' END AS pressure FROM facts, (VALUES (1::BIGINT), (1000), (1000000)) v(scale)")
def load_pressure(spark, d):
    """Of the tables as they are, and a thousand and a million times as large."""
    scaled = facts(spark, d).withColumn("scale", F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 1000, 1_000_000)))))
    return scaled.select("table_name", "scale", assess.load_pressure(F.col("n_rows") * F.col("scale"), F.col("bytes") * F.col("scale")).alias("pressure"))


@query(f"""WITH {FACTS_SQL}, e AS (SELECT table_name, bytes::DOUBLE * 8 / 50000000 + greatest(1, floor(n_rows / 2000)) * 0.05::DOUBLE + n_rows * 0.00002::DOUBLE AS x FROM facts)
SELECT table_name, round(x::DOUBLE, 4) AS seconds, round((x * 0.8)::DOUBLE, 4) AS seconds_low, round((x * 1.6)::DOUBLE, 4) AS seconds_high FROM e""")
def migration_estimate(spark, d):
    e = assess.estimate(F.col("n_rows").cast("double"), F.col("bytes").cast("double"))
    return facts(spark, d).select("table_name", *(v.alias(k) for k, v in e.items()))


@query("SELECT sum(8 + strlen(c_name) + 8 + 8 + strlen(c_mktsegment))::BIGINT AS total_bytes, max(8 + strlen(c_name) + 8 + 8 + strlen(c_mktsegment))::BIGINT AS widest FROM customer")
def row_bytes(spark, d):
    c = table(spark, d, "customer")
    return c.select(assess.row_bytes(c).alias("b")).agg(F.sum("b").alias("total_bytes"), F.max("b").alias("widest"))


_RISKS = [("warning", "NO_PRIMARY_KEY", "lineitem"), ("warning", "LEGACY_LOB", "documents"), ("info", "NAME_CASE", "part"), ("blocking", "TARGET_EXISTS", "orders")]


@query("SELECT 67::BIGINT AS score, false AS ready")
def risk_score(spark, d):
    return assess.readiness(spark.createDataFrame(_RISKS, "level string, code string, object string"))


@query("SELECT 44::BIGINT AS score")
def conclusion_score(spark, d):
    return assess.conclusion_score(spark.createDataFrame(_RISKS, "level string, code string, object string"))


@query("""WITH r AS (SELECT 'p' || (event_id % 4) AS phase, event_type AS status FROM events) SELECT phase, count(*) AS total, count(*) FILTER (status = 'view') AS completed, count(*) FILTER (status = 'error') AS failed,
count(*) FILTER (status = 'signup') AS cancelled, count(*) FILTER (status = 'click') AS running, count(*) FILTER (status = 'purchase') AS pending, round(100.0::DOUBLE * count(*) FILTER (status IN ('view', 'error', 'signup')) / count(*), 1) AS percent FROM r GROUP BY phase""")
def phase_progress(spark, d):
    """Progress of results whose statuses stand for the types of events."""
    e = table(spark, d, "events")
    status = F.lit(None).cast("string")
    for kind, name in (("view", "completed"), ("error", "failed"), ("signup", "cancelled"), ("click", "running"), ("purchase", "pending")):
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return assess.phase_progress(e.select(F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("phase"), status.alias("status")))


# ---------------------------------------------------------------- change log

_C = f"WITH {CHANGES_SQL}"


@query(f"{_C} SELECT operation, count(*) AS n_events FROM changes GROUP BY operation UNION ALL SELECT 'total', count(*) FROM changes")
def event_breakdown(spark, d):
    return changelog.breakdown(changes(spark, d))


@query(f"{_C} SELECT commit_scn, xid, count(*) AS n_events, min(scn) AS first_scn, max(scn) AS last_scn FROM changes GROUP BY commit_scn, xid")
def transactions(spark, d):
    return changelog.transactions(changes(spark, d))


@query(f"{_C} SELECT commit_scn, xid, scn, operation FROM changes WHERE commit_scn BETWEEN 1 AND 700")
def events_in_window(spark, d):
    return changelog.window(changes(spark, d), 500, 700, 200).select("commit_scn", "xid", "scn", "operation")


@query(f"{_C} SELECT greatest(0, least(900, min(scn) - 1))::BIGINT AS safe_scn FROM changes WHERE xid >= 100")
def safe_scn(spark, d):
    return changelog.safe_scn(900, changes(spark, d).where("xid >= 100").select(F.col("scn").alias("start_scn")))


_FILES = [("log1", 0, 300), ("log2", 300, 600), ("log3", 600, 900), ("log4", 900, None)]


@query(f"WITH {_values('f', _FILES, 'name, first_change, next_change')} SELECT DISTINCT name FROM f WHERE coalesce(next_change, 801) > 400 AND first_change <= 800")
def log_files_for_window(spark, d):
    return changelog.covering_files(spark.createDataFrame(_FILES, "name string, first_change long, next_change long"), 400, 800)


@query("SELECT conv_id, min(turn) AS first, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def reassemble_continuations(spark, d):
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m"))
    return changelog.reassemble(c.join(last, "conv_id").withColumn("csf", (F.col("turn") < F.col("m")).cast("int")), "conv_id", "turn", "text")


@query(f"{_C} SELECT key, commit_scn, scn, operation, value::DOUBLE AS value FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_scn DESC, scn DESC) = 1")
def last_op_per_key(spark, d):
    return changelog.last_per_key(changes(spark, d).select("key", "commit_scn", "scn", "operation", F.col("value").cast("double").alias("value")))


@query(f"""{_C}, r AS (SELECT *, 2 * sum((operation = 'insert')::INT) OVER (PARTITION BY xid, key ORDER BY scn) + (operation = 'delete')::INT AS run FROM changes),
f AS (SELECT *, run > 1 AND operation <> 'delete' AS folds, row_number() OVER (PARTITION BY xid, key, run ORDER BY scn) AS i, last_value(value) OVER (PARTITION BY xid, key, run ORDER BY scn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM r)
SELECT commit_scn, xid, key, scn, operation, (CASE WHEN folds THEN lv ELSE value END)::DOUBLE AS value FROM f WHERE NOT folds OR i = 1""")
def coalesced_events(spark, d):
    return changelog.coalesce_inserts(changes(spark, d).drop("event_type")).withColumn("value", F.col("value").cast("double"))


_APPLIED = f"""{_C}, l AS (SELECT key, operation, value FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_scn DESC, scn DESC) = 1),
base AS (SELECT c_custkey AS user_id, CAST(c_acctbal AS DECIMAL(18,2)) AS value FROM customer)
SELECT user_id, value::DOUBLE AS value FROM base ANTI JOIN l ON user_id = key UNION ALL SELECT key, value::DOUBLE FROM l WHERE operation <> 'delete'"""


def _snapshot(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"))


@query(_APPLIED)
def apply_changes(spark, d):
    return changelog.apply_changes(_snapshot(spark, d), changes(spark, d), "user_id", ["value"]).withColumn("value", F.col("value").cast("double"))


@query(_APPLIED)
def replay_idempotent(spark, d):
    once = changelog.apply_changes(_snapshot(spark, d), changes(spark, d), "user_id", ["value"])
    return changelog.apply_changes(once, changes(spark, d), "user_id", ["value"]).withColumn("value", F.col("value").cast("double"))


@query(f"{_C} SELECT commit_scn, xid, scn FROM changes WHERE xid % 3 <> 0")
def ledger_skip(spark, d):
    c = changes(spark, d)
    return changelog.unapplied(c, c.where("xid % 3 = 0")).select("commit_scn", "xid", "scn")


@query(f"{_C} SELECT commit_scn, xid, scn FROM changes WHERE commit_scn BETWEEN 301 AND 600")
def overlap_dedup(spark, d):
    c = changes(spark, d)
    return changelog.unapplied(changelog.window(c, 300, 600, 300), c.where("commit_scn <= 300")).select("commit_scn", "xid", "scn")


# ---------------------------------------------------------------- loads


@query("""SELECT 'range' AS layout, CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 0 WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 1 ELSE 2 END AS bucket, count(*) AS n_rows FROM orders GROUP BY ALL
UNION ALL SELECT 'list', CASE WHEN l_returnflag IN ('A', 'R') THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE -1 END, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'hash', (o_orderkey % 4)::INT, count(*) FROM orders GROUP BY ALL""")
def partition_bucket_counts(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    count = lambda df, name, b: df.groupBy(b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layout"), "bucket", "n_rows")
    by_range = load.range_bucket(F.col("o_orderdate"), [F.expr("timestamp_ntz'1994-01-01'"), F.expr("timestamp_ntz'1997-01-01'")])
    return count(o, "range", by_range).unionAll(count(li, "list", load.list_bucket(F.col("l_returnflag"), [["A", "R"], ["N"]]))).unionAll(count(o, "hash", F.pmod("o_orderkey", F.lit(4))))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name, n_nationkey LIMIT 5 OFFSET 10")
def page(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_name", "n_nationkey").offset(10).limit(5)


@query("SELECT s_suppkey, regexp_extract(lower(s_name), '^[^0-9]*') || lpad(regexp_extract(s_name, '[0-9]+'), 12, '0') AS sort_key FROM supplier")
def natural_sort(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", naming.natural_key(F.col("s_name")).alias("sort_key"))


from ferrule.plans import extended, running  # noqa: E402, F401  register their queries
