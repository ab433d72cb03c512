"""Jobs, connections, copied values and loads that are cancelled."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import adapt
from ferrule.functions.portable import SourceType
from ferrule.operators import jobs, load
from ferrule.sources import jdbc_source as jdbc


def test_states():
    assert jobs.advance("queued", "running") == "running"
    assert jobs.advance("syncing", "catching_up") == "catching_up"
    for state, to in (("completed", "running"), ("queued", "syncing"), ("nothing", "queued")):
        with pytest.raises(ValueError):
            jobs.advance(state, to)


def test_progress_of_repeated_and_empty(spark):
    planned = spark.createDataFrame([("tables", "a"), ("tables", "a"), ("tables", "b"), ("views", "v")], "phase string, name string")
    none = spark.createDataFrame([], "phase string, name string, status string")
    got = {r["phase"]: r for r in jobs.planned_progress(planned, none, planned.where("name = 'b'")).collect()}
    assert (got["tables"]["total"], got["tables"]["running"], got["tables"]["pending"], got["tables"]["percent"]) == (2, 1, 1, 0.0)
    assert jobs.planned_progress(planned.limit(0), none, planned).count() == 0


def test_object_total_without_sequences(spark):
    t = spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    assert [jobs.object_total(t).first()[0], jobs.object_total(t, t).first()[0], jobs.object_total(t.limit(0)).first()[0]] == [2, 4, 0]


def test_errors_of_nulls(spark):
    code, kind = jobs.connection_error(F.col("m"))
    df = spark.createDataFrame([(None,)], "m string")
    assert tuple(df.select(code, kind, jobs.failure_kind(F.col("m"), F.lit(None).cast("string"))).first()) == ("CONNECTION_ERROR", "other", "other")


def test_names():
    assert jobs.clean_names([" a ", "b", "a"]) == ["a", "b"]
    for bad in ("", "  ", "a\x01", "x" * 256):
        with pytest.raises(ValueError):
            jobs.clean_names([bad])


def test_connection():
    c = jdbc.Connection("oracle", "[::1]", 1521, "pdb 1", "scott", "s&p")
    assert jdbc.options(c)["url"] == "jdbc:oracle:thin:@//[::1]:1521/pdb+1"
    assert "s&p" not in jdbc.options(c)["url"] and jdbc.options(c)["password"] == "s&p"
    assert jdbc.quoted(c, 'a"b') == '"SCOTT"."a""b"'
    assert jdbc.sample_query(c, "t", 5) == 'SELECT * FROM "SCOTT"."t" FETCH FIRST 5 ROWS ONLY'
    m = jdbc.Connection("tdsql", "h", 3306, "d", "u", "p")
    assert jdbc.default_schema(m) is None and jdbc.quoted(m, "s.t") == "`s`.`t`"
    assert jdbc.bounds_query(m, "t", "k") == "SELECT MIN(`k`) AS low, MAX(`k`) AS high FROM `t`"
    assert jdbc.default_schema(jdbc.Connection("postgresql", "h", 5432, "d", "u", "p")) == "public"
    for bad in (dict(dialect="other"), dict(host="a\nb"), dict(port=0)):
        with pytest.raises(ValueError):
            jdbc.Connection(**(dict(dialect="mysql", host="h", port=1, database="d", user="u", password="p") | bad))


def test_spans(spark):
    spans = [dt.timedelta(0), dt.timedelta(days=1, seconds=5), dt.timedelta(seconds=-1), dt.timedelta(days=-3, microseconds=250), dt.timedelta(days=40, hours=23, microseconds=1), None]
    df = spark.createDataFrame([(x,) for x in spans], "v interval day to second")
    assert [r[0] for r in df.select(adapt.span_text(F.col("v"))).collect()] == [None if x is None else str(x) for x in spans]


def test_adapted_names_and_types(spark):
    df = spark.createDataFrame([(1, "x", True, None)], "a int, B string, c boolean, d date")
    want = T.StructType([T.StructField("A", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType()), T.StructField("d", T.StringType())])
    out = adapt.adapted(df, want)
    assert out.columns == ["A", "b", "c", "d"] and tuple(out.first()) == (1, "x", "true", None)
    with pytest.raises(ValueError):
        adapt.adapted(df.drop("c"), want)


def test_type_text():
    assert [adapt.type_text(t) for t in (SourceType("NUMBER", 10, 2), SourceType("CHAR", length=3), SourceType("DATE"))] == ["NUMBER(10,2)", "CHAR(3)", "DATE"]


def test_structure_of_partitioned_table_can_be_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, p string")
    path = f"{tmp_path}/t"
    got = load.load_table(load.TablePlan("t", df, path, content="structure_only", partition_by=("p",)))
    assert (got.rows, got.status) == (0, "completed") and got.bytes > 0
    assert spark.read.parquet(path).columns == ["a", "p"] and spark.read.parquet(path).count() == 0
    done = load.load_table(load.TablePlan("t", df, path, policy="append", content="data_only", partition_by=("p",)))
    assert done.rows == 2 and done.bytes > 0 and done.seconds > 0 and load.is_partitioned(spark, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "y")]


def test_cancel(spark, tmp_path):
    asked = threading.Event()
    slow = spark.range(0, 1 << 40, 1, 8).where("hash(id) = 1 and hash(id + 1) = 2")
    plans = [load.TablePlan("slow", slow, f"{tmp_path}/slow"), load.TablePlan("later", spark.range(3).toDF("a"), f"{tmp_path}/later", phase="views")]
    threading.Timer(2, asked.set).start()
    assert [(r.name, r.status) for r in load.run(plans, cancel=asked)] == [("slow", "cancelled"), ("later", "cancelled")]
    again = load.run([load.TablePlan("later", spark.range(3).toDF("a"), f"{tmp_path}/later", phase="views")], cancel=threading.Event())
    assert [(r.status, r.rows, r.notes) for r in again] == [("completed", 3, ["a view, written as a table"])]
