import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import canonical, naming
from ferrule.functions.portable import SourceType, portable_type, target_schema
from ferrule.operators import changelog, compare, load, validate
from ferrule.sources.changelog_source import next_offset
from ferrule.streaming.replicate import Replica


@pytest.mark.parametrize("sql, want", [
    ("CAST(NULL AS INT)", '["null"]'),
    ("true", '["bool",true]'),
    ("CAST(2.500 AS DECIMAL(10,3))", '["number","2.5"]'),
    ("CAST(100 AS DECIMAL(10,2))", '["number","100"]'),
    ("CAST(1e10 AS DOUBLE)", '["number","10000000000"]'),
    ("CAST(-0.0 AS DOUBLE)", '["number","0"]'),
    ("timestamp_ntz'2024-01-02 03:04:05'", '["datetime","2024-01-02 03:04:05"]'),
    ("timestamp_ntz'2024-01-02 03:04:05.5'", '["datetime","2024-01-02 03:04:05.500000"]'),
    ("date'2024-01-02'", '["datetime","2024-01-02"]'),
    ("'a \"b\" '", '["text","a \\"b\\" "]'),
    ("INTERVAL '26-8' YEAR TO MONTH", '["text","+0026-08"]'),
])
def test_canonical(spark, sql, want):
    df = spark.sql(f"SELECT {sql} AS v")
    assert df.select(canonical.canonical(F.col("v"), df.schema["v"].dataType)).first()[0] == want


def test_fixed_char_ignores_trailing_blanks(spark):
    df = spark.sql("SELECT ' a  ' AS v")
    assert df.select(canonical.canonical(F.col("v"), df.schema["v"].dataType, True)).first()[0] == '["text"," a"]'


@pytest.mark.parametrize("kind, target, want", [
    (SourceType("NUMBER", 2, 0), "mysql", "TINYINT"),
    (SourceType("NUMBER", 9, 0), "mysql", "INT"),
    (SourceType("NUMBER", 18, 0), "mysql", "BIGINT"),
    (SourceType("NUMBER", 38, 0), "mysql", "NUMERIC(38,0)"),
    (SourceType("NUMBER", 30, 10), "mysql", "NUMERIC(30,10)"),
    (SourceType("NUMBER"), "mysql", "NUMERIC(65,0)"),
    (SourceType("VARCHAR2", length=80), "mysql", "VARCHAR(80)"),
    (SourceType("TIMESTAMP", timezone=True), "mysql", "VARCHAR(48)"),
    (SourceType("UUID"), "postgresql", "UUID"),
    (SourceType("WHATEVER"), "mysql", "TEXT"),
])
def test_types(kind, target, want):
    assert portable_type(kind, target).target == want


def test_surrogate_key_leads():
    s = target_schema([("a", SourceType("INT"), True)], "mysql", surrogate="id")
    assert s.fieldNames() == ["id", "a"]


def test_names():
    assert naming.resolve_policy("auto", 1) == "lower" and naming.resolve_policy("auto", 0) == "preserve"
    with pytest.raises(ValueError):
        naming.resolve_policy("upper", 1)
    assert naming.parse_key_overrides("t = a, b\n") == {"t": ["a", "b"]}
    with pytest.raises(ValueError):
        naming.parse_key_overrides("t=a\nT=b")


def test_key_choice():
    cols = [("a", False), ("b", True), ("c", False)]
    assert compare.choose_key(cols, [], [["a", "c"], ["b"], ["c"]]) == ("unique", ["c"])
    assert compare.choose_key(cols, [], []) == ("none", [])
    assert compare.choose_key(cols, ["a"], [], ["c"]) == ("override", ["c"])


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    assert {r["diff_class"] for r in compare.key_diff(a, a, ["k"]).collect()} == {"equal"}


def test_key_changes_split(spark):
    e = spark.createDataFrame([(1, 1, 5, 4, 1, "update")], "commit_scn long, xid long, key int, old_key int, scn long, operation string")
    got = sorted((r["key"], r["operation"], r["sub"]) for r in changelog.split_key_changes(e).collect())
    assert got == [(4, "delete", 0), (5, "update", 1)]


def test_offsets_lag_one_poll():
    assert next_offset({"scn": 10, "seen": 40}, 90, 60) == {"scn": 40, "seen": 90}
    assert next_offset({"scn": 10, "seen": 80}, 90, 60)["scn"] == 59
    assert next_offset({"scn": 70, "seen": 80}, 90, 60)["scn"] == 70


def test_partition_clause():
    assert load.partition_clause("HASH", ["a"], 4, ["a"]) == "PARTITION BY HASH (`a`) PARTITIONS 4"
    with pytest.raises(ValueError):
        load.partition_clause("HASH", ["a"], 4, ["b"])


def test_load_policies(spark, tmp_path):
    df, path = spark.range(7), str(tmp_path / "t")
    assert load.run([load.TablePlan("t", df, path)])[0].rows == 7
    again = load.run([load.TablePlan("t", df, path), load.TablePlan("v", df, str(tmp_path / "v"), phase="views")])
    assert [r.status for r in again] == ["failed", "cancelled"]
    load.run([load.TablePlan("t", df, path, policy="append")])
    assert spark.read.parquet(path).count() == 14
    with pytest.raises(ValueError):
        load.TablePlan("t", df, path, content="data_only")


def test_stream_is_idempotent(spark, tmp_path):
    kind = "commit_scn long, xid long, key int, scn long, operation string, v string"
    spark.createDataFrame([(1, 1, 1, 1, "insert", "a"), (2, 2, 2, 2, "insert", "b")], kind).write.parquet(str(tmp_path / "log"))
    spark.createDataFrame([(3, 3, 1, 3, "delete", None), (4, 4, 2, 4, "update", "c"), (2, 2, 2, 2, "insert", "b")], kind).write.mode("append").parquet(str(tmp_path / "log"))
    replica = Replica(spark, str(tmp_path / "replica"), "id", ["v"], "id int, v string")
    for turn in ("one", "two"):
        replica.follow(spark.readStream.schema(kind).parquet(str(tmp_path / "log")), str(tmp_path / turn)).awaitTermination()
        assert [tuple(r) for r in replica.snapshot().collect()] == [(2, "c")]
    assert replica.version() == 0


@pytest.mark.parametrize("value", [1e-19, 2e-19, 1.2345678901234567e-5, 1.2345678901234571e-5, 1e25, 1.7976931348623157e308, 2.5e-300, 0.1, -123.456, 100.0, 1e7, 12345678.9, -0.0, 1 / 7])
def test_canonical_doubles_over_the_whole_range(spark, value):
    from decimal import Decimal

    want = format(Decimal(repr(value)).normalize(), "f") if value else "0"
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(canonical.plain_number(F.col("v"), df.schema["v"].dataType)).first()[0] == want


def test_columns_fold_and_repeated_keys_are_refused(spark):
    a, b = spark.createDataFrame([(1, 1e-19)], "k int, v double"), spark.createDataFrame([(1, 2e-19)], "K int, V double")
    diff = compare.key_diff(a, b, ["k"])
    assert diff.first()["diff_class"] == "changed"
    cell = compare.samples(diff, ["k"]).first()["columns"][0]
    assert (cell["column"], cell["source"]) == ("v", '["number","0.0000000000000000001"]')
    with pytest.raises(ValueError):
        compare.key_diff(a.union(a), b, ["k"], check=True)


def test_keys_for_comparison():
    cols = [("a", False), ("b", True), ("c", False, "CLOB")]
    assert compare.comparison_key(cols, ["a"], [], ["c"]) == ("primary", ["a"])
    assert compare.comparison_key(cols, [], [["b"], ["c"], ["a"]], ["b"]) == ("unique", ["c"])
    assert compare.comparison_key(cols, ["a"], [], is_view=True) == ("none", [])
    assert compare.choose_key(cols, [], [], allow_all=True) == ("all_columns", ["a", "b"])


E_KIND = "commit_scn long, xid long, key long, old_key long, scn long, operation string, v string"


def test_chains_of_key_changes_fold(spark):
    rows = [(9, 1, 1, None, 1, "insert", "a"), (9, 1, 2, 1, 2, "update", "b"), (9, 1, 2, None, 3, "update", "c"), (9, 1, 5, None, 4, "update", "x"), (9, 1, 2, None, 5, "delete", None), (9, 1, 2, None, 6, "insert", "d")]
    got = sorted((r["scn"], r["operation"], r["key"], r["v"]) for r in changelog.coalesce_chains(spark.createDataFrame(rows, E_KIND), E_KIND).collect())
    assert got == [(1, "insert", 2, "c"), (4, "update", 5, "x"), (5, "delete", 2, None), (6, "insert", 2, "d")]


def test_late_events_and_guards(spark):
    state = changelog.versioned(spark.createDataFrame([(1, "old")], "id long, v string"), "id", ["v"])
    put = lambda *rows: spark.createDataFrame(rows, E_KIND)
    state = changelog.merge_events(state, put((10, 2, 1, None, 10, "update", "new"), (10, 2, 3, None, 11, "delete", None)), "id", ["v"])
    state = changelog.merge_events(state, put((5, 1, 1, None, 5, "update", "late"), (5, 1, 3, None, 6, "insert", "late"), (5, 1, 4, None, 7, "lob", "part")), "id", ["v"])
    assert [tuple(r) for r in changelog.visible(state, "id", ["v"]).collect()] == [(1, "new")]
    with pytest.raises(Exception, match="unsupported operation ddl"):
        changelog.merge_events(state, put((20, 3, 1, None, 20, "ddl", None)), "id", ["v"]).collect()
    with pytest.raises(Exception, match="more than once"):
        changelog.merge_events(state.union(state), put((20, 3, 1, None, 20, "delete", None)), "id", ["v"]).collect()
    assert changelog.start_scn(50, None) == 50 and changelog.start_scn(50, 20) == 19 and changelog.start_scn(50, 0) == 1
    files = spark.createDataFrame([("a", 10, 20)], "name string, first_change long, next_change long")
    changelog.check_start(files, 15, 30)
    for start in (5, 40):
        with pytest.raises(ValueError):
            changelog.check_start(files, start, 30)
    assert changelog.lag(90, 70, 80) == {"lag": 20, "phase": "catching_up"}


def test_replica_takes_late_batches_and_retires_versions(spark, tmp_path):
    put = lambda *rows: spark.createDataFrame(rows, E_KIND)
    replica = Replica(spark, str(tmp_path / "r"), "id", ["v"], "id long, v string", buckets=4, keep=2)
    replica.apply(put((10, 2, 1, None, 10, "insert", "new"), (10, 2, 7, None, 11, "insert", "x")))
    replica.apply(put((5, 1, 1, None, 5, "insert", "late"), (5, 1, 8, 7, 6, "update", "early")))
    replica.apply(put((12, 3, 9, 7, 12, "update", "moved")))
    replica.apply(put((12, 3, 9, 7, 12, "update", "again")))
    assert sorted(map(tuple, replica.snapshot().collect())) == [(1, "new"), (8, "early"), (9, "moved")]
    assert (replica.version(), replica.checkpoint()) == (2, 12)


def test_statements():
    from datetime import datetime

    from ferrule.functions import redo

    sql = """update "A"."T" set "CODE" = 'NEW', "N" = UNISTR('\\4F60\\D83D\\DE00') where "CODE" = 'it''s and' and "GONE" IS NULL and "B" = HEXTORAW('0aff')"""
    assert redo.statement(sql) == {"old": {"CODE": "it's and", "GONE": None, "B": "0AFF"}, "new": {"CODE": "NEW", "N": "你😀"}}
    assert redo.old_key(sql, ["code", "gone"]) == {"code": "it's and", "gone": None} and redo.new_key(sql, ["code"]) == {"code": "NEW"}
    assert redo.old_key(sql, ["ID"]) is None and redo.statement(None) == {"old": {}, "new": {}}
    sql = """insert into "A"."T"("ID","D","X") values (12.50, TO_DATE('02-MAR-26', 'DD-MON-RR'), f('a,b', g(1,2)));"""
    assert redo.statement(sql)["new"] == {"ID": "12.5", "D": "02-MAR-26", "X": "f('a,b', g(1,2))"}
    assert redo.coerced("02-MAR-26") == datetime(2026, 3, 2) and redo.coerced("26-AUG-50 09.01.01 PM") == datetime(1950, 8, 26, 21, 1, 1)
    assert redo.coerced("2024-01-02T03:04:05") == datetime(2024, 1, 2, 3, 4, 5) and redo.coerced("free text") == "free text"


def test_layouts():
    from ferrule.operators import partitioning as p

    both = p.Layout("RANGE", ("ID",), (("P1", "100"), ("P2", "MAXVALUE")), "HASH", ("REGION",), 4)
    text, warnings = p.clause(both, {"ID": "BIGINT", "REGION": "VARCHAR(10)"})
    assert text.startswith("PARTITION BY RANGE (`ID`) SUBPARTITION BY KEY (`REGION`) SUBPARTITIONS 4 (PARTITION `P1` VALUES LESS THAN (100)") and warnings
    grows = p.Layout("RANGE", ("D",), (("P1", "TO_DATE(' 2024-01-01 00:00:00', 'SYYYY-MM-DD HH24:MI:SS')"),), interval=True)
    text, warnings = p.clause(grows, {"D": "DATETIME(6)"})
    assert text == "PARTITION BY RANGE COLUMNS (`D`) (PARTITION `P1` VALUES LESS THAN ('2024-01-01'), PARTITION `p_max` VALUES LESS THAN (MAXVALUE))" and warnings
    assert p.clause(p.Layout("HASH", ("ID",), count=4), {"ID": "NUMERIC(38,0)"})[1][0].endswith("can be a partition key")
    assert p.clause(p.Layout("LIST", ("R",), (("P1", "'a', 'b,c', NULL"),)), {"R": "VARCHAR(9)"})[0] == "PARTITION BY LIST COLUMNS (`R`) (PARTITION `P1` VALUES IN ('a', 'b,c', NULL))"
    ddl, warnings = p.create_table("t", [("ID", "NUMERIC(12,0)", False), ("R", "INT", True)], ["R"], p.Layout("HASH", ("ID",), count=4))
    assert "PARTITION" not in ddl and "`ID` BIGINT NOT NULL" in ddl and warnings == ["primary key lacks partition column ID"]
    with pytest.raises(ValueError):
        p.create_table("t", [("R", "VARCHAR(9)", True)], [], p.Layout("LIST", ("R",), (("P1", "DEFAULT"),)))
    assert p.bound("sysdate") is None and p.label(p.Layout("RANGE", ("a",), sub_kind="NONE")) == "RANGE"
    assert "START WITH 9223372036854775807" in p.sequence_ddl("s", 10**30) and "NOCYCLE NOCACHE" in p.sequence_ddl("s", 1)


def test_fk_tree_with_cycles(spark):
    from ferrule.operators import catalog

    tree = lambda edges: sorted(map(tuple, catalog.fk_tree(spark.createDataFrame(edges, "parent string, child string")).collect()))
    assert tree([("a", "b"), ("b", "c"), ("b", "b")]) == [("a", "a", 0, 1), ("a", "b", 1, 1), ("a", "c", 2, 0)]
    assert tree([("x", "y"), ("y", "x")]) == [("x", "x", 0, 1), ("x", "y", 1, 1)]


def test_report_and_history(spark, tmp_path):
    from ferrule.operators import report, validate

    page = report.html_report("T <1>", {"risks": spark.createDataFrame([("<b>", None)], "a string, b string"), "summary": spark.range(3)})
    assert "T &lt;1&gt;" in page and "&lt;b&gt;" in page and page.index("summary") < page.index("risks")
    notes = []
    assert report.defended({"a": lambda: 1, "b": lambda: 1 / 0}, notes) == {"a": 1, "b": None} and notes[0][0] == "b"
    one = spark.range(1).select(F.lit("t").alias("requested"), F.lit(True).alias("passed"))
    history = validate.History(spark, str(tmp_path / "h"))
    history.add("r1", "j", one)
    history.add("r2", "j", one.union(one.withColumn("passed", F.lit(False))))
    assert {(r["run_id"], r["tables"], r["passed"]) for r in history.runs().collect()} == {("r1", 1, True), ("r2", 2, False)}
    with pytest.raises(ValueError):
        validate.validate(spark, [], content="structure_only")


def test_null_checks(spark):
    from ferrule.operators import quality

    df = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, "x", 2)], "id int, v string, u int")
    assert [r["column_name"] for r in quality.suspicious_nulls(df, ["id", "v"], ["id"]).collect()] == ["v"]
    assert quality.first_duplicates(df, ["id"], [["u"]]) == (["u"], 1) and quality.first_duplicates(df, ["id"], []) == ([], 0)


def test_ordered_digest_of_many_rows_in_pieces(spark):
    many = spark.range(100_003).select((100_002 - F.col("id")).alias("k"), F.concat(F.lit("é|"), (F.col("id") % 1000).cast("string")).alias("t"))
    texts = [f"é|{(100_002 - k) % 1000}".encode() for k in range(100_003)]
    want = lambda ts: hashlib.sha256(b"|".join(b"%08d" % len(t) + t for t in ts)).hexdigest()
    for size in (1 << 16, 100):
        assert [r["digest"] for r in compare.ordered_digest(many, ["k"], F.col("t"), piece_bytes=size).collect()] == [want(texts)]
    ties = spark.createDataFrame([(1, "b"), (None, "z"), (1, None), (1, "a"), (0, ""), (1, "a")], "k int, t string")
    assert compare.ordered_digest(ties, ["k"], F.col("t"), piece_bytes=1).first()["digest"] == want([b"z", b"", b"a", b"a", b"b"])
    assert [r["digest"] for r in compare.ordered_digest(ties.where("k > 1"), ["k"], F.col("t")).collect()] == [want([])]


def test_fingerprint_hashes_each_row_once(spark):
    df = spark.range(10).select("id", (F.col("id") / 4).alias("v"))
    plan = compare.fingerprint(df)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan and not any("sha2" in line for line in plan.splitlines() if "Aggregate" in line)
    hashes = [int(hashlib.sha256(f'[["number","{i}"],["number","{(str(i / 4)).removesuffix(".0")}"]]'.encode()).hexdigest()[:15], 16) for i in range(10)]
    assert tuple(compare.fingerprint(df).first()) == (10, str(sum(hashes)))


def test_canonical_of_many_values(spark):
    rnd = random.Random(7)
    numbers = [rnd.choice([1, -1]) * rnd.randrange(10 ** rnd.randrange(1, 18)) * 10.0 ** rnd.randrange(-25, 20) for _ in range(2000)]
    numbers += [0.0, -0.0, 1e-3, 9.999e-4, 1e7, 9999999.5, 10000000.5, 1e15, 999999999999999.0, 2.0**53, 5e-324, 1.7976931348623157e308]
    plain = lambda t: "0" if Decimal(t) == 0 else f"{Decimal(t):f}".rstrip("0").rstrip(".") if "." in f"{Decimal(t):f}" else f"{Decimal(t):f}"
    got = spark.createDataFrame([(x,) for x in numbers], "v double").select(F.col("v").cast("string").alias("v"), canonical.canonical(F.col("v"), T.DoubleType()).alias("c")).collect()
    for r in got:
        assert r["c"] == f'["number","{plain(r["v"])}"]', r["v"]
    texts = ["", "a b", 'a"b', "a\\b", "a\n", "\n", "é", "𝄞", "\x7f", "/", "<&'>"]
    rows = spark.createDataFrame([(x,) for x in texts], "v string").select("v", canonical.canonical(F.col("v"), T.StringType()).alias("c"), F.to_json(F.array(F.lit("text"), "v")).alias("w")).collect()
    assert all(r["c"] == r["w"] for r in rows)
    odd = spark.sql("SELECT CAST(9.9999990E9 AS FLOAT) AS f, CAST('NaN' AS DOUBLE) AS n, CAST('-Infinity' AS DOUBLE) AS i, CAST(1.20 AS DECIMAL(38,20)) AS d")
    assert list(odd.select(*(canonical.canonical(F.col(f.name), f.dataType) for f in odd.schema)).first()) == ['["number","9999999000"]', '["number","NaN"]', '["number","-Infinity"]', '["number","1.2"]']


def test_validation_joins_once_for_all_differences(spark, monkeypatch):
    a = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    b = a.where("k > 4").withColumn("v", F.when(F.col("k") % 10 == 7, 9).otherwise(F.col("v")))
    held = []
    monkeypatch.setattr(compare, "diff_columns", lambda d, f=compare.diff_columns: held.append(d.storageLevel.useMemory) or f(d))
    got = validate.validate_table(validate.Pair("t", a, b, primary=("k",)), most=10, beyond="fingerprint")
    assert (got["hash_mode"], got["difference_rows"], got["column_differences"], len(got["samples"]), got["passed"]) == ("fingerprint", 10, {"v": 5}, 10, False)
    assert held == [True]
