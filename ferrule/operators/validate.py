"""Validation of many tables: a record a table, an overall verdict, a history."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import naming
from ferrule.operators import compare

#: Rows beyond which the ordered hash is not taken, sampled differences, tables at once.
MAX_ROWS, SAMPLES, THREADS = 100_000, 20, 4

DIFFERENCE = "row_index long, primary_key map<string,string>, columns array<struct<column:string,source:string,target:string>>"
RECORD = f"""requested string, source_name string, target_name string, expected_name string, name_matches boolean, key_kind string,
key_columns array<string>, source_rows long, target_rows long, counts_match boolean, hash_mode string, source_hash string, target_hash string,
hashes_match boolean, difference_rows long, column_differences map<string,long>, samples array<struct<primary_key:map<string,string>,diff_class:string,columns:array<struct<column:string,source:string,target:string>>>>,
passed boolean, error string, seconds double"""


@dataclass(frozen=True)
class Pair:
    """Two sides of a table and what is known of the source's keys."""

    name: str
    source: DataFrame
    target: DataFrame | None
    target_name: str | None = None
    primary: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    business: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    is_view: bool = False
    expected: str | None = field(default=None)


def hash_mode(kind: str, source_rows: int, target_rows: int, most: int = MAX_ROWS, beyond: str = "count_only") -> str:
    """full where a key exists and both sides have ``most`` rows at most, else ``beyond``: count_only, or fingerprint,
    which needs neither key nor order and no limit."""
    if beyond not in ("count_only", "fingerprint"):
        raise ValueError(f"unknown mode {beyond!r}")
    return "full" if kind != "none" and max(source_rows, target_rows) <= most else beyond


def verdict(counts_match: bool, name_matches: bool, mode: str, hashes_match: bool | None) -> bool:
    """Counts equal, the name as expected and, where hashes were taken, hashes equal."""
    return counts_match and name_matches and (mode == "count_only" or bool(hashes_match))


def validate_table(pair: Pair, policy: str = "preserve", most: int = MAX_ROWS, n_samples: int = SAMPLES, beyond: str = "count_only") -> dict:
    """The record of one table. Differences are taken by key, one join; the hash is of the canonical rows in key order."""
    began = time.perf_counter()
    expected = pair.expected or {"lower": str.lower, "upper": str.upper}.get(policy, str)(pair.name)
    out = {"requested": pair.name, "source_name": pair.name, "target_name": pair.target_name, "expected_name": expected, "key_columns": [], "column_differences": {}, "samples": [], "passed": False}
    try:
        if pair.target is None:
            raise LookupError(f"{pair.name} has no target")
        name = out["target_name"] = pair.target_name or expected
        out["name_matches"] = name == expected
        by = {c.lower(): c for c in pair.target.columns}
        lacking = [c for c in pair.source.columns if c.lower() not in by]
        if lacking:
            raise ValueError(f"the target has no column {', '.join(lacking)}")
        target = pair.target.select(*(F.col(by[c.lower()]).alias(c) for c in pair.source.columns))
        columns = [(c, c not in pair.not_null and c not in pair.primary) for c in pair.source.columns]
        kind, keys = compare.comparison_key(columns, list(pair.primary), [list(u) for u in pair.uniques], list(pair.business) or None, pair.is_view)
        rows = {s: df.count() for s, df in (("source", pair.source), ("target", target))}
        out |= {"key_kind": kind, "key_columns": keys, "source_rows": rows["source"], "target_rows": rows["target"], "counts_match": rows["source"] == rows["target"]}
        mode = out["hash_mode"] = hash_mode(kind, rows["source"], rows["target"], most, beyond)
        if mode != "count_only":
            digest = (lambda df: compare.ordered_digest(df, keys).first()[0]) if mode == "full" else (lambda df: "-".join(map(str, compare.fingerprint(df).first())))
            out["source_hash"], out["target_hash"] = digest(pair.source), digest(target)
            out["hashes_match"] = out["source_hash"] == out["target_hash"]
            if kind != "none" and not out["hashes_match"]:
                diff = compare.key_diff(pair.source, target, keys, check=True).where("diff_class <> 'equal'").persist()  # one join for all three
                try:
                    out["difference_rows"] = diff.count()
                    out["column_differences"] = {r["column_name"]: r["differing_rows"] for r in compare.diff_columns(diff).collect()}  # a row a column
                    out["samples"] = [r.asDict(True) for r in compare.samples(diff, keys, n_samples).drop(*keys).collect()]
                finally:
                    diff.unpersist()
            elif out["hashes_match"]:
                out["difference_rows"] = 0
        out["passed"] = verdict(out["counts_match"], out["name_matches"], mode, out.get("hashes_match"))
    except Exception as e:  # a table's failure is its record
        out["error"] = str(e).splitlines()[0][:2000]
    return out | {"seconds": round(time.perf_counter() - began, 3)}


def validate(spark: SparkSession, pairs: list[Pair], content: str = "structure_and_data", threads: int = THREADS, **options) -> DataFrame:
    """Records of all tables, several at once, in the order asked for, a name once."""
    if content == "structure_only":
        raise ValueError("structure_only has no rows to validate")
    once = list({p.name: p for p in reversed(pairs)}.values())[::-1]
    with ThreadPoolExecutor(max(1, min(threads, len(once)))) as pool:
        found = list(pool.map(lambda p: validate_table(p, **options), once))
    kind = T.StructType.fromDDL(RECORD)
    return spark.createDataFrame([tuple(r.get(f) for f in kind.names) for r in found], kind)


def all_passed(records: DataFrame) -> DataFrame:
    """(tables, failed, passed): one row; passed if every table is."""
    return records.agg(F.count(F.lit(1)).alias("tables"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.every("passed"), F.lit(True)).alias("passed"))


def resolve_names(requested: DataFrame, available: DataFrame) -> DataFrame:
    """(requested, name, how) of names: exact, else the only one that is equal but for case, else null; how is exact, folded,
    ambiguous or missing. Both frames have one column, name."""
    r = requested.select(F.col("name").alias("requested")).distinct()
    a = available.select(F.col("name").alias("found")).distinct()
    folded = a.groupBy(F.lower("found").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("only"))
    j = r.join(a, F.col("requested") == F.col("found"), "left").join(folded, F.lower("requested") == F.col("low"), "left")
    how = F.when(F.col("found").isNotNull(), "exact").when(F.col("n") == 1, "folded").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return j.select("requested", F.coalesce("found", F.when(F.col("n") == 1, F.col("only"))).alias("name"), how.alias("how"))


class History:
    """Validation runs as Parquet below ``path``: one row a table and run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, run_id: str, job: str, records: DataFrame) -> None:
        stamped = records.select(F.lit(run_id).alias("run_id"), F.lit(job).alias("job"), F.current_timestamp().alias("at"), "*")
        stamped.write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        held = self.spark.read.parquet(self.path)
        return held.groupBy("run_id", "job").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("tables"), F.every("passed").alias("passed"))


def page(rows: DataFrame, order: list, number: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows of a page, page, pages): the page asked for is moved into 1 to pages."""
    if size < 1:
        raise ValueError("a page holds one row at least")
    pages = max(1, -(-rows.count() // size))
    number = min(max(1, number), pages)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), number, pages


def with_status(runs: DataFrame, status: str = "all") -> DataFrame:
    """Runs that passed, that failed, or all."""
    if status not in ("all", "passed", "failed"):
        raise ValueError(f"unknown status {status!r}")
    return runs if status == "all" else runs.where(F.col("passed") == F.lit(status == "passed"))


def expected_names(names: DataFrame, policy: str) -> DataFrame:
    """(name, expected) under a resolved name policy."""
    return names.select("name", naming.apply_policy(F.col("name"), policy).alias("expected"))
