"""Comparison of a source with a target: by key, by position, by digest."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ferrule.functions.canonical import canonical, record


def _kinds(df: DataFrame) -> dict:
    """Types by folded name: names are met as Spark resolves them."""
    return {f.name.lower(): f.dataType for f in df.schema}


def _values(df: DataFrame, columns: list[str]) -> list[Column]:
    kinds = _kinds(df)
    return [canonical(F.col(c), kinds[c.lower()]) for c in columns]


def _native(kind: T.DataType) -> bool:
    """Types whose equality is that of their canonical texts."""
    return isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DecimalType))


def _require(source: DataFrame, target: DataFrame) -> None:
    missing = [c for c in source.columns if c.lower() not in {x.lower() for x in target.columns}]
    if missing:
        raise ValueError(f"the target has no column {', '.join(missing)}")


def _refuse_repeats(df: DataFrame, keys: list[str], side: str) -> None:
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"the {side} has repeated keys; check_key counts them, multiset_diff needs no key")


def key_diff(source: DataFrame, target: DataFrame, keys: list[str], check: bool = False) -> DataFrame:
    """Keys, class (changed, equal, missing_in_target, missing_in_source), the columns that differ, and both sides'
    canonical values of those alone, null for the others.

    One full outer join on null-safe keys; both sides are shuffled by key once and hold nothing but the
    compared columns. Columns of one type on both sides are compared as they are, others by canonical text.
    Names of columns fold. Null keys match null keys. With check, repeated keys on either side are refused, at the cost
    of an aggregation of the keys; without, each of a key's rows meets each of the other side's.
    """
    _require(source, target)
    if check:
        _refuse_repeats(source, keys, "source")
        _refuse_repeats(target, keys, "target")
    folded = {k.lower() for k in keys}
    rest = [c for c in source.columns if c.lower() not in folded]
    left, right = _kinds(source), _kinds(target)
    same = {c: left[c.lower()] == right[c.lower()] and _native(left[c.lower()]) for c in rest}
    put = lambda c, kinds: F.col(c) if same[c] else canonical(F.col(c), kinds[c.lower()])
    s = source.select(*(F.col(k).alias(f"s_{k}") for k in keys), *(put(c, left).alias(f"s_{c}") for c in rest), F.lit(True).alias("in_s"))
    t = target.select(*(F.col(k).alias(f"t_{k}") for k in keys), *(put(c, right).alias(f"t_{c}") for c in rest), F.lit(True).alias("in_t"))
    on = None
    for k in keys:
        equal = F.col(f"s_{k}").eqNullSafe(F.col(f"t_{k}"))
        on = equal if on is None else on & equal
    j = s.join(t, on, "full_outer")
    both = F.col("in_s").isNotNull() & F.col("in_t").isNotNull()
    unlike = {c: both & ~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")) for c in rest}
    differ = F.array_compact(F.array(*(F.when(unlike[c], F.lit(c)) for c in rest))) if rest else F.array().cast("array<string>")
    kind = F.when(F.col("in_t").isNull(), "missing_in_target").when(F.col("in_s").isNull(), "missing_in_source").when(F.size("differ") > 0, "changed").otherwise("equal")
    text = lambda side, c, kinds: canonical(F.col(f"{side}_{c}"), kinds[c.lower()]) if same[c] else F.col(f"{side}_{c}")
    values = [F.when(unlike[c], text(side, c, kinds)).alias(f"{side}_{c}") for side, kinds in (("s", left), ("t", right)) for c in rest]
    return j.withColumn("differ", differ).select(*(F.coalesce(f"s_{k}", f"t_{k}").alias(k) for k in keys), kind.alias("diff_class"), "differ", *values)


def samples(diff: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The first n differing rows by key: the key as a map, the class, and (column, source, target) of what differs."""
    named = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k).cast("string"))))
    pair = [F.when(F.array_contains("differ", c[2:]), F.struct(F.lit(c[2:]).alias("column"), F.col(c).alias("source"), F.col(f"t_{c[2:]}").alias("target"))) for c in diff.columns if c.startswith("s_")]
    cells = F.array_compact(F.array(*pair)) if pair else F.array()
    return diff.where("diff_class <> 'equal'").orderBy(*keys).limit(n).select(*keys, named.alias("primary_key"), "diff_class", cells.alias("columns"))


def diff_columns(diff: DataFrame) -> DataFrame:
    """(column_name, differing_rows) over changed rows."""
    return diff.where("diff_class = 'changed'").select(F.explode("differ").alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("differing_rows"))


def ordinals(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with row_index from 0 in a total order, without one task holding all: a range sort, a count of
    each range, and the sum of the ranges before it (a row a partition is what is broadcast).

    Rows with equal order values are ordered by their other columns, so that only equal rows tie. The sorted rows are
    held on two executors' disks: a lost executor does not deal them anew. ``spark.catalog.clearCache()`` lets them go.
    """
    rest = [F.to_json(F.struct(c)) for c in df.columns if c.lower() not in {o.lower() for o in order}]
    ranged = df.orderBy(*order, *rest).withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY_2)
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    out = ranged.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return out.withColumn("row_index", F.col("_ahead") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_ahead")


def positional_diff(source: DataFrame, target: DataFrame, order: list[str]) -> DataFrame:
    """(row_index, differ): rows compared by their place; a missing side differs in every column."""
    _require(source, target)
    cols = source.columns
    s = ordinals(source, order).select("row_index", *(v.alias(f"s_{c}") for c, v in zip(cols, _values(source, cols), strict=True)))
    t = ordinals(target.select(*cols), order).select("row_index", *(v.alias(f"t_{c}") for c, v in zip(cols, _values(target, cols), strict=True)))
    j = s.join(t, "row_index", "full_outer")
    return j.select("row_index", F.array_compact(F.array(*(F.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")), F.lit(c)) for c in cols))).alias("differ")).where("size(differ) > 0")


def fingerprint(df: DataFrame, text: Column | None = None) -> DataFrame:
    """(row_count, hash_sum): a digest that needs no order and is summed where the rows lie."""
    h = F.conv(F.substring(F.sha2(record(df) if text is None else text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    hashes = df.select(F.when(F.rand() >= 0, h).alias("h"))  # rand() keeps Spark from computing h in the sum, twice a row
    return hashes.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("hash_sum"))


def ordered_digest(df: DataFrame, keys: list[str], text: Column | None = None, piece_bytes: int = 1 << 16) -> DataFrame:
    """(digest): SHA-256 over length-prefixed records in key order, of any number of rows; null texts are left out.

    Records are sorted by ranges and joined into pieces where they lie; one task, as SHA-256 goes from start to end, takes
    the pieces in order and holds few of them at a time.
    """
    rec = record(df) if text is None else text
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    rows = df.select(*named, F.concat(F.lpad(F.octet_length(rec).cast("string"), 8, "0"), rec).alias("rec")).where("rec IS NOT NULL")
    rows = rows.orderBy(*(f"_{i}" for i in range(len(keys))), "rec").select(F.col("rec").cast("binary").alias("rec"))

    def join(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for piece in _pieces(b.column(0), piece_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([b"|".join(piece.to_pylist())], pa.binary())], ["part", "n", "piece"])
                n += 1

    def digest(batches):
        h, between = hashlib.sha256(), b""
        for b in batches:
            for piece in b.column(0):
                h.update(between)
                h.update(piece.as_buffer())
                between = b"|"
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()], pa.string())], ["digest"])

    pieces = rows.mapInArrow(join, "part int, n long, piece binary").repartition(1).sortWithinPartitions("part", "n")
    found = pieces.select("piece").mapInArrow(digest, "digest string")
    return found.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"))  # no partition, no row


def _pieces(texts: pa.Array, size: int):
    """Slices of texts in order, of size bytes each at most; a longer text is one by itself."""
    start = taken = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and taken + n > size:
            yield texts.slice(start, i - start)
            start, taken = i, 0
        taken += n
    if len(texts) > start:
        yield texts.slice(start)


def multiset_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(record, source_rows, target_rows) where the counts of equal rows differ; needs no key."""
    both = source.select(record(source).alias("record"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(target.select(record(target).alias("record"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    return both.groupBy("record").agg(F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows")).where("source_rows <> target_rows")


#: Types of columns that hold large objects; they take no part in a key of all columns.
LARGE = ("CLOB", "NCLOB", "BLOB", "LONG", "LONG RAW", "BFILE", "XMLTYPE", "TEXT", "LONGTEXT", "BYTEA", "JSON")


def choose_key(columns: list[tuple], primary: list[str], uniques: list[list[str]], override: list[str] | None = None, allow_all: bool = False) -> tuple[str, list[str]]:
    """(kind, columns) of a replication key: override, primary key, shortest unique key without nullable columns (ties by
    name), all columns but large objects, or none. columns: (name, nullable) or (name, nullable, type)."""
    nullable = {c[0].lower(): c[1] for c in columns}
    if override:
        if any(c.lower() not in nullable for c in override):
            raise ValueError("the key override names an unknown column")
        return "override", override
    if primary:
        return "primary", primary
    fit = [u for u in uniques if u and not any(nullable.get(c.lower(), True) for c in u)]
    if fit:
        return "unique", min(fit, key=lambda u: (len(u), [c.upper() for c in u]))
    return ("all_columns", [c[0] for c in columns if len(c) < 3 or c[2].upper() not in LARGE]) if allow_all else ("none", [])


def comparison_key(columns: list[tuple], primary: list[str], uniques: list[list[str]], business: list[str] | None = None, is_view: bool = False) -> tuple[str, list[str]]:
    """(kind, columns) of a comparison key: primary key, business key whose columns all exist and hold no null, the
    first unique key without nullable columns, or none; views have none."""
    nullable = {c[0].lower(): c[1] for c in columns}
    if is_view:
        return "none", []
    if primary:
        return "primary", primary
    if business and all(nullable.get(c.lower(), True) is False for c in business):
        return "business", business
    fit = [u for u in uniques if u and not any(nullable.get(c.lower(), True) for c in u)]
    return ("unique", fit[0]) if fit else ("none", [])


def check_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """(null_rows, duplicate_groups) of a proposed key, in one aggregation of the key columns."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return n.agg(F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("long").alias("null_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))
