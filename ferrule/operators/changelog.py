"""Change logs: windows, transactions, coalescing, and application to a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def reassemble(fragments: DataFrame, log: str, order: str, text: str, more: str = "csf", header: tuple[str, ...] = ()) -> DataFrame:
    """(log, first, text, header): fragments joined to the next as long as ``more`` is 1; the first gives the header."""
    w = Window.partitionBy(log).orderBy(order)
    starts = F.when(F.coalesce(F.lag(more).over(w), F.lit(0)) == 0, 1).otherwise(0)
    grouped = fragments.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(w))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    return grouped.groupBy(log, "_g").agg(F.min(order).alias("first"), parts.alias("text"), *(F.min_by(c, order).alias(c) for c in header)).drop("_g")


def transactions(events: DataFrame) -> DataFrame:
    """(commit_scn, xid, n_events, first_scn, last_scn) in the order in which they apply."""
    return events.groupBy("commit_scn", "xid").agg(F.count(F.lit(1)).alias("n_events"), F.min("scn").alias("first_scn"), F.max("scn").alias("last_scn"))


def window(events: DataFrame, checkpoint: int, safe: int, span: int = 100_000, start: int = 0) -> DataFrame:
    """Events committed in the next window, read again from ``span`` before the checkpoint for late commits."""
    low, high = max(start + 1, checkpoint - max(span, 100_000) + 1), min(safe, checkpoint + span)
    return events.where(F.col("commit_scn").between(low, high))


def safe_scn(current: int, open_starts: DataFrame, scn: str = "start_scn") -> DataFrame:
    """(safe_scn): below it no transaction is open."""
    return open_starts.agg(F.greatest(F.lit(0), F.least(F.lit(current), F.coalesce(F.min(scn) - 1, F.lit(current)))).cast("long").alias("safe_scn"))


def covering_files(files: DataFrame, start: int, end: int) -> DataFrame:
    """Files (name, first_change, next_change; null while open) that overlap [start, end]."""
    return files.where((F.coalesce("next_change", F.lit(end + 1)) > start) & (F.col("first_change") <= end)).select("name").distinct()


def unapplied(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose transaction the ledger (commit_scn, xid) does not hold."""
    return events.join(ledger.select("commit_scn", "xid").distinct(), ["commit_scn", "xid"], "left_anti")


#: Operation codes of a log.
OPERATIONS = {1: "insert", 2: "delete", 3: "update", 5: "ddl", 10: "lob", 11: "lob", 29: "lob"}


def decoded(code: Column) -> Column:
    """The operation of a code; any other is unsupported."""
    out = F.lit("unsupported")
    for k, name in OPERATIONS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def selected(events: DataFrame, tables: DataFrame) -> DataFrame:
    """Events of the selected objects (owner, table_name, object_type), in whatever case they are written; views have none."""
    chosen = tables.where("object_type <> 'view'").select(F.upper("owner").alias("_o"), F.upper("table_name").alias("_t")).distinct()
    return events.join(chosen, (F.upper("owner") == F.col("_o")) & (F.upper("table_name") == F.col("_t")), "left_semi")


def supported(events: DataFrame) -> DataFrame:
    """Events without fragments of large objects, which the row's own image covers; any other operation than insert,
    update and delete fails the batch when it is read."""
    known = F.col("operation").isin("insert", "update", "delete")
    refuse = F.raise_error(F.concat(F.lit("unsupported operation "), F.coalesce("operation", F.lit("null")), F.lit(" at "), F.col("scn").cast("string"))).cast("string")
    return events.where(~F.col("operation").eqNullSafe("lob")).withColumn("operation", F.when(known, F.col("operation")).otherwise(refuse))


def coalesce_inserts(events: DataFrame, key: str = "key") -> DataFrame:
    """Within a transaction, updates of a key that it inserted before fold into that insert: the insert's scn, the
    last payload. A delete ends the run, so that a later insert begins another."""
    w = Window.partitionBy("commit_scn", "xid", key).orderBy("scn")
    runs = events.withColumn("_run", F.sum(F.when(F.col("operation") == "insert", 1).otherwise(0)).over(w) * 2 + F.when(F.col("operation") == "delete", 1).otherwise(0))
    ahead = Window.partitionBy("commit_scn", "xid", key, "_run").orderBy("scn")
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, folds = F.row_number().over(ahead), (F.col("_run") > 1) & (F.col("operation") != "delete")
    rest = [c for c in events.columns if c not in ("commit_scn", "xid", key, "scn", "operation")]
    out = runs.withColumns({"_first": first, "_folds": folds} | {f"_{c}": F.when(folds, F.last(c).over(whole)).otherwise(F.col(c)) for c in rest})
    return out.where("NOT _folds OR _first = 1").select("commit_scn", "xid", key, "scn", "operation", *(F.col(f"_{c}").alias(c) for c in rest))


def coalesce_chains(events: DataFrame, schema: str, key: str = "key", old_key: str = "old_key") -> DataFrame:
    """Like coalesce_inserts for updates that may change the key: an update whose old key, or whose new one if there is
    none, is that of a row inserted in the same transaction folds into the insert, which moves on to the new key.
    A delete closes the row. One transaction is one group; ``schema`` is the events' own DDL."""

    def fold(pdf):
        out, open_rows = [], {}
        for e in pdf.sort_values("scn").to_dict("records"):
            new, old = e[key], e[old_key]
            has_old = old is not None and old == old
            at = open_rows.get(old if has_old else new)
            if e["operation"] == "insert":
                open_rows[new] = len(out)
                out.append(dict(e))
            elif e["operation"] == "update" and at is not None:
                del open_rows[old if has_old else new]
                open_rows[new] = at
                out[at] = e | {"operation": "insert", "scn": out[at]["scn"], old_key: None}
            else:
                if e["operation"] == "delete":
                    open_rows.pop(old if has_old else new, None)
                out.append(dict(e))
        return type(pdf)(out, columns=pdf.columns)

    return events.groupBy("commit_scn", "xid").applyInPandas(fold, schema)


def split_key_changes(events: DataFrame, key: str = "key", old_key: str = "old_key") -> DataFrame:
    """An update that changes its key becomes a delete of the old one and an upsert of the new, in this order."""
    changed = F.col(old_key).isNotNull() & ~F.col(old_key).eqNullSafe(F.col(key))
    upsert = events.withColumn("sub", F.lit(1))
    delete = events.where(changed & (F.col("operation") == "update")).withColumn(key, F.col(old_key)).withColumn("operation", F.lit("delete")).withColumn("sub", F.lit(0))
    return upsert.unionByName(delete).drop(old_key)


def last_per_key(events: DataFrame, key: str = "key", order: tuple[str, ...] = ("commit_scn", "scn")) -> DataFrame:
    """The last event of each key, as one aggregation that is combined before the shuffle."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("e")
    return events.groupBy(key).agg(last).select(key, "e.*")


def versioned(snapshot: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A plain snapshot as (key, values, commit_scn, scn, sub, gone): rows older than any event."""
    return snapshot.select(key, *values, *(F.lit(0).cast("long").alias(c) for c in ("commit_scn", "scn")), F.lit(0).alias("sub"), F.lit(False).alias("gone"))


def visible(state: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The rows of a state that are there."""
    return state.where("NOT gone").select(key, *values)


def merge_events(state: DataFrame, events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The state (key, values, commit_scn, scn, sub, gone) after events (key, operation, values, commit_scn, scn and, if
    keys change, old_key): of each key what the last event by (commit_scn, scn) left, wherever it came from.

    Deleted keys stay as tombstones, so that events that commit late, come twice or come out of order change
    nothing that a later one wrote. An update that changes its key deletes the old one. One aggregation over
    the union, combined before the shuffle. Keys that the state holds twice fail when read.
    """
    split = split_key_changes(events) if "old_key" in events.columns else events.withColumn("sub", F.lit(1))
    fresh = supported(split).select(F.col("key").alias(key), *values, "commit_scn", "scn", "sub", (F.col("operation") == "delete").alias("gone"), F.lit(0).alias("_held"))
    both = state.select(*fresh.columns[:-1], F.lit(1).alias("_held")).unionByName(fresh)
    rest = [*values, "commit_scn", "scn", "sub", "gone"]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("commit_scn", "scn", "sub")).alias("e"), F.sum("_held").alias("_n"))
    twice = F.raise_error(F.concat(F.lit("the target holds a key more than once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return last.where(F.when(F.col("_n") > 1, twice).otherwise(True)).select(key, "e.*")


def apply_changes(snapshot: DataFrame, events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The snapshot after the events; applying the same events again changes nothing. To apply batches that may come
    late, keep the state of merge_events instead."""
    return visible(merge_events(versioned(snapshot, key, values), events, key, values), key, values)


def refresh_rows(state: DataFrame, events: DataFrame, source: DataFrame, key: str, values: list[str]) -> DataFrame:
    """merge_events with the source's present rows in place of the events' images: a key whose row is gone from
    the source is skipped; a key that the source holds twice fails when read."""
    n = F.count(F.lit(1)).alias("_n")
    rows = source.groupBy(F.col(key).alias("key")).agg(*(F.first(v).alias(v) for v in values), n)
    twice = F.raise_error(F.lit("the source holds a key more than once")).cast("boolean")
    rows = rows.where(F.when(F.col("_n") > 1, twice).otherwise(True)).drop("_n")
    plain = split_key_changes(events).drop("sub") if "old_key" in events.columns else events
    upserts = plain.where("operation <> 'delete'").drop(*values).join(rows, "key")
    return merge_events(state, plain.where("operation = 'delete'").unionByName(upserts), key, values)


def start_scn(current: int, oldest_open: int | None) -> int:
    """Where capture begins: before the oldest open transaction, if any."""
    return current if oldest_open is None else max(1, min(current, oldest_open) - 1)


def check_start(files: DataFrame, start: int, current: int) -> None:
    """Refuses a start that lies ahead or that no log file covers."""
    if start > current:
        raise ValueError(f"{start} is ahead of the log's {current}")
    if not covering_files(files, start, start).limit(1).count():
        raise ValueError(f"no log file covers {start}")


def lag(safe: int, checkpoint: int, end: int) -> dict:
    """{lag, phase}: realtime once a window has reached the safe number."""
    return {"lag": max(safe - checkpoint, 0), "phase": "realtime" if end >= safe else "catching_up"}


def missing_log_columns(required: DataFrame, logged: DataFrame) -> DataFrame:
    """(table_name, columns) that a key needs and no log group of the table holds; both are (table_name, column_name)."""
    lacking = required.join(logged, [F.upper(required["table_name"]) == F.upper(logged["table_name"]), F.upper(required["column_name"]) == F.upper(logged["column_name"])], "left_anti")
    return lacking.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"))


def key_summary(old: Column, new: Column, most: int = 80) -> Column:
    """old -> new for a log line, each cut at ``most`` characters."""
    cut = lambda c: F.substring(F.coalesce(c.cast("string"), F.lit("?")), 1, most)
    return F.when(old.isNull() | old.eqNullSafe(new), cut(new)).otherwise(F.concat_ws(" -> ", cut(old), cut(new)))


def breakdown(events: DataFrame) -> DataFrame:
    """(operation, n_events) and their total."""
    return events.rollup("operation").agg(F.count(F.lit(1)).alias("n_events")).select(F.coalesce("operation", F.lit("total")).alias("operation"), "n_events")
