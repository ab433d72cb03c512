"""Jobs: their states, progress, totals and errors; what a source must have before changes are read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a job, and those that follow each.
NEXT = {
    "queued": ("running", "cancelled", "failed"),
    "running": ("catching_up", "completed", "failed", "cancelled"),
    "catching_up": ("syncing", "completed", "failed", "cancelled"),
    "syncing": ("catching_up", "completed", "failed", "cancelled"),
    "completed": (),
    "failed": ("queued",),
    "cancelled": ("queued",),
}
#: Codes and phrases of a refused connection, and what they mean, in order of test.
CONNECTION = (
    (("ORA-01017", "DPY-4001"), "credentials"),
    (("ORA-12514", "ORA-12505"), "unknown_service"),
    (("ORA-12541",), "listener_down"),
    (("ORA-12170", "DPY-6005", "timed out", "timeout"), "timeout"),
    (("ORA-28000",), "locked_account"),
    (("ORA-28001",), "expired_password"),
)
#: Accounts that a source brings with it, by dialect.
SENSITIVE = {"oracle": ("SYS", "SYSTEM", "DBSNMP", "OUTLN", "XDB", "SYSMAN", "MGMT_VIEW"), "mysql": ("ROOT", "ADMIN", "ADMINISTRATOR")}


def advance(state: str, to: str) -> str:
    """``to``, if it may follow ``state``; else ValueError."""
    if to not in NEXT.get(state, ()):
        raise ValueError(f"a job that is {state} cannot become {to}")
    return to


def recovered(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, status, sync_mode) after a restart: those that follow changes are queued again from their checkpoint,
    full loads that ran or waited have failed, all others stay as they are. Adds ``action``: resume, fail or none."""
    follows = F.col("status").isin("catching_up", "syncing") & ~F.coalesce(F.col("sync_mode") == "full_only", F.lit(False))
    action = F.when(follows, "resume").when(F.col("status").isin("queued", "running"), "fail").otherwise("none")
    rows = jobs.withColumn("action", action)
    return rows.withColumn("status", F.when(F.col("action") == "resume", "queued").when(F.col("action") == "fail", "failed").otherwise(F.col("status")))


def planned_progress(planned: DataFrame, results: DataFrame, active: DataFrame) -> DataFrame:
    """(phase, total, completed, failed, cancelled, running, pending, percent) of planned objects (phase, name), by their
    results (phase, name, status) and those active now (name). Skipped counts as cancelled; an object without a result that is
    not active is pending; results of objects that were not planned do not count."""
    status = results.groupBy("phase", "name").agg(F.max("status").alias("status"))
    busy = active.select("name").distinct().withColumn("busy", F.lit(True))
    rows = planned.select("phase", "name").distinct().join(status, ["phase", "name"], "left").join(busy, "name", "left")
    state = F.when(F.col("status") == "success", "completed").when(F.col("status") == "failed", "failed").when(F.col("status").isin("cancelled", "skipped"), "cancelled").when(F.col("busy"), "running").otherwise("pending")
    n = {s: F.count_if(F.col("state") == s) for s in ("completed", "failed", "cancelled", "running", "pending")}
    percent = F.round(100 * (n["completed"] + n["failed"] + n["cancelled"]) / F.count(F.lit(1)), 2)
    return rows.withColumn("state", state).groupBy("phase").agg(F.count(F.lit(1)).alias("total"), *(c.alias(s) for s, c in n.items()), percent.alias("percent"))


def object_total(tables: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """(total): distinct tables (name) and, if they are moved, distinct sequences (name)."""
    names = tables.select(F.lit("table").alias("kind"), "name")
    if sequences is not None:
        names = names.unionAll(sequences.select(F.lit("sequence").alias("kind"), "name"))
    return names.distinct().agg(F.count(F.lit(1)).alias("total"))


def target_owner(name: Column, owner: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Owner in the target of a table: what the mapping has for the name's own owner, or else for ``owner``, in whatever case;
    ``default`` where it has none."""
    own = F.trim(F.substring_index(name, ".", 1))
    source = F.upper(F.when(name.contains(".") & (own != ""), own).otherwise(owner))
    out = F.lit(default).cast("string")
    for one, to in mapping.items():
        out = F.when(source == one.upper(), F.lit(to)).otherwise(out)
    return out


def failure_kind(message: Column, kind: Column) -> Column:
    """Kind of a table's failure by its message and the error's type: no_space, lock_timeout, metadata or other."""
    low = F.lower(F.coalesce(message, F.lit("")))
    space = low.contains("disk is full") | low.contains("(3675")
    lock = low.contains("lock wait timeout") | low.contains("(1205")
    return F.when(space, "no_space").when(lock, "lock_timeout").when(kind.isin("NoSuchTableError", "KeyError"), "metadata").otherwise("other")


def connection_error(message: Column) -> tuple[Column, Column]:
    """(code, kind) of a refused connection: the first ORA- or DPY- code, or CONNECTION_ERROR, and what it means. Only the
    first 500 characters are read; any of them may name the cause."""
    cause = F.substring(F.translate(F.coalesce(message, F.lit("")), "\n", " "), 1, 500)
    code = F.regexp_extract(cause, r"(?:ORA|DPY)-\d+", 0)
    kind = F.lit("other")
    for needles, meaning in reversed(CONNECTION):
        hit = F.lit(False)
        for x in needles:
            hit = hit | F.lower(cause).contains(x.lower())
        kind = F.when(hit, meaning).otherwise(kind)
    return F.when(code == "", "CONNECTION_ERROR").otherwise(code), kind


def log_ready(log_mode: Column, minimal: Column, container: Column, is_container: Column) -> Column:
    """Whether a source's changes can be read: it archives its log, logs more than the least, and the session is in the root,
    if there are containers."""
    root = (F.upper(is_container) != "YES") | (F.upper(container) == "CDB$ROOT")
    return F.coalesce((F.upper(log_mode) == "ARCHIVELOG") & F.upper(minimal).isin("YES", "IMPLICIT") & root, F.lit(False))


def first_parameter(parameters: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(parameter, value): of each parameter's aliases, in order, the first that has a value in parameters (name, value),
    whatever its case; null where none has. Aliases are few and are broadcast."""
    rows = [(p, a.lower(), i) for p, names in aliases.items() for i, a in enumerate(names)]
    spark = parameters.sparkSession
    known = spark.createDataFrame(rows, "parameter string, alias string, place int")
    every = spark.createDataFrame([(p,) for p in aliases], "parameter string")
    held = parameters.where("value IS NOT NULL").join(F.broadcast(known), F.lower("name") == F.col("alias"))
    best = held.groupBy("parameter").agg(F.min_by("value", F.struct("place", "value")).alias("value"))
    return every.join(best, "parameter", "left").select("parameter", "value")


def sensitive_accounts(accounts: DataFrame, dialect: str) -> DataFrame:
    """Rows of accounts (account) that a source of this dialect brings with it."""
    return accounts.where(F.upper("account").isin(*SENSITIVE.get(dialect, ("",))))


def grants(held: DataFrame, what: str, most: int = 20) -> DataFrame:
    """(what, grants): how often each role or privilege is granted, the ``most`` granted first."""
    return held.groupBy(what).agg(F.count(F.lit(1)).alias("grants")).orderBy(F.desc("grants"), what).limit(most)


def clean_names(names: list[str], most: int = 255) -> list[str]:
    """Names without blanks at their ends, each once, in order. Empty, overlong or control characters: ValueError."""
    out = [x.strip() for x in names]
    for x in out:
        if not x or len(x) > most or any(ord(ch) < 32 for ch in x):
            raise ValueError(f"not a name: {x!r}")
    return list(dict.fromkeys(out))
