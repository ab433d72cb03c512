"""Assessment from facts to a report: checks to risks, comparison of parameters, suggestions, conclusion, HTML."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators import assess

#: Fixed values of the rules.
MANY_ROWS, MUCH_ROWS, MUCH_BYTES, NULL_RATE, LONG_TEXT = 50_000_000, 5_000_000, 10 << 30, 0.30, 16_383
CANDIDATE_ROWS, CANDIDATES, TOP, PAIRS, SECTIONS = 200_000, 20, 10, 20, ("summary", "environment", "objects", "data", "quality", "risks", "estimate", "conclusion")
RISK = "level string, category string, code string, object string, message string"
#: Bytes that a column of a kind is estimated at; text counts by its length up to 4,096.
COLUMN_BYTES = {"large": 4096, "date": 32, "number": 16, "other": 64}


def column_bytes(kind: Column, length: Column) -> Column:
    """Estimated bytes of a column by its declared length, else by its kind (large, date, number, other)."""
    out = F.lit(COLUMN_BYTES["other"])
    for k, n in COLUMN_BYTES.items():
        out = F.when(kind == k, n).otherwise(out)
    return F.when(length.isNotNull(), F.least(length, F.lit(4096))).otherwise(out)


def quick_sizes(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_name, n_rows, row_estimate, bytes_estimate): columns are (table_name, kind, length), rows (table_name, n_rows)."""
    per = columns.groupBy("table_name").agg(F.sum(column_bytes(F.col("kind"), F.col("length"))).cast("long").alias("row_estimate"))
    return rows.join(per, "table_name", "left").select("table_name", "n_rows", F.coalesce("row_estimate", F.lit(0)).alias("row_estimate"), (F.col("n_rows") * F.coalesce("row_estimate", F.lit(0))).alias("bytes_estimate"))


def quick_risks(tables: DataFrame, policy: str = "fail") -> DataFrame:
    """Risks (table_name, level, code) of tables (table_name, is_view, renamed, has_external, has_large, has_zoned, has_key,
    takes_surrogate, target_exists, target_case): one row a rule that holds."""
    rule = lambda when, level, code: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    held = F.array_compact(F.array(
        rule(F.col("is_view"), "warning", "VIEW_MATERIALIZED"), rule(F.col("renamed"), "info", "NAME_TRANSFORM"), rule(F.col("has_external"), "blocking", "BFILE_EXTERNAL"),
        rule(F.col("has_large"), "warning", "LEGACY_LOB"), rule(F.col("has_zoned"), "warning", "TIMEZONE_TO_TEXT"), rule(~F.col("has_key") & ~F.col("is_view") & ~F.col("takes_surrogate"), "warning", "NO_PRIMARY_KEY"),
        rule(~F.col("has_key") & ~F.col("is_view") & F.col("takes_surrogate"), "warning", "SYNTHETIC_PRIMARY_KEY"),
        rule(F.col("target_exists"), "blocking" if policy == "fail" else "warning", "TARGET_EXISTS"), rule(F.col("target_case") & ~F.col("target_exists"), "warning", "NAME_CASE"),
    ))
    return tables.select("table_name", F.explode(held).alias("r")).select("table_name", "r.*")


def candidates(tables: DataFrame, most_rows: int = CANDIDATE_ROWS, top: int = CANDIDATES) -> DataFrame:
    """Tables (table_name, n_rows) that are checked row by row: those of up to ``most_rows``, the largest ``top``."""
    return tables.where(F.col("n_rows") <= most_rows).orderBy(F.desc("n_rows"), "table_name").limit(top)


#: check: (level, code)
QUALITY = {"null_rate": ("warning", "QUALITY_NULL_RATE"), "duplicates": ("blocking", "QUALITY_DUPLICATES"), "overlong": ("warning", "QUALITY_OVERLONG"), "encoding": ("warning", "QUALITY_ENCODING"), "unique_conflict": ("warning", "QUALITY_UNIQUE_CONFLICT")}


def quality_risks(checks: DataFrame) -> DataFrame:
    """Risks of findings (table_name, check, value): null rates count above their bound, all else above 0."""
    level, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (a, b) in QUALITY.items():
        level, code = F.when(F.col("check") == name, a).otherwise(level), F.when(F.col("check") == name, b).otherwise(code)
    bad = checks.where(F.col("value") > F.when(F.col("check") == "null_rate", NULL_RATE).otherwise(0.0))
    return bad.select(level.alias("level"), F.lit("quality").alias("category"), code.alias("code"), F.col("table_name").alias("object")).where("code IS NOT NULL").distinct()


def compare_parameters(source: DataFrame, target: DataFrame) -> DataFrame:
    """(name, source_value, target_value, risk) of parameters (name, value), whichever side has them: equal but for case is
    ok, a side without one unknown; character sets, collations, case rules and SQL modes that differ are warnings, others info."""
    s = source.select(F.lower("name").alias("name"), F.col("value").alias("source_value"))
    t = target.select(F.lower("name").alias("name"), F.col("value").alias("target_value"))
    grave = F.col("name").rlike("char|collat|case|sql_mode|isolation|zone")
    risk = (
        F.when(F.col("source_value").isNull() | F.col("target_value").isNull(), "unknown")
        .when(F.lower("source_value") == F.lower("target_value"), "ok")
        .when(grave, "warning")
        .otherwise("info")
    )
    return s.join(t, "name", "full_outer").withColumn("risk", risk)


def table_risks(facts: DataFrame) -> DataFrame:
    """Risks of tables (table_name, n_rows, bytes, has_key, has_large, n_foreign)."""
    rule = lambda when, level, category, code: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(code).alias("code")))
    held = F.array_compact(F.array(
        rule(~F.col("has_key"), "warning", "data", "NO_PRIMARY_KEY"), rule(F.col("has_large"), "warning", "data", "LEGACY_LOB"),
        rule(F.col("n_rows") > MANY_ROWS, "warning", "data", "LARGE_TABLE"), rule(F.col("n_foreign") > 0, "info", "objects", "FOREIGN_KEYS"),
    ))
    return facts.select(F.col("table_name").alias("object"), F.explode(held).alias("r")).select("r.*", "object")


def suggestions(facts: DataFrame, risks: DataFrame) -> DataFrame:
    """(code) of what to do, from table facts and risks."""
    f = facts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("r"))
    r = risks.agg(*(F.coalesce(F.max(F.col("code") == code), F.lit(False)).alias(code) for code in ("NO_PRIMARY_KEY", "LEGACY_LOB", "FOREIGN_KEYS")), F.coalesce(F.max(F.col("level") == "blocking"), F.lit(False)).alias("blocked"))
    said = F.array_compact(F.array(
        F.when(F.col("b") > MUCH_BYTES, "SPLIT_BY_SIZE"), F.when(F.col("r") > MUCH_ROWS, "RAISE_CONCURRENCY"), F.when(F.col("NO_PRIMARY_KEY"), "ADD_KEYS"),
        F.when(F.col("LEGACY_LOB"), "SMALLER_BATCHES"), F.when(F.col("FOREIGN_KEYS"), "CONSTRAINTS_LAST"), F.when(F.col("blocked"), "CLEAR_BLOCKERS"),
    ))
    return f.join(r, F.lit(True)).select(F.explode(said).alias("code"))


def total_estimate(tables: DataFrame, mbps: float = 50, batch: int = 2000, concurrency: int = 1, top: int = 50) -> DataFrame:
    """(tables, seconds, seconds_low, seconds_high) over the ``top`` largest tables (table_name, n_rows, bytes), copied several at once."""
    first = tables.orderBy(F.desc("bytes"), "table_name").limit(top)
    each = assess.estimate(F.col("n_rows").cast("double"), F.col("bytes").cast("double"), mbps, batch)["seconds"]
    s = F.coalesce(F.sum(each), F.lit(0.0)) / concurrency
    return first.agg(F.count(F.lit(1)).alias("tables"), F.round(s, 4).alias("seconds"), F.round(s * assess.LOW, 4).alias("seconds_low"), F.round(s * assess.HIGH, 4).alias("seconds_high"))


def conclusion(risks: DataFrame, parameters: DataFrame) -> DataFrame:
    """(dimension, status, n_blocking, n_warning): parameters, objects, data, quality and overall; blocked, attention or ok."""
    given = parameters.where("risk = 'warning'").select(F.lit("parameters").alias("category"), F.lit("warning").alias("level"))
    found = risks.select("category", "level").unionByName(given)
    n = found.groupBy("category").agg(F.count_if(F.col("level") == "blocking").alias("n_blocking"), F.count_if(F.col("level") == "warning").alias("n_warning"))
    every = found.agg(F.lit("overall").alias("category"), F.count_if(F.col("level") == "blocking").alias("n_blocking"), F.count_if(F.col("level") == "warning").alias("n_warning"))
    names = risks.sparkSession.createDataFrame([(x,) for x in ("parameters", "objects", "data", "quality", "overall")], "category string")
    full = names.join(n.unionByName(every), "category", "left").fillna(0)
    status = F.when(F.col("n_blocking") > 0, "blocked").when(F.col("n_warning") > 0, "attention").otherwise("ok")
    return full.select(F.col("category").alias("dimension"), status.alias("status"), "n_blocking", "n_warning")


def human_duration(seconds: Column) -> Column:
    """12 s, 3 min 5 s, 2 h 10 min or 1 d 4 h."""
    n = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    two = lambda big, a, small, b: F.concat((n / big).cast("long").cast("string"), F.lit(f" {a} "), F.floor(n % big / small).cast("string"), F.lit(f" {b}"))
    return F.when(n < 60, F.concat(n.cast("string"), F.lit(" s"))).when(n < 3600, two(60, "min", 1, "s")).when(n < 86400, two(3600, "h", 60, "min")).otherwise(two(86400, "d", 3600, "h"))


def human_bytes(size: Column) -> Column:
    """Bytes in the largest unit that they fill, one decimal above bytes."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1 << 10 * k, F.concat(F.format_string("%.1f", size / (1 << 10 * k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_rows(rows: Column) -> Column:
    """Rows as they are, in thousands (K) or millions (M), one decimal."""
    return F.when(rows >= 1_000_000, F.concat(F.format_string("%.1f", rows / 1_000_000), F.lit("M"))).when(rows >= 1000, F.concat(F.format_string("%.1f", rows / 1000), F.lit("K"))).otherwise(rows.cast("string"))


def html_report(title: str, sections: dict[str, DataFrame], most: int = 100) -> str:
    """One HTML page of the sections, in their fixed order and then others, ``most`` rows of each."""
    order = [s for s in SECTIONS if s in sections] + [s for s in sections if s not in SECTIONS]
    cell = lambda x, tag: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    body = []
    for name in order:
        df = sections[name]
        rows = df.limit(most + 1).collect()
        table = "".join(f"<tr>{''.join(cell(x, 'td') for x in r)}</tr>" for r in rows[:most])
        more = f"<p>Only {most} rows are shown.</p>" if len(rows) > most else ""
        body.append(f"<section><h2>{html.escape(name)}</h2><table><tr>{''.join(cell(c, 'th') for c in df.columns)}</tr>{table}</table>{more}</section>")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(body)}"


def defended(metrics: dict, notes: list[tuple[str, str]]) -> dict:
    """Each metric's value, null where it fails; notes gets (metric, message)."""
    out = {}
    for name, f in metrics.items():
        try:
            out[name] = f()
        except Exception as e:  # a metric that cannot be had is a note
            out[name] = None
            notes.append((name, str(e).splitlines()[0][:4000]))
    return out
