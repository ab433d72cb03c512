"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Each source is a queue of its documents in a hashed order, run through up to ``max_repeats`` times. A document's
virtual finish time is the words its source has sent by its end, over the source's target. All are
range-sorted by finish time and cut at the total budget; the document at the cut is taken in part.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the budget, which is all words;
what a source is owed beyond ``max_repeats`` times its words is shared anew by weight.

No queue is summed in one task: a queue is split into about sqrt(rows) ranges of its hash, each summed
first, and the running sum of a range begins with the sum of those before it. The global order is cut the
same way, its ranges in two levels. Only (id, source, size) rows are shuffled, never texts.

Defined cases: null text has size 0 and is never taken; null ids are rows of their own; repeated rows share a
place in their queue's order and are told apart by a row number fixed in a written table, or by file and place in
it; other columns are ignored, or kept by ``mixed_documents``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ferrule.llm.common import Scratch, n_words, numbered


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, place, source_size, target): one row per source; sized has (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on, so that the windows without partitions are over the sources alone
    w = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + F.when(F.col("place") % len(weights) == 0, len(weights)).otherwise(0)), "cap": (max_repeats * F.col("source_size")).cast("decimal(38,0)")})
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy()
    w = w.withColumns({
        "before": F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"),
        "rest": F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(every),
    })
    w = w.withColumn("full", F.expr("cap * rest <= (total - before) * weight"))
    w = w.withColumns({"spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * max_repeats)).over(every), F.lit(0)), "share": F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)})
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * (F.col("total") - F.col("spent")).cast("double") / F.col("share").cast("double"))
    return w.select("source", "place", "source_size", "total", target.alias("target"))


def _order_key(doc_id: Column, size: Column, text: Column) -> Column:
    """The hash that puts a source's documents in order; rows without an id are spread by their texts."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"), F.when(doc_id.isNull(), F.md5(F.coalesce(text, F.lit(""))))))


def _ahead(sums: DataFrame, keys: list[str], piece: str) -> DataFrame:
    """(keys, piece, ahead): what the pieces before sum up to; sums has (keys, piece, s)."""
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, piece, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))


def _mixed(s: Scratch, docs: DataFrame, weights: tuple[int, ...], max_repeats: int, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    """(doc_id, source, h, row, size, source_size, target, taken) of every document."""
    doc_id, text, size = F.col(id_col), F.col(text_col), n_words(F.col(text_col))
    sized = docs.select(doc_id.alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), row.alias("row"), _order_key(doc_id, size, text).alias("h"))
    rows = s.table(sized, "op6-rows")
    ranges, n = 64, rows.count()
    while ranges * ranges < n:
        ranges *= 2
    targets = s.table(source_targets(rows, weights, max_repeats).withColumnRenamed("source", "of"), "op6-targets")
    found = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    found = found.withColumn("part", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int"))
    sums = _ahead(found.groupBy("place", "part").agg(F.sum("size").alias("s")), ["place"], "part")
    within = Window.partitionBy("place", "part").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)
    queued = found.join(sums, ["place", "part"]).withColumn("sent", F.col("ahead") + F.sum("size").over(within)).drop("ahead", "part")
    queued = s.table(queued, "op6-queues")
    turns = queued.where("size > 0").withColumn("turn", F.explode(F.array(*map(F.lit, range(max_repeats)))))
    turns = turns.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("sent")).cast("double") / F.col("target"))
    turns = turns.withColumn("slot", F.floor(F.least("finish", F.lit(1024.0)) * ranges).cast("long"))  # the cut lies near 1
    slots = turns.groupBy("slot").agg(F.sum("size").alias("s")).withColumn("block", F.floor(F.col("slot") / ranges))
    blocks = _ahead(slots.groupBy("block").agg(F.sum("s").alias("s")), [], "block").withColumnRenamed("ahead", "base")  # 1,025 rows at most
    sums = _ahead(slots, ["block"], "slot").join(blocks, "block").select("slot", (F.col("ahead") + F.col("base")).alias("ahead"))
    turns = turns.join(sums, "slot").where("ahead < total")
    order = Window.partitionBy("slot").orderBy("finish", "place", "turn", "h", "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.col("ahead") - F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = turns.withColumn("take", F.greatest(F.lit(0), F.least("size", left))).groupBy("row").agg(F.sum("take").alias("taken"))
    s.drop(rows, targets)
    return queued.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, row, size, source_size, target, taken) of every document; row tells repeated ids apart."""
    with Scratch(docs.sparkSession) as s:
        out = _mixed(s, docs, weights, max_repeats, id_col, text_col, source_col, F.monotonically_increasing_id())
        return s.result(out.select("doc_id", "row", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, a part counting as the whole, other columns kept.

    A source's taken documents are the first of its queue in its last turn and all in the turns before, so that
    one row a source, the last that was taken, decides for each document where it lies: texts are neither
    shuffled nor written.
    """
    with Scratch(docs.sparkSession) as s:
        rows = numbered(docs, "__row", s)
        out = _mixed(s, rows, weights, max_repeats, id_col, text_col, source_col, F.col("__row"))
        last = F.max(F.struct(F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"), "h", "row")).alias("__last")
        cuts = s.table(out.where("taken > 0").groupBy(F.col("source").alias("__of")).agg(last), "op6-cuts")
        size = n_words(F.col(text_col))
        keyed = rows.withColumn("__size", size).withColumn("__h", _order_key(F.col(id_col), F.col("__size"), F.col(text_col)))
        met = keyed.join(cuts, F.col(source_col).eqNullSafe(F.col("__of")))
        taken = F.struct(F.col("__h").alias("h"), F.col("__row").alias("row")) <= F.struct("__last.h", "__last.row")
        times = F.when(F.col("__size") == 0, 0).when(taken, F.col("__last.times")).otherwise(F.col("__last.times") - 1)
        return s.result(met.withColumn("__turn", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR || CASE WHEN doc_id IS NULL THEN ':' || md5(coalesce(text, '')) ELSE '' END) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
n AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
c AS (SELECT *, cap * rest <= (total - before) * weight AS is_full FROM n),
t AS (SELECT source, place, source_size, total,
             CASE WHEN is_full THEN cap::DOUBLE ELSE weight::DOUBLE * (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))::DOUBLE / (sum(CASE WHEN NOT is_full THEN weight END) OVER ())::DOUBLE END AS target FROM c),
q AS (SELECT d.*, place, source_size, total, target, sum(size) OVER (PARTITION BY place ORDER BY h, rid ROWS UNBOUNDED PRECEDING) AS sent FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (turn * source_size + sent)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0),
g AS (SELECT rid, greatest(0, least(size, total - coalesce(sum(size) OVER (ORDER BY finish, place, turn, h, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM e)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM q LEFT JOIN (SELECT rid, sum(take) AS taken FROM g GROUP BY rid) USING (rid)
"""
