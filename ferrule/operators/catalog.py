"""Catalog frames: objects, keys, sizes and dependencies, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.naming import natural_key

#: Bits of a trigger's type.
TRIGGER_BITS = ((4, "INSERT"), (8, "DELETE"), (16, "UPDATE"), (32, "TRUNCATE"))


def bulk_objects(tables: DataFrame, partitioned: DataFrame, views: DataFrame, columns: DataFrame, keys: DataFrame, sequences: DataFrame) -> DataFrame:
    """(object_type, name, n_columns, primary_key) of all objects from one frame a kind, in order of type and name."""
    kind = F.when(F.col("p").isNotNull(), "partitioned_table").otherwise("table")
    part = partitioned.select("name", F.lit(1).alias("p")).distinct()
    named = tables.select("name").join(part, "name", "left").select("name", kind.alias("object_type")).unionByName(views.select("name", F.lit("view").alias("object_type")))
    n = columns.groupBy("name").agg(F.count(F.lit(1)).alias("n_columns"))
    k = keys.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]), ",").alias("primary_key"))
    full = named.join(n, "name", "left").join(k, "name", "left").unionByName(sequences.select("name", F.lit("sequence").alias("object_type")), allowMissingColumns=True)
    return sorted_objects(full.select("object_type", "name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("primary_key", F.lit("")).alias("primary_key")))


def sorted_objects(objects: DataFrame) -> DataFrame:
    """By type, then by name in its natural order, in which case counts for nothing."""
    return objects.orderBy("object_type", natural_key(F.col("name")), "name")


def owners(objects: DataFrame, excluded: list[str], patterns: list[str] = ()) -> DataFrame:
    """(owner) of objects, without those named and those like a pattern."""
    keep = ~F.col("owner").isin(excluded) if excluded else F.lit(True)
    for p in patterns:
        keep = keep & ~F.col("owner").like(p)
    return objects.where(keep).select("owner").distinct()


def sizes(tables: DataFrame, segments: DataFrame) -> DataFrame:
    """Tables with the sum of their segments' bytes, 0 for none."""
    total = segments.groupBy("table_name").agg(F.sum("bytes").alias("bytes"))
    return tables.join(total, "table_name", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))


def marked(tables: DataFrame, keyed: DataFrame, large: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables with has_key and has_large, whether a frame holds them, and n_indexes, how often one does."""
    mark = lambda df, name: df.select("table_name", F.lit(True).alias(name)).distinct()
    n = indexes.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_indexes"))
    out = tables.join(mark(keyed, "has_key"), "table_name", "left").join(mark(large, "has_large"), "table_name", "left").join(n, "table_name", "left")
    return out.fillna(False, ["has_key", "has_large"]).fillna(0, ["n_indexes"])


def foreign_keys(constraints: DataFrame, most: int = 20) -> DataFrame:
    """(child, parent, name): each foreign key joined with the constraint that it refers to; the first ``most`` by name."""
    child, parent = constraints.alias("c"), constraints.alias("p")
    found = child.where("kind = 'R'").join(parent.where("kind IN ('P', 'U')"), F.col("c.refers_to") == F.col("p.name"))
    return found.select(F.col("c.table_name").alias("child"), F.col("p.table_name").alias("parent"), F.col("c.name").alias("name")).orderBy("name").limit(most)


def trigger_events(code: Column) -> Column:
    """Names of the events that a trigger's type stands for, joined by OR."""
    return F.array_join(F.array_compact(F.array(*(F.when(code.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in TRIGGER_BITS))), " OR ")


def truncated(rows: DataFrame, order: list, most: int = 100) -> DataFrame:
    """The first ``most`` rows, each with how many there are in all and whether some are left out."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(most).join(F.broadcast(total), F.lit(True)).withColumn("truncated", F.col("total") > most)


def ordered_distinct(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): each value once, with the least place that holds it."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def object_counts(objects: DataFrame) -> DataFrame:
    """(object_type, n_objects), with all of them as total."""
    return objects.rollup("object_type").agg(F.count(F.lit(1)).alias("n_objects")).select(F.coalesce("object_type", F.lit("total")).alias("object_type"), "n_objects")


def partition_distribution(layouts: DataFrame) -> DataFrame:
    """(layout, n_tables, n_partitions) of layouts (table_name, kind, sub_kind, partitions); NONE and null are no sub-layout."""
    sub = F.when(F.coalesce("sub_kind", F.lit("NONE")) == "NONE", F.lit(None)).otherwise(F.col("sub_kind"))
    return layouts.groupBy(F.concat_ws("-", "kind", sub).alias("layout")).agg(F.count(F.lit(1)).alias("n_tables"), F.sum("partitions").alias("n_partitions"))


def fk_tree(foreign: DataFrame, most: int = 1000) -> DataFrame:
    """(root, node, depth, n_children): tables below each table that is no one's child; where all are children, below the first
    parent by name. Depths are found level by level, each one join, a table at its least depth; ``most`` levels end in an error."""
    edges = foreign.select("child", "parent").where("child <> parent").distinct().persist()
    try:
        n = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
        roots = edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")).distinct(), "root", "left_anti")
        if not roots.limit(1).count():
            roots = edges.agg(F.min("parent").alias("root")).where("root IS NOT NULL")
        level = [(r["root"], r["root"]) for r in roots.collect()]  # tables of a catalog
        below: dict[str, list[str]] = {}
        for r in edges.collect():
            below.setdefault(r["parent"], []).append(r["child"])
        seen = dict.fromkeys(level, 0)
        for depth in range(1, most + 2):
            level = [x for x in {(root, c) for root, node in level for c in below.get(node, ())} if x not in seen]
            if not level:
                break
            if depth > most:
                raise ValueError(f"the tree has more than {most} levels")
            seen |= dict.fromkeys(level, depth)
        rows = foreign.sparkSession.createDataFrame([(a, b, d) for (a, b), d in seen.items()], "root string, node string, depth int")
        return rows.join(n, "node", "left").select("root", "node", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"))
    finally:
        edges.unpersist()
