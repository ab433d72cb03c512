"""Continuous replication: idempotent micro-batches into a state kept in buckets of keys.

The state holds for each key its last version, tombstones too, so that transactions that commit late or come
again change nothing newer. A batch rewrites the buckets that it touches, as new folders; a manifest, one small JSON
line a version, names each bucket's folder and is written last. A batch that fails midway is repeated from the
old manifest. The ledger's rows lie beside the version that they belong to and count from its manifest on.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.operators import changelog
from ferrule.operators.load import exists


class Replica:
    """A replicated table below ``root``: state/<version>/bucket=<n>, ledger/<version>, manifest/<version>."""

    def __init__(self, spark: SparkSession, root: str, key: str, values: list[str], schema: str, buckets: int = 16, keep: int = 3):
        self.spark, self.root, self.key, self.values, self.buckets, self.keep = spark, root.rstrip("/"), key, values, buckets, keep
        kind = T.StructType.fromDDL(schema)
        self.rows = T.StructType([kind[key], *(kind[v] for v in values)])
        self.schema = T.StructType([*self.rows.fields, T.StructField("commit_scn", T.LongType()), T.StructField("scn", T.LongType()), T.StructField("sub", T.IntegerType()), T.StructField("gone", T.BooleanType())])

    def _manifest(self) -> dict:
        """{version, buckets: {bucket: folder's version}, scn} of the last whole version."""
        path = f"{self.root}/manifest"
        if not exists(self.spark, path):
            return {"version": -1, "buckets": {}, "scn": 0}
        lines = [json.loads(r["value"]) for r in self.spark.read.option("recursiveFileLookup", "true").text(path).collect()]  # ``keep`` lines
        return max(lines, key=lambda x: x["version"], default={"version": -1, "buckets": {}, "scn": 0})

    def version(self) -> int:
        return self._manifest()["version"]

    def checkpoint(self) -> int:
        """The greatest commit number applied."""
        return self._manifest()["scn"]

    def _folders(self, held: dict, only: set | None = None) -> list[str]:
        return [f"{self.root}/state/{v}/bucket={b}" for b, v in held["buckets"].items() if only is None or int(b) in only]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def state(self) -> DataFrame:
        return self._read(self._folders(self._manifest()))

    def snapshot(self) -> DataFrame:
        return changelog.visible(self.state(), self.key, self.values)

    def ledger(self) -> DataFrame:
        path, kind = f"{self.root}/ledger", "commit_scn long, xid long, version int"
        held = self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], kind)
        return held.where(F.col("version") <= self.version())

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, _epoch: int = 0) -> None:
        fresh = changelog.unapplied(batch, self.ledger()).persist()
        try:
            moved = F.expr("operation = 'update' AND old_key IS NOT NULL AND NOT old_key <=> key") if "old_key" in fresh.columns else F.lit(False)
            old = self._bucket("old_key") if "old_key" in fresh.columns else F.lit(None).cast("int")
            seen = fresh.where("NOT operation <=> 'lob'").agg(F.collect_set(self._bucket("key")).alias("new"), F.collect_set(F.when(moved, old)).alias("old"), F.max("commit_scn").alias("scn")).first()
            touched = {*seen["new"], *seen["old"]}  # ``buckets`` numbers at most
            if not touched:
                return
            held = self._manifest()
            v = held["version"] + 1
            before = self._read(self._folders(held, touched))
            after = changelog.merge_events(before, fresh, self.key, self.values)
            after.withColumn("bucket", self._bucket(self.key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/state/{v}")
            fresh.select("commit_scn", "xid").distinct().withColumn("version", F.lit(v)).write.mode("overwrite").parquet(f"{self.root}/ledger/{v}")
            line = json.dumps({"version": v, "scn": max(held["scn"], seen["scn"]), "buckets": held["buckets"] | {str(b): v for b in touched}})
            self.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{v}")
            self._retire(held, {int(x) for x in json.loads(line)["buckets"].values()}, v)
        finally:
            fresh.unpersist()

    def _retire(self, held: dict, used: set[int], v: int) -> None:
        """Deletes manifests older than ``keep`` versions, and state folders that neither the last nor the one before names."""
        spark = self.spark
        used = used | {int(x) for x in held["buckets"].values()}
        hadoop = spark._jvm.org.apache.hadoop.fs
        for kind in ("state", "manifest"):
            path = hadoop.Path(f"{self.root}/{kind}")
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            for f in fs.listStatus(path):
                name = f.getPath().getName()
                if name.isdigit() and (int(name) not in used if kind == "state" else int(name) <= v - self.keep):
                    fs.delete(f.getPath(), True)

    def follow(self, events: DataFrame, checkpoint: str, once: bool = True, seconds: int = 3):
        """A streaming query that applies each micro-batch; ``seconds``, 1 to 60, lie between polls."""
        if not 1 <= seconds <= 60:
            raise ValueError("polls are 1 to 60 seconds apart")
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
