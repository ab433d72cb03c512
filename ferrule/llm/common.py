"""Shared plumbing of the llm operators: scratch tables, word hashing, packed blocks, connected components.

Scratch tables are Parquet folders below ``spark.checkpoint.dir`` (or the context's
checkpoint folder); only in local mode, where neither is set, a temporary folder is made.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \t \n \v \f \r, as ``bytes.split()`` does.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; on a cluster it must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="ferrule-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _relations(df: DataFrame):
    """(JVM relation, root path) of each file scan in a frame's plan."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            for k in range(roots.size()):
                yield leaf.relation(), roots.apply(k).toString()


class Scratch:
    """The scratch tables of one operator call, as a context.

    ``table`` cuts a frame's lineage with a Parquet table, ``drop`` deletes tables that no later plan reads. What
    ``result`` is given may still read some; on leaving the context all others are deleted, and on an error all. A
    table that a result reads goes once no frame refers to it, which is looked up whenever a context is
    entered, by weak references to the JVM's relations; at the latest it goes when the JVM ends.
    """

    _held: list[tuple[str, str, object]] = []  # (application, path, weak reference)

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, {}, set()

    def __enter__(self):
        self.sweep(self.spark)
        return self

    def __exit__(self, kind, value, trace):
        for path, ref in self.paths.items():
            if kind is None and path in self.kept:
                Scratch._held.append((self.spark.sparkContext.applicationId, path, ref))
            else:
                _delete(self.spark, path)

    @classmethod
    def sweep(cls, spark: SparkSession) -> None:
        app = spark.sparkContext.applicationId
        cls._held = [x for x in cls._held if x[0] == app]
        if cls._held:
            gc.collect()
            time.sleep(0.2)  # what Python lets go of, the JVM lets go of a little later
            spark._jvm.System.gc()
            gone = [x for x in cls._held if x[2].refersTo(None)]
            cls._held = [x for x in cls._held if x not in gone]
            for _, path, _ in gone:
                _delete(spark, path)

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = scratch_path(self.spark, tag)
        self.paths[path] = None
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        self.paths[path] = self.spark._jvm.java.lang.ref.WeakReference(next(_relations(out))[0])
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if self.paths.pop(t._scratch, 0) != 0:
                _delete(self.spark, t._scratch)

    def collect_garbage(self) -> None:
        """Lets Spark delete the shuffle files of plans that no frame refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def result(self, df: DataFrame) -> DataFrame:
        read = {root.rpartition("/")[2] for _, root in _relations(df)}
        self.kept |= {path for path in self.paths if path.rpartition("/")[2] in read}
        return df


def tidy(f):
    """A function for a Python worker, after which what it has freed goes back to the system: workers live on
    and would hold the most memory that any task ever took."""

    def trim():
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            yield from f(batches)
            trim()

    else:

        @functools.wraps(f)
        def run(*tables):
            out = f(*tables)
            trim()
            return out

    if not inspect.isgeneratorfunction(f):
        run.__signature__ = inspect.signature(f)
    return run


def numbered(docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """docs with a column that tells all rows apart, the same at every reading: file and place of a Parquet
    scan's rows; any other frame is written first."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "Parquet" in plan.relation().fileFormat().getClass().getSimpleName():
        return docs.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))
    return scratch.table(docs.withColumn(name, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("place"))), "numbered")


def carried(src: DataFrame, carry: tuple[str, ...], own: tuple[str, ...]) -> None:
    """Refuses carried columns that would clash with an operator's own."""
    clash = sorted({x.lower() for x in carry} & {x.lower() for x in own})
    if clash:
        raise ValueError(f"rename the carried columns {', '.join(clash)}")


def n_words(text):
    """Number of words of a text column, 0 for null; no arrays of words are kept."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, GAP))).cast("long")


# ---------------------------------------------------------------- hashing


def _rng_table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _rng_table(11, 256)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE, _STEP = (int(x) for x in _rng_table(12, 2))
_M64 = (1 << 64) - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """_hash_words over runs of texts of about ``block`` bytes at a time, so that its buffers stay small."""
    if len(data) <= block:
        return _hash_words(data, offsets, lower)
    marks = np.unique(np.searchsorted(offsets, np.arange(0, len(data), block)))
    marks = np.unique(np.concatenate([[0], marks, [len(offsets) - 1]]))
    hashes, starts, n = [], [np.zeros(1, np.int64)], 0
    for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
        h, wo = _hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        hashes.append(h)
        starts.append(wo[1:] + n)
        n += len(h)
    return np.concatenate(hashes), np.concatenate(starts)


def _hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of UTF-8 texts, and the first word of each text.

    data: the bytes of the texts, one after the other; offsets: where each begins, and the end.
    Returns (hashes, word_offsets) with len(word_offsets) == len(offsets).
    """
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[cut] |= solid[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    last = solid
    last_mask = last.copy()
    last_mask[:-1] &= ~solid[1:]
    last_mask[cut - 1] |= solid[cut - 1]
    lens = np.flatnonzero(last_mask) + 1 - starts
    at = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    longest = int(lens.max())
    power = np.full(longest, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    h = np.add.reduceat((_LOWER if lower else _BYTE)[data[solid]] * power[place], at)
    return mix64(h + lens.astype(np.uint64)), np.searchsorted(starts, offsets)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, body = texts.buffers()
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on, as if all texts were one; len - width + 1 of them."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                term = part[done : done + n] * np.uint64(pow(_STEP, done, 1 << 64))
                out = term if out is None else out + term
                done += size
            if done == width:
                return mix64(out + np.uint64(width))
            part = part[:-size] + part[size:] * np.uint64(pow(_STEP, size, 1 << 64))
            size *= 2


def window_starts(word_offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first n places begin a window that ends in the same text."""
    ok = np.ones(n, bool)
    for k in range(1, width):
        at = word_offsets - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


# ---------------------------------------------------------------- packed blocks


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their differences."""
    d = np.diff(sorted_values, prepend=sorted_values.dtype.type(0))
    planes = d.view(np.uint8).reshape(len(d), d.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def pack_any(values: np.ndarray) -> bytes:
    """Integers in any order as compressed byte planes."""
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_any(body: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if body else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def unpack(body: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack_any(body, kind), dtype=kind)


def cut_points(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges of sorted 64-bit hashes begins, and the end."""
    if not bits:
        return np.array([0, len(sorted_hashes)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def chunked(scratch: Scratch, docs: DataFrame, tag: str, columns: list[str], text: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """Documents as rows (chunk long, body binary) of about ``chunk_bytes`` of text each, written once.

    The body is a compressed Arrow stream of ``columns`` and ``text``. A written chunk never changes, so
    that its number is a stable address in later joins.
    """
    schema = "chunk long, body binary"

    @tidy
    def write(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held, size = [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))

        def flush():
            nonlocal k, held, size
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as w:
                w.write_table(table.combine_chunks())
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) | k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])
            k, held, size = k + 1, [], 0
            return out

        for b in batches:
            _, off = text_buffers(b.column(b.schema.get_field_index(text)))
            at = 0
            while at < len(b):
                to = int(np.searchsorted(off, off[at] + chunk_bytes - size, "right")) - 1
                to = min(max(to, at + 1), len(b))
                held.append(b.slice(at, to - at))
                size += int(off[to] - off[at]) + 16 * (to - at)
                at = to
                if size >= chunk_bytes or at < len(b):
                    yield flush()
        if held:
            yield flush()

    return scratch.table(docs.select(*columns, text).mapInArrow(write, schema), tag)


def opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all().combine_chunks()


_ARROW = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string; executors have no session to parse it with."""
    return pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in ddl.split(",")])


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kind = arrow_schema(ddl)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, kind, strict=True)], schema=kind)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def bucket_bits(n_chunks: int, chunk_bytes: int = 4 << 20, bucket_bytes: int = 24 << 20) -> int:
    """Buckets grow with the data, so that each one stays of bounded size."""
    return max(2, int(np.ceil(np.log2(max(1, n_chunks * chunk_bytes / bucket_bytes)))))


# ---------------------------------------------------------------- graphs


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 1024) -> DataFrame:
    """(node, component) for all nodes of an edge table; component is the smallest node reachable.

    Labels start at the smallest neighbour. In a round each node offers the least label among its neighbours to
    itself and to the node its own label names, then takes its label's new label: labels are trees whose
    roots are hooked on to one another and whose depth is halved, so that the rounds grow with a power of
    log(nodes), in whatever order the nodes lie. It ends when a round changes nothing, and raises after ``rounds``.
    Minimums are combined before they are shuffled; the joins meet hot nodes as adaptive skew joins. Nothing is
    collected but one count a round; a round's tables go with the next.
    """
    both = scratch.table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    held = scratch.table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    for _ in range(rounds):
        labels = held.select("node", "component")
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        offered = F.array(F.struct("node", "near"), F.struct(F.col("component").alias("node"), "near"))
        least = labels.join(near, "node").select(F.inline(offered)).groupBy("node").agg(F.min("near").alias("near"))
        low = scratch.table(labels.join(least, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")), "labels")
        up = low.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = scratch.table(low.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        scratch.drop(held, low)
        held = step
        if step.where("was <> component").limit(1).count() == 0:
            scratch.drop(both)
            return step
    raise RuntimeError(f"labels still change after {rounds} rounds")


def merged(scratch: Scratch, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels of components with further edges (a, b): only the components that the edges join are looked at again."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"l{side}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    ends = scratch.table(ends, "joined")
    top = components(scratch, ends, "x", "y")
    new = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    over = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    out = scratch.table(labels.select("node", "component").union(new).join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
    scratch.drop(ends, top, labels)
    return out
