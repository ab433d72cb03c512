"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

For each length of vectors, rotations for balanced binary codes are learned on a bounded sample, the ``sample_rows``
vectors with the least hash: unit length, centred, projected on their principal axes, then rotated in turns of
rounding to signs and solving the orthogonal Procrustes problem. Every vector is coded by all rotations and the
codes are cut into substrings, one table each. Vectors that agree in a table's substring meet there, and their
cosine is computed from the original vectors in double precision; nothing below the threshold is linked.

How long substrings are and how many tables there are follows from the sample alone, at every size in the same way:
pairs are made that lie just at the threshold, moved toward other sampled vectors and in random directions, and
joined by those that the sample itself holds near it; for each length the fewest tables are counted that find
the share ``recall`` of each kind, and of these the cheapest by the number of cosines and the bytes sent is
taken. Where codes say little, in low dimensions or where all vectors point one way, or where there are few
vectors, that is a substring of no bits: one table that all vectors share, which is exact.

A table's bucket is compared in blocks of ``block_rows`` vectors, a task for a pair of blocks, so that a hot
bucket is many tasks and none holds it whole. A pair counts in the first table alone in which it agrees. Links
are counted where they are found and leave a block as counts and a spanning forest, at most a row for a vector
of the block, never as pairs.

Equal vectors are one class that takes part once and counts with its size. Defined cases: a vector that is null, empty,
zero or holds a null or non-finite component links with nothing; vectors of different lengths are never linked;
ids may be of any ordered type; repeated and null ids are vectors of their own, a component of null ids alone has a
null id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as c

#: Rotations that may be learned for one length of vectors.
MOST_ROTATIONS = 8
#: Seconds of the cost model: to send a vector to a table, a component of it, to open a bucket, a product of two components.
SEND, SEND_PART, OPEN, PRODUCT = 1.5e-6, 2e-8, 1e-3, 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (x - mean) @ projection are a unit vector's code."""
    x = _unit(sample)
    mean = x.mean(axis=0)
    x = x - mean
    _, axes = np.linalg.eigh(x.T @ x)
    w = axes[:, ::-1][:, :bits]
    v = x @ w
    r, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((w.shape[1], w.shape[1])))
    for _ in range(rounds):
        a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (a @ b).T
    return mean, w @ r


@dataclass(frozen=True)
class Tables:
    """mean and projection of all rotations, side by side; bits of a substring and how many there are."""

    mean: np.ndarray
    turn: np.ndarray
    bits: int
    tables: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The substring of each table, (vectors, tables)."""
        return substrings((unit - self.mean) @ self.turn >= 0, self.bits)[:, : self.tables]


def substrings(signs: np.ndarray, bits: int) -> np.ndarray:
    """Codes of signs cut into numbers of ``bits`` bits; what is left over at the end is not used."""
    if not bits:
        return np.zeros((len(signs), 1), np.int32)
    n = signs.shape[1] // bits
    return (signs[:, : n * bits].reshape(len(signs), n, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)


def _at_threshold(x: np.ndarray, threshold: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs of unit vectors whose cosine is about the threshold."""
    rnd = np.random.Generator(np.random.PCG64(seed))
    a = x[rnd.integers(0, len(x), 2048)]

    def moved(to: np.ndarray) -> np.ndarray:
        side = to - (to * a).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(side, axis=1, keepdims=True)
        side = np.where(size > 1e-9, side / np.maximum(size, 1e-9), 0)
        return _unit(threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * side)

    kinds = [(a, moved(x[rnd.integers(0, len(x), len(a))])), (a, moved(rnd.standard_normal(a.shape)))]
    some = x[:2048]
    i, j = np.nonzero(np.triu(some @ some.T >= threshold, 1))
    if len(i) >= 200:
        pick = rnd.permutation(len(i))[:2048]
        kinds.append((some[i[pick]], some[j[pick]]))
    return kinds


def choose_tables(sample: np.ndarray, n: int, threshold: float, recall: float, seed: int = 7) -> Tables:
    """The cheapest tables for n vectors that find the share ``recall`` of pairs at the threshold, by the sample."""
    dim = sample.shape[1]
    best = Tables(np.zeros(dim), np.zeros((dim, 0)), 0, 1)
    cost = n / 2 * dim * PRODUCT
    most = min(30, int(np.log2(max(2, n))))
    if cost <= SEND + dim * SEND_PART or len(sample) < 64:
        return best
    x, width = _unit(sample), min(64, dim)
    learned = [learn_rotation(sample, width, seed=seed + k) for k in range(MOST_ROTATIONS)]
    mean, turn = learned[0][0], np.concatenate([t for _, t in learned], axis=1)
    signs = (x - mean) @ turn >= 0
    kinds = [((a - mean) @ turn >= 0, (b - mean) @ turn >= 0) for a, b in _at_threshold(x, threshold, seed)]
    for bits in range(1, most + 1):
        least = 0
        for a, b in kinds:
            found = np.maximum.accumulate(substrings(a, bits) == substrings(b, bits), axis=1).mean(axis=0)
            least = max(least, int(np.searchsorted(found, recall)) + 1 if found[-1] >= recall else 1 << 30)
        if least == 1 << 30:
            break
        keys = substrings(signs, bits)[:, :least]
        meet = np.mean([(np.unique(keys[:, t], return_counts=True)[1] ** 2).sum() for t in range(least)]) / len(keys) ** 2
        now = least * (SEND + dim * SEND_PART + n * meet / 2 * dim * PRODUCT + OPEN / max(1.0, n * meet))
        if now < cost:
            rotations = -(-least * bits // width)
            cost, best = now, Tables(mean, turn[:, : rotations * width], bits, least)
    return best


_MET = "node long, degree long, other long"


def _block_links(table: pa.Table, threshold: float, strip: int = 512) -> pa.Table:
    """Links within a bucket's pair of blocks (side 0 and 1; side 2 where a block meets itself) that agree in no earlier
    table: (node, degree, null) counts and (node, null, other) edges of a spanning forest."""
    turn = table.column("t")[0].as_py()
    side = table.column("side").to_numpy()
    node, m = table.column("node").to_numpy(), table.column("m").to_numpy()
    x = _unit(np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1))
    keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(table.num_rows, -1)[:, :turn]
    same = bool((side == 2).any())
    rows, cols = (np.flatnonzero(side == 2),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    near = np.zeros((len(rows), len(cols)), bool)
    for k in range(0, len(rows), strip):
        part = rows[k : k + strip]
        ok = x[part] @ x[cols].T >= threshold
        if same:
            ok &= part[:, None] != cols[None, :]
        if ok.any():
            for t in range(turn):
                ok &= keys[part, t][:, None] != keys[cols, t][None, :]
        near[k : k + strip] = ok
    degree = np.zeros(table.num_rows, np.int64)
    degree[rows] += near @ m[cols]
    if not same:
        degree[cols] += near.T @ m[rows]
    some = np.flatnonzero(degree)
    a, b = _forest(near, same)
    nodes = np.concatenate([node[some], node[rows[a]]])
    blank = np.concatenate([np.zeros(len(some), bool), np.ones(len(a), bool)])
    degrees = pa.array(np.concatenate([degree[some], np.zeros(len(a), np.int64)]), mask=blank)
    others = pa.array(np.concatenate([np.zeros(len(some), np.int64), node[cols[b]]]), mask=~blank)
    return pa.Table.from_arrays([pa.array(nodes), degrees, others], schema=c.arrow_schema(_MET))


def _forest(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) edges that join all that ``near`` joins; with ``same`` rows and columns are the same things."""
    n_rows, n_cols = near.shape
    left, a, b = near.any(axis=1), [], []
    new_cols = np.ones(n_cols, bool)
    for root in range(n_rows):
        if not left[root]:
            continue
        left[root] = False
        if same:
            new_cols[root] = False
        front = np.array([root])
        while len(front):
            reach = near[front][:, new_cols]
            found = np.flatnonzero(new_cols)[reach.any(axis=0)]
            if len(found):
                a.append(front[near[np.ix_(front, found)].argmax(axis=0)])
                b.append(found)
                new_cols[found] = False
            if same:
                left[found] = False
                front = found
            elif len(found):
                back = near[:, found] & left[:, None]
                front = np.flatnonzero(back.any(axis=1))
                if len(front):
                    a.append(front)
                    b.append(found[back[front].argmax(axis=1)])
                    left[front] = False
            else:
                front = found
    e = np.zeros(0, np.int64)
    return np.concatenate([e, *a]), np.concatenate([e, *b])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample_rows: int = 4096, block_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    with c.Scratch(vectors.sparkSession) as s:
        return s.result(_near(s, vectors, threshold, recall, sample_rows, block_rows, id_col, vec_col))


def _near(s: c.Scratch, vectors: DataFrame, threshold: float, recall: float, sample_rows: int, block_rows: int, id_col: str, vec_col: str) -> DataFrame:
    raw = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = raw.withColumn("key", F.when(fine, F.sha1(F.col("v").cast("string"))))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = s.table(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "op10-classes")
    models = {}
    for r in classes.groupBy("d").count().where(F.col("count") > block_rows).collect():  # lengths that more than a block of vectors have
        sample = classes.where(F.col("d") == r["d"]).select("v").orderBy(F.xxhash64("key"), "key").limit(sample_rows).toPandas()["v"]  # sample_rows * d numbers
        found = choose_tables(np.array(sample.tolist()), r["count"], threshold, recall)
        if found.bits:
            models[r["d"]] = found

    def coded(batches):
        for b in batches:
            for k in range(0, len(b), 4096):
                part = b.slice(k, 4096)
                size = part.column(3).to_numpy()
                for d in np.unique(size).tolist():
                    mine = part.filter(pa.array(size == d))
                    keys = np.zeros((len(mine), 1), np.int32)
                    if d in models:
                        keys = models[d].keys(_unit(np.asarray(mine.column(2).flatten()).reshape(-1, d)))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*mine.columns, lists], ["node", "m", "v", "d", "keys"])

    codes = s.table(classes.select("node", "m", "v", "d").mapInArrow(coded, "node long, m long, v array<double>, d int, keys array<int>"), "op10-codes")
    at = ["d", "t", "key"]
    spread = codes.select("*", F.posexplode("keys").alias("t", "key"))
    full = spread.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    hot = s.table(full.select(*at, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "op10-hot")
    dealt = spread.join(hot, at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int")
    # a vector's block meets every block of its bucket, itself too
    dealt = dealt.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    dealt = dealt.select(*at, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"), "node", "m", "v", "keys")
    met = dealt.groupBy(*at, "i", "j").applyInArrow(lambda table: _block_links(table, threshold), _MET)
    met = s.table(met.groupBy("node", "other").agg(F.sum("degree").alias("degree")), "op10-met")
    s.drop(codes, hot)
    labels = c.components(s, met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    degree = met.where("other IS NULL").select("node", "degree")
    parts = classes.select("key", "id", "m", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = parts.groupBy("component").agg(F.min("id").alias("component_id"))
    answer = parts.join(least, "component").join(degree, "node", "left")
    answer = s.table(answer.select("key", (F.coalesce("degree", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), "component_id"), "op10-answer")
    known = rows.where("key IS NOT NULL").join(answer, "key").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return known.union(rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
