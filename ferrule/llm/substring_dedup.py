"""Exact substring removal with fixed-block anchors.

Every window of ``width`` words holds, wholly, one of its text's non-overlapping blocks of
``(width + 1) // 2`` words. So the index keeps block hashes only, all rolling windows of the block's size
probe it, and a hash that starts in two places is a hit. Hits go back to their texts, where they are
extended to every ``width``-word window around a hit; the windows found twice are the maximal exact
repeats, as unions of overlapping windows.

Layout: texts are written once as compressed chunks. Hashes travel as sorted, difference-coded arrays,
one row for a (chunk, bucket) pair; a bucket is a range of hashes, so a passage that a third of all
texts hold is one entry for a chunk, never a hot key. Buckets grow in number with the input. Both
phases send about two bytes for a word of the corpus and eight for a repeated one. A first-phase hash
has 32 bits within its bucket: a clash there only adds a window to test. The second phase compares
64-bit hashes of the windows.

Defined cases: null or blank text has no words and keeps ``''``; texts shorter than ``width`` words are
kept whole; repeated rows repeat each other and lose all their windows; null ids are carried through;
other columns are ignored; an empty table gives an empty table. Kept words are joined by one space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as c

SENT = "bucket int, chunk long, probes binary, multi binary, blocks binary"
REPLY = "chunk long, bucket int, found binary"


def _words(body: bytes):
    table = c.opened(body)
    data, off = c.text_buffers(table.column("text"))
    h, wo = c.hash_words(data, off)
    return table, data, off, h, wo


def _rolling(h: np.ndarray, wo: np.ndarray, width: int):
    """Window hashes, which of them lie in one text, and which begin at a multiple of width in it."""
    roll = c.windows(h, width)
    ok = c.window_starts(wo, width, len(roll))
    return roll, ok


def _low32(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without the words of windows that occur elsewhere."""
    with c.Scratch(docs.sparkSession) as s:
        return s.result(_dedup(s, docs, width, id_col, text_col, chunk_bytes))


def _dedup(s: c.Scratch, docs: DataFrame, width: int, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    block = (width + 1) // 2
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    chunks = c.chunked(s, src, "op7-texts", ["doc_id"], chunk_bytes=chunk_bytes)
    bits = c.bucket_bits(chunks.count(), chunk_bytes)

    @c.tidy
    def probes(batches):
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                *_, h, wo = _words(body.as_py())
                roll, ok = _rolling(h, wo, block)
                seen, n = np.unique(roll[ok], return_counts=True)
                inside = np.arange(len(roll)) - np.repeat(wo[:-1], np.diff(wo))[: len(roll)]
                anchors = np.unique(roll[ok & (inside % block == 0)])
                multi = seen[n > 1]
                cuts = [c.cut_points(x, bits) for x in (seen, multi, anchors)]
                rows = [(k, chunk, *(c.pack(_low32(x[p[k] : p[k + 1]], bits)) for x, p in zip((seen, multi, anchors), cuts, strict=True))) for k in range(1 << bits) if cuts[0][k + 1] > cuts[0][k]]
                if rows:
                    yield c.batch_of(rows, SENT)

    @c.tidy
    def hits(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        sent = [c.unpack(x.as_py(), "u4") for x in table.column("probes")]
        value, n = np.unique(np.concatenate(sent), return_counts=True)
        twice = [value[n > 1]] + [c.unpack(x.as_py(), "u4") for x in table.column("multi")]
        anchors = np.unique(np.concatenate([c.unpack(x.as_py(), "u4") for x in table.column("blocks")]))
        hit = np.intersect1d(np.unique(np.concatenate(twice)), anchors, assume_unique=True)
        return _replies(table, k, sent, hit)

    def _replies(table, k, sent, hit):
        rows = []
        for chunk, own in zip(table.column("chunk").to_pylist(), sent, strict=True):
            got = own[c.is_in(own, hit)]
            if len(got):
                rows.append((chunk, k, c.pack(got)))
        return pa.Table.from_batches([c.batch_of(rows, REPLY)])

    @c.tidy
    def repeats(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        sent = [c.unpack(x.as_py(), "u8") for x in table.column("probes")]
        value, n = np.unique(np.concatenate(sent), return_counts=True)
        twice = np.unique(np.concatenate([value[n > 1]] + [c.unpack(x.as_py(), "u8") for x in table.column("multi")]))
        return _replies(table, k, sent, twice)

    @c.tidy
    def extended(batches):
        for b in batches:
            for chunk, body, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                *_, h, wo = _words(body.as_py())
                roll, ok = _rolling(h, wo, block)
                seeds = np.zeros(len(roll) + 1, np.int64)
                bucket = (roll >> np.uint64(64 - bits)).astype(np.int64)
                key = (bucket << 32) | _low32(roll, bits).astype(np.int64)
                hit = np.sort(np.concatenate([(np.int64(x["bucket"]) << 32) | c.unpack(x["found"], "u4").astype(np.int64) for x in found]))
                np.cumsum(ok & c.is_in(key, hit), out=seeds[1:])
                wide, ok = _rolling(h, wo, width)
                reach = np.arange(len(wide)) + width - block + 1
                ok &= seeds[reach] > seeds[np.arange(len(wide))]
                seen, n = np.unique(wide[ok], return_counts=True)
                multi = seen[n > 1]
                p, q = c.cut_points(seen, bits), c.cut_points(multi, bits)
                rows = [(k, chunk, c.pack(seen[p[k] : p[k + 1]]), c.pack(multi[q[k] : q[k + 1]]), b"") for k in range(1 << bits) if p[k + 1] > p[k]]
                if rows:
                    yield c.batch_of(rows, SENT)

    out = f"doc_id {id_type}, n_words long, n_removed long, kept_text string"

    @c.tidy
    def kept(batches):
        for b in batches:
            for body, found in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                table, data, off, h, wo = _words(body.as_py())
                gone = np.zeros(len(h) + 1, np.int64)
                if found:
                    wide, ok = _rolling(h, wo, width)
                    ok &= c.is_in(wide, np.sort(np.concatenate([c.unpack(x["found"], "u8") for x in found])))
                    at = np.flatnonzero(ok)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                keep = np.cumsum(gone)[:-1] == 0
                texts, n_removed = [], []
                whole = data.tobytes()
                for i in range(len(off) - 1):
                    words = whole[off[i] : off[i + 1]].split()
                    mine = keep[wo[i] : wo[i + 1]]
                    n_removed.append(len(mine) - int(mine.sum()))
                    texts.append(b" ".join(words if not n_removed[-1] else [words[j] for j in np.flatnonzero(mine)]).decode())
                yield pa.RecordBatch.from_arrays([_one(table.column("doc_id")), pa.array(np.diff(wo), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    def answered(replies: DataFrame) -> DataFrame:
        """Each chunk with what the buckets found for it; at most one entry a bucket."""
        return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "found")).alias("found"))

    first = answered(chunks.mapInArrow(probes, SENT).groupBy("bucket").applyInArrow(hits, REPLY))
    second = chunks.join(first, "chunk").select("chunk", "body", "found").mapInArrow(extended, SENT).groupBy("bucket").applyInArrow(repeats, REPLY)
    return chunks.join(answered(second), "chunk", "left").select("chunk", "body", "found").mapInArrow(kept, out)


def _one(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT rid, p, sha256(array_to_string(w[p:p + 34], ' ')) AS k
           FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS p FROM d WHERE len(w) >= 35)),
twice AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, q FROM (SELECT rid, unnest(generate_series(p, p + 34)) AS q FROM starts SEMI JOIN twice USING (k))),
lost AS (SELECT rid, list(q) AS qs, count(*) AS n FROM gone GROUP BY rid),
word AS (SELECT rid, unnest(w) AS w, unnest(generate_series(1, len(w))) AS q FROM d),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY q) AS t FROM word ANTI JOIN gone USING (rid, q) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)
"""
