r"""Line deduplication by pairwise alignment of overlapping documents.

A line is known by the hash of its words and by which of its equals within the document it is (first, second ...),
so that it occurs once in any document. A document with the very lines of an earlier one is a copy: it
is emptied, however short, and takes no further part, so that copies make no line frequent. Among the others
each line of at most ``rare_df`` holders pairs each later holder with every earlier one, and the pair
is aligned over all lines that both hold. The common lines are the points of a patience diff: the
rare ones are the anchors, their longest increasing run is kept, and the gaps between anchors are aligned in
turn by the frequent lines within them; where no line is rare, the frequent ones align alone. A frequent line
pairs its holder with its earliest holder only, if these are no pair already, and the two are aligned over
such lines: a star, linear in the lines, whatever the size of a group. A block is a run of aligned lines that
is without a gap in both documents of one pair; blocks of ``min_block_words`` words and more are deleted from the
later document. The first copy of a line in the corpus always stays.

"Later" is by id, null last, then by place in the written chunks. Only line postings are shuffled by line; a
hot line is summed before it is shuffled and joined as a skewed join. A document's line hashes travel once to each chunk
that holds partners of it; points gather by chunk of documents, bounded by the chunk's lines times ``rare_df``.

Defined cases: ids are whole numbers or null, others are refused; null text stays null and has no lines; lines
without words are never matched and stay; repeated rows are documents of their own, the later ones emptied; other
columns are ignored, carried ones must not bear the names of the result's own; an empty table gives an empty
table.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm import common as c

LINES = "chunk long, ids binary, counts binary, keys binary, words binary"
WHOLE = "whole long, rank long, chunk long, doc int"
POSTING = "key long, rank long, chunk long, doc int, pos int, words int"
SHIPPED = "chunk long, a_chunk long, a_doc int, docs binary, keys binary"


def line_table(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with words: document, place among the document's lines with words, key, words."""
    data, off = c.text_buffers(texts)
    breaks = np.flatnonzero(data == 10) + 1
    cuts = np.concatenate([off, breaks])
    cuts.sort(kind="stable")
    h, wo = c.hash_words(data, cuts)
    words = np.diff(wo)
    full = np.flatnonzero(words)
    if not len(full):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    place = np.arange(len(h)) - np.repeat(wo[:-1], words)
    power = np.full(int(words.max()), c._STEP, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    key = c.mix64(np.add.reduceat(h * power[place], wo[:-1][full]) + words[full].astype(np.uint64))
    doc = np.searchsorted(off, cuts[:-1][full], "right") - 1
    pos = np.arange(len(full)) - np.searchsorted(doc, doc)
    order = np.lexsort((pos, key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
    own = key.copy()
    own[order] = c.mix64(k + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc, pos, own.view(np.int64), words[full]


def increasing(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of points, given in order of the first, that increases in the second."""
    tails, at, back = [], [], []
    for i, (_, y) in enumerate(points):
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(points[i])
        i = back[i]
    return out[::-1]


def patience(points: list[tuple[int, int, int]], rare_df: int) -> list[tuple[int, int]]:
    """Aligned (place in the later, place in the earlier document); points are (place, place in the earlier, holders), by place."""
    rare = increasing([(b, a) for b, a, n in points if n <= rare_df])
    rest = [(b, a) for b, a, n in points if n > rare_df]
    if not rest:
        return rare
    out, k = [], 0
    for (b0, a0), (b1, a1) in zip([(-1, -1), *rare], [*rare, (1 << 60, 1 << 60)], strict=True):
        gap = []
        while k < len(rest) and rest[k][0] < b1:
            if a0 < rest[k][1] < a1:
                gap.append(rest[k])
            k += 1
        out += increasing(gap)
        out += [(b1, a1)] if b1 < 1 << 60 else []
    return out


def blocks(aligned: list[tuple[int, int]], size, min_words: int) -> set[int]:
    """Places of the later document in runs without a gap on either side that have ``min_words`` words and more."""
    lost, run = set(), []
    for p, q in [*aligned, (1 << 60, 1 << 60)]:
        if run and (p != run[-1][0] + 1 or q != run[-1][1] + 1):
            if sum(int(size[x]) for x, _ in run) >= min_words:
                lost.update(x for x, _ in run)
            run = []
        run.append((p, q))
    return lost


def _lines_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of LINES: the documents' ids, where the lines of each begin, and the lines' keys and words."""
    ids, counts, keys, words = (c.unpack_any(row[k], t) for k, t in (("ids", np.int64), ("counts", np.int32), ("keys", np.int64), ("words", np.int32)))
    return ids, np.concatenate([[0], np.cumsum(counts)]), keys, words


def _deleted(start: np.ndarray, keys: np.ndarray, words: np.ndarray, copies: list[int], points: pa.Table, partners: pa.Table, rare_df: int, min_words: int) -> dict[int, set[int]]:
    """For each document of a chunk that loses lines, the lines to delete."""
    gone = {d: set(range(int(start[d + 1] - start[d]))) for d in copies}
    cols = [points.column(k).to_numpy() for k in ("doc", "pos", "a_chunk", "a_doc", "a_pos", "holders")]
    order = np.lexsort((cols[1], cols[0]))
    doc, pos, ac, ad, apos, holders = (x[order] for x in cols)
    pairs: dict[int, list[int]] = {}
    for i, docs in enumerate(partners.column("docs")):
        for d in np.frombuffer(docs.as_py(), np.int32).tolist():
            pairs.setdefault(d, []).append(i)
    far = list(zip(partners.column("a_chunk").to_pylist(), partners.column("a_doc").to_pylist(), strict=True))
    bodies = partners.column("keys")
    cut = [*np.flatnonzero(np.diff(doc, prepend=-1)).tolist(), len(doc)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        d = int(doc[i])
        own, size = keys[start[d] : start[d + 1]], words[start[d] : start[d + 1]]
        held = dict(zip(pos[i:j].tolist(), holders[i:j].tolist(), strict=True))
        lost, known = set(), set()
        for k in pairs.get(d, ()):
            known.add(far[k])
            _, at, other = np.intersect1d(own, np.frombuffer(bodies[k].as_py(), np.int64), assume_unique=True, return_indices=True)
            points_of = [(x, y, held[x]) for x, y in sorted(zip(at.tolist(), other.tolist(), strict=True))]
            lost |= blocks(patience(points_of, rare_df), size, min_words)
        stars: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for p, x, y, q, n in zip(*(z[i:j].tolist() for z in (pos, ac, ad, apos, holders)), strict=True):
            if n > rare_df and (x, y) not in known:
                stars.setdefault((x, y), []).append((p, q, n))
        for left in stars.values():
            lost |= blocks(patience(left, rare_df), size, min_words)
        if lost:
            gone[d] = lost
    return gone


def line_dedup(docs: DataFrame, rare_df: int = 64, min_block_words: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_words_left) and the carried columns, of every row."""
    c.carried(docs, carry, ("doc_id", "text", "n_lines", "n_removed", "n_words_left"))
    src = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("text"))
    if not isinstance(src.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("ids of documents must be whole numbers")
    with c.Scratch(docs.sparkSession) as s:
        return s.result(_dedup(s, src, rare_df, min_block_words, carry, chunk_bytes))


def _dedup(s: c.Scratch, src: DataFrame, rare_df: int, min_block_words: int, carry: tuple[str, ...], chunk_bytes: int) -> DataFrame:
    chunks = c.chunked(s, src, "op2-texts", ["doc_id", *carry], chunk_bytes=chunk_bytes)

    @c.tidy
    def split(batches):
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                table = c.opened(body.as_py())
                doc, _, key, words = line_table(table.column("text"))
                ids = table.column("doc_id").cast(pa.int64()).fill_null((1 << 63) - 1).to_numpy()
                counts = np.bincount(doc, minlength=len(ids)).astype(np.int32)
                yield c.batch_of([(chunk, *map(c.pack_any, (ids, counts, key.astype(np.int64), words.astype(np.int32))))], LINES)

    lines = s.table(chunks.mapInArrow(split, LINES), "op2-lines")

    @c.tidy
    def wholes(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, start, keys, _ = _lines_of(row)
                some = np.flatnonzero(np.diff(start))
                if not len(some):
                    continue
                size = np.diff(start)[some]
                place = np.arange(len(keys)) - np.repeat(start[some], size)
                power = np.full(int(size.max()), c._STEP, np.uint64)
                power[0] = 1
                np.multiply.accumulate(power, out=power)
                whole = c.mix64(np.add.reduceat(keys.view(np.uint64) * power[place], start[some]) + size.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(ids[some]), pa.array(np.full(len(some), row["chunk"])), pa.array(some.astype(np.int32))], schema=c.arrow_schema(WHOLE))

    whole = s.table(lines.mapInArrow(wholes, WHOLE), "op2-wholes")
    least = whole.groupBy("whole").agg(F.min(F.struct("rank", "chunk", "doc")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("whole", "f")
    copies = whole.join(least, "whole").where("chunk <> f.chunk OR doc <> f.doc").groupBy("chunk").agg(F.collect_list("doc").alias("copies"))
    bare = lines
    lines = s.table(lines.join(copies, "chunk", "left"), "op2-copies")
    s.drop(bare, whole)

    @c.tidy
    def post(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, start, keys, words = _lines_of(row)
                doc = np.repeat(np.arange(len(ids)), np.diff(start))
                pos = np.arange(len(keys)) - start[doc]
                alone = np.ones(len(ids), bool)
                alone[row["copies"] or []] = False
                ok = alone[doc]
                cols = [keys, ids[doc], np.full(len(keys), row["chunk"]), doc.astype(np.int32), pos.astype(np.int32), words]
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in cols], schema=c.arrow_schema(POSTING))

    postings = s.table(lines.mapInArrow(post, POSTING), "op2-postings")
    first = postings.groupBy("key").agg(F.min(F.struct("rank", "chunk", "doc", "pos")).alias("f"), F.count(F.lit(1)).alias("holders")).where("holders > 1")
    first = s.table(first.select("key", F.col("f.rank").alias("a_rank"), F.col("f.chunk").alias("a_chunk"), F.col("f.doc").alias("a_doc"), F.col("f.pos").alias("a_pos"), "holders"), "op2-first")
    points = s.table(postings.join(first, "key").where("chunk <> a_chunk OR doc <> a_doc"), "op2-points")
    s.drop(postings, first)
    # all holders of a rare line but the first, at most rare_df - 1, with each earlier one
    rare = points.where(F.col("holders") <= rare_df).groupBy("key").agg(F.first(F.struct(F.col("a_rank").alias("rank"), F.col("a_chunk").alias("chunk"), F.col("a_doc").alias("doc"))).alias("f"), F.collect_list(F.struct("rank", "chunk", "doc")).alias("more"))
    later = rare.select(F.explode("more").alias("b"), F.concat(F.array("f"), "more").alias("all"))
    pairs = later.select("b", F.explode(F.filter("all", lambda x: x < F.col("b"))).alias("a")).select("b.chunk", "b.doc", F.col("a.chunk").alias("a_chunk"), F.col("a.doc").alias("a_doc")).distinct()
    partners = pairs.groupBy("a_chunk", "chunk", "a_doc").agg(F.collect_list("doc").alias("docs"))

    @c.tidy
    def ship(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist() if right.num_rows else []:
            _, start, keys, _ = _lines_of(row)
            for p in right.to_pylist():
                d = p["a_doc"]
                out.append((p["chunk"], p["a_chunk"], d, np.array(p["docs"], np.int32).tobytes(), keys[start[d] : start[d + 1]].tobytes()))
        return pa.Table.from_batches([c.batch_of(out, SHIPPED)])

    shipped = lines.groupBy("chunk").cogroup(partners.groupBy("a_chunk")).applyInArrow(ship, SHIPPED)
    near = points.select("chunk", "doc", "pos", "a_chunk", "a_doc", "a_pos", "holders").unionByName(shipped, allowMissingColumns=True)
    kinds = ", ".join(f"{x} {src.schema[x].dataType.simpleString()}" for x in ("doc_id", *carry))
    schema = f"{kinds}, text string, n_lines long, n_removed long, n_words_left long"

    @c.tidy
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        stars = right.filter(pc.is_null(right.column("keys"))).combine_chunks()
        partners = right.filter(pc.is_valid(right.column("keys"))).combine_chunks()
        out = []
        for row in left.to_pylist():
            table = c.opened(row["body"])
            _, start, keys, words = _lines_of(row)
            gone = _deleted(start, keys, words, row["copies"] or [], stars, partners, rare_df, min_block_words)
            n = table.num_rows
            lines = np.diff(start)
            left_words = np.bincount(np.repeat(np.arange(n), lines), weights=words, minlength=n).astype(np.int64)
            removed = np.zeros(n, np.int64)
            kept = table.column("text").to_pylist()
            for d, places in gone.items():
                k, keep = 0, []
                for line in kept[d].split("\n"):
                    if line.encode().split():
                        if k not in places:
                            keep.append(line)
                        k += 1
                    else:
                        keep.append(line)
                kept[d], removed[d] = "\n".join(keep), len(places)
                left_words[d] -= int(words[start[d] + np.array(sorted(places))].sum())
            cols = [table.column(x) for x in ("doc_id", *carry)]
            cols = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in cols]
            out.append(pa.Table.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(removed), pa.array(left_words)], names=["doc_id", *carry, "text", "n_lines", "n_removed", "n_words_left"]))
        return pa.concat_tables(out)

    whole_chunks = chunks.join(lines, "chunk")
    return whole_chunks.groupBy("chunk").cogroup(near.groupBy("chunk")).applyInArrow(cut, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", "n_words_left", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
