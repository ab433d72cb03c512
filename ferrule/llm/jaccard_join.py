"""N-gram Jaccard self-join with token-combination prefixes.

A text's tokens are the hashes of its distinct shingles. Equal sets are one class, so copies never meet as
pairs. Tokens are ordered: the rare class first, then the frequent one, by hash within each. Two sets of
similarity s share a token among the first n - ceil(s n) + 1 of each, and two tokens in prefixes one longer.
A rare token of the prefix is an index key by itself; frequent tokens are keys as pairs from the extended prefix,
or, in sets of ``long_set`` tokens and more, singly (sets within reach of that size give both, so that
every similar pair has a common scheme). Candidates are verified on whole sets.

The frequent class is read from a bitmap of 2**filter_bits bits, the one thing that is broadcast: its size is
fixed. A token whose bit is set by another one counts as frequent, which costs time, not results.

Posting lists of rare tokens hold at most ``rare_df`` documents, so their pairs are of bounded number. A frequent
list is never expanded at first: all its members are compared with one member, links become components, and
members already connected with each other need no comparison. After ``pivots`` such rounds the pairs left are
those across components; all of them are compared, so that no link is lost.

Tokens and postings travel packed, a row for a (chunk, bucket) pair. Class keys are 128 bits; a class is
addressed by 64 of them, and a clash of these stops the run with an error (another ``seed`` avoids it).

Defined cases: without words the set is empty, linked with nothing, and the document its own component; with
fewer words than a shingle the whole sequence is the only token; repeated ids are one node; rows with a null id
take part, and a component of such rows alone has a null id; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common as c

#: Bits of a token within its bucket when frequencies are counted; a clash can only make a token frequent.
COUNT_BITS = 26
NARROW = "n_shingles long, node long, other long"
#: kind 0: postings of rare tokens, 1: of frequent ones, 2: the tokens (keys) of a node (chunk) that has frequent ones,
#: 3: the signature (keys) of a node (chunk)
POSTED = "bucket int, chunk long, kind int, keys binary, nodes binary, sizes binary"
PAIR = "a long, ca long, b long, cb long"


def token_sets(texts, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = c.text_buffers(texts)
    h, wo = c.hash_words(data, off, lower=True)
    roll = c.windows(h, width)
    out = []
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
        if b - a >= width:
            t = np.sort(roll[a : b - width + 1])
            out.append(t[np.concatenate([[True], t[1:] != t[:-1]])])
        else:
            out.append(c.windows(h[a:b], b - a) if b > a else h[:0])
    return out


def _class_keys(sets: list[np.ndarray], seed: int, address_bits: int, clashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Address and check of each set's class, 128 bits in all. Classes at a clashed address take one that mixes in the check."""
    sizes = np.array([len(x) for x in sets])
    keys = [np.zeros(len(sets), np.uint64) for _ in range(2)]
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(sets)
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for k, salt in enumerate((2 * seed + 1, 2 * seed + 2)):
            keys[k][full] = c.mix64(np.add.reduceat(c.mix64(flat ^ c.mix64(np.array([salt], np.uint64))), at) + sizes[full].astype(np.uint64))
        if address_bits < 64:
            keys[0] >>= np.uint64(64 - address_bits)
        move = c.is_in(keys[0].view(np.int64), clashed) & (sizes > 0)
        keys[0][move] = c.mix64(keys[0][move] + np.uint64(3) * c.mix64(keys[1][move]))
    return keys[0].view(np.int64), keys[1].view(np.int64)


def signature(t: np.ndarray) -> bytes:
    """A set's size and a bitmap of two to four bits a token, set by the tokens' low bits."""
    m = 1 << max(6, (2 * len(t) - 1).bit_length())
    mark = np.zeros(m, bool)
    mark[(t & np.uint64(m - 1)).astype(np.int64)] = True
    return len(t).to_bytes(4, "little") + np.packbits(mark).tobytes()


def may_link(x: bytes, y: bytes, percent: int) -> bool:
    """False only if the sets' difference, at least that of their bitmaps, rules a link out."""
    n = int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little")
    a, b = np.frombuffer(x, np.uint8, offset=4), np.frombuffer(y, np.uint8, offset=4)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    d = int(np.bitwise_count(a ^ b).sum())
    return 100 * (n - d) >= percent * (n + d)


class Signatures:
    """The test of may_link for many pairs at once; signatures of a length stand in one matrix."""

    def __init__(self, nodes: np.ndarray, marks: list[bytes], percent: int):
        self.percent = percent
        order = np.argsort(nodes)
        self.nodes = nodes[order]
        marks = [marks[i] for i in order.tolist()]
        self.n = np.array([int.from_bytes(x[:4], "little") for x in marks], np.int64)
        self.width = np.array([len(x) - 4 for x in marks], np.int64)
        self.row = np.zeros(len(marks), np.int64)
        self.mats = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.mats[w] = np.frombuffer(b"".join(marks[i][4:] for i in at.tolist()), np.uint8).reshape(len(at), w)

    def keep(self, pairs: pa.Table) -> pa.Table:
        a, b = (np.searchsorted(self.nodes, pairs.column(k).to_numpy()) for k in ("a", "b"))
        ok = np.zeros(len(a), bool)
        kind = self.width[a] * (1 << 32) + self.width[b]
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k)
            wa, wb = k >> 32, k & 0xFFFFFFFF
            step = max(1, (16 << 20) // max(wa, wb))
            for part in np.split(at, range(step, len(at), step)):
                x, y = self.mats[wa][self.row[a[part]]], self.mats[wb][self.row[b[part]]]
                while x.shape[1] != y.shape[1]:
                    x, y = (x, y) if x.shape[1] > y.shape[1] else (y, x)
                    h = x.shape[1] // 2
                    x = x[:, :h] | x[:, h:]
                d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                n = self.n[a[part]] + self.n[b[part]]
                ok[part] = 100 * (n - d) >= self.percent * (n + d)
        return pairs.filter(pa.array(ok))


def _groups(s: c.Scratch, docs: DataFrame, carry: tuple[str, ...], width: int, percent: int, rare_df: int, long_set: int, pivots: int, filter_bits: int, seed: int, id_col: str, text_col: str, chunk_bytes: int, address_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chunks, the rows (chunk, at, doc_id, n_shingles, node) and the classes (node, rep, component)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    chunks = c.chunked(s, src, "op5-texts", ["doc_id", *carry], chunk_bytes=chunk_bytes)
    clashed = np.zeros(0, np.int64)
    least_tokens = 2 if percent > 50 else 1  # a set of one token has no near set but itself above a half

    def distinct_sets(body: bytes):
        """Sets of a chunk that may have near ones, once a class, and their nodes."""
        sets = token_sets(c.opened(body).column("text"), width)
        nodes = _class_keys(sets, seed, address_bits, clashed)[0]
        _, first = np.unique(nodes, return_index=True)
        keep = [i for i in first.tolist() if len(sets[i]) >= least_tokens]
        return [sets[i] for i in keep], nodes[keep]

    @c.tidy
    def narrow(batches):
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                table = c.opened(body.as_py())
                sets = token_sets(table.column("text"), width)
                node, other = _class_keys(sets, seed, address_bits, clashed)
                ids = table.column("doc_id")
                ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
                n = len(sets)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk), pa.int64()), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array([len(x) for x in sets], pa.int64()), pa.array(node), pa.array(other)], ["chunk", "at", "doc_id", "n_shingles", "node", "other"])

    for _ in range(8):
        sized = s.table(chunks.mapInArrow(narrow, f"chunk long, at int, doc_id {id_type}, {NARROW}"), "op5-sets")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "chunk", "at")).alias("rep")
        classes = s.table(sized.where("n_shingles > 0").groupBy("node").agg(first, (F.min("other") != F.max("other")).alias("clash")), "op5-classes")
        found = [r["node"] for r in classes.where("clash").select("node").collect()]  # about n squared over 2**65 of n classes
        if not found:
            break
        clashed = np.unique(np.concatenate([clashed, np.array(found, np.int64)]))
        s.drop(sized, classes)
    else:
        raise ValueError("class addresses clash again and again; run with another seed")

    packed = chunks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    bits = c.bucket_bits(3 * packed, 1)  # text is about three times its packed size
    slot = min(COUNT_BITS, max(3, filter_bits - bits))

    @c.tidy
    def counted(batches):
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sets, _ = distinct_sets(body.as_py())
                if not sets:
                    continue
                value, n = np.unique(np.concatenate(sets), return_counts=True)
                p = c.cut_points(value, bits)
                low = _low32(value, bits) >> np.uint32(32 - COUNT_BITS)
                yield c.batch_of([(k, chunk, c.pack(low[p[k] : p[k + 1]]), c.pack_any(np.minimum(n[p[k] : p[k + 1]], 65535).astype(np.uint16))) for k in range(1 << bits) if p[k + 1] > p[k]], "bucket int, chunk long, keys binary, n binary")

    @c.tidy
    def frequent(table: pa.Table) -> pa.Table:
        value = np.concatenate([c.unpack(x.as_py(), "u4") for x in table.column("keys")])
        n = np.concatenate([c.unpack_any(x.as_py(), "u2") for x in table.column("n")]).astype(np.int64)
        order = np.argsort(value, kind="stable")
        value, n = value[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        hot = value[at][np.add.reduceat(n, at) > rare_df]
        mark = np.zeros(1 << slot, bool)
        mark[hot >> np.uint32(COUNT_BITS - slot) if slot < COUNT_BITS else hot << np.uint32(slot - COUNT_BITS)] = True
        return pa.Table.from_batches([c.batch_of([(table.column("bucket")[0].as_py(), np.packbits(mark).tobytes())], "bucket int, bits binary")])

    counts = chunks.mapInArrow(counted, "bucket int, chunk long, keys binary, n binary")
    mark = np.zeros((1 << bits, (1 << slot) // 8), np.uint8)
    for row in counts.groupBy("bucket").applyInArrow(frequent, "bucket int, bits binary").collect():  # 2**filter_bits bits in all
        mark[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    hot_bits = spark.sparkContext.broadcast(mark.tobytes())

    @c.tidy
    def posted(batches):
        is_hot = np.unpackbits(np.frombuffer(hot_bits.value, np.uint8)).view(bool)
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sets, nodes = distinct_sets(body.as_py())
                found, rows = {0: ([], [], []), 1: ([], [], [])}, []

                def put(kind, keys, i, n, found=found, nodes=nodes):
                    if len(keys):
                        for out, x in zip(found[kind], (keys, np.full(len(keys), nodes[i]), np.full(len(keys), n, np.uint64)), strict=True):
                            out.append(x)

                for i, t in enumerate(sets):
                    n = len(t)
                    rows.append((-1, int(nodes[i]), 3, signature(t), None, None))
                    prefix = n - (-(-percent * n // 100)) + 1
                    hot = is_hot[(t >> np.uint64(64 - bits - slot)).astype(np.int64)]
                    rare = t[~hot][:prefix]
                    put(0, rare, i, n)
                    often = t[hot][: prefix + 1 - int((~hot).sum())] if prefix + 1 > int((~hot).sum()) else t[:0]
                    if not len(often):
                        continue
                    far = (int((~hot).sum()) * 1000 // n) << 40  # few rare tokens: near the middle of its group
                    if n < long_set * 100 / percent and len(often) > 1:
                        x, y = np.triu_indices(len(often), 1)
                        put(1, c.mix64(often[x] + np.uint64(3) * c.mix64(often[y])), i, far | n)
                    if n >= long_set * percent / 100:
                        put(1, c.mix64(often[: max(0, prefix - int((~hot).sum()))]), i, far | n)
                for kind, (keys, ids, sizes) in found.items():
                    if not keys:
                        continue
                    keys = np.concatenate(keys)
                    order = np.argsort(keys, kind="stable")
                    keys, ids, sizes = keys[order], np.concatenate(ids)[order], np.concatenate(sizes)[order]
                    p, low = c.cut_points(keys, bits), _low32(keys, bits)
                    rows += [(k, chunk, kind, c.pack(low[p[k] : p[k + 1]]), c.pack_any(ids[p[k] : p[k + 1]]), c.pack_any(sizes[p[k] : p[k + 1]])) for k in range(1 << bits) if p[k + 1] > p[k]]
                if rows:
                    yield c.batch_of(rows, POSTED)

    postings = s.table(chunks.mapInArrow(posted, POSTED), "op5-postings")

    def gathered(table: pa.Table):
        """Lists of two nodes or more: key, node, size, chunk, in order of key and node; a node once a list."""
        key = np.concatenate([c.unpack(x.as_py(), "u4").astype(np.uint64) + np.uint64(k << 32) for x, k in zip(table.column("keys"), table.column("bucket").to_pylist(), strict=True)])
        node = np.concatenate([c.unpack_any(x.as_py(), "i8") for x in table.column("nodes")])
        size = np.concatenate([c.unpack_any(x.as_py(), "u8") for x in table.column("sizes")])
        lens = [len(c.unpack(x.as_py(), "u4")) for x in table.column("keys")]
        chunk = np.repeat(table.column("chunk").to_numpy(), lens)
        order = np.argsort(key, kind="stable")
        key, node, size, chunk = key[order], node[order], size[order], chunk[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        multi = same[1:] | same[:-1]
        key, node, size, chunk = key[multi], node[multi], size[multi], chunk[multi]
        order = np.lexsort((node, key))
        key, node, size, chunk = key[order], node[order], size[order], chunk[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size, chunk = key[new], node[new], size[new], chunk[new]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        multi = same[1:] | same[:-1]
        return key[multi], node[multi], size[multi], chunk[multi]

    def near(x, y):
        x, y = (np.bitwise_and(v, np.uint64((1 << 40) - 1)).astype(np.int64) for v in (x, y))
        return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)

    def pair_table(found: list[tuple]) -> pa.Table:
        a, ca, b, cb = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 4))
        swap = a > b
        a, b, ca, cb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, cb, ca), np.where(swap, ca, cb)
        order = np.lexsort((b, a))
        a, b, ca, cb = a[order], b[order], ca[order], cb[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.Table.from_arrays([pa.array(x[new], pa.int64()) for x in (a, ca, b, cb)], schema=c.arrow_schema(PAIR))

    @c.tidy
    def rare_pairs(table: pa.Table) -> pa.Table:
        key, node, size, chunk = gathered(table)
        found, d = [], 1
        while True:
            at = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else []
            if not len(at):
                return pair_table(found)
            at = at[near(size[at], size[at + d])]
            found.append((node[at], chunk[at], node[at + d], chunk[at + d]))
            if sum(len(x[0]) for x in found) > 2_000_000:
                t = pair_table(found)
                found = [tuple(t.column(k).to_numpy() for k in range(4))]
            d += 1

    listed = "bucket int, keys binary, nodes binary, sizes binary, chunks binary, parts binary, firsts binary"

    def put_lists(bucket: int, key, node, size, chunk, part) -> pa.Table:
        if not len(key):
            return c.arrow_schema(listed).empty_table()
        return pa.Table.from_batches([c.batch_of([(bucket, c.pack(key), c.pack_any(node), c.pack_any(size), c.pack_any(chunk), c.pack_any(part), np.unique(node).tobytes())], listed)])

    @c.tidy
    def lists(table: pa.Table) -> pa.Table:
        key, node, size, chunk = gathered(table)
        order = np.lexsort((node, size >> np.uint64(40), key))  # a list's middle first
        key, node, size, chunk = key[order], node[order], size[order], chunk[order]
        return put_lists(table.column("part")[0].as_py(), key, node, size, chunk, node)

    def got_lists(table: pa.Table):
        row = table.to_pylist()[0]
        return c.unpack(row["keys"], "u8"), *(c.unpack_any(row[k], t) for k, t in (("nodes", "i8"), ("sizes", "u8"), ("chunks", "i8"), ("parts", "i8")))

    @c.tidy
    def still_mixed(left: pa.Table, right: pa.Table) -> pa.Table:
        """Left: a bucket's lists; right: (bucket, node, component) of its nodes. The lists that hold two components or more."""
        if not left.num_rows:
            return c.arrow_schema(listed).empty_table()
        key, node, size, chunk, part = got_lists(left)
        known = right.column("node").to_numpy()
        order = np.argsort(known)
        known, label = known[order], right.column("component").to_numpy()[order]
        if len(known):
            at = np.searchsorted(known, node)
            at[at == len(known)] = 0
            part = np.where(known[at] == node, label[at], node)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        mixed = np.repeat(np.maximum.reduceat(part, start) != np.minimum.reduceat(part, start), np.diff(np.append(start, len(key))))
        return put_lists(left.column("bucket")[0].as_py(), *(x[mixed] for x in (key, node, size, chunk, part)))

    def pivot_pairs(first: int, end: int):
        """Pairs of a list's members with those at ranks from first up to end; all pairs from rank first on for end 0."""

        @c.tidy
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            """Left: a bucket's mixed lists; right: (bucket, node, signature) of its nodes."""
            if not left.num_rows:
                return c.arrow_schema(PAIR).empty_table()
            possible = Signatures(right.column("node").to_numpy(), right.column("x").to_pylist(), percent).keep
            key, node, size, chunk, part = got_lists(left)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
            found = []

            def compare(i, j):
                ok = (part[i] != part[j]) & near(size[i], size[j])
                i, j = i[ok], j[ok]
                found.append((node[i], chunk[i], node[j], chunk[j]))
                if sum(len(x[0]) for x in found) > 1_000_000:
                    t = possible(pair_table(found))
                    found[:] = [tuple(t.column(k).to_numpy() for k in range(4))]

            if end:
                for pivot in range(first, end):
                    j = np.flatnonzero(rank > pivot)
                    compare(j - rank[j] + pivot, j)
                return possible(pair_table(found))
            # what is left: each pair of a list once, however many lists hold it, by rows of a bit table
            left_over = np.flatnonzero(rank >= first)
            if not len(left_over):
                return possible(pair_table(found))
            k = key[left_over]
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            own, one, at = np.unique(node[left_over], return_index=True, return_inverse=True)
            one = left_over[one]
            sign = np.add.reduceat(c.mix64(own.view(np.uint64))[at], start)
            stop = np.append(start[1:], len(k))
            _, some = np.unique(sign, return_index=True)
            groups = [np.sort(at[start[g] : stop[g]]) for g in some.tolist()]
            for low in range(0, len(own), 1024):
                meet = np.zeros((min(1024, len(own) - low), len(own)), bool)
                for g in groups:
                    lo, hi = np.searchsorted(g, (low, low + 1024))
                    if hi > lo:
                        meet[np.ix_(g[lo:hi] - low, g)] = True
                x, y = np.nonzero(meet)
                x += low
                compare(one[x[x < y]], one[y[x < y]])
            return possible(pair_table(found))

        return run

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = int(c.is_in(y, x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    def judged(pairs: DataFrame, held: DataFrame, verdict) -> DataFrame:
        """Pairs that verdict accepts, given what is held for either node."""
        one = pairs.join(held.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a")
        names, schema = pairs.columns, pairs.schema
        two = one.join(held.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b").select("xa", "xb", *names)

        def run(batches):
            for batch in batches:
                ok = [verdict(x.as_py(), y.as_py()) for x, y in zip(batch.column(0), batch.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([col.filter(pa.array(ok, pa.bool_())) for col in batch.columns[2:]], names)

        return two.mapInArrow(run, schema)

    def verified(pairs: DataFrame, hint: str = "") -> DataFrame:
        """Links among candidates (a table): whole sets are fetched from the chunks, once a node, and compared."""
        needed = pairs.select(F.col("a").alias("node"), F.col("ca").alias("chunk")).union(pairs.select("b", "cb")).groupBy("node").agg(F.min("chunk").alias("chunk"))
        needed = s.table(needed.groupBy("chunk").agg(F.collect_list("node").alias("nodes")), "op5-needed")  # at most a chunk's documents

        @c.tidy
        def wanted(batches):
            for b in batches:
                for body, nodes in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    sets, own = distinct_sets(body.as_py())
                    at = dict(zip(own.tolist(), range(len(own)), strict=True))
                    yield c.batch_of([(x, c.pack(sets[at[x]])) for x in nodes], "node long, x binary")

        held = s.table(chunks.join(needed.hint(hint) if hint else needed, "chunk").select("body", "nodes").mapInArrow(wanted, "node long, x binary"), "op5-tokens")
        links = s.table(judged(pairs.select("a", "b"), held, lambda x, y: similar(c.unpack(x, "u8"), c.unpack(y, "u8"))), "op5-links")
        s.drop(needed, held, pairs)
        s.collect_garbage()
        return links

    once = lambda pairs: pairs.groupBy("a", "b").agg(F.min("ca").alias("ca"), F.min("cb").alias("cb"))
    # written, so that a join with it can split a hot node
    marks = s.table(postings.where("kind = 3").groupBy(F.col("chunk").alias("node")).agg(F.first("keys").alias("x")), "op5-held")
    # frequent lists are few; fewer, wider parts of the hash range repeat a pair less often
    frequent_rows = postings.where("kind = 1")
    size = frequent_rows.agg(F.coalesce(F.sum(F.octet_length("keys") + F.octet_length("nodes") + F.octet_length("sizes")), F.lit(0)).alias("n")).first()["n"]
    wide = min(bits, int(np.ceil(np.log2(max(1, size / (8 << 20))))))
    often = s.table(frequent_rows.withColumn("part", F.shiftright("bucket", bits - wide)).groupBy("part").applyInArrow(lists, listed), "op5-lists")

    def likely(lists: DataFrame, first: int, end: int) -> DataFrame:
        members = lists.select("bucket", "firsts").mapInArrow(_nodes_of, "bucket int, node long")
        signed = members.join(marks, "node").select("bucket", "node", "x")
        return lists.groupBy("bucket").cogroup(signed.groupBy("bucket")).applyInArrow(pivot_pairs(first, end), PAIR)

    # signatures rule most candidates out; those of rare tokens and of the first pivots are verified in one go
    rare = judged(once(postings.where("kind = 0").groupBy("bucket").applyInArrow(rare_pairs, PAIR)), marks, lambda x, y: may_link(x, y, percent))
    pairs = s.table(once(rare.unionByName(likely(often, 0, 1))), "op5-pairs")
    s.drop(postings)
    links = verified(pairs, "merge")
    labels = c.components(s, links)
    s.drop(links)
    for first, end in ((1, pivots), (pivots, 0)):
        # lists of one component need no comparison, now and later
        members = often.select("bucket", "firsts").mapInArrow(_nodes_of, "bucket int, node long")
        known = members.join(labels, "node").select("bucket", "node", "component")
        rest = s.table(often.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(still_mixed, listed), "op5-lists")
        s.drop(often)
        often = rest
        pairs = s.table(once(likely(often, first, end)), "op5-pairs")
        if pairs.limit(1).count():
            fresh = verified(pairs)
            if fresh.limit(1).count():
                labels = c.merged(s, labels, fresh)
            s.drop(fresh)
    s.drop(often, marks)
    parts = s.table(classes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "op5-parts")
    s.drop(classes, labels)
    return chunks, sized, parts


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, rare_df: int = 12, long_set: int = 200, pivots: int = 3, filter_bits: int = 23, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, address_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; sets link at a similarity of percent / 100 or more."""
    with c.Scratch(docs.sparkSession) as s:
        _, sized, parts = _groups(s, docs, (), width, percent, rare_df, long_set, pivots, filter_bits, seed, id_col, text_col, chunk_bytes, address_bits)
        # the least id of each component, by class and then by row
        least = parts.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
        answer = s.table(parts.join(least, "component").select("node", "component_id"), "op5-answer")
        full = sized.where("n_shingles > 0").join(answer, "node").select("doc_id", "n_shingles", "component_id")
        return s.result(full.union(sized.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80, carry: tuple[str, ...] = (), rare_df: int = 12, long_set: int = 200, pivots: int = 3, filter_bits: int = 23, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, address_bits: int = 64) -> DataFrame:
    """(doc_id, text) and the carried columns of one row of each component, that with the least id, null last, and
    of every row without words. The rows come from the chunks themselves; texts are not written again."""
    c.carried(docs, carry, ("doc_id", "text"))
    with c.Scratch(docs.sparkSession) as s:
        chunks, sized, parts = _groups(s, docs, carry, width, percent, rare_df, long_set, pivots, filter_bits, seed, id_col, text_col, chunk_bytes, address_bits)
        first = parts.groupBy("component").agg(F.min("rep").alias("f")).select("f.chunk", "f.at")
        stay = s.table(first.union(sized.where("n_shingles = 0").select("chunk", "at")).groupBy("chunk").agg(F.collect_list("at").alias("stay")), "op5-stay")  # at most a chunk's documents
        src = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("text"))
        names, schema = src.columns, src.schema

        @c.tidy
        def picked(batches):
            for b in batches:
                for body, at in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    yield from c.opened(body.as_py()).take(pa.array(sorted(at))).select(names).to_batches(max_chunksize=512)

        return s.result(chunks.join(stay.hint("merge"), "chunk").select("body", "stay").mapInArrow(picked, schema))


def _nodes_of(batches):
    for b in batches:
        for bucket, nodes in zip(b.column("bucket").to_pylist(), b.column("firsts"), strict=True):
            own = np.frombuffer(nodes.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket), pa.int32()), pa.array(own)], ["bucket", "node"])


def _low32(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE unnest_s END AS s FROM (
        SELECT doc_id, w, array_to_string(w[p:p + 3], ' ') AS unnest_s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS p FROM d WHERE len(w) > 0)))),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.a = e.a WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
