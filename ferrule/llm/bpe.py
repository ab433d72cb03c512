"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to leaves of at most ``leaf_chars`` characters, which the vocabulary's library encodes. Two
neighbours are joined by encoding again a window around their border. A window begins and ends at sure
cuts, places where any text is split whatever stands around it: before a space that follows another
character and is followed by a letter. It holds a rim, up to the next sure cut, on either side; it grows, twice
as many cuts each time, until its tokens over both rims are those that the halves had, which shows that the
halves agree with the whole from there on, and the cuts prove that nothing beyond them changes. If a side
has too few cuts, the window takes all of it. Joining is associative, with the empty sequence as its unit.
Decoding concatenates bytes up the same tree.

The cuts are sure for patterns whose matches hold no white space but at their beginning or their end, and none but
line breaks at the end; a pattern that crosses such a place in a set of probes is refused.

Defined cases: null counts as empty text and has no tokens; repeated rows give equal rows; special tokens
are never made; other columns are ignored, or kept by ``bpe_encode`` and ``bpe_decode``; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import tidy

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 512
#: Characters of many kinds, of which probes of a pattern are made.
PROBES = ("a", "É", "語", "1", "'s", "!", "_", "\u0301", "\n", "\u3000", "\t")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def check_pattern(pattern: str) -> None:
    """Refuses a split pattern that has a match across a place that _sure takes for a cut."""
    split = regex.compile(pattern)
    for before in PROBES:
        for second in ("", *PROBES):
            for letter in ("a", "É", "語"):
                text = f"{letter}{before}{second} {letter}{before}"
                at = text.index(" ")
                if not text[at - 1].isspace() and any(m.start() < at < m.end() for m in split.finditer(text)):
                    raise ValueError(f"the split pattern has matches across {text!r}")


def _sure(text: str, i: int) -> bool:
    """Whether any text is cut before place i, whatever stands further off."""
    return text[i] == " " and not text[i - 1].isspace() and text[i + 1].isalpha()


def _cuts_left(text: str, start: int, end: int, n: int) -> list[int]:
    """The last n sure cuts in text[start:end], from the end on; fewer if there are no more."""
    out, at = [], end - 1
    while len(out) < n:
        at = text.rfind(" ", start + 1, at)
        if at < 0:
            break
        if _sure(text, at):
            out.append(at)
    return out


def _cuts_right(text: str, start: int, end: int, n: int) -> list[int]:
    """The first n sure cuts in text[start:end]."""
    out, at = [], start
    while len(out) < n:
        at = text.find(" ", at + 1, end - 1)
        if at < 0:
            break
        if _sure(text, at):
            out.append(at)
    return out


@lru_cache(maxsize=2)
def _token_sizes(enc: tiktoken.Encoding) -> list[int]:
    """Bytes of each token."""
    sizes = [0] * enc.n_vocab
    for body in enc.token_byte_values():
        sizes[enc.encode_single_token(body)] = len(body)
    return sizes


def encode(enc, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Token ids of a whole text."""
    return _encode(enc.encode_ordinary, _token_sizes(enc), text, 0, len(text), max(1, leaf_chars))


def _encode(enc, sizes: list[int], text: str, a: int, b: int, leaf: int) -> list[int]:
    """Token ids of text[a:b] as a text of its own."""
    if b - a <= leaf:
        return enc(text[a:b])
    m = (a + b) // 2
    return _join(enc, sizes, text, a, m, b, _encode(enc, sizes, text, a, m, leaf), _encode(enc, sizes, text, m, b, leaf))


def _over(sizes: list[int], ids: list[int], text: str, step: int) -> int:
    """How many tokens from the beginning (step 1) or the end (-1) of ids make up text, which ends at a token's border."""
    left, n = len(text.encode()), 0
    for t in ids[::step]:
        if left <= 0:
            break
        left, n = left - sizes[t], n + 1
    return n


def _join(enc, sizes: list[int], text: str, a: int, m: int, b: int, x: list[int], y: list[int]) -> list[int]:
    """Token ids of text[a:b], x and y being those of its parts up to and from m."""
    n = 2
    while True:
        left, right = _cuts_left(text, a, m, n), _cuts_right(text, m, b, n)
        all_left, all_right = len(left) < n, len(right) < n
        p, q = a if all_left else left[-1], b if all_right else right[-1]
        window = enc(text[p:q])
        # where the window begins in x and ends in y, and how many of its tokens lie over its rims
        k = 0 if all_left else len(x) - _over(sizes, x[-(m - p) * 4 :], text[p:m], -1)
        j = len(y) if all_right else _over(sizes, y[: (q - m) * 4], text[m:q], 1)
        u = 0 if all_left else _over(sizes, window, text[p : left[-2]], 1)
        v = 0 if all_right else _over(sizes, window, text[right[-2] : q], -1)
        if window[:u] == x[k : k + u] and window[len(window) - v :] == y[j - v : j]:
            return x[:k] + window + y[j:]
        n *= 2


def decode(enc, ids: list[int], leaf: int = 64) -> bytes:
    """Bytes of a token sequence, concatenated up the tree."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    return decode(enc, ids[: len(ids) // 2], leaf) + decode(enc, ids[len(ids) // 2 :], leaf)


def _digest_batch(texts: pa.Array, enc, words: list[str], leaf_chars: int):
    n, ids_sha, back_sha = [], [], []
    for t in texts:
        ids = encode(enc, t.as_py() or "", leaf_chars)
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(",".join([words[i] for i in ids]).encode()).hexdigest())
        back_sha.append(hashlib.sha256(decode(enc, ids)).hexdigest())
    return pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())


def bpe_digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    check_pattern(pattern)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @tidy
    def run(batches):
        enc = encoding(ranks, pattern)
        words = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), *_digest_batch(part.column(1), enc, words, leaf_chars)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _lists(rows: list[list[int]]) -> pa.Array:
    flat = np.fromiter((i for x in rows for i in x), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", check: bool = False, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The documents with their token ids as a column of array<int>; a column of that name is replaced.
    With check also decoded_sha256, the digest of what the ids decode to. A few documents are held at a time."""
    check_pattern(pattern)
    src = docs.drop(out_col, *(["decoded_sha256"] if check else []))
    names, at = src.columns, src.columns.index(text_col)
    extra = [T.StructField("decoded_sha256", T.StringType())] if check else []
    kind = T.StructType([*src.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType())), *extra])

    @tidy
    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                ids = [encode(enc, t.as_py() or "", leaf_chars) for t in part.column(at)]
                back = [pa.array([hashlib.sha256(decode(enc, x)).hexdigest() for x in ids], pa.string())] if check else []
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids), *back], [*names, out_col, *(["decoded_sha256"] if check else [])])

    return src.mapInArrow(run, kind)


def bpe_decode(docs: DataFrame, ranks: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """The documents with the bytes of their token ids as a binary column; null ids give empty bytes."""
    src = docs.drop(out_col)
    names, at = src.columns, src.columns.index(ids_col)

    @tidy
    def run(batches):
        enc = encoding(ranks, pattern)
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                back = pa.array([decode(enc, x.as_py() or []) for x in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, back], [*names, out_col])

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out_col, T.BinaryType())]))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(docs, public_tokenizers.path(DEFAULT_RANKS), public_tokenizers.PATTERN)
