r"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is a DataFrame plan: of equal payloads the one with the largest id is a response, the others are revisit
records that refer to it and hold no block, only digest and length. A record ends with CRLF CRLF, so that
Spark's text writer, with CRLF as line end, lays the records down as they are, in gzip files of at most
``records_per_archive`` records, wherever Spark can write.

Reading splits each archive at the magic ``WARC/1.1 CRLF``. A payload may hold the magic too, so each piece is
only a candidate: a task reads its header and emits (offset, successor offset). Pointer jumping from the
file's start, doubling each hop, keeps what is reachable; all else was payload. A record whose payload
holds the magic is put together from its pieces.

Memory: a task streams pieces; one archive's candidates (two integers each) meet in one task, bounded by
``records_per_archive``. A missing successor ends a chain: the records before it are kept.

Defined cases: null html is an empty payload; null url gives no target header, control characters in a url are
percent-encoded; a null id gives no id header and reads back as null; rows that repeat the kept id and
payload are responses too; ``least_bytes`` is the least payload that is deduplicated; payloads read back are
bytes of any kind; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ferrule.llm.common import Scratch, arrow_schema, batch_of, scratch_path

MAGIC = "WARC/1.1\r\n"
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: each 5 hex digits are 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), *_B32)


def _urn(page_id: Column) -> Column:
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, records_per_archive: int = 20_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of pages (page_id, url, html), into gzip archives below path."""
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.encode("html", "utf-8"))})
    sums = src.select("page_id", "digest", "bytes")
    kept = sums.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "bytes", "keeper")
    again = sums.join(kept, ["digest", "bytes"]).where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", F.col("digest").alias("d"), "keeper").distinct()
    rows = src.join(again.withColumnRenamed("page_id", "p"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("d").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat_ws("\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("keeper")), F.lit("\r\nWARC-Refers-To-Page-ID: "), F.col("keeper").cast("string"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    )
    record = F.concat(F.lit(MAGIC), head, F.lit("\r\n\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n"))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


_PIECE = "file string, off long, succ long, page_id long, kind string, refers long, bytes long, digest string, whole boolean, body binary"
_FIELD = re.compile(r"^(WARC-Type|WARC-Page-ID|WARC-Refers-To-Page-ID|WARC-Payload-Length|WARC-Payload-Digest|Content-Length): *(.*?) *$", re.M)


def _long(x: str | None) -> int | None:
    return int(x) if x and re.fullmatch(r"-?[0-9]{1,18}", x) else None


def _candidates(batches):
    """Pieces of archives, each whole archive in order in one task, as candidate records; and each archive's end."""
    file, at, reach = None, 0, 0
    for b in batches:
        rows = []
        for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if name != file:
                if file is not None:
                    rows.append((file, at, None, None, "end", None, None, None, True, None))
                file, at, reach = name, 0, 0
                if not raw:
                    continue
            off, at = at, at + len(MAGIC) + len(raw)
            cut = raw.find(b"\r\n\r\n")
            field = dict(_FIELD.findall(raw[:cut].decode("utf-8", "replace").replace("\r\n", "\n"))) if cut >= 0 else {}
            size = _long(field.get("Content-Length"))
            good = size is not None and size >= 0 and "WARC-Type" in field
            succ = off + len(MAGIC) + cut + 4 + size + 4 if good else None
            whole = succ == at
            reach = max(reach, succ or 0) if not whole else reach
            digest, length = None, None
            if good and field["WARC-Type"] == "revisit":
                digest, length = field.get("WARC-Payload-Digest", "").removeprefix("sha1:"), _long(field.get("WARC-Payload-Length"))
            elif whole:
                payload = raw[cut + 4 : cut + 4 + size]
                digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            hold = not whole or off < reach
            rows.append((file, off, succ, _long(field.get("WARC-Page-ID")), field.get("WARC-Type"), _long(field.get("WARC-Refers-To-Page-ID")), length, digest, whole, raw if hold else None))
        if rows:
            yield batch_of(rows, _PIECE)
    if file is not None:
        yield batch_of([(file, at, None, None, "end", None, None, None, True, None)], _PIECE)


def _reachable(table: pa.Table) -> pa.Table:
    """Of one archive's candidates, those that a chain of successors from offset 0 meets."""
    off = table.column("off").to_numpy()
    order = np.argsort(off, kind="stable")
    off = off[order]
    succ = table.column("succ").fill_null(-1).to_numpy()[order]
    n = len(off)
    at = np.searchsorted(off, succ)
    at[at == n] = 0
    hop = np.append(np.where((succ >= 0) & (off[at] == succ), at, n), n)  # n: no such place
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and off[0] == 0
    while True:  # after k rounds all places within 2**k hops of the start are seen
        grown = seen.copy()
        grown[hop[seen]] = True
        hop = hop[hop]
        if (grown == seen).all() and (hop == n).all():
            break
        seen = grown
    keep = np.flatnonzero(seen[:n])
    name = table.column("file")[0].as_py() if n else ""
    return pa.Table.from_arrays([pa.array([name] * len(keep), pa.string()), pa.array(off[keep])], schema=arrow_schema("file string, off long"))


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _mended(batches):
    """Records that hold the magic, put together from their pieces."""
    magic = MAGIC.encode()
    for b in batches:
        rows = []
        for x in b.to_pylist():
            raw = magic.join(p["body"] for p in x["parts"])
            payload = raw[raw.find(b"\r\n\r\n") + 4 : x["succ"] - x["start"] - len(magic) - 4]
            rows.append((x["page_id"], len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), x["kind"], x["refers"]))
        yield batch_of(rows, _RECORD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record below path."""
    lines = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    with Scratch(spark) as s:
        found = s.table(lines.mapInArrow(_candidates, _PIECE), "op9-pieces")
        true = s.table(found.select("file", "off", "succ").groupBy("file").applyInArrow(_reachable, "file string, off long"), "op9-records")
        records = found.where("kind IS NOT NULL AND kind <> 'end'").join(true, ["file", "off"])
        done = records.where("whole OR kind = 'revisit'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
        # records that hold the magic do not overlap: a held piece belongs to the last of them that begins at or before it
        broken = records.where("NOT whole AND kind <> 'revisit'").select("file", "off", F.struct(F.col("off").alias("start"), "succ", "page_id", "kind", "refers").alias("r"))
        before = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
        pieces = found.where("body IS NOT NULL").select("file", "off", "body").join(broken, ["file", "off"], "left")
        owned = pieces.withColumn("r", F.last("r", ignorenulls=True).over(before)).where("off < r.succ")
        whole = owned.groupBy("file", "r").agg(F.sort_array(F.collect_list(F.struct("off", "body"))).alias("parts")).select("r.*", "parts")
        return s.result(done.union(whole.mapInArrow(_mended, _RECORD)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "op9-archives")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path)
