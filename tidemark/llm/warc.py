"""WARC archives: written from pages with revisit records, read back with boundary-chain verification.

Writing uses Spark's own text writer with the record separator as line separator, so archives go through Spark's
commit protocol to any file system it knows, gzip-compressed, in files of bounded size. Of records with equal payloads of at least 100 bytes
the one with the smallest page id is a response, the others are revisits that refer to it.

Reading: a task looks for the magic in its archive and emits, for each occurrence that has a header, a candidate
(offset -> offset of its successor). Payloads may hold the magic too, so a candidate counts only if the chain of
successors from the file's start reaches it: pointer jumping doubles the steps each round. A chain that ends before
its file does raises an error: the archive is damaged.

Null html is an empty payload. Null urls have no target header. Rows with equal ids and equal payloads are of the
same type. A null page id never counts as the smallest unless all ids of the payload are null. Urls and payloads have any
length up to Spark's 2 GB of a value. An empty table gives an archive folder without records; other columns, whatever
their names, are not written.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import Scratch, bounded_batches

MAGIC = b"WARC/1.0\r\n"
_LENGTH = b"\r\nContent-Length: "
LEAST = 100
#: Bytes of an archive before compression, at most; only a single record may be longer. Records are written by size,
#: those of up to so many bytes into common files, so that a number of records bounds the bytes of a file.
ARCHIVE = 64 << 20
SIZES = (8 << 10, 64 << 10, 1 << 20, 16 << 20)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` below ``path``."""
    scratch = Scratch(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload")})
    # a bound of the record's length: the header's own lines are short, and a line end in a url takes three bytes
    length = F.col("bytes") + F.coalesce(F.octet_length("url"), F.lit(0)) * 3 + 1024
    size = F.lit(len(SIZES))
    for i in reversed(range(len(SIZES))):
        size = F.when(length <= SIZES[i], i).otherwise(size)
    rows = rows.withColumn("size", size)
    seen = Observation()
    watched = rows.observe(seen, *[F.count_if(F.col("size") == i).alias(f"n{i}") for i in range(len(SIZES) + 1)])
    # only ids and digests are compared; a payload that thousands share is one row per task and then one in all
    small = scratch.keep(watched.where(F.col("bytes") >= LEAST).select("id", "digest"), "digests")
    firsts = scratch.keep(small.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "firsts")
    again = scratch.keep(small.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).distinct(), "revisits")
    again = again.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), "first")
    joined = rows.join(again, F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left")
    revisit = F.col("first").isNotNull()
    nl = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), nl, nl)
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), nl,
        F.lit("WARC-Record-ID: "), name("id"), nl,
        F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), clean, nl), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), nl,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"), nl, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), nl, nl, block,
    )
    used = [i for i in range(len(SIZES) + 1) if seen.get[f"n{i}"]] or [0]
    for i in used:
        most = ARCHIVE // SIZES[i] if i < len(SIZES) else 1
        out = joined.where(F.col("size") == i).select(record.alias("value"))
        mode = "error" if i == used[0] else "append"
        out.write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _fields(data: bytes, start: int, end: int) -> dict[bytes, bytes]:
    return dict(x.split(b": ", 1) for x in data[start:end].split(b"\r\n") if b": " in x)


def _page(name: bytes | None) -> int | None:
    text = (name or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(text) if text.lstrip(b"-").isdigit() else None


def candidates(data: bytes) -> Iterator[dict]:
    """Every occurrence of the magic that has a header, with its successor's offset (none if it can't be a record)."""
    at, end, line = data.find(MAGIC), -1, -1
    while at >= 0:
        following = data.find(MAGIC, at + 1)
        if at > end:  # a header has any length; all occurrences before its end share it, so it is sought once
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                return
            line = data.rfind(_LENGTH, at, end)
        # a line that is the magic itself is no field, so a header does not hold one
        nested = 0 <= following < end and data[following - 2 : following] == b"\r\n"
        if not nested and line > at:
            block = end + 4
            size = data[line + len(_LENGTH) : data.find(b"\r\n", line + 2, end + 2)]
            after = block + int(size) + 4 if size.isdigit() and len(size) < 16 else None
            if after is not None and after <= len(data) and data[after - 4 : after] == b"\r\n\r\n":
                fields = _fields(data, at + len(MAGIC), end)
                body = data.find(b"\r\n\r\n", block, after - 4)
                payload = data[body + 4 : after - 4] if body >= 0 else data[block : after - 4]
                http = _fields(data, block, body) if body >= 0 else {}
                kind = fields.get(b"WARC-Type", b"").decode("ascii", "replace")
                digest = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha256:").decode("ascii", "replace")
                length = http.get(b"Content-Length", b"")
                whole = kind != "revisit"
                yield {
                    "offset": at, "after": after, "page_id": _page(fields.get(b"WARC-Record-ID")), "record_type": kind,
                    "payload_bytes": len(payload) if whole or not length.isdigit() else int(length),
                    "payload_digest": hashlib.sha256(payload).hexdigest() if whole else digest,
                    "intact": not whole or digest in ("", hashlib.sha256(payload).hexdigest()),
                    "refers_to": _page(fields.get(b"WARC-Refers-To")), "url": fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace") or None,
                }
        at = following


def reachable(offset: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """Which candidates (rising offsets) a chain of successors from offset 0 reaches; it must lead to the file's end."""
    n = len(offset)
    jump = np.full(n + 1, n)
    at = np.searchsorted(offset, after)
    hit = (at < n) & (offset[np.minimum(at, n - 1)] == after)
    jump[:n][hit] = at[hit]
    good = np.zeros(n + 1, bool)
    if n and offset[0] == 0:
        good[0] = True
    before = 0
    while good[:n].sum() != before:
        before = good[:n].sum()
        good[jump[good]] = True
        jump = jump[jump]
    good = good[:n]
    if end and (not good.any() or after[good].max() != end):
        raise ValueError("the records of an archive do not lead to its end")
    return good


_COLUMNS = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, url string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, url, archive, offset) of all records below ``path``."""
    bounded_batches(spark)  # an archive is one row
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    names = ["archive", "end", "offset", "after", "page_id", "record_type", "payload_bytes", "payload_digest", "intact", "refers_to", "url"]
    schema = "archive string, `end` bigint, offset bigint, after bigint, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, intact boolean, refers_to bigint, url string"
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = gzip.decompress(b.column(1)[i].as_py())
                rows = [{"archive": b.column(0)[i].as_py(), "end": len(data), **x} for x in candidates(data)]
                if data and not rows:
                    raise ValueError("no record in an archive")
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows[at : at + 1000]], k) for n, k in zip(names, kinds)], names)

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        t = t.filter(pa.array(reachable(np.asarray(t.column("offset")), np.asarray(t.column("after")), t.column("end")[0].as_py())))
        if not all(t.column("intact").to_pylist()):
            raise ValueError("a payload does not have its record's digest")
        return t.select(["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "archive", "offset"])

    return files.mapInArrow(scan, schema).groupBy("archive").applyInArrow(chain, _COLUMNS + ", archive string, offset bigint")
