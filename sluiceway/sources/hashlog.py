"""An append-only log of checked records.

A record is the mark ``LOG1``, eight hex digits of the payload's length, eight of its check
value, a newline, the payload and a newline.  The check value is the head of the MD5 of
payload and position, and reading verifies it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

MARK, HEAD = b"LOG1", 21


class BrokenLog(ValueError):
    """A record whose header or check value is wrong."""


def _check(payload: bytes, at: int) -> bytes:
    return hashlib.md5(payload + str(at).encode()).hexdigest()[:8].encode()


def record(payload: bytes, at: int) -> bytes:
    """The bytes of a record that stands at a position."""
    if len(payload) >= 1 << 32:
        raise ValueError("a payload is below 4 GB")
    return MARK + b"%08x" % len(payload) + _check(payload, at) + b"\n" + payload + b"\n"


def append(path: str, payload: bytes) -> int:
    """Add a record to a local file; its position in the file."""
    with open(path, "ab") as f:
        at = f.tell()
        f.write(record(payload, at))
    return at


def records(path: str) -> Iterator[bytes]:
    """All payloads, in order."""
    with open(path, "rb") as f:
        while head := f.read(HEAD):
            at = f.tell() - len(head)
            if len(head) != HEAD or head[:4] != MARK or head[20:] != b"\n":
                raise BrokenLog(f"no header at {at}")
            payload = f.read(int(head[4:12], 16))
            if f.read(1) != b"\n" or _check(payload, at) != head[12:20]:
                raise BrokenLog(f"the record at {at} is damaged")
            yield payload


def scan(spark, paths):
    """``_file, at, payload`` of the records of all logs, checked; logs are read in parallel, each by one task."""
    from pyspark.sql import functions as F

    return payloads(spark.read.format("binaryFile").load(paths).select(F.col("path").alias("_file"), "content"))


def payloads(logs):
    """``_file, at, payload`` of the records in ``_file, content``."""
    import pyarrow as pa

    from ..shipping import ship

    ship(logs.sparkSession)

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(_parsed(raw))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([a for a, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], ["_file", "at", "payload"])

    return logs.select("_file", "content").mapInArrow(run, "_file string, at long, payload binary")


def _parsed(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Position and payload of each record of a log's bytes."""
    at = 0
    while at < len(raw):
        head = raw[at : at + HEAD]
        if len(head) != HEAD or head[:4] != MARK or head[20:] != b"\n":
            raise BrokenLog(f"no header at {at}")
        end = at + HEAD + int(head[4:12], 16)
        payload = raw[at + HEAD : end]
        if raw[end : end + 1] != b"\n" or _check(payload, at) != head[12:20]:
            raise BrokenLog(f"the record at {at} is damaged")
        yield at, payload
        at = end + 1


def fold(path: str, start, step):
    for payload in records(path):
        start = step(start, payload)
    return start
