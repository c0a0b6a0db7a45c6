"""RecordIO files: records of named metas and a payload, with resynchronisation after damage.

Frame: magic ``RDIO``, a big-endian 32-bit word (bit 31: metas follow; the rest:
bytes of the body), a CRC-8 of that word, then the body: metas as 1-byte name
length, name, big-endian 32-bit size with bit 31 for "another meta follows", data;
then the payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"RDIO"
_MORE = 1 << 31
#: Fixed value: the Koopman CRC-8 polynomial.
_POLY = 0x4D


def crc8(data: bytes) -> int:
    """CRC-8 with the reflected Koopman polynomial, initial value and result inverted."""
    crc = 0xFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ 0xB2 if crc & 1 else crc >> 1
    return crc ^ 0xFF


def encode(payload: bytes, metas: dict[str, bytes] | None = None) -> bytes:
    body = b""
    items = list((metas or {}).items())
    for i, (name, data) in enumerate(items):
        raw = name.encode()
        if len(raw) > 255:
            raise ValueError("a meta's name has at most 255 bytes")
        body += bytes([len(raw)]) + raw + struct.pack(">I", len(data) | (_MORE if i + 1 < len(items) else 0)) + data
    body += payload
    if len(body) >= _MORE:
        raise ValueError("record too large")
    word = struct.pack(">I", len(body) | (_MORE if items else 0))
    return MAGIC + word + bytes([crc8(word)]) + body


def decode(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """Records of a file; where a frame is damaged, on from the next magic. An incomplete last record is left out."""
    at = 0
    while True:
        at = data.find(MAGIC, at)
        if at < 0 or at + 9 > len(data):
            return
        word = data[at + 4 : at + 8]
        size = struct.unpack(">I", word)[0]
        n = size & (_MORE - 1)
        if crc8(word) != data[at + 8] or at + 9 + n > len(data):
            at += 1
            continue
        parsed = _body(data[at + 9 : at + 9 + n], bool(size & _MORE))
        if parsed is None:
            at += 1
            continue
        yield parsed
        at += 9 + n


def _body(body: bytes, has_metas: bool) -> tuple[dict[str, bytes], bytes] | None:
    metas: dict[str, bytes] = {}
    at, more = 0, has_metas
    while more:
        if at + 1 > len(body):
            return None
        k = body[at]
        name, at = body[at + 1 : at + 1 + k], at + 1 + k
        if at + 4 > len(body):
            return None
        size = struct.unpack(">I", body[at : at + 4])[0]
        at += 4
        n, more = size & (_MORE - 1), bool(size & _MORE)
        if at + n > len(body):
            return None
        metas[name.decode("utf-8", "replace")] = body[at : at + n]
        at += n
    return metas, body[at:]


SCHEMA = "path string, metas map<string,binary>, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files under a path; one file is one task's work, files are read in parallel."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                rows = [(p, m, x) for m, x in decode(bytes(c))]
                yield pd.DataFrame(rows, columns=["path", "metas", "payload"])

    return files.mapInPandas(run, SCHEMA)


def write(rows: DataFrame, path: str, payload: str = "payload") -> None:
    """One file a task, its records framed; a line break stands between frames, which readers skip on their way to the next magic.

    Files are committed as any of Spark's are, so a task that is run again leaves no half of one.
    """
    frames(rows, payload).selectExpr("CAST(frame AS STRING) AS value").write.text(path)


def frames(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """(frame) of each row's payload, for round trips and sinks."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"frame": [encode(bytes(p)) for p in b[payload]]})

    return rows.select(payload).mapInPandas(run, "frame binary")
