"""Codecs: mcpack trees, compression, ML matrix files, table keys, Redis commands and replies."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field types of the format.
OBJECT, ARRAY, ISOARRAY, OBJECTISOARRAY, STRING, BINARY = 0x10, 0x20, 0x30, 0x40, 0x50, 0x60
INT64, DOUBLE, BOOL, DATE, NULL = 0x18, 0x48, 0x31, 0x58, 0x61
#: Of the fixed types the low half byte is the width; the form in which each is stored.
FORMS = {0x11: "b", 0x12: "h", 0x14: "i", INT64: "q", 0x21: "B", 0x22: "H", 0x24: "I", 0x28: "Q", BOOL: "?", 0x44: "f", DOUBLE: "d", DATE: "q"}
_TYPED = {np.int8: 0x11, np.int16: 0x12, np.int32: 0x14, np.int64: INT64, np.uint8: 0x21, np.uint16: 0x22, np.uint32: 0x24, np.uint64: 0x28, np.float32: 0x44, np.float64: DOUBLE, int: INT64, float: DOUBLE}
_SHORT, _WIDTH, _LIVE = 0x80, 0x0F, 0x70
DEEPEST = 128


def _head(kind: int, name: bytes, size: int) -> bytes:
    """Type, name size, value size (one byte if short, else four) and the name with its end mark."""
    n = name + b"\0" if name else b""
    if kind in (STRING, BINARY) and size <= 255:
        return struct.pack("<BBB", kind | _SHORT, len(n), size) + n
    return struct.pack("<BBI", kind, len(n), size) + n


def pack(value: Any, name: str = "", depth: int = 0) -> bytes:
    """A JSON-like value as a self-describing field; NumPy scalars keep their width. Lists of objects with one set of keys go column by column."""
    if depth > DEEPEST:
        raise ValueError("nested too deeply")
    key = name.encode()
    fixed = lambda kind, raw: struct.pack("<BB", kind, len(key) + 1 if key else 0) + (key + b"\0" if key else b"") + raw
    if value is None:
        return fixed(NULL, b"\0")
    if isinstance(value, bool):
        return fixed(BOOL, bytes([value]))
    if type(value) in _TYPED:
        kind = _TYPED[type(value)]
        if kind == INT64 and value >= 1 << 63:
            kind = 0x28
        return fixed(kind, struct.pack("<" + FORMS[kind], value))
    if isinstance(value, str):
        raw = value.encode() + b"\0"
        return _head(STRING, key, len(raw)) + raw
    if isinstance(value, (bytes, bytearray)):
        return _head(BINARY, key, len(value)) + bytes(value)
    if isinstance(value, dict):
        body = struct.pack("<I", len(value)) + b"".join(pack(v, k, depth + 1) for k, v in value.items())
        return _head(OBJECT, key, len(body)) + body
    items = list(value)
    if items and all(isinstance(x, dict) and x and list(x) == list(items[0]) for x in items):
        columns = {k: [x[k] for x in items] for k in items[0]}
        body = struct.pack("<I", len(columns)) + b"".join(pack(v, k, depth + 1) for k, v in columns.items())
        return _head(OBJECTISOARRAY, key, len(body)) + body
    if items and type(items[0]) in _TYPED and all(type(x) is type(items[0]) for x in items):
        kind = _TYPED[type(items[0])]
        body = bytes([kind]) + struct.pack(f"<{len(items)}{FORMS[kind]}", *items)
        return _head(ISOARRAY, key, len(body)) + body
    body = struct.pack("<I", len(items)) + b"".join(pack(v, "", depth + 1) for v in items)
    return _head(ARRAY, key, len(body)) + body


def unpack(data: bytes) -> Any:
    return _field(data, 0, 0)[1]


def _field(data: bytes, at: int, depth: int) -> tuple[str, Any, int]:
    if depth > DEEPEST:
        raise ValueError("nested too deeply")
    kind, n = data[at], data[at + 1]
    at += 2
    width = kind & _WIDTH
    short, kind_ = bool(kind & _SHORT) and not width, kind if width else kind & ~_SHORT
    size = None
    if not width:
        size = data[at] if short else struct.unpack_from("<I", data, at)[0]
        at += 1 if short else 4
    name = data[at : at + n - 1].decode() if n else ""
    at += n
    if size is None:
        if at + width > len(data):
            raise ValueError("field runs over the end")
        # a kind that isn't known is stepped over by its width
        return name, struct.unpack_from("<" + FORMS[kind_], data, at)[0] if kind_ in FORMS else None, at + width
    end = at + size
    if end > len(data):
        raise ValueError("field runs over the end")
    if kind_ == STRING:
        return name, data[at : end - 1].decode(), end
    if kind_ == BINARY:
        return name, data[at:end], end
    if kind_ == ISOARRAY:
        item = data[at]
        if item not in FORMS or (size - 1) % (item & _WIDTH):
            raise ValueError("array of an unknown type or of broken items")
        return name, list(struct.unpack_from(f"<{(size - 1) // (item & _WIDTH)}{FORMS[item]}", data, at + 1)), end
    count = struct.unpack_from("<I", data, at)[0]
    at += 4
    found = []
    for _ in range(count):
        live = data[at] & _LIVE
        k, v, at = _field(data, at, depth + 1)
        # deleted fields count, but aren't values
        if live:
            found.append((k, v))
    if kind_ == OBJECT:
        return name, dict(found), end
    if kind_ == OBJECTISOARRAY:
        keys = [k for k, _ in found]
        return name, [dict(zip(keys, row, strict=True)) for row in zip(*[v for _, v in found], strict=True)], end
    return name, [v for _, v in found], end


def _bytes_udf(f: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v.encode() if isinstance(v, str) else bytes(v)))

    apply.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, "binary")


def _snappy(raw: bytes) -> bytes:
    return pa.compress(raw, codec="snappy", asbytes=True)


def _unsnappy(raw: bytes) -> bytes:
    """A raw block starts with its size, seven bits a byte, the lowest first."""
    size = shift = 0
    for b in raw:
        size |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    return pa.decompress(raw, decompressed_size=size, codec="snappy", asbytes=True)


_COMPRESS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress),
    "zlib": (zlib.compress, zlib.decompress),
    "snappy": (_snappy, _unsnappy),
}


def compress(col: Column, kind: str = "gzip") -> Column:
    return _bytes_udf(_COMPRESS[kind][0])(col)


def decompress(col: Column, kind: str = "gzip") -> Column:
    return _bytes_udf(_COMPRESS[kind][1])(col)


def encode_key(kind: int, table: Column, pid: Column, key: Column) -> Column:
    """[kind][table size][table][int32 id, little-endian][key] as binary."""
    hx = lambda n, w: F.lpad(F.hex(n), w, "0")
    word = hx(pid, 8)
    little = F.concat(*[F.substring(word, k, 2) for k in (7, 5, 3, 1)])
    return F.unhex(F.concat(F.lit(f"{kind:02X}"), hx(F.octet_length(table), 2), F.hex(table.cast("binary")), little, F.hex(key.cast("binary"))))


def decode_key(raw: Column) -> Column:
    """struct(kind, table, pid, key)."""
    h = F.hex(raw)
    n = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    at = n * 2 + 5
    word = F.concat(*[F.substring(h, at + k, F.lit(2)) for k in (6, 4, 2, 0)])
    return F.struct(
        F.conv(F.substring(h, 1, 2), 16, 10).cast("int").alias("kind"),
        F.decode(F.unhex(F.substring(h, F.lit(5), n * 2)), "UTF-8").alias("table"),
        F.conv(word, 16, 10).cast("long").alias("pid"),
        F.decode(F.unhex(F.substring(h, at + 8, F.length(h))), "UTF-8").alias("key"),
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_id, features) of ``<int n><int dim><double ...>`` files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                n, dim = struct.unpack_from("<ii", c, 0)
                m = np.frombuffer(bytes(c), "<f8", n * dim, 8).reshape(n, dim)
                yield pd.DataFrame({"path": p, "sample_id": np.arange(n), "features": list(m)})

    return files.mapInPandas(run, "path string, sample_id long, features array<double>")


def matrix_bytes(rows: list[list[float]]) -> bytes:
    return struct.pack("<ii", len(rows), len(rows[0]) if rows else 0) + np.array(rows, "<f8").tobytes()


def sequence_bytes(seqs: list[list[list[float]]]) -> bytes:
    dim = next((len(r) for s in seqs for r in s), 0)
    return struct.pack("<ii", len(seqs), dim) + b"".join(struct.pack("<i", len(s)) + np.array(s, "<f8").tobytes() for s in seqs)


def label_bytes(labels: list[int]) -> bytes:
    return struct.pack(f"<i{len(labels)}i", len(labels), *labels)


def read_labels(data: bytes) -> list[int]:
    """Labels of ``<int n><int ...>``."""
    n = struct.unpack_from("<i", data, 0)[0]
    return list(struct.unpack_from(f"<{n}i", data, 4))


def read_sequences(data: bytes) -> list[list[list[float]]]:
    """Sequences of ``<int size><int dim>{<int length><double ...>}``."""
    n, dim = struct.unpack_from("<ii", data, 0)
    at, out = 8, []
    for _ in range(n):
        t = struct.unpack_from("<i", data, at)[0]
        out.append(np.frombuffer(data, "<f8", t * dim, at + 4).reshape(t, dim).tolist())
        at += 4 + 8 * t * dim
    return out


def redis_command(text: str) -> bytes:
    """A command line (quotes and backslash escapes) as a request of bulk strings."""
    parts: list[str] = []
    cur, quote, open_, i = "", "", False, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            cur, open_ = cur + {"n": "\n", "t": "\t", "r": "\r"}.get(text[i], text[i]), True
        elif quote:
            if c == quote:
                quote = ""
            else:
                cur += c
        elif c in "'\"":
            quote, open_ = c, True
        elif c.isspace():
            if open_:
                parts.append(cur)
            cur, open_ = "", False
        else:
            cur, open_ = cur + c, True
        i += 1
    if quote:
        raise ValueError("quote isn't closed")
    if open_:
        parts.append(cur)
    raw = [p.encode() for p in parts]
    return b"*%d\r\n" % len(raw) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in raw)


def redis_reply(data: bytes, at: int = 0) -> tuple[Any, int]:
    """A reply (status, error, integer, string, array or nil) and where it ends; errors come back as ("error", text)."""
    end = data.index(b"\r\n", at)
    kind, head = data[at : at + 1], data[at + 1 : end].decode()
    at = end + 2
    if kind == b"+":
        return head, at
    if kind == b"-":
        return ("error", head), at
    if kind == b":":
        return int(head), at
    n = int(head)
    if n < 0:
        return None, at
    if kind == b"$":
        if at + n + 2 > len(data):
            raise ValueError("incomplete reply")
        return data[at : at + n], at + n + 2
    out = []
    for _ in range(n):
        v, at = redis_reply(data, at)
        out.append(v)
    return out, at
