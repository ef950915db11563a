"""TFRecord files of tf.train.Example messages, read without their library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a feature holds: one of the three lists.
FEATURES = "map<string,struct<bytes:array<binary>,floats:array<float>,ints:array<bigint>>>"


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of the fields of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"a field of kind {kind}")
        yield key >> 3, value


def _numbers(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def example(data: bytes) -> dict[str, dict]:
    """The features of a message by name."""
    out: dict[str, dict] = {}
    for number, features in _fields(memoryview(data)):
        for entry_number, entry in _fields(features) if number == 1 else ():
            if entry_number != 1:
                continue
            name, made = "", {"bytes": None, "floats": None, "ints": None}
            for k, part in _fields(entry):
                if k == 1:
                    name = bytes(part).decode()
                    continue
                for kind, held in _fields(part):
                    values = [v for n, v in _fields(held) if n == 1]
                    if kind == 1:
                        made["bytes"] = [bytes(v) for v in values]
                    elif kind == 2:
                        made["floats"] = [float(x) for v in values for x in np.frombuffer(v, "<f4")]
                    elif kind == 3:
                        made["ints"] = [x for v in values for x in ([v - (1 << 64) if v >> 63 else v] if isinstance(v, int) else _numbers(v))]
            out[name] = made
    return out


def framed(data: bytes) -> Iterator[bytes]:
    """The records of a file, compressed or not; one that is cut short is an error. Checksums are not looked at."""
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and int.from_bytes(data[:2], "big") % 31 == 0):
        data = zlib.decompressobj(47).decompress(data)
    at = 0
    while at < len(data):
        if at + 12 > len(data) or at + 16 + (size := struct.unpack_from("<Q", data, at)[0]) > len(data):
            raise ValueError("a record is cut short")
        yield data[at + 12 : at + 12 + size]
        at += 16 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, features) of TFRecord files (a folder or pattern); record numbers those of a file. Files are read
    whole, as shards of training data are small."""
    features = pa.map_(pa.string(), pa.struct([("bytes", pa.list_(pa.binary())), ("floats", pa.list_(pa.float32())), ("ints", pa.list_(pa.int64()))]))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[tuple[int, list]] = []
                for k, record in enumerate(framed(content.as_py())):
                    held.append((k, list(example(record).items())))
                    if len(held) >= 64:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], features)], names=["path", "record", "features"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], features)], names=["path", "record", "features"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(over, f"path string, record bigint, features {FEATURES}")


def _decoded(records: DataFrame, columns: dict[str, tuple[str, str, str]], seq: str, one_hot: bool) -> DataFrame:
    """records with arrays in place of features: column: (feature, numpy type, SQL type); seq is a sequence of one-hot rows,
    or of indexes, as letters."""
    names = ["path", "record", "seq", *columns]
    kinds = {"float": pa.float32(), "int": pa.int32(), "bigint": pa.int64()}

    def letters(data: bytes) -> str:
        x = np.frombuffer(data, np.uint8)
        if one_hot:
            hot = x.reshape(-1, 4)
            x = np.where(hot.any(1), hot.argmax(1), 4)
        return np.frombuffer(b"ACGTN", "S1")[np.minimum(x, 4)].tobytes().decode()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(f) for f in batch.column(2).to_pylist()]
            out = [batch.column(0), batch.column(1), pa.array([letters(r[seq]["bytes"][0]) if seq in r else None for r in rows], pa.string())]
            for feature, kind, sql in columns.values():
                made = [None if feature not in r else np.frombuffer(r[feature]["bytes"][0], kind).tolist() if r[feature]["bytes"] is not None else r[feature]["ints"] or r[feature]["floats"] for r in rows]
                out.append(pa.array(made, pa.list_(kinds[sql])))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return records.mapInArrow(over, "path string, record bigint, seq string" + "".join(f", {n} array<{sql}>" for n, (_, _, sql) in columns.items()))


def examples(records: DataFrame, n_targets: int, sequence: str = "sequence", target: str = "target", one_hot: bool = True) -> DataFrame:
    """(path, record, seq, targets): sequences as letters, and half-precision targets as bins by targets."""
    flat = _decoded(records, {"flat": (target, "<f2", "float")}, sequence, one_hot)
    rows = F.transform(F.sequence(F.lit(0), (F.size("flat") / n_targets).cast("int") - 1), lambda b: F.slice("flat", b * n_targets + 1, F.lit(n_targets)))
    return flat.select("path", "record", "seq", F.when(F.size("flat") >= n_targets, rows).otherwise(F.array().cast("array<array<float>>")).alias("targets"))


def rna(records: DataFrame, length: int) -> DataFrame:
    """(path, record, length, seq, coding, splice, targets) of transcripts, sequences filled up with N and the two tracks
    with 0 to the length."""
    made = _decoded(records, {"lengths": ("lengths", "<i8", "bigint"), "coding": ("coding", "u1", "int"), "splice": ("splice", "u1", "int"), "targets": ("targets", "<f2", "float")}, "sequence", False)
    filled = lambda c: F.concat(c, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(c), F.lit(0))))
    return made.select("path", "record", F.coalesce(F.get("lengths", F.lit(0)), F.length("seq").cast("bigint")).alias("length"), F.rpad("seq", length, "N").alias("seq"), filled("coding").alias("coding"), filled("splice").alias("splice"), "targets")
