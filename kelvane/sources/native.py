"""The binary log format, both versions: decoder, encoder and a Spark data source.

Integers are little-endian; sizes and magics are fixed values of the format. Damage is told apart: a record
cut short by the end of its file ends that file; one whose checksum or inner lengths are wrong is skipped.
"""

from __future__ import annotations

import io
import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
DATA_MAGIC, HINT_MAGIC = b"ybcdat02", b"ybchnt02"
DATA_SUFFIX, HINT_SUFFIX, LOCK_NAME = ".bitcask.data", ".bitcask.hint", ".bitcask.lock"
TOMBSTONE = 1 << 31
V1_ENTRY, V2_HEADER, V2_RECORD, V2_OP = struct.Struct("<IIII"), struct.Struct("<8sQII"), struct.Struct("<IIQII"), struct.Struct("<II")
V1_HINT, V2_HINT = struct.Struct("<IIIQ"), struct.Struct("<QIIIQ")

NATIVE_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType(), False), T.StructField("offset", T.LongType(), False),
    T.StructField("seq", T.LongType(), False), T.StructField("op_idx", T.IntegerType(), False),
    T.StructField("ts", T.LongType(), False), T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType()), T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("value_pos", T.LongType(), False),
])


def data_name(file_id: int) -> str:
    return f"{file_id:020d}{DATA_SUFFIX}"


def hint_name(file_id: int) -> str:
    return f"{file_id:020d}{HINT_SUFFIX}"


def discover(folder: str) -> list[int]:
    """Ids of well-named data files, ascending; other names are ignored."""
    found = (re.fullmatch(r"(\d{20})" + re.escape(DATA_SUFFIX), name) for name in os.listdir(folder))
    return sorted(int(m[1]) for m in found if m)


def identify(head: bytes) -> int:
    """Format of a file from its first bytes: 2 for the magic, and for a file that ends inside it."""
    return 2 if head[:8] == DATA_MAGIC[:len(head[:8])] and (len(head) < 8 or head[:8] == DATA_MAGIC) else 1


def file_header(seq_floor: int) -> bytes:
    head = struct.pack("<8sQ", DATA_MAGIC, seq_floor)
    return head + struct.pack("<II", zlib.crc32(head), 0)


def seq_floor(head: bytes) -> int:
    """The floor in a file's header; 0 if the header is torn or its checksum is wrong."""
    if len(head) < V2_HEADER.size:
        return 0
    _, floor, crc, _ = V2_HEADER.unpack_from(head)
    return floor if crc == zlib.crc32(head[:16]) else 0


def encode_record(seq: int, ts: int, ops: list[tuple[bytes, bytes | None]]) -> bytes:
    """One atomic write; a value of None is a delete."""
    body = b"".join(V2_OP.pack(len(k) | (TOMBSTONE if v is None else 0), len(v or b"")) + k + (v or b"") for k, v in ops)
    rest = struct.pack("<IQII", len(body), seq, ts, len(ops)) + body
    return struct.pack("<I", zlib.crc32(rest)) + rest


def encode_entry(ts: int, key: bytes, value: bytes | None) -> bytes:
    """A record of the old format."""
    rest = struct.pack("<III", ts, len(key) | (TOMBSTONE if value is None else 0), len(value or b"")) + key + (value or b"")
    return struct.pack("<I", zlib.crc32(rest)) + rest


def encode_hint(rows: list[tuple[int, int, int, int, bytes]], version: int = 2) -> bytes:
    """Rows (seq, ts, value size, value position, key); the old format leaves seq out."""
    if version == 2:
        raw = HINT_MAGIC + b"".join(V2_HINT.pack(seq, ts, len(k), size, pos) + k for seq, ts, size, pos, k in rows)
    else:
        raw = b"".join(V1_HINT.pack(ts, len(k), size, pos) + k for _, ts, size, pos, k in rows)
    return raw + struct.pack("<I", zlib.crc32(raw))


def decode_hint(raw: bytes, data_size: int | None = None) -> list[tuple[int, int, int, int, bytes]] | None:
    """Rows of a hint file, or None if it cannot be trusted: it is taken whole or not at all."""
    if len(raw) < 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        return None
    new = raw.startswith(HINT_MAGIC)
    at, end, head, out = 8 if new else 0, len(raw) - 4, V2_HINT if new else V1_HINT, []
    while at < end:
        if at + head.size > end:
            return None
        fields = head.unpack_from(raw, at)
        seq, (ts, ksz, size, pos) = (fields[0], fields[1:]) if new else (1, fields)
        at += head.size
        if not ksz or at + ksz > end or (data_size is not None and pos + size > data_size):
            return None
        out.append((seq, ts, size, pos, raw[at:at + ksz]))
        at += ksz
    return out


class Corrupt:
    """A record that was skipped."""

    def __init__(self, offset: int):
        self.offset = offset


class Truncated(Corrupt):
    """Where a file ends inside a record."""


def _ops(body: bytes, n: int):
    """(key, value or None, place of the value in body) of each operation; None unless they fill body exactly."""
    at, out = 0, []
    for _ in range(n):
        if at + V2_OP.size > len(body):
            return None
        ksz, vsz = V2_OP.unpack_from(body, at)
        dead, ksz = bool(ksz & TOMBSTONE), ksz & ~TOMBSTONE
        at += V2_OP.size
        if at + ksz + vsz > len(body) or not ksz or (dead and vsz):
            return None
        out.append((body[at:at + ksz], None if dead else body[at + ksz:at + ksz + vsz], at + ksz))
        at += ksz + vsz
    return out if at == len(body) else None


def scan_file(f: io.BufferedIOBase, size: int) -> Iterator:
    """Of each record (offset, seq, ts, [(key, value, position)]), or Corrupt or Truncated, from start to end.

    A length that goes past the end of the file is a truncation, found before anything is allocated."""
    head = f.read(8)
    new = identify(head) == 2
    at = min(size, V2_HEADER.size) if new else 0
    while at < size:
        f.seek(at)
        left, fixed = size - at, V2_RECORD if new else V1_ENTRY
        raw = f.read(fixed.size) if left >= fixed.size else b""
        if len(raw) < fixed.size:
            yield Truncated(at)
            return
        if new:
            crc, length, seq, ts, n = fixed.unpack(raw)
        else:
            crc, ts, ksz, vsz = fixed.unpack(raw)
            seq, length, n = 1, (ksz & ~TOMBSTONE) + vsz, 1
        if length > left - fixed.size:
            yield Truncated(at)
            return
        body = f.read(length)
        if zlib.crc32(body, zlib.crc32(raw[4:])) != crc:
            yield Corrupt(at)
        elif new:
            ops = _ops(body, n) if n <= length else None
            yield Corrupt(at) if ops is None else (at, seq, ts, [(k, v, at + fixed.size + p) for k, v, p in ops])
        else:
            k = ksz & ~TOMBSTONE
            yield (at, seq, ts, [(body[:k], None if ksz & TOMBSTONE else body[k:], at + fixed.size + k)])
        at += fixed.size + length


def rows_of(path: str, file_id: int, keys_only: bool = False) -> Iterator[tuple]:
    """Log rows of one data file. keys_only: from its hint file, without values, where that can be trusted."""
    size = os.path.getsize(path)
    hint = path[:-len(DATA_SUFFIX)] + HINT_SUFFIX
    if keys_only and os.path.exists(hint):
        with open(hint, "rb") as f:
            listed = decode_hint(f.read(), size)
        if listed is not None:
            for seq, ts, _, pos, key in listed:
                yield file_id, pos, seq, 0, ts, key, None, False, pos
            return
    with open(path, "rb", buffering=1 << 18) as f:
        for rec in scan_file(f, size):
            if not isinstance(rec, Corrupt):
                at, seq, ts, ops = rec
                for k, (key, value, pos) in enumerate(ops):
                    yield file_id, at, seq, k, ts, key, None if keys_only else value, value is None, pos


class NativeSource(DataSource):
    """spark.read.format("kelvane_native").load(folder); option keys_only=true reads hints where it can."""

    @classmethod
    def name(cls) -> str:
        return "kelvane_native"

    def schema(self):
        return NATIVE_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.keys_only = str(options.get("keys_only", "false")).lower() == "true"

    def partitions(self):
        """One file each: like the format's own rotation, files are the unit of work."""
        return [InputPartition(i) for i in discover(self.folder)]

    def read(self, partition):
        if partition is None or partition.value is None:
            return iter(())
        return rows_of(os.path.join(self.folder, data_name(partition.value)), partition.value, self.keys_only)


def read_native(spark: SparkSession, folder: str, keys_only: bool = False) -> DataFrame:
    spark.dataSource.register(NativeSource)
    return spark.read.format("kelvane_native").option("keys_only", keys_only).load(folder)


def next_seq_of(folder: str) -> int:
    """After reading a folder: more than any record's number, and no less than any file's floor."""
    best = 1
    for i in discover(folder):
        path = os.path.join(folder, data_name(i))
        with open(path, "rb", buffering=1 << 18) as f:
            head = f.read(V2_HEADER.size)
            if identify(head) == 2:
                best = max(best, seq_floor(head))
            f.seek(0)
            best = max([best, *(rec[1] + 1 for rec in scan_file(f, os.path.getsize(path)) if not isinstance(rec, Corrupt))])
    return best


def write_native(rows, folder: str, file_id: int = 0, floor: int = 1) -> str:
    """Rows (seq, ts, [(key, value or None)]) as one data file of the new format."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, data_name(file_id))
    with open(path, "wb") as f:
        f.write(file_header(floor))
        for seq, ts, ops in rows:
            f.write(encode_record(seq, ts, ops))
    return path


def write_native_frame(log: DataFrame, folder: str) -> int:
    """A log (seq, op_idx, key, value, tombstone), keys and values binary, as data files that the tasks write: ranges of seq,
    so file ids ascend in log order and each seq is one record (ts 0) of one file. Gives the number of records. Files are moved into place, so a
    task that runs twice leaves whole ones. The folder must be one that executors and readers share."""
    os.makedirs(folder, exist_ok=True)

    def write(batches):
        import itertools
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        name = data_name(TaskContext.get().partitionId())
        temp, n = os.path.join(folder, f".{name}.{uuid.uuid4().hex}"), 0

        def records():
            nonlocal n
            for seq, ops in itertools.groupby(rows, lambda r: r[0]):
                n += 1
                ops = list(ops)
                if any(not k or v is None and not dead for _, _, k, v, dead in ops):
                    raise ValueError(f"number {seq} has an empty key or a put without a value")
                yield seq, 0, [(k, None if dead else v) for _, _, k, v, dead in ops]

        with open(temp, "wb") as f:
            f.write(file_header(1))
            for seq, ts, ops in records():
                f.write(encode_record(seq, ts, ops))
        os.replace(temp, os.path.join(folder, name))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = log.select("seq", "op_idx", "key", "value", "tombstone").repartitionByRange("seq").sortWithinPartitions("seq", "op_idx")
    return sum(r["n"] for r in ordered.mapInArrow(write, "n long").collect())


def write_old(entries, folder: str, file_id: int = 0, hint=None) -> str:
    """Entries (ts, key, value or None) as one data file of the old format, and its hint if one is given."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, data_name(file_id))
    with open(path, "wb") as f:
        f.writelines(encode_entry(*e) for e in entries)
    if hint is not None:
        with open(os.path.join(folder, hint_name(file_id)), "wb") as f:
            f.write(encode_hint(hint, 1))
    return path
