"""Training-order materialisation of token ids.

A document's ids are cut in sequences of LENGTH. Sequences are numbered 0 to N - 1 in the order of the input
files; a keyed Feistel network over the least even power of two that holds N, walked along its cycles until it falls
below N, permutes the numbers: each sequence has a global slot. Slots are range-partitioned to shards of
PER_SHARD records of a fixed stride, so record r of the training order is at (r mod PER_SHARD) * stride of shard
r div PER_SHARD, and reading can start and resume anywhere.

Ids are those of a column of ids, two or four bytes each (one that is null or does not fit is an error; the column may
hold them packed, little-endian), or without one the bytes of the text's UTF-8 (a byte vocabulary, one byte each). A record is: document id (int64), number of the sequence in it (uint32), how many ids it has (uint32), then LENGTH
ids, unused ones 0; all little-endian.

Numbering needs no shuffle: documents are staged in packs of some MB with the number of their task and how many sequences came before them in it, so that
numbers hang on the staged packs and on no plan of input splits; counts of tasks (MAX_SPLITS at most, 16 bytes each, broadcast)
give each task its base. Sequences travel to their shard in compressed runs. Shards are
written under a temporary name and moved, so a task that is lost or run twice leaves whole files; the manifest is written when all of them
are there.
Null or empty text or ids: no sequences. A null id is stored as the least int64. Repeated rows are sequences of their own.
"""

from __future__ import annotations

import itertools
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import fresh_path, in_pieces, staged

LENGTH, PER_SHARD, KEY, ROUNDS, MAX_SPLITS = 512, 16384, 0x5EED, 6, 2_000_000
RUN_LEVEL = 6  # of zstd
# of zstd for packs: greedy matches of six bytes or more, found in a whole pack; smaller and faster than level 9
STAGED = {"window_log": 24, "hash_log": 22, "search_log": 4, "min_match": 6, "strategy": zstandard.STRATEGY_GREEDY}
PACK, SLICE = 16_000_000, 1_000_000  # bytes of a staged pack, ids dealt at once
NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """Slots of indices below n (or, back, indices of slots): a bijection of 0..n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def once(x):
        left, right = x >> np.uint64(half), x & low
        if back:
            for k in keys[::-1]:
                left, right = right ^ (_mix(left + k) & low), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix(right + k) & low)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(over := np.flatnonzero(out >= n)):
        out[over] = once(out[over])
    return out.astype(np.int64)


def materialise(docs: DataFrame, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, id_bytes: int = 2, pack=None) -> DataFrame:
    """Writes the shards and a manifest to out_dir (by default a new folder in the shared one) and gives, for each
    sequence, (doc_id, seq_no, slot, shard, offset, n_ids, path). With pack (batches of (doc_id, body) to lists of ids of documents and
    of their ids, packed), the text is encoded in the task that numbers it."""
    spark = docs.sparkSession
    out_dir = out_dir or fresh_path(spark, "shards")
    item = id_bytes if ids_col or pack else 1
    lists = bool(ids_col) and not isinstance(docs.schema[ids_col].dataType, BinaryType)
    text = F.col(text_col).cast("string")
    body = F.col(ids_col).cast("array<long>") if lists else F.col(ids_col) if ids_col else text if pack else F.encode(text, "UTF-8")
    width = length * item

    def number(batches):
        task, before = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**STAGED))
        heads: list[tuple[int, int]] = []
        held: list[bytes] = []

        def packs(last):
            nonlocal before
            if not heads or not last and sum(map(len, held)) < PACK:
                return
            n = sum(-(-size // width) for _, size in heads)
            packed = squeeze.compress(np.array(heads, "<i8").tobytes() + b"".join(held))
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([len(heads)], pa.int64()), pa.array([packed], pa.binary())], ["task", "first", "n", "docs", "packed"])
            before += n
            heads.clear()
            held.clear()

        for ids, bodies in pack(batches) if pack else _pieces(batches, lists, item):
            heads += [(NO_ID if i is None else i, len(x)) for i, x in zip(ids, bodies, strict=True) if x]
            held += [x for x in bodies if x]
            yield from packs(False)
        yield from packs(True)

    rows = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).mapInArrow(number, "task int, first long, n long, docs long, packed binary"), "sequences", "none")
    counts = rows.groupBy("task").agg(F.sum("n").alias("n")).limit(MAX_SPLITS + 1).collect()
    if len(counts) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} tasks: give docs fewer partitions")
    sizes = np.zeros(max((r["task"] + 1 for r in counts), default=0), np.int64)
    for r in counts:
        sizes[r["task"]] = r["n"]
    total = int(sizes.sum())
    shared = spark.sparkContext.broadcast(np.cumsum(sizes) - sizes)

    def deal(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=RUN_LEVEL), zstandard.ZstdDecompressor()
        held: dict[int, list[np.ndarray]] = {}
        weight = 0

        def flush():
            pairs = [(shard, squeeze.compress(_run(np.concatenate(held[shard]), length))) for shard in sorted(held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.binary())], ["shard", "run"])

        for batch in batches:
            for k in range(batch.num_rows):
                task, first, docs_here, packed = (batch.column(c)[k].as_py() for c in ("task", "first", "docs", "packed"))
                raw = open_.decompress(packed)
                heads = np.frombuffer(raw, "<i8", 2 * docs_here).reshape(-1, 2)
                flat, ends = np.frombuffer(raw, f"<u{item}", offset=16 * docs_here), np.cumsum(heads[:, 1] // item)
                # some documents at a time: indices take more memory than ids
                for a, b in itertools.pairwise(np.unique([0, *np.searchsorted(ends, np.arange(SLICE, int(ends[-1]), SLICE)).tolist(), docs_here]).tolist()):
                    records = _records(heads[a:b, 0], heads[a:b, 1], flat[ends[a - 1] if a else 0:ends[b - 1]], length, item)
                    records["slot"] = permute(shared.value[task] + first + np.arange(len(records)), total, key)
                    first += len(records)
                    shards = records["slot"] // per_shard
                    order = np.argsort(shards, kind="stable")
                    records, shards = records[order], shards[order]
                    for x, y in itertools.pairwise([0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(records)]):
                        held.setdefault(int(shards[x]), []).append(records[x:y])
                    weight += records.nbytes
                if weight > 64_000_000:
                    weight = 0
                    yield flush()
        if held:
            yield flush()

    runs = rows.mapInArrow(deal, "shard long, run binary")

    def write(pdf):
        import pandas as pd
        from pyarrow import fs

        shard, stride = int(pdf["shard"].iloc[0]), 16 + length * item
        unpack = zstandard.ZstdDecompressor()
        records = np.concatenate([_of_run(unpack.decompress(r), length, item) for r in pdf["run"]])
        slots = records["slot"]
        order = np.argsort(slots)
        records, slots = records[order], slots[order]
        if len(np.unique(slots)) != len(slots) or len(slots) != min(per_shard, total - shard * per_shard):
            raise RuntimeError(f"shard {shard} does not have each of its records once")
        where, folder = fs.FileSystem.from_uri(out_dir)
        where.create_dir(folder, recursive=True)
        name, temp = f"{folder}/shard-{shard:08d}.bin", f"{folder}/.shard-{shard:08d}.{uuid.uuid4().hex}"
        with where.open_output_stream(temp) as f:
            f.write(records[["id", "seq", "used", "body"]].astype(_record(length, item)[1:]).tobytes())
        where.move(temp, name)
        ids = records["id"]
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").where(pd.Series(ids != NO_ID)), "seq_no": records["seq"].astype(np.int64), "slot": slots, "shard": shard, "offset": (slots - shard * per_shard) * stride, "n_ids": records["used"].astype(np.int64), "path": name})

    out = staged(runs.groupBy("shard").applyInPandas(write, "doc_id long, seq_no long, slot long, shard long, offset long, n_ids long, path string"), "slots")
    _write_manifest(out_dir, {"n": total, "length": length, "per_shard": per_shard, "id_bytes": item, "stride": 16 + length * item, "key": key, "rounds": ROUNDS})
    return out


def _record(length: int, item: int) -> list[tuple]:
    return [("slot", "<i8"), ("id", "<i8"), ("seq", "<u4"), ("used", "<u4"), ("body", f"<u{item}", (length,))]


def _run(records: np.ndarray, length: int) -> bytes:
    """Records by columns, without what pads them: how many, slots, ids, numbers, sizes, bodies."""
    heads = [np.ascontiguousarray(records[c]).tobytes() for c in ("slot", "id", "seq", "used")]
    return b"".join([np.int64(len(records)).tobytes(), *heads, records["body"][np.arange(length) < records["used"][:, None]].tobytes()])


def _of_run(raw: bytes, length: int, item: int) -> np.ndarray:
    n, at = int(np.frombuffer(raw, "<i8", 1)[0]), 8
    out = np.zeros(n, _record(length, item))
    for c, kind in (("slot", "<i8"), ("id", "<i8"), ("seq", "<u4"), ("used", "<u4")):
        out[c] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    body = np.zeros((n, length), f"<u{item}")
    body[np.arange(length) < out["used"][:, None]] = np.frombuffer(raw, f"<u{item}", offset=at)
    out["body"] = body
    return out


def _records(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, length: int, item: int) -> np.ndarray:
    """The sequences of documents whose ids lie one after another in flat, padded with 0; sizes are in bytes. Slots are not set."""
    used = sizes // item
    n = -(-used // length)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), _record(length, item))
    body = np.zeros(len(out) * length, f"<u{item}")
    body[np.arange(len(flat)) + np.repeat(first * length - (np.cumsum(used) - used), used)] = flat
    out["body"] = body.reshape(-1, length)
    out["id"], out["seq"] = np.repeat(ids, n), np.arange(len(out)) - np.repeat(first, n)
    out["used"] = np.minimum(np.repeat(used, n) - out["seq"].astype(np.int64) * length, length)
    return out


def _pieces(batches, lists, item):
    """Lists of ids of documents and of their bodies as bytes (None: null)."""
    if not lists:
        yield from in_pieces(batches, ["doc_id", "body"], 8_000_000)
        return
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            flat = b.column(1).flatten()
            values = flat.to_numpy(zero_copy_only=False)
            if flat.null_count or len(values) and not 0 <= values.min() <= values.max() < 1 << 8 * item:
                raise ValueError(f"an id is null or does not fit in {item} bytes")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            yield b.column(0).to_pylist(), [x.tobytes() for x in np.split(values.astype(f"<u{item}"), ends[:-1])[:len(b)]]


def _write_manifest(out_dir: str, what: dict) -> None:
    from pyarrow import fs

    where, folder = fs.FileSystem.from_uri(out_dir)
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(what).encode())


def read(out_dir: str, start: int = 0, count: int | None = None):
    """(slot, doc_id, seq_no, ids) of records in training order, from slot start on."""
    from pyarrow import fs

    where, folder = fs.FileSystem.from_uri(out_dir)
    with where.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    stop = m["n"] if count is None else min(m["n"], start + count)
    slot = start
    while slot < stop:
        shard, first = divmod(slot, m["per_shard"])
        last = min(stop, (shard + 1) * m["per_shard"])
        with where.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
            f.seek(first * m["stride"])
            raw = f.read((last - slot) * m["stride"])
        for k in range(last - slot):
            rec = raw[k * m["stride"]:(k + 1) * m["stride"]]
            n = int.from_bytes(rec[12:16], "little")
            doc = int.from_bytes(rec[:8], "little", signed=True)
            yield slot + k, None if doc == NO_ID else doc, int.from_bytes(rec[8:12], "little"), np.frombuffer(rec[16:], f"<u{m['id_bytes']}")[:n]
        slot = last
