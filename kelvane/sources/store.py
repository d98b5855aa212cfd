"""A store: a folder of Parquet log files and a manifest that names those which count.

A commit writes one file and then replaces the manifest; the replacement is the moment of publication, so
readers see all of a batch or nothing, and a DataFrame made from a manifest stays a snapshot. Many batches can
be committed as one group: one job looks the touched keys up, batches are decided in order against an
overlay, and one file is written. Compaction writes the live rows in key order (sorted files with small row
groups make point and range filters skip nearly all) and swaps exactly the files it has read.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from concurrent.futures import Future

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..metrics import Metrics
from ..model import (
    LOG_SCHEMA,
    UNBOUNDED,
    AlreadyLocked,
    Bound,
    Check,
    CompactedAway,
    ConditionFailed,
    Delete,
    Direction,
    KeyOrder,
    Options,
    Put,
    ReadOnly,
    Unordered,
    Versioned,
    validate,
)
from ..operators import access
from ..operators import live as lv
from ..plans import planner
from . import native

_ARROW = pa.schema([("seq", pa.int64()), ("op_idx", pa.int32()), ("key", pa.binary()), ("value", pa.binary()), ("tombstone", pa.bool_()), ("ts", pa.int64())])
ROW_GROUP = 1 << 20
LOOKUP = 512  # keys that are looked up by a pushed IN filter; more are joined


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options = spark, path, options
        self.metrics = options.metrics or Metrics()
        self._lock = None

    # ---- opening and closing ----

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Opens or makes a store. A folder with files of the binary format and no manifest is read in first;
        read-only it must exist. Opening alone writes no data file."""
        store = cls(spark, path, options or Options())
        if store.options.read_only:
            if not os.path.isdir(path):
                raise FileNotFoundError(path)
            store._manifest = store._load()
            return store
        os.makedirs(path, exist_ok=True)
        store._lock = os.open(os.path.join(path, "LOCK"), os.O_RDWR | os.O_CREAT)
        try:
            fcntl.flock(store._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            os.close(store._lock)
            store._lock = None
            raise AlreadyLocked from None
        store._manifest = store._load()
        if not os.path.exists(store._pointer) and native.discover(path):
            store._ingest()
        return store

    @property
    def _pointer(self) -> str:
        return os.path.join(self.path, "MANIFEST")

    def _load(self) -> dict:
        try:
            with open(self._pointer) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"generation": 0, "files": [], "next_seq": 1, "floor": 0, "done": {}, "gone": []}

    def _publish(self, manifest: dict) -> None:
        manifest = manifest | {"generation": self._manifest["generation"] + 1}
        temp = f"{self._pointer}.{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, self._pointer)
        self._sync_dir()
        self._manifest = manifest

    def _sync_dir(self) -> None:
        fd = os.open(self.path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def _ingest(self) -> None:
        rows = native.read_native(self.spark, self.path)
        out = lv.latest(rows, order=lv.NATIVE_ORDER).where("not tombstone")
        files = self._write_sorted(out.select(*LOG_SCHEMA.names))
        seq = native.next_seq_of(self.path)
        self._publish(self._manifest | {"files": files, "next_seq": seq, "floor": seq - 1})

    def close(self) -> None:
        self.sync()
        self.drop()

    def drop(self) -> None:
        """Lets the store go without the barrier, as a process that stops does."""
        if self._lock is not None:
            os.close(self._lock)
            self._lock = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def sync(self) -> None:
        if not self.options.read_only:
            began = time.perf_counter()
            self._sync_dir()
            self.metrics.record_sync(time.perf_counter() - began)

    # ---- reading ----

    def log(self) -> DataFrame:
        """The operations of this moment's files."""
        files = [os.path.join(self.path, f) for f in self._manifest["files"]]
        return self.spark.read.schema(LOG_SCHEMA).parquet(*files) if files else self.spark.createDataFrame([], LOG_SCHEMA)

    def live(self) -> DataFrame:
        return lv.live(self.log()).select("key", "value", "version", "ts")

    snapshot = live

    def as_of(self, seq: int) -> DataFrame:
        if seq < self._manifest["floor"]:
            raise CompactedAway
        return lv.as_of(self.log(), seq).select("key", "value", "version", "ts")

    @property
    def key_order(self) -> KeyOrder:
        return self.options.key_order

    @property
    def next_seq(self) -> int:
        return self._manifest["next_seq"]

    def __len__(self) -> int:
        return self.live().count()

    def is_empty(self) -> bool:
        return not self.live().head(1)

    def get_versioned(self, key: bytes) -> Versioned | None:
        began = time.perf_counter()
        rows = access.get(self.live(), bytes(key)).collect()
        self.metrics.record_get(time.perf_counter() - began)
        return Versioned(bytes(rows[0]["value"]), rows[0]["version"]) if rows else None

    def get(self, key: bytes) -> bytes | None:
        got = self.get_versioned(key)
        return got and got.value

    def list_keys(self) -> DataFrame:
        return self._ordered(access.list_keys(self.live()))

    def _ordered(self, df: DataFrame) -> DataFrame:
        return df.orderBy("key") if self.key_order is KeyOrder.SORTED else df

    def _need_order(self) -> None:
        if self.key_order is not KeyOrder.SORTED:
            raise Unordered

    def scan(self, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
        self._need_order()
        return access.scan(self.live(), start, end).select("key", "value")

    def scan_page(self, start: Bound, end: Bound, direction: Direction, limit: int) -> list[tuple[bytes, Versioned]]:
        self._need_order()
        return [(bytes(r["key"]), Versioned(bytes(r["value"]), r["version"])) for r in access.scan_page(self.live(), start, end, direction, limit).collect()]

    def fold(self, step, start):
        return access.fold(self.live(), step, start, self.key_order is KeyOrder.SORTED)

    def sql(self, text: str) -> DataFrame:
        return planner.query(self.live(), text, self.key_order)

    def explain(self, text: str) -> str:
        return str(planner.plan(planner.parse(text), self.key_order))

    # ---- writing ----

    def put(self, key: bytes, value: bytes, ts: int | None = None) -> int:
        began = time.perf_counter()
        seq = self.write_batch([Put(bytes(key), bytes(value))], ts)
        self.metrics.record_put(time.perf_counter() - began)
        return seq

    def delete(self, key: bytes, ts: int | None = None) -> int | None:
        began = time.perf_counter()
        seq = self.write_batch([Delete(bytes(key))], ts)
        self.metrics.record_delete(time.perf_counter() - began)
        return seq

    def write_batch(self, ops, ts: int | None = None) -> int | None:
        """The batch's number, which is the version of all it puts; None if it wrote nothing."""
        got = self.commit_group([ops], ts)[0]
        if isinstance(got, Exception):
            raise got
        return got

    def submit(self, ops, ts: int | None = None) -> Future:
        future: Future = Future()
        try:
            future.set_result(self.write_batch(ops, ts))
        except Exception as e:  # the caller's to see
            future.set_exception(e)
        return future

    def versions(self, keys: list[bytes]) -> dict[bytes, int]:
        """Live versions of some keys, in one job."""
        if not keys or not self._manifest["files"]:
            return {}
        live = self.live().select("key", "version")
        if len(keys) <= LOOKUP:
            found = live.where(F.col("key").isin([bytearray(k) for k in keys]))
        else:
            touched = self.spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
            found = live.join(touched, "key", "left_semi")
        return {bytes(r["key"]): r["version"] for r in found.collect()}

    def commit_group(self, batches, ts: int | None = None, token: tuple[str, int] | None = None) -> list:
        """Decides batches in order, each seeing those before it, and publishes what they write at once.

        For each batch its number, None, or the error that it met. token (writer, n) makes a commit idempotent:
        one with an n that this writer has reached already does nothing."""
        if self.options.read_only:
            raise ReadOnly
        batches = [list(b) for b in batches]
        self.metrics.record_pending_queue_depth(len(batches))
        if token and self._manifest["done"].get(token[0], -1) >= token[1]:
            return [None] * len(batches)
        ts = int(time.time()) if ts is None else ts
        out: list = [None] * len(batches)
        for k, ops in enumerate(batches):
            try:
                validate(ops)
            except Exception as e:
                out[k] = e
        now = self.versions(sorted({op.key for k, ops in enumerate(batches) if out[k] is None for op in ops}))
        seq, rows = self.next_seq, []
        for k, ops in enumerate(batches):
            if out[k] is not None:
                continue
            failed = next((i for i, op in enumerate(ops) if isinstance(op, Check) and not op.holds(now.get(op.key))), None)
            if failed is not None:
                out[k] = ConditionFailed(failed)
                continue
            mine, written = dict.fromkeys((op.key for op in ops), None), []
            mine = {key: now.get(key) for key in mine}
            for op in ops:
                if isinstance(op, Put):
                    written.append((seq, len(written), op.key, op.value, False, ts))
                    mine[op.key] = seq
                elif isinstance(op, Delete) and mine[op.key] is not None:
                    written.append((seq, len(written), op.key, None, True, ts))
                    mine[op.key] = None
            if written:
                rows += written
                for key, version in mine.items():
                    if version is None:
                        now.pop(key, None)
                    else:
                        now[key] = version
                out[k], seq = seq, seq + 1
        if rows or token:
            manifest = self._manifest | {"next_seq": seq}
            if rows:
                name = f"log-{rows[0][0]:020d}-{uuid.uuid4().hex}.parquet"
                pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW), os.path.join(self.path, name))
                if self.options.sync_on_put:
                    with open(os.path.join(self.path, name), "rb") as f:
                        os.fsync(f.fileno())
                manifest["files"] = [*manifest["files"], name]
            if token:
                manifest["done"] = manifest["done"] | {token[0]: token[1]}
            self._publish(manifest)
        return out

    def write_frame(self, ops: DataFrame, ts: int | None = None, token: tuple[str, int] | None = None) -> int | None:
        """One batch from a DataFrame (key, value, tombstone; the last of equal keys by an optional op_idx counts):
        for sets too large for the driver. Keys and values are checked in the same job; deletes of absent keys are left out.
        token as in commit_group: it is published with the rows, in one manifest."""
        if self.options.read_only:
            raise ReadOnly
        if token and self._manifest["done"].get(token[0], -1) >= token[1]:
            return None
        done = self._manifest["done"] | ({token[0]: token[1]} if token else {})
        seq, ts = self.next_seq, int(time.time()) if ts is None else ts
        if "op_idx" not in ops.columns:
            ops = ops.withColumn("op_idx", F.lit(0))
        last = lv.latest(ops.withColumn("seq", F.lit(seq).cast("long")))
        last = last.withColumn("key", F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("key must not be empty"))))
        last = last.withColumn("value", F.when(F.col("tombstone") | F.col("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.lit("a put needs a value"))))
        there = self.live().select("key", F.lit(True).alias("__there"))
        kept = last.join(there, "key", "left").where("not tombstone or coalesce(__there, false)")
        folder = f"log-{seq:020d}-{uuid.uuid4().hex}"
        rows = kept.select("seq", "op_idx", "key", F.when(F.col("tombstone"), F.lit(None)).otherwise(F.col("value")).alias("value"), "tombstone", F.lit(ts).cast("long").alias("ts"))
        rows.write.parquet(os.path.join(self.path, folder))
        names = sorted(f"{folder}/{n}" for n in os.listdir(os.path.join(self.path, folder)) if n.endswith(".parquet"))
        if not sum(pq.read_metadata(os.path.join(self.path, n)).num_rows for n in names):
            shutil.rmtree(os.path.join(self.path, folder))
            if token:
                self._publish(self._manifest | {"done": done})
            return None
        self._publish(self._manifest | {"files": [*self._manifest["files"], *names], "next_seq": seq + 1, "done": done})
        return seq

    def _write_sorted(self, rows: DataFrame) -> list[str]:
        """Files of about max_file_size in key order, small row groups."""
        folder = f"base-{uuid.uuid4().hex}"
        size = rows.agg(F.coalesce(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))), F.lit(0))).first()[0]
        n = max(1, -(-int(size) // max(1, self.options.max_file_size)))
        n = min(n, 100_000)
        rows.repartitionByRange(n, "key").sortWithinPartitions("key").write.option("parquet.block.size", ROW_GROUP).parquet(os.path.join(self.path, folder))
        return sorted(f"{folder}/{f}" for f in os.listdir(os.path.join(self.path, folder)) if f.endswith(".parquet"))

    def merge(self) -> None:
        """Rewrites the store as its live rows. Files that came after this began stay, and win by their numbers.
        Replaced files are removed once `retain` further manifests have been published, so that open snapshots
        can still read them."""
        if self.options.read_only:
            raise ReadOnly
        began = time.perf_counter()
        scope = list(self._manifest["files"])
        if not scope:
            return
        floor = self.next_seq - 1
        files = self._write_sorted(lv.compacted(self.log()).select(*LOG_SCHEMA.names))
        later = [f for f in self._manifest["files"] if f not in set(scope)]
        gone = [*self._manifest["gone"], [self._manifest["generation"], scope]]
        old = [g for g in gone if g[0] <= self._manifest["generation"] - self.options.retain]
        self._publish(self._manifest | {"files": [*files, *later], "floor": max(floor, self._manifest["floor"]), "gone": [g for g in gone if g not in old]})
        for _, names in old:
            for name in names:
                try:
                    os.remove(os.path.join(self.path, name))
                except FileNotFoundError:
                    pass
        self.metrics.record_merge_summary(len(scope), sum(pq.read_metadata(os.path.join(self.path, f)).num_rows for f in files))
        self.metrics.record_merge(time.perf_counter() - began)

    def export_native(self, folder: str) -> str:
        """The live rows as one file of the binary format, streamed through the driver."""
        rows = self.live().orderBy("version", "key").toLocalIterator()
        return native.write_native(((r["version"], r["ts"], [(bytes(r["key"]), bytes(r["value"]))]) for r in rows), folder, 0, self.next_seq)
