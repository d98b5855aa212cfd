"""Replays traces of commands, one JSON object a line, against a store; keys and values are lowercase hex.

Commands: open close drop merge sync put delete batch get get_versioned list_keys fold scan scan_page seed_v1.
Replies: {"ok": ...}, {"err": name} with index for a failed condition, or {"protocol": message}.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

from .model import UNBOUNDED, Bound, Check, ConditionFailed, Delete, Direction, KeyOrder, Options, Put, StoreError
from .sources import native
from .sources.store import Store


def _bound(b) -> Bound:
    if b is None:
        return UNBOUNDED
    kind, key = next(iter(b.items()))
    return Bound(bytes.fromhex(key), kind == "incl")


def _op(o):
    key = bytes.fromhex(o["k"])
    if o["op"] == "put":
        return Put(key, bytes.fromhex(o["v"]))
    return Delete(key) if o["op"] == "delete" else Check(key, o["version"] if o["op"] == "version" else o["op"])


class Replayer:
    def __init__(self, spark: SparkSession):
        self.spark, self.store = spark, None

    def run(self, lines, folder: str) -> list[dict]:
        return [self.one(json.loads(line.replace("{DIR}", folder))) for line in lines if line.strip()]

    def one(self, c: dict) -> dict:
        handler = getattr(self, "do_" + str(c.get("cmd")), None)
        if handler is None:
            return {"protocol": f"unknown command {c.get('cmd')!r}"}
        if self.store is None and c["cmd"] not in ("open", "seed_v1"):
            return {"protocol": "no store is open"}
        try:
            return {"ok": handler(c)}
        except ConditionFailed as e:
            return {"err": e.code, "index": e.index}
        except StoreError as e:
            return {"err": e.code}
        except OSError as e:
            return {"err": "Io", "kind": type(e).__name__}

    def do_open(self, c):
        self.store = Store.open(self.spark, c["dir"], Options(KeyOrder.SORTED if c.get("sorted") else KeyOrder.HASHED, c.get("read_only", False), c.get("sync_on_put", False), c.get("max_file_size", 64 << 20)))

    def do_close(self, c):
        self.store.close()
        self.store = None

    def do_drop(self, c):
        self.store.drop()
        self.store = None

    def do_merge(self, c):
        self.store.merge()

    def do_sync(self, c):
        self.store.sync()

    def do_put(self, c):
        self.store.put(bytes.fromhex(c["k"]), bytes.fromhex(c["v"]), c["ts"])

    def do_delete(self, c):
        self.store.delete(bytes.fromhex(c["k"]), c["ts"])

    def do_batch(self, c):
        return self.store.write_batch([_op(o) for o in c["ops"]], c["ts"])

    def do_get(self, c):
        got = self.store.get(bytes.fromhex(c["k"]))
        return None if got is None else got.hex()

    def do_get_versioned(self, c):
        got = self.store.get_versioned(bytes.fromhex(c["k"]))
        return got and {"value": got.value.hex(), "version": got.version}

    def do_list_keys(self, c):
        return [bytes(r["key"]).hex() for r in self.store.list_keys().collect()]

    def do_fold(self, c):
        return self.store.fold(lambda out, k, v: [*out, [k.hex(), v.hex()]], [])

    def do_scan(self, c):
        return [[bytes(r["key"]).hex(), bytes(r["value"]).hex()] for r in self.store.scan(_bound(c["start"]), _bound(c["end"])).collect()]

    def do_scan_page(self, c):
        page = self.store.scan_page(_bound(c["start"]), _bound(c["end"]), Direction.REVERSE if c.get("reverse") else Direction.FORWARD, c["limit"])
        return [[k.hex(), v.value.hex(), v.version] for k, v in page]

    def do_seed_v1(self, c):
        os.makedirs(c["dir"], exist_ok=True)
        native.write_old([(e["ts"], bytes.fromhex(e["k"]), None if e.get("tombstone") else bytes.fromhex(e["v"])) for e in c["entries"]], c["dir"], c["file_id"])
