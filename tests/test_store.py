import io
import os
import random

import pytest

from kelvane import cli
from kelvane.metrics import Metrics
from kelvane.model import (
    UNBOUNDED,
    AlreadyLocked,
    BatchTooLarge,
    Check,
    CompactedAway,
    ConditionFailed,
    Delete,
    Direction,
    EmptyKey,
    KeyOrder,
    Options,
    Put,
    ReadOnly,
    Unordered,
    Versioned,
    excluded,
    included,
    validate,
)
from kelvane.replay import Replayer
from kelvane.sources import loadgen, native
from kelvane.sources.store import Store
from kelvane.streaming.upsert import upsert
from pyspark.sql import functions as F

SORTED = Options(KeyOrder.SORTED)


def data(path):
    return [n for n in os.listdir(path) if n not in ("LOCK", "MANIFEST")]


def contents(s):
    return {bytes(r["key"]): (bytes(r["value"]), r["version"]) for r in s.live().collect()}


def test_batches_and_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store.open(spark, path, SORTED) as s:
        assert data(path) == [] and s.is_empty()
        assert s.write_batch([]) is None and s.write_batch([Check(b"k", "absent"), Delete(b"k")]) is None and data(path) == []
        assert s.put(b"gone", b"x", 5) == 1
        v = s.write_batch([Put(b"a", b"1"), Put(b"b", b"2"), Delete(b"gone")])
        assert v == 2 and contents(s) == {b"a": (b"1", 2), b"b": (b"2", 2)}
        assert s.write_batch([Put(b"k", b"1"), Delete(b"k"), Put(b"k", b"3")]) == 3 and s.get(b"k") == b"3"
        with pytest.raises(ConditionFailed) as e:
            s.write_batch([Put(b"other", b""), Check(b"k", "exists"), Check(b"k", 4), Put(b"k", b"new")])
        assert e.value.index == 2 and s.next_seq == 4 and s.get(b"other") is None
        assert s.write_batch([Put(b"n", b"1"), Check(b"n", "absent")]) == 4  # checks see the state before
        assert s.write_batch([Put(b"j", b"1"), Delete(b"j")]) == 5 and s.get(b"j") is None
        with pytest.raises(EmptyKey):
            s.write_batch([Put(b"ok", b""), Put(b"", b"")])
        with pytest.raises(EmptyKey):
            s.write_batch([Check(b"", "absent")])
        assert s.submit([Check(b"a", "absent")]).exception().index == 0
        assert s.get_versioned(b"a") == Versioned(b"1", 2) and s.get(b"nobody") is None
        # a group is decided in order, each batch seeing those before
        got = s.commit_group([[Check(b"g", "absent"), Put(b"g", b"1")], [Check(b"g", "absent"), Put(b"g", b"2")], [Check(b"g", 6), Put(b"g", b"3")]])
        assert got[0] == 6 and isinstance(got[1], ConditionFailed) and got[2] == 7 and s.get_versioned(b"g") == Versioned(b"3", 7)
        before = contents(s)
    with Store.open(spark, path, SORTED) as s:
        assert contents(s) == before and s.next_seq == 8 and s.key_order is KeyOrder.SORTED and len(s) == len(before)


def test_sizes_are_checked_before_anything_is_written():
    class Huge(bytes):
        def __len__(self):
            return 2**31

    with pytest.raises(BatchTooLarge):
        validate([Put(b"k", Huge()), Put(b"k", Huge())])


def test_locks_snapshots_merge_and_time(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        Store.open(spark, path, Options(read_only=True))
    seen = []

    class M(Metrics):
        def record_merge_summary(self, files, copied):
            seen.append((files, copied))

    s = Store.open(spark, path, Options(KeyOrder.SORTED, metrics=M()))
    s.merge()
    assert data(path) == []
    with pytest.raises(AlreadyLocked):
        Store.open(spark, path)
    for i in range(4):
        s.put(b"k%d" % (i % 2), b"v%d" % i)
    s.delete(b"k1")
    old = s.snapshot()
    was = contents(s)
    assert {bytes(r["key"]) for r in s.as_of(2).collect()} == {b"k0", b"k1"}
    s.merge()
    assert contents(s) == was == {b"k0": (b"v2", 3)} and seen == [(5, 1)]
    s.put(b"k0", b"later")
    assert {bytes(r["key"]): bytes(r["value"]) for r in old.collect()} == {b"k0": b"v2"}  # still readable
    with pytest.raises(CompactedAway):
        s.as_of(2)
    s.delete(b"k0")
    s.merge()
    assert s.next_seq == 8 and contents(s) == {}
    reader = Store.open(spark, path, Options(read_only=True))
    for write in (lambda: reader.put(b"a", b""), lambda: reader.delete(b"a"), reader.merge, lambda: reader.write_batch([])):
        with pytest.raises(ReadOnly):
            write()
    reader.sync()
    s.close()
    with Store.open(spark, path) as again:
        assert again.put(b"k0", b"new") == 8  # versions never come back
        with pytest.raises(Unordered):
            again.scan()
        with pytest.raises(Unordered):
            again.scan_page(UNBOUNDED, UNBOUNDED, Direction.FORWARD, 1)


def test_scans_sql_and_fold(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), SORTED) as s:
        s.write_batch([Put(k.encode(), v.encode()) for k, v in (("apple-ii", "1977"), ("ibm-pc", "1981"), ("bbc-micro", "1981"), ("zx-spectrum", "1982"), ("c64", "1982"))])
        for _ in range(2):
            assert [bytes(r["key"]) for r in s.scan(included(b"b"), excluded(b"j")).collect()] == [b"bbc-micro", b"c64", b"ibm-pc"]
            assert [k for k, _ in s.scan_page(UNBOUNDED, excluded(b"d"), Direction.FORWARD, 3)] == [b"apple-ii", b"bbc-micro", b"c64"]
            assert s.scan_page(excluded(b"c64"), excluded(b"d"), Direction.FORWARD, 3) == []
            assert {bytes(r[0]) for r in s.sql("SELECT DISTINCT value WHERE key BETWEEN 'a' AND 'j'").collect()} == {b"1977", b"1981", b"1982"}
            assert s.fold(lambda out, k, v: [*out, k], []) == [b"apple-ii", b"bbc-micro", b"c64", b"ibm-pc", b"zx-spectrum"]
            s.merge()
        assert s.explain("SELECT * WHERE key = 'c64'") == "Get 'c64' (get: one lookup)\n"
        rows = s.live().select("key", "value", F.lit(False).alias("tombstone"))
        assert s.write_frame(rows.where("key = binary('c64')").withColumn("value", F.lit(b"!"))) == 2 and s.get_versioned(b"c64") == Versioned(b"!", 2)
        assert s.write_frame(spark.createDataFrame([(bytearray(b"nobody"), None, True)], "key binary, value binary, tombstone boolean")) is None
        out = str(tmp_path / "native")
        s.export_native(out)
        assert {bytes(r["key"]) for r in native.read_native(spark, out).collect()} == set(contents(s)) and native.next_seq_of(out) == 3


@pytest.mark.parametrize("seed", range(3))
def test_against_a_model(spark, tmp_path, seed):
    """Random commands in groups, with merges and reopenings, against a dictionary."""
    r, path, model, seq = random.Random(seed), str(tmp_path / "s"), {}, 1
    s = Store.open(spark, path, SORTED)
    key = lambda: bytes([r.choice(b"abcdef")])
    for _ in range(6):
        batches, want = [], []
        for _ in range(r.randrange(1, 12)):
            ops = []
            for _ in range(r.randrange(5)):
                k, kind = key(), r.randrange(9)
                ops.append(Put(k, bytes(r.randrange(256) for _ in range(r.randrange(8)))) if kind < 4 else Delete(k) if kind < 6 else Check(k, r.choice(["absent", "exists", model.get(k, (0, 1))[1]])))
            failed = next((i for i, o in enumerate(ops) if isinstance(o, Check) and not o.holds(model[o.key][1] if o.key in model else None)), None)
            wrote, now = False, dict(model)
            if failed is None:
                for o in ops:
                    if isinstance(o, Put):
                        now[o.key], wrote = (o.value, seq), True
                    elif isinstance(o, Delete) and o.key in now:
                        del now[o.key]
                        wrote = True
            batches.append(ops)
            want.append(("failed", failed) if failed is not None else seq if wrote else None)
            if wrote:
                model, seq = now, seq + 1
        got = s.commit_group(batches)
        assert [("failed", g.index) if isinstance(g, ConditionFailed) else g for g in got] == want
        if r.random() < 0.4:
            s.merge()
        if r.random() < 0.4:
            s.close()
            s = Store.open(spark, path, SORTED)
        assert contents(s) == model and s.next_seq == seq
    s.close()


# ---- the binary format ----

def scan_bytes(raw):
    return list(native.scan_file(io.BytesIO(raw), len(raw)))


def test_damage_is_told_apart():
    one, two = native.encode_record(1, 9, [(b"a", b"1"), (b"b", None)]), native.encode_record(2, 9, [(b"c", b"")])
    raw = native.file_header(1) + one + two
    assert [x[3] for x in scan_bytes(raw)] == [[(b"a", b"1", 24 + 24 + 9), (b"b", None, 24 + 24 + 19)], [(b"c", b"", len(raw))]]
    for cut in range(24 + len(one) + 1, len(raw)):  # the whole last record or nothing
        got = scan_bytes(raw[:cut])
        assert len(got) == 2 and isinstance(got[1], native.Truncated)
    for at in range(24 + 8, 24 + len(one)):  # behind the length
        bad = bytearray(raw)
        bad[at] ^= 4
        got = scan_bytes(bytes(bad))
        assert type(got[0]) is native.Corrupt and got[1][1] == 2
    long = bytearray(raw)
    long[24 + 4:24 + 8] = b"\xff\xff\xff\x7f"
    assert type(scan_bytes(bytes(long))[0]) is native.Truncated
    assert native.identify(b"") == 2 == native.identify(b"ybc") == native.identify(raw) and native.identify(b"\0\0\0\0\0\0\0\0\0") == 1
    head = native.file_header(77)
    assert native.seq_floor(head) == 77 and native.seq_floor(head[:20]) == 0 and native.seq_floor(head[:9] + b"\1" + head[10:]) == 0


def test_hints_are_taken_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path)
    native.write_old([(5, b"k", b"v1"), (6, b"gone", b"x"), (7, b"gone", None)], folder, 0, [(1, 5, 2, 17, b"k")])
    rows = native.read_native(spark, folder, True).collect()
    assert [(bytes(r["key"]), r["seq"], r["value_pos"]) for r in rows] == [(b"k", 1, 17)]
    hint = os.path.join(folder, native.hint_name(0))
    raw = open(hint, "rb").read()
    assert native.decode_hint(raw, 18) is None  # past the end
    open(hint, "wb").write(raw[:-1] + bytes([raw[-1] ^ 1]))
    assert native.read_native(spark, folder, True).count() == 3
    new = native.encode_hint([(9, 1, 2, 3, b"k")])
    assert native.decode_hint(new) == [(9, 1, 2, 3, b"k")] and native.decode_hint(new[:-1]) is None


def test_old_stores_are_taken_in(spark, tmp_path):
    path = str(tmp_path / "s")
    native.write_old([(1700000000, b"a", b"a-old"), (1700000000, b"b", b"b-1"), (1700000000, b"gone", b"x"), (1700000000, b"gone", None)], path, 0)
    native.write_old([(1700000001, b"a", b"a-new")], path, 1)
    open(os.path.join(path, "notes.txt"), "w").close()
    with Store.open(spark, path, SORTED) as s:
        assert contents(s) == {b"a": (b"a-new", 1), b"b": (b"b-1", 1)} and s.put(b"c", b"") == 2


def test_replayed_traces(spark, tmp_path):
    hx = lambda t: t.encode().hex()
    mixed = ['{"cmd":"seed_v1","dir":"{DIR}","file_id":0,"entries":[{"k":"%s","v":"%s","ts":5},{"k":"%s","v":"%s","ts":6},{"k":"%s","tombstone":true,"ts":7}]}' % (hx("old"), hx("v1"), hx("kept"), hx("k"), hx("x")),
             '{"cmd":"open","dir":"{DIR}","sorted":true}', '{"cmd":"get_versioned","k":"%s"}' % hx("old"), '{"cmd":"put","k":"%s","v":"%s","ts":1}' % (hx("old"), hx("v2")),
             '{"cmd":"batch","ops":[{"op":"absent","k":"%s"},{"op":"put","k":"%s","v":"00"}],"ts":2}' % (hx("new"), hx("new")), '{"cmd":"batch","ops":[{"op":"version","k":"%s","version":1},{"op":"put","k":"61","v":""}],"ts":2}' % hx("old"),
             '{"cmd":"merge"}', '{"cmd":"scan_page","start":{"excl":"%s"},"end":null,"reverse":true,"limit":2}' % hx("kept"), '{"cmd":"fold"}', '{"cmd":"scan","start":null,"end":{"incl":"%s"}}' % hx("new"), '{"cmd":"list_keys"}', '{"cmd":"nonsense"}', '{"cmd":"put","k":"","v":"","ts":1}', '{"cmd":"close"}', '{"cmd":"sync"}']
    got = Replayer(spark).run(mixed, str(tmp_path / "m"))
    assert got[2] == {"ok": {"value": hx("v1"), "version": 1}} and got[4] == {"ok": 3} and got[5] == {"err": "ConditionFailed", "index": 0}
    assert got[7] == {"ok": [[hx("old"), hx("v2"), 2], [hx("new"), "00", 3]]} and got[8]["ok"][0] == [hx("kept"), hx("k")] and got[10]["ok"] == [hx("kept"), hx("new"), hx("old")]
    assert "protocol" in got[11] and got[12] == {"err": "EmptyKey"} and got[13] == {"ok": None} and "protocol" in got[14]
    reuse = ['{"cmd":"open","dir":"{DIR}","sorted":true}', '{"cmd":"put","k":"61","v":"","ts":1}', '{"cmd":"delete","k":"61","ts":2}', '{"cmd":"merge"}', '{"cmd":"close"}', '{"cmd":"open","dir":"{DIR}"}', '{"cmd":"put","k":"61","v":"","ts":5}', '{"cmd":"get_versioned","k":"61"}', '{"cmd":"get","k":"62"}', '{"cmd":"scan","start":null,"end":null}']
    got = Replayer(spark).run(reuse, str(tmp_path / "r"))
    assert got[7] == {"ok": {"value": "", "version": 3}} and got[8] == {"ok": None} and got[9] == {"err": "Unordered"}


def test_command_line(spark, tmp_path):
    run = lambda *a: (lambda o, e: (cli.main([str(tmp_path / "s"), *a], spark, o, e), o.getvalue(), e.getvalue()))(io.StringIO(), io.StringIO())
    assert run("add", "c64", "1982")[0] == 0 and run("get", "c64") == (0, "1982\n", "") and run("list")[1] == "c64\n"
    code, _, err = run("get", "amiga")
    assert code == 1 and "key not found" in err
    assert run("sql", "SELECT value")[1].endswith("(1 row)\n") and "^ expected key" in run("sql", "SELECT * WHERE value = 'x'")[2]
    assert run("merge")[0] == 0 and run("rm", "c64")[0] == 0 and run("list")[1] == "" and run("dance")[0] == 2


def test_stream_of_operations(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "seq long, op_idx int, key binary, value binary, tombstone boolean"
    spark.createDataFrame([(1, 0, bytearray(b"a"), bytearray(b"1"), False), (2, 0, bytearray(b"a"), bytearray(b"2"), False), (3, 0, bytearray(b"b"), bytearray(b"x"), False)], schema).coalesce(1).write.parquet(src)
    with Store.open(spark, str(tmp_path / "s")) as s:
        run = lambda **kw: upsert(spark.readStream.schema(schema).parquet(src), s, str(tmp_path / "cp"), **kw).awaitTermination()
        run()
        assert {k: v for k, (v, _) in contents(s).items()} == {b"a": b"2", b"b": b"x"}
        spark.createDataFrame([(4, 0, bytearray(b"b"), None, True), (5, 0, bytearray(b"c"), bytearray(b"y"), False)], schema).coalesce(1).write.mode("append").parquet(src)
        run(per_group=1)
        assert {k: v for k, (v, _) in contents(s).items()} == {b"a": b"2", b"c": b"y"}
        n = s.next_seq
        assert s.commit_group([[Put(b"z", b"")]], token=("stream", 0)) == [None] and s.next_seq == n


def test_a_failure_before_publication_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    """A micro-batch of the executors' way whose driver fails when it publishes is delivered again, and counts once."""
    src, schema = str(tmp_path / "in"), "seq long, op_idx int, key binary, value binary, tombstone boolean"
    spark.createDataFrame([(k, 0, bytearray(b"k%d" % k), bytearray(b"v"), False) for k in range(50)], schema).coalesce(1).write.parquet(src)
    with Store.open(spark, str(tmp_path / "s")) as s:
        run = lambda: upsert(spark.readStream.schema(schema).parquet(src), s, str(tmp_path / "cp"), per_group=5).awaitTermination()
        publish, calls = s._publish, []

        def fails_after(manifest):
            publish(manifest)
            calls.append(1)
            raise RuntimeError("the driver goes down")

        monkeypatch.setattr(s, "_publish", fails_after)
        with pytest.raises(Exception, match="goes down"):
            run()
        monkeypatch.setattr(s, "_publish", publish)
        run()
        assert len(calls) == 1 and s.log().count() == 50 and s.next_seq == 2 and len(s) == 50
        # and before: files that no manifest names do not count
        spark.createDataFrame([(100 + k, 0, bytearray(b"m%d" % k), bytearray(b"v"), False) for k in range(20)], schema).coalesce(1).write.mode("append").parquet(src)

        def fails_before(manifest):
            raise RuntimeError("the driver goes down")

        monkeypatch.setattr(s, "_publish", fails_before)
        with pytest.raises(Exception, match="goes down"):
            run()
        monkeypatch.setattr(s, "_publish", publish)
        run()
        assert s.log().count() == 70 and s.next_seq == 3 and len(s) == 70


def test_groups_take_linear_time(spark, tmp_path):
    import time

    took = []
    for n in (2_000, 20_000):
        with Store.open(spark, str(tmp_path / str(n))) as s:
            began = time.perf_counter()
            got = s.commit_group([[Put(b"%d" % k, b"")] for k in range(n)])
            took.append(time.perf_counter() - began)
            assert got == list(range(1, n + 1))
    assert took[1] < 20 * took[0] + 2


def test_frames_are_checked(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        for key, value in ((b"", b"v"), (None, b"v"), (b"k", None)):
            with pytest.raises(Exception, match="key must not be empty|needs a value"):
                s.write_frame(spark.createDataFrame([(key, value, False)], "key binary, value binary, tombstone boolean"))
        assert s.next_seq == 1 and s.is_empty()


def test_load(spark):
    n = {r["op"]: r["count"] for r in loadgen.workload(spark, 11_000).groupBy("op").count().collect()}
    assert abs(n["get"] - 8000) < 300 and abs(n["put"] - 2000) < 200 and abs(n["delete"] - 1000) < 150
    log = loadgen.as_log(loadgen.workload(spark, 500, keys=10))
    assert log.where("tombstone and value is not null").count() == 0 and log.select("key").distinct().count() <= 10
