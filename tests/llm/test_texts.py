"""Operators on texts against brute force, exact round trips and held-out accuracy."""

import base64
import bz2
import hashlib
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest

from kelvane.llm import fingerprints, langid, mixing, pii, piece_codec, queries, secret_scan, token_shards
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra string, spans int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns with names that operators use."""
    texts = [None, "", " \n ", "one", "Ünï cödé", "a b c d e f g", "a b c d e f g", "word " * 30000, "x" * 50000, "\0\x01 ퟿ 😀 ▁", "1234 5678", "@", "a@b.c d"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", "e", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "null id", None, None, None, None)], DOCS)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- language ----

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() and got.count() > 30


def test_language_of_odd_texts(spark, odd):
    got = langid.identify(odd).collect()
    assert len(got) == 15 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 10, 11)) and by[4]["lang_pred"] == "en"
    import zlib as z
    assert all(by[i]["held_out"] == (z.crc32(str(i).encode()) % 3 == 1) for i in range(13)) and by[None]["held_out"] is False
    assert langid.identify(odd.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_hashed_ngrams_stay_within_texts():
    alone = [np.sort(p[p > 0]) for p in langid.hashed(["Abc d"])[0]]
    parts, offsets = langid.hashed(["xyz", "Abc d", ""])
    for a, p in zip(alone, parts, strict=True):
        assert (np.sort(p[offsets[1]:offsets[2]][p[offsets[1]:offsets[2]] > 0]) == a).all()


# ---- personal data ----

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return pii.in_order(out)


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(1)
    pieces = ["a@b.c", "x.y@z", "@", ".", "1.2.3.4", "300.1.1.1", "1", "22", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+", " ", "  ", "-", "é", "mail", "12345678901234567890", "%", "_@a-b.c.d"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(12)))
        assert pii.in_order(pii.base_spans(t)) == plain_pii(t), t


def test_long_runs_are_linear():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "0-" * 100_000):
        pii.base_spans(t)
        secret_scan.scan(t)


def test_network_finds_forms_that_patterns_miss():
    net = pii.default_tagger()
    fresh = pii.made_up(200, seed=5)
    found = pii.proposals(net, [t for t, _ in fresh])
    gold = sum(len(g) for _, g in fresh)
    right = sum(len(set(g) & set(p)) for (_, g), p in zip(fresh, found, strict=True))
    assert right >= 0.8 * gold and sum(map(len, found)) - right <= 0.05 * gold
    assert [pii.proposals(net, ["plain words " * 50 + "in 1984 of 42 pages"])] == [[[]]]


def test_windows_without_a_digit_or_at_yield_nothing(monkeypatch):
    net = pii.default_tagger()
    texts = [("some words and names, " * 20) + t for t, _ in pii.made_up(30, seed=8)]
    with_gate = pii.proposals(net, texts)
    monkeypatch.setattr(pii, "TRIGGER", re.compile(r"(?s)."))
    without = pii.proposals(net, texts)
    keep = re.compile(r"[\d@]")
    assert [[s for s in p if keep.search(t[s[1]:s[2]])] for p, t in zip(without, texts, strict=True)] == with_gate


@pytest.mark.parametrize("inside", [1, 2])
def test_spans_longer_than_windows_are_joined(inside):
    class Sure:
        def decode(self, cls):
            other = [pii.classes_of(np.array([c]))[0] for c in (0, ord("#"))]
            on = ~np.isin(cls, other)
            tags = np.where(on, 2, 0)
            tags[:, 1:][on[:, 1:] & ~on[:, :-1]] = 1
            tags[:, 0] = np.where(on[:, 0], inside, 0)
            return tags, np.zeros((*cls.shape, pii.TAGS))

    for size in (20, 46, 91, 95, 130, 400):
        mail = "j " + "o" * (size - 12) + " @ a.bcde"
        for before in range(3, 103, 7):
            text = "#" * before + mail + "#" * 150
            assert pii.proposals(Sure(), [text, "", text]) == [[("email", before, before + len(mail))], [], [("email", before, before + len(mail))]], (size, before)


def test_gradients_of_the_network():
    net, r = pii.Tagger(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    cls, tags = r.integers(0, pii.CLASSES, (3, 7)), r.integers(0, pii.TAGS, (3, 7))
    _, grads = net.loss(cls, tags)
    for name in ("u1", "w2", "v", "t", "e"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old = net.p[name][at]
        vals = []
        for d in (1e-3, -1e-3):
            net.p[name][at] = old + d
            vals.append(net.loss(cls, tags)[0])
        net.p[name][at] = old
        assert abs((vals[0] - vals[1]) / 2e-3 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


def test_pii_rows_and_redaction(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(50, "write to a.b@mail.org or +1 555 123 4567.", None, None, None, None)], DOCS))
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert (got[50]["n_email"], got[50]["n_phone"]) == (1, 1) and got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    base = plain_pii("write to a.b@mail.org or +1 555 123 4567.")
    assert got[50]["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
    assert set(pii.listed(base).split(",")) <= set(got[50]["spans"].split(","))
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[50]["text"] == "write to [email] or [phone]." and clean[0]["text"] is None and clean[7]["text"] == "word " * 30000 and clean[5]["spans"] == 5


# ---- secrets ----

def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return secret_scan.in_order(out)


def test_base_secrets_are_those_of_the_plain_patterns():
    r = random.Random(2)
    pieces = ["password", "PassWd", "ſecret", "toKen", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef", "abc", "AKIA" + "A1" * 9, "AKIA", "0f" * 11, "0f" * 13, "Z", "/+", "é"]
    for _ in range(4000):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(10)))
        assert secret_scan.scan(t) == plain_secrets(t), t


def test_layers_are_unwrapped_to_the_end():
    inner = "password = hunter2hunter2"
    wraps = [lambda s: base64.b64encode(s.encode()).decode(), lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
             lambda s: base64.b64encode(zlib.compress(s.encode())).decode(), lambda s: base64.urlsafe_b64encode(bz2.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(s.encode(), wbits=31)).decode()]
    for f in wraps:
        for g in wraps:
            body = f(g(inner))
            text = f"see {body} end"
            spans = secret_scan.all_spans(text, [])
            assert any(k == "assign" and a >= 4 and b <= 4 + len(body) for k, a, b in spans), text
    text = "x token%3Dabcdef99 y"
    assert secret_scan.all_spans(text, secret_scan.scan(text)) == [("assign", 2, 18)]
    loop = "%2525" * 50 + base64.b64encode(b"\0" * 64).decode()
    assert secret_scan.all_spans(loop, []) == []
    bomb = base64.b64encode(zlib.compress(b"a" * 50_000_000)).decode()
    assert secret_scan.all_spans(bomb, []) == []
    assert secret_scan.all_spans("plain words, nothing more", []) == []


def test_compressed_layers_of_any_depth_and_number():
    b64 = lambda b: base64.b64encode(b).decode()
    secret = b"\npassword=hunter2hunter2\n"
    deep = secret
    for k in range(20):
        deep = (zlib.compress, bz2.compress)[k % 2](deep)
    two = zlib.compress(b"first", wbits=31) + zlib.compress(secret, wbits=31)
    torn = bz2.compress(b"passw") + bz2.compress(b"ord=hunter2hunter2")
    for body in (b64(deep), b64(two), b64(torn)):
        assert secret_scan.all_spans(body, []) == [("assign", 0, len(body))]
    parts = [b64(zlib.compress(b"%d " % k + b"z " * 400_000 + secret)) for k in range(6)]  # each fits, all six together do not
    text = " ".join(parts)
    assert len(secret_scan.all_spans(text, [])) == 6


def test_base64_glued_to_text_or_wrapped():
    body = base64.b64encode(b"password=hunter22").decode()
    for before in ("https://x.y/api/", "x", "xy", "xyz", "k_", "some-words-"):
        spans = secret_scan.all_spans(before + body, [])
        assert len(spans) == 1 and spans[0][0] == "assign" and spans[0][2] == len(before + body)
    r = random.Random(4)
    noise = "".join(r.choice("ghijklmnop .,") for _ in range(900))
    for raw in ((noise[:41] + " password=hunter2hunter2 " + noise).encode(), zlib.compress((noise + " password=hunter2hunter2 ").encode())):
        for width, end in ((64, "\n"), (76, "\r\n"), (10, "\n  ")):
            flat = base64.b64encode(raw).decode()
            text = "Body" + end + end.join(flat[k:k + width] for k in range(0, len(flat), width)) + end + "Thanks for it"
            assert [k for k, _, _ in secret_scan.all_spans(text, [])] == ["assign"], (width, end)


def test_escapes_are_decoded_where_they_stand():
    found = lambda t: secret_scan.all_spans(t, secret_scan.scan(t))
    for t, start, end in (("my token\\u003d abcdef123456 x", 3, 27), ('{"password"%3A"hunter22"}', 2, 23), ("?q=caf%E9&password%3Dhunter22 x", 10, 29),
                          ("a \\x74oken = abc%64ef%2525 b", 2, 21), ("token%25253D%61bcdef", 0, 20), ("t\\u{6f}ken\\u005cu003dabcdef", 0, 27)):
        assert ("assign", start, end) in found(t), (t, found(t))
    body = zlib.compress(b"password=hunter2hunter2 " * 3, wbits=31)
    for quoted in ("".join(f"%{b:02X}" for b in body), urllib.parse.quote(body), "".join(f"\\x{b:02x}" for b in body)):
        assert found(f"see {quoted} end") == [("assign", 4, 4 + len(quoted))]
    assert len(found("%" + "25" * 200_000 + "41")) <= 1 and found("\\" + "u005c" * 100_000 + "u0041 token") == []


def test_secret_rows(spark, odd):
    got = secret_scan.scan_secrets(odd).collect()
    assert len(got) == 15 and {r["spans"] for r in got} == {""} and {r["n_hex"] for r in got} == {0}


# ---- fingerprints ----

def words5(t):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t or "") if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_against_true_likeness(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    got = rows_of(queries.fingerprints.edited_fingerprints(docs))
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    off = []
    for k, r in enumerate(rows):
        nxt, t = rows[(k + 1) % len(rows)]["text"] or "", r["text"] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for a, b, x in ((t, edited, g["near_edited"]), (t, nxt, g["near_next"])):
            j = len(words5(a) & words5(b)) / max(1, len(words5(a) | words5(b)))
            off.append(x - j)
    assert len(got) == len(rows) and abs(np.mean(off)) < 0.02 and np.abs(off).mean() < 0.04 and np.abs(off).max() < 0.25


def test_fingerprints_of_odd_texts(spark, odd):
    got = fingerprints.edited_fingerprints(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 15 and by[0]["fingerprint"] == by[1]["fingerprint"] == by[2]["fingerprint"] == "" and by[5]["fingerprint"] == by[6]["fingerprint"]
    assert by[7]["n_chars"] == 150000 and by[0]["near_edited"] == 1.0
    assert fingerprints.edited_fingerprints(odd.limit(0)).collect() == []
    one = fingerprints.edited_fingerprints(odd.where("doc_id = 5").limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert "Python" not in fingerprints.edited_fingerprints(odd)._jdf.queryExecution().executedPlan().toString()


# ---- pieces ----

def test_pieces_are_those_of_the_public_encoder(spark, odd):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    codec = piece_codec.Codec(piece_codec.load(queries.vocabulary()))
    r = random.Random(4)
    alphabet = "abc e  \n\té中😀=-"
    texts = ["", " ", "  a  b \n", "x" * 300, "ab" * 400 + " " + "=" * 90, "\0\x01", *["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(300)]]
    texts += [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    ids, at = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == ref.encode(texts, num_threads=1)
    assert codec.decode(ids, at) == [t.encode() for t in texts]
    got = piece_codec.encode(odd, queries.vocabulary())
    by = {x["doc_id"]: x for x in got.collect()}
    assert by[0]["ids"] is None and by[0]["n_tokens"] is None and by[1]["ids"] == [] and by[5]["round_trip"] and by[7]["ids"] == ref.encode("word " * 30000)
    back = {x["doc_id"]: x["text"] for x in piece_codec.decode(got, queries.vocabulary()).collect()}
    assert back[5] == "a b c d e f g" and back[0] is None and back[4] == "Ünï cödé" and back[8] == "x" * 50000


def _field(n, kind, raw):
    return bytes([n << 3 | kind]) + raw


def test_unigram_models_take_the_best_path():
    import itertools
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -2.0, 1), ("a", -2.5, 1), ("b", -2.5, 1), ("ab", -3.5, 1), ("▁ab", -4.2, 1), ("ba", -3.0, 1), ("aba", -5.0, 1)]
    raw = b""
    for p, s, kind in pieces:
        body = _field(1, 2, bytes([len(p.encode())]) + p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, bytes([kind]))
        raw += _field(1, 2, bytes([len(body)]) + body)
    raw += _field(2, 2, b"\x02" + _field(3, 0, b"\x01")) + _field(3, 2, b"\x04" + _field(3, 0, b"\x01") + _field(4, 0, b"\x00"))
    codec = piece_codec.Codec(piece_codec.Model(raw))
    import sentencepiece
    ref = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["".join(x) for n in range(1, 7) for x in itertools.product("ab ", repeat=n)][:600]
    ids, at = codec.encode(texts)
    score = lambda xs: sum(pieces[i][1] for i in xs)
    for t, a, b in zip(texts, at, at[1:]):
        assert abs(score(ids[a:b]) - score(ref.encode(t))) < 1e-4, t


# ---- training order ----

@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = token_shards.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n)) and (token_shards.permute(p, n, back=True) == np.arange(n)).all()
    assert n < 17 or (p != token_shards.permute(np.arange(n), n, key=9)).any()


@pytest.mark.parametrize("ids", [False, True])
def test_shards_hold_each_sequence_once(spark, odd, tmp_path, ids):
    docs = odd.withColumn("ids", F.when(F.col("text").isNotNull(), F.transform(F.sequence(F.lit(0), F.octet_length("text") % 50), lambda i: i * 7))) if ids else odd
    out = f"file://{tmp_path}/shards"
    rows = token_shards.materialise(docs, out, ids_col="ids" if ids else None, length=16, per_shard=64).collect()
    records = list(token_shards.read(out))
    assert len(records) == len(rows) and [r[0] for r in records] == list(range(len(rows))) == sorted(r["slot"] for r in rows)
    whole: dict = {}
    for _, doc, seq, part in records:
        whole.setdefault((doc, seq), []).append(part)
    for d in docs.collect():
        want = np.array(d["ids"] or []) if ids else np.frombuffer((d["text"] or "").encode(), np.uint8)
        parts = [whole[d["doc_id"], k][0] for k in range(-(-len(want) // 16))]
        assert (np.concatenate(parts) == want).all() if len(want) else (d["doc_id"], 0) not in whole
    assert [r[0] for r in token_shards.read(out, 5, 7)] == list(range(5, min(12, len(rows)))) and len(whole[5, 0]) == 2
    assert token_shards.materialise(docs.limit(0), f"file://{tmp_path}/none").collect() == []


def test_query_shards_ids_of_the_vocabulary(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: odd)
    out, real = f"file://{tmp_path}/shards", token_shards.materialise
    monkeypatch.setattr(token_shards, "materialise", lambda docs, **kw: real(docs, out, **kw))
    rows = queries.op3_training_order(spark, None).collect()
    whole: dict = {}
    for _, doc, seq, part in token_shards.read(out):
        whole.setdefault((doc, seq), []).append(part.tolist())
    want: dict = {}
    for d in piece_codec.encode(odd, queries.vocabulary()).collect():
        for k in range(0, len(d["ids"] or []), token_shards.LENGTH):
            want.setdefault((d["doc_id"], k // token_shards.LENGTH), []).append(d["ids"][k:k + token_shards.LENGTH])
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()} and len(rows) == sum(map(len, want.values()))
    for bad in (-1, 1 << 16, None):
        with pytest.raises(Exception, match="null or does not fit"):
            real(spark.createDataFrame([(1, [3, bad])], "doc_id long, ids array<long>"), f"file://{tmp_path}/bad", ids_col="ids").collect()


# ---- mixing ----

def test_exponents_meet_their_targets():
    t = {"a": 1000, "b": 100, "c": 10, "z": 0}
    import math
    for target in (0.5, 0.9, math.log(3) - 0.01):
        assert abs(mixing.entropy(mixing.weights(t, mixing.bisect(t, target_entropy=target))) - target) < 1e-6
    a = mixing.bisect(t, max_repeats=4)
    w = mixing.weights(t, a)
    assert abs(max(w[k] * mixing.least_whole(t, w) / t[k] for k in "abc") - 4) < 1e-6
    assert mixing.bisect(t, max_repeats=1000) == 0 and mixing.bisect(t, target_entropy=0.0) == 1 and mixing.bisect({"a": 5}, max_repeats=1) in (0.0, 1.0)
    assert abs(sum(w.values()) - 1) < 1e-12


@pytest.mark.parametrize("total", [None, 3000.0])
def test_budgets_are_realised(spark, total):
    r = random.Random(6)
    rows = [(i, "w " * r.randrange(0, 30), None, r.choice(["big"] * 20 + ["mid"] * 4 + ["small", None]), None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    per, _ = mixing.plan(docs, max_repeats=3, total=total)
    plan = {p["skey"]: p for p in per.collect()}
    placed = mixing.mix(docs, max_repeats=3, total=total).collect()
    words = {i: len(t.split()) for i, t, *_ in rows}
    for k, p in plan.items():
        mine = [x for x in placed if ("null" if x["source"] is None else "=" + x["source"]) == k]
        used, longest = sum(x["n_tokens"] for x in mine), max(words[x["doc_id"]] for x in mine)
        assert p["budget"] - longest <= used <= p["budget"] and all(x["n_tokens"] == words[x["doc_id"]] for x in mine)
        for e in range(p["epochs"]):
            assert len([x for x in mine if x["epoch"] == e]) == len([1 for _, _, _, s, *_ in rows if ("null" if s is None else "=" + s) == k])
        orders = {e: tuple(b for _, b in sorted({(x["block_rank"], x["block"]) for x in mine if x["epoch"] == e})) for e in range(p["epochs"])}
        assert all(len(set(o)) == len(o) for o in orders.values())
    again = mixing.mix(docs.repartition(7), max_repeats=3, total=total).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, placed))


def test_mixing_odd_rows(spark, odd):
    per, _ = mixing.plan(odd, max_repeats=2)
    out = mixing.realise(odd, per)
    assert out.columns[:6] == odd.columns and out.select("doc_id").distinct().count() == 14 and out.where("doc_id = 5").count() % 2 == 0
    assert mixing.mix(odd.limit(0), max_repeats=2).collect() == []


# ---- brute force: mixing, language scores, fingerprints, the Feistel network ----

def test_mixture_by_brute_force(spark):
    """Which documents the partial epoch takes, remade one document after another from the keys."""
    r = random.Random(16)
    rows = [(i, "w " * r.randrange(0, 30), None, r.choice(["big"] * 9 + ["mid"] * 3 + ["small", None]), None, None) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS)
    for options in ({"max_repeats": 3}, {"target_entropy": 0.9}, {"max_repeats": 2, "total": 2500.0}):
        per, narrow = mixing.plan(docs, **options)
        plan = {p["skey"]: p for p in per.collect()}
        tokens = {}
        for i, t, _, s, *_ in rows:
            k = "null" if s is None else "=" + s
            tokens[k] = tokens.get(k, 0) + len(t.split())
        # the exponent: the largest on a fine grid at which the weights are still as flat as asked for is next to the bisected one
        a = mixing.bisect(tokens, **options)
        total = options.get("total") or max(n / (n ** a / sum(x ** a for x in tokens.values())) for n in tokens.values())
        want = {}
        keyed = narrow.join(per.select("skey", "blocks", "epochs"), "skey").select("*", mixing._block(F.col("doc_id"), F.col("blocks"), mixing.SEED).alias("block"))
        keyed = keyed.select("*", mixing._block_key(F.col("skey"), F.col("block"), F.col("epochs"), mixing.SEED).alias("bkey"), mixing._doc_key(F.col("doc_id"), mixing.SEED).alias("dkey")).collect()
        for k, n in tokens.items():
            budget = int(n ** a / sum(x ** a for x in tokens.values()) * total + 1e-6)
            assert abs(budget - plan[k]["budget"]) <= 1
            epochs, room = divmod(plan[k]["budget"], n)
            mine = sorted((x for x in keyed if x["skey"] == k), key=lambda x: (x["bkey"], x["dkey"]))
            for x in mine:
                want[x["doc_id"]] = epochs
            blocks = {}
            for x in mine:
                blocks.setdefault(x["bkey"], []).append(x)
            for key in sorted(blocks):
                held = sum(x["n_tokens"] for x in blocks[key])
                if held <= room:
                    room -= held
                    for x in blocks[key]:
                        want[x["doc_id"]] += budget % n > 0 or plan[k]["rest"] > 0
                    continue
                for x in blocks[key]:
                    if x["n_tokens"] > room:
                        break
                    room -= x["n_tokens"]
                    want[x["doc_id"]] += plan[k]["rest"] > 0
                break
        got = {}
        for x in mixing.mix(docs, **options).collect():
            got[x["doc_id"]] = got.get(x["doc_id"], 0) + 1
        assert got == {i: n for i, n in want.items() if n}, options


def test_scores_by_plain_naive_bayes():
    """Counts and scores of n-grams in dictionaries, one n-gram at a time."""
    import math

    train = [("aa", "la casa blanca y la otra"), ("aa", "casa de la playa"), ("bb", "the white house and the other"), ("bb", "Where? There!")]
    langs, counts = ["aa", "bb"], np.zeros((2, langid.BUCKETS))

    def grams(t):
        low, out = t.lower(), []
        for n in langid.ORDERS:
            for k in range(len(low) - n + 1):
                h = 0
                for j, c in enumerate(low[k:k + n]):
                    h = (h ^ ord(c)) * int(langid._MULT[j % 3]) & 0xFFFFFFFF
                    h ^= h >> 15
                out.append(((h * 0x27D4EB2F & 0xFFFFFFFF) >> 16) % (langid.BUCKETS - 1) + 1)
        return out

    for lang, t in train:
        for g in grams(t):
            counts[langs.index(lang), g] += 1
        parts, _ = langid.hashed([t])
        assert sorted(x for p in parts for x in p.tolist() if x) == sorted(grams(t))
    seen = {g for _, t in train for g in grams(t)}
    logs = np.zeros((2, langid.BUCKETS), np.float32)
    for k in range(2):
        for g in seen:
            logs[k, g] = math.log(counts[k, g] + langid.ALPHA) - math.log(counts[k].sum() + langid.ALPHA * len(seen))
    texts = ["la casa", "the house", "zzz qqq", "x", "other otra the", "Там дом casa"]
    pred, score = langid.score_texts(texts, langs, np.ascontiguousarray(logs.T))
    for t, p, s in zip(texts, pred, score, strict=True):
        used = [g for g in grams(t) if g in seen]
        mean = [sum(float(logs[k, g]) for g in used) / max(1, len(used)) * min(len(used), langid.EVIDENCE) for k in range(2)]
        e = [math.exp(m - max(mean)) for m in mean]
        best = 0 if mean[0] >= mean[1] else 1
        assert p == langs[best] and abs(s - e[best] / sum(e)) < 1e-6, t


def test_slots_by_a_plain_feistel_network():
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    for n, key in ((1, 3), (2, 3), (5, token_shards.KEY), (1000, token_shards.KEY), (65537, 9)):
        half = 1
        while 1 << 2 * half < n:
            half += 1
        keys = [mix((k * 0x9E3779B97F4A7C15 + key) & mask) for k in range(1, token_shards.ROUNDS + 1)]
        got = token_shards.permute(np.arange(min(n, 3000)), n, key).tolist()
        for i, slot in enumerate(got):
            x = i
            while True:
                left, right = x >> half, x & ((1 << half) - 1)
                for k in keys:
                    left, right = right, left ^ (mix((right + k) & mask) & ((1 << half) - 1))
                x = left << half | right
                if x < n:
                    break
            assert slot == x, (n, i)


def test_shards_do_not_hang_on_input_splits(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(r.randrange(200))), None, None, None, None) for i in range(400)]
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs, was = spark.read.parquet(str(tmp_path / "docs")), spark.conf.get("spark.sql.files.maxPartitionBytes")
    out = f"file://{tmp_path}/shards"
    got = token_shards.materialise(docs, out, length=16, per_shard=64)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        shown = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted(x["slot"] for x in shown) == list(range(len(shown))) == [x[0] for x in token_shards.read(out)]
    text = dict((i, t.encode()) for i, t, *_ in rows)
    for _, doc, seq, part in token_shards.read(out):
        assert part.tobytes() == text[doc][seq * 16:seq * 16 + 16]


def spark_hash(value, seed=42):
    """xxhash64 of a long as Spark has it."""
    mask, p = (1 << 64) - 1, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    rot = lambda x, k: (x << k | x >> (64 - k)) & mask
    h = (seed + p[4] + 8) & mask
    h ^= rot((value & mask) * p[1] & mask, 31) * p[0] & mask
    h = (rot(h, 27) * p[0] + p[3]) & mask
    h = (h ^ h >> 33) * p[1] & mask
    h = (h ^ h >> 29) * p[2] & mask
    return h ^ h >> 32


def test_fingerprints_by_plain_one_permutation_minhash(spark):
    """Bins, minima, densification and low-order bits remade one shingle at a time, over Spark's hashes of the words."""
    r = random.Random(44)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "x%d" % r.randrange(40)]) for _ in range(n))
    texts = [say(n) for n in (1, 2, 4, 5, 6, 9, 40, 300, 1500)] + ["one\ttwo\n three", "é ü é ü é ü é"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["fp"] for x in fingerprints.with_fingerprint(rows, "text", "fp").collect()}
    vocabulary = sorted({w for t in texts for w in t.split()})
    word = {x["w"]: x["h"] for x in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    bins = fingerprints.BINS
    low = (1 << 64 - bins.bit_length() + 1) - 1
    both = lambda a, b, seed=42: spark_hash(b, spark_hash(a, seed))
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def of_int(value, seed=42):  # xxhash64 of an int
        mask = (1 << 64) - 1
        h = (seed + 0x27D4EB2F165667C5 + 4) & mask
        h ^= (value & 0xFFFFFFFF) * 0x9E3779B185EBCA87 & mask
        h = ((h << 23 | h >> 41) & mask) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9 & mask
        h = (h ^ h >> 33) * 0xC2B2AE3D27D4EB4F & mask
        h = (h ^ h >> 29) * 0x165667B19E3779F9 & mask
        return h ^ h >> 32

    for i, t in enumerate(texts):
        run = words = [word[w] for w in t.split()]
        have = 1
        while have < fingerprints.SHINGLE:  # pairs, then fours, then one word more; none where the text has ended
            more = have if 2 * have <= fingerprints.SHINGLE else 1
            other = run if more == have else words
            after = [*other[have:], *[None] * have]
            run = [signed(both(x, y)) if y is not None else signed(spark_hash(x)) for x, y in zip(run, after)]
            have += more
        run = run[:max(1, len(words) - fingerprints.SHINGLE + 1)]
        least = [None] * bins
        for h in run:
            b = (h >> 64 - bins.bit_length() + 1) + bins // 2
            if h & low != low and (least[b] is None or h < least[b]):
                least[b] = h
        out = ""
        for j in range(bins):
            code = least[j]
            for k in range(fingerprints.PROBES):
                if code is None:
                    code = least[signed(of_int(k, of_int(j))) % bins]
            if code is None:
                code = min((signed(spark_hash(c >> 64 - bins.bit_length() + 1, of_int(j))), c) for c in least if c is not None)[1]
            out += "%x" % (of_int(j, spark_hash(code)) & 15)
        assert got[i] == out, (i, t[:40])


# A set written by hand, none of it made by the generator that the network learns from.
BY_HAND = [
    ("Write to anna.berg@post.example.org before Friday.", [("email", "anna.berg@post.example.org")]),
    ("Reach me at j_smith+news@mail.co.uk, thanks", [("email", "j_smith+news@mail.co.uk")]),
    ("The host 192.168.4.17 refused the connection", [("ip", "192.168.4.17")]),
    ("ping 10.0.0.1 and 10.0.0.254 again", [("ip", "10.0.0.1"), ("ip", "10.0.0.254")]),
    ("charged to 4111 1111 1111 1111 in March", [("card", "4111 1111 1111 1111")]),
    ("card no. 5500-0000-0000-0004 expired", [("card", "5500-0000-0000-0004")]),
    ("call +44 20 7946 0958 after six", [("phone", "+44 20 7946 0958")]),
    ("her number is +1 (415) 555-0132.", [("phone", "+1 (415) 555-0132")]),
    ("In 1984 there were 42 pages and 3.5 tons.", []),
    ("Version 2.10.4 was released on 2021-03-04.", []),
    ("The meeting @ noon was moved to room 12.", []),
    ("Order 12345678 shipped in 3 boxes.", []),
]


def test_recall_and_precision_by_hand():
    net = pii.default_tagger()
    found, gold, right, wrong = {}, {}, {}, {}
    for t, want in BY_HAND:
        spans = {(k, t[a:b]) for k, a, b in [*pii.base_spans(t), *pii.proposals(net, [t])[0]]}
        for k, x in want:
            gold[k] = gold.get(k, 0) + 1
            right[k] = right.get(k, 0) + ((k, x) in spans)
        for k, _ in spans - set(want):
            wrong[k] = wrong.get(k, 0) + 1
    print({k: (right[k], gold[k], wrong.get(k, 0)) for k in gold}, found)
    assert all(right[k] >= 0.9 * gold[k] for k in gold) and sum(wrong.values()) <= 1


def test_codec_forgets_and_still_encodes(monkeypatch):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdeé\n") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(60))) for _ in range(200)]
    model = piece_codec.load(queries.vocabulary())
    want = piece_codec.Codec(model).encode(texts)
    monkeypatch.setattr(piece_codec, "CACHE", 100)
    codec, got = piece_codec.Codec(model), []
    for k in range(0, 200, 5):
        ids, offsets = codec.encode(texts[k:k + 5])
        got += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [want[0][a:b].tolist() for a, b in zip(want[1], want[1][1:])]


def test_pieces_are_packed_once_for_the_same_letters(monkeypatch):
    r = random.Random(6)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(5, 30))) for _ in range(400)]
    real, calls = piece_codec._packed, []
    monkeypatch.setattr(piece_codec, "_packed", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(piece_codec, "LEARN", 500)
    with open(queries.vocabulary(), "rb") as f:
        codec = piece_codec.Codec(piece_codec.Model(f.read()))
    codec.encode([" ".join(["abcde", *words])])
    assert len(codec.known) > 300 and len(calls) == 2


def test_segments_of_all_lengths_join_as_by_definition():
    model = piece_codec.load(queries.vocabulary())
    number = {model.pieces[i]: i for i in model.normal}
    r = random.Random(7)
    lengths = sorted({0, 1, 2, piece_codec.LONG + 1, *(w + d for w in piece_codec.WIDTHS for d in (-1, 0, 1))})
    for alphabet in ("\x01\x02", "ab", "▁etainrs", "é中\n😀a=", "".join(r.sample([model.pieces[i] for i in model.normal], 300))):
        segments = ["".join(r.choice(alphabet) for _ in range(n)) for n in lengths * 3]
        ids, at = piece_codec.encode_segments(segments, model)
        for s, a, b in zip(segments, at, at[1:], strict=False):
            parts = list(s)
            while True:
                pairs = [(-model.scores[number[x + y]], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in number]
                if not pairs:
                    break
                k = min(pairs)[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            want = [i for p in parts for i in ([number[p]] if p in number else [model.bytes[x] for x in p.encode()])]
            assert ids[a:b].tolist() == want, s
