"""Joins and dedup against brute force, in groups large enough to reach each way through them."""

import random
import re
import time

import numpy as np
import pytest

from kelvane.llm import chunk_dedup, common, embed_dedup, jaccard_join

DOCS = "doc_id long, text string, lang string, digest string, leader int"
TOP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)]
    want = roots({x for e in links for x in e}, links)
    got = {x["id"]: x["component"] for x in common.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in set(want) - set(got))
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_staged_tables_leave_no_shuffle_files(spark):
    def held():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before, conf = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(10000).selectExpr("id % 100 AS k", "id").groupBy("k").count()  # held, so that no garbage collection removes what it shuffled
    assert common.staged(df, "t").count() == 100 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf
    for _ in range(50):
        if not (left := {x for x in held() - before if x.endswith(".data")}):
            break
        time.sleep(0.2)
    assert len(left) <= 4  # of the count above, a row for each of 4 tasks at most
    assert df.count() == 100


def words(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TOP))
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n=3, percent=90):
    sets = [(i, words(t, n)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return roots([i for i, _ in rows], links), dict(sets)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["w%d" % k for k in range(60)] + ["The", "the", "É"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    out = [None, "", " \t ", "one", "one", "ONE", "one two", "one  two", "one two three", "é a", "É a"]
    for size in (5, 9, 12, 15, 21, 24, 40, 90, 200):  # copies with edits at the end, in the middle, and chains of them
        base = say(size)
        for _ in range(14):
            t = list(base)
            for _ in range(r.randrange(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocab)
            if r.random() < 0.3:
                t = t[:-r.randrange(1, 3)] or t
            if r.random() < 0.2:
                base = t
            out.append(" ".join(t))
    passage = say(30)
    out += [" ".join(passage + say(r.randrange(3, 40))) for _ in range(30)]
    out += [" ".join(passage + passage[:r.randrange(6)]) for _ in range(6)]
    r.shuffle(out)
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_jaccard_components(spark, seed, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 8)  # so that groups are split
    rows = corpus(seed)
    want, sets = brute(rows, width, percent)
    df = spark.createDataFrame([(i, t, None, "x", 1) for i, t in rows], DOCS)
    got = {r["doc_id"]: r for r in jaccard_join.connect(df, width=width, percent=percent).collect()}
    assert len(got) == len(rows)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    kept = jaccard_join.first_of_each(df, width=width, percent=percent)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c} and kept.columns == df.columns


@pytest.mark.parametrize("boundary", [0, 12, 20])
def test_any_boundary_gives_the_same(spark, boundary, monkeypatch):
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda *_: boundary)
    rows = corpus(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.connect(spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DOCS)).collect()}
    assert got == brute(rows)[0]


def test_jaccard_of_odd_rows(spark):
    rows = [(1, "a b c d", None, None, None), (1, "a b c d", None, None, None), (2, "A b c  d", None, None, None), (None, "a b c d", None, None, None), (3, None, None, None, None), (4, "y " * 40000, None, None, None), (5, "y " * 40001, None, None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.connect(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3), (4, 1, 4), (5, 1, 4)], key=str)
    assert jaccard_join.connect(spark.createDataFrame([], DOCS)).collect() == []


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(4)
    for n in (3, 40, 900, 1100, 4100):
        base = np.unique(r.integers(0, 2**63, n * 2).astype(np.uint64))[:n]
        other = np.unique(r.integers(0, 2**63, n * 2).astype(np.uint64))[:n]
        for change in (0, 1, n // 20, n // 8):
            t = np.unique(np.concatenate([base[change:], other[:change // 2]]))
            both = len(np.intersect1d(base, t))
            diff = jaccard_join._differ(jaccard_join._sketch(base), jaccard_join._sketch(t))
            assert diff <= n + len(t) - 2 * both
            for percent in (80, 90):
                if 100 * both >= percent * (n + len(t) - both):
                    assert jaccard_join._may_link(np.array([n]), np.array([len(t)]), np.array([diff]), percent)[0]
            assert jaccard_join._least(n, len(t), diff) <= 1 - both / (n + len(t) - both) + 1e-12
        if n >= 40:
            far = jaccard_join._differ(jaccard_join._sketch(base), jaccard_join._sketch(other))
            assert not jaccard_join._may_link(np.array([n]), np.array([n]), np.array([far]), 80)[0]


def test_overlap_is_the_least_that_links():
    for s in range(1, 40):
        for t in range(s, 45):
            o = jaccard_join.overlap(s, t)
            assert 100 * o >= 90 * (s + t - o) and 100 * (o - 1) < 90 * (s + t - o + 1)


def vectors(seed, n=240, dim=24):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n // 6):
        c = r.standard_normal(dim)
        for _ in range(6):
            rows.append((c + r.standard_normal(dim) * r.choice([0, 0.1, 0.3, 0.4])) * r.choice([1, 1, 2.5]))
    rows += [rows[0]] * 40 + [rows[0] + r.standard_normal(dim) * 0.05 for _ in range(60)]
    return rows


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PART", 20)
    rows = vectors(2)
    out = [(k, [float(x) for x in v], k % 2 if k % 11 else None, "x") for k, v in enumerate(rows)]
    n = len(out)
    out += [(n, None, 1, "x"), (n + 1, [], 1, "x"), (n + 2, [0.0] * 24, 1, "x"), (n + 3, [float("nan")] + [1.0] * 23, 1, "x"), (n + 4, [None] + [1.0] * 23, 1, "x"), (n + 5, [1.0, 0.0], 1, "x"), (n + 6, [2.0, 0.0], 1, "x"), (n + 7, [1e300, 1e-300], 1, "x"), (n + 8, [float("inf"), 1.0], 1, "x")]
    df = spark.createDataFrame(out, "vec_id long, embedding array<double>, label int, cid string")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    ok = [(i, np.array(v), l) for i, v, l, _ in out if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v, _ in ok}
    links = [(i, j) for k, (i, v, l) in enumerate(ok) for j, w, m in ok[:k] if l == m and len(v) == len(w) and unit[i] @ unit[j] >= 0.93]
    want = roots([x[0] for x in out], links)
    count = {i: 0 for i in want}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (count[i], want[i], want[i] == i) for i in want}
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_each_linked_pair_comes_once(spark):
    rows = vectors(3, 60)
    classes = spark.createDataFrame([(k, 1, [float(x) for x in v]) for k, v in enumerate(rows)], "cid long, label long, v array<double>")
    got = [tuple(r) for r in embed_dedup.links(classes).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)


def test_chunks_cover_texts_and_resist_insertions():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(20000))
    ends = chunk_dedup.cuts(np.frombuffer(data, np.uint8))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunk_dedup.MAX and sizes[:-1].min() >= chunk_dedup.MIN
    parts = lambda d: {d[a:b] for e in [chunk_dedup.cuts(np.frombuffer(d, np.uint8))] for a, b in zip([0, *e], e)}
    moved = data[:7000] + b"inserted here" + data[7000:]
    assert len(parts(data) - parts(moved)) <= 4
    h = chunk_dedup.rolling(np.frombuffer(data[:200], np.uint8))
    slow = 0
    for k, b in enumerate(data[:200]):
        slow = (slow * 2 + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        assert h[k] == slow & 0xFFFF


def test_passages(spark):
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    passage = say(60)
    rows = [(k, say(80), None, None, None) for k in range(40)] + [(100 + k, say(r.randrange(50)) + " " + passage + " " + say(30), None, None, None) for k in range(12)]
    copy = say(100)
    rows += [(300, copy, None, None, None), (301, copy, None, None, None), (301, copy, None, None, None), (400, None, None, None, None), (401, "", None, None, None), (None, copy, None, None, None), (402, "z" * 30000, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = chunk_dedup.passages(docs).collect()
    assert {x["doc_id"] for x in got} - {402} == {*range(100, 112), 300, 301}
    assert all(x["first_doc_id"] == (100 if x["doc_id"] < 200 else 300) and x["kept"] == (x["doc_id"] in (100, 300)) for x in got if x["doc_id"] != 402)
    texts = {}
    for x in chunk_dedup.without_repeats(docs.where("doc_id <> 402")).collect():
        texts.setdefault(x["doc_id"], x["text"])
    assert texts[0] == rows[0][1] and texts[100] == rows[40][1] and len(texts[101]) < len(rows[41][1]) - 200 and texts[400] is None
    assert chunk_dedup.passages(spark.createDataFrame([], DOCS)).collect() == []


def test_passages_of_repeated_rows_are_whole(spark):
    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    long, other, shared = say(5000), say(300), say(400)
    rows = [(1, long), (1, long), (2, long), (3, other), (4, other), (4, other), (4, other), (5, say(50) + " " + shared), (5, say(90) + " " + shared), (6, say(9) + " " + shared)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = sorted(tuple(x[c] for c in ("doc_id", "start", "end", "kept", "n_copies")) for x in chunk_dedup.passages(docs).collect())
    whole = lambda i, t, kept, n: (i, 0, len(t), kept, n)
    assert [g for g in got if g[0] < 5] == [whole(1, long, True, 3), whole(2, long, False, 3), whole(3, other, True, 4), whole(4, other, False, 4)]
    assert sum(e - s > len(shared) - 200 for i, s, e, _, _ in got if i == 5) == 2 and [k for i, _, _, k, _ in got if i == 5].count(True) == 1
    left = [x["text"] for x in chunk_dedup.without_repeats(docs).collect()]
    assert sorted(len(t) for t in left)[:4] == [0, 0, 0, 0] and left.count(long) == 2 and left.count(rows[7][1]) == 1


def test_passages_without_spaces_and_short_copies(spark):
    r = random.Random(12)
    thai = "".join(chr(r.randrange(0xE01, 0xE2F)) for _ in range(400))
    token = "".join(r.choice("abcdefghijklmnop0123456789") for _ in range(3000))
    rows = [(1, thai), (2, thai), (3, token), (4, token), (5, "a short note"), (6, "a short note"), (7, "ok"), (8, "ok"), (9, "not again")]
    got = {(x["doc_id"], x["start"], x["end"], x["kept"]) for x in chunk_dedup.passages(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()}
    assert got == {(i, 0, len(t.encode()), i % 2 == 1) for i, t in rows if i < 9}


def plain_passages(rows):
    """The passages by dictionaries, one chunk after another."""
    at = {}
    texts = sorted({(i, t.encode()) for i, t in rows if i is not None and t})
    cut = {x: list(zip([0, *(e := chunk_dedup.cuts(np.frombuffer(x[1], np.uint8)))], e)) for x in texts}
    for i, t in rows:
        if i is not None and t:
            for a, b in cut[i, t.encode()]:
                at.setdefault(t.encode()[a:b], []).append((i, a))
    out = []
    for i, t in texts:
        run = []
        for a, b in [*cut[i, t], (None, None)]:
            held = a is not None and len(at[t[a:b]]) > 1
            first = held and min(at[t[a:b]])
            if run and (not held or (first == (i, a)) != run[0][2]):
                start, end = run[0][0], run[-1][1]
                # words that begin in the passage, the same way as for one chunk: at its start, or after a gap
                n = sum(1 for k in range(start, end) if t[k:k + 1] not in b" \n\t\r" and (k == 0 or t[k - 1:k] in b" \n\t\r"))
                if n >= chunk_dedup.MIN_WORDS or end - start >= chunk_dedup.MIN_WORDS * chunk_dedup.BYTES_A_WORD or (start, end) == (0, len(t)):
                    out.append((i, start, end, n, min(x[3] for x in run), max(x[4] for x in run), run[0][2]))
                run = []
            if held:
                run.append((a, b, first == (i, a), first[0], len(at[t[a:b]])))
    return sorted(out)


def test_passages_by_brute_force(spark):
    r = random.Random(21)
    say = lambda n: " ".join("".join(r.choice("abcdefghé\u0e01") for _ in range(r.randrange(1, 12))) for _ in range(n))
    shared = [say(n) for n in (20, 35, 60, 200)]
    rows = []
    for k in range(60):
        t = say(r.randrange(60))
        for _ in range(r.randrange(3)):
            t += r.choice([" ", "\n", ""]) + r.choice(shared) + " " + say(r.randrange(30))
        rows.append((k // 2 * 2 if k % 10 == 0 else k, t))
    rows += [rows[5], rows[5], (500, rows[7][1]), (None, rows[7][1]), (501, None), (502, "")]
    got = chunk_dedup.passages(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()
    assert sorted(tuple(x[c] for c in ("doc_id", "start", "end", "n_words", "first_doc_id", "n_copies", "kept")) for x in got) == plain_passages(rows)


def test_recall_of_short_passages():
    """Pairs of texts that share exactly n words: in how many a run of shared chunks is long enough to be reported."""
    r = random.Random(22)
    say = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvw") for _ in range(r.randrange(2, 10))) for _ in range(n))
    found = {}
    for n in (17, 25, 35, 51):
        hits = 0
        for _ in range(200):
            passage = say(n)
            parts = []
            for _ in range(2):
                t = f"{say(30)} {passage} {say(30)}".encode()
                e = chunk_dedup.cuts(np.frombuffer(t, np.uint8))
                parts.append([t[a:b] for a, b in zip([0, *e], e)])
            run, best, other = b"", 0, set(parts[1])
            for c in [*parts[0], b""]:
                if c and c in other:
                    run += c
                else:
                    best, run = max(best, len(run) if len(run) >= chunk_dedup.MIN_WORDS * chunk_dedup.BYTES_A_WORD or run.count(b" ") >= chunk_dedup.MIN_WORDS else 0), b""
            hits += best > 0
        found[n] = hits / 200
    assert found[51] >= 0.98 and found[17] <= found[25] <= found[35] <= found[51], found
    print(found)


def test_blocks_test_few_pairs():
    """Pairs that a block is tested on, of all pairs and blocks: the slabs and windows leave out most."""
    r = np.random.default_rng(8)
    v = embed_dedup._unit(r.standard_normal((3000, 64)))
    tests: list[int] = []
    assert not list(embed_dedup.linked(v, np.zeros(3000, int), tests=tests))
    assert len(tests) == 8 and sum(tests) / (3000 * 2999 / 2) < 4, sum(tests) / (3000 * 2999 / 2)


def test_labels_are_compared_in_their_own_type(spark):
    rows = [(1, [1.0, 0.0], 1.2, "a"), (2, [1.0, 0.0], 1.7, "b"), (3, [1.0, 0.0], 1.2, "b"), (4, [0.99, 0.01], 1.7, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label double, name string")
    got = lambda label: sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, label_col=label).collect())
    assert got("label") == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False), (4, 1, 2, False)]
    assert got("name") == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 1, False)]


def test_counts_and_spanning_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PART", 30)
    rows = vectors(5, 120)
    classes = spark.createDataFrame([(k, 2000 - k, 1 + k % 3, "l%d" % (k % 2), [float(x) for x in v]) for k, v in enumerate(rows)], "cid long, least long, n long, label string, v array<double>")
    pairs = [tuple(r) for r in embed_dedup.links(classes).collect()]
    more = {}
    for a, b in pairs:
        more[a], more[b] = more.get(a, 0) + 1 + b % 3, more.get(b, 0) + 1 + a % 3
    found = embed_dedup.link_counts(classes).collect()
    got = {}
    for x in found:
        got[x["cid"]] = got.get(x["cid"], 0) + x["more"]
        assert x["least"] == 2000 - x["cid"]
    assert got == more
    ids = [2000 - k for k in range(len(rows))]
    assert roots(ids, [(x["least"], x["root"]) for x in found]) == roots(ids, [(2000 - a, 2000 - b) for a, b in pairs])
