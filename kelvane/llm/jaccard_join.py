"""N-gram Jaccard join: a size-aware heavy-light join (after Deng, Tao and Li, SIGMOD 2018).

Documents are sets of word shingles; equal sets form one class. Light classes (at most `boundary`
shingles) enumerate subsets: two sets of s <= t shingles link exactly if they share a subset of the
least overlap o(s, t) that the threshold asks of these sizes, so each set emits the hashes of its
subsets of o elements for every size it may link with, and classes that meet under (s, t, subset) are linked,
with no pair formed: all of one side are tied to the first of the other. Heavy classes scan inverted
lists: shingles are put in one global order, rare ones first, and two sets that link must share one of their
first |set| - o + 1 shingles, so only these are listed. The boundary is chosen by cost: for each candidate the
subsets to enumerate are set against the entries of the lists that it would save, from the counts of sizes.

The lists are scanned without forming all pairs. Each list has a leader, the member whose own lists are
longest (in a group of near copies that is the one nearest to all), and each member is compared
with its leaders alone (sizes and small sketches rule most unrelated pairs out, without error, before texts are moved). Distance d (1 - Jaccard) is a metric: two members of a cluster (all that share a leader)
can link only if their distances to it differ by no more than the threshold, and members that are already
connected need no comparison. What is left, members of different components in neighbouring bands of
d, meets in blocks of at most 2 * PART documents. So every list is exhausted, no group grows with a list, and
a large group of near copies costs as many comparisons as it has members, not pairs.

The order: a shingle comes first whose rarest word is in the fewest documents, then by its other words, then by
hash. Words, not shingles, are counted: a fixed number of buckets of word hashes tells rare words from common ones at any size of the
corpus, where buckets of shingles would all fill up alike. Counts cover all documents; the order is total in any case and
results do not depend on it. Lists are split by bands of sizes, as sets that link have sizes in one band or in two neighbouring ones.

Texts are read twice, and again for sets that meet others: for their sketches, and for pairs to measure. What moves is a row of two longs for each entry of a list; an equal set
is listed once a task. Text: A-Z lower-cased, words split by space and \\t to \\r. Null or empty text and text
without words: an empty set, linked with nothing. A null id: its row stays, with a null component, and links with nothing. A
repeated id is one document with several texts. Extra columns are not read. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, in_pieces, lean, staged

SHINGLE, PERCENT, BUCKETS, SLICES = 3, 90, 1 << 20, 256
KEY_BITS = 40  # of a shingle's hash that name its list: lists that clash are one, which adds candidates and loses none
LIGHT_SIZES = range(4, 21)
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_GAPS = bytes(1 if b in b" \t\n\x0b\x0c\r" else 0 for b in range(256))


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Least intersection of sets of s and t elements that link: 100 i >= percent (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS = {}


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2^64."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        have = _POWERS["p"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(0x9E3779B97F4A7C15 | 1))]).astype(np.uint64))
    return have[:n]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, in their order (uint64)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER)
    data = np.frombuffer(raw, np.uint8)
    gap = np.frombuffer(raw.translate(_GAPS), np.uint8) == 1
    word = ~gap
    if not word.any():
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(word & np.concatenate([gap[1:], [True]])) + 1
    # a word's hash: its bytes weighed by powers from the word's start, mixed
    at = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    vals = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(at.max()) + 1)[at]
    vals[gap] = 0
    return _mix(np.add.reduceat(vals, starts) + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _joined(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles in their order: of `width` words, or of all if there are fewer."""
    k = min(width, len(words))
    h = np.full(len(words) - k + 1 if k else 0, k, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0xE7037ED1A0B428DB) + words[i:len(words) - k + 1 + i])
    return h


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending (uint64)."""
    return np.unique(_joined(word_hashes(text), width))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(44)).astype(np.intp)


def _ranked(words: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """The set of a text in the global order: by the count of the rarest word, by the product of all counts, by hash."""
    s, at = np.unique(_joined(words, width), return_index=True)
    k = min(width, len(words))
    logs = np.log(np.maximum(counts[_bucket(words)], 1).astype(np.float32))
    windows = np.lib.stride_tricks.sliding_window_view(logs, k)
    # sums in one order of the counts: the same shingle has the same sum anywhere
    return s[np.lexsort((s, np.sort(windows, 1).sum(1)[at], windows.min(1)[at]))]


def _add_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums one slice of the buckets over tasks, a batch at a time."""
    total = np.zeros(BUCKETS // SLICES, np.int64)
    for b in batches:
        for x in b.column(b.schema.get_field_index("counts")).to_pylist():
            total += np.frombuffer(x, np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


SURVEY = "doc_id long, n_shingles int, digest binary, cls long, slice int, counts binary"


def _survey(rows: DataFrame, width: int) -> DataFrame:
    """A row for each document: the size of its set, its digest, the digest's first 64 bits. And, in rows that have a
    slice, how many documents of a task hold a word of each bucket (its hash's top 20 bits)."""
    part = BUCKETS // SLICES

    @lean
    def run(batches):
        total = np.zeros(BUCKETS, np.int32)
        for ids, texts in in_pieces(batches, ["doc_id", "text"]):
            sets = []
            for t in texts:
                words = word_hashes(t)
                np.add.at(total, np.unique(_bucket(words)), 1)
                sets.append(np.unique(_joined(words, width)))
            marks = [_digest(s) if len(s) else None for s in sets]
            yield _record({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int32()), "digest": pa.array(marks, pa.binary()), "cls": pa.array([None if m is None else _class(m) for m in marks], pa.int64())})
        held = [k for k in range(SLICES) if total[k * part:(k + 1) * part].any()]
        yield _record({"slice": pa.array(held, pa.int32()), "counts": pa.array([total[k * part:(k + 1) * part].tobytes() for k in held], pa.binary())})

    return staged(rows.mapInArrow(run, SURVEY), "survey")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _record(cols: dict) -> pa.RecordBatch:
    """A batch of SURVEY; columns that are not given are null."""
    n = len(next(iter(cols.values())))
    names = [f.split() for f in SURVEY.split(", ")]
    return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(n, _KINDS[kind])) for c, kind in names], [c for c, _ in names])


def word_counts(survey: DataFrame) -> np.ndarray:
    """How many documents hold a word of each bucket; what moves depends on the tasks and not on the words."""
    rows = survey.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_add_counts, "slice int, counts binary").collect()
    out = np.zeros(BUCKETS, np.int64)
    part = BUCKETS // SLICES
    for r in rows:
        out[r["slice"] * part:(r["slice"] + 1) * part] = np.frombuffer(r["counts"], np.int64)
    return out


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The boundary of least cost. sizes: how many classes have each size, up to the largest that may be light."""
    def subsets(s):
        return sum(math.comb(s, overlap(min(s, t), max(s, t), percent)) for t in range(s * percent // 100, s * 100 // percent + 1) if t > 0 and overlap(min(s, t), max(s, t), percent) <= min(s, t))

    def prefix(s):
        return s - overlap(s, -(-s * percent // 100), percent) + 1

    best, least = 0, None
    for b in LIGHT_SIZES:
        # an entry of a list also has to be verified, with all of its set: it weighs its size more
        cost = sum(n * (subsets(s) if s <= b else prefix(s) * (1 + s / 8)) for s, n in sizes.items())
        if least is None or cost < least:
            best, least = b, cost
    return best


def _subset_keys(s: np.ndarray, boundary: int, percent: int):
    """(smaller size, larger size, hash of the subset) for each subset that a light partner may share."""
    n = len(s)
    for t in range(max(1, n * percent // 100), min(boundary, n * 100 // percent) + 1):
        lo, hi = min(n, t), max(n, t)
        o = overlap(lo, hi, percent)
        if o > lo:
            continue
        whole = np.add.reduce(s)
        for out in itertools.combinations(range(n), n - o):
            left = whole - np.add.reduce(s[list(out)]) if out else whole
            yield lo, hi, left


def connect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row. A repeated id counts as one document with several
    texts: each row is compared, and its component is shared."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = _survey(rows, width)
    order = docs.sparkSession.sparkContext.broadcast(word_counts(survey).astype(np.uint32))  # 4 MB, whatever the input
    members = survey.where("slice is null").select("doc_id", "n_shingles", "digest", "cls")
    full = members.where("digest is not null and doc_id is not null")
    classes = staged(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("cls").alias("cls")), "classes")
    sizes = {r["n"]: r["c"] for r in classes.where(F.col("n") <= max(LIGHT_SIZES)).groupBy("n").agg(F.count("*").alias("c")).collect()}
    boundary = choose_boundary(sizes, percent)
    keys = _keys(rows, order, boundary, width, percent)
    edges = staged(_light(keys.where("lo > 0"), classes), "light").unionByName(_heavy(keys, rows, classes, width, percent))
    # links go between classes; an id with several texts ties their classes
    several = full.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("doc_id")
    tied = full.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(edges.unionByName(tied.where("a <> b")), "documents")
    reached = staged(classes.select("digest", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "reached")
    out = members.where("digest is not null").select("doc_id", "n_shingles", "digest").join(reached, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    # a row without words has its own id, or what another text of its id reaches
    empty = members.where("digest is null").select("doc_id", "n_shingles")
    other = full.select("doc_id", "digest").join(empty.select("doc_id"), "doc_id", "left_semi").join(reached, "digest").groupBy("doc_id").agg(F.min("component").alias("component"))
    alone = empty.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that have a linked one with a smaller id; rows with a null id stay."""
    gone = staged(connect(docs, id_col=id_col, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    # texts of rows that the bitmap rules out stay where they are
    held, bit = _bitmap(gone.select(F.col("__id").alias("id")))
    key = F.col(f"`{id_col}`").cast("long")
    marked = docs.withColumn("__slot", _slot(key)).join(F.broadcast(held.select(F.col("word").alias("__word"), F.col("held").alias("__held"))), F.expr("__slot div 64") == F.col("__word"), "left")
    marked = marked.withColumn("__may", F.coalesce(bit("__held", "__slot"), F.lit(False)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where("not __may").select(*columns).unionByName(marked.where("__may").select(*columns).join(gone, key == F.col("__id"), "left_anti"))


def _digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _class(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


SKETCH, SKETCHED = 256, 1000


def _sketch(s: np.ndarray) -> bytes:
    """A byte for each of some parts of all shingles: the sum, modulo 256, of mixed hashes of those in the part.

    Where two sketches differ, so do the sets, in a shingle of that part: sets whose symmetric difference is d
    differ in d bytes at most. This rules pairs out without error. Large sets have 4, 16, ... times SKETCH parts, so that
    unrelated ones differ in more bytes than linked ones may; sums of parts make a smaller sketch of a larger one."""
    parts = SKETCH
    while len(s) > SKETCHED * (parts // SKETCH):
        parts *= 4
    part = ((s >> np.uint64(20)) % np.uint64(parts)).astype(np.intp)
    return np.bincount(part, weights=(_mix(s) & np.uint64(255)).astype(np.float64), minlength=parts).astype(np.int64).astype(np.uint8).tobytes()


def _sketches(ids: DataFrame, rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, n, sketch) of the classes that go by these documents. Made where the texts are, for texts that a bitmap of ids does not rule
    out, so that only the sketches of sets that meet others are moved or stored."""
    some = _maybe(rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text"), ids)

    @lean
    def make(batches):
        seen = set()
        for held, texts in in_pieces(batches, ["id", "text"]):
            out = []
            for i, t in zip(held, texts, strict=True):
                s = shingles(t, width)
                mark = _digest(s) if len(s) else None
                if mark is None or (i, mark) in seen:
                    continue
                seen.add((i, mark))
                out.append((i, mark, len(s), _sketch(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), [pa.int64(), pa.binary(), pa.int32(), pa.binary()], strict=True)], ["id", "digest", "n", "sketch"])

    made = some.mapInArrow(make, "id long, digest binary, n int, sketch binary")
    # a document that has several texts stands only for the classes in which it is the smallest
    own = classes.select(F.col("rep").alias("id"), "digest").join(ids, "id", "left_semi")
    return made.join(own, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("id", "n", "sketch")


def _folded(sketch: bytes, parts: int) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8).reshape(-1, parts).sum(0, dtype=np.uint8)


def _differ(a: bytes, b: bytes) -> int:
    parts = min(len(a), len(b))
    return int((_folded(a, parts) != _folded(b, parts)).sum())


def _keys(rows: DataFrame, order, boundary: int, width: int, percent: int) -> DataFrame:
    """(lo, hi, key, n, cls), a class once a task. lo > 0: subsets of light sets, for sizes lo and hi. lo = 0: entries of the inverted
    lists of all sets that a heavy one may link with, their prefixes in the global order. cls may stand for several classes
    (64 bits of a digest); all of them are then taken."""
    floor = max(1, -(-(boundary + 1) * percent // 100))

    @lean
    def emit(batches):
        counts, seen = order.value, set()
        for ids, texts in in_pieces(batches, ["doc_id", "text"]):
            light: list[tuple] = []
            tokens, owners, sizes = [], [], []
            for i, t in zip(ids, texts, strict=True):
                words = word_hashes(t)
                if i is None or not len(words):
                    continue
                s = _ranked(words, counts, width)
                mark = _digest(np.sort(s))
                if mark in seen:
                    continue
                seen.add(mark)
                n, cls = len(s), _class(mark)
                if n <= boundary:
                    light += [(lo, hi, int(np.uint64(k).view(np.int64)), n, cls) for lo, hi, k in _subset_keys(s, boundary, percent)]
                if n >= floor:
                    take = n - overlap(-(-n * percent // 100), n, percent) + 1
                    tokens.append(s[:take])
                    owners.append(np.full(take, cls, np.int64))
                    sizes.append(np.full(take, n))
            names = ["lo", "hi", "key", "n", "cls"]
            if light:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*light, strict=True), [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names)
            if tokens:
                key = (np.concatenate(tokens) >> np.uint64(64 - KEY_BITS)).view(np.int64)
                zero = pa.array(np.zeros(len(key), np.int32))
                yield pa.RecordBatch.from_arrays([zero, zero, pa.array(key), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(owners))], names)

    return staged(rows.mapInArrow(emit, "lo int, hi int, key long, n int, cls long"), "keys")


def _light(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """Links among light sets, through shared subsets."""
    # the first of the smaller and of the larger sets; equal sizes are both sides at once
    firsts = staged(keys.groupBy("lo", "hi", "key").agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("cls"))).alias("small"), F.min(F.when(F.col("n") == F.col("hi"), F.col("cls"))).alias("large"), F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y and small is not null and large is not null").drop("x", "y"), "firsts")
    met = keys.join(firsts, ["lo", "hi", "key"]).select(F.col("cls").alias("a"), F.when(F.col("n") == F.col("lo"), F.col("large")).otherwise(F.col("small")).alias("b")).where("a <> b").distinct()
    rep = lambda side: classes.select(F.col("cls").alias(side), F.col("rep").alias(f"rep_{side}"))
    return met.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _heavy(keys: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of sets with more than boundary shingles (and any between these and smaller ones). A class goes by its smallest document.
    keys, staged, is read here for the last time and removed."""
    tokens = keys.where("lo = 0").select("key", "n", "cls")
    counted = tokens.groupBy("key").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count("*").alias("c"), F.min("n").alias("s"), F.max("n").alias("t"))
    shared = staged(counted.where(f"x <> y and (c > 2 or 100 * s >= {percent} * t)").drop("s", "t"), "shared")
    # most lists hold two sets, which the count has found; the same two have many, and are one pair
    two = shared.where("c = 2").select("x", "y").distinct()
    two = two.join(classes.select(F.col("cls").alias("x"), F.col("rep").alias("leader"), F.col("n").alias("leader_n")), "x").join(classes.select(F.col("cls").alias("y"), F.col("rep").alias("id"), "n"), "y").drop("x", "y")
    met = tokens.select("key", "cls").join(shared.where("c > 2").select("key"), "key").join(classes.select("cls", F.col("rep").alias("id"), "n"), "cls")
    # a list is split by bands of sizes; a set is held in its own and shown to the next
    band = F.floor(F.log("n") / -math.log(percent / 100) + 1e-9) if percent < 100 else F.col("n").cast("long")
    split = met.select("key", "id", "n", band.alias("band"), F.explode(F.array(F.lit(True), F.lit(False))).alias("own"))
    split = split.groupBy(F.xxhash64("key", F.when(F.col("own"), F.col("band")).otherwise(F.col("band") + 1)).alias("token"), "id", "n").agg(F.max("own").alias("own"))
    listed = staged(split, "lists")
    discard(keys)
    # near copies share many lists: of those that hold the same sets, by two hashes of all their members, one is scanned
    member = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "id", "n"))
    length = listed.groupBy("token").agg(F.count("*").alias("m"), F.max("own").alias("own"), F.min("id").alias("x"), F.max("id").alias("y"), member(1).alias("h1"), member(2).alias("h2")).where("own and x <> y")
    length = staged(length.groupBy("m", "h1", "h2").agg(F.min("token").alias("token")).select("token", "m"), "lengths")
    entries = staged(listed.join(length, "token").select("token", "id", "n", "m"), "entries")
    discard(listed)
    weight = staged(entries.groupBy("id").agg((F.sum("m") / F.max("n")).alias("weight")), "weights")
    leader = staged(entries.join(weight, "id").groupBy("token").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"), F.col("n").alias("n"))).alias("l")).select("token", (-F.col("l.id")).alias("leader"), F.col("l.n").alias("leader_n")), "leaders")
    led = staged(entries.select("token", "id", "n").join(leader, "token"), "led")
    pairs = staged(led.select("leader", "leader_n", "id", "n").distinct(), "stars")
    pairs = staged(pairs.unionByName(two).distinct(), "pairs")
    sketches = staged(_sketches(pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct(), rows, classes, width), "sketches")
    # sizes rule out most unrelated pairs before sketches are moved
    apart = pairs.where("id <> leader").withColumn("ratio", F.least("n", "leader_n") / F.greatest("n", "leader_n"))
    by_size = apart.where(F.least("n", "leader_n") * 100 < F.greatest("n", "leader_n") * percent).select("leader", "id", F.lit(False).alias("possible"), (1 - F.col("ratio")).alias("lo"))
    stars = staged(by_size.unionByName(_rule_out(apart.where(F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent).select("leader", "id").distinct(), sketches, percent)), "bounds")
    near = staged(_measured(stars.where("possible").select("leader", "id").distinct(), rows, width, percent), "distances")
    linked = near.where("linked").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    comp = staged(components(linked, "stars"), "star-components")
    # members that were measured meet others of their leader's cluster; members that were ruled out, those of their lists
    delta = 1 - percent / 100 + 1e-9
    centre = pairs.select("leader").distinct().select("leader", F.col("leader").alias("id"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    known = near.select("leader", "id", F.col("d").alias("lo"), F.col("d").alias("hi")).unionByName(centre).distinct()
    far = stars.where("not possible").select("leader", "id", "lo", F.lit(2.0).alias("hi"))
    places = staged(known.unionByName(far), "places")
    listed = staged(led.select("token", "leader", "id").join(places, ["leader", "id"]).select("token", "id", "lo", "hi"), "list-places")
    least = staged(listed.where("hi > 1").groupBy("token").agg(F.min("lo").alias("least")), "far-lists")
    by_list = listed.join(least, "token").where(f"hi > 1 or hi >= least - {delta}").select(F.col("token").alias("group"), F.lit(True).alias("far"), "id", "lo", "hi")
    by_cluster = places.where("hi <= 1").select(F.col("leader").alias("group"), F.lit(False).alias("far"), "id", "lo", "hi")
    groups = staged(by_list.unionByName(by_cluster), "groups")
    # first, of each block, the links that would tie its components most closely; then all pairs of what is still apart
    found = staged(_blocks(groups, comp, sketches, percent, True), "found")
    ties = staged(_measured(staged(found.select("leader", "id").distinct(), "candidates"), rows, width, percent), "ties")
    # a group in which no pair was possible has none now
    groups = groups.join(found.select("group", "far").distinct(), ["group", "far"], "left_semi")
    linked = linked.unionByName(ties.where("linked").select(F.col("id").alias("a"), F.col("leader").alias("b")))
    apart = _blocks(groups, staged(components(linked, "tied"), "tied-components"), sketches, percent, False).select("leader", "id").distinct()
    more = _measured(staged(apart.join(ties.select("leader", "id"), ["leader", "id"], "left_anti"), "candidates"), rows, width, percent)
    return linked.unionByName(more.where("linked").select(F.col("id").alias("a"), F.col("leader").alias("b")))


def _rule_out(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(leader, id, possible, lo): whether sizes and sketches let the pair link, and the least distance that
    the sketches allow."""
    @lean
    def look(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            n, m = col("n").to_numpy(zero_copy_only=False).astype(np.int64), col("m").to_numpy(zero_copy_only=False).astype(np.int64)
            diff = np.array([_differ(x, y) for x, y in zip(col("sketch").to_pylist(), col("other").to_pylist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([col("leader"), col("id"), pa.array(_may_link(n, m, diff, percent), pa.bool_()), pa.array(_least(n, m, diff), pa.float64())], ["leader", "id", "possible", "lo"])

    joined = pairs.join(sketches, "id").join(sketches.select(F.col("id").alias("leader"), F.col("n").alias("m"), F.col("sketch").alias("other")), "leader")
    return joined.mapInArrow(look, "leader long, id long, possible boolean, lo double")


def _may_link(n, m, diff, percent: int):
    """Whether sets of n and m shingles that differ in diff at least can link: the overlap is (n + m - difference) / 2."""
    return (diff <= n + m - 2 * -(-percent * (n + m) // (100 + percent))) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _least(n, m, diff):
    """The least distance of such sets: by the difference, and by the sizes alone."""
    return np.maximum(2 * diff / (n + m + diff), 1 - np.minimum(n, m) / np.maximum(n, m))


BITS = 1 << 23


def _slot(c):
    return F.pmod(F.xxhash64(c), F.lit(BITS))


def _bitmap(ids: DataFrame):
    """(a table of BITS hashed ids, 131,072 rows at most, to broadcast; the test of a slot in it)."""
    words = ids.select(_slot("id").alias("s")).groupBy(F.expr("s div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("held"))
    return staged(words, "bitmap"), lambda held, slot: F.expr(f"(shiftrightunsigned({held}, cast({slot} % 64 as int)) & 1) = 1")


def _maybe(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df (id, ...) whose id is in a broadcast bitmap of ids: all that are among ids, and few others."""
    held, bit = _bitmap(ids)
    some = df.withColumn("__slot", _slot("id")).withColumn("word", F.expr("__slot div 64")).join(F.broadcast(held), "word")
    return some.where(bit("held", "__slot")).select(*df.columns)


def _among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df (id, ...) whose id is among ids. The bitmap leaves out most of the others before rows are moved; the join decides."""
    return _maybe(df, ids).join(ids.select("id"), "id", "left_semi")


def _texts_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts (doc_id, text) of ids; rows that are the same come once."""
    some = _among(rows.select(F.col("doc_id").alias("id"), "text"), ids)
    return some.groupBy("id", F.sha2("text", 256).alias("__mark")).agg(F.first("text").alias("text")).select(F.col("id").alias("doc_id"), "text")


def _measured(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(leader, id, d, linked) for each pair, from whole texts. Leaders' texts meet their members' in a join that
    adaptive execution may split; the last leader's set is kept, as its rows come together."""
    ids = staged(pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct(), "ids")
    texts = staged(_texts_of(ids, rows), "near-texts")

    @lean
    def measure(batches):
        last, base = None, None
        for leads, lead_texts, ids, texts_ in in_pieces(batches, ["leader", "lead_text", "id", "text"]):
            d, ok = [], []
            for x, y in zip(lead_texts, texts_, strict=True):
                if x is not last and x != last:
                    last, base = x, shingles(x, width)
                s = shingles(y, width)
                both = len(np.intersect1d(base, s, assume_unique=True))
                union = len(base) + len(s) - both
                d.append(1 - both / max(1, union))
                ok.append(bool(both) and 100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([pa.array(leads, pa.int64()), pa.array(ids, pa.int64()), pa.array(d, pa.float64()), pa.array(ok, pa.bool_())], ["leader", "id", "d", "linked"])

    joined = pairs.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").join(texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("lead_text")), "leader")
    return joined.select("leader", "lead_text", "id", "text").mapInArrow(measure, "leader long, id long, d double, linked boolean")


PART = 512


def _blocks(groups: DataFrame, comp: DataFrame, sketches: DataFrame, percent: int, ties: bool) -> DataFrame:
    """Pairs (leader, id), and their group, still to be measured: members of one group (a cluster or, with far, a list) that are in different components
    so far and that neither their distances from its leader (between lo and hi) nor sizes and sketches rule out.
    far: only pairs with a member whose distance is not known. ties: of the pairs that meet in a block only a forest over their
    components, of those whose sketches differ least, so that there are no more pairs than members."""
    delta = 1 - percent / 100 + 1e-9
    group = ["leader", "far"]
    cluster = groups.join(comp, "id", "left").select(F.col("group").alias("leader"), "far", "id", "lo", "hi", F.coalesce("component", "id").alias("comp"), F.when(F.col("hi") <= 1, F.floor(F.col("lo") / delta)).otherwise(F.lit(-1) - F.floor(F.col("lo") / delta)).alias("band"))
    cluster = staged(cluster, "members")
    mixed = staged(cluster.groupBy(*group).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x <> y").select(*group, (F.col("c") <= PART).alias("small")), "mixed")
    # a group that is one block needs no bands: distances are looked at pair by pair
    one = F.when(F.col("small"), F.when(F.col("far"), -1).otherwise(0)).otherwise(F.col("band"))
    cluster = staged(cluster.join(mixed, group).withColumn("band", one).drop("small"), "clusters")
    # a component with many members in a band has parts of its own, which need not meet; the rest share parts
    sizes = cluster.groupBy(*group, "band", "comp").agg(F.count("*").alias("m"))
    kind = F.when(F.col("m") > PART, F.col("comp")).otherwise(F.lit(None).cast("long"))
    kinds = staged(sizes.select(*group, "band", "comp", F.coalesce(kind, F.lit(-(1 << 63))).alias("kind"), "m"), "kinds")
    parts = staged(kinds.groupBy(*group, "band", "kind").agg(F.ceil(F.sum("m") / PART).cast("int").alias("parts")), "part-counts")
    placed = cluster.join(kinds.drop("m"), [*group, "band", "comp"]).join(parts, [*group, "band", "kind"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = staged(placed.select(*group, "id", "lo", "hi", "comp", "band", "kind", "part"), "parts")
    p = placed.groupBy(*group, "band", "kind", "part").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    left, right = (p.select(*group, *[F.col(c).alias(f"{c}{k}") for c in ("band", "kind", "part", "c1", "c2", "lo", "hi")]) for k in "lr")
    meets = left.join(right, group).where(f"lol <= hir + {delta} and lor <= hil + {delta} and (bandl, kindl, partl) <= (bandr, kindr, partr)").where("not (c1l = c2l and c1r = c2r and c1l = c1r) and (not far or bandl < 0 or bandr < 0)")
    meets = staged(meets.select(*group, "bandl", "kindl", "partl", "bandr", "kindr", "partr"), "meetings")
    block = [f"b{k}" for k in range(len(meets.columns))]
    sides = meets.select(*[F.col(c).alias(b) for c, b in zip(meets.columns, block, strict=True)], *group, F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("band", "kind", "part")]) for k in "lr"]))).alias("p"))
    rows = sides.select(*block, *group, "p.*").join(placed, [*group, "band", "kind", "part"]).select(*block, "far", "id", "lo", "hi", "comp").join(sketches, "id")

    @lean
    def meet(batches):
        for g in runs_of(batches, block):
            lo, hi, n, comps, ids, sketch = (g[c] for c in ("lo", "hi", "n", "comp", "id", "sketch"))
            n, one_far, out = n.astype(np.int64), bool(g["far"][0]), []
            length = np.array([len(x) for x in sketch])
            sk = {parts: np.stack([_folded(x, parts) if len(x) >= parts else np.zeros(parts, np.uint8) for x in sketch]) for parts in set(length.tolist())}
            for i in range(len(ids) - 1):
                j = np.arange(i + 1, len(ids))
                j = j[(comps[j] != comps[i]) & (lo[j] <= hi[i] + delta) & (lo[i] <= hi[j] + delta)]
                if one_far and hi[i] <= 1:
                    j = j[hi[j] > 1]
                if not len(j):
                    continue
                diff = np.zeros(len(j), np.int64)
                for parts, at in sk.items():
                    same = np.minimum(length[j], length[i]) == parts
                    diff[same] = (at[j[same]] != at[i]).sum(1)
                may = _may_link(n[j], n[i], diff, percent)
                if may.any():
                    j = j[may]
                    out.append(np.stack([diff[may], np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i]), comps[j], np.full(len(j), comps[i])], 1))
            if out:
                both = np.concatenate(out)
                if ties:
                    both = _forest(both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))])
                where = [pa.array([g[b][0]] * len(both), kind) for b, kind in (("b0", pa.int64()), ("b1", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*where, pa.array(both[:, 1]), pa.array(both[:, 2])], ["group", "far", "leader", "id"])

    # one group after another in sorted partitions: a call for each of many small groups would cost more than its work
    return rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(meet, "group long, far boolean, leader long, id long")


def _forest(pairs: np.ndarray) -> np.ndarray:
    """The rows (.., .., .., component, component) that tie components not tied by rows before them."""
    up: dict[int, int] = {}

    def find(x):
        while x in up:
            x = up[x]
        return x
    keep, need = [], len(np.unique(pairs[:, 3:])) - 1
    for k, (a, b) in enumerate(pairs[:, 3:].tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(k)
            if len(keep) == need:
                break
    return pairs[keep]


def runs_of(batches, keys: list[str]):
    """Columns (arrays, or lists of bytes) of each run of rows with equal keys; a run may span batches."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            cols = {f.name: b.column(k).to_pylist() if pa.types.is_binary(f.type) else b.column(k).to_numpy(zero_copy_only=False) for k, f in enumerate(b.schema)}
            if not b.num_rows:
                continue
            held = cols if held is None else {c: held[c] + v if isinstance(v, list) else np.concatenate([held[c], v]) for c, v in cols.items()}
        if held is None:
            return
        size = len(held[keys[0]])
        change = np.zeros(size - 1, bool)
        for c in keys:
            change |= held[c][1:] != held[c][:-1]
        ends = (np.flatnonzero(change) + 1).tolist() + ([size] if b is None else [])
        start = 0
        for end in ends:
            yield {c: v[start:end] for c, v in held.items()}
            start = end
        held = {c: v[start:] for c, v in held.items()}
