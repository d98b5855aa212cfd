"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A text's UTF-8 is cut where the gear hash of the last 16 bytes falls under a threshold, so cuts depend on
the bytes nearby alone and an insertion shifts none but its own. Chunks have MIN to MAX bytes, MEAN more
than MIN on average. A chunk's digest is 64 bits of XXH3. Digests that occur more than once are joined back;
neighbouring repeated chunks become passages, reported if they have MIN_WORDS words, or BYTES_A_WORD bytes for each of so many (scripts
without spaces), or are their whole text (a repeated passage of 50
words always has a run of whole chunks about as long; single small chunks, and the rare equal digests
of different chunks, stay below).

The first occurrence of a chunk (smallest document, then position) is the one that stays.
Null or empty text: no chunks. A repeated id: its rows count as one document's, and passages are those of each of its
different texts (told apart by 32 bits of a hash); a row that comes again has its passages reported once. Null ids are left out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_pieces, staged

MIN, MEAN, MAX = 8, 24, 128
MIN_WORDS, BYTES_A_WORD = 16, 8


def _gear() -> np.ndarray:
    """One number for each byte, by a rule: the finaliser of splitmix64."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2h + gear[byte] at each byte, in the 16 bits that depend on the last 16 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h & np.uint32(0xFFFF)


def cuts(data: np.ndarray, smallest: int = MIN, mean: int = MEAN, largest: int = MAX) -> list[int]:
    """Ends of the chunks of one text's bytes."""
    n = len(data)
    good = (np.flatnonzero(rolling(data) < 65536 // mean) + 1).tolist()
    out, start = [], 0
    for g in itertools.chain(good, [n]):
        while g - start > largest:
            start += largest
            out.append(start)
        if g - start >= smallest or (g == n and g > start):
            out.append(g)
            start = g
    return out


SCHEMA = "doc_id long, version int, start int, len int, words short, last boolean, digest long"


def _version(text_col: str):
    """Tells texts of one id apart."""
    return F.hash(F.col(text_col).cast("string"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: int = MIN, mean: int = MEAN, largest: int = MAX, once: bool = False) -> DataFrame:
    """(doc_id, version, start, len, words, last, digest) of every chunk; start and len in bytes of UTF-8. once: rows that are the
    same are cut once a task."""
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for ids, versions, texts in in_pieces(batches, ["doc_id", "version", "text"], 1_000_000):
            rows: list[list] = [[], [], [], [], [], [], []]
            for i, v, t in zip(ids, versions, texts, strict=True):
                if i is None or not t or (once and (i, v) in seen):
                    continue
                if once:
                    seen.add((i, v))
                raw = t.encode("utf-8", "replace")
                data = np.frombuffer(raw, np.uint8)
                ends = cuts(data, smallest, mean, largest)
                starts = [0, *ends[:-1]]
                gap = (data == 32) | (data == 10) | (data == 9) | (data == 13)
                first = np.cumsum(~gap & np.concatenate([[True], gap[:-1]]))
                upto = first[np.array(ends) - 1]
                rows[0].append(np.full(len(ends), i, np.int64))
                rows[1].append(np.full(len(ends), v, np.int32))
                rows[2].append(np.array(starts, np.int32))
                rows[3].append(np.diff(np.array([0, *ends], np.int32)))
                rows[4].append(np.diff(upto, prepend=0).astype(np.int16))
                rows[5].append(np.arange(len(ends)) == len(ends) - 1)
                rows[6].append(np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64).view(np.int64))
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], ["doc_id", "version", "start", "len", "words", "last", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _version(text_col).alias("version"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **sizes) -> DataFrame:
    """Repeated passages: (doc_id, start, end, n_words, first_doc_id, n_copies, kept).

    start and end are bytes of the text's UTF-8; first_doc_id is the smallest document that holds
    one of the passage's chunks and n_copies the most often that one occurs. kept: these are the
    first occurrences. One pre-aggregated shuffle counts digests; those that repeat are staged, and chunks, cut a second time, meet
    them in a join of two plain tables, which adaptive execution splits where one digest has many rows; only what meets goes on to be put in
    order by document.
    """
    return _passages(docs, id_col, text_col, min_words, **sizes).drop("version")


def _passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **sizes) -> DataFrame:
    place = ("doc_id", "start", "version")
    first = chunks(docs, id_col, text_col, **sizes).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("f")).where("n > 1")
    met = chunks(docs, id_col, text_col, **sizes, once=True).join(staged(first, "repeats"), "digest").select("doc_id", "version", "start", (F.col("start") + F.col("len")).alias("end"), "words", "last", "n", F.col("f.doc_id").alias("first_doc"), (F.struct(*place) == F.col("f")).alias("kept"))
    order = Window.partitionBy("doc_id", "version").orderBy("start")
    # rows that are the same come once
    once = met.withColumn("again", F.lag("start").over(order) == F.col("start")).where("again is null or not again")
    broken = once.withColumn("new", F.when((F.lag("end").over(order) == F.col("start")) & (F.lag("kept").over(order) == F.col("kept")), 0).otherwise(1))
    run = broken.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy("doc_id", "version", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.max("last").alias("last"), F.min("first_doc").alias("first_doc_id"), F.max("n").alias("n_copies"), F.first("kept").alias("kept"))
    enough = (F.col("n_words") >= min_words) | (F.col("end") - F.col("start") >= min_words * BYTES_A_WORD) | ((F.col("start") == 0) & F.col("last"))
    return out.where(enough).select("doc_id", "version", "start", "end", "n_words", "first_doc_id", "n_copies", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the passages that do not stay cut out of the texts; cuts that fall inside a character move to
    its ends. All other columns and rows stay."""
    gone = _passages(docs, id_col, text_col, **options).where("not kept").groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__gone"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(t, s):
            if t is None or s is None:
                return t
            raw, parts, at = t.encode("utf-8", "replace"), [], 0
            for x in s:
                parts.append(raw[at:x["start"]])
                at = x["end"]
            return b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
        return texts.combine(spans, one)

    joined = docs.join(gone.withColumnsRenamed({"doc_id": "__id", "version": "__version"}), (F.col(id_col).cast("long") == F.col("__id")) & (_version(text_col) == F.col("__version")), "left")
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col(c)).otherwise(cut(F.col(c), F.col("__gone"))).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
