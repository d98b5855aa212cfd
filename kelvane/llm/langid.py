"""Language identification: multinomial naive Bayes over hashed character n-grams.

fit() counts hashed n-grams per language in the executors; the log-probability matrix (languages x
BUCKETS floats, a fixed bound for MAX_LANGS) is broadcast; predict() scores batches in numpy as a
sparse matrix (indices and row offsets) times that matrix.

The fit uses a bounded sample of labelled rows: each language gives about SAMPLE documents, chosen by
a hash of the id, or all it has. Prediction reads whole texts. Null labels teach nothing; a row with a
null id teaches nothing. Null text, or text without a letter: `und`, score 0. With nothing to learn
from, all is `und`. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_pieces, lean

SAMPLE = 1000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_LANGS = 1000
PIECE = 500_000  # characters that relabel looks at, and gives back, at once
EVIDENCE = 40.0
ALPHA = 0.5
# n-grams that a text may lack of all whitespace runs count as one space
_SPACE = re.compile(r"\s+")
_WORDISH = re.compile(r"[^\W\d_]")
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _WORDISH.finditer(text))


def _codes(texts: list[str]):
    """Code points of the texts, each lower-cased and followed by a zero, and the offsets."""
    low = [t.lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in low])])


def hashed(texts: list[str]):
    """For each order, (bucket of the n-gram at each code point, offsets of the texts). The zeros
    between texts make n-grams that cross a border; they hash to bucket 0, which weighs nothing."""
    codes, offsets = _codes(texts)
    n = len(codes)
    end = np.zeros(n + 2, bool)
    end[offsets[1:] - 1] = True
    h, out, over = np.zeros(n, np.uint32), [], np.zeros(n, bool)
    padded = np.concatenate([codes, np.zeros(2, np.uint32)])
    for k in range(max(ORDERS)):
        h = (h ^ padded[k:k + n]) * _MULT[k % 3]
        h ^= h >> np.uint32(15)
        over |= end[k:k + n]
        if k + 1 in ORDERS:
            b = (h * np.uint32(0x27D4EB2F) >> np.uint32(16)) % np.uint32(BUCKETS - 1) + np.uint32(1)
            b[over] = 0
            out.append(b.astype(np.intp))
    return out, offsets


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE):
    """(languages in order, float32 matrix of log-probabilities, languages x BUCKETS)."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("i is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    picked = rows.where("text is not null").where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for langs, texts in in_pieces(batches, ["lang", "text"]):
            for lang in set(langs):
                parts, _ = hashed([t for x, t in zip(langs, texts, strict=True) if x == lang])
                for p in parts:
                    sums[lang] = sums.get(lang, 0) + np.bincount(p, minlength=BUCKETS)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "bucket", "n"])

    got = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS))
    at = {x: k for k, x in enumerate(langs)}
    counts[got["lang"].map(at).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy(float)
    counts[:, 0] = 0
    seen = counts.sum(0) > 0
    logs = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * max(1, seen.sum()))
    logs[:, ~seen] = 0  # an n-gram that no language has shown says nothing
    return langs, logs.astype(np.float32)


def score_texts(texts: list[str], langs: list[str], logs_t: np.ndarray) -> tuple[list[str], np.ndarray]:
    """logs_t: BUCKETS x languages."""
    parts, offsets = hashed(texts)
    total, used = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    weigh = (np.abs(logs_t).sum(1) > 0)
    for p in parts:
        for k in range(len(langs)):
            total[:, k] += np.add.reduceat(logs_t[:, k][p], offsets[:-1], dtype=np.float64)
        used += np.add.reduceat(weigh[p], offsets[:-1], dtype=np.float64)
    mean = total / np.maximum(used, 1)[:, None] * np.minimum(used, EVIDENCE)[:, None]
    e = np.exp(mean - mean.max(1, keepdims=True))
    best = mean.argmax(1)
    return [langs[k] for k in best], e[np.arange(len(texts)), best] / e.sum(1)


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; with keep, those columns come along after the text."""
    langs, logs = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, np.ascontiguousarray(logs.T)))

    def run(batches):
        names, table = shared.value
        table = np.asfortranarray(table)
        for ids, texts in in_pieces(batches, ["doc_id", "text"]):
            pred, score = ["und"] * len(ids), np.zeros(len(ids))
            at = [k for k, t in enumerate(texts) if names and has_letter(t)]
            if at:
                p, s = score_texts([texts[k] for k in at], names, table)
                for k, x in zip(at, p, strict=True):
                    pred[k] = x
                score[at] = s
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def relabel(docs: DataFrame, model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_col set to the prediction and its score in __score; all else stays."""
    langs, logs = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logs.T)))

    @lean
    def run(batches):
        names, table = shared.value
        table = np.asfortranarray(table)
        for batch in batches:
            done = 0
            for (texts,) in in_pieces([batch], [text_col], PIECE):
                at = [k for k, t in enumerate(texts) if names and has_letter(t)]
                p, s = ["und"] * len(texts), [0.0] * len(texts)
                if at:
                    for k, x, y in zip(at, *score_texts([texts[k] for k in at], names, table), strict=True):
                        p[k], s[k] = x, float(y)
                part = batch.slice(done, len(texts))
                done += len(texts)
                out = part.set_column(part.schema.get_field_index(lang_col), lang_col, pa.array(p, pa.string()))
                yield out.append_column("__score", pa.array(s, pa.float64()))

    fields = [f if f.name != lang_col else T.StructField(lang_col, T.StringType()) for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("__score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), fitted on the rows that are not held out."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col, sample)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
