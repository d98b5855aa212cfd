"""Mixing sources to target weights by temperature.

A source's share q of all tokens (words) becomes a weight in proportion to q^a. The exponent a is bisected in
[0, 1] until the weights' entropy (in nats) meets a target, or until no source is repeated more often than a limit;
a = 1 keeps the shares, a = 0 gives all sources the same. The budget of a source is its weight times the total;
with no total given, the total is the least at which every source is used whole at least once.

A budget is realised as whole epochs and one part of an epoch. Documents are dealt by a keyed hash into blocks,
and each epoch has its own keyed permutation of a source's blocks. The last, partial epoch takes blocks in that
order while they fit and then documents of the block that does not, by hash, while they fit: a source never
exceeds its budget and falls short of it by less than the next document. Which documents these are follows from three numbers per
source, so realising the mixture is a narrow map of the documents.

Null text counts as empty; documents without tokens go with their block. Null is a source of its own. A source without tokens is used once.
Rows with equal ids are taken or left together. Only per-source rows reach the driver, at most MAX_SOURCES.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

SEED, DOCS_PER_BLOCK, MAX_BLOCKS, MAX_SOURCES = 17, 64, 4096, 10_000


def n_words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " "), "")).cast("long")


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised weights of sources by their tokens; a source without tokens weighs nothing."""
    total = sum(tokens.values())
    raw = {k: (n / total) ** exponent if n else 0.0 for k, n in tokens.items()}
    norm = sum(raw.values()) or 1.0
    return {k: x / norm for k, x in raw.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def least_whole(tokens: dict, w: dict) -> float:
    """The least total at which each source is used whole."""
    return max((n / w[k] for k, n in tokens.items() if n), default=0.0)


def bisect(tokens: dict, target_entropy: float | None = None, max_repeats: float | None = None, total: float | None = None, steps: int = 60) -> float:
    """The exponent. Entropy falls and the largest number of repeats falls as the exponent grows, so both have
    one crossing; beyond the reach of [0, 1] the nearer end is given."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a limit of repeats")

    def flat(a: float) -> bool:
        """Whether the weights are flatter than asked for."""
        w = weights(tokens, a)
        if target_entropy is not None:
            return entropy(w) > target_entropy
        whole = least_whole(tokens, w) if total is None else total
        return any(w[k] * whole / n > max_repeats for k, n in tokens.items() if n)

    if flat(1.0) or not flat(0.0):
        return 1.0 if flat(1.0) else 0.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat(mid) else (lo, mid)
    return hi


def _source(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _doc_key(doc_id: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def _block(doc_id: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed + 1)), blocks).cast("int")


def _block_key(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(source, block, epoch.cast("int"), F.lit(seed + 2))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_repeats: float | None = None, total: float | None = None, seed: int = SEED):
    """(a small DataFrame with one row per source, the narrow table of documents that it was made from).

    Per source: tokens, weight, budget, epochs (whole ones), blocks, and what the partial epoch takes: blocks
    with a key up to below, and, of the block with key part_key, documents with a key up to part_below.
    """
    spark = docs.sparkSession
    narrow = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("n_tokens")).withColumn("skey", _source(F.col("source"))), "tokens")
    rows = narrow.groupBy("skey").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["skey"]: r["tokens"] for r in rows}
    exponent = bisect(tokens, target_entropy, max_repeats, total) if any(tokens.values()) else 1.0
    w = weights(tokens, exponent) if any(tokens.values()) else dict.fromkeys(tokens, 0.0)
    whole = total is None
    total = least_whole(tokens, w) if whole else total
    schema = "skey string, tokens long, weight double, budget long, epochs int, rest long, blocks int"
    out = []
    for r in sorted(rows, key=lambda r: r["skey"]):
        k, n = r["skey"], r["tokens"]
        budget = math.floor(w[k] * total + 1e-6)
        if whole:
            budget = max(budget, n)
        epochs = budget // n if n else 1
        out.append((k, n, w[k], budget, epochs, budget - epochs * n, max(1, min(MAX_BLOCKS, -(-r["docs"] // DOCS_PER_BLOCK)))))
    per = spark.createDataFrame(out, schema)
    placed = narrow.join(F.broadcast(per), "skey").withColumn("block", _block(F.col("doc_id"), F.col("blocks"), seed))
    sums = placed.groupBy("skey", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("t")).withColumn("key", _block_key(F.col("skey"), F.col("block"), F.col("epochs"), seed))
    cum = staged(sums.withColumn("upto", F.sum("t").over(Window.partitionBy("skey").orderBy("key"))), "blocks")
    edge = cum.groupBy("skey").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("below"), F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("used"), F.min(F.when(F.col("upto") > F.col("rest"), F.col("key"))).alias("part_key"))
    # documents of the one block of each source that is taken in part
    split = edge.join(cum.select("skey", F.col("key").alias("part_key"), "block", "rest"), ["skey", "part_key"])
    some = placed.join(F.broadcast(split.select("skey", "block", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("room"))), ["skey", "block"]).withColumn("dkey", _doc_key(F.col("doc_id"), seed))
    part = some.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("skey").orderBy("dkey"))).where("upto <= room").groupBy("skey").agg(F.max("dkey").alias("part_below"))
    full = per.join(edge, "skey", "left").join(part, "skey", "left").select("skey", "tokens", "weight", "budget", "epochs", "rest", "blocks", F.when(F.col("rest") > 0, F.col("below")).alias("below"), F.when(F.col("rest") > 0, F.col("part_key")).alias("part_key"), F.when(F.col("rest") > 0, F.col("part_below")).alias("part_below"))
    return spark.createDataFrame(full.collect(), full.schema), narrow


def realise(docs: DataFrame, per_source: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mixture has it, and columns __epoch, __block and __block_key. The
    plan is broadcast: one row per source, MAX_SOURCES at most."""
    renamed = per_source.select(*[F.col(c).alias(f"__{c}") for c in per_source.columns])
    rows = docs.join(F.broadcast(renamed), _source(F.col(f"`{source_col}`")) == F.col("__skey"))
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = rows.withColumn("__block", _block(doc_id, F.col("__blocks"), seed))
    key = _block_key(F.col("__skey"), F.col("__block"), F.col("__epochs"), seed)
    taken = F.coalesce(key <= F.col("__below"), F.lit(False)) | F.coalesce((key == F.col("__part_key")) & (_doc_key(doc_id, seed) <= F.col("__part_below")), F.lit(False))
    copies = F.col("__epochs") + taken.cast("int")
    out = rows.withColumn("__copies", copies).where("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    return out.withColumn("__block_key", _block_key(F.col("__skey"), F.col("__block"), F.col("__epoch"), seed)).select(*[F.col(f"`{c}`") for c in docs.columns], "__epoch", "__block", "__block_key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Placements: (doc_id, source, n_tokens, epoch, block, block_rank, doc_rank_key). A source's training order is
    by epoch, block_rank, doc_rank_key, doc_id."""
    seed = options.get("seed", SEED)
    per, narrow = plan(docs, **options)
    placed = realise(narrow, per, seed=seed)
    ranks = placed.select("skey", "__epoch", "__block", "__block_key").distinct().withColumn("block_rank", F.row_number().over(Window.partitionBy("skey", "__epoch").orderBy("__block_key", "__block")))
    out = placed.join(ranks.drop("__block_key"), ["skey", "__epoch", "__block"])
    return out.select("doc_id", "source", "n_tokens", F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), "block_rank", F.xxhash64("doc_id", "__epoch", F.lit(seed)).alias("doc_rank_key"))
