"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

Each shingle of SHINGLE words is hashed once; the hash's top bits name its bin and the rest is compared there, so one pass gives all BINS minima. Empty bins are filled by optimal densification: bin j
takes the minimum of the first full bin in a random sequence of bins that belongs to j alone (hashes of
j and the attempt; after PROBES of them the full bins are ranked by a hash of the pair). BITS low-order bits of each minimum are packed as hex, and
the likeness of two fingerprints corrects the rate of equal bins for chance: (m - c) / (1 - c), c = 2^-BITS,
held to 0..1.

Texts with fewer than SHINGLE words have one shingle, all their words. Null text counts as empty. Texts
without a word have an empty fingerprint; two of these are alike (1), one and any other are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE, BINS, BITS = 5, 256, 4
PROBES = 12
ROWS_PER_BUCKET, MAX_BUCKETS = 64, 1 << 16


def with_fingerprint(df: DataFrame, text_col: str, out: str, width: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """df and the fingerprint of a text; no shuffle. bins: a power of two.

    Each step is a column of its own: an expression that is named inside a lambda would be worked out for
    each element. Steps pair arrays with zip_with, which binds elements directly, not by index.
    """
    q, step = bins.bit_length() - 1, [f"__{out}_{k}" for k in range(5)]
    kept = [F.col(f"`{c}`") for c in df.columns]
    words, run, codes, dense, full = map(F.col, step)
    text = F.coalesce(F.col(text_col), F.lit(""))
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    df = df.select(*kept, F.transform(F.array_remove(F.split(text, " "), ""), lambda w: F.xxhash64(w)).alias(step[0]))
    # run: hashes of 1, then 2, 4, ... words from each word on, then of the words that are left; those beyond the end count as none
    df = df.select(*kept, words, words.alias(step[1]))
    have = 1
    while have < width:
        more = min(have, width - have)
        other = run if more == have else words
        if other is words:
            more = 1
        df = df.select(*kept, words, F.zip_with(run, F.slice(other, have + 1, F.size(words)), lambda x, y: F.xxhash64(x, y)).alias(step[1]))
        have += more
    # a hash's top bits name its bin; each bin has a mark that sorts after all of its hashes
    low = (1 << (64 - q)) - 1
    marks = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.shiftleft(j.cast("long") - (1 << (q - 1)), 64 - q).bitwiseOR(F.lit(low)))
    shingles = F.slice(run, 1, F.greatest(F.lit(1), F.size(words) - width + 1))
    df = df.select(*kept, F.when(F.size(words) > 0, F.sort_array(F.concat(shingles, marks))).alias(step[2]))
    # the least of each bin: the code whose forerunner is of another bin
    first = F.zip_with(codes, F.concat(F.array(F.lit(None).cast("long")), F.slice(codes, 1, F.size(codes) - 1)), lambda c, before: F.when(F.coalesce(F.shiftright(c.bitwiseXOR(before), 64 - q) != 0, F.lit(True)), c))
    df = df.select(*kept, F.array_compact(first).alias(step[3]))
    df = df.select(*kept, dense, F.filter(dense, lambda c: c.bitwiseAND(F.lit(low)) != low).alias(step[4]))
    # an empty bin probes bins in an order of its own until one is full; after PROBES, the full ones are ranked at once
    def probe(j, t):
        c = F.get(dense, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(bins)).cast("int"))
        return F.when(c.bitwiseAND(F.lit(low)) != low, c)

    rest = lambda j: F.array_min(F.transform(full, lambda c: F.struct(F.xxhash64(j, F.shiftright(c, 64 - q)).alias("rank"), c.alias("code"))))["code"]
    filled = lambda c, j: F.when(c.bitwiseAND(F.lit(low)) != low, c).otherwise(F.coalesce(*[probe(j, t) for t in range(PROBES)], rest(j)))
    digits = lambda v: F.hex(v.bitwiseAND((1 << bits) - 1))
    # low-order bits of the minimum hashed with its bin: copies of one minimum in several bins agree with another's by chance one by one
    low_bits = lambda c, j: digits(F.xxhash64(filled(c, j), j))
    hexed = F.transform(dense, lambda c, j: low_bits(c, j) if bits == 4 else F.lpad(low_bits(c, j), bits // 4, "0"))
    return df.select(*kept, F.coalesce(F.lower(F.array_join(hexed, "")), F.lit("")).alias(out))


def likeness(a: Column, b: Column, bits: int = BITS, bins: int = BINS) -> Column:
    """Corrected likeness of two fingerprints (hex text), 0 to 1."""
    w = bits // 4
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substring(x, i * w + 1, F.lit(w)))
    same = F.size(F.filter(F.zip_with(F.split(a, "") if w == 1 else cut(a), F.split(b, "") if w == 1 else cut(b), lambda x, y: (x == y) & (x != "")), lambda x: x))
    c = 2.0 ** -bits
    good = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(bins)) - c) / (1 - c)))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(good)


def _bounds(ids: DataFrame, buckets: int) -> list:
    """Up to buckets - 1 ids that split the ids evenly, ascending."""
    if buckets <= 1:
        return []
    shares = [k / buckets for k in range(1, buckets)]
    return sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 50 * buckets).alias("p")).first()["p"]))


def _bucket(doc_id: Column, bounds: list) -> Column:
    """How many bounds are at or below the id: by blocks of bounds first, then within one."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    lit = lambda xs: F.expr("array(" + ",".join(f"{x}L" for x in xs) + ")")
    heads = lit([b[0] for b in blocks])
    nested = F.expr("array(" + ",".join("array(" + ",".join(f"{x}L" for x in b) + ")" for b in blocks) + ")")
    block = F.size(F.filter(heads, lambda x: x <= doc_id))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + F.size(F.filter(F.get(nested, block - 1), lambda x: x <= doc_id)))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each document: its length, the SHA-256 of its edited text, both fingerprints, and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next
    document by descending doc_id; the first follows the last. Documents are dealt once, by ranges of ids
    with a copy of the one that follows each range's last; windows and the bins' minima reuse that. A
    repeated doc_id: rows with the smaller text come first. Null ids come last of all, by text. A lone
    document is its own next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    total, most = ids.agg(F.count("*"), F.max("doc_id")).first()
    bounds = _bounds(ids, min(MAX_BUCKETS, -(-total // ROWS_PER_BUCKET)))
    bucketed = ids.select("doc_id", _bucket(F.col("doc_id"), bounds).alias("bucket"))
    # the next document of a bucket's last one is the largest of the bucket below that has rows; the lowest's is the largest of all
    tops = sorted((r["bucket"], r["top"]) for r in bucketed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()) if total else []
    follows = [(b, tops[k - 1][1] if k else most) for k, (b, _) in enumerate(tops)]
    keyed = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("bucket", _bucket(F.col("at"), bounds))
    # each row goes to its own bucket, and the largest of a bucket to the one that it follows, too
    owner = {top: b for b, top in follows}
    if owner:
        entries = sorted(owner.items())
        step = max(1, int(len(entries) ** 0.5))
        blocks = [entries[i:i + step] for i in range(0, len(entries), step)]
        sql = "array(" + ",".join("map(" + ",".join(f"{_long(t)},{b}" for t, b in blk) + ")" for blk in blocks) + ")"
        heads = F.expr("array(" + ",".join(_long(blk[0][0]) for blk in blocks) + ")")
        also = F.element_at(F.get(F.expr(sql), F.greatest(F.lit(0), F.size(F.filter(heads, lambda x: x <= F.col("at"))) - 1)), F.col("at"))
    else:
        also = F.lit(None).cast("int")
    dealt = keyed.withColumn("copies", F.when(also.isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("follower")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("follower")), F.struct(also.alias("b"), F.lit(1).alias("follower")))))
    dealt = dealt.select(F.explode("copies").alias("c"), "doc_id", "at", "text").select(F.col("c.b").alias("bucket"), F.col("c.follower").alias("follower"), "doc_id", "at", "text")
    order = Window.partitionBy("bucket").orderBy("follower", F.desc("at"), "text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    placed = dealt.withColumn("next", F.lead("text").over(order)).withColumn("row", F.row_number().over(order))
    edited = placed.select("bucket", "row", "follower", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("follower") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))).alias("edited"))
    hashed = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    prints = with_fingerprint(with_fingerprint(hashed, "text", "fingerprint").drop("text"), "edited", "edited_fingerprint").drop("edited")
    near = prints.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("row"))).where("follower = 0")
    return near.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"

