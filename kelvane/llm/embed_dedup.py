"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into blocks of BLOCK dimensions.
If two vectors are within squared distance D = 2 - 2 * cosine, then in at least one block their squared
distance is at most that block's share of D (the shares are in proportion to the block's dimensions and sum
to D). So each block is range-joined alone: its first coordinate is cut in slabs, rows of a slab are sorted by the second,
and a run of rows meets, in the slabs within reach, the window of the second coordinate within reach; the pairs that meet are
tested on the whole block. Candidates are the union over blocks; a pair is verified, by cosine of the
original vectors in double precision, in the first block that proposes it, so it is counted once.

Vectors of a label are dealt in parts of PART rows (fewer if they have more than 64 dimensions), and every two parts meet in a
group of their own, which joins all blocks: a vector travels once to each group and not once for each block. Links are counted where they are
found; what leaves a group is a row for each linked vector, with its count and the smallest vector its links reach in the group, and
no pairs. Equal vectors of a label are one class (a member count, the smallest id), so copies are never paired.

A vector travels n / PART times for n different vectors of its label: for a block's radius (0.13 of a unit vector of 64 dimensions, against a
spread of 0.12 in each coordinate) grids over coordinates would take more copies than that to spare the same tests.

Only equal, non-null labels are compared, in their own type. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths. A null id: the row is kept, alone. Repeated
ids count as vectors of their own, but share a component. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, staged

COSINE, BLOCK, PART, SEED = 0.93, 8, 8192, 5
RUN = 64
SLACK = 1e-9


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _blocks(dim: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, dim)) for a in range(0, dim, BLOCK)]


def linked(v: np.ndarray, side: np.ndarray, cosine: float = COSINE, tests: list[int] | None = None):
    """(i, j) arrays of linked pairs of the unit vectors v, each pair once. side: if it has two values, only pairs across them.
    tests: gets how many pairs each block was tested on."""
    n, dim = v.shape
    rot, blocks = v @ rotation(dim), _blocks(dim)
    square = [(2 - 2 * cosine) * (b.stop - b.start) / dim + SLACK for b in blocks]
    across = len(np.unique(side)) > 1
    for k, block in enumerate(blocks):
        x, r = rot[:, block], square[k] ** 0.5
        second = x[:, 1] if x.shape[1] > 1 else np.zeros(n)
        slab = np.floor(x[:, 0] / (r / 2)).astype(np.int64)
        order = np.lexsort((second, slab))
        x, slab, second, which = x[order], slab[order], second[order], side[order]
        norm = (x ** 2).sum(1)
        begin = {int(s): (int(a), int(b)) for s, a, b in zip(*_runs(slab), strict=True)}
        tested = 0
        for s, (a, b) in begin.items():
            for lo in range(a, b, RUN):
                hi = min(lo + RUN, b)
                for t in (s, s + 1, s + 2):
                    if t not in begin:
                        continue
                    ta, tb = begin[t]
                    p = lo if t == s else ta + int(np.searchsorted(second[ta:tb], second[lo] - r))
                    q = ta + int(np.searchsorted(second[ta:tb], second[hi - 1] + r, "right"))
                    if p >= q:
                        continue
                    tested += (hi - lo) * (q - p)
                    ok = norm[lo:hi, None] + norm[p:q] - 2 * (x[lo:hi] @ x[p:q].T) <= square[k]
                    if t == s:
                        ok &= np.arange(lo, hi)[:, None] < np.arange(p, q)
                    if across:
                        ok &= which[lo:hi, None] != which[p:q]
                    i, j = np.nonzero(ok)
                    i, j = order[i + lo], order[j + p]
                    for e in range(k):  # an earlier block that proposes the pair counts it
                        new = ((rot[i, blocks[e]] - rot[j, blocks[e]]) ** 2).sum(1) > square[e] - SLACK
                        i, j = i[new], j[new]
                    keep = ((rot[i, block] - rot[j, block]) ** 2).sum(1) <= square[k] - SLACK
                    i, j = i[keep], j[keep]
                    keep = np.einsum("ij,ij->i", v[i], v[j]) >= cosine
                    if keep.any():
                        yield i[keep], j[keep]
        if tests is not None:
            tests.append(tested)


def _runs(keys: np.ndarray):
    """(key, start, end) of the runs of sorted keys."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], start, np.concatenate([start[1:], [len(keys)]])


def _meetings(classes: DataFrame):
    """classes dealt so that every two vectors of a label and length meet in one group (label, dim, g1, g2)."""
    rows = classes.withColumn("dim", F.size("v"))
    counts = staged(rows.groupBy("label", "dim").agg(F.count("*").alias("n_rows")).where("n_rows > 1").withColumn("parts", F.ceil(F.col("n_rows") * F.greatest("dim", F.lit(64)) / (64 * PART)).cast("int")).drop("n_rows"), "label-counts")
    parted = rows.join(counts, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    dealt = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"g1": F.least("part", "other"), "g2": F.greatest("part", "other")}).drop("parts", "other").groupBy("label", "dim", "g1", "g2")


def _vectors(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return _unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1))


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Linked pairs of classes (a, b), a < b, each once; classes: (cid, label, v array<double>)."""
    def meet(table):
        cid, side = table.column("cid").to_numpy(), table.column("part").to_numpy()
        pairs = [np.stack([cid[i], cid[j]], 1) for i, j in linked(_vectors(table), side, cosine)]
        both = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        return pa.table({"a": both.min(1), "b": both.max(1)}) if len(both) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return _meetings(classes).applyInArrow(meet, "a long, b long")


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of components (the smallest row in each), after the links i, j."""
    a, b = root[i], root[j]
    new = a != b
    if not new.any():
        return root
    up: dict[int, int] = {}

    def find(x):
        while x in up:
            x = up[x]
        return x
    for x, y in np.unique(np.stack([np.minimum(a[new], b[new]), np.maximum(a[new], b[new])], 1), axis=0).tolist():
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    to = np.arange(len(root))
    for x in up:
        to[x] = find(x)
    return to[root]


def link_counts(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(cid, more, least, root), some rows for each linked class: more sums up to the members of the classes that it is linked with; the
    rows' edges from least to root tie what links tie. classes: (cid, least, n, label, v)."""
    def meet(table):
        n, side = table.column("n").to_numpy(), table.column("part").to_numpy()
        least = table.column("least").to_numpy()
        order = np.argsort(least, kind="stable")  # row numbers in the order of ids
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        more, root = np.zeros(len(n), np.int64), np.arange(len(n))
        for i, j in linked(_vectors(table), side, cosine):
            more += np.bincount(i, n[j], len(n)).astype(np.int64) + np.bincount(j, n[i], len(n)).astype(np.int64)
            root = _merge(root, place[i], place[j])
        at = np.flatnonzero(more)
        return pa.table({"cid": table.column("cid").to_numpy()[at], "more": more[at], "least": least[at], "root": least[order[root[place[at]]]]})

    return _meetings(classes).applyInArrow(meet, "cid long, more long, least long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    v = F.col(vector_col) if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = staged(rows.withColumn("ok", usable).withColumn("digest", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))), "vectors")
    good = rows.where("ok")
    groups = good.groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("v").alias("v"))
    # a repeated id may stand for several classes; each class needs a number of its own for the join
    again = F.row_number().over(Window.partitionBy("least").orderBy("label", "digest"))
    numbered = staged(groups.withColumn("cid", F.when(again == 1, F.col("least")).otherwise(F.xxhash64("label", "digest"))), "numbered")
    found = staged(link_counts(numbered, cosine), "links")
    both = found.groupBy("cid").agg(F.sum("more").alias("more"))
    # an id with several vectors ties their classes
    several = good.groupBy("vec_id").agg(F.min(F.xxhash64("label", "digest")).alias("x"), F.max(F.xxhash64("label", "digest")).alias("y")).where("x <> y").select("vec_id")
    tied = good.select("vec_id", "label", "digest").join(several, "vec_id", "left_semi").join(numbered.select("label", "digest", "least"), ["label", "digest"]).select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    comp = components(found.select(F.col("least").alias("a"), F.col("root").alias("b")).unionByName(tied).where("a <> b").distinct(), "embeddings")
    per = numbered.join(both, "cid", "left").join(comp.withColumnRenamed("id", "least"), "least", "left").select("label", "digest", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    # staged, so that adaptive execution may split the join at a class of many copies
    out = rows.select("vec_id", "label", "digest").join(staged(per, "reached"), ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
