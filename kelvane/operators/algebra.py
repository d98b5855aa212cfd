"""Relational algebra with set semantics, set-at-a-time changes as log rows, and integrity checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: In bag_join: rows of an array, rows read in a row that are put in arrays together, rows of the result in a task.
BLOCK, SPAN_BITS, TASK = 2048, 16, 1 << 23


def project(r: DataFrame, *cols: str) -> DataFrame:
    return r.select(*cols).distinct()


def rename(r: DataFrame, **names: str) -> DataFrame:
    return r.withColumnsRenamed(names)


def product(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.distinct().crossJoin(s.distinct())


def theta_join(r: DataFrame, s: DataFrame, on: Column) -> DataFrame:
    return r.distinct().join(s.distinct(), on)


def equi_join(r: DataFrame, s: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of r and s whose columns are equal as `on` pairs them; of two sets, a set. Nulls meet nothing."""
    return r.join(s, [F.col(a) == F.col(b) for a, b in on.items()])


def bag_join(r: DataFrame, s: DataFrame, on: dict[str, str]) -> DataFrame:
    """equi_join for few keys that many rows of both sides have; all columns have names of their own. Nulls meet nothing, other repeats are kept.

    Such a result is far larger than what is read, so tasks that follow the files of one side would be few and long. Rows
    of a key go in arrays of BLOCK at most, pairs of arrays are dealt evenly to tasks of about TASK rows of the result,
    and rows are paired there, one row of r with one array of s at a time. The rows of the result are counted when it is planned.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    known = " and ".join(f"{k} is not null" for k in keys)
    r, s = (t.select("*", *[F.col(c).alias(k) for k, c in zip(keys, cols, strict=True)]).where(known) for t, cols in ((r, on.keys()), (s, on.values())))
    each = [t.groupBy(*keys).agg(F.count("*").cast("double").alias(n)) for t, n in ((r, "__n"), (s, "__m"))]
    rows = each[0].join(each[1], keys).agg(F.sum(F.col("__n") * F.col("__m"))).first()[0] or 0
    pairs = _blocks(r, keys, "__r").join(_blocks(s, keys, "__s"), keys).select("__r", "__s").repartition(max(1, math.ceil(rows / TASK)))
    # transform has no generated code, so these rows come one by one; generated code would hold all that come of an array
    ones = pairs.select(F.inline(F.transform("__r", lambda x: x)), "__s")
    return ones.select(*[c for c in r.columns if c not in keys], F.inline("__s"))


def _blocks(r: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The other columns of r as arrays of rows that are equal in keys."""
    at = F.shiftright(F.monotonically_increasing_id(), SPAN_BITS)
    lists = r.select(*keys, F.struct(*[c for c in r.columns if c not in keys]).alias("__row"), at.alias("__at")).groupBy(*keys, "__at").agg(F.collect_list("__row").alias("__rows"))
    starts = F.sequence(F.lit(1), F.size("__rows"), F.lit(BLOCK))
    return lists.select(*keys, F.explode(F.transform(starts, lambda i: F.slice("__rows", i, BLOCK))).alias(name))


def natural_join(r: DataFrame, s: DataFrame) -> DataFrame:
    """On all columns that both have; with none, the product."""
    common = [c for c in r.columns if c in s.columns]
    return r.distinct().join(s.distinct(), common) if common else product(r, s)


def union(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.unionByName(s).distinct()


def intersect(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.intersect(s.select(*r.columns))


def difference(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.subtract(s.select(*r.columns))


def divide(r: DataFrame, s: DataFrame) -> DataFrame:
    """The rows x such that (x, y) is in r for all y in s. An empty divisor is met by all of r.

    One semi join and one count per x; s is counted once, so no product is formed.
    """
    by = s.columns
    keep = [c for c in r.columns if c not in by]
    need = s.distinct().agg(F.count("*").alias("__need"))
    have = r.distinct().join(s.distinct(), by, "left_semi").groupBy(*keep).agg(F.count("*").alias("__have"))
    all_of = r.select(*keep).distinct().join(have, keep, "left")
    return all_of.join(F.broadcast(need), F.coalesce("__have", F.lit(0)) == F.col("__need")).select(*keep)


def without_earlier(r: DataFrame, by: str) -> DataFrame:
    """The rows for which no row has a smaller value: the difference of r and its self-product's losers."""
    least = r.agg(F.min(by).alias("__least"))
    return r.join(F.broadcast(least), F.col(by) == F.col("__least"), "left_semi")


def index_on(live: DataFrame, *cols: str) -> DataFrame:
    """A secondary index: the attributes, then the key."""
    return live.select(*cols, "key")


def index_lookup(index: DataFrame, where: Column, live: DataFrame) -> DataFrame:
    return index.where(where).join(live, "key", "left_semi" if set(live.columns) <= {"key"} else "inner")


def unique_violations(r: DataFrame, *cols: str) -> DataFrame:
    """Values that more than one row has; nulls are not compared."""
    known = r.where(" and ".join(f"`{c}` is not null" for c in cols))
    return known.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_violations(r: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    p = parent.select(F.col(parent_col).alias("__p"))
    return r.where(F.col(col).isNotNull()).join(p, F.col(col) == F.col("__p"), "left_anti")


def domain_violations(r: DataFrame, rule: Column) -> DataFrame:
    return r.where(~F.coalesce(rule, F.lit(False)))


def delete_where(live: DataFrame, cond: Column, seq: int) -> DataFrame:
    """Tombstones of the rows that satisfy cond, as one batch."""
    return _batch(live.where(cond).select("key", F.lit(None).cast(dict(live.dtypes)["value"]).alias("value"), F.lit(True).alias("tombstone")), seq)


def insert_rows(rows: DataFrame, seq: int) -> DataFrame:
    return _batch(rows.select("key", "value", F.lit(False).alias("tombstone")), seq)


def _batch(rows: DataFrame, seq: int) -> DataFrame:
    # one operation for each key, so its place among the others decides nothing
    return rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(0).alias("op_idx"), "key", "value", "tombstone")


def first_wins(attempts: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Attempts (seq, key, ...) that each check that the key is absent: the first of each key succeeds, if the key is not
    live (without live: in an empty store)."""
    w = Window.partitionBy("key").orderBy("seq")
    if live is None:
        return attempts.withColumn("applied", F.row_number().over(w) == 1)
    met = attempts.join(live.select("key", F.lit(True).alias("__there")), "key", "left")
    return met.withColumn("applied", F.col("__there").isNull() & (F.row_number().over(w) == 1)).drop("__there")


def compare_and_put(live: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts (seq, key, expected) decided in order: the first per key whose expected version is the live one
    succeeds, and moves the version, so all others of that key fail."""
    joined = attempts.join(live.select("key", F.col("version").alias("__now")), "key", "left")
    match = F.coalesce(F.col("expected") == F.col("__now"), F.lit(False))
    w = Window.partitionBy("key", "__match").orderBy("seq")
    return joined.withColumn("__match", match).withColumn("applied", F.col("__match") & (F.row_number().over(w) == 1)).drop("__match", "__now")
