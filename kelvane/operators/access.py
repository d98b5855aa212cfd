"""Access paths over a live relation (key, value, version): all are filters and sorts that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import UNBOUNDED, Bound, Direction


def in_range(start: Bound = UNBOUNDED, end: Bound = UNBOUNDED, key: str = "key") -> Column:
    """A range that is upside down, or empty by an excluded end, holds nothing; it is no error."""
    c, terms = F.col(key), []
    if start.key is not None:
        terms.append(c >= F.lit(start.key) if start.included else c > F.lit(start.key))
    if end.key is not None:
        terms.append(c <= F.lit(end.key) if end.included else c < F.lit(end.key))
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def get(live: DataFrame, key, col: str = "key") -> DataFrame:
    return live.where(F.col(col) == F.lit(key))


def scan(live: DataFrame, start: Bound = UNBOUNDED, end: Bound = UNBOUNDED) -> DataFrame:
    return live.where(in_range(start, end)).orderBy("key")


def scan_page(live: DataFrame, start: Bound, end: Bound, direction: Direction, limit: int) -> DataFrame:
    """One page; a sort with a limit is a top-k of each task, then of those."""
    by = F.col("key").asc() if direction is Direction.FORWARD else F.col("key").desc()
    return live.where(in_range(start, end)).orderBy(by).limit(limit)


def floor_key(live: DataFrame, key) -> DataFrame:
    return scan_page(live, UNBOUNDED, Bound(key), Direction.REVERSE, 1)


def ceil_key(live: DataFrame, key) -> DataFrame:
    return scan_page(live, Bound(key), UNBOUNDED, Direction.FORWARD, 1)


def first_n(live: DataFrame, n: int) -> DataFrame:
    return scan_page(live, UNBOUNDED, UNBOUNDED, Direction.FORWARD, n)


def last_n(live: DataFrame, n: int) -> DataFrame:
    return scan_page(live, UNBOUNDED, UNBOUNDED, Direction.REVERSE, n)


def next_after(live: DataFrame, key) -> DataFrame:
    return scan_page(live, Bound(key, False), UNBOUNDED, Direction.FORWARD, 1)


def prev_before(live: DataFrame, key) -> DataFrame:
    return scan_page(live, UNBOUNDED, Bound(key, False), Direction.REVERSE, 1)


def prefix(live: DataFrame, start, key: str = "key") -> DataFrame:
    """Keys that start with a prefix. As a range where an end exists, so that files can be skipped by it."""
    if isinstance(start, str):
        return live.where(F.col(key).startswith(start))
    end = bytes(start).rstrip(b"\xff")
    if not end:
        return live.where(in_range(Bound(bytes(start)), UNBOUNDED, key)) if start else live
    return live.where(in_range(Bound(bytes(start)), Bound(end[:-1] + bytes([end[-1] + 1]), False), key))


def list_keys(live: DataFrame) -> DataFrame:
    return live.select("key")


def count(live: DataFrame) -> DataFrame:
    return live.agg(F.count("*").alias("n"))


def value_bytes(live: DataFrame) -> DataFrame:
    return live.agg(F.coalesce(F.sum(F.length("value")), F.lit(0)).cast("long").alias("value_bytes"))


def next_id(live: DataFrame) -> DataFrame:
    """One more than the largest key that is a number; other keys do not count."""
    return live.agg((F.coalesce(F.max(F.expr("try_cast(cast(key as string) as bigint)")), F.lit(-1)) + 1).alias("next_id"))


def fold(live: DataFrame, step, start, ordered: bool = False):
    """A left fold in the driver over a stream of rows (one partition at a time is held)."""
    rows = live.select("key", "value")
    for r in (rows.orderBy("key") if ordered else rows).toLocalIterator():
        start = step(start, bytes(r["key"]), bytes(r["value"]))
    return start


def aggregate(live: DataFrame, zero, step, combine):
    """A fold that has a combiner: tasks fold their rows, results are combined as a tree."""
    pairs = live.select("key", "value").rdd.map(lambda r: (bytes(r[0]), bytes(r[1])))
    return pairs.treeAggregate(zero, lambda a, kv: step(a, *kv), combine)
