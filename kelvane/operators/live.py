"""The live relation: the last operation of each key in log order, without tombstones.

The window form lets Catalyst prune `value` where it is not asked for and push a filter on the key below the
rank to the scan; WindowGroupLimit keeps one row per key and task before the shuffle, so a hot key
moves no more rows than there are tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ("seq", "op_idx")
#: Files of the old format carry no sequence numbers: the place in the files orders them.
NATIVE_ORDER = ("file_id", "offset", "op_idx")


def latest(log: DataFrame, key: str = "key", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The last row of each key, tombstones too. Filter nothing but keys before this."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def live(log: DataFrame, key: str = "key", order: tuple[str, ...] = ORDER) -> DataFrame:
    rows = latest(log, key, order).where("not tombstone").drop("tombstone")
    return rows.withColumn("version", F.col("seq")) if "version" not in rows.columns else rows


def as_of(log: DataFrame, seq: int, **kw) -> DataFrame:
    """The live relation when seq was the last number given."""
    return live(log.where(F.col("seq") <= seq), **kw)


def next_seq(log: DataFrame, floor: int = 1) -> DataFrame:
    return log.agg(F.greatest(F.lit(1), F.lit(floor), F.coalesce(F.max("seq") + 1, F.lit(1))).cast("long").alias("next_seq"))


def effective(log: DataFrame, key: str = "key") -> DataFrame:
    """Operations that write something (a delete of an absent key does not), with the number each gets."""
    w = Window.partitionBy(key).orderBy(*ORDER)
    absent = F.coalesce(F.lag("tombstone").over(w), F.lit(True))
    kept = log.withColumn("__absent", absent).where("not (tombstone and __absent)").drop("__absent")
    return numbered(kept, "new_seq")


def numbered(rows: DataFrame, out: str, buckets: int = 4096) -> DataFrame:
    """Rows numbered from 1 in log order without one sort of everything: counts of buckets of seq give each
    bucket's base, and each bucket is numbered alone. seq may have any spread."""
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return rows.withColumn(out, F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // buckets))
    b = rows.withColumn("__b", F.expr(f"(seq - {low}) div {width}"))
    counts = b.groupBy("__b").agg(F.count("*").alias("n"))  # at most `buckets` rows
    bases = counts.withColumn("__base", F.sum("n").over(Window.orderBy("__b")) - F.col("n")).drop("n")
    n = F.row_number().over(Window.partitionBy("__b").orderBy(*ORDER))
    return b.join(F.broadcast(bases), "__b").withColumn(out, (F.col("__base") + n).cast("long")).drop("__b", "__base")


def holds(version: Column, cond: str | int) -> Column:
    """A condition on a key's version, null where the key is absent."""
    if cond == "absent":
        return version.isNull()
    return version.isNotNull() if cond == "exists" else F.coalesce(version == F.lit(cond), F.lit(False))


def compacted(log: DataFrame) -> DataFrame:
    """The operations that a compaction keeps."""
    return latest(log).where("not tombstone")
