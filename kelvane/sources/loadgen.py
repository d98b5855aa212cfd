"""A synthetic mixed load: gets, puts and deletes 8 : 2 : 1 over numbered keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import load_key

# Fixed values of the profile.
WEIGHTS = {"get": 8, "put": 2, "delete": 1}
KEYS, VALUE = 10_000, b"\xab" * 128


def workload(spark: SparkSession, n: int, keys: int = KEYS, seed: int = 1, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """(i, op, key, value) of n operations; the same for the same seed, however it is partitioned."""
    total = sum(weights.values())
    draw = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(total))
    op, upto = None, 0
    for name, w in weights.items():
        upto += w
        op = F.when(draw < upto, name) if op is None else op.when(draw < upto, name)
    rows = spark.range(n).withColumnRenamed("id", "i")
    key = F.encode(load_key(F.pmod(F.xxhash64("i", F.lit(seed + 1)), F.lit(keys))), "UTF-8")
    return rows.select("i", op.alias("op"), key.alias("key")).withColumn("value", F.when(F.col("op") == "put", F.lit(VALUE)))


def as_log(load: DataFrame) -> DataFrame:
    """The load's writes as a log."""
    return load.where("op <> 'get'").select((F.col("i") + 1).alias("seq"), F.lit(0).alias("op_idx"), "key", "value", (F.col("op") == "delete").alias("tombstone"), F.lit(0).cast("long").alias("ts"))
