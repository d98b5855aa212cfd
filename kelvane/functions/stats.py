"""Summaries of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


BUCKETS = 1024


def percentile_rows(df: DataFrame, by: list[str], col: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, the element at round((n - 1) * p) of a group in order, for each named share.

    Exact, and no group is sorted whole: equal values are counted before the shuffle, the values of a group fall in BUCKETS ranges of equal
    width, counts of ranges (BUCKETS rows a group at most) tell which range holds a rank, and only those ranges are put in order.
    """
    keys = [f"__by{k}" for k in range(len(by))]
    values = df.where(F.col(col).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    ends = values.groupBy(*keys).agg(F.sum("__n").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("max"))
    place = (F.col("__v") - F.col("__low")) / F.nullif(F.col("max") - F.col("__low"), F.lit(0)) * BUCKETS
    placed = _beside(values, ends, keys).withColumn("__b", F.coalesce(F.least(F.floor(place), F.lit(BUCKETS - 1)), F.lit(0)).cast("int"))
    sizes = placed.groupBy(*keys, "__b").agg(F.sum("__n").alias("__size"), F.max("n").alias("n"))
    upto = sizes.withColumn("__base", F.sum("__size").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__size"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.round((F.col("n") - 1) * F.lit(p)).cast("long").alias("at")) for name, p in shares.items()])
    wanted = upto.withColumn("__s", F.explode(ranks)).where("__s.at >= __base and __s.at < __base + __size").select(*keys, "__b", "__base", F.col("__s.name").alias("__name"), F.col("__s.at").alias("__at"))
    ranked = _beside(placed.select(*keys, "__b", "__v", "__n"), wanted, [*keys, "__b"])
    run = F.col("__base") + F.sum("__n").over(Window.partitionBy(*keys, "__b", "__name").orderBy("__v"))
    found = ranked.withColumn("__upto", run).where("__upto > __at").groupBy(*keys).agg(*[F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in shares])
    out = _beside(ends.drop("__low"), found, keys)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", *shares, "max")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, nulls equal."""
    there = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return left.join(there, on).drop(*[f"{k}_r" for k in keys])


def ranks(df: DataFrame, key: str, lead: str, out: str, buckets: int = 4096) -> DataFrame:
    """rank() over all rows by key, without one sort of everything: lead, a number that never falls as key rises, is cut in ranges of
    equal width, whose counts give each range its base."""
    low, high = df.agg(F.min(lead), F.max(lead)).first()
    if low is None:
        return df.withColumn(out, F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // buckets))
    b = df.withColumn("__b", F.floor((F.col(lead) - F.lit(low)) / F.lit(width)).cast("int"))
    counts = b.groupBy("__b").agg(F.count("*").alias("n"))  # at most `buckets` rows
    bases = counts.withColumn("__base", F.sum("n").over(Window.orderBy("__b")) - F.col("n")).drop("n")
    return b.join(F.broadcast(bases), "__b").withColumn(out, (F.col("__base") + F.rank().over(Window.partitionBy("__b").orderBy(key))).cast("long")).drop("__b", "__base")


def latency_summary(df: DataFrame, by: str = "op", col: str = "latency_ns") -> DataFrame:
    return percentile_rows(df, [by], col, {"p50": 0.50, "p90": 0.90, "p99": 0.99, "p999": 0.999})


def geometric_mean_of_ratios(a: Column, b: Column) -> Column:
    return F.exp(F.avg(F.log(a / b)))
