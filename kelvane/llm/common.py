"""What several operators share: a folder that every executor sees, staged tables and
connected components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, one machine) a
    temporary folder is made and set for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="kelvane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kelvane/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors. What was shuffled on the way is
    removed at once, as nothing reads it again; else it stays until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a staged table that no later step reads: all that came of it is staged itself, so lost executors do not ask for it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_pieces(batches, columns: list[str], max_chars: int = 2_000_000):
    """Lists of the columns of some rows, whose last column, a text, sums to about max_chars: the
    memory of a Python worker depends on that and on the longest text alone."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        sizes = pc.fill_null(pc.binary_length(cols[-1]), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= max_chars or i == len(sizes) - 1:
                yield [c.slice(start, i + 1 - start).to_pylist() for c in cols]
                start, total = i + 1, 0


def lean(run):
    """run, a function of batches, that gives freed memory back to the system when its task ends: a worker that Spark keeps for later tasks
    would hold the most that any took."""
    @functools.wraps(run)
    def and_trim(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return and_trim


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in edges (a, b: longs).

    Large-star and small-star rounds (Kiveris et al. 2014) on staged tables until the edges no
    longer change. Each round pre-aggregates per node and joins what comes out, staged, with the edges. Empty edges give an empty result; self links and repeats are fine.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b <= a")
        # staged, so that the join is of two plain tables and adaptive execution may split a hub
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            return out.where("a <> b").distinct()
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    mark = None
    for _ in range(max_rounds):
        now = staged(star(star(now, True), False), f"{name}-star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("links did not settle")
    # settled: each node other than the smallest of its component has one edge, to the smallest
    pairs = now.groupBy("a").agg(F.min("b").alias("b"))
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
