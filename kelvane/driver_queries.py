"""The queries that run on the test tables, each with the same question in SQL.

The log: events as operations on users (log_e), the same in batches of ten whose inner order is not the order of
events (log_b), and on (user, event type) (log_t). Keys and values are text here, so that results compare
plainly; the library itself takes binary ones alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import keys as fk
from .functions import stats
from .model import UNBOUNDED, Bound, Direction, KeyOrder, excluded
from .operators import access, algebra
from .operators import live as lv
from .plans import planner

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
LO, HI, MID = "0000000003", "0000000090", "0000000007"

# ---- base views, here and in SQL ----

_WITH = """
WITH ev AS (SELECT event_id, lpad(CAST(user_id AS VARCHAR), 10, '0') AS u, event_type, event_type || '|' || props AS v FROM events),
log_e AS (SELECT event_id + 1 AS seq, 0 AS op_idx, u AS key, v AS value, event_type = 'error' AS tombstone FROM ev),
log_b AS (SELECT event_id // 10 + 1 AS seq, CAST(9 - event_id % 10 AS INTEGER) AS op_idx, u AS key, v AS value, event_type = 'error' AS tombstone FROM ev),
log_t AS (SELECT event_id + 1 AS seq, 0 AS op_idx, u || '/' || event_type AS key, v AS value, event_id % 7 = 0 AS tombstone FROM ev),
live_e AS (SELECT key, value, seq AS version FROM (SELECT * FROM log_e QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, op_idx DESC) = 1) WHERE NOT tombstone),
live_b AS (SELECT key, value, seq AS version FROM (SELECT * FROM log_b QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, op_idx DESC) = 1) WHERE NOT tombstone),
live_t AS (SELECT key, value, seq AS version FROM (SELECT * FROM log_t QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, op_idx DESC) = 1) WHERE NOT tombstone)
"""


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.lpad(F.col("user_id").cast("string"), 10, "0").alias("u"), "event_type", F.concat("event_type", F.lit("|"), "props").alias("v"))


def log_e(spark, sf) -> DataFrame:
    return _events(spark, sf).select((F.col("event_id") + 1).alias("seq"), F.lit(0).alias("op_idx"), F.col("u").alias("key"), F.col("v").alias("value"), (F.col("event_type") == "error").alias("tombstone"))


def log_b(spark, sf) -> DataFrame:
    return _events(spark, sf).select(F.expr("event_id div 10 + 1").alias("seq"), (9 - F.col("event_id") % 10).cast("int").alias("op_idx"), F.col("u").alias("key"), F.col("v").alias("value"), (F.col("event_type") == "error").alias("tombstone"))


def log_t(spark, sf) -> DataFrame:
    return _events(spark, sf).select((F.col("event_id") + 1).alias("seq"), F.lit(0).alias("op_idx"), F.concat("u", F.lit("/"), "event_type").alias("key"), F.col("v").alias("value"), (F.col("event_id") % 7 == 0).alias("tombstone"))


def live_e(spark, sf):
    return lv.live(log_e(spark, sf)).select("key", "value", "version")


def live_b(spark, sf):
    return lv.live(log_b(spark, sf)).select("key", "value", "version")


def live_t(spark, sf):
    return lv.live(log_t(spark, sf)).select("key", "value", "version")


def q(name: str, sql: str | None, base: bool = True):
    """Registers a query and its SQL; base: the SQL may use the views above."""
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (_WITH if base else "") + sql
        return f
    return add


def dialect(name: str, text: str, sql: str, order: KeyOrder = KeyOrder.HASHED, live=live_e):
    q(name, sql)(lambda spark, sf: planner.query(live(spark, sf), text, order))


# ---- scans and the dialect ----

dialect("full_scan", "SELECT *", "SELECT key, value FROM live_e")
dialect("project_key", "SELECT key", "SELECT key FROM live_e")
dialect("project_value", "SELECT value", "SELECT value FROM live_e")
dialect("distinct_value", "SELECT DISTINCT value", "SELECT DISTINCT value FROM live_e")
dialect("distinct_star", "SELECT DISTINCT *", "SELECT DISTINCT key, value FROM live_e")
dialect("distinct_key", "SELECT DISTINCT key", "SELECT DISTINCT key FROM live_e")
dialect("get_hit", f"SELECT * WHERE key = '{MID}'", f"SELECT key, value FROM live_e WHERE key = '{MID}'")
dialect("get_miss", "SELECT * WHERE key = 'nobody'", "SELECT key, value FROM live_e WHERE key = 'nobody'")
dialect("distinct_value_get", f"SELECT DISTINCT value WHERE key = '{MID}'", f"SELECT DISTINCT value FROM live_e WHERE key = '{MID}'")
dialect("range_between", f"SELECT * WHERE key BETWEEN '{LO}' AND '{HI}'", f"SELECT key, value FROM live_e WHERE key BETWEEN '{LO}' AND '{HI}'", KeyOrder.SORTED)
dialect("range_between_hashed", f"SELECT * WHERE key BETWEEN '{LO}' AND '{HI}'", f"SELECT key, value FROM live_e WHERE key BETWEEN '{LO}' AND '{HI}'")
dialect("range_inverted", f"SELECT key WHERE key BETWEEN '{HI}' AND '{LO}'", f"SELECT key FROM live_e WHERE key BETWEEN '{HI}' AND '{LO}'", KeyOrder.SORTED)
dialect("distinct_value_range", f"SELECT DISTINCT value WHERE key BETWEEN '{LO}' AND '{HI}'", f"SELECT DISTINCT value FROM live_e WHERE key BETWEEN '{LO}' AND '{HI}'", KeyOrder.SORTED)


@q("get_versioned", f"SELECT value, version FROM live_e WHERE key = '{MID}'")
def get_versioned(spark, sf):
    return access.get(live_e(spark, sf), MID).select("value", "version")


@q("range_excl", f"SELECT key, value FROM live_e WHERE key > '{LO}' AND key < '{HI}'")
def range_excl(spark, sf):
    return access.scan(live_e(spark, sf), excluded(LO), excluded(HI)).select("key", "value")


@q("range_open", f"SELECT key, value FROM live_e WHERE key >= '{HI}'")
def range_open(spark, sf):
    return access.scan(live_e(spark, sf), Bound(HI), UNBOUNDED).select("key", "value")


@q("page_first_fwd", "SELECT key, value, version FROM live_t ORDER BY key LIMIT 20")
def page_first_fwd(spark, sf):
    return access.scan_page(live_t(spark, sf), UNBOUNDED, UNBOUNDED, Direction.FORWARD, 20)


@q("page_second_fwd", "SELECT key, value, version FROM live_t ORDER BY key LIMIT 20 OFFSET 20")
def page_second_fwd(spark, sf):
    live = live_t(spark, sf)
    last = access.scan_page(live, UNBOUNDED, UNBOUNDED, Direction.FORWARD, 20).agg(F.max("key")).first()[0]
    return access.scan_page(live, excluded(last), UNBOUNDED, Direction.FORWARD, 20)


@q("page_first_rev", "SELECT key, value, version FROM live_t ORDER BY key DESC LIMIT 20")
def page_first_rev(spark, sf):
    return access.scan_page(live_t(spark, sf), UNBOUNDED, UNBOUNDED, Direction.REVERSE, 20)


@q("page_zero", "SELECT key, value, version FROM live_t LIMIT 0")
def page_zero(spark, sf):
    return access.scan_page(live_t(spark, sf), UNBOUNDED, UNBOUNDED, Direction.FORWARD, 0)


q("floor_key", f"SELECT key, value, version FROM live_t WHERE key <= '{MID}/d' ORDER BY key DESC LIMIT 1")(lambda s, sf: access.floor_key(live_t(s, sf), f"{MID}/d"))
q("ceil_key", f"SELECT key, value, version FROM live_t WHERE key >= '{MID}/d' ORDER BY key LIMIT 1")(lambda s, sf: access.ceil_key(live_t(s, sf), f"{MID}/d"))
q("first_n", "SELECT key, value, version FROM live_t ORDER BY key LIMIT 7")(lambda s, sf: access.first_n(live_t(s, sf), 7))
q("last_n", "SELECT key, value, version FROM live_t ORDER BY key DESC LIMIT 7")(lambda s, sf: access.last_n(live_t(s, sf), 7))
q("next_after", f"SELECT key, value, version FROM live_t WHERE key > '{MID}' ORDER BY key LIMIT 1")(lambda s, sf: access.next_after(live_t(s, sf), MID))
q("prev_before", f"SELECT key, value, version FROM live_t WHERE key < '{MID}' ORDER BY key DESC LIMIT 1")(lambda s, sf: access.prev_before(live_t(s, sf), MID))
q("prefix_scan", "SELECT key, value, version FROM live_t WHERE starts_with(key, '000000000')")(lambda s, sf: access.prefix(live_t(s, sf), "000000000"))
q("list_keys", "SELECT key FROM live_t")(lambda s, sf: access.list_keys(live_t(s, sf)))
q("live_count", "SELECT count(*) AS n FROM live_t")(lambda s, sf: access.count(live_t(s, sf)))
q("fold_value_bytes", "SELECT CAST(sum(length(value)) AS BIGINT) AS value_bytes FROM live_e")(lambda s, sf: access.value_bytes(live_e(s, sf)))
q("fold_max_id", "SELECT max(CAST(key AS BIGINT)) + 1 AS next_id FROM live_e")(lambda s, sf: access.next_id(live_e(s, sf)))
q("select_by_scan_visited", f"SELECT (SELECT count(*) FROM live_e WHERE key = '{MID}') AS n, (SELECT count(*) FROM live_e) AS visited")(lambda s, sf: (lambda rows, visited: rows.agg(F.count("*").alias("n")).crossJoin(visited))(*planner.select_by_scan(live_e(s, sf), MID)))

# ---- the log: last write wins, numbers, time, compaction ----

q("lww_recover", "SELECT key, value, version FROM live_e")(live_e)
q("lww_batches", "SELECT key, value, version FROM live_b")(live_b)


@q("lww_tombstones", "SELECT key, seq FROM (SELECT * FROM log_e QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, op_idx DESC) = 1) WHERE tombstone")
def lww_tombstones(spark, sf):
    return lv.latest(log_e(spark, sf)).where("tombstone").select("key", "seq")


@q("batch_versions", "SELECT version, count(*) AS n FROM live_b GROUP BY version")
def batch_versions(spark, sf):
    return live_b(spark, sf).groupBy("version").agg(F.count("*").alias("n"))


@q("seq_assignment", "SELECT key, seq, row_number() OVER (ORDER BY seq, op_idx) AS new_seq FROM (SELECT *, coalesce(lag(tombstone) OVER (PARTITION BY key ORDER BY seq, op_idx), true) AS absent FROM log_e) WHERE NOT (tombstone AND absent)")
def seq_assignment(spark, sf):
    return lv.effective(log_e(spark, sf)).select("key", "seq", "new_seq")


q("next_seq", "SELECT max(seq) + 1 AS next_seq FROM log_e")(lambda s, sf: lv.next_seq(log_e(s, sf)))
q("as_of_seq", "SELECT key, value, seq AS version FROM (SELECT * FROM log_e WHERE seq <= 400 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, op_idx DESC) = 1) WHERE NOT tombstone")(lambda s, sf: lv.as_of(log_e(s, sf), 400).select("key", "value", "version"))


@q("merge_equiv", "SELECT key, value, version FROM live_e")
def merge_equiv(spark, sf):
    """The live relation after the first half of the log has been compacted."""
    log = log_e(spark, sf)
    half = log.agg(F.max("seq")).first()[0] // 2
    return lv.live(lv.compacted(log.where(F.col("seq") <= half)).unionByName(log.where(F.col("seq") > half))).select("key", "value", "version")


@q("merge_reclaimed", "SELECT h.half, count(*) AS ops, count(*) - count(*) FILTER (WHERE r = 1 AND NOT tombstone) AS reclaimed FROM (SELECT seq <= (SELECT max(seq) // 2 FROM log_e) AS half, tombstone, row_number() OVER (PARTITION BY seq <= (SELECT max(seq) // 2 FROM log_e), key ORDER BY seq DESC, op_idx DESC) AS r FROM log_e) h GROUP BY h.half")
def merge_reclaimed(spark, sf):
    log = log_e(spark, sf)
    half = log.agg(F.max("seq")).first()[0] // 2
    halves = log.withColumn("half", F.col("seq") <= half)
    w = Window.partitionBy("half", "key").orderBy(F.desc("seq"), F.desc("op_idx"))
    r = halves.withColumn("r", F.row_number().over(w))
    return r.groupBy("half").agg(F.count("*").alias("ops"), (F.count("*") - F.count_if((F.col("r") == 1) & ~F.col("tombstone"))).alias("reclaimed"))


# ---- changes ----

@q("insert_absent", "SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) = 1 AS applied FROM log_e")
def insert_absent(spark, sf):
    return algebra.first_wins(log_e(spark, sf).select("seq", "key"))


_HALF = "(SELECT max(seq) // 2 FROM log_e)"
_FIRST = f"(SELECT key, seq AS version FROM (SELECT * FROM log_e WHERE seq <= {_HALF} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone)"


def _halves(spark, sf):
    log = log_e(spark, sf)
    half = log.agg(F.max("seq")).first()[0] // 2
    return log.where(F.col("seq") <= half), log.where(F.col("seq") > half)


@q("insert_absent_live", f"SELECT a.seq, a.key, l.version IS NULL AND row_number() OVER (PARTITION BY a.key ORDER BY a.seq) = 1 AS applied FROM (SELECT seq, key FROM log_e WHERE seq > {_HALF}) a LEFT JOIN {_FIRST} l ON a.key = l.key")
def insert_absent_live(spark, sf):
    """The log's second half as inserts into what its first half has left."""
    first, second = _halves(spark, sf)
    return algebra.first_wins(second.select("seq", "key"), lv.live(first)).select("seq", "key", "applied")


@q("conditions_hold", f"SELECT a.seq, l.version IS NULL AS absent, l.version IS NOT NULL AS present, coalesce(l.version = a.seq - 1000, false) AS same FROM (SELECT seq, key FROM log_e WHERE seq > {_HALF}) a LEFT JOIN {_FIRST} l ON a.key = l.key")
def conditions_hold(spark, sf):
    """Each condition of a batch on each key of the second half, against the first half's state."""
    first, second = _halves(spark, sf)
    met = second.select("seq", "key").join(lv.live(first).select("key", "version"), "key", "left")
    v = F.col("version")
    return met.select("seq", lv.holds(v, "absent").alias("absent"), lv.holds(v, "exists").alias("present"), F.coalesce(v == F.col("seq") - 1000, F.lit(False)).alias("same"))


@q("update_cas", "SELECT a.seq, a.key, l.version IS NOT NULL AND row_number() OVER (PARTITION BY a.key ORDER BY a.seq) = 1 AS applied FROM (SELECT seq, key FROM log_e WHERE seq > (SELECT max(seq) // 2 FROM log_e)) a LEFT JOIN (SELECT key, seq AS version FROM (SELECT * FROM log_e WHERE seq <= (SELECT max(seq) // 2 FROM log_e) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT tombstone) l ON a.key = l.key")
def update_cas(spark, sf):
    log = log_e(spark, sf)
    half = log.agg(F.max("seq")).first()[0] // 2
    first = lv.live(log.where(F.col("seq") <= half)).select("key", "version")
    attempts = log.where(F.col("seq") > half).select("seq", "key").join(first.withColumnRenamed("version", "expected"), "key", "left")
    return algebra.compare_and_put(first, attempts).select("seq", "key", "applied")


@q("delete_where", "SELECT key, value, version FROM live_e WHERE NOT starts_with(value, 'click')")
def delete_where(spark, sf):
    log = log_e(spark, sf)
    gone = algebra.delete_where(live_e(spark, sf), F.col("value").startswith("click"), 10**12)
    return lv.live(log.unionByName(gone)).select("key", "value", "version")


@q("insert_select", "SELECT key, value, version FROM live_e UNION ALL SELECT 'order/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), o_orderstatus, 1000000000000 FROM orders")
def insert_select(spark, sf):
    rows = read(spark, sf, "orders").select(F.concat(F.lit("order/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("key"), F.col("o_orderstatus").alias("value"))
    return lv.live(log_e(spark, sf).unionByName(algebra.insert_rows(rows, 10**12))).select("key", "value", "version")


@q("fk_violations", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)", False)
def fk_violations(spark, sf):
    parent = read(spark, sf, "customer").where("c_acctbal >= 0")
    return algebra.foreign_key_violations(read(spark, sf, "orders"), "o_custkey", parent, "c_custkey").select("o_orderkey")


q("domain_violations", "SELECT p_partkey FROM part WHERE NOT coalesce(p_size BETWEEN 5 AND 45, false)", False)(lambda s, sf: algebra.domain_violations(read(s, sf, "part"), F.col("p_size").between(5, 45)).select("p_partkey"))

# ---- algebra ----


def _nations(rows, col):
    return rows.select(F.col(col).alias("nationkey"))


_CS = ("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < -900", "SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 7000")


def _cs(spark, sf):
    return _nations(read(spark, sf, "customer").where("c_acctbal < -900"), "c_nationkey"), _nations(read(spark, sf, "supplier").where("s_acctbal > 7000"), "s_nationkey")


q("union_set", f"{_CS[0]} UNION {_CS[1]}", False)(lambda s, sf: algebra.union(*_cs(s, sf)))
q("intersect_set", f"{_CS[0]} INTERSECT {_CS[1]}", False)(lambda s, sf: algebra.intersect(*_cs(s, sf)))
q("except_set", f"{_CS[0]} EXCEPT {_CS[1]}", False)(lambda s, sf: algebra.difference(*_cs(s, sf)))
q("project_set", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", False)(lambda s, sf: algebra.project(read(s, sf, "orders"), "o_orderstatus", "o_orderpriority"))
q("product", "SELECT r_name, n_name FROM region, nation", False)(lambda s, sf: algebra.product(read(s, sf, "region").select("r_name"), read(s, sf, "nation").select("n_name")))
q("theta_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", False)(lambda s, sf: algebra.theta_join(algebra.rename(read(s, sf, "nation"), n_name="x", n_nationkey="xk", n_regionkey="xr"), algebra.rename(read(s, sf, "nation"), n_name="y", n_nationkey="yk", n_regionkey="yr"), (F.col("xr") == F.col("yr")) & (F.col("xk") < F.col("yk"))).select("x", "y"))
q("equi_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'", False)(lambda s, sf: algebra.equi_join(read(s, sf, "orders").where("o_orderstatus = 'F'"), read(s, sf, "customer"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name"))
q("natural_join", "SELECT DISTINCT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", False)(lambda s, sf: algebra.natural_join(read(s, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), read(s, sf, "nation").select("n_nationkey", "n_name")).select("s_suppkey", "n_name"))


@q("division", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)", False)
def division(spark, sf):
    o = read(spark, sf, "orders")
    return algebra.divide(o.select("o_custkey", "o_orderpriority"), o.select("o_orderpriority"))


@q("oldest_by_difference", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders)", False)
def oldest_by_difference(spark, sf):
    return algebra.without_earlier(read(spark, sf, "orders"), "o_orderdate").select("o_orderkey")


def _orders_kv(spark, sf):
    return read(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.col("o_orderstatus").alias("status"), "o_custkey", "o_orderpriority")


_KV = "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderstatus AS status, o_custkey, o_orderpriority FROM orders"


@q("index_lookup", f"SELECT key, status, o_orderpriority FROM ({_KV}) WHERE o_custkey = 7", False)
def index_lookup(spark, sf):
    kv = _orders_kv(spark, sf)
    return algebra.index_lookup(algebra.index_on(kv, "o_custkey"), F.col("o_custkey") == 7, kv.drop("o_custkey")).select("key", "status", "o_orderpriority")


q("covering_index", f"SELECT status, key FROM ({_KV}) WHERE status = 'P'", False)(lambda s, sf: algebra.index_on(_orders_kv(s, sf), "status").where("status = 'P'"))
q("unique_index_violations", f"SELECT o_custkey, status, count(*) AS n FROM ({_KV}) GROUP BY 1, 2 HAVING count(*) > 1", False)(lambda s, sf: algebra.unique_violations(_orders_kv(s, sf), "o_custkey", "status"))
q("bags_semi", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", False)(lambda s, sf: read(s, sf, "supplier").join(read(s, sf, "nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey"))
q("bags_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey", False)(lambda s, sf: algebra.bag_join(read(s, sf, "supplier").select("s_suppkey", "s_nationkey"), read(s, sf, "customer").select("c_custkey", "c_nationkey"), {"s_nationkey": "c_nationkey"}).select("s_suppkey", "c_custkey"))


@q("bags_not_in", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)", False)
def bags_not_in(spark, sf):
    read(spark, sf, "supplier").createOrReplaceTempView("kelvane_supplier")
    read(spark, sf, "nation").createOrReplaceTempView("kelvane_nation")
    return spark.sql("SELECT count(*) AS n FROM kelvane_nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM kelvane_supplier)")


@q("bags_not_exists", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE nullif(s_nationkey, 3) = n_nationkey AND s_acctbal > 5000)", False)
def bags_not_exists(spark, sf):
    s = read(spark, sf, "supplier").where("s_acctbal > 5000").select(F.expr("nullif(s_nationkey, 3)").alias("k"))
    return read(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("k"), "left_anti").select("n_nationkey")


q("bag_sum_vs_set_sum", "SELECT CAST(sum(p_size) AS BIGINT) AS of_bag, (SELECT CAST(sum(p_size) AS BIGINT) FROM (SELECT DISTINCT p_brand, p_size FROM part)) AS of_set FROM part", False)(lambda s, sf: read(s, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).agg(F.sum(F.col("p_size") * F.col("n")).alias("of_bag"), F.sum("p_size").alias("of_set")))


# ---- functions ----


@q("composite_key_order", "SELECT l_orderkey, l_shipmode, r FROM (SELECT o_custkey - 500 AS l_orderkey, o_orderpriority AS l_shipmode, o_orderkey, rank() OVER (ORDER BY o_custkey - 500, o_orderpriority, o_orderkey) AS r FROM orders)", False)
def composite_key_order(spark, sf):
    """Ranks by the encoded key are those by the columns."""
    o = read(spark, sf, "orders").select((F.col("o_custkey") - 500).alias("l_orderkey"), F.col("o_orderpriority").alias("l_shipmode"), "o_orderkey")
    key = fk.composite(fk.encode_long(F.col("l_orderkey")), fk.encode_text(F.col("l_shipmode")), fk.encode_long(F.col("o_orderkey")))
    return stats.ranks(o.withColumn("k", key), "k", "l_orderkey", "r").select("l_orderkey", "l_shipmode", "r")


q("key_roundtrip", "SELECT o_orderkey - 700 AS x FROM orders", False)(lambda s, sf: read(s, sf, "orders").select(fk.decode_long(fk.encode_long(F.col("o_orderkey") - 700)).alias("x")))
q("load_keys", "SELECT 'key-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k FROM orders", False)(lambda s, sf: read(s, sf, "orders").select(fk.load_key(F.col("o_orderkey")).alias("k")))
q("packed_sizes", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS size, o_orderstatus = 'F' AS dead FROM orders", False)(lambda s, sf: read(s, sf, "orders").withColumn("p", fk.pack_key_size(F.col("o_custkey"), F.col("o_orderstatus") == "F")).select("o_orderkey", fk.key_size(F.col("p")).alias("size"), fk.is_tombstone(F.col("p")).alias("dead")))


_PCT = ", ".join(f"min(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE r > round((n - 1) * {p})) AS {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))


@q("percentile_nearest_rank", f"SELECT l_returnflag, max(n) AS n, {_PCT}, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS max FROM (SELECT l_returnflag, l_extendedprice, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY 1", False)
def percentile_nearest_rank(spark, sf):
    l = read(spark, sf, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))  # noqa: E741
    return stats.percentile_rows(l, ["l_returnflag"], "cents", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


_LAT = ", ".join(f"min(x) FILTER (WHERE r > round((n - 1) * {p})) AS {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999)))


@q("latency_summary", f"SELECT op, max(n) AS n, {_LAT}, max(x) AS max FROM (SELECT event_type AS op, CAST(round(value * 1000) AS BIGINT) AS x, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r FROM events) GROUP BY 1", False)
def latency_summary(spark, sf):
    return stats.latency_summary(read(spark, sf, "events").select(F.col("event_type").alias("op"), F.round(F.col("value") * 1000).cast("long").alias("latency_ns")))


q("geomean_ratio", "SELECT p_brand, CAST(round(exp(avg(ln((p_retailprice + 1) / (p_size + 1)))) * 1000000) AS BIGINT) AS g FROM part GROUP BY 1", False)(lambda s, sf: read(s, sf, "part").groupBy("p_brand").agg(F.round(stats.geometric_mean_of_ratios(F.col("p_retailprice") + 1, F.col("p_size") + 1) * 1000000).cast("long").alias("g")))
@q("checksums", "SELECT event_id, event_type FROM events", False)
def checksums(spark, sf):
    """Rows whose CRC-32 by Spark is the one that the binary format stores (zlib's): all rows, if the two agree."""
    import zlib

    @F.pandas_udf("long")
    def stored(raw):
        return raw.map(zlib.crc32)

    e = read(spark, sf, "events").select("event_id", "event_type")
    raw = F.encode(F.to_json(F.struct("event_id", "event_type")), "UTF-8")
    return e.where(F.crc32(raw) == stored(raw))


# ---- stores and files that are written and read back ----

def _store(spark):
    """A new store in the folder that driver and executors share."""
    import tempfile
    import uuid

    from .sources.store import Store

    shared = spark.conf.get("spark.checkpoint.dir", None)
    return Store.open(spark, f"{shared.removeprefix('file://')}/store-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp())


def _ops(log):
    raw = lambda c: F.encode(c, "UTF-8").alias(c)
    return log.select("seq", "op_idx", raw("key"), raw("value"), "tombstone")


def _shown(live):
    text = lambda c: F.decode(c, "UTF-8").alias(c)
    return live.select(text("key"), text("value"), "version")


@q("store_two_batches", f"SELECT key, value, CASE WHEN version <= {_HALF} THEN 1 ELSE 2 END AS version FROM live_e")
def store_two_batches(spark, sf):
    """Each half of the log written as one batch of a store; what is live then."""
    with _store(spark) as store:
        for half in _halves(spark, sf):
            store.write_frame(lv.latest(_ops(half)).select("key", "value", "tombstone"))
        return _shown(store.live())


@q("store_merged", f"SELECT key, value, CASE WHEN version <= {_HALF} THEN 1 ELSE 2 END AS version FROM live_e")
def store_merged(spark, sf):
    """The same after a merge between the batches and one after them."""
    with _store(spark) as store:
        for half in _halves(spark, sf):
            store.write_frame(lv.latest(_ops(half)).select("key", "value", "tombstone"))
            store.merge()
        return _shown(store.live())


@q("native_roundtrip", "SELECT key, value, version FROM live_e")
def native_roundtrip(spark, sf):
    """All events as files of the binary format, read back, and the last write of each key. Tasks write the files and
    tasks read them, so they need a folder that all see."""
    import tempfile
    import uuid

    from .sources import native

    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{shared.removeprefix('file://')}/native-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp()
    log = log_e(spark, sf)
    native.write_native_frame(log.select("seq", "op_idx", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), "tombstone"), folder)
    return lv.live(native.read_native(spark, folder), order=lv.NATIVE_ORDER).select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "version")


@q("load_profile", None)
def load_profile(spark, sf):
    from .sources import loadgen

    return loadgen.workload(spark, 20_000).groupBy("op").agg(F.count("*").alias("n"))
