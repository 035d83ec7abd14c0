"""One query per operator over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow import functions as C
from weirflow import operators as O
from weirflow.plans.graph import Graph
from weirflow.plans.iterate import iterate
from weirflow.plans.workloads import first_rows, k_means, least_record_per_key
from weirflow.schema import flattened
from weirflow.functions.lifecycle import Function, environment
from weirflow.session import Session
from weirflow.shared import fresh_path
from weirflow.sources import generate, read_csv, table, write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- per-record operators ---------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, 'HELLO' AS tag, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def map_project(spark, sf):
    df = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return O.map_rows(df, "l_orderkey", "l_linenumber", "'HELLO' AS tag", "l_extendedprice * (1 - l_discount) AS net")


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def map_python(spark, sf):
    df = table(spark, sf, "events", "event_id", "event_type")
    return O.map_rows(df, function=lambda r: (r["event_id"], r["event_type"].upper()), schema="event_id long, kind string")


@query("SELECT unnest(['HEL', 'LO']) AS word, event_id + unnest([0, 1]) AS n FROM events WHERE event_id % 10 = 0")
def flat_map(spark, sf):
    df = O.filter_rows(table(spark, sf, "events", "event_id"), "event_id % 10 = 0")
    pair = lambda w, k: F.struct(F.lit(w).alias("word"), (F.col("event_id") + k).alias("n"))
    return O.flat_map(df, F.array(pair("HEL", 0), pair("LO", 1)))


@query("SELECT event_id, unnest(string_split(event_type, 'c')) AS part FROM events")
def flat_map_python(spark, sf):
    df = table(spark, sf, "events", "event_id", "event_type")
    return O.flat_map(df, function=lambda r: ((r["event_id"], p) for p in r["event_type"].split("c")), schema="event_id long, part string")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 2 = 0")
def filter_even(spark, sf):
    return O.filter_rows(table(spark, sf, "events", "event_id", "user_id", "event_type", "value"), "event_id % 2 = 0")


@query("SELECT event_id, value FROM events WHERE value > 50")
def filter_python(spark, sf):
    return O.filter_rows(table(spark, sf, "events", "event_id", "value"), function=lambda r: r["value"] is not None and r["value"] > 50)


@query("SELECT event_id, 'HELLO' || (SELECT string_agg(r_name, '' ORDER BY r_name) FROM region) AS word FROM events")
def map_broadcast_var(spark, sf):
    names = table(spark, sf, "region", "r_name").agg(F.array_join(F.array_sort(F.collect_list("r_name")), "").alias("names"))
    return O.map_with_broadcast(table(spark, sf, "events", "event_id"), names, "event_id", "concat('HELLO', names) AS word")


@query("SELECT event_id, 'HELLO' || (SELECT string_agg(r_name, '' ORDER BY r_name) FROM region) AS word FROM events")
def map_broadcast_rows(spark, sf):
    """A broadcast variable of many rows, as an array."""
    word = "concat('HELLO', array_join(transform(array_sort(names), x -> x.r_name), '')) AS word"
    return O.map_with_broadcast(table(spark, sf, "events", "event_id"), table(spark, sf, "region", "r_name"), "event_id", word, collection="names")


class NationNames(Function):
    """Names a customer's nation from a broadcast collection that is made into a table once per task."""

    def create(self, environment):
        self.names = {r["n_nationkey"]: r["n_name"] for r in environment.collection("nations")}
        self.tag, self.calls = environment.property("tag"), 0

    def __call__(self, row):
        self.calls += 1
        return (row["c_custkey"], f"{self.tag}{self.names[row['c_nationkey']]}", self.calls > 0)

    def release(self):
        self.names = None


@query("SELECT c_custkey, 'of ' || n_name AS nation, true AS created FROM customer JOIN nation ON c_nationkey = n_nationkey")
def map_lifecycle(spark, sf):
    given = environment(spark, {"tag": "of "}, nations=table(spark, sf, "nation", "n_nationkey", "n_name"))
    return O.map_rows(table(spark, sf, "customer", "c_custkey", "c_nationkey"), function=NationNames(), schema="c_custkey long, nation string, created boolean", environment=given)


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def map_partitions_python(spark, sf):
    """Whole partitions in Python: sums per user of each Arrow batch, which are then added up."""

    def sums(batches):
        for batch in batches:
            import pyarrow as pa

            own = pa.Table.from_batches([batch]).group_by("user_id").aggregate([("value", "count"), ("value", "sum")])
            yield pa.RecordBatch.from_arrays([own.column(c).combine_chunks() for c in ("user_id", "value_count", "value_sum")], names=["user_id", "n", "total"])

    parts = O.map_partitions(table(spark, sf, "events", "user_id", "value"), sums, "user_id long, n long, total double")
    return O.hash_fold(parts, "user_id", F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("SELECT 'HEL' AS word, event_id AS n FROM events WHERE event_id % 10 = 0 AND event_id % 2 = 0")
def chained_map_flat_map_filter(spark, sf):
    """Several operators as one graph; the optimizer fuses them."""
    g = Graph("chain").add("source", lambda: table(spark, sf, "events", "event_id"))
    g.add("map", lambda d: O.map_rows(d, "'HELLO' AS word", "event_id AS n"), "source")
    pair = F.array(F.struct(F.lit("HEL").alias("word"), F.col("n")), F.struct(F.lit("LO").alias("word"), (F.col("n") + 1).alias("n")))
    g.add("flat_map", lambda d: O.flat_map(O.filter_rows(d, "n % 10 = 0"), pair), "map")
    g.add("filter", lambda d: O.filter_rows(d, "n % 2 = 0"), "flat_map")
    return g.submit()["filter"]


# -- joins ------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def hash_join_unique(spark, sf):
    pairs = O.hash_join(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "o_orderkey", "l_orderkey")
    return pairs.select("_1.o_orderkey", "_1.o_totalprice", "_2.l_linenumber", "_2.l_quantity")


@query("SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def merge_join(spark, sf):
    pairs = O.merge_join(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "o_orderkey", "l_orderkey")
    return pairs.select("_1.o_orderkey", "_1.o_totalprice", "_2.l_linenumber", "_2.l_quantity")


@query("""
SELECT p.event_id, b.event_id AS last_id, b.event_type AS last_type, b.value AS last_value
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1) b
JOIN events p ON b.user_id = p.user_id WHERE p.event_type = 'purchase'
""")
def hash_join_last_wins(spark, sf):
    events = table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    pairs = O.hash_join(events, events.where("event_type = 'purchase'"), "user_id", "user_id", duplicates="last", order="event_id")
    return pairs.select("_2.event_id", F.col("_1.event_id").alias("last_id"), F.col("_1.event_type").alias("last_type"), F.col("_1.value").alias("last_value"))


@query("""
SELECT c_custkey, c_name, o_orderkey, l_linenumber, l_quantity
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
""")
def join_chain_nested(spark, sf):
    first = O.hash_join(table(spark, sf, "customer", "c_custkey", "c_name"), table(spark, sf, "orders", "o_orderkey", "o_custkey"), "c_custkey", "o_custkey")
    second = O.hash_join(first, table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "_2.o_orderkey", "l_orderkey")
    return second.select("_1._1.c_custkey", "_1._1.c_name", "_1._2.o_orderkey", "_2.l_linenumber", "_2.l_quantity")


@query("SELECT l1.l_orderkey AS a_l_orderkey, l1.l_linenumber AS a_l_linenumber, l2.s_suppkey AS b_s_suppkey, l2.s_name AS b_s_name FROM lineitem l1 JOIN supplier l2 ON l1.l_suppkey = l2.s_suppkey")
def join_flattened(spark, sf):
    pairs = O.hash_join(table(spark, sf, "supplier", "s_suppkey", "s_name"), table(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber"), "s_suppkey", "l_suppkey")
    wide = flattened(pairs.select(F.col("_2").alias("a"), F.col("_1").alias("b")))
    return wide.select("a_l_orderkey", "a_l_linenumber", "b_s_suppkey", "b_s_name")


# -- sets -------------------------------------------------------------------------
@query("SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf):
    return O.union_all(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, sf, "supplier", "s_nationkey"))


@query("SELECT c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey IS NOT DISTINCT FROM c.c_nationkey AND s.s_acctbal > 5000)")
def difference(spark, sf):
    return O.difference(table(spark, sf, "customer", "c_nationkey"), table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(spark, sf):
    return O.distinct(table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_linenumber"))


# -- sorting ------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders ORDER BY rank LIMIT 100")
def sort_top_k(spark, sf):
    first = O.top_k(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, ascending=False)
    # A hundred rows: numbering them in one task is fine.
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey"))).cast("long"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position FROM orders")
def sort_total(spark, sf):
    """All orders in one order, with each one's place in it."""
    return O.with_positions(O.sort(table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey", "o_orderkey"]))


@query("SELECT c_custkey, c_acctbal, true AS in_order FROM customer")
def sort_in_partitions(spark, sf):
    """Sorted partitions, with whether each row follows a lesser or equal one of its partition."""
    own = O.sort_within_partitions(O.hash_partition(table(spark, sf, "customer", "c_custkey", "c_acctbal"), "c_custkey", 8), "c_acctbal")
    placed = own.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    before = F.lag("c_acctbal").over(Window.partitionBy("part").orderBy("place"))
    return placed.select("c_custkey", "c_acctbal", F.coalesce(before <= F.col("c_acctbal"), F.lit(True)).alias("in_order"))


# -- folds --------------------------------------------------------------------------
@query("SELECT 'RESULT' AS tag, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem")
def fold_global(spark, sf):
    return O.fold(table(spark, sf, "lineitem", "l_linenumber"), F.first(F.lit("RESULT")).alias("tag"), F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
def fold_empty(spark, sf):
    return O.fold(table(spark, sf, "lineitem", "l_quantity").where("l_quantity < 0"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def hash_fold(spark, sf):
    df = O.filter_rows(table(spark, sf, "lineitem"), F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return O.hash_fold(df, ["l_returnflag", "l_linestatus"], F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum(net), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY event_type")
def fold_monoid_python(spark, sf):
    """A fold by Python functions, in two phases."""
    fold = O.aggregate.Monoid(lambda: (0, 0), lambda r: (1, r["event_id"]), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return O.monoid(table(spark, sf, "events", "event_id", "event_type"), "event_type", fold, "event_type string, n long, total long", finish=lambda v: v)


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_suppkey) AS k FROM lineitem) WHERE k = 1
""")
def fold_min_record(spark, sf):
    df = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return least_record_per_key(df, "l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")


_RUNS = """
SELECT event_type, run::BIGINT AS run, count(*) AS n, min(event_id) AS first_id FROM (
  SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM (
    SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS NOT DISTINCT FROM event_type AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events))
GROUP BY event_type, run
"""


@query(_RUNS)
def group_runs(spark, sf):
    return O.group_runs(table(spark, sf, "events", "event_id", "event_type"), "event_id", "event_type", F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).select("event_type", F.col("run").cast("long").alias("run"), "n", "first_id")


@query(_RUNS.replace("min(event_id) AS first_id", "min(value) AS least, max(props) AS props, count(DISTINCT user_id) AS users"))
def group_runs_values(spark, sf):
    """Runs with aggregates of columns that the grouping itself doesn't read."""
    out = O.group_runs(table(spark, sf, "events"), "event_id", "event_type", F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("props").alias("props"), F.count_distinct("user_id").alias("users"))
    return out.select("event_type", F.col("run").cast("long").alias("run"), "n", "least", "props", "users")


@query("""
SELECT user_id, event_type, run::BIGINT AS run, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (
    SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, event_type, run
""")
def group_runs_per_user(spark, sf):
    return O.group_runs(table(spark, sf, "events", "event_id", "user_id", "event_type"), "event_id", "event_type", F.count(F.lit(1)).alias("n"), partition_by="user_id").select("user_id", "event_type", F.col("run").cast("long").alias("run"), "n")


@query("""
SELECT user_id, 'first' AS which, min(event_id) AS event_id FROM events GROUP BY user_id
UNION ALL SELECT user_id, 'last', max(event_id) FROM events GROUP BY user_id
""")
def map_group(spark, sf):
    def ends(rows):
        first = last = None
        for r in rows:
            first, last = first or r, r
        return [(first["user_id"], "first", first["event_id"]), (last["user_id"], "last", last["event_id"])]

    return O.map_group(table(spark, sf, "events", "event_id", "user_id"), "user_id", ends, "user_id long, which string, event_id long", order="event_id")


_STEPS = """
SELECT user_id, list_reduce(list_prepend(0::BIGINT, list(event_id ORDER BY event_id)), lambda a, e: CASE WHEN (a + e) % 2 = 0 THEN a + e ELSE a END)::BIGINT AS {0}
FROM events GROUP BY user_id
"""


@query(_STEPS.format("value"))
def fold_ordered(spark, sf):
    return O.fold_ordered(table(spark, sf, "events", "event_id", "user_id"), "user_id", "event_id", 0, lambda a, r: a + r["event_id"] if (a + r["event_id"]) % 2 == 0 else a, "user_id long, value long")


# -- exchanges ------------------------------------------------------------------------
@query("SELECT how, l_returnflag, count(*) AS n FROM lineitem CROSS JOIN (SELECT unnest(['hash', 'range', 'round_robin', 'record']) AS how) GROUP BY ALL")
def exchange_roundtrip(spark, sf):
    df = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag")
    ways = {"hash": O.hash_partition(df, "l_orderkey"), "range": O.range_partition(df, "l_orderkey"), "round_robin": O.round_robin(df, 8), "record": O.hash_partition(df)}
    out = None
    for how, dealt in ways.items():
        part = dealt.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "l_returnflag", "n")
        out = part if out is None else out.unionByName(part)
    return out


# -- datasets, state and iteration --------------------------------------------------------
@query("""
SELECT 'by_type' AS what, event_type AS name, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type
UNION ALL SELECT 'by_day', strftime(ts, '%Y-%m-%d'), count(*) FROM events WHERE value > 10 GROUP BY 2
""")
def dataset_reuse(spark, sf):
    """A stored dataset that two later queries read, one of them through a reference."""
    session = Session(spark)
    session.store("events", table(spark, sf, "events", "event_type", "ts", "value").where("value > 10"))
    session.reference("again")
    session.assign("again", "events")
    by_type = session.read("events").groupBy(F.lit("by_type").alias("what"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_day = session.read("again").groupBy(F.lit("by_day").alias("what"), F.date_format("ts", "yyyy-MM-dd").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by_type.unionByName(by_day)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def dataset_upsert(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_id", "event_type", "value")
    return O.upsert(None, events, "user_id", "event_id")


@query("""
SELECT c_custkey, CASE WHEN l IS NULL THEN 0 ELSE list_reduce(list_prepend(0::BIGINT, l), lambda a, e: CASE WHEN (a + e) % 2 = 0 THEN a + e ELSE a END) END::BIGINT AS state
FROM customer LEFT JOIN (SELECT user_id, list(event_id ORDER BY event_id) AS l FROM events GROUP BY user_id) ON user_id = c_custkey
""")
def dataset_update(spark, sf):
    """A keyed state, of which the keys that exist are updated: the sum is kept where it is even."""
    state = table(spark, sf, "customer", "c_custkey").withColumn("state", F.lit(0).cast("long"))
    changes = table(spark, sf, "events", "user_id", "event_id").withColumnRenamed("user_id", "c_custkey")
    return O.update_existing(state, changes, "c_custkey", "state", "event_id", lambda s, x: s + x if (s + x) % 2 == 0 else None, "event_id")


@query("""
WITH first AS (SELECT c_custkey AS user_id, c_acctbal AS total FROM customer WHERE c_custkey <= 100),
added AS (SELECT user_id, value AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'signup') WHERE k = 1),
held AS (SELECT * FROM first WHERE user_id NOT IN (SELECT user_id FROM added) UNION ALL SELECT * FROM added),
spent AS (SELECT user_id, sum(value) AS spent FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, round(total + coalesce(spent, 0), 4) AS total FROM held LEFT JOIN spent USING (user_id)
""")
def dataset_mutable(spark, sf):
    """A mutable dataset with prior state: records are put over it, then the keys that exist are updated."""
    session, events = Session(spark), table(spark, sf, "events", "user_id", "event_id", "event_type", "value")
    first = table(spark, sf, "customer").where("c_custkey <= 100").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.col("c_acctbal").alias("total"))
    session.mutable("totals", ["user_id"], ["event_id"], first)
    session.add("totals", events.where("event_type = 'signup'").select("user_id", "event_id", F.col("value").alias("total")))
    session.update("totals", events.where("event_type = 'purchase'"), "total", "value", lambda old, x: old + x, "event_id")
    return session.read("totals").select("user_id", F.round("total", 4).alias("total"))


@query("SELECT event_id + 100 AS event_id, event_type FROM events")
def iterate_map(spark, sf):
    return iterate(table(spark, sf, "events", "event_id", "event_type"), lambda d: d.select((F.col("event_id") + 1).alias("event_id"), "event_type"), 100, checkpoint_every=50)


@query("SELECT r_regionkey::BIGINT + 12 AS r_regionkey FROM region")
def iterate_graph_loop(spark, sf):
    """A graph with a backward edge, re-executed from its tail."""
    g = Graph("loop").add("head", lambda: table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey")))
    g.add("tail", lambda d: d.select((F.col("r_regionkey") + 3).alias("r_regionkey")), "head").connect("tail", "head", backward=True)
    return g.submit(rounds=4)["tail"]


@query("SELECT 'up' AS edge, r_regionkey::BIGINT + 9 AS n FROM region UNION ALL SELECT 'double', 8 * r_regionkey::BIGINT FROM region")
def iterate_two_loops(spark, sf):
    """A graph with two backward edges, which go round together."""
    g = Graph("loops").add("source", lambda: table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("n")))
    g.add("a", lambda d: d, "source").add("up", lambda d: d.select((F.col("n") + 3).alias("n")), "a").connect("up", "a", backward=True)
    g.add("b", lambda d: d, "source").add("double", lambda d: d.select((F.col("n") * 2).alias("n")), "b").connect("double", "b", backward=True)
    ends = g.submit(rounds=3, checkpoint_every=2)
    return O.union_all(*[ends[e].select(F.lit(e).alias("edge"), "n") for e in ("up", "double")])


_POINTS = "SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y, (p_partkey % 17)::DOUBLE AS z FROM part"


def _k_means_sql() -> str:
    near = "(SELECT p.p_partkey, p.x, p.y, p.z, arg_min(c.cluster, (((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z)), c.cluster)) AS cluster FROM points p CROSS JOIN {0} c GROUP BY ALL)"
    parts = [f"points AS ({_POINTS})", "c0 AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS cluster, x, y, z FROM points ORDER BY p_partkey LIMIT 3)"]
    for i in range(4):
        parts.append(f"m{i} AS (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {near.format(f'c{i}')} GROUP BY cluster)")
        parts.append(f"c{i + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.z, c.z) AS z FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return f"WITH {', '.join(parts)} SELECT p_partkey, cluster FROM {near.format('c4')}"


@query(_k_means_sql())
def kmeans_4(spark, sf):
    points = O.map_rows(table(spark, sf, "part"), "p_partkey", "cast(p_size AS double) AS x", "p_retailprice / 100 AS y", "cast(p_partkey % 17 AS double) AS z")
    seeds = first_rows(points, "p_partkey", 3).withColumn("cluster", F.col("cluster").cast("long"))
    assigned, _ = k_means(points, seeds, ["x", "y", "z"], updates=4, epsilon=0.0)
    return assigned.select("p_partkey", "cluster")


# -- sources and sinks --------------------------------------------------------------------
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf):
    path = fresh_path(spark, "query")
    write_csv(table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), path, quote_strings=True)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT c_custkey, c_nationkey FROM customer")
def csv_column_subset(spark, sf):
    path = fresh_path(spark, "query")
    write_csv(table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double", include=[0, 2])


@query("SELECT i AS n, 'String' || i AS name FROM range(1000) r(i) CROSS JOIN range(3)")
def udf_source(spark, sf):
    return generate(spark, lambda: ((i, f"String{i}") for i in range(1000)), "n long, name string", replicas=3)


@query("SELECT n_regionkey, n_name FROM nation")
def client_broadcast(spark, sf):
    """A client's collection, broadcast to all machines."""
    session = Session(spark)
    rows = [tuple(r) for r in table(spark, sf, "nation", "n_regionkey", "n_name").collect()]  # 25 rows by definition
    return session.broadcasted(session.broadcast(rows, "n_regionkey int, n_name string"))


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem")
def sink_foreach(spark, sf):
    """A sink that adds up what it consumes."""
    from weirflow.sources import foreach

    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def consume(row):
        n.add(1)
        total.add(row["l_linenumber"])

    foreach(table(spark, sf, "lineitem", "l_linenumber"), consume)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


# -- collections ---------------------------------------------------------------------------
@query("""
SELECT l_orderkey, len(a)::INT AS size, len(a) = 0 AS empty, list_contains(a, 3) AS has_3, coalesce(a[2], 0) AS second, (coalesce(list_position(a, 3), 0) - 1)::INT AS at,
       CASE WHEN list_contains(a, 1) THEN len(a) - list_position(list_reverse(a), 1) ELSE -1 END::INT AS last_at, list_has_all(a, [1, 2]) AS has_all, m[1] AS price_1, len(map_keys(m))::INT AS keys
FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a, map_from_entries(list(DISTINCT {'k': l_linenumber, 'v': p})) AS m
      FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) OVER (PARTITION BY l_orderkey, l_linenumber) AS p FROM lineitem) GROUP BY l_orderkey)
""")
def collection_accessors(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    maps = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "p"))).alias("m"))
    d = lists.join(maps, "l_orderkey")
    return d.select(
        "l_orderkey", C.size("a").alias("size"), C.is_empty("a").alias("empty"), C.contains("a", 3).alias("has_3"), F.coalesce(C.get("a", 1), F.lit(0)).alias("second"), C.index_of("a", 3).alias("at"),
        C.last_index_of("a", 1).alias("last_at"), C.contains_all("a", F.array(F.lit(1), F.lit(2))).alias("has_all"), C.value_of("m", 1).alias("price_1"), F.size(C.keys("m")).alias("keys"),
    )


# -- extensions: not operators of the reference ------------------------------------------------
@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_windows(spark, sf):
    from weirflow.streaming import windowed

    out = windowed(table(spark, sf, "events", "ts", "event_type", "value"), "ts", "1 day", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), keys=["event_type"])
    return out.select(F.col("window.start").alias("day"), "event_type", "n", "total")


@query("SELECT DISTINCT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(spark, sf):
    from weirflow.operators.setops import intersect

    return intersect(table(spark, sf, "customer", "c_nationkey"), table(spark, sf, "supplier", "s_nationkey"))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events WHERE event_id % 2 = 0 GROUP BY event_type")
def ext_stream_to_files(spark, sf):
    """The events as a stream: filtered into files by a streaming query, which are then folded."""
    from weirflow import streaming

    where = fresh_path(spark, "query")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf, "events").schema)
    stream = streaming.read_files(spark, f"{sf}/events.parquet*", kinds)
    streaming.write(O.filter_rows(stream, "event_id % 2 = 0").select("event_id", "event_type"), f"{where}/checkpoint", f"{where}/out").awaitTermination()
    out = spark.read.schema("event_id long, event_type string").parquet(f"{where}/out")
    return O.hash_fold(out, "event_type", F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))
