"""Semantics of operators on small frames: what the survey's ledger keeps or mends."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from weirflow import functions as C
from weirflow import operators as O
from weirflow.functions.lifecycle import Function, environment
from weirflow.operators.aggregate import Monoid
from weirflow.schema import flattened, inferred, positional


def pairs(spark, data, schema="k int, v string"):
    return spark.createDataFrame(data, schema)


def test_join_pairs_all_or_last(spark):
    build = pairs(spark, [(1, "a"), (1, "b"), (2, "c")])
    probe = pairs(spark, [(1, "x"), (1, "y"), (3, "z")])
    assert len(rows(O.hash_join(build, probe, "k", "k"))) == 4
    last = O.hash_join(build, probe, "k", "k", duplicates="last", order="v")
    assert rows(flattened(last)) == [(1, "b", 1, "x"), (1, "b", 1, "y")]
    with pytest.raises(ValueError):
        O.hash_join(build, probe, "k", "k", duplicates="last")
    with pytest.raises(ValueError):
        O.hash_join(build, probe, ["k", "v"], "k")


def test_join_nulls_and_nested_paths(spark):
    a, b = pairs(spark, [(None, "a"), (1, "b")]), pairs(spark, [(None, "x"), (1, "y")])
    assert len(rows(O.hash_join(a, b, "k", "k"))) == 1
    assert len(rows(O.hash_join(a, b, "k", "k", null_equal=True))) == 2
    nested = O.hash_join(O.hash_join(a, b, "k", "k"), b, "_1.k", "k")
    assert nested.select("_1._2.v").collect()[0][0] == "y"


def test_difference_keeps_repeats_and_matches_nulls(spark):
    a = pairs(spark, [(1, "a"), (1, "a"), (2, None), (3, "c")])
    b = pairs(spark, [(2, None), (3, "d"), (3, "d")])
    assert rows(O.difference(a, b)) == [(1, "a"), (1, "a"), (3, "c")]


def test_difference_of_25(spark):
    a = spark.range(120).select(F.lit("Bam").alias("_1"), F.col("id").alias("_2"))
    b = spark.range(95).select(F.lit("Bam").alias("_1"), F.col("id").alias("_2"))
    assert [r[1] for r in rows(O.difference(a, b).orderBy("_2"))].__len__() == 25


def test_distinct_and_union(spark):
    one, two = pairs(spark, [(1, "SOURCE1")] * 1000), pairs(spark, [(2, "SOURCE2")] * 1000)
    both = O.union_all(one, two)
    assert both.count() == 2000
    assert rows(O.distinct(both)) == [(1, "SOURCE1"), (2, "SOURCE2")]
    with pytest.raises(ValueError):
        O.union_all(one, one.select("k"))


def test_folds(spark):
    df = spark.range(100)
    assert rows(O.fold(df, F.count(F.lit(1)).alias("n"))) == [(100,)]
    assert rows(O.fold(df.where("id < 0"), F.count(F.lit(1)).alias("n"))) == []
    assert rows(O.hash_fold(df.where("id < 0"), F.col("id") % 2, F.count(F.lit(1)).alias("n"))) == []
    assert rows(O.hash_fold(df, (F.col("id") % 5).alias("k"), F.sum("id").alias("s"), emit_keys=False)) == [(1010,), (1030,), (950,), (970,), (990,)]


def test_monoid_in_two_phases(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") % 3).alias("k"), "id")
    fold = Monoid(lambda: 0, lambda r: r["id"], lambda a, b: a + b)
    assert rows(O.monoid(df, "k", fold, "k long, s long")) == [(0, 166833), (1, 166167), (2, 166500)]


def test_runs(spark):
    df = pairs(spark, list(enumerate("aabbac")))
    out = rows(O.group_runs(df, "k", "v", F.count(F.lit(1)).alias("n")).select("run", "v", "n"))
    assert out == [(1, "a", 2), (2, "b", 2), (3, "a", 1), (4, "c", 1)]
    nulls = pairs(spark, [(1, None), (2, None), (3, "a"), (4, None)])
    assert [r[2] for r in rows(O.group_runs(nulls, "k", "v", F.count(F.lit(1)).alias("n")).select("run", "v", "n"))] == [2, 1, 1]
    assert rows(O.group_runs(df.where("k < 0"), "k", "v", F.count(F.lit(1)).alias("n"))) == []


def test_runs_of_many_partitions_with_any_aggregates(spark):
    """Aggregates of other columns must not change where partitions begin: sf0.1, 80,036 runs."""
    import duckdb

    path = "/root/testdata/sf0.1/events.parquet"
    events = spark.read.parquet(path).repartition(13)
    out = O.group_runs(events, "event_id", "event_type", F.count(F.lit(1)).alias("n"), F.min("value").alias("v"), F.min("props").alias("p"))
    got = out.agg(F.count(F.lit(1)), F.sum("n"), F.max("run"), F.sum(F.hash("v", "p") * 0 + F.length("p")), F.sum("v")).first()
    want = duckdb.sql(f"""SELECT count(*), sum(n), count(*), sum(length(p)), sum(v) FROM (SELECT run, count(*) AS n, min(value) AS v, min(props) AS p FROM (
        SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM '{path}')) GROUP BY run)""").fetchall()[0]
    assert got[:4] == want[:4] and abs(got[4] - want[4]) < 1e-6 * want[4]


def test_runs_with_ties_in_the_order(spark):
    df = pairs(spark, [(i // 50, "a" if i // 100 % 2 else "b") for i in range(1000)]).repartition(5)
    out = O.group_runs(df, "k", "v", F.count(F.lit(1)).alias("n"), F.max("k").alias("m"))
    assert sorted((r.run, r.n) for r in out.collect()) == [(i + 1, 100) for i in range(10)]


def test_folds_and_updates_of_a_hot_key(spark):
    df = spark.range(60_000).repartition(7).select(F.lit("hot").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("x"))
    df = df.unionByName(spark.createDataFrame([("cold", 1, 5), (None, 1, 6)], "k string, o long, x long"))
    want = 0
    for i in range(60_000):
        want = (want * 3 + i % 7) % 1009
    out = O.fold_ordered(df, "k", "o", 0, lambda a, r: (a * 3 + r["x"]) % 1009, "k string, v long")
    assert rows(out) == sorted([("hot", want), ("cold", 5), (None, 6)], key=repr)
    state = spark.createDataFrame([("hot", 0, "kept"), ("none", 1, "kept"), (None, 2, "kept")], "k string, s long, other string")
    got = O.update_existing(state, df, "k", "s", "x", lambda s, x: (s * 3 + x) % 1009, "o")
    assert rows(got) == sorted([("hot", want, "kept"), ("none", 1, "kept"), (None, 2, "kept")], key=repr)


def test_broadcast_variables(spark):
    two = pairs(spark, [(1, "A"), (2, "B")])
    df = spark.range(2)
    assert rows(O.map_with_broadcast(df, two.limit(1), "id", "v")) == [(0, "A"), (1, "A")]
    assert rows(O.map_with_broadcast(df, two.where("k > 5"), "id", "v")) == [(0, None), (1, None)]
    with pytest.raises(Exception, match="(?i)more than one row"):
        O.map_with_broadcast(df, two, "id", "v").collect()
    assert rows(O.map_with_broadcast(df, two, "id", "size(both) AS n", collection="both")) == [(0, 2), (1, 2)]
    with pytest.raises(Exception, match="more than 1 rows"):
        O.map_with_broadcast(df, two, "id", "both", collection="both", most_rows=1).collect()


class Counted(Function):
    """Says what its task has seen."""

    def __init__(self, log):
        self.log = log

    def create(self, environment):
        self.seen, self.names = 0, sorted(r["v"] for r in environment.collection("names"))
        self.log.add(1)

    def __call__(self, row):
        self.seen += 1
        if row["id"] < 0:
            raise ValueError("below 0")
        return (row["id"], "".join(self.names))

    def release(self):
        self.log.add(1000)


def test_life_of_functions(spark):
    log = spark.sparkContext.accumulator(0)
    given = environment(spark, {"p": 1}, names=pairs(spark, [(1, "A"), (2, "B"), (3, "C"), (4, "D")]))
    out = O.map_rows(spark.range(100).repartition(3), function=Counted(log), schema="id long, word string", environment=given)
    assert {r.word for r in out.collect()} == {"ABCD"}
    assert log.value % 1000 == log.value // 1000 >= 3
    with pytest.raises(Exception, match="below 0"):
        O.map_rows(spark.range(-1, 0), function=Counted(log), schema="id long, word string", environment=given).collect()
    with pytest.raises(ValueError):
        environment(spark, most_rows=2, many=spark.range(3))
    with pytest.raises(KeyError):
        given.collection("other")


def test_whole_partitions(spark):
    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], names=["n"])

    assert sum(r.n for r in O.map_partitions(spark.range(100).repartition(4), sizes, "n long").collect()) == 100


def test_positions(spark):
    out = O.with_positions(O.sort(spark.range(1000).repartition(6), "id", ascending=False))
    assert {(r.id, r.position) for r in out.collect()} == {(i, 999 - i) for i in range(1000)}
    assert O.with_positions(spark.range(0)).collect() == []


def test_map_group_streams_groups(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    out = O.map_group(df, "k", lambda g: [(r["k"], r["id"]) for i, r in enumerate(g) if i == 0], "k long, first long", order="id")
    assert rows(out) == [(i, i) for i in range(7)]
    # What a function leaves of its group is skipped.
    left = O.map_group(df, "k", lambda g: [(next(iter(g))["id"],)], "first long", order="id")
    assert rows(left) == [(i,) for i in range(7)]


def test_min_record_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, 9, "z"), (2, 3, "q")], "k int, x int, v string")
    assert rows(O.min_record_by(df, "k", "x", "v")) == [(1, 5, "a"), (2, 3, "q")]


def test_ordered_update(spark):
    state = spark.createDataFrame([(f"id={i}", i) for i in range(100)], "k string, s int")
    changes = spark.createDataFrame([(f"id={i}", i, 0) for i in range(120)], "k string, x int, o int")
    out = O.update_existing(state, changes, "k", "s", "x", lambda s, x: s + x if (s + x) % 2 == 0 else None, "o")
    assert sorted(r.s for r in out.collect()) == [2 * i for i in range(100)]
    odd = O.update_existing(state.limit(1), spark.createDataFrame([("id=0", 3, 0)], "k string, x int, o int"), "k", "s", "x", lambda s, x: s + x if (s + x) % 2 == 0 else None, "o")
    assert rows(odd) == [("id=0", 0)]


def test_upsert(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    first = O.upsert(None, df, "k", "o")
    assert rows(first) == [(1, 2, "b"), (2, 1, "c")]
    assert rows(O.upsert(first, spark.createDataFrame([(2, 0, "d")], df.schema), "k", "o")) == [(1, 2, "b"), (2, 0, "d")]


def test_exchanges_keep_rows(spark):
    df = spark.range(100)
    for dealt in (O.hash_partition(df, "id", 3), O.hash_partition(df), O.round_robin(df, 5), O.range_partition(df, "id", 4), O.broadcast_if_small(df), O.broadcast_if_small(df, 10)):
        assert dealt.count() == 100


def test_sort_of_structs(spark):
    df = spark.createDataFrame([((2, "a"),), ((1, "b"),), ((1, "a"),)], "s struct<x:int,y:string>")
    assert [tuple(r.s) for r in O.sort(df, "s").collect()] == [(1, "a"), (1, "b"), (2, "a")]
    assert [r.id for r in O.top_k(spark.range(50), "id", 3, ascending=False).collect()] == [49, 48, 47]


def test_maps_by_python(spark):
    df = pairs(spark, [(1, "a"), (2, None)])
    assert rows(O.map_rows(df, function=lambda r: (r["k"] * 2,), schema="n long")) == [(2,), (4,)]
    assert rows(O.filter_rows(df, function=lambda r: r["v"] is None)) == [(2, None)]
    assert rows(O.flat_map(df.where("k > 5"), function=lambda r: [(1,)], schema="n int")) == []
    with pytest.raises(ValueError):
        O.flat_map(df)


def test_collections(spark):
    df = spark.createDataFrame([([1, 2, 3, 2], {"a": 1}), ([], {}), (None, None)], "a array<int>, m map<string,int>")
    out = df.select(C.size("a"), C.is_empty("a"), C.index_of("a", 2), C.last_index_of("a", 2), C.get("a", 9), C.contains_key("m", "a"), C.value_of("m", "b"), C.contains_value("m", 1), F.size(C.as_set("a"))).collect()
    assert tuple(out[0]) == (4, False, 1, 3, None, True, None, True, 3)
    assert tuple(out[1])[:4] == (0, True, -1, -1)
    assert out[2][0] is None


def test_schema_helpers(spark):
    assert positional(spark.range(1).withColumn("x", F.lit(1))).columns == ["_1", "_2"]
    assert inferred((1, "a", 2.0)).simpleString() == "struct<_1:bigint,_2:string,_3:double>"
    assert inferred({"a": [1]}).simpleString() == "map<string,array<bigint>>"
    with pytest.raises(TypeError):
        inferred(object())


small = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", None])), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=small, b=small)
def test_difference_property(spark, a, b):
    x, y = pairs(spark, a), pairs(spark, b)
    assert rows(O.difference(x, y)) == sorted((r for r in a if r not in b), key=repr)
    assert O.union_all(x, y).count() == len(a) + len(b)
    assert rows(O.distinct(x)) == sorted(set(a), key=repr)
