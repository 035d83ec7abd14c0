"""Sessions, sources, sinks, graphs, iteration and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weirflow import streaming
from weirflow.plans import Graph, iterate, k_means
from weirflow.session import Session
from weirflow.shared import shared_dir
from weirflow.sources import foreach, generate, read_csv, register_generator, write_csv


def test_datasets(spark):
    s = Session(spark)
    s.store("a", spark.range(10), reads=2)
    assert s.read("a").count() == 10 and len(s.gather("a")) == 10
    with pytest.raises(KeyError):
        s.read("a")
    s.store("b", spark.range(3), serialized=True)
    with pytest.raises(ValueError):
        s.gather("b")
    s.reference("r")
    with pytest.raises(ValueError):
        s.read("r")
    s.assign("r", "b")
    assert s.read("r").count() == 3
    with pytest.raises(ValueError):
        s.assign("b", "r")
    s.erase("b")
    with pytest.raises(KeyError):
        s.erase("b")
    assert s.utilization()["slots"] > 0
    s.close()
    assert s.datasets() == {}


def test_mutable_dataset(spark):
    s = Session(spark)
    s.mutable("m", ["k"], ["o"], spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, o int"))
    s.add("m", spark.createDataFrame([("a", 5, 1)], "k string, v int, o int"))
    s.update("m", spark.createDataFrame([("b", 2, 0), ("zz", 1, 0)], "k string, x int, o2 int"), "v", "x", lambda a, b: a + b, "o2")
    assert rows(s.read("m").select("k", "v")) == [("a", 5), ("b", 4)]


def test_broadcast(spark):
    s = Session(spark)
    name = s.broadcast([("A", 0), ("B", 1)], "w string, n int")
    one = s.broadcasted(name).agg(F.array_join(F.array_sort(F.collect_list("w")), "").alias("all"))
    assert {r[0] for r in spark.range(3).join(F.broadcast(one)).select(F.concat(F.lit("HELLO"), "all")).collect()} == {"HELLOAB"}


def test_generators(spark):
    assert generate(spark, lambda: ((i,) for i in range(50)), "n int", replicas=3).count() == 150

    def make():
        left = iter([(1, "a"), (2, "b")])
        return lambda: next(left, None)

    register_generator(spark, "until_none", "n int, v string", make)
    assert spark.read.format("until_none").option("replicas", 2).load().count() == 4


LINES = ["3", "1,a,b", ",a", " 7,a", "+7,a", '4,"u', '1,"a""b"', '1,"a" b', "1,", "", "2,x\r", "99999999999,a", '5, "q,r" ', "-6,  z", '8,""']


def test_csv_rules(spark, tmp_path):
    path = str(tmp_path / "f.csv")
    with open(path, "w", newline="") as f:
        f.write("\n".join(LINES) + "\n")
    good = read_csv(spark, path, "n int, v string", lenient=True)
    assert rows(good) == sorted([(1, "a"), (0, "a"), (2, "x"), (5, "q,r"), (-6, "  z"), (8, "")], key=repr)
    with pytest.raises(Exception, match="malformed line"):
        read_csv(spark, path, "n int, v string").collect()


def test_csv_roundtrip_header_and_types(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a,b"), (2, -1.0, "")], "i long, d double, s string")
    write_csv(df, str(tmp_path / "out"), quote_strings=True)
    assert rows(read_csv(spark, str(tmp_path / "out"), "i long, d double, s string")) == rows(df)
    assert rows(read_csv(spark, str(tmp_path / "out"), "i long, d double, s string", include=[True, False, False])) == [(1,), (2,)]
    with pytest.raises(Exception, match="null in column"):
        write_csv(spark.createDataFrame([(None,)], "i int"), str(tmp_path / "n"))
    (tmp_path / "h.csv").write_text("i,s\n1,x\n2,y\n")
    assert rows(read_csv(spark, str(tmp_path / "h.csv"), "i int, s string", header=True)) == [(1, "x"), (2, "y")]
    (tmp_path / "e.csv").write_text("1,\n")
    with pytest.raises(Exception, match="malformed"):
        read_csv(spark, str(tmp_path / "e.csv"), "i int, d double").collect()


def test_foreach_passes_through(spark):
    assert foreach(spark.range(3), lambda r: None).count() == 3


def test_iteration(spark):
    df = spark.range(100).select("id", F.concat(F.lit("String"), "id").alias("s"))
    out = iterate(df, lambda d: d.select((F.col("id") + 1).alias("id"), "s"), 100, checkpoint_every=25)
    assert sorted(r.id for r in out.collect()) == list(range(100, 200))
    seen = []
    iterate(spark.range(4), lambda d: d.select((F.col("id") + 1).alias("id")), 50, until=lambda a, b, n: seen.append(n) or n == 3)
    assert seen == [1, 2, 3]


def test_graph_rules(spark):
    g = Graph().add("a", lambda: spark.range(5)).add("b", lambda x: x.where("id > 1"), "a").add("c", lambda x: x.where("id > 2"), "a")
    assert {k: v.count() for k, v in g.submit().items()} == {"b": 3, "c": 2}
    with pytest.raises(NotImplementedError):
        Graph().add("x", "loop_control")
    with pytest.raises(ValueError):
        Graph().add("a", lambda x: x, "b").add("b", lambda x: x, "a").order()
    with pytest.raises(ValueError):
        Graph().add("a", lambda: 1).add("b", lambda: 1).connect("a", "b", backward=True).order()


def test_two_loops(spark):
    def graph():
        g = Graph().add("s", lambda: spark.range(3)).add("a", lambda d: d, "s").add("x", lambda d: d.select((F.col("id") + 1).alias("id")), "a")
        return g.add("b", lambda d: d, "s").add("y", lambda d: d.select((F.col("id") * 2).alias("id")), "b").connect("x", "a", backward=True)

    ends = graph().connect("y", "b", backward=True).submit(rounds=4, checkpoint_every=2)
    assert {k: sorted(r.id for r in v.collect()) for k, v in ends.items()} == {"x": [4, 5, 6], "y": [0, 16, 32]}
    seen = []
    graph().submit(rounds=9, until=lambda a, b, n: seen.append(n) or n == 2)
    assert seen == [1, 2]
    with pytest.raises(ValueError):
        graph().connect("y", "a", backward=True).submit(rounds=2)


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Cluster())


def test_k_means_keeps_empty_clusters(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 10.0)], "p int, x double")
    seeds = spark.createDataFrame([(0, 0.0), (1, 9.0), (2, 500.0)], "cluster int, x double")
    assigned, centroids = k_means(points, seeds, ["x"])
    assert rows(assigned.select("p", "cluster")) == [(1, 0), (2, 0), (3, 1)]
    assert rows(centroids) == [(0, 0.5), (1, 10.0), (2, 500.0)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 3), (2, "a", 4), (3, "b", 2)], "o long, k string, v long").coalesce(1).write.parquet(src)
    stream = streaming.read_files(spark, src, "o long, k string, v long")
    q = streaming.write(stream.where("v > 2").select("k", "v"), str(tmp_path / "c1"), str(tmp_path / "out"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", 3), ("a", 4)]
    loose = streaming.keyed_state(stream, "k", "v", None, lambda s, v: s + v)
    streaming.write(loose, str(tmp_path / "c3"), "loose", format="memory", mode="update").awaitTermination(90)
    assert rows(spark.table("loose")) == [("a", 7), ("b", 2)]
    state = streaming.keyed_state(stream, "k", "v", "o", lambda s, v: s + v if (s + v) % 2 else None)
    q = streaming.write(state, str(tmp_path / "c2"), "kept", format="memory", mode="update")
    q.awaitTermination(90)
    assert rows(spark.table("kept")) == [("a", 7), ("b", 0)]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:05", 1), ("2024-01-01 00:00:50", 2), ("2024-01-01 00:03:00", 4)], "t string, v int").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.s for r in streaming.windowed(df, "t", "1 minute", F.sum("v").alias("s")).orderBy("window").collect()] == [3, 4]
    assert [r.s for r in streaming.sessions(df, "t", "1 minute", F.sum("v").alias("s")).orderBy("session_window").collect()] == [3, 4]
