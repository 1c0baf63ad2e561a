"""Change logs as tables and streams, and reference graphs."""

from datetime import datetime, timedelta

from recordloom.operators import graph
from recordloom.streaming import changes

T0 = datetime(2024, 1, 1)
SCHEMA = "resource string, field string, old string, new string, source string, batch_id long, ts timestamp"
ROWS = [
    ("A", "price", "1", "2", "ui", 1, T0),
    ("A", "price", "2", "2", "ui", 2, T0 + timedelta(minutes=1)),
    ("A", "price", "2", "5", "ui", 3, T0 + timedelta(minutes=2)),
    ("B", "name", None, "x", "ui", 3, T0 + timedelta(minutes=3)),
]


def test_log(spark):
    log = spark.createDataFrame(ROWS, SCHEMA)
    assert changes.effective(log).count() == 3
    assert {(r.resource, r.value) for r in changes.latest(log).collect()} == {("A", "5"), ("B", "x")}
    undone = changes.undone(log, spark.createDataFrame([(3,)], "batch_id long"))
    assert {(r.resource, r.value) for r in undone.collect()} == {("A", "2"), ("B", None)}
    assert [r.version for r in changes.history(log).where("resource = 'A'").orderBy("ts").collect()] == [1, 2, 3]


def test_stream_keeps_the_latest_state(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame(ROWS[2 * k : 2 * k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = changes.upserted(changes.once(stream, "1 hour"), out, str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        assert q.exception() is None
    last = max(int(p.name) for p in (tmp_path / "out").iterdir() if p.name.isdigit())
    assert {(r.resource, r.value) for r in spark.read.parquet(f"{out}/{last}").collect()} == {("A", "5"), ("B", "x")}


def test_windows_count_changes(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = changes.activity(stream, "2 minutes", "0 seconds").writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.resource, r.n) for r in spark.sql("SELECT * FROM activity").collect()} == {("A", 2), ("A", 1), ("B", 1)}


def test_graph(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d")], "src string, dst string")
    found = {(r.src, r.dst): r.depth for r in graph.closure(links).collect()}
    assert found["a", "d"] == 3 and found["a", "a"] == 3 and ("x", "a") not in found
    stop = spark.createDataFrame([("c",)], "node string")
    assert ("a", "d") not in {(r.src, r.dst) for r in graph.closure(links, stop).collect()}
    assert {r.dst: r.n for r in graph.shared(links).collect()} == {"d": 2}
    rows = spark.createDataFrame([("r", "i1", ["i2", "", None])], "name string, icon string, more array<string>")
    assert {(r.field, r.dst) for r in graph.edges(rows, "name", ["icon", "more"]).collect()} == {("icon", "i1"), ("more", "i2")}


def test_closure_follows_long_chains(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)] + [("n100", "n99"), (None, "n99"), ("n0", "n3")], "src string, dst string")
    found = {(r.src, r.dst): r.depth for r in graph.closure(links).collect()}
    assert found["n0", "n100"] == 98 and found["n1", "n100"] == 99 and found["n99", "n99"] == 2 and found[None, "n100"] == 2
    assert len(found) == 100 * 101 // 2 + 3 + 2
    stop = spark.createDataFrame([("n90",)], "node string")
    far = {(r.src, r.dst): r.depth for r in graph.closure(links, stop).collect()}
    assert far["n0", "n90"] == 88 and ("n0", "n91") not in far and ("n90", "n91") in far
