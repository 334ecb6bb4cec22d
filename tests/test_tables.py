"""Dataflow over tables, ledger, cache, sources, streams and assertions."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from weftline import sources
from weftline.functions import texts
from weftline.operators import assertions, cache, dataflow, ledger
from weftline.streaming import fold_states, liveness, monitor, reconcile

T0 = dt.datetime(2024, 1, 1)


def test_gather_keeps_nulls_order_and_empties(spark):
    parents = spark.createDataFrame([(1, [3, None, 1]), (2, []), (3, None)], "k int, xs array<int>")
    kids = dataflow.scatter(parents, "xs", keep=["k"]).withColumn("y", F.col("item") * 2)
    out = dataflow.gather_onto(parents.select("k"), kids, ["k"], "pos", ["y"]).orderBy("k").collect()
    assert [r.y for r in out] == [[6, None, 2], [], []]


def test_conditional_takes_each_row_once(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, c boolean")
    out = dataflow.conditional(rows, [(F.col("c"), lambda d: d.withColumn("a", F.lit(1))), (F.col("k") > 1, lambda d: d.withColumn("b", F.lit(2)))])
    assert sorted((r.k, r.a, r.b) for r in out.collect()) == [(1, 1, None), (2, None, 2), (3, None, 2)]
    some = dataflow.conditional(rows, [(F.col("c"), lambda d: d.withColumn("a", F.lit(1)))])
    assert sorted((r.k, r.a) for r in some.collect()) == [(1, 1), (2, None), (3, None)]


def test_call_and_matrix(spark):
    out = dataflow.call(spark.range(2), lambda d: d.withColumn("y", F.col("x") + 1), {"x": F.col("id")}, "c").orderBy("id").collect()
    assert [(r.id, r.c.y) for r in out] == [(0, 1), (1, 2)]
    grid = dataflow.input_matrix(spark, [{"a": [1, 2], "b": ["x", "y"]}, {"c": [5, 6, 7]}])
    assert grid.count() == 6 and {(r.a, r.b) for r in grid.collect()} == {(1, "x"), (2, "y")}
    with pytest.raises(ValueError):
        dataflow.input_matrix(spark, [{"a": [1], "b": []}])


def test_ledger(spark):
    sessions = spark.createDataFrame([(1, "s1", "run", "me", T0, None), (2, "s2", "server", "me", T0, T0 + dt.timedelta(hours=2))], ledger.SCHEMAS["sessions"])
    run = lambda i, s, status: (i, f"r{i}", s, "n", "src", None, status, "{}", None, None, None, None, None, None, T0 + dt.timedelta(minutes=i))
    runs = spark.createDataFrame([run(1, 1, "running"), run(2, 2, "running"), run(3, 1, "completed")], ledger.SCHEMAS["runs"])
    cutoff = F.lit(T0 + dt.timedelta(hours=1))
    assert [r.id for r in ledger.orphaned(runs, sessions, cutoff).collect()] == [1]
    assert {r.id: r.status for r in ledger.sweep(runs, sessions, cutoff).collect()} == {1: "orphaned", 2: "running", 3: "completed"}
    assert ledger.with_session(runs, sessions, "r2").first().session_uuid == "s2"
    assert [r.id for r in ledger.page(runs, [F.desc("created_at")], 1, 1).collect()] == [2]
    assert ledger.next_token(3, 2, 0) == 2 and ledger.next_token(2, 2, 0) is None
    assert ledger.pivoted_counts(runs, ledger.RUN_STATES).first().asDict()["running"] == 2
    changed = ledger.upsert(runs, runs.where("id = 1").withColumn("status", F.lit("failed")), "uuid", ["created_at"])
    assert {r.id: r.status for r in changed.collect()} == {1: "failed", 2: "running", 3: "completed"}
    assert {r.id: r.status for r in ledger.transition(runs, "canceling", ("queued", "running")).collect()} == {1: "canceling", 2: "canceling", 3: "completed"}
    index = spark.createDataFrame([(1, 1, "a", "x", T0), (2, 2, "a", "y", T0), (3, 1, "b", "z", T0)], ledger.SCHEMAS["index_log"])
    want = [("a", "y"), ("b", "z")]
    assert sorted((r.link_path, r.target_path) for r in ledger.latest_by(index, ["link_path"], ["created_at", "id"]).collect()) == want
    assert sorted((r.link_path, r.target_path) for r in ledger.latest(index, ["link_path"], [F.desc("created_at"), F.desc("id")]).collect()) == want
    new = spark.createDataFrame([("s2", "r9"), ("none", "r8")], "uuid string, name string")
    assert [(r.name, r.session_id) for r in ledger.inserted(new, sessions, "session_id", "uuid").collect()] == [("r9", 2)]
    logs = spark.createDataFrame([(i, "t", "stdout" if i % 2 else "stderr", b"x", T0) for i in range(4)], ledger.SCHEMAS["task_logs"])
    assert [r.id for r in ledger.logs(logs, "t", "stdout").collect()] == [1, 3]


def test_cache(spark, tmp_path):
    calls = spark.createDataFrame([("a", 1), ("b", None), ("a", 1)], "t string, x int").withColumn("key", cache.cache_key(F.lit("u"), F.col("t"), F.col("x")))
    assert calls.select("key").distinct().count() == 2
    entries = cache.put(spark.createDataFrame([], "key string, out int"), calls.where("t = 'a'").select("key", F.lit(7).alias("out")).distinct())
    assert [r.out for r in cache.hits(calls, entries).collect()] == [7, 7] and [r.t for r in cache.misses(calls, entries).collect()] == ["b"]
    (tmp_path / "f").write_bytes(b"abc")
    (tmp_path / "g").write_bytes(b"abd")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    for strength in ("strong", "strongish", "weak"):
        assert cache.content_digest(files, strength).select("digest").count() == 2
    assert cache.content_digest(files, "strong").select("digest").distinct().count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.txt").write_text("x\ty\n1\t\n\"2\tq\n")
    (tmp_path / "d" / "e" / "b.txt").write_text("line\r\nlast")
    (tmp_path / "d" / "c.bin").write_bytes(b"12345")
    root = str(tmp_path / "d")
    assert [r.path.rsplit("/", 1)[1] for r in sources.globbed(spark, root, "*.txt").collect()] == ["a.txt", "b.txt"]
    assert sources.size_of(spark, root, "B").first().size == float(5 + 12 + 10)
    assert [tuple(r) for r in sources.read_object_table(spark, f"{root}/a.txt").collect()] == [("1", ""), ('"2', "q")]
    assert [r.line for r in sources.read_line_table(spark, f"{root}/e/b.txt").orderBy("at").collect()] == ["line", "last"]
    content = sources.read_contents(spark, f"{root}/a.txt").select(texts.parse_objects(F.col("content")).alias("o")).first().o
    assert content == [{"x": "1", "y": ""}, {"x": '"2', "y": "q"}]
    sources.write_tsv_table(spark.createDataFrame([(1, None), (2, "b")], "k int, v string"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in sources.read_tsv_table(spark, str(tmp_path / "out"), ["k", "v"]).collect()) == [("1", ""), ("2", "b")]
    with pytest.raises(Exception, match="a cell holds"):
        sources.write_tsv_table(spark.createDataFrame([("a\tb",)], "v string"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="hasn't 3 cells"):
        sources.read_tsv_table(spark, f"{root}/a.txt", ["a", "b", "c"]).collect()
    sources.write_contents(spark.createDataFrame([("p\nq\n",)], "content string"), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["p", "q"]


EVENTS = [("a", "running", 3, 1), ("a", "completed", 5, 2), ("a", "failed", 6, 3), ("b", "running", 2, 4), ("b", "pending", 3, 5), (None, "failed", 1, 6)]


def test_stream_folds_as_the_table_does(spark, tmp_path):
    rows = [(t, s, T0 + dt.timedelta(minutes=m), i) for t, s, m, i in EVENTS]
    events = spark.createDataFrame(rows, "task string, state string, ts timestamp, event_id long")
    want = {"a": "completed", "b": "running"}
    assert {r.task: r.status for r in fold_states(events).collect()} == want
    assert {r.task: r.status for r in reconcile(fold_states(events)).collect()} == {"a": "completed", "b": "canceled"}
    for i, r in enumerate(rows[::-1]):  # the latest first, a file each
        spark.createDataFrame([r], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"m{uuid.uuid4().hex}"
    monitor(stream, name, str(tmp_path / "cp")).awaitTermination()
    assert {r.task: r.status for r in spark.table(name).collect()} == want
    seen = []
    monitor(stream, "n", str(tmp_path / "cp2"), foreach_batch=lambda d, _: seen.extend(d.collect())).awaitTermination()
    assert {r.task: r.status for r in seen} == want


def test_liveness(spark):
    beats = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(minutes=4)), (1, T0 + dt.timedelta(minutes=30))], "session_id int, ts timestamp")
    assert sorted(r.beats for r in liveness(beats).collect()) == [1, 2]


def test_assertions(spark):
    rows = spark.createDataFrame([([1, 2], "abc", None)], "xs array<int>, s string, n int")
    good = {"xs": [("First", ("Equals", 1)), ("Last", ("Equals", 2)), ("Length", 2), ("Contains", 2), ("Empty", False)], "s": [("Contains", "b"), ("Length", 3), ("Name", "abc")], "n": [("Defined", False)]}
    assert assertions.checked(rows, good, text=("s",)).first().passed
    got = assertions.checked(rows, {"xs": [("Equals", [1]), ("First", ("Equals", 2))], "n": [("Defined", True), ("Equals", 1)]}).first()
    assert not got.passed and got.failed == ["xs: Equals", "xs: First", "n: Defined", "n: Equals"]


def test_cancellation(spark):
    import threading
    import time

    from weftline.operators.cancellation import Canceled, Cancellation

    whole = Cancellation(spark)
    part = whole.child()
    assert part.run(lambda: spark.range(3), lambda d: d.count()) == 3
    caught = []

    def work():
        nap = F.udf(lambda i: time.sleep(60) or i, "long")
        try:
            part.run(lambda: spark.range(0, 4, 1, 4).select(nap("id").alias("x")), lambda d: d.collect())
        except Canceled as e:
            caught.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(4)
    assert whole.cancel() == "waiting" and part.state == "waiting" and thread.is_alive()
    with pytest.raises(Canceled):
        part.run(lambda: spark.range(3), lambda d: d.count())
    assert whole.cancel() == "canceling"
    thread.join(50)
    assert caught and not thread.is_alive()
    alone = Cancellation(spark, fast=True)
    assert alone.child().cancel() == "canceling" and alone.state == "running"
