"""Each stream equals its batch twin, also when input arrives in several batches or twice."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trialstats.operators.rates import f2p_by_run
from trialstats.schema import TRIAL_SCHEMA
from trialstats.sources.paths import matching
from trialstats.streaming import feeds

HEADER = "task_id,sample_index,initial_state,final_state\n"


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + "\n".join(lines) + "\n")


def test_run_rates_follow_the_shards(spark, tmp_path):
    shards, out, state = tmp_path / "in [x]", f"{tmp_path}/rates", f"{tmp_path}/state"
    put(shards, "a.csv", ["a,1,fail,pass", "a,2,fail,fail"])
    wanted = [("a", 1, "fail", "pass"), ("a", 2, "fail", "fail")]

    def run():
        folder = str(shards).replace("[", "\\[").replace("]", "\\]")
        feeds.run_rate_feed(spark, folder, out, state, max_files=1).awaitTermination()
        batch = f2p_by_run(spark.createDataFrame(wanted, TRIAL_SCHEMA))
        assert rows(feeds.current_rates(spark, out)) == rows(batch)

    run()
    put(shards, "b.csv", ["b,1,fail,fail", "b,3,fail,pass", "b,,fail,pass"])
    # Another order of columns, and one more: they go by name.
    (shards / "c.csv").write_text("final_state,cost,task_id,initial_state,sample_index\npass,1,c,pass,1\nfail,2,d,fail,1\n")
    wanted += [("b", 1, "fail", "fail"), ("b", 3, "fail", "pass"), ("c", 1, "pass", "pass"), ("d", 1, "fail", "fail")]
    run()
    run()  # nothing new arrives
    assert len(matching(spark, f"{out}/version-*")) == 2


def test_rates_are_replaced_in_one_step(spark, tmp_path, monkeypatch):
    """A batch that fails at any point leaves the version before in force; run again, it counts once."""
    shards, out, state = tmp_path / "in", f"{tmp_path}/rates", f"{tmp_path}/state"
    put(shards, "a.csv", ["a,1,fail,pass"])
    feeds.run_rate_feed(spark, str(shards), out, state).awaitTermination()
    first = rows(feeds.current_rates(spark, out))
    put(shards, "b.csv", ["b,1,fail,fail", "b,2,fail,fail"])
    whole = feeds.replace_text

    def fails_before(*args):
        raise OSError("the executor was lost")

    def fails_after(*args):
        whole(*args)
        raise OSError("the driver was lost")

    for failure, seen in ((fails_before, first), (fails_after, None)):
        monkeypatch.setattr(feeds, "replace_text", failure)
        with pytest.raises(StreamingQueryException):
            feeds.run_rate_feed(spark, str(shards), out, state).awaitTermination()
        if seen is not None:
            assert rows(feeds.current_rates(spark, out)) == seen
    monkeypatch.setattr(feeds, "replace_text", whole)
    feeds.run_rate_feed(spark, str(shards), out, state).awaitTermination()
    assert rows(feeds.current_rates(spark, out)) == [(1, 2, 1, 50.0), (2, 1, 0, 0.0)]
    # A stream that lost its progress would count everything again: it is refused.
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        feeds.run_rate_feed(spark, str(shards), out, f"{tmp_path}/other").awaitTermination()


def test_shard_stream_refuses_another_header(spark, tmp_path):
    shards = tmp_path / "in"
    shards.mkdir()
    (shards / "a.csv").write_text("task_id,sample_index,final_state,initial_state\na,1,pass,fail\n")
    query = feeds.shard_stream(spark, str(shards)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state")
    with pytest.raises(StreamingQueryException):
        query.trigger(availableNow=True).start().awaitTermination()


RESULT = "task_id string, sample_index int, ts timestamp, state string, cost double"


def result_batches(spark, folder, batches):
    """One file per batch, in this order of arrival."""
    for i, batch in enumerate(batches):
        made = spark.createDataFrame([(t, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), s, c) for t, i, h, s, c in batch], RESULT)
        made.coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not os.path.exists(f"{folder}/.{name}.seen"):
                os.utime(f"{folder}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
                open(f"{folder}/.{name}.seen", "w").close()


def feed(spark, folder, out, state, **more):
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(folder)
    query = feeds.result_feed(stream, out, state, **more)
    query.awaitTermination()
    return query


BATCH_ROWS = [
    [("a", 1, 0, "pass", 1.0), ("a", 1, 5, "fail", 2.0), ("b", 1, 1, "fail", None), ("c", 2, 3, "pass", float("nan"))],
    [("a", 1, 2, "fail", 1.0), ("b", 1, 0, "pass", 3.0), ("d", 1, 30, "fail", 1.0)],
    [("c", 2, 3, "fail", 1.0), ("e", 1, 300, "pass", 1.0), ("e", 1, 300, "pass", 1.0)],
    [("a", 1, -1, "INVALID", 9.0), ("d", 1, 31, "pass", 1.0), ("f", 1, 301, "fail", 1.0)],
    [("b", 1, 0, "fail", 3.0), ("a", 1, 1, "pass", 0.0), ("g", 1, 900, "pass", 1.0)],
]


def test_results_do_not_depend_on_the_order_of_batches(spark, tmp_path):
    """Five micro-batches in three orders: the same table, whatever came late, and states that are dropped."""
    tables = []
    for k, order in enumerate(([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 4, 0, 3, 1])):
        folder, out = f"{tmp_path}/in{k}", f"{tmp_path}/out{k}"
        result_batches(spark, folder, [BATCH_ROWS[i] for i in order])
        query = feed(spark, folder, out, f"{tmp_path}/state{k}", keep="10 hours")
        assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 5
        tables.append([(r.task_id, r.sample_index, r.ts.day, r.ts.hour, r.state, r.cost) for r in feeds.result_table(spark, out).orderBy("task_id").collect()])
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
        if k == 0:
            # Seven keys were seen; those of the first days have left the state.
            assert held[-1] <= 2
    assert tables[0] == tables[1] == tables[2]
    assert [t[0] for t in tables[0]] == ["a", "b", "c", "d", "e", "f", "g"]
    assert tables[0][0][4:] == ("INVALID", 9.0) and tables[0][1][4:] == ("fail", 3.0)


def test_results_are_written_once(spark, tmp_path):
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/results", f"{tmp_path}/state"
    result_batches(spark, folder, [[("a", 1, 0, "pass", 1.0)] * 3 + [("b", 1, 0, "fail", 1.0)]])
    feed(spark, folder, out, state)
    assert spark.read.parquet(out).count() == 2
    result_batches(spark, folder, [[("a", 1, 0, "pass", 1.0), ("a", 1, 4, "fail", 1.0), ("c", 1, 0, "fail", 1.0)]])
    feed(spark, folder, out, state)
    # The state holds what was chosen before: only what is new is written, and no folder is read.
    assert sorted((r.task_id, r.version) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    # A stream that lost its progress sends everything again to another folder: the table is the same.
    feed(spark, folder, f"{out}2", f"{state}2")
    assert rows(feeds.result_table(spark, out)) == rows(feeds.result_table(spark, f"{out}2"))


def test_rows_are_combined_before_the_shuffle():
    """A hot key leaves each batch as one row, with the latest of its times."""
    batch = pa.RecordBatch.from_pydict({"k": ["x"] * 5 + [None], "v": [3, None, 2, None, 5, 1], feeds._MILLIS: [1, 2, 9, 4, 5, 6]})
    (out,) = feeds._least_of_batch(["k"], ["v"])(iter([batch]))
    assert out.to_pylist() == [{"k": "x", "v": None, feeds._MILLIS: 9}, {"k": None, "v": 1, feeds._MILLIS: 6}]


def test_keys_of_a_bucket_share_a_state(spark, tmp_path):
    """Many keys are held in few states, and repeats of any of them are found there."""
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    keys = [(f"t{i}", 1, i % 20, "pass", 1.0) for i in range(500)]
    result_batches(spark, folder, [keys, [*keys, ("t7", 1, 0, "fail", 1.0), ("new", 1, 0, "fail", None)]])
    query = feed(spark, folder, out, state, buckets=3)
    # The states of three buckets: one part of each batch that changed it.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 6
    found = spark.read.parquet(out)
    assert found.count() == 502 and found.filter("version = 2").select("task_id", "state").collect() == [("t7", "fail")]
    assert feeds.result_table(spark, out).count() == 501


def test_state_stores_follow_the_cores(spark, tmp_path):
    """Shuffle partitions made for batches are not as many state stores, each of which every micro-batch writes out."""
    folder, name = f"{tmp_path}/in", "spark.sql.shuffle.partitions"
    result_batches(spark, folder, [[(f"t{i}", 1, 0, "pass", 1.0) for i in range(50)], [("t7", 1, -1, "fail", 1.0)]])
    had, found = spark.conf.get(name), []
    try:
        spark.conf.set(name, "60")
        for k, more in enumerate(({}, {"stores": 3})):
            query = feed(spark, folder, f"{tmp_path}/out{k}", f"{tmp_path}/state{k}", **more)
            assert spark.conf.get(name) == "60"
            stores = {p["stateOperators"][0]["numShufflePartitions"] for p in query.recentProgress}
            table = feeds.result_table(spark, f"{tmp_path}/out{k}")
            found.append((stores, table.count(), table.filter("state = 'fail'").select("task_id").collect()))
    finally:
        spark.conf.set(name, had)
    assert found == [({2 * spark.sparkContext.defaultParallelism}, 50, [("t7",)]), ({3}, 50, [("t7",)])]


class Parts:
    """A list state and the timer of one bucket."""

    def __init__(self):
        self.parts, self.timer, self.most = [], None, 0

    def get(self):
        return iter(self.parts)

    def appendValue(self, part):  # noqa: N802
        self.parts = [*self.parts, part]
        self.most = max(self.most, len(self.parts))

    def put(self, parts):
        self.parts = list(parts)

    def clear(self):
        self.parts = []

    def registerTimer(self, at):  # noqa: N802
        assert self.timer is None
        self.timer = at


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def test_a_bucket_over_many_batches():
    """The least row of each key by the order of Spark, new versions alone, few parts, and nothing held that is over."""
    random, state = np.random.default_rng(5), Parts()
    choice = feeds._Choice(["k"], ["v", "x", "l"])
    choice.handle = choice.parts = state
    least, versions, seen = {}, {}, 0
    for n in range(60):
        rows = [
            {"k": random.choice(["a", "b", "c", None, f"n{n}"]), "v": random.choice([None, 0.0, -0.0, 1.5, float("nan")]), "x": random.choice([None, "b", "a"]), "l": [None, [2], [1, 3]][random.integers(3)], feeds._MILLIS: int(n * 10 + random.integers(10))}
            for _ in range(4)
        ]
        schema = pa.schema([("k", pa.string()), ("v", pa.float64()), ("x", pa.string()), ("l", pa.list_(pa.int64())), (feeds._MILLIS, pa.int64())])
        now, before = Now(max(n * 10 - 100, 0)), dict(least)
        for r in rows:
            rank = feeds._order([r["v"], r["x"], r["l"]])
            least[r["k"]] = min(least.get(r["k"], rank), rank)
        packed = [feeds._stored(pa.Table.from_pylist(rows[:2], schema)), feeds._stored(pa.Table.from_pylist(rows[2:], schema))]
        got = [r for o in choice.handleInputRows((0,), iter([{feeds._ROWS: p} for p in packed]), now) for r in feeds._opened(o[feeds._ROWS]).to_pylist()]
        for r in got:
            versions[r["k"]] = min(versions.get(r["k"], feeds._order([r["v"], r["x"], r["l"]])), feeds._order([r["v"], r["x"], r["l"]]))
        assert versions == least and {k for k in least if least[k] != before.get(k)} <= {r["k"] for r in got}
        if state.timer is not None and state.timer <= now.at:
            state.timer = None
            assert list(choice.handleExpiredTimer((0,), now, None)) == []
            seen += 1
            assert all(m > now.at for p in state.parts for m in feeds._opened(p[0])[feeds._MILLIS].to_pylist())
    assert seen > 3 and state.most <= feeds._PARTS and len(least) > 20


def run_log(spark, times):
    return spark.createDataFrame(
        [(t, f"t{i}", 1, "INVALID" if i % 2 else "pass", "HTTP 503" if i % 4 == 1 else "") for i, t in enumerate(times)],
        "at string, task_id string, sample_index int, state string, error_msg string",
    ).select(F.to_timestamp("at").alias("ts"), "task_id", "sample_index", "state", "error_msg")


def test_health_drops_late_rows_and_keeps_open_windows_back(spark, tmp_path):
    source, out, state = f"{tmp_path}/log", f"{tmp_path}/health", f"{tmp_path}/state"
    first = run_log(spark, ["2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 01:30:00", "2024-01-01 03:00:00"])

    def run():
        stream = spark.readStream.schema(first.schema).parquet(source)
        feeds.health_feed(stream, out, state).awaitTermination()
        return rows(spark.read.parquet(out))

    first.coalesce(1).write.parquet(source)
    closed = rows(feeds.health_by_window(first).filter("window_end <= timestamp'2024-01-01 02:50:00'"))
    assert run() == closed and len(closed) == 2
    # A row for a closed window comes too late; one for the open window counts.
    late = run_log(spark, ["2024-01-01 00:20:00", "2024-01-01 03:20:00", "2024-01-01 09:00:00"])
    late.coalesce(1).write.mode("append").parquet(source)
    got = run()
    assert got[:2] == closed
    assert [(r[2], r[3]) for r in got[2:]] == [(2, 2)]


def test_recent_repeats(spark, tmp_path):
    source = f"{tmp_path}/log"
    runs = run_log(spark, ["2024-01-01 00:00:00", "2024-01-01 00:05:00"]).withColumn("task_id", F.lit("same"))
    runs.write.parquet(source)
    kept = feeds.drop_recent_repeats(spark.readStream.schema(runs.schema).parquet(source), delay="1 hour")
    query = (
        kept.writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
