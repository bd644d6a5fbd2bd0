"""Run rates as shards arrive, one result per trial however often it is sent, and error rates per time window."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from trialstats.functions.states import is_invalid, rate, retryable
from trialstats.operators.rates import RUN, counts
from trialstats.operators.tables import one_per_key
from trialstats.schema import TRIAL_KEY, TRIAL_SCHEMA
from trialstats.sources.paths import base_name, delete, matching, read_text, replace_text
from trialstats.sources.readers import CSV, read_shard_files


def shard_stream(
    spark: SparkSession, folder: str, schema: T.StructType = TRIAL_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """CSV outcome shards of a folder as a stream; ``max_files`` bounds a micro-batch.

    The header of every shard must name the columns of ``schema`` in their order, else the stream fails: columns
    are never taken by position. ``run_rate_feed`` reads shards of any column order.
    """
    reader = spark.readStream.schema(schema).options(**CSV).option("enforceSchema", False)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).csv(folder)


# --- running rates --------------------------------------------------------------------------------

# Names under the folder of a rate table: the pointer to the version that readers see, and the versions.
_CURRENT, _VERSION = "current", "version"

# Files whose names one micro-batch sends to the driver.
MAX_FILES = 1000


def run_rate_feed(
    spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int = MAX_FILES, schema: T.StructType = TRIAL_SCHEMA
) -> StreamingQuery:
    """Keep the rate of every run current as CSV shards arrive in ``folder``; ``current_rates`` reads the table at ``out``.

    The stream carries the names of new files; each micro-batch reads its files by their headers, counts them per run (combined
    before the shuffle) and adds these counts to the version before. A new version is written aside and comes in force
    when one pointer file is renamed, so a reader sees the old table or the new one, whole. A micro-batch that is run
    again starts from the version before its own and changes nothing. Two versions are kept, for readers that have
    begun; older ones are deleted.
    """
    arrivals = (
        spark.readStream.format("binaryFile")  # its contents are not read: only the path is asked for
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select("path")
    )

    def publish(batch: DataFrame, batch_id: int) -> None:
        files = [row.path for row in batch.collect()]
        pointer = json.loads(read_text(spark, f"{out}/{_CURRENT}") or '{"batch": -1, "path": null, "before": null}')
        if batch_id < pointer["batch"]:
            raise ValueError(f"{out} has batch {pointer['batch']}; batch {batch_id} comes from another checkpoint")
        base = pointer["before"] if batch_id == pointer["batch"] else pointer["path"]
        counted = read_shard_files(spark, files, schema).groupBy(RUN).agg(*counts())
        if base is not None:
            counted = counted.unionByName(spark.read.schema(counted.schema).parquet(base))
        path = f"{out}/{_VERSION}-{batch_id}-{uuid.uuid4().hex}"
        totals = counted.groupBy(RUN).agg(F.sum("n_failing").alias("n_failing"), F.sum("n_rescued").alias("n_rescued"))
        totals.coalesce(1).write.parquet(path)
        replace_text(spark, f"{out}/{_CURRENT}", json.dumps({"batch": batch_id, "path": path, "before": base}))
        kept = {base_name(p) for p in (path, base) if p is not None}
        delete(spark, [p for p in matching(spark, f"{out}/{_VERSION}-*") if base_name(p) not in kept])

    return arrivals.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rates(spark: SparkSession, out: str) -> DataFrame:
    """The rates of all runs that ``run_rate_feed`` has published last, one row per run."""
    pointer = read_text(spark, f"{out}/{_CURRENT}")
    if pointer is None:
        raise FileNotFoundError(f"no rates were published at {out}")
    totals = spark.read.parquet(json.loads(pointer)["path"]).filter(F.col(RUN).isNotNull())
    return totals.select(RUN, "n_failing", "n_rescued", rate(F.col("n_rescued"), F.col("n_failing")).alias("f2p"))


# --- results --------------------------------------------------------------------------------------

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MILLIS, VERSION = "_millis", "version"
_BUCKET, _ROWS, _TIMER, _BEFORE = "_bucket", "_rows", "_timer", "_before"

# Hash buckets of keys that share a state, and the parts that the state of a bucket has at most.
BUCKETS = 4096
_PARTS = 16
# Rows that a task holds before it deals them to buckets, and the buckets it hands on at once.
_CHUNK = 1 << 18
_AT_ONCE = 512
# State stores for each core: each is written to the checkpoint at the end of every micro-batch, however little it holds.
_STORES = 2


def _order(values: Sequence) -> tuple:
    """Orders rows as Spark orders structs: null first, NaN last."""
    return tuple((v is not None, v != v, v if v == v else None) if v is not None else (False,) for v in values)


def _ranks(column: pa.ChunkedArray) -> list[pa.ChunkedArray | pa.Array]:
    """What orders the rows of a column as ``_order`` does, for a plain sort."""
    if pa.types.is_nested(column.type):
        values = [_order([v]) for v in column.to_pylist()]
        ranks, rank = [0] * len(values), 0
        by = sorted(range(len(values)), key=values.__getitem__)
        for before, i in zip(by, by[1:], strict=False):
            rank += values[before] != values[i]
            ranks[i] = rank
        return [pa.array(ranks, pa.int64())]
    if pa.types.is_null(column.type):
        return []
    more = [pc.fill_null(pc.is_nan(column), False).cast(pa.int8())] if pa.types.is_floating(column.type) else []
    return [pc.is_valid(column).cast(pa.int8()), *more, column]


def _least(rows: pa.Table, keys: Sequence[str], others: Sequence[str], most: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of the least row of each key, the first of equal ones, and the largest values of the columns ``most`` over its rows."""
    ranks = [r for c in others for r in _ranks(rows.column(c))]
    order = np.arange(len(rows))
    if ranks:
        named = pa.table({str(i): r for i, r in enumerate(ranks)})
        order = pc.sort_indices(named, sort_keys=[(c, "ascending") for c in named.column_names]).to_numpy()
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    columns = {f"k{i}": rows.column(c) for i, c in enumerate(keys)} | {f"m{i}": rows.column(c) for i, c in enumerate(most)} | {"place": place}
    grouped = pa.table(columns).group_by([f"k{i}" for i in range(len(keys))], use_threads=False)
    found = grouped.aggregate([("place", "min"), *[(f"m{i}", "max") for i in range(len(most))]])
    return order[found["place_min"].to_numpy()], [found[f"m{i}_max"].to_numpy() for i in range(len(most))]


def _with(rows: pa.Table, **columns: np.ndarray) -> pa.Table:
    """``rows`` with these columns of longs, in place of those they have."""
    for name, values in columns.items():
        made = pa.array(values, pa.int64())
        rows = rows.set_column(rows.column_names.index(name), name, made) if name in rows.column_names else rows.append_column(name, made)
    return rows


def _least_of_batch(keys: Sequence[str], others: Sequence[str]):
    """Before the shuffle: of a batch of rows, the least of each key, and its latest time. Copies of a hot key stay where they are."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            at, (latest,) = _least(rows, keys, others, [_MILLIS])
            yield from _with(rows.take(at), **{_MILLIS: latest}).combine_chunks().to_batches()

    return combine


def _stored(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _opened(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def _by_bucket(keys: Sequence[str], others: Sequence[str]):
    """Rows of a task as one value for each bucket, of ``_CHUNK`` rows at a time; keys that repeat are combined first."""
    combine = _least_of_batch((_BUCKET, *keys), others)

    def dealt(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by(_BUCKET).combine_chunks()
        bucket, rows = rows.column(_BUCKET).to_numpy(), rows.drop_columns([_BUCKET])
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts[1:], len(bucket))
        for i in range(0, len(starts), _AT_ONCE):
            s, e = starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE]
            values = [_stored(rows.slice(a, z - a)) for a, z in zip(s, e, strict=True)]
            yield pa.RecordBatch.from_pydict({_BUCKET: pa.array(bucket[s], pa.int64()), _ROWS: pa.array(values, pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in combine(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= _CHUNK:
                held = list(combine(pa.Table.from_batches(held).combine_chunks().to_batches()))
                n = sum(b.num_rows for b in held)
                if n > _CHUNK // 2:
                    yield from dealt(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield from dealt(pa.Table.from_batches(list(combine(pa.Table.from_batches(held).combine_chunks().to_batches()))))

    return pack


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stored in batch.column(_ROWS):
            yield from _opened(stored.as_py()).to_batches()


class _Choice(StatefulProcessor):
    """The rows that the keys of a bucket have now, until their time is over; puts out each row that replaces another.

    The state of a bucket is a list of parts, each with the rows that one micro-batch changed, so little is written for few rows. The
    least row of a key over all parts is its choice. A timer in the middle of the times of a bucket drops what is over and makes one part
    of the rest: at least half of the rows that it was set for go, so each row is written again few times.
    """

    def __init__(self, keys: Sequence[str], others: Sequence[str]):
        self.keys, self.others = list(keys), list(others)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", T.StructType([T.StructField(_ROWS, T.BinaryType()), T.StructField(_TIMER, T.LongType())]))

    def _timer(self, ends: np.ndarray, now: int) -> int:
        """Sets the timer of a bucket to the middle of its times, after now."""
        timer = max(int(np.partition(ends, len(ends) // 2)[len(ends) // 2]), now + 1)
        self.handle.registerTimer(timer)
        return timer

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, parts = timerValues.getCurrentWatermarkInMs(), list(self.parts.get())
        names = [*self.keys, *self.others, _MILLIS, VERSION]
        held = [_opened(p[0]).select(names) for p in parts]
        new = [_opened(row[_ROWS]) for row in rows]
        n_held = sum(len(t) for t in held)
        new = [_with(t, **{VERSION: np.zeros(len(t), np.int64)}).select(names) for t in new]
        both = pa.concat_tables([*held, *new])
        ends = both.column(_MILLIS).to_numpy()
        both = both.append_column(_BEFORE, pa.array(np.where(np.arange(len(both)) < n_held, ends, np.iinfo(np.int64).min)))
        at, (version, until, before) = _least(both, self.keys, self.others, [VERSION, _MILLIS, _BEFORE])
        better = at >= n_held
        chosen = _with(both.select(names).take(at), **{_MILLIS: until, VERSION: version + better})
        # A row that comes late is not held: it would leave the state at once.
        live = (until > now) | (now <= 0)
        changed = live & (better | (until > before))
        if changed.any():
            timer = parts[-1][1] if parts else self._timer(until[live], now)
            if len(parts) < _PARTS:
                self.parts.appendValue((_stored(chosen.filter(pa.array(changed))), timer))
            else:
                self.parts.put([(_stored(chosen.filter(pa.array(live))), timer)])
        if better.any():
            yield Row(**{_ROWS: _stored(chosen.filter(pa.array(better)).drop_columns([_MILLIS]))})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now, held = timerValues.getCurrentWatermarkInMs(), pa.concat_tables([_opened(p[0]) for p in self.parts.get()])
        at, (version, until) = _least(held, self.keys, self.others, [VERSION, _MILLIS])
        live = until > now
        if live.any():
            kept = _with(held.take(at), **{_MILLIS: until, VERSION: version}).filter(pa.array(live))
            self.parts.put([(_stored(kept), self._timer(until[live], now))])
        else:
            self.parts.clear()
        yield from ()

    def close(self) -> None:
        pass


def result_feed(
    results: DataFrame, out: str, checkpoint: str, keys: Sequence[str] = TRIAL_KEY, ts: str = "ts", keep: str = "1 day", buckets: int = BUCKETS,
    stores: int | None = None,
) -> StreamingQuery:
    """Write the results of a stream so that ``result_table`` has one row per key, whatever ranges overlap or batches are sent again.

    Of the rows of a key the least by its other columns, in their order, is its result: with the time first, the earliest. That
    depends on the rows alone, not on their batches. The state holds the result of a key so far, and each row that
    replaces it is appended as its next version; no batch reads what was written before. Keys share the state of one of ``buckets``
    buckets by their hash, so a state is opened once for many keys; a task holds one bucket at a time, and more buckets suit more keys. Go on
    with the number a checkpoint began with: another one finds no earlier choices, which repeats versions but leaves the table as it is. A timer drops the state of keys once the event time is ``keep`` past their last rows: at
    the latest when half of the keys of their bucket are. A row that comes later still is appended and takes its place in the table
    all the same, so ``keep`` bounds the state and never the result. Rows without an event time are appended as well, and are held
    until the event time moves. The buckets are dealt to ``stores`` state stores, a task each: unless given, two for each core
    the session has, or its shuffle partitions where they are fewer. A checkpoint goes on with the number it began with, so give it where the
    cluster will grow.
    """
    spark = results.sparkSession
    others = [c for c in results.columns if c not in keys]
    # Times travel as microseconds, which order alike wherever they are held.
    stamps = {f.name for f in results.schema.fields if isinstance(f.dataType, T.TimestampType)}
    fields = {f.name: T.StructField(f.name, T.LongType() if f.name in stamps else f.dataType) for f in results.schema.fields}
    row_type = T.StructType([*[fields[c] for c in (*keys, *others)], T.StructField(VERSION, T.LongType())])
    # Added to 0, a negative zero among the keys is one.
    real = {f.name for f in results.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    plain = [F.unix_micros(c).alias(c) if c in stamps else (F.col(c) + F.lit(0).cast(fields[c].dataType)).alias(c) if c in real else F.col(c) for c in keys]
    plain += [F.unix_micros(c).alias(c) if c in stamps else F.col(c) for c in others]
    # The watermark trails by ``keep`` already, so a timer at the time of a row is that much later.
    timed = results.withWatermark(ts, keep).select(*plain, F.coalesce(F.unix_millis(F.col(ts).cast("timestamp")), F.lit(0)).alias(_MILLIS))
    timed = timed.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    packed = timed.mapInArrow(_by_bucket(keys, others), f"{_BUCKET} bigint, {_ROWS} binary")
    chosen = packed.groupBy(_BUCKET).transformWithState(_Choice(keys, others), f"{_ROWS} binary", "append", "eventTime")
    chosen = chosen.mapInArrow(_unpacked, row_type).withColumns({c: F.timestamp_micros(c) for c in stamps})
    partitions = int(spark.conf.get(_SHUFFLE_PARTITIONS))
    settings = {_STATE_STORE: _ROCKSDB, _SHUFFLE_PARTITIONS: str(stores or min(partitions, _STORES * spark.sparkContext.defaultParallelism))}
    had = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return (
            chosen.writeStream.outputMode("append")
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def result_table(spark: SparkSession, out: str, keys: Sequence[str] = TRIAL_KEY) -> DataFrame:
    """One row per key of what ``result_feed`` wrote: the least of its versions, combined before the shuffle."""
    return one_per_key(spark.read.parquet(out).drop(VERSION), keys)


def drop_recent_repeats(
    results: DataFrame, ts: str = "ts", delay: str = "1 day", keys: Sequence[str] = TRIAL_KEY
) -> DataFrame:
    """Drop repeats of a key within the watermark delay: state is bounded by the keys of that span."""
    return results.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def health_by_window(
    runs: DataFrame, width: str = "1 hour", ts: str = "ts", state: str = "state", error: str = "error_msg"
) -> DataFrame:
    """Trials, invalid trials and retryable errors per tumbling window; for batches and streams."""
    return (
        runs.groupBy(F.window(ts, width))
        .agg(
            F.count("*").alias("n_trials"),
            F.count_if(is_invalid(state)).alias("n_invalid"),
            F.count_if(retryable(error)).alias("n_retryable"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "n_trials",
            "n_invalid",
            "n_retryable",
            rate(F.col("n_invalid"), F.col("n_trials")).alias("invalid_rate"),
        )
    )


def health_feed(
    runs: DataFrame, out: str, checkpoint: str, width: str = "1 hour", delay: str = "10 minutes", ts: str = "ts"
) -> StreamingQuery:
    """Append every window once it is closed by the watermark; later rows of it are dropped.

    Windows still open when the input ends are not written.
    """
    return (
        health_by_window(runs.withWatermark(ts, delay), width, ts)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
