"""Structured Streaming forms of the windowed operators."""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of one table in a folder, a single file or a folder of its own."""
    at = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = spark.readStream.schema(schema)
    if files_a_trigger:
        stream = stream.option("maxFilesPerTrigger", files_a_trigger)
    return stream.parquet(at) if whole else stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def sliding_counts(stream: DataFrame, time: Column, width: str, stride: str, late: str, keys: list[str]) -> DataFrame:
    """Count and sum of `value` by key and sliding window [start, end)."""
    rows = stream.withColumn("_time", time.cast("timestamp")).withWatermark("_time", late)
    out = rows.groupBy(F.window("_time", width, stride), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, time: Column, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Episodes of a key: rows with less than the gap between them."""
    rows = stream.withColumn("_time", time.cast("timestamp")).withWatermark("_time", late)
    out = rows.groupBy(F.session_window("_time", gap), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, as a table: the last batch's result, in Parquet files in the warehouse folder until the session ends."""
    spark = stream.sparkSession
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/drained-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    def clear() -> None:
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(clear)
    stream.writeStream.outputMode(mode).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stepped(stream: DataFrame, key: str, order: str, output: str, state: str, start: Callable, step: Callable) -> DataFrame:
    """A stream's rows with what a state that goes from row to row of a key says of each.

    start() gives a key's first state, a tuple; step(state, row) the next state and the values of the
    output columns, a tuple. Rows of a batch are taken in order; batches are taken as they come.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = stream.columns
    added = [f.split()[0] for f in output.split(", ")]

    def run(_, frames, held):
        now = held.get if held.exists else start()
        rows = pd.concat(frames).sort_values(order, kind="stable")
        out = []
        for row in rows.to_dict("records"):
            now, values = step(now, row)
            out.append(values)
        held.update(now)
        yield rows.assign(**{c: [v[k] for v in out] for k, c in enumerate(added)})[[*names, *added]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(key).applyInPandasWithState(run, f"{schema}, {output}", state, "append", GroupStateTimeout.NoTimeout)


#: Under which a row has its time, in microseconds since 1970.
MICROS = "_micros"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(stream: DataFrame, key: str, time: str, output: str, start: Callable, step: Callable, late: str = "0 seconds", tie: str | None = None, idle: str | None = None) -> DataFrame:
    """A stream's rows with what a state that goes from row to row of a key says of each, in the order of event time.

    start() gives a key's first state, step(state, row) the next state and the values of the output
    columns, a tuple; states must be JSON, and row has its time in microseconds under MICROS. Rows wait until the watermark (the latest time less `late`) has
    passed them, so whatever order they come in within `late`, the result is that of a table sorted by time and
    `tie`. A row that comes when a later one of its key has been taken is left out. With `idle`, a key without rows for so long after its last one starts anew, and
    its state goes. Needs the RocksDB state store, which is set for the session. Rows without a time are left out.
    """
    from pyspark.sql.streaming import StatefulProcessor

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names = [*stream.columns, MICROS]
    rows = stream.where(F.col(f"`{time}`").isNotNull()).withColumn(MICROS, F.unix_micros(F.col(f"`{time}`")))
    order = [len(names) - 1] + ([] if tie is None else [names.index(tie)])
    added = [f.split()[0] for f in output.split(", ")]
    wait = int(spark.sql(f"select timestampdiff(millisecond, timestamp_ntz'2000-01-01', timestamp_ntz'2000-01-01' + interval {idle})").first()[0]) if idle else None
    inner = rows.schema

    class InOrder(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", inner)
            self.state = handle.getValueState("state", "state string, seen long")

        @staticmethod
        def ms(row) -> int:
            """The first millisecond by which the watermark has passed the row."""
            return row[-1] // 1000 + 1

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            fresh = pd.concat(rows).astype(object)
            fresh = [tuple(r) for r in fresh.where(fresh.notna(), None).itertuples(index=False)]
            if self.state.exists():
                seen = self.state.get()[1]
                fresh = [r for r in fresh if r[-1] >= seen]
            if not fresh:
                return iter(())
            self.waiting.appendList(fresh)
            # the next timer is that of the earliest row that waits
            self.handle.registerTimer(min(map(self.ms, fresh)))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            until = timerValues.getCurrentWatermarkInMs()
            held = list(self.waiting.get()) if self.waiting.exists() else []
            # of nulls in the tie the first
            due = sorted((tuple(r) for r in held if self.ms(r) <= until), key=lambda r: tuple((r[k] is not None, r[k]) for k in order))
            rest = [tuple(r) for r in held if self.ms(r) > until]
            state = self.state.get() if self.state.exists() else None
            now, seen = (json.loads(state[0]), state[1]) if state else (start(), None)
            out = []
            for r in due:
                if wait is not None and seen is not None and (r[-1] - seen) // 1000 > wait:
                    now = start()
                now, values = step(now, dict(zip(names, r)))
                seen = r[-1]
                out.append((*r[:-1], *values))
            if due:
                if rest:
                    self.waiting.put(rest)
                else:
                    self.waiting.clear()
                self.state.update((json.dumps(now), seen))
            if rest:
                self.handle.registerTimer(min(map(self.ms, rest)))
            elif wait is not None and seen is not None:
                if until - seen // 1000 > wait:
                    self.state.clear()
                else:
                    self.handle.registerTimer(seen // 1000 + wait + 1)
            if out:
                yield pd.DataFrame(out, columns=[*names[:-1], *added])

        def close(self):
            pass

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return rows.withWatermark(time, late).groupBy(key).transformWithStateInPandas(InOrder(), f"{schema}, {output}", "append", "eventTime")


def missing(value) -> bool:
    return value is None or value != value


def onset_step(value: str, rows: int, factor: float, floor: float) -> Callable:
    """A row's `onset`, as the batch operator has it: a null value keeps its place among the `rows` before, but isn't in their median."""
    from statistics import median

    def step(now, row):
        above_before, recent = now
        v = None if missing(row[value]) else float(row[value])
        recent = [*recent[len(recent) - rows if len(recent) > rows else 0 :], v] if rows else [v]
        if v is None:
            return (None, recent), (False if above_before else None,)
        above = v > max(factor * median([x for x in recent if not missing(x)]), floor)
        return (above, recent), (bool(above and not above_before),)

    return step


def carry_step(value: str) -> Callable:
    def step(now, row):
        last = now[0] if missing(row[value]) else float(row[value])
        return (last,), (last,)

    return step


def onsets(stream: DataFrame, key: str, order: str, value: str, rows: int, factor: float, floor: float) -> DataFrame:
    """The stream with `onset`: the value rises over factor * the median of the rows before it (and itself) and over floor. Rows count as they come."""
    return stepped(stream, key, order, "onset boolean", "above boolean, recent array<double>", lambda: (False, []), onset_step(value, rows, factor, floor))


def carried(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The stream with `last`: the value of the row, or where it has none that of the last one before. Rows count as they come."""
    return stepped(stream, key, order, "last double", "last double", lambda: (None,), carry_step(value))


def onsets_in_order(stream: DataFrame, key: str, time: str, value: str, rows: int, factor: float, floor: float, **how) -> DataFrame:
    """onsets() by event time; how: late, tie and idle of in_order()."""
    return in_order(stream, key, time, "onset boolean", lambda: (False, []), onset_step(value, rows, factor, floor), **how)


def carried_in_order(stream: DataFrame, key: str, time: str, value: str, **how) -> DataFrame:
    """carried() by event time; how: late, tie and idle of in_order()."""
    return in_order(stream, key, time, "last double", lambda: (None,), carry_step(value), **how)


def episodes_in_order(stream: DataFrame, key: str, time: str, flag: str, gap: float, **how) -> DataFrame:
    """The stream with `episode`, the number of the stretch of its key that a row with the flag belongs to, else null.

    Stretches under `gap` seconds apart are one; a flag holds until the next row. how: late, tie and idle of in_order().
    """

    def step(now, row):
        on_before, nth, off_since = now
        at, on = row[MICROS] / 1e6, not missing(row[flag]) and bool(row[flag])
        if on and not on_before and (off_since is None or at - off_since >= gap):
            nth += 1
        if on_before and not on:
            off_since = at
        return (on, nth, off_since), (nth if on else None,)

    return in_order(stream, key, time, "episode long", lambda: (False, 0, None), step, **how)


def to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], key_time: Callable[[DataFrame], DataFrame] | None = None, late: tuple[str, str] | None = None):
    """Appends a stream to Parquet, what is there now; each file once, across restarts with one checkpoint.

    `late` (a time column and how late a repeat may come) bounds how long keys are remembered; without it all are.
    """
    rows = key_time(stream) if key_time else stream
    rows = rows.withWatermark(*late).dropDuplicatesWithinWatermark(keys) if late else rows.dropDuplicates(keys)
    q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
