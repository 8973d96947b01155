"""Operators on streams. Each takes a streaming (or a batch) DataFrame and returns one; sinks are the caller's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from wardline.functions.urls import rule_url_score, url_features

SHARES = 1024  # groups of keys that share a state
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(df: DataFrame, time: str) -> DataFrame:
    """df with its time column as a timestamp, which watermarks ask for."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def ingest(stream: DataFrame, min_url: int = 8, min_html: int = 200, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Filters, then URL features and scores; the html goes no further."""
    good = stream.where((F.length(url_col) >= min_url) & (F.length(html_col) >= min_html)).drop(html_col)
    return rule_url_score(url_features(good, url_col))


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, **rules):
    """Writes ingest() as Parquet. A restart goes on from the checkpoint; available data is worked off and the query ends."""
    return ingest(stream, **rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dedupe_stream(stream: DataFrame, key: Column, time: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key. With time and within, keys are forgotten once the watermark has passed them."""
    keyed = stream.withColumn("_key", key)
    if time and within:
        return timed(keyed, time).withWatermark(time, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return keyed.dropDuplicates(["_key"]).drop("_key")


def running_counts(stream: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows so far by the first rule they fail; for update or complete mode."""
    reason = F.coalesce(*(F.when(F.coalesce(cond, F.lit(True)), name) for name, cond in rules), F.lit("accepted"))
    return stream.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def quota_stream(stream: DataFrame, key: str, limit: int, order: str) -> DataFrame:
    """The first rows of each key as they arrive (by order inside a batch), up to limit; state is one count per key."""
    columns = stream.columns
    state = "n long"

    def take(key_: tuple, frames: Iterator[pd.DataFrame], seen: GroupState) -> Iterator[pd.DataFrame]:
        n = seen.get[0] if seen.exists else 0
        if n < limit:
            rows = pd.concat(f.nsmallest(limit - n, order) if pd.api.types.is_numeric_dtype(f[order]) else f.sort_values(order).head(limit - n) for f in frames).sort_values(order).head(limit - n)
            seen.update((n + len(rows),))
            yield rows[columns]
        else:
            for _ in frames:
                pass

    return stream.groupBy(key).applyInPandasWithState(take, stream.schema, state, "append", GroupStateTimeout.NoTimeout)


class Reuse(StatefulProcessor):
    """Holds the rows of a share of the keys until the watermark has passed them and judges each key's in order of time, ties by tie.

    Keys share their state's calls: a call takes rows of many keys, and each key's last fresh time is an entry of a map.
    """

    def __init__(self, tie_type: str, ttl: int):
        self.tie_type, self.ttl = tie_type, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"of string, at long, tie {self.tie_type}")
        self.last = handle.getListState("last", "of string, at long")

    def wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        least = None
        for frame in rows:
            times = frame["at"].tolist()
            self.held.appendList(list(zip(frame["of"].tolist(), times, frame["tie"].tolist(), strict=True)))
            least = min(times) if least is None else min(least, min(times))
        if least is not None:
            self.wake(least)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for row in self.held.get():
            (due if row[1] <= passed else later).append(tuple(row))
        before = [tuple(x) for x in self.last.get()]
        last = {of: at for of, at in before if at + self.ttl > passed or due}
        due.sort()
        fresh = []
        for of, at, _ in due:
            hit = of in last and at - last[of] < self.ttl
            fresh.append(not hit)
            if not hit:
                last[of] = at
        # A fresh row older than ttl hides none that is still to come.
        last = {of: at for of, at in last.items() if at + self.ttl > passed}
        if due or len(last) < len(before):
            self.last.put(list(last.items())) if last else self.last.clear()
        if due:
            self.held.put(later) if later else self.held.clear()
        if last:
            self.wake(min(last.values()) + self.ttl)
        if later:
            self.wake(min(x[1] for x in later))
        for i in range(0, len(due), 10_000):
            part = due[i : i + 10_000]
            yield pd.DataFrame({"of": [x[0] for x in part], "at": [x[1] for x in part], "tie": [x[2] for x in part], "fresh": fresh[i : i + 10_000]})


def ttl_stream(stream: DataFrame, key: list[str], time: str, tie: str, ttl_seconds: float = 300.0, late: str = "10 minutes", shares: int = SHARES) -> DataFrame:
    """Rows with `fresh`: false within ttl of the key's last fresh row, which hits don't extend.

    In whatever order rows come, the answer is that of ttl_reuse() on the whole table: a row is held in its
    key's state until the watermark (`late` behind the newest time seen) has passed it, then judged in order
    of time. Rows later than that are dropped, as by every watermark, and rows without a time or tie too.
    State is the rows of the last `late`, and one time per key, which goes once the watermark is ttl past it;
    it lies in `shares` groups of keys by their hash, each judged in one task (more, where a lateness has
    more rows than those tasks hold; a running stream's number is fixed by its checkpoint).
    What the watermark has not passed when a stream ends stays held; closing_row() lets it go. Sets the
    session's state store to RocksDB, which timers and lists ask for.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    marked = timed(stream.select(*key, time, tie), time).withWatermark(time, late)
    kinds = dict(marked.dtypes)
    # The condition names the time, so that it stays above the watermark, which closing rows must reach.
    kept = marked.where(F.when(F.col(time).isNotNull(), F.col(tie).isNotNull()))
    # Keys travel as one string: workers would see a null in a column of integers as a float.
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    of = F.to_json(F.struct(*key), exact)
    plain = kept.select(of.alias("of"), F.pmod(F.xxhash64(of), F.lit(shares)).alias("share"), F.col(time).alias("time"), F.unix_micros(time).alias("at"), F.col(tie).alias("tie"))
    out = f"of string, at long, tie {kinds[tie]}, fresh boolean"
    judged = plain.groupBy("share").transformWithStateInPandas(Reuse(kinds[tie], int(ttl_seconds * 1e6)), out, "append", "eventTime")
    of = F.from_json("of", ", ".join(f"`{k}` {kinds[k]}" for k in key), exact)
    return judged.select(*(of[k].alias(k) for k in key), F.timestamp_micros("at").alias(time), F.col("tie").alias(tie), "fresh")


def closing_row(df: DataFrame, time: str, late: str) -> DataFrame:
    """One row of nulls, with a time so late that a stream that reads it after df lets go of all rows of df.

    It has no tie, so ttl_stream() only takes its time. Of an empty df, or one without times, the time is null.
    """
    end = F.max(F.col(time).cast("timestamp")) + F.expr(f"interval {late}") + F.expr("interval 1 second")
    return df.agg(end.cast(dict(df.dtypes)[time]).alias(time)).select(*(F.col(time) if c == time else F.lit(None).cast(t).alias(c) for c, t in df.dtypes))


def debounced_stream(stream: DataFrame, key: list[str], time: str, gap: str = "800 milliseconds", late: str = "1 minute") -> DataFrame:
    marked = timed(stream, time).withWatermark(time, late)
    out = marked.groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(*key, F.col("w.end").alias("acts_at"), "events")


def latest_stream(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The newest value of each key so far; for update or complete mode."""
    return timed(stream, time).groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def windowed_stream(stream: DataFrame, what: list[str], time: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window; rows later than the watermark are dropped, windows are final in append mode."""
    marked = timed(stream, time).withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return marked.groupBy(w.alias("w"), *what).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *what, "n")
