"""Sessions over event streams, and their batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from edgewise.streaming.totals import STATE_STORE

CLOSE = "CLOSE_SESSION"
EVENT_SCHEMA = "user_id string, event_type string, timestamp timestamp"


def window_sessions(rows: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Built-in session windows per key: start, end, duration in seconds, events."""
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("session"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            key,
            F.col("session.start").alias("start"),
            F.col("session.end").alias("end"),
            (
                F.unix_timestamp("session.end") - F.unix_timestamp("session.start")
            ).alias("seconds"),
            "n",
        )
    )


def _combine(rows: DataFrame, key: str) -> DataFrame:
    """Per Arrow batch: count, first and last time of each key, before any shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grouped = pdf.groupby("key", as_index=False)
            yield grouped.agg(n=("millis", "size"), first=("millis", "min"), last=("millis", "max"))

    return rows.select(F.col(key).cast("string").alias("key"), "millis").mapInPandas(
        run, "key string, n bigint, first bigint, last bigint"
    )


class IdleSession(StatefulProcessor):
    """One open session a key; a processing-time timer closes it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "n bigint, start bigint, end bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, start, end = self.session.get() if self.session.exists() else (0, None, None)
        for pdf in rows:
            low, high = int(pdf["first"].min()), int(pdf["last"].max())
            n += int(pdf["n"].sum())
            start = low if start is None else min(start, low)
            end = high if end is None else max(end, high)
        self.session.update((n, start, end))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            yield pd.DataFrame([(key[0], *self.session.get(), True)], columns=["key", "n", "start", "end", "expired"])
            self.session.clear()

    def close(self) -> None:
        pass


def idle_sessions(rows: DataFrame, time: str, key: str, idle_ms: int) -> DataFrame:
    """Sessions of each key, told once, when no row has come for `idle_ms` of processing time.

    The state of a key is one session; it is forgotten when it is told. Rows are
    counted per Arrow batch before the shuffle. `expired` is always true.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        _combine(rows.withColumn("millis", F.unix_millis(time)), key)
        .groupBy("key")
        .transformWithStateInPandas(
            IdleSession(idle_ms),
            outputStructType="key string, n bigint, start bigint, end bigint, expired boolean",
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


def parse_events(lines: DataFrame, delay: str) -> DataFrame:
    """JSON lines to `user_id, event_type, timestamp` with a watermark."""
    return (
        lines.select(F.from_json("value", EVENT_SCHEMA).alias("e"))
        .select("e.*")
        .na.drop()
        .withWatermark("timestamp", delay)
    )


def split_sessions(events: list[tuple[int, bool]], gap_ms: int) -> list[list[tuple[int, bool]]]:
    """Events in time order cut into sessions.

    An event opens a session if none is open: the one before closed it, or came
    `gap_ms` or longer ago.
    """
    sessions: list[list[tuple[int, bool]]] = []
    for at, closing in sorted(events):
        if sessions:
            last, closed = sessions[-1][-1]
            if not closed and last + gap_ms > at:
                sessions[-1].append((at, closing))
                continue
        sessions.append([(at, closing)])
    return sessions


def session_end(session: list[tuple[int, bool]], gap_ms: int) -> int:
    """A closing event ends its session at once, any other after the gap."""
    at, closing = session[-1]
    return at if closing else at + gap_ms


class Timeline:
    """Events of a user that are not final yet, in time buckets, and the session they may continue.

    `buckets` maps a bucket number to `(times, closings, counts)`, sorted and without
    repeats, so that a bucket has at most two entries a millisecond; `firsts` maps it to
    its earliest time, or to None as long as that was not looked up. `open` is the session all final events have led to, as (start, last,
    closed, n), or None. Adding a late event loads its bucket; making events final loads the
    buckets below the watermark. No access loads all of a user.
    """

    def __init__(self, buckets, firsts, open_session: tuple | None, gap_ms: int, bucket_ms: int):
        self.buckets, self.firsts, self.open = buckets, firsts, open_session
        self.gap_ms, self.bucket_ms = gap_ms, bucket_ms

    def _store(self, bucket: int, entries: list[tuple[int, bool, int]]) -> None:
        if entries:
            self.buckets[bucket] = tuple([e[i] for e in entries] for i in range(3))
            self.firsts[bucket] = entries[0][0]
        else:
            del self.buckets[bucket], self.firsts[bucket]

    def add(self, events: list[tuple[int, bool, int]]) -> None:
        """Merge (time, closing, count) events into their buckets."""
        parts: dict[int, dict[tuple[int, bool], int]] = {}
        for at, closing, n in events:
            held = parts.setdefault(at // self.bucket_ms, {})
            held[at, closing] = held.get((at, closing), 0) + n
        for bucket, held in parts.items():
            if bucket in self.firsts:
                for at, closing, n in zip(*self.buckets[bucket], strict=True):
                    held[at, closing] = held.get((at, closing), 0) + n
            self._store(bucket, sorted((at, closing, n) for (at, closing), n in held.items()))

    def end(self) -> int:
        start, last, closed, _ = self.open
        return last if closed else last + self.gap_ms

    def advance(self, mark: int) -> list[tuple[int, int, int]]:
        """Make all events before `mark` final; sessions (start, end, events) that end before it."""
        done = []

        def report() -> None:
            done.append((self.open[0], self.end(), self.open[3]))

        for bucket in sorted(b for b, first in self.firsts.items() if (b * self.bucket_ms if first is None else first) < mark):
            entries = list(zip(*self.buckets[bucket], strict=True))
            for at, closing, n in entries:
                if at >= mark:
                    break
                for size in [1] * n if closing else [n]:  # each closing event ends a session
                    if self.open and not self.open[2] and self.open[1] + self.gap_ms > at:
                        self.open = (self.open[0], at, closing, self.open[3] + size)
                    else:
                        if self.open:
                            report()
                        self.open = (at, at, closing, size)
            if entries[0][0] < mark:
                self._store(bucket, [e for e in entries if e[0] >= mark])
            else:
                self.firsts[bucket] = entries[0][0]
        if self.open and self.end() < mark:
            report()
            self.open = None
        return done

    def next_time(self) -> int | None:
        """When there is something to do again: a pending event or the end of the open session."""
        times = []
        if self.firsts:
            low = min(self.firsts)
            if self.firsts[low] is None:
                self.firsts[low] = self.buckets[low][0][0]
            times.append(self.firsts[low])
        if self.open:
            times.append(self.end())
        return min(times) + 1 if times else None


class _Held:
    """A state map of one-column keys as a mutable mapping."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, bucket: int):
        return tuple(self.state.getValue((bucket,)))

    def __setitem__(self, bucket: int, value) -> None:
        self.state.updateValue((bucket,), value)

    def __delitem__(self, bucket: int) -> None:
        self.state.removeKey((bucket,))

    def __iter__(self):
        return iter([k[0] for k in self.state.keys()])


class ClosingSessions(StatefulProcessor):
    """Sessions of a user's `Timeline`; event-time timers make events final."""

    def __init__(self, gap_ms: int, bucket_ms: int):
        self.gap_ms, self.bucket_ms = gap_ms, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, last bigint, closed boolean, n bigint")
        self.buckets = handle.getMapState("buckets", "bucket bigint", "times array<bigint>, closings array<boolean>, counts array<bigint>")

    def _run(self, key, events: list[tuple[int, bool, int]], mark: int) -> Iterator[pd.DataFrame]:
        opened = tuple(self.open.get()) if self.open.exists() else None
        held = _Held(self.buckets)
        # each call to the state is a message to the JVM: the buckets are listed once, and found in that list
        line = Timeline(held, dict.fromkeys(held), opened, self.gap_ms, self.bucket_ms)
        line.add(events)
        done = line.advance(mark)
        if line.open is not None:
            self.open.update(line.open)
        elif opened is not None:
            self.open.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        at = line.next_time()
        if at is not None:
            self.handle.registerTimer(max(at, mark + 1))
        if done:
            rows = [(key[0], start, end - start, n) for start, end, n in done]
            yield pd.DataFrame(rows, columns=["user_id", "start_ms", "duration_ms", "n_events"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [e for pdf in rows for e in zip(pdf["millis"].tolist(), pdf["closing"].tolist(), pdf["n"].tolist(), strict=True)]
        yield from self._run(key, events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def closing_sessions(events: DataFrame, gap_ms: int, bucket_ms: int = 60_000) -> DataFrame:
    """Event-time sessions that a closing event may end early; append mode.

    A late event, closing or not, can still split or join sessions until the
    watermark has passed it. Events wait in buckets of `bucket_ms` of the user's timeline; when
    the watermark passes them they are folded into the open session, which is reported
    when its end lies before the watermark. A bucket holds each time once, with counts, so
    what an access loads is bounded by the width of a bucket and not by the user. `events`
    needs a watermark on `timestamp`.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        events.select(
            "user_id",
            "timestamp",
            F.unix_millis("timestamp").alias("millis"),
            (F.col("event_type") == CLOSE).alias("closing"),
            F.lit(1).cast("bigint").alias("n"),
        )
        .groupBy("user_id")
        .transformWithStateInPandas(
            ClosingSessions(gap_ms, bucket_ms),
            outputStructType="user_id string, start_ms bigint, duration_ms bigint, n_events bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def batch_sessions(
    rows: DataFrame, key: str, millis: Column, closing: Column, gap_ms: int, bucket_ms: int = 3_600_000
) -> DataFrame:
    """Batch form of `closing_sessions`, for a user of any size.

    Events are ordered inside (user, time bucket) only. What a bucket has to know
    of the ones before it, the last event and the latest session start, travels
    in one summary row per bucket.
    """
    inside = f"(partition by {key}, bucket order by at, closing)"
    across = f"(partition by {key} order by bucket rows between unbounded preceding and 1 preceding)"
    opens = f"before is null or before_closing or before + {gap_ms} <= at"
    events = rows.select(F.col(key), millis.alias("at"), closing.alias("closing")).withColumn(
        "bucket", F.floor(F.col("at") / bucket_ms)
    )
    edges = events.groupBy(key, "bucket").agg(
        F.max(F.struct("at", "closing")).alias("tail"), F.count(F.lit(1)).alias("size")
    )
    edges = edges.selectExpr(
        key,
        "bucket",
        f"lag(tail) over (partition by {key} order by bucket) as carried",
    )
    marked = (
        events.selectExpr(
            "*", f"lag(at) over {inside} as in_at", f"lag(closing) over {inside} as in_closing"
        )
        .join(edges, [key, "bucket"])
        .selectExpr(
            key,
            "bucket",
            "at",
            "closing",
            "coalesce(in_at, carried.at) as before",
            "if(in_at is null, carried.closing, in_closing) as before_closing",
        )
        .selectExpr(key, "bucket", "at", "closing", f"if({opens}, at, null) as opened")
        # two events of one time may open a session each: number the openings too
        .selectExpr(
            "*",
            f"max(opened) over {inside} as start_in",
            f"count(opened) over {inside} as rank_in",
        )
    )
    starts = (
        marked.groupBy(key, "bucket")
        .agg(F.max("opened").alias("latest"), F.count("opened").alias("opened"))
        .selectExpr(
            key,
            "bucket",
            f"max(latest) over {across} as start_before",
            f"coalesce(sum(opened) over {across}, 0) as rank_before",
        )
    )
    return (
        marked.join(starts, [key, "bucket"])
        .selectExpr(
            key,
            "rank_before + rank_in as session",
            "coalesce(start_in, start_before) as start_ms",
            f"if(closing, at, at + {gap_ms}) as until",
            "at",
            "closing",
        )
        .groupBy(key, "session")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max(F.struct("at", "closing", "until")).alias("tail"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .selectExpr(key, "start_ms", "tail.until - start_ms as duration_ms", "n_events")
    )
