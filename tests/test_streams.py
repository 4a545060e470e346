import pytest
from pyspark.sql import functions as F

from edgewise.streaming import clicks, learning, sessions, totals, words
from edgewise.streaming.run import Sink, table_stream


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_split_sessions():
    events = [(0, False), (3, True), (4, False), (20, False), (25, False)]
    assert sessions.split_sessions(events, 5) == [
        [(0, False), (3, True)], [(4, False)], [(20, False)], [(25, False)],
    ]
    assert sessions.session_end([(0, False), (3, True)], 5) == 3
    assert sessions.session_end([(4, False)], 5) == 9


def test_late_closing_event_splits_a_stored_session(spark, tmp_path):
    folder = str(tmp_path / "in")
    sink = Sink(spark, "t")
    schema = "value string"
    line = '{{"user_id": "u", "event_type": "{}", "timestamp": "2024-01-01T00:00:{:02d}Z"}}'

    def run():
        events = sessions.parse_events(table_stream(spark, folder), "10 seconds")
        return sink.append(sessions.closing_sessions(events, 5000))

    feed(spark, folder, [(line.format("NEW_EVENT", s),) for s in (0, 2, 4)], schema)
    assert run().count() == 0
    feed(spark, folder, [(line.format("CLOSE_SESSION", 3),), (line.format("NEW_EVENT", 40),)], schema)
    found = sorted((r["duration_ms"], r["n_events"]) for r in run().collect())
    assert found == [(3000, 3), (5000, 1)]


@pytest.mark.parametrize("bucket", [1000, 3_600_000])
def test_batch_sessions_match_the_plain_split(spark, bucket):
    import random

    rng = random.Random(9)
    events = [(rng.choice("ab"), rng.randrange(60_000), rng.random() < 0.2) for _ in range(120)]
    rows = spark.createDataFrame(events, "u string, ms bigint, c boolean")
    found = sessions.batch_sessions(rows, "u", F.col("ms"), F.col("c"), 1500, bucket).collect()
    want = [
        (u, s[0][0], sessions.session_end(s, 1500) - s[0][0], len(s))
        for u in "ab"
        for s in sessions.split_sessions([(m, c) for k, m, c in events if k == u], 1500)
    ]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_idle_sessions_are_told_on_expiry_only(spark, tmp_path):
    folder = str(tmp_path / "in")
    sink = Sink(spark, "t", once=True)
    at = spark.sql("select timestamp'2024-01-01 00:00:00' as t").first()["t"]

    def state(idle):
        return sessions.idle_sessions(table_stream(spark, folder), "at", "k", idle)

    feed(spark, folder, [("a", at), ("a", at)], "k string, at timestamp")
    # one batch and a stop: the session is open, nothing is told
    assert sink.batches(state(600_000), lambda part, batch: part).count() == 0
    feed(spark, folder, [("a", at), ("b", at)], "k string, at timestamp")
    # the restarted stream goes on with the stored session and sets shorter timers
    got = sink.until_idle(state(1500), lambda part, batch: part)
    assert sorted((r["key"], r["n"], r["expired"]) for r in got.collect()) == [("a", 3, True), ("b", 1, True)]
    # a key that comes back opens a new session
    feed(spark, folder, [("a", at)], "k string, at timestamp")
    got = sink.until_idle(state(1500), lambda part, batch: part)
    assert sorted((r["key"], r["n"]) for r in got.collect()) == [("a", 1), ("a", 3), ("b", 1)]


class Counted(dict):
    """A state map that tells how many entries were loaded."""

    loaded = 0

    def __getitem__(self, key):
        found = super().__getitem__(key)
        self.loaded += len(found[0])
        return found


def test_a_late_event_loads_one_bucket():
    line = sessions.Timeline(Counted(), {}, None, 5000, 1000)
    line.add([(t, False, 3) for t in range(0, 1_000_000, 10)])
    line.buckets.loaded = 0
    line.add([(500_005, True, 1)])
    assert line.buckets.loaded == 100
    line.buckets.loaded = 0
    # final events: two buckets below the mark
    assert line.advance(2000) == [] and line.buckets.loaded == 200
    line.buckets.loaded = 0
    line.add([(700_000, False, 10**6)])  # a time of a million events is one entry
    assert line.buckets.loaded == 100
    assert line.advance(10**9) == [(0, 500_005, 150_004), (500_010, 999_990 + 5000, 149_997 + 10**6)]


def test_a_users_state_is_called_a_few_times_an_event():
    class State:
        """A state map that counts the calls to it."""

        def __init__(self):
            self.held, self.calls = {}, 0

        def __getattr__(self, name):
            do = {
                "getValue": lambda key: self.held[key],
                "updateValue": lambda key, value: self.held.update({key: value}),
                "removeKey": lambda key: self.held.pop(key),
                "keys": lambda: iter(list(self.held)),
                "exists": lambda: "" in self.held,
                "get": lambda: self.held[""],
                "update": lambda value: self.held.update({"": value}),
                "clear": lambda: self.held.clear(),
                "containsKey": lambda key: key in self.held,
            }[name]

            def run(*args):
                self.calls += 1
                return do(*args)

            return run

    class Handle:
        def __init__(self):
            self.states, self.timer = {}, None

        def getValueState(self, name, *schemas):
            return self.states.setdefault(name, State())

        getMapState = getValueState

        def listTimers(self):
            return []

        def registerTimer(self, at):
            self.timer = at

    handle, user = Handle(), sessions.ClosingSessions(1500, 1000)
    user.init(handle)
    events = [(5000 * i, False, 1) for i in range(100)]
    assert list(user._run(("a",), events, 0)) == [] and handle.timer == 1
    # two buckets at a time: the one told of is loaded, the next one tells when to go on
    told = list(user._run(("a",), [], 5001))
    assert told[0].values.tolist() == [["a", 0, 1500, 1]] and handle.timer == 5000 + 1500 + 1
    told = list(user._run(("a",), [], 10**6))
    assert len(told[0]) == 99 and not any(s.held for s in handle.states.values())
    assert sum(s.calls for s in handle.states.values()) < 4 * len(events)


@pytest.mark.parametrize("seed", range(20))
def test_timeline_equals_the_plain_split(seed):
    import random

    rng = random.Random(seed)
    events = sorted((rng.randrange(40_000), rng.random() < 0.2) for _ in range(rng.randint(1, 120)))
    want = [(s[0][0], sessions.session_end(s, 1500), len(s)) for s in sessions.split_sessions(events, 1500)]
    line, got, mark = sessions.Timeline({}, {}, None, 1500, rng.choice([100, 1000, 10**7])), [], 0
    shuffled = sorted(events, key=lambda e: e[0] + rng.randrange(3000))
    while shuffled:
        part, shuffled = shuffled[:7], shuffled[7:]
        line.add([(*e, 1) for e in part])
        rest = [e[0] for e in shuffled]
        mark = max(mark, min(rest, default=10**6))
        got += line.advance(mark)
    assert got == want
    assert line.next_time() is None


def test_closing_sessions_over_five_batches(spark, tmp_path):
    import random

    rng = random.Random(3)
    folder, sink = str(tmp_path / "in"), Sink(spark, "t")
    events = sorted((rng.randrange(100_000), rng.choice("ab"), rng.random() < 0.2) for _ in range(200))
    late = sorted(events, key=lambda e: e[0] + rng.randrange(9000))
    late.append((10**6, "z", True))  # moves the watermark past everything
    schema = "ms bigint, user_id string, closing boolean"

    def run():
        rows = table_stream(spark, folder).selectExpr("user_id", "if(closing, 'CLOSE_SESSION', 'NEW_EVENT') as event_type", "timestamp_millis(ms) as timestamp")
        return sink.append(sessions.closing_sessions(rows.withWatermark("timestamp", "10 seconds"), 1500, 700))

    for i in range(5):
        feed(spark, folder, late[41 * i : 41 * i + 41], schema)
        got = run()
    found = sorted(tuple(r) for r in got.where("user_id <> 'z'").collect())
    rows = spark.createDataFrame(events, schema)
    want = sessions.batch_sessions(rows, "user_id", F.col("ms"), F.col("closing"), 1500)
    assert found == sorted(tuple(r) for r in want.collect()) and len(found) > 40


def test_windows_that_are_open_are_told(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = spark.sql("select timestamp'2024-01-01 00:00:30' as t").first()["t"]
    feed(spark, folder, [("/a", 404, 1, 5, at), ("/a", 200, 1, 6, at), ("/b", 200, 1, 6, at)], clicks.VIEW_SCHEMA)
    views = table_stream(spark, folder)
    now = clicks.active_users_now(views, "1 minute", "1 minute", "1 minute", Sink(spark, "t")).collect()
    assert [r["n_users"] for r in now] == [2]
    assert Sink(spark, "t").append(clicks.active_users(views, "1 minute", "1 minute", "1 minute")).count() == 0


def test_running_totals_with_initial_state_and_restart(spark, tmp_path):
    folder = str(tmp_path / "in")
    sink = Sink(spark, "t")
    start = spark.createDataFrame([("hello", 1), ("world", 1)], "word string, n bigint")

    def run():
        state = totals.running_totals(table_stream(spark, folder), start)
        rows = sink.batches(state, lambda part, batch: part, "update").collect()
        return {r["word"]: r["total"] for r in sorted(rows, key=lambda r: r["batch"])}

    feed(spark, folder, [("hello",), ("hello",), ("x",)], "word string")
    assert run()["hello"] == 3
    feed(spark, folder, [("hello",)], "word string")
    assert run()["hello"] == 4


def test_windows_reject_a_slide_beyond_the_size(spark, tmp_path):
    rows = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        words.windowed_counts(rows, "timestamp", "value", "10 seconds", "20 seconds")


def test_recovery_counts_every_line_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    sink = Sink(spark, "t")
    listed = spark.createDataFrame([("bad",)], "word string")
    for lines in ([("good bad",)], [("bad bad",)]):
        feed(spark, folder, lines, "value string")
        out = words.filtered_counts(table_stream(spark, folder), listed, sink)
    total = out.agg(F.sum("n_kept"), F.sum("n_dropped"), F.count_distinct("batch")).first()
    assert tuple(total) == (1, 3, 2)


def test_views_from_tab_separated_files(spark, tmp_path):
    (tmp_path / "v.tsv").write_text(
        "/a\t200\t10\t1\t2024-01-01 00:00:00\n/a\t404\t10\t2\t2024-01-01 00:00:01\n"
    )
    sink = Sink(spark, "t")
    views = clicks.read_views(spark, str(tmp_path))
    assert sink.batches(views, lambda r, b: clicks.page_counts(r)).first()["n"] == 2


def test_binary_messages(spark, tmp_path):
    folder = str(tmp_path / "in")
    feed(spark, folder, [(bytearray(b"a b a"),)], "value binary")
    counts = Sink(spark, "t").latest(words.running_counts(table_stream(spark, folder)))
    assert {r["word"]: r["n"] for r in counts.collect()} == {"a": 2, "b": 1}


def test_streaming_models(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [([1.0, i / 5 - 0.9], 2.0 + 3.0 * (i / 5 - 0.9)) for i in range(10)]
    feed(spark, folder, rows, "features array<double>, label double")
    model = learning.StreamingRegression(dims=2, step=1.5, steps=30)
    model.train(table_stream(spark, folder), Sink(spark, "t"))
    assert model.weights == pytest.approx([2.0, 3.0], abs=0.3)

    points = str(tmp_path / "points")
    feed(spark, points, [([0.0, 0.0],), ([0.0, 0.2],), ([9.0, 9.0],), ([9.0, 9.2],)], "features array<double>")
    means = learning.StreamingKMeans(k=2, dims=2, decay=0.5, start=[[1, 1], [8, 8]])
    means.train(table_stream(spark, points), Sink(spark, "t"))
    assert means.centres.tolist() == [pytest.approx([0, 0.1]), pytest.approx([9, 9.1])]


def test_two_sided_p():
    # published table values of Student's t
    assert learning.two_sided_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert learning.two_sided_p(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_latest_after_a_restart_without_input(spark, tmp_path):
    from edgewise.streaming import words

    folder = str(tmp_path / "lines")
    feed(spark, folder, [("a b a",)], "value string")
    sink = Sink(spark, "restart")
    first = words_of(sink.latest(words.running_counts(table_stream(spark, folder))))
    assert first == words_of(sink.latest(words.running_counts(table_stream(spark, folder)))) == {"a": 2, "b": 1}


def words_of(df):
    return {r["word"]: r["n"] for r in df.collect()}


def test_model_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path / "more")
    feed(spark, folder, [([1.0], 2.0), ([2.0], 4.0)], "features array<double>, label double")
    sink = Sink(spark, "go-on")
    once = learning.StreamingRegression(dims=1, step=0.1, steps=3)
    once.train(table_stream(spark, folder), sink)
    again = learning.StreamingRegression(dims=1, step=0.1, steps=3)
    again.train(table_stream(spark, folder), sink)
    assert again.weights == pytest.approx(once.weights) and abs(again.weights[0]) > 0
