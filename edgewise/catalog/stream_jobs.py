"""Queries: streams over the driver tables, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewise.catalog.registry import Tables, query
from edgewise.catalog.table_jobs import EXCLUDED, _IN_EXCLUDED
from edgewise.plans.scratch import Scratch
from edgewise.streaming import clicks, learning, sessions, totals, words
from edgewise.streaming.run import Sink, table_stream

#: Queries by micro-batch get their input in this many arrivals, a restart before each.
ARRIVALS = 2
_BATCH_WORDS_SQL = """select batch, word, count(*) as n from (
    select cast(doc_id % 2 as integer) as batch, unnest(string_split(text, ' ')) as word from documents) group by batch, word"""
_WORDS_SQL = "select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) group by word"


def _lines(t: Tables):
    return table_stream(t.spark, t.path("documents")).selectExpr("text as value")


def _events(t: Tables):
    """Events with a time that a watermark accepts."""
    return table_stream(t.spark, t.path("events")).withColumn("at", F.col("ts").cast("timestamp"))


def _views(t: Tables):
    return _events(t).selectExpr(
        "event_type as url",
        "if(event_type = 'error', 500, 200) as status",
        "int(user_id % 20) as zip_code",
        "user_id",
        "at",
    )


def _arriving(t: Tables, rows, number: str, job):
    """Run `job` on the rows of each arrival in turn; `rows.<number>` tells which one a row comes with.

    The stream is stopped after each arrival and started again from its checkpoint, so an
    arrival is a micro-batch.
    """
    folder = Scratch(t.spark, "arrivals").path()
    out = None
    for i in range(ARRIVALS):
        rows.where(F.expr(number) == i).write.mode("append").parquet(folder)
        out = job(table_stream(t.spark, folder))
    return out


def _arriving_lines(t: Tables, job):
    return _arriving(t, t.documents.selectExpr("text as value", "doc_id"), f"doc_id % {ARRIVALS}", lambda rows: job(rows.select("value")))


def _timed(t: Tables):
    return t.events.withColumn("at", F.col("ts").cast("timestamp"))


def _text_times(df, *columns):
    """Times as text, the same in every engine and time zone setting."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


def windows_sql(keys: str, select: str, size: int, slide: int, delay: int, closed: bool = True) -> str:
    """Sliding windows (hours) that end at or before the watermark; all with `closed=False`."""
    return f"""
with v as (select ts, event_type, event_type as url, case when event_type = 'error' then 500 else 200 end as status,
                  user_id % 20 as zip_code, user_id from events),
w as (select *, unnest(generate_series(0, {size // slide - 1})) as i from v),
s as (select *, to_timestamp((floor(epoch(ts) / {slide * 3600}) - i) * {slide * 3600}) at time zone 'UTC' as s from w),
m as (select max(ts) - interval {delay} hour as mark from events)
select strftime(s, '%Y-%m-%d %H:%M:%S') as start, strftime(s + interval {size} hour, '%Y-%m-%d %H:%M:%S') as end{',' if keys else ''} {keys}, {select}
from s where {'s + interval ' + str(size) + ' hour <= (select mark from m)' if closed else 'true'} group by s {',' if keys else ''} {keys}"""


@query("stream_wordcount", _WORDS_SQL)
def stream_wordcount(t: Tables):
    return Sink(t.spark, "wordcount").latest(words.running_counts(_lines(t)))


@query("stream_windows", windows_sql("event_type", "count(*) as n", 2, 1, 1))
def stream_windows(t: Tables):
    counted = words.windowed_counts(_events(t), "at", "event_type", "2 hours", "1 hour", "1 hour")
    return _text_times(Sink(t.spark, "windows").append(counted), "start", "end")


@query("stream_windows_all", windows_sql("event_type", "count(*) as n", 2, 1, 1, closed=False))
def stream_windows_all(t: Tables):
    """Complete mode: the windows that are still open are told as well."""
    counted = words.windowed_counts(_events(t), "at", "event_type", "2 hours", "1 hour", "1 hour")
    return _text_times(Sink(t.spark, "windows-all").latest(counted), "start", "end")


@query("click_sliding_all", windows_sql("url", "count(*) as n", 10, 2, 1, closed=False))
def click_sliding_all(t: Tables):
    counted = clicks.sliding_page_counts(_views(t), "10 hours", "2 hours", "1 hour")
    return _text_times(Sink(t.spark, "sliding-all").latest(counted), "start", "end")


@query(
    "stream_sessions_all",
    """with e as (select user_id, date_trunc('second', ts) as tm from events),
       b as (select *, case when lag(tm) over w + interval 6 hour > tm then 0 else 1 end as opens
             from e window w as (partition by user_id order by tm)),
       s as (select *, sum(opens) over (partition by user_id order by tm rows unbounded preceding) as session from b)
       select user_id, strftime(min(tm), '%Y-%m-%d %H:%M:%S') as start,
              strftime(max(tm) + interval 6 hour, '%Y-%m-%d %H:%M:%S') as end,
              cast(epoch(max(tm)) - epoch(min(tm)) as bigint) + 21600 as seconds, count(*) as n
       from s group by user_id, session""",
)
def stream_sessions_all(t: Tables):
    """Complete mode: sessions that may still grow are told as well."""
    rows = _events(t).withColumn("at", F.date_trunc("second", "at"))
    found = sessions.window_sessions(rows, "at", "user_id", "6 hours", "1 hour")
    return _text_times(Sink(t.spark, "sessions-all").latest(found), "start", "end")


@query(
    "stream_sessions",
    """with e as (select user_id, date_trunc('second', ts) as tm from events),
       b as (select *, case when lag(tm) over w + interval 6 hour > tm then 0 else 1 end as opens
             from e window w as (partition by user_id order by tm)),
       s as (select *, sum(opens) over (partition by user_id order by tm rows unbounded preceding) as session from b)
       select user_id, strftime(min(tm), '%Y-%m-%d %H:%M:%S') as start,
              strftime(max(tm) + interval 6 hour, '%Y-%m-%d %H:%M:%S') as end,
              cast(epoch(max(tm)) - epoch(min(tm)) as bigint) + 21600 as seconds, count(*) as n
       from s group by user_id, session
       having max(tm) + interval 6 hour <= (select max(tm) - interval 1 hour from e)""",
)
def stream_sessions(t: Tables):
    rows = _events(t).withColumn("at", F.date_trunc("second", "at"))
    found = sessions.window_sessions(rows, "at", "user_id", "6 hours", "1 hour")
    return _text_times(Sink(t.spark, "sessions").append(found), "start", "end")


@query(
    "stream_state_sessions",
    """select cast(user_id as varchar) as key, count(*) as n, cast(floor(epoch_us(min(ts)) / 1000) as bigint) as start,
              cast(floor(epoch_us(max(ts)) / 1000) as bigint) as end, true as expired from events group by user_id""",
)
def stream_state_sessions(t: Tables):
    """Every row is a session that its timer has closed; the sessions of a user are put together.

    Where the clock cuts a user's events into sessions is not the data's doing, their sum is.
    """
    sink = Sink(t.spark, "idle")

    def job(rows):
        # the first arrival is left open: the timers of the restarted stream close all
        sessions_ = sessions.idle_sessions(rows, "at", "user_id", 3_000)
        return sink.until_idle(sessions_, lambda part, batch: part)

    told = _arriving(t, _timed(t).select("user_id", "at", "event_id"), f"event_id % {ARRIVALS}", job)
    return told.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.every("expired").alias("expired")
    )


_GAP = 6 * 3600 * 1000


@query(
    "complex_sessions",
    f"""with e as (select cast(user_id as varchar) as user_id, cast(floor(epoch_us(ts) / 1000) as bigint) as tm,
                          event_type = 'purchase' as closing from events),
        b as (select *, case when lag(closing) over w or coalesce(lag(tm) over w + {_GAP} <= tm, true) then 1 else 0 end as opens
              from e window w as (partition by user_id order by tm, closing)),
        s as (select *, sum(opens) over (partition by user_id order by tm, closing rows unbounded preceding) as session from b)
        select user_id, min(tm) as start_ms, max(tm) + case when bool_or(closing) then 0 else {_GAP} end - min(tm) as duration_ms,
               count(*) as n_events from s group by user_id, session
        having max(tm) + case when bool_or(closing) then 0 else {_GAP} end < (select max(tm) - 3600000 from e)""",
)
def complex_sessions(t: Tables):
    """Purchases close a session."""
    lines = _events(t).select(
        F.to_json(
            F.struct(
                F.col("user_id").cast("string").alias("user_id"),
                F.when(F.col("event_type") == "purchase", sessions.CLOSE)
                .otherwise("NEW_EVENT")
                .alias("event_type"),
                F.col("at").alias("timestamp"),
            )
        ).alias("value")
    )
    events = sessions.parse_events(lines, "1 hour")
    return Sink(t.spark, "closing").append(sessions.closing_sessions(events, _GAP))


@query(
    "batch_sessions",
    f"""with e as (select user_id, cast(floor(epoch_us(ts) / 1000) as bigint) as tm, event_type = 'purchase' as closing from events),
        b as (select *, case when lag(closing) over w or coalesce(lag(tm) over w + {_GAP} <= tm, true) then 1 else 0 end as opens
              from e window w as (partition by user_id order by tm, closing)),
        s as (select *, sum(opens) over (partition by user_id order by tm, closing rows unbounded preceding) as session from b)
        select user_id, min(tm) as start_ms, max(tm) + case when bool_or(closing) then 0 else {_GAP} end - min(tm) as duration_ms,
               count(*) as n_events from s group by user_id, session""",
)
def batch_sessions(t: Tables):
    return sessions.batch_sessions(
        t.events,
        "user_id",
        F.unix_millis(F.col("ts").cast("timestamp")),
        F.col("event_type") == "purchase",
        _GAP,
    )


@query(
    "stream_totals",
    """select event_type as word, count(*) + case when event_type in ('view', 'click') then 1 else 0 end as total
       from events group by event_type""",
)
def stream_totals(t: Tables):
    start = t.spark.createDataFrame([("view", 1), ("click", 1)], "word string, n bigint")
    sink = Sink(t.spark, "totals")

    def job(rows):
        return sink.batches(totals.running_totals(rows.selectExpr("event_type as word"), start), lambda part, batch: part, "update")

    # a word comes back in every batch that has it; its last total is the answer
    told = _arriving(t, t.events.select("event_type", "event_id"), f"event_id % {ARRIVALS}", job)
    return told.groupBy("word").agg(F.max_by("total", "batch").alias("total"))


@query("stream_batch_counts", _BATCH_WORDS_SQL)
def stream_batch_counts(t: Tables):
    sink = Sink(t.spark, "batches")
    return _arriving_lines(t, lambda lines: words.batch_counts(lines, sink))


@query("stream_sql", _BATCH_WORDS_SQL)
def stream_sql(t: Tables):
    sink = Sink(t.spark, "sql")
    return _arriving_lines(t, lambda lines: words.sql_counts(lines, sink))


@query(
    "stream_sentiment",
    """with s as (select word, count(*) as score from (select unnest(string_split(text, ' ')) as word from benchmark)
                  where regexp_full_match(word, '[a-z]+') group by word),
       w as (select batch, word, count(*) as n from (
               select cast(doc_id % 2 as integer) as batch, unnest(string_split(text, ' ')) as word from documents) group by batch, word),
       r as (select batch, word, score * n as weight, row_number() over (partition by batch order by score * n desc, word) as r
             from s join w using (word))
       select batch, word, weight from r where r <= 5""",
)
def stream_sentiment(t: Tables):
    """Word scores from a tab-separated file, here the counts in `benchmark`."""
    path = Scratch(t.spark, "scores").path()
    counted = t.benchmark.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").count()
    counted.where("word rlike '^[a-z]+$'").write.csv(path, sep="\t")
    scores = words.read_scores(t.spark, path)
    sink = Sink(t.spark, "sentiment")
    return _arriving_lines(t, lambda lines: words.top_scored(lines, scores, sink))


@query(
    "stream_recover",
    f"""select count(*) filter (where word not in ({_IN_EXCLUDED})) as n_kept,
               count(*) filter (where word in ({_IN_EXCLUDED})) as n_dropped
        from (select unnest(string_split(text, ' ')) as word from documents)""",
)
def stream_recover(t: Tables):
    """Stopped after the first files, started again when more have arrived."""
    folder = Scratch(t.spark, "arrivals").path()
    sink = Sink(t.spark, "recover")
    listed = t.spark.createDataFrame([(w,) for w in EXCLUDED], "word string")
    arrivals = t.documents.selectExpr("text as value", "doc_id")
    out = None
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 != 0):
        arrivals.where(part).select("value").write.mode("append").parquet(folder)
        out = words.filtered_counts(table_stream(t.spark, folder), listed, sink)
    return out.agg(F.sum("n_kept").alias("n_kept"), F.sum("n_dropped").alias("n_dropped"))


@query(
    "stream_mod",
    "select cast(user_id % 2 as integer) as batch, event_id % 10 as remainder, count(*) as n from events group by all",
)
def stream_mod(t: Tables):
    sink = Sink(t.spark, "mod")
    rows = t.events.select("event_id", "user_id")
    return _arriving(t, rows, f"user_id % {ARRIVALS}", lambda part: words.remainder_counts(part, "event_id", 10, sink))


@query(
    "stream_grep",
    """select count(*) as n from (select text from documents union all select text from conversations)
       where contains(text, 'the')""",
)
def stream_grep(t: Tables):
    streams = [
        table_stream(t.spark, t.path(name)).selectExpr("text as value")
        for name in ("documents", "conversations")
    ]
    return words.matching_lines(streams, "the", Sink(t.spark, "grep")).agg(F.sum("n").alias("n"))


@query(
    "click_pages",
    "select cast(event_id % 2 as integer) as batch, event_type as url, count(*) as n from events group by all",
)
def click_pages(t: Tables):
    sink = Sink(t.spark, "pages")
    rows = t.events.selectExpr("event_type as url", "event_id")
    return _arriving(t, rows, f"event_id % {ARRIVALS}", lambda part: sink.batches(part, lambda x, batch: clicks.page_counts(x)))


@query("click_sliding", windows_sql("url", "count(*) as n", 10, 2, 1))
def click_sliding(t: Tables):
    counted = clicks.sliding_page_counts(_views(t), "10 hours", "2 hours", "1 hour")
    return _text_times(Sink(t.spark, "sliding").append(counted), "start", "end")


def _rates_sql(closed: bool) -> str:
    select = """avg(case when status = 200 then 0.0 else 1.0 end) as rate,
           avg(case when status = 200 then 0.0 else 1.0 end) > 0.05 as flagged"""
    return windows_sql("zip_code", select, 30, 2, 1, closed).replace("user_id % 20 as zip_code", "cast(user_id % 20 as integer) as zip_code")


@query("click_error_rate", _rates_sql(closed=True))
def click_error_rate(t: Tables):
    rated = clicks.error_rates(_views(t), "30 hours", "2 hours", "1 hour")
    return _text_times(Sink(t.spark, "errors").append(rated), "start", "end")


@query("click_error_rate_all", _rates_sql(closed=False))
def click_error_rate_all(t: Tables):
    """Complete mode: the windows that are still open are told as well."""
    rated = clicks.error_rates(_views(t), "30 hours", "2 hours", "1 hour")
    return _text_times(Sink(t.spark, "errors-all").latest(rated), "start", "end")


@query("click_active", windows_sql("", "count(distinct user_id) as n_users", 16, 2, 1))
def click_active(t: Tables):
    active = clicks.active_users(_views(t), "16 hours", "2 hours", "1 hour")
    return _text_times(Sink(t.spark, "active").append(active), "start", "end")


@query("click_active_all", windows_sql("", "count(distinct user_id) as n_users", 16, 2, 1, closed=False))
def click_active_all(t: Tables):
    sink = Sink(t.spark, "active-all")
    return _text_times(clicks.active_users_now(_views(t), "16 hours", "2 hours", "1 hour", sink), "start", "end")


@query(
    "click_users",
    """with u as (select distinct cast(event_id % 2 as integer) as batch, user_id, c_name as name from events join customer on c_custkey = user_id)
       select * from u qualify row_number() over (partition by batch order by user_id) <= 10""",
)
def click_users(t: Tables):
    """The first ten users of each batch, with their names."""
    names = t.customer.selectExpr("c_custkey as user_id", "c_name as name")
    sink = Sink(t.spark, "users")
    rows = t.events.select("user_id", "event_id")
    return _arriving(t, rows, f"event_id % {ARRIVALS}", lambda part: sink.batches(part, lambda x, batch: clicks.named_users(x, names)))


@query("stream_kmeans")
def stream_kmeans(t: Tables):
    points = table_stream(t.spark, t.path("embeddings")).selectExpr(
        "vec_id", "transform(embedding, x -> double(x)) as features"
    )
    model = learning.StreamingKMeans(k=4, dims=64, decay=1.0, seed=42)
    model.train(points, Sink(t.spark, "kmeans"))
    rows = t.embeddings.selectExpr("vec_id", "transform(embedding, x -> double(x)) as features")
    return model.predict(rows).select("vec_id", "cluster")


def _linreg_sql(steps: int, step: float) -> str:
    """Gradient steps one after the other."""
    columns = ["1.0::double", "l_quantity / 50", "l_discount * 10"]
    guess = " + ".join(f"w{i} * x{i}" for i in range(3))
    parts = [f"p as materialized (select {', '.join(f'{c} as x{i}' for i, c in enumerate(columns))}, l_extendedprice / 100000 as y from lineitem)"]
    parts.append("m0 as (select 0.0::double as w0, 0.0::double as w1, 0.0::double as w2)")
    for n in range(1, steps + 1):
        moved = ", ".join(f"any_value(w{i}) - {step} / sqrt({n}) * avg(({guess} - y) * x{i}) as w{i}" for i in range(3))
        parts.append(f"m{n} as materialized (select {moved} from p, m{n - 1})")
    return f"with {', '.join(parts)} " + " union all ".join(f"select {i}::integer as feature, round(w{i}, 6) as weight from m{steps}" for i in range(3))


@query("stream_linreg", _linreg_sql(10, 0.5))
def stream_linreg(t: Tables):
    rows = table_stream(t.spark, t.path("lineitem")).selectExpr(
        "array(1.0D, l_quantity / 50, l_discount * 10) as features", "l_extendedprice / 100000 as label"
    )
    model = learning.StreamingRegression(dims=3, step=0.5, steps=10)
    # one file is one batch
    return model.train(rows, Sink(t.spark, "linreg")).select("feature", F.round("weight", 6).alias("weight"))


@query(
    "stream_abtest",
    """with g as (select l_linestatus = 'O' as grp, count(*) as n, avg(l_quantity) as mean, var_samp(l_quantity) / count(*) as s
                  from lineitem group by 1),
       w as (select max(n) filter (not grp) as n_a, max(n) filter (grp) as n_b, max(mean) filter (not grp) as mean_a,
                    max(mean) filter (grp) as mean_b, max(s) filter (not grp) as s_a, max(s) filter (grp) as s_b from g),
       v as (select n_a, n_b, (mean_a - mean_b) / sqrt(s_a + s_b) as t,
                    pow(s_a + s_b, 2) / (s_a * s_a / (n_a - 1) + s_b * s_b / (n_b - 1)) as df from w),
       x as (select *, i, atan(abs(t) / sqrt(df)) as low, (pi() / 2 - atan(abs(t) / sqrt(df))) / 20000 as h
             from v, range(0, 20001) r(i)),
       y as (select *, exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(pi()) + (df - 1) * ln(greatest(cos(low + i * h), 1e-300)))
                       * case when i in (0, 20000) then 1 when i % 2 = 1 then 4 else 2 end as part from x)
       select n_a, n_b, round(any_value(t), 6) as t, round(any_value(df), 3) as df, round(2 * any_value(h) / 3 * sum(part), 6) as p,
              2 * any_value(h) / 3 * sum(part) < 0.05 as differs from y group by n_a, n_b""",
)
def stream_abtest(t: Tables):
    rows = table_stream(t.spark, t.path("lineitem")).selectExpr("l_linestatus = 'O' as grp", "l_quantity")
    return learning.ab_test(rows, "grp", "l_quantity", Sink(t.spark, "abtest")).select(
        "n_a", "n_b", F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("p", 6).alias("p"), "differs"
    )
