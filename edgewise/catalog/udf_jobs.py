"""Queries: user-defined scalar, aggregate and table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgewise.catalog.registry import Tables, query
from edgewise.functions import grouped, scalar, tablefunctions as tf
from edgewise.plans import skew


@query("pudf_scalar", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as revenue from lineitem")
def pudf_scalar(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", scalar.line_revenue("l_extendedprice", "l_discount").alias("revenue")
    )


@query("pudf_struct", "select c_custkey, c_acctbal / 2 as half, upper(c_name) as label from customer")
def pudf_struct(t: Tables):
    return t.customer.select(
        "c_custkey", scalar.describe("c_acctbal", "c_name").alias("d")
    ).select("c_custkey", "d.half", "d.label")


@query(
    "pudf_iter",
    """with d as (select o_orderkey, o_custkey, unnest(range(0, length(o_custkey::varchar))) as i, reverse(o_custkey::varchar) as s from orders),
       v as (select o_orderkey, case when i % 2 = 0 then 2 * s[i + 1]::bigint else s[i + 1]::bigint end as x from d)
       select o_orderkey, (10 - sum(x // 10 + x % 10)::bigint % 10) % 10 as digit, any_value(o_orderkey + o_custkey) as both
       from v join orders using (o_orderkey) group by o_orderkey""",
)
def pudf_iter(t: Tables):
    return t.orders.select(
        "o_orderkey",
        scalar.check_digit("o_custkey").alias("digit"),
        scalar.add_columns("o_orderkey", "o_custkey").alias("both"),
    )


@query(
    "pudf_agg",
    """select event_type, count(*) as n, avg(k) as mean, max(abs(k - m)) as farthest
       from (select event_type, k, avg(k) over (partition by event_type) as m
             from (select event_type, cast(props->>'$.k' as double) as k from events)) group by event_type""",
)
def pudf_agg(t: Tables):
    """Mean per group by a pandas aggregate, then every row against its group's mean."""
    rows = t.events.select(
        "event_id", "event_type", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    means = grouped.blocked_mean(rows, "event_type", "k", ["event_id"])
    apart = grouped.over_group(rows, means, "event_type")
    far = apart.groupBy("event_type").agg(F.max(F.abs(F.col("k") - F.col("mean"))).alias("farthest"))
    return means.join(far, "event_type")


@query(
    "pudf_window",
    """select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey), 4) as total,
              round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey
                rows between 2 preceding and current row), 4) as recent from orders""",
)
def pudf_window(t: Tables):
    """All orders of a customer, and the last three.

    The pandas aggregate gets a customer's orders, in blocks of bounded size if they are many; sums
    of blocks are added up and joined back. The last three are looked up by built-in functions, which spill.
    """
    blocks = grouped.total_blocks(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"])
    sizes = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    totals = blocks.groupBy("o_custkey").agg(F.sum("part").alias("total")).join(sizes, "o_custkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = [F.coalesce(F.lag("o_totalprice", i).over(order), F.lit(0.0)) for i in (1, 2)]
    rows = t.orders.select("o_custkey", "o_orderkey", (F.col("o_totalprice") + before[0] + before[1]).alias("recent"))
    found = skew.join_counted(rows, totals, ["o_custkey"], "n", t.orders.count())
    return found.select("o_orderkey", F.round("total", 4).alias("total"), F.round("recent", 4).alias("recent"))


@query(
    "grouped_map",
    """select l_orderkey, l_linenumber,
              round(l_quantity - avg(l_quantity) over (partition by l_orderkey), 6) as quantity
       from lineitem""",
)
def grouped_map(t: Tables):
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_quantity as quantity")
    out = grouped.demean(rows, "l_orderkey", "quantity", ["l_orderkey", "l_linenumber"])
    # no negative zero
    return out.withColumn("quantity", F.round("quantity", 6) + F.lit(0.0))


@query("map_batches", "select c_custkey, c_name, c_acctbal from customer where c_acctbal > 5000")
def map_batches(t: Tables):
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return grouped.map_batches(rows, lambda pdf: pdf["c_acctbal"] > 5000)


@query(
    "cogrouped_map",
    """with b as (select user_id as id, epoch(date_trunc('hour', ts))::bigint // 3600 as time, event_type, value from events)
       select coalesce(l.id, r.id) as id, coalesce(l.time, r.time) as time, coalesce(v1, -1) as v1, coalesce(v2, 'none') as v2
       from (select id, time, max(value) as v1 from b where event_type in ('view', 'click') group by 1, 2) l
       full join (select id, time, max(event_type) as v2 from b where event_type not in ('view', 'click') group by 1, 2) r
       on l.id = r.id and l.time = r.time""",
)
def cogrouped_map(t: Tables):
    """Two groups of events merged by user and hour."""
    rows = t.events.selectExpr(
        "user_id as id", "bigint(floor(unix_timestamp(cast(ts as timestamp)) / 3600)) as time",
        "event_type in ('view', 'click') as seen", "event_type", "value",
    )
    left = rows.where("seen").groupBy("id", "time").agg(F.max("value").alias("v1"))
    right = rows.where("not seen").groupBy("id", "time").agg(F.max("event_type").alias("v2"))
    merged = grouped.ordered_merge(
        left, right, ["time", "id"], "id bigint, time bigint, v1 double, v2 string"
    )
    return merged.na.fill({"v1": -1.0, "v2": "none"})


@query("arrow_udf", "select c_custkey, length(c_name)::integer as n, upper(c_name) || '!' as loud from customer")
def arrow_udf(t: Tables):
    return t.customer.select(
        "c_custkey", scalar.text_length("c_name").alias("n"), scalar.shout("c_name").alias("loud")
    )


@query(
    "udf_sql",
    """with d as (select c_custkey, c_name, unnest(range(0, length(c_custkey::varchar))) as i, reverse(c_custkey::varchar) as s from customer),
       v as (select c_custkey, c_name, case when i % 2 = 0 then 2 * s[i + 1]::bigint else s[i + 1]::bigint end as x from d)
       select c_custkey, (10 - sum(x // 10 + x % 10)::bigint % 10) % 10 as digit, length(any_value(c_name))::integer as n, true as tossed
       from v where length(c_name) > 3 group by c_custkey""",
)
def udf_sql(t: Tables):
    """Registered functions in the select list and in the filter.

    `coin` is non-deterministic: it runs for every row, and only that it has given a
    value is told.
    """
    scalar.register_scalars(t.spark)
    return t.spark.sql(
        """select c_custkey, check_digit(c_custkey) as digit, text_length(c_name) as n, coin() in (true, false) as tossed
           from {c} where text_length(c_name) > 3""",
        c=t.customer,
    )


@query(
    "udaf_sql",
    "select count(*) as n, avg(cast(props->>'$.k' as double)) as mean from events",
)
def udaf_sql(t: Tables):
    """A registered aggregate called from SQL, once per block; the blocks are merged."""
    scalar.register_scalars(t.spark)
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))
    blocks = rows.withColumn("block", grouped.block(rows, ["event_id"]))
    return t.spark.sql(
        """select sum(n) as n, sum(total) / sum(n) as mean
           from (select block, series_total(k) as total, series_count(k) as n from {b} group by block)""",
        b=blocks,
    )


@query(
    "udtf_squares",
    """select p_partkey, instalment, case when instalment < p_size then cents // p_size else cents - cents // p_size * (p_size - 1) end as share
       from (select p_partkey, p_size, round(p_retailprice * 100)::bigint as cents,
               unnest(range(1, p_size + 1))::integer as instalment from part)""",
)
def udtf_instalments(t: Tables):
    """The price of a part in as many instalments as its size."""
    tf.register_table_functions(t.spark)
    return t.spark.sql(
        "select p_partkey, instalment, share from {p} p, lateral instalments(bigint(round(p.p_retailprice * 100)), p.p_size)",
        p=t.part,
    )


@query(
    "udtf_split",
    """select doc_id, row_number() over (partition by doc_id order by i)::integer as position, sentence
       from (select doc_id, i, trim(s[i], ' ' || chr(10)) as sentence
             from (select doc_id, string_split(text, '.') as s, unnest(range(1, len(string_split(text, '.')) + 1)) as i from documents))
       where sentence <> ''""",
)
def udtf_sentences(t: Tables):
    tf.register_table_functions(t.spark)
    return t.spark.sql("select doc_id, position, sentence from {d} d, lateral sentences(d.text)", d=t.documents)


@query(
    "date_expand",
    """select user_id, strftime(unnest(generate_series(first, last, interval 1 day)), '%Y-%m-%d') as day
       from (select user_id, min(ts)::date as first, max(ts)::date as last from events group by user_id)""",
)
def date_expand(t: Tables):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return tf.expand_dates(spans, "first", "last").select(
        "user_id", F.date_format("day", "yyyy-MM-dd").alias("day")
    )


@query("udtf_count", "select count(*) as n, min(value) as low, max(value) as high from events")
def udtf_count(t: Tables):
    """Extent of each partition of a table argument, then of all."""
    tf.register_table_functions(t.spark)
    rows = t.events.selectExpr("event_id", "value as amount")
    blocks = rows.withColumn("block", grouped.block(rows, ["event_id"]))
    return t.spark.sql(
        "select sum(n) as n, min(low) as low, max(high) as high from extent(table({b}) partition by block)", b=blocks
    )


@query("udtf_table", "select event_id as id, value as amount from events where value >= 5")
def udtf_table(t: Tables):
    tf.register_table_functions(t.spark)
    return t.spark.sql(
        "select id, amount from at_least(table(select event_id as id, value as amount from {e}))",
        e=t.events,
    )


@query(
    "age_fn",
    "select o_orderkey, date_sub('year', o_orderdate::date, date '2010-01-01')::integer as age from orders",
)
def age_fn(t: Tables):
    """A SQL function over built-in date expressions; the day is given, not today's."""
    scalar.register_scalars(t.spark)
    return t.spark.sql(
        "select o_orderkey, age_at(date(o_orderdate), date'2010-01-01') as age from {o}", o=t.orders
    )
