"""Queries: text and table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgewise.catalog.registry import Tables, query
from edgewise.functions import aggregators
from edgewise.operators import text
from edgewise.plans.scratch import Scratch
from edgewise.plans.skew import salted_agg


@query(
    "wordcount",
    "select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) group by word",
)
def wordcount(t: Tables):
    return text.word_count(t.documents, "text")


@query(
    "sort_tokens",
    r"""select cast(cast(word as decimal(38,0)) as varchar) as number
        from (select unnest(regexp_split_to_array(text, '\s+')) as word from documents)
        where regexp_full_match(word, '[+-]?[0-9]+') and length(ltrim(ltrim(word, '+-'), '0')) <= 38 order by cast(word as decimal(38,0))""",
)
def sort_tokens(t: Tables):
    return text.sorted_integers(t.documents, "text").select(F.col("number").cast("string").alias("number"))


def access_lines(t: Tables):
    """One access-log line per event: errors have no user, sign-ups are not log lines."""
    return t.events.selectExpr(
        """if(event_type = 'signup', 'signup ' || event_id,
           '10.0.0.' || (user_id % 250) || ' - ' ||
           if(event_type = 'error', '"-"', '"u' || user_id || '"') ||
           ' [05/Mar/2024:08:30:00 +0000] "GET /' || event_type || ' HTTP/1.1" 200 ' ||
           get_json_object(props, '$.k') || ' "ref" "agent"') as value"""
    )


@query(
    "log_stats",
    """select case when named then '10.0.0.' || (user_id % 250) end as ip,
              case when named then '"u' || user_id || '"' end as user,
              case when named then 'GET /' || event_type || ' HTTP/1.1' end as query,
              cast(sum(case when event_type = 'signup' then 0
                            else cast(props->>'$.k' as bigint) end) as bigint) as bytes,
              count(*) as n
       from (select *, event_type not in ('signup', 'error') as named from events) group by 1, 2, 3""",
)
def log_stats(t: Tables):
    return text.log_stats(access_lines(t))


@query("project", "select c_name as name, c_acctbal + 1 as balance_plus from customer")
def project(t: Tables):
    return t.customer.select(
        F.col("c_name").alias("name"), (F.col("c_acctbal") + 1).alias("balance_plus")
    )


@query(
    "filter_between",
    "select p_partkey, p_name from part where p_size between 13 and 19 and p_retailprice > 950",
)
def filter_between(t: Tables):
    wanted = F.col("p_size").between(13, 19) & (F.col("p_retailprice") > 950)
    return t.part.where(wanted).select("p_partkey", "p_name")


@query(
    "group_count",
    """select coalesce(cast(quality as varchar), 'none') as quality, count(*) as n
       from documents left join labels using (doc_id) group by 1""",
)
def group_count(t: Tables):
    """Documents per quality; those without a label form the null group."""
    return (
        t.documents.select("doc_id")
        .join(t.labels.select("doc_id", "quality"), "doc_id", "left")
        .groupBy("quality")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("quality"), "n")
    )


@query(
    "daily_avg",
    """select strftime(ts, '%Y-%m-%d') as day,
              cast(sum(cast(value as decimal(18,2))) as double) / count(*) as mean_value,
              cast(sum(cast(props->>'$.k' as bigint)) as double) / count(*) as mean_k
       from events group by 1""",
)
def daily_avg(t: Tables):
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.expr("double(sum(cast(value as decimal(18,2)))) / count(1)").alias("mean_value"),
        F.avg(F.get_json_object("props", "$.k").cast("bigint")).alias("mean_k"),
    )


@query("count_all", "select count(*) as n from lineitem")
def count_all(t: Tables):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_inner",
    "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey",
)
def join_inner(t: Tables):
    return t.spark.sql(
        "select o_orderkey, c_name, o_totalprice from {o} o join {c} c on o.o_custkey = c.c_custkey",
        o=t.orders,
        c=t.customer,
    )


@query(
    "filter_order", "select p_partkey, p_size, p_name from part where p_size < 10 order by p_size, p_partkey"
)
def filter_order(t: Tables):
    return t.spark.sql(
        "select p_partkey, p_size, p_name from {p} where p_size < 10 order by p_size, p_partkey",
        p=t.part,
    )


@query(
    "views",
    """select c_mktsegment as segment, count(*) as n_here,
              cast(count(*) as bigint) as n_there from customer group by c_mktsegment""",
)
def views(t: Tables):
    """A session view in its own session, a global view from a second one."""
    t.customer.createOrReplaceTempView("edgewise_customer")
    t.customer.createOrReplaceGlobalTempView("edgewise_customer_shared")
    here = t.spark.sql("select c_mktsegment as segment, count(*) as n_here from edgewise_customer group by 1")
    there = t.spark.newSession().sql(
        "select c_mktsegment as segment, count(*) as n_there from global_temp.edgewise_customer_shared group by 1"
    )
    copy = Scratch(t.spark, "views").write(there).df
    return here.join(copy, "segment")


@query("schema_apply", "select s_suppkey as id, s_name as name, s_acctbal as balance from supplier")
def schema_apply(t: Tables):
    """Text lines, and a schema that is put together at run time."""
    lines = t.supplier.selectExpr("concat_ws('|', s_suppkey, s_name, s_acctbal) as value")
    fields = [("id", T.LongType()), ("name", T.StringType()), ("balance", T.DoubleType())]
    schema = T.StructType([T.StructField(name, kind, True) for name, kind in fields])
    parts = F.split("value", r"\|")
    return lines.select(
        *[F.get(parts, i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    )


@query(
    "agg_typed",
    """select event_type, count(k) as n, cast(sum(k) as bigint) as total,
              avg(k) as mean, min(k) as low, max(k) as high, avg(k) as custom_mean
       from (select event_type, cast(props->>'$.k' as bigint) as k from events) group by event_type""",
)
def agg_typed(t: Tables):
    rows = t.events.select(
        "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    custom = aggregators.average()(rows, ["event_type"], "k", "custom_mean")
    return aggregators.typed(rows, ["event_type"], "k").join(custom, "event_type")


@query(
    "sum_lengths",
    """select count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars
       from (select unnest(string_split(text, chr(10))) as line from documents)""",
)
def sum_lengths(t: Tables):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("value"))
    return text.line_lengths(lines)


@query(
    "write_verify",
    r"""select n as n_before, n as n_after, true as equal from (
          select count(*) as n from (
            select unnest(regexp_split_to_array(text, '[ \t]')) as word from documents) where word <> '')""",
)
def write_verify(t: Tables):
    """Words counted before writing and after reading back."""
    found = text.words(t.documents, "text", "[ \t]").where("word <> ''")
    before = found.agg(F.count(F.lit(1)).alias("n_before")).withColumn("_one", F.lit(1))
    after = (
        Scratch(t.spark, "verify")
        .write(found)
        .df.agg(F.count(F.lit(1)).alias("n_after"))
        .withColumn("_one", F.lit(1))
    )
    return before.join(after, "_one").selectExpr("n_before", "n_after", "n_before = n_after as equal")


@query(
    "skewed_group",
    """select l_returnflag as flag, count(*) as n, sum(cast(l_quantity as bigint))::bigint as quantity,
              count(distinct l_partkey) as n_parts from lineitem group by 1""",
)
def skewed_group(t: Tables):
    """Three hot keys: rows are summed by salt first, distinct parts by hashing key and part."""
    sums = salted_agg(
        t.lineitem,
        [F.col("l_returnflag").alias("flag")],
        ["l_orderkey", "l_linenumber"],
        [F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q")],
        [F.sum("n").alias("n"), F.sum("q").alias("quantity")],
        final_keys=["flag"],
    )
    parts = (
        t.lineitem.select(F.col("l_returnflag").alias("flag"), "l_partkey")
        .distinct()
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("n_parts"))
    )
    return sums.join(parts, "flag")


# a few frequent words, as a user would list them
EXCLUDED = ["the", "of", "and", "in", "la", "de"]
_IN_EXCLUDED = ", ".join(f"'{w}'" for w in EXCLUDED)


@query(
    "exclude_list",
    f"""select count(*) filter (where word not in ({_IN_EXCLUDED})) as n_kept,
               count(*) filter (where word in ({_IN_EXCLUDED})) as n_dropped
        from (select unnest(string_split(text, ' ')) as word from documents)""",
)
def exclude_list(t: Tables):
    listed = t.spark.createDataFrame([(w,) for w in EXCLUDED], "word string")
    return text.exclude(text.words(t.documents, "text"), listed)[1]
