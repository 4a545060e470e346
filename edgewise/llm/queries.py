"""Named queries of this package, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise import session
from edgewise.llm import (
    centroids,
    decontaminate,
    divergence,
    grammar,
    imatch,
    pieces,
    quality,
    records,
    sharding,
    simhash,
    substrings,
    toxicity,
    wrapper,
)
from edgewise.llm.base import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARD_BYTES = 1 << 20


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(session.tune(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_records")
def token_records(spark, folder):
    return records.token_records(table(spark, folder, "documents"), VOCABULARY, end_id=2)


@query(
    "op2_decontaminate",
    """
    with d as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    b as (
      select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
    sizes as (select distinct least(13, len(w)) as n from b where len(w) > 0),
    iw as (
      select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as words
      from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
            from b where len(w) > 0)),
    dw as (
      select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as words
      from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as i from d, sizes)),
    hits as (select doc_id, i, dw.n, item_id from dw join iw on dw.n = iw.n and dw.words = iw.words),
    hit as (
      select doc_id, count(distinct p) as n_hit
      from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
    items as (
      select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
      from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join hit using (doc_id) left join items using (doc_id)
    """,
)
def decontaminated(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("tie", "items")


@query("op3_toxicity")
def toxic_documents(spark, folder):
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


@query("op4_main_text")
def page_text(spark, folder):
    return wrapper.main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_imatch")
def imatch_fingerprints(spark, folder):
    return imatch.fingerprints(table(spark, folder, "documents"))


@query("op6_simhash")
def simhash_groups(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op7_secrets")
def secrets(spark, folder):
    found = grammar.scan(table(spark, folder, "documents"))
    digest = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


@query(
    "op8_repeated_passages",
    """
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    win as (
      select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) as i from d)),
    rep as (select h from win group by h having count(*) > 1),
    gone as (select distinct doc_id, p from (
      select doc_id, unnest(range(i, i + 35)) as p from win where h in (select h from rep))),
    words as (select doc_id, w[i] as word, i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
    kept as (
      select doc_id, count(*) as n, string_agg(word, ' ' order by i) as kept
      from words where (doc_id, i) not in (select (doc_id, p) from gone) group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
      sha256(coalesce(kept, '')) as kept_sha256
    from d left join kept on kept.doc_id = d.doc_id
    """,
)
def repeated_passages(spark, folder):
    kept = substrings.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op9_sentencepiece")
def sentencepiece(spark, folder):
    """Ids of every text, and whether decoding them gives the text back."""
    coded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), PIECES)
    back = pieces.decode(coded, PIECES)
    return back.select("doc_id", "n_ids", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("exact"))


@query(
    "op10_shards",
    f"""
    with r as (
      select doc_id, cast(coalesce(strlen(text), 0) + 8 as bigint) as bytes,
        cast(('0x' || md5(cast(doc_id as varchar))[1:15]) as bigint) as h from documents),
    levels as (select doc_id, h, bytes, unnest(range(0, 61)) as depth from r),
    sums as (
      select depth, h >> (60 - depth) as prefix, sum(bytes) as total, count(*) as n from levels group by all),
    fits as (select * from sums where total <= {SHARD_BYTES} or n = 1),
    leaf as (
      select l.doc_id, l.h, l.bytes, min(l.depth) as depth from levels l
      join fits f on f.depth = l.depth and f.prefix = l.h >> (60 - l.depth) group by all)
    select doc_id, bytes, cast(leaf.depth as integer) as depth,
      case when leaf.depth = 0 then '' else
        lpad(ltrim(bin(h >> (60 - leaf.depth)), '0'), cast(leaf.depth as integer), '0') end as shard,
      cast(f.total as bigint) as shard_bytes
    from leaf join fits f on f.depth = leaf.depth and f.prefix = h >> (60 - leaf.depth)
    """,
)
def shards(spark, folder):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return sharding.extendible_shards(table(spark, folder, "documents"), ["doc_id"], size, SHARD_BYTES)


@query("op11_quality")
def quality_scores(spark, folder):
    found = quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def _clusters_sql(k: int, rounds: int, size: int) -> str:
    """Plain rounds of assignment and floored means, one step after the other."""
    floor_div = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept as materialized (
          select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
          from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(cast(x as double)))) = {size})""",
        f"x as materialized (select r, unnest(range(1, {size + 1})) as i, unnest(v) as x from kept)",
        f"""first as (select row_number() over (order by sha256('3:' || vec_id), v) - 1 as j, v from kept
          order by sha256('3:' || vec_id), v limit {k})""",
        f"c0 as materialized (select j, unnest(range(1, {size + 1})) as i, unnest(v) as c from first)",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} as materialized (select r, arg_min(j, (d, j)) as j, min(d) as d from (
              select r, j, sum((x - c) * (x - c)) as d from x join c{t} using (i) group by r, j) group by r)"""
        )
        if t < rounds:
            steps.append(
                f"""c{t + 1} as materialized (select old.j, old.i, case when n is null then c else {floor_div} end as c
                  from c{t} old left join (
                    select j, i, sum(x) as s, count(*) as n from a{t} join x using (r) group by j, i) new using (j, i))"""
            )
    return f"""
    with {", ".join(steps)},
    names as (select j, sha256(string_agg(cast(c as varchar), ',' order by i)) as h from c{rounds} group by j),
    per as (select j, sum(d) as s from a{rounds} group by j)
    select vec_id, cast(j as integer) as cluster, cast(d as bigint) as distance, cast(s as bigint) as cluster_inertia,
      cast((select sum(d) from a{rounds}) as bigint) as inertia, h as centroid_sha256
    from a{rounds} join kept using (r) join per using (j) join names using (j)
    """


@query("op12_centroids", _clusters_sql(8, 10, 64))
def centroid_clusters(spark, folder):
    return centroids.clusters(table(spark, folder, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed=3)


@query(
    "op13_divergence",
    """
    with d as (
      select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
    t as (select r, lang, source, unnest(w) as term from d),
    kept as (select lang, term from t group by lang, term having count(distinct r) >= 3),
    g as (select distinct lang, source from d),
    counts as (select lang, source, term, count(*) as c from t semi join kept using (lang, term) group by all),
    size as (
      select g.lang, g.source, coalesce(n, 0) as n, coalesce(v, 0) as v from g
      left join (select lang, source, sum(c) as n from counts group by all) using (lang, source)
      left join (select lang, count(*) as v from kept group by all) using (lang)),
    p as (
      select lang, source, term, coalesce(c, 0) as c,
        cast(1 + (1000000000::hugeint * (coalesce(c, 0) + 1)) // (n + v) as hugeint) as p
      from size join kept using (lang) left join counts using (lang, source, term)),
    q as (
      select lang, term, cast(1 + (1000000000::hugeint * (c + 1)) // (n + v) as hugeint) as q
      from (select lang, term, sum(c) as c from counts group by all)
      join (select lang, sum(n) as n, max(v) as v from size group by all) using (lang)),
    sums as (
      select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pairs as (
      select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source
      left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
    terms as (
      select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value
      from p join q using (lang, term) where c > 0 and p > q),
    ranked as (
      select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
      from (select * from pairs union all select * from terms))
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
    from ranked where part = 'pair' or rank <= 200
    """,
)
def source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))
