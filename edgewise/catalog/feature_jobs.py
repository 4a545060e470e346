"""Queries: feature jobs over `pyspark.ml`, similarity and statistics."""

from __future__ import annotations

import math

from pyspark.ml import feature as ml
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import ChiSquareTest, Correlation, KolmogorovSmirnovTest, Summarizer
from pyspark.sql import functions as F

from edgewise.catalog.registry import Tables, query
from edgewise.catalog.table_jobs import EXCLUDED, _IN_EXCLUDED
from edgewise.operators import factors, matrix, neighbours, products, similarity, stats
from edgewise.operators.text import ALL_TERMS
from edgewise.plans.scratch import Scratch

# tokens as a lower-cased split on single blanks gives them, without trailing empty ones
_TOKENS = r"""select doc_id, regexp_split_to_array(regexp_replace(lower(text), '\s+$', ''), '\s') as tokens from documents"""


def _tokens(t: Tables):
    return ml.Tokenizer(inputCol="text", outputCol="tokens").transform(
        t.documents.select("doc_id", "text")
    )


def _assemble(df, *columns, name="features"):
    return ml.VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def _vectors(t: Tables):
    return t.embeddings.select(
        F.col("vec_id").alias("id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
    )


def _entry(vector: str, i: int, digits: int = 6):
    return F.round(vector_to_array(vector)[i], digits)


@query(
    "tokenize",
    rf"""select doc_id, len(tokens) as n_tokens, n_words from ({_TOKENS})
         join (select doc_id, len(regexp_extract_all(lower(text), '\w+')) as n_words from documents) using (doc_id)""",
)
def tokenize(t: Tables):
    words = ml.RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W")
    return words.transform(_tokens(t)).select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size("words").cast("bigint").alias("n_words"),
    )


@query(
    "stopwords",
    f"select doc_id, len(list_filter(tokens, lambda w: w not in ({_IN_EXCLUDED}))) as n from ({_TOKENS})",
)
def stopwords(t: Tables):
    remover = ml.StopWordsRemover(inputCol="tokens", outputCol="kept", stopWords=EXCLUDED)
    return remover.transform(_tokens(t)).select("doc_id", F.size("kept").cast("bigint").alias("n"))


@query(
    "ngrams",
    f"""select gram, count(*) as n from (
          select unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) as gram
          from ({_TOKENS})) group by gram""",
)
def ngrams(t: Tables):
    grams = ml.NGram(n=2, inputCol="tokens", outputCol="grams").transform(_tokens(t))
    return (
        grams.select(F.explode("grams").alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("tfidf")
def tfidf(t: Tables):
    hashed = ml.HashingTF(inputCol="tokens", outputCol="tf", numFeatures=1 << 16).transform(
        _tokens(t)
    )
    model = ml.IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2).fit(hashed)
    total = F.aggregate(F.unwrap_udt("tfidf")["values"], F.lit(0.0), lambda s, x: s + x)
    return model.transform(hashed).select("doc_id", F.round(total, 4).alias("weight"))


@query(
    "tfidf_terms",
    f"""with w as (select doc_id, unnest(tokens) as word from ({_TOKENS})),
        v as (select word, ln(((select count(*) from documents) + 1) / (count(distinct doc_id) + 1)) as idf from w
              group by word having count(distinct doc_id) >= 2)
        select d.doc_id, round(coalesce(sum(v.idf), 0), 4) as weight from documents d
        left join w on w.doc_id = d.doc_id left join v on v.word = w.word group by d.doc_id""",
)
def tfidf_terms(t: Tables):
    """Summed weights of a document's words, over a vocabulary instead of hashes."""
    tokens = _tokens(t)
    counts = ml.CountVectorizer(inputCol="tokens", outputCol="tf", minDF=2.0, vocabSize=ALL_TERMS).fit(tokens)
    counted = counts.transform(tokens)
    weighed = ml.IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    total = F.aggregate(F.unwrap_udt("tfidf")["values"], F.lit(0.0), lambda s, x: s + x)
    return weighed.select("doc_id", F.round(total, 4).alias("weight"))


@query(
    "count_vectors",
    f"""with w as (select doc_id, unnest(list_distinct(tokens)) as word from ({_TOKENS})),
        v as (select word from w group by word having count(*) >= 2)
        select doc_id, count(v.word) as n_terms from (select doc_id from documents)
        left join w using (doc_id) left join v using (word) group by doc_id""",
)
def count_vectors(t: Tables):
    tokens = _tokens(t)
    model = ml.CountVectorizer(inputCol="tokens", outputCol="counts", minDF=2.0, vocabSize=ALL_TERMS).fit(tokens)
    # the entries of a sparse vector are its distinct terms
    return model.transform(tokens).select(
        "doc_id", F.size(F.unwrap_udt("counts")["indices"]).cast("bigint").alias("n_terms")
    )


@query("word2vec")
def word2vec(t: Tables):
    model = ml.Word2Vec(
        vectorSize=8, minCount=0, maxIter=1, numPartitions=8, seed=1, inputCol="tokens", outputCol="v"
    ).fit(_tokens(t))
    return model.transform(_tokens(t)).select("doc_id", F.size(vector_to_array("v")).alias("dims"))


@query("feature_hash", "select p_partkey, 2 as n_active from part")
def feature_hash(t: Tables):
    hasher = ml.FeatureHasher(inputCols=["p_brand", "p_retailprice"], outputCol="v")
    return hasher.transform(t.part).select(
        "p_partkey",
        F.size(F.unwrap_udt("v")["indices"]).alias("n_active"),
    )


_INDEX = """select c_mktsegment, row_number() over (order by count(*) desc, c_mktsegment) - 1 as i
            from customer group by c_mktsegment"""


@query(
    "string_index",
    f"select c_custkey, i::double as idx, c_mktsegment as back from customer join ({_INDEX}) using (c_mktsegment)",
)
def string_index(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment")
    model = ml.StringIndexer(inputCol="c_mktsegment", outputCol="idx").fit(rows)
    back = ml.IndexToString(inputCol="idx", outputCol="back", labels=model.labels)
    return back.transform(model.transform(rows)).select("c_custkey", "idx", "back")


@query(
    "one_hot",
    f"""select c_custkey, case when i = (select max(i) from ({_INDEX})) then 0 else i + 1 end as hot
        from customer join ({_INDEX}) using (c_mktsegment)""",
)
def one_hot(t: Tables):
    """Position of the one, from 1; the last category is all zeros."""
    rows = t.customer.select("c_custkey", "c_mktsegment")
    indexed = ml.StringIndexer(inputCol="c_mktsegment", outputCol="idx").fit(rows).transform(rows)
    coded = ml.OneHotEncoder(inputCol="idx", outputCol="v").fit(indexed).transform(indexed)
    return coded.select("c_custkey", F.array_position(vector_to_array("v"), 1.0).alias("hot"))


@query(
    "vector_assemble",
    """select l_orderkey, l_linenumber, l_quantity as a, l_discount as b, l_discount as sliced from lineitem""",
)
def vector_assemble(t: Tables):
    rows = _assemble(t.lineitem, "l_quantity", "l_extendedprice", "l_discount")
    hinted = ml.VectorSizeHint(inputCol="features", size=3).transform(rows)
    sliced = ml.VectorSlicer(inputCol="features", outputCol="part", indices=[2]).transform(hinted)
    indexed = ml.VectorIndexer(inputCol="part", outputCol="same", maxCategories=2).fit(sliced)
    return indexed.transform(sliced).select(
        "l_orderkey",
        "l_linenumber",
        vector_to_array("features")[0].alias("a"),
        vector_to_array("features")[2].alias("b"),
        vector_to_array("same")[0].alias("sliced"),
    )


@query(
    "bucketize",
    """select p_partkey, case when p_size > 25 then 1.0 else 0.0 end::double as big,
              case when p_size < 10 then 0.0 when p_size < 30 then 1.0 else 2.0 end::double as bucket from part""",
)
def bucketize(t: Tables):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"))
    big = ml.Binarizer(inputCol="size", outputCol="big", threshold=25.0).transform(rows)
    return (
        ml.Bucketizer(
            inputCol="size", outputCol="bucket", splits=[-float("inf"), 10, 30, float("inf")]
        )
        .transform(big)
        .select("p_partkey", "big", "bucket")
    )


@query(
    "quantile_buckets",
    """with s as (select quantile_disc(p_retailprice, 0.25) as a, quantile_disc(p_retailprice, 0.5) as b,
                         quantile_disc(p_retailprice, 0.75) as c from part)
       select p_partkey, ((p_retailprice >= a)::integer + (p_retailprice >= b)::integer + (p_retailprice >= c)::integer)::double as bucket
       from part, s""",
)
def quantile_buckets(t: Tables):
    """Four buckets of equal frequency."""
    rows = t.part.select("p_partkey", "p_retailprice")
    cut = ml.QuantileDiscretizer(numBuckets=4, inputCol="p_retailprice", outputCol="bucket", relativeError=1e-6)
    return cut.fit(rows).transform(rows).select("p_partkey", "bucket")


@query(
    "scale",
    """with s as (select avg(p_retailprice) as m, stddev_samp(p_retailprice) as d, min(p_retailprice) as lo,
                         max(p_retailprice) as hi, max(abs(p_retailprice)) as top from part)
       select p_partkey, round((p_retailprice - m) / d, 6) as standard, round((p_retailprice - lo) / (hi - lo), 6) as min_max,
              round(p_retailprice / top, 6) as max_abs,
              round(p_retailprice / sqrt(p_retailprice * p_retailprice + p_size * p_size), 6) as unit,
              round(p_retailprice / (select quantile_disc(p_retailprice, 0.75) - quantile_disc(p_retailprice, 0.25) from part), 6) as robust
       from part, s""",
)
def scale(t: Tables):
    rows = _assemble(t.part, "p_retailprice", "p_size")
    for scaler in (
        ml.StandardScaler(inputCol="features", outputCol="standard", withMean=True),
        ml.MinMaxScaler(inputCol="features", outputCol="min_max"),
        ml.MaxAbsScaler(inputCol="features", outputCol="max_abs"),
        ml.RobustScaler(inputCol="features", outputCol="robust", relativeError=1e-6),
    ):
        rows = scaler.fit(rows).transform(rows)
    rows = ml.Normalizer(inputCol="features", outputCol="unit").transform(rows)
    names = ("standard", "min_max", "max_abs", "unit", "robust")
    return rows.select("p_partkey", *[_entry(n, 0).alias(n) for n in names])


@query(
    "impute",
    """with k as (select event_id, case when event_type <> 'error' then cast(props->>'$.k' as double) end as k from events)
       select event_id, round(coalesce(k, (select avg(k) from k)), 6) as filled from k""",
)
def impute(t: Tables):
    rows = t.events.selectExpr(
        "event_id",
        "if(event_type = 'error', null, cast(get_json_object(props, '$.k') as double)) as k",
    )
    model = ml.Imputer(inputCols=["k"], outputCols=["filled"]).fit(rows)
    return model.transform(rows).select("event_id", F.round("filled", 6).alias("filled"))


@query(
    "feature_cross",
    """select l_orderkey, l_linenumber, l_quantity * l_tax as crossed, l_quantity * l_quantity as square,
              l_quantity * l_tax as product, l_tax * 2.0 as doubled,
              round((l_quantity + l_tax) / sqrt(2), 6) as dct0, round((l_quantity - l_tax) / sqrt(2), 6) as dct1 from lineitem""",
)
def feature_cross(t: Tables):
    rows = _assemble(t.lineitem, "l_quantity", "l_tax")
    rows = ml.Interaction(inputCols=["l_quantity", "l_tax"], outputCol="x").transform(rows)
    rows = ml.PolynomialExpansion(degree=2, inputCol="features", outputCol="poly").transform(rows)
    rows = ml.ElementwiseProduct(
        scalingVec=[1.0, 2.0], inputCol="features", outputCol="weighted"
    ).transform(rows)
    rows = ml.DCT(inputCol="features", outputCol="dct").transform(rows)
    # order of the expansion: x, x*x, y, x*y, y*y
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        vector_to_array("x")[0].alias("crossed"),
        vector_to_array("poly")[1].alias("square"),
        vector_to_array("poly")[3].alias("product"),
        vector_to_array("weighted")[1].alias("doubled"),
        _entry("dct", 0).alias("dct0"),
        _entry("dct", 1).alias("dct1"),
    )


@query("pca_svd")
def pca_svd(t: Tables):
    """Leading singular values, and the variance the leading components explain."""
    rows = _vectors(t)
    explained = ml.PCA(k=4, inputCol="features", outputCol="p").fit(rows).explainedVariance
    values = factors.svd(_plain_vectors(t), 4, extra=60).values  # as wide as the vectors, so exact
    out = [(i, round(float(v), 4), round(float(explained[i]), 6)) for i, v in enumerate(values)]
    return t.spark.createDataFrame(out, "component int, singular double, explained double")


@query(
    "svd_product",
    """select vec_id as id, generate_subscripts(embedding, 1)::integer - 1 as j,
              round(unnest(embedding)::double, 5) + 0.0 as value from embeddings""",
)
def svd_product(t: Tables):
    """The vectors put together again from all their factors."""
    found = factors.svd(_plain_vectors(t), 64)
    scaled = found.right.select("j", F.zip_with("v", F.array(*[F.lit(float(x)) for x in found.values]), lambda a, b: a * b).alias("v"))
    # 64 rows of 64 numbers
    pairs = found.left.join(F.broadcast(scaled))
    value = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("id", "j", (F.round(value, 5) + 0.0).alias("value"))


@query(
    "svd_orthonormal",
    """select i::integer as i, j::integer as j, case when i = j then 1.0::double else 0.0::double end as product
       from range(0, 5) a(i), range(0, 5) b(j) where exists (select 1 from embeddings)""",
)
def svd_orthonormal(t: Tables):
    """Products of the five leading left vectors with each other."""
    left = factors.svd(_plain_vectors(t), 5).left
    sums = [F.round(F.sum(F.col("u")[i] * F.col("u")[j]), 6) for i in range(5) for j in range(5)]
    cells = left.agg(F.array(*[F.abs(x) for x in sums]).alias("p")).select(F.posexplode("p").alias("at", "product"))
    return cells.selectExpr("int(at div 5) as i", "int(at % 5) as j", "product")


@query("select_features")
def select_features(t: Tables):
    rows = _vectors(t)
    best = ml.UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="s")
    best = best.setFeatureType("continuous").setLabelType("categorical")
    best = best.setSelectionMode("numTopFeatures").setSelectionThreshold(8)
    varied = ml.VarianceThresholdSelector(
        featuresCol="features", outputCol="v", varianceThreshold=0.1
    )
    flags = t.lineitem.groupBy("l_linenumber", "l_returnflag", "l_linestatus").count()
    flags = ml.StringIndexer(inputCol="l_returnflag", outputCol="label").fit(flags).transform(flags)
    chosen = [("univariate", i) for i in best.fit(rows).selectedFeatures]
    chosen += [("variance", i) for i in varied.fit(rows).selectedFeatures]
    chi = ml.ChiSqSelector(numTopFeatures=1, featuresCol="features", labelCol="label", outputCol="c")
    chosen += [("chi_square", i) for i in chi.fit(_assemble(flags, "l_linenumber", "count")).selectedFeatures]
    return t.spark.createDataFrame(chosen, "selector string, feature int")


@query(
    "select_univariate",
    """with x as (select label, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings),
       g as (select i, label, count(*) as n, avg(v) as m, var_pop(v) * count(*) as within from x group by i, label),
       t as (select i, sum(n * m) / sum(n) as mean, sum(within) as within, sum(n) as n, count(*) as k from g group by i),
       f as (select g.i, sum(g.n * pow(g.m - t.mean, 2)) / (any_value(t.k) - 1) / (any_value(t.within) / (any_value(t.n) - any_value(t.k))) as f
             from g join t using (i) group by g.i)
       select i::integer as feature from f order by f desc, i limit 8""",
)
def select_univariate(t: Tables):
    """The eight components that tell the labels apart best, by analysis of variance."""
    best = ml.UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="s")
    best = best.setFeatureType("continuous").setLabelType("categorical").setSelectionMode("numTopFeatures").setSelectionThreshold(8)
    return t.spark.createDataFrame([(int(i),) for i in best.fit(_vectors(t)).selectedFeatures], "feature int")


@query(
    "select_variance",
    """select i::integer as feature from (
         select generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings)
       group by i having var_samp(v) > 0.0156""",
)
def select_variance(t: Tables):
    """Components whose variance is above a threshold."""
    chosen = ml.VarianceThresholdSelector(featuresCol="features", outputCol="v", varianceThreshold=0.0156).fit(_vectors(t))
    return t.spark.createDataFrame([(int(i),) for i in chosen.selectedFeatures], "feature int")


@query(
    "formula",
    """with r as (select l_returnflag, row_number() over (order by count(*) desc, l_returnflag) - 1 as i from lineitem group by 1)
       select l_orderkey, l_linenumber, l_quantity + l_tax as total, l_extendedprice as label, l_quantity as f0,
              (i = 0)::integer::double as f1, (i = 1)::integer::double as f2 from lineitem join r using (l_returnflag)""",
)
def formula(t: Tables):
    rows = ml.SQLTransformer(
        statement="select *, l_quantity + l_tax as total from __THIS__"
    ).transform(t.lineitem)
    model = ml.RFormula(formula="l_extendedprice ~ l_quantity + l_returnflag").fit(rows)
    coded = vector_to_array("features")
    return model.transform(rows).select(
        "l_orderkey", "l_linenumber", "total", "label", *[coded[i].alias(f"f{i}") for i in range(3)]
    )


def _links(pairs):
    """Both directions of `(a, b, distance)` from the rows whose id is divisible by 100."""
    both = pairs.selectExpr("a as query", "b as id", "distance").unionByName(pairs.selectExpr("b as query", "a as id", "distance"))
    return both.where("query % 100 = 0")


def _with_recall(found, got, exact):
    return found.withColumn("recall", F.lit(round(neighbours.recall(got, exact), 6)))


@query("minhash_join")
def minhash_join(t: Tables):
    """Clusters of near-copies; `recall` is the share of all links of every hundredth text that the hashes found."""
    scratch = Scratch(t.spark, "minhash")
    pairs = scratch.write(similarity.minhash_pairs(t.documents, "doc_id", "text", 0.4)).df
    clusters = similarity.near_duplicate_clusters(t.documents, "doc_id", "text", 0.4, pairs)
    originals = similarity.same_text(t.documents, "doc_id", "text").where("src = dst").select(F.col("src").alias("id"))
    sets = scratch.write(similarity.word_sets(t.documents, "doc_id", "text").join(originals, "id", "left_semi")).df
    exact = neighbours.Index(sets, neighbours.Jaccard).within(sets.where("id % 100 = 0"), 0.4).where("query <> id")
    return _with_recall(clusters.labels, _links(pairs), scratch.write(exact).df)


@query("minhash_nearest")
def minhash_nearest(t: Tables):
    """The five documents nearest to each one whose id is divisible by 100, itself among them."""
    scratch = Scratch(t.spark, "minhash")
    queries = t.documents.where("doc_id % 100 = 0")
    found = scratch.write(similarity.minhash_nearest_each(t.documents, "doc_id", "text", queries, 5, tables=40)).df
    sets = similarity.word_sets(t.documents, "doc_id", "text")
    exact = scratch.write(neighbours.Index(sets, neighbours.Jaccard).nearest(sets.where("id % 100 = 0"), 5)).df
    return _with_recall(found.select("query", "id", F.round("distance", 6).alias("distance")), found, exact)


# on tables of this size the hashes find every neighbour, so the exact rows are the answer
_RP_NEAREST = """with r as (select vec_id as id, embedding::double[] as x from embeddings),
       d as (select a.id as query, b.id, list_distance(a.x, b.x) as distance from r a, r b where a.id % 100 = 0)
       select query, id, round(distance, 6) as distance, 1.0::double as recall from d
       qualify row_number() over (partition by query order by distance, id) <= 5"""
_RP_JOIN = """with r as (select vec_id as id, embedding::double[] as x from embeddings)
       select a.id as a, b.id as b, round(list_distance(a.x, b.x), 6) as distance, 1.0::double as recall
       from r a join r b on a.id < b.id where list_distance(a.x, b.x) < 1.2"""


@query("rp_nearest", _RP_NEAREST)
def rp_nearest(t: Tables):
    """The five embeddings nearest to each one whose id is divisible by 100, itself among them."""
    scratch, rows = Scratch(t.spark, "projection"), _vectors(t).select("id", "features")
    found = scratch.write(similarity.nearest_each(rows, rows.where("id % 100 = 0"), 5, tables=12)).df
    exact = scratch.write(_nearest_vectors(t)).df
    return _with_recall(found.select("query", "id", F.round("distance", 6).alias("distance")), found, exact)


@query("rp_lsh_join", _RP_JOIN)
def rp_lsh_join(t: Tables):
    scratch = Scratch(t.spark, "projection")
    pairs = scratch.write(similarity.euclidean_pairs(_vectors(t).select("id", "features"), 1.2, bucket=2.0, tables=12)).df
    rows = _plain_vectors(t)
    exact = scratch.write(neighbours.Index(rows).within(rows.where("id % 100 = 0"), 1.2).where("query <> id")).df
    return _with_recall(pairs.select("a", "b", F.round("distance", 6).alias("distance")), _links(pairs), exact)


def _plain_vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _nearest_vectors(t: Tables):
    rows = _plain_vectors(t)
    return neighbours.Index(rows).nearest(rows.where("id % 100 = 0"), 5)


@query(
    "exact_nearest",
    """with r as (select vec_id as id, embedding::double[] as x from embeddings),
       d as (select a.id as query, b.id, list_distance(a.x, b.x) as distance from r a, r b where a.id % 100 = 0)
       select query, id, round(distance, 6) as distance from d
       qualify row_number() over (partition by query order by distance, id) <= 5""",
)
def exact_nearest(t: Tables):
    """The five embeddings nearest to each one whose id is divisible by 100, exactly."""
    return _nearest_vectors(t).select("query", "id", F.round("distance", 6).alias("distance"))


@query(
    "exact_nearest_texts",
    """with r as (select doc_id as id, list_distinct(string_split(text, ' ')) as x from documents),
       d as (select a.id as query, b.id, len(list_intersect(a.x, b.x)) as n, len(a.x) + len(b.x) as m from r a, r b where a.id % 100 = 0)
       select query, id, round(1 - n / (m - n), 6) as distance from d
       qualify row_number() over (partition by query order by 1 - n / (m - n), id) <= 5""",
)
def exact_nearest_texts(t: Tables):
    """The five documents with the most similar sets of words, exactly."""
    words = F.array_distinct(F.split("text", " "))
    sets = t.documents.select(F.col("doc_id").alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("x"))
    found = neighbours.Index(sets, neighbours.Jaccard).nearest(sets.where("id % 100 = 0"), 5)
    return found.select("query", "id", F.round("distance", 6).alias("distance"))


@query(
    "largest_products",
    """with r as (select vec_id as id, embedding::double[] as x from embeddings),
       d as (select a.id as user, b.id as item, list_dot_product(a.x, b.x) as product from r a, r b where a.id % 100 = 0)
       select user, item, round(product, 6) as product from d
       qualify row_number() over (partition by user order by product desc, item) <= 5""",
)
def largest_products(t: Tables):
    """The five embeddings of the largest inner product with each one whose id is divisible by 100."""
    rows = _plain_vectors(t)
    found = products.largest_products(rows.where("id % 100 = 0"), rows, 5)
    return found.select("user", "item", F.round("product", 6).alias("product"))


_COSINE = """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings),
       n as (select i, sqrt(sum(v * v)) as norm from x group by i)
       select a.i::integer as i, b.i::integer as j, round(sum(a.v * b.v) / any_value(p.norm) / any_value(q.norm), 6) as cosine
       from x a join x b on a.vec_id = b.vec_id and a.i < b.i join n p on p.i = a.i join n q on q.i = b.i group by a.i, b.i"""


@query("column_cosine", _COSINE)
def column_cosine(t: Tables):
    return matrix.column_cosine(t.embeddings, "embedding").select(
        "i", "j", F.round("cosine", 6).alias("cosine")
    )


@query(
    "column_cosine_bounds",
    """with x as (select l_quantity as a, l_discount as b, l_tax as c, l_extendedprice / 1000 as d from lineitem),
       s as (select sqrt(sum(a * a)) as na, sqrt(sum(b * b)) as nb, sqrt(sum(c * c)) as nc, sqrt(sum(d * d)) as nd,
                    sum(a * b) as ab, sum(a * c) as ac, sum(a * d) as ad, sum(b * c) as bc, sum(b * d) as bd, sum(c * d) as cd from x)
       select i::integer as i, j::integer as j, round(v, 6) as cosine, true as near from s,
         lateral (values (0, 1, ab / na / nb), (0, 2, ac / na / nc), (0, 3, ad / na / nd), (1, 2, bc / nb / nc), (1, 3, bd / nb / nd), (2, 3, cd / nc / nd)) p(i, j, v)""",
)
def column_cosine_bounds(t: Tables):
    """Long columns, of which the sampled form drops most entries: is its estimate near the cosine?

    The estimate is made for entries of about one at most.
    """
    rows = t.lineitem.selectExpr("array(l_quantity / 50, l_discount * 10, l_tax * 10, l_extendedprice / 100000) as x")
    exact = matrix.column_cosine(rows, "x")
    estimate = matrix.column_cosine_sampled(rows, "x", 0.01, seed=1).withColumnRenamed("cosine", "estimate")
    near = F.abs(F.col("cosine") - F.col("estimate")) < 0.1
    return exact.join(estimate, ["i", "j"]).select("i", "j", F.round("cosine", 6).alias("cosine"), near.alias("near"))


@query("column_cosine_sampled", _COSINE)
def column_cosine_sampled(t: Tables):
    """The sampled form, for cosines above a tenth; columns as short as these are kept whole."""
    found = matrix.column_cosine_sampled(t.embeddings, "embedding", 0.1, seed=1)
    return found.select("i", "j", F.round("cosine", 6).alias("cosine"))


@query(
    "col_summary",
    """select round(avg(l_quantity), 6) as mean, round(var_samp(l_quantity), 4) as variance, count(*) as n,
              round(sum(l_quantity * l_discount) / sum(l_discount), 6) as weighted_mean from lineitem""",
)
def col_summary(t: Tables):
    rows = _assemble(t.lineitem, "l_quantity")
    every = Summarizer.metrics("mean", "variance", "count")
    out = rows.select(
        every.summary(F.col("features")).alias("s"),
        Summarizer.mean(F.col("features"), F.col("l_discount")).alias("w"),
    )
    return out.select(
        _entry("s.mean", 0).alias("mean"),
        _entry("s.variance", 0, 4).alias("variance"),
        F.col("s.count").alias("n"),
        _entry("w", 0).alias("weighted_mean"),
    )


_RANKED = """(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0)"""


@query(
    "correlation",
    f"""with r as (select l_quantity, l_extendedprice, {_RANKED.format(c='l_quantity')} as a,
                          {_RANKED.format(c='l_extendedprice')} as b from lineitem)
        select round(corr(l_quantity, l_extendedprice), 6) as pearson, round(corr(a, b), 6) as spearman from r""",
)
def correlation(t: Tables):
    rows = _assemble(t.lineitem, "l_quantity", "l_extendedprice")
    pearson = float(Correlation.corr(rows, "features", "pearson").first()[0][0, 1])
    ranked = stats.spearman(t.lineitem, "l_quantity", "l_extendedprice")
    return ranked.select(F.lit(round(pearson, 6)).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(
    "chi_square",
    """with o as (select l_returnflag as a, l_linestatus as b, count(*) as o from lineitem group by 1, 2),
       s as (select *, sum(o) over (partition by a) * sum(o) over (partition by b) / sum(o) over () as e from o)
       select round(sum(pow(o - e, 2) / e), 6) as statistic,
              (count(distinct a) - 1) * (count(distinct b) - 1) as df from s""",
)
def chi_square(t: Tables):
    return stats.independence(t.lineitem, "l_returnflag", "l_linestatus").select(
        F.round("statistic", 6).alias("statistic"), "df"
    )


@query(
    "chi_fit",
    """with c as (select event_type, count(*) as o from events group by 1),
       s as (select sum(pow(o - m, 2) / m) as x, count(*) - 1 as df from c, (select avg(o) as m from c))
       select round(x, 6) as statistic, df, round(exp(-x / 2) * (1 + x / 2), 9) as p_value from s""",
)
def chi_fit(t: Tables):
    """Are the five event types equally frequent?"""
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("o"))
    test = stats.with_p_value(stats.goodness_of_fit(counts, "o"))
    return test.select(F.round("statistic", 6).alias("statistic"), F.col("df").cast("bigint").alias("df"), F.round("p_value", 9).alias("p_value"))


_SETS = """with d as (select user_id, event_id % 2 as half, list(distinct event_type) as s from events group by all),
       s as (select a.user_id, coalesce(a.s, []) as own, coalesce(b.s, []) as said
             from (select * from d where half = 0) a full join (select * from d where half = 1) b using (user_id)),
       c as (select *, len(list_intersect(own, said)) as h, len(own) as o, len(said) as p from s)"""


def _user_sets(t: Tables):
    """Event types of a user in one half of the events, told by the other half."""
    sets = t.events.groupBy("user_id").agg(
        F.collect_set(F.expr("if(event_id % 2 = 0, event_type, null)")).alias("own"), F.collect_set(F.expr("if(event_id % 2 = 1, event_type, null)")).alias("said")
    )
    return sets


@query(
    "multilabel_metrics",
    _SETS
    + """ select avg(h / nullif(o + p - h, 0)) as accuracy, avg(coalesce(h / nullif(p, 0), 0)) as precision, avg(coalesce(h / nullif(o, 0), 0)) as recall,
             avg(2 * h / (o + p)) as f1, avg((h = o and h = p)::integer) as equal_sets, sum(o + p - 2 * h) / (count(*) * 5) as hamming_loss,
             sum(h) / sum(p) as micro_precision, sum(h) / sum(o) as micro_recall, 2 * sum(h) / (sum(o) + sum(p)) as micro_f1 from c""",
)
def multilabel_metrics(t: Tables):
    return stats.multilabel_metrics(_user_sets(t), "own", "said", 5)


@query(
    "multilabel_by_label",
    _SETS
    + """, t as (select unnest(['view', 'signup', 'error', 'click', 'purchase']) as label),
         n as (select label, count(*) filter (list_contains(own, label)) as o, count(*) filter (list_contains(said, label)) as p,
                      count(*) filter (list_contains(own, label) and list_contains(said, label)) as h from t, c group by label)
         select label, h / p as precision, h / o as recall, 2 * h / (o + p) as f1 from n where o + p > 0""",
)
def multilabel_by_label(t: Tables):
    return stats.multilabel_by_label(_user_sets(t), "own", "said")


def _chi_sql(feature: int, column: str) -> str:
    return f"""select {feature}::integer as feature, round(sum(pow(o - e, 2) / e), 4) as statistic,
                      ((count(distinct a) - 1) * (count(distinct b) - 1))::integer as df
               from (select a, b, coalesce(o, 0) as o, n_a * n_b / (select count(*) from lineitem) as e
                     from (select {column} as a, count(*) as n_a from lineitem group by 1)
                     cross join (select l_returnflag as b, count(*) as n_b from lineitem group by 1)
                     left join (select {column} as a, l_returnflag as b, count(*) as o from lineitem group by 1, 2)
                     using (a, b))"""


@query("chi_square_features", f"{_chi_sql(0, 'l_linenumber')} union all {_chi_sql(1, 'l_tax')}")
def chi_square_features(t: Tables):
    rows = ml.StringIndexer(inputCol="l_returnflag", outputCol="label").fit(t.lineitem).transform(t.lineitem)
    rows = _assemble(rows, "l_linenumber", "l_tax")
    test = ChiSquareTest.test(rows, "features", "label", flatten=True)
    return test.select(
        F.col("featureIndex").alias("feature"),
        F.round("statistic", 4).alias("statistic"),
        F.col("degreesOfFreedom").alias("df"),
    )


@query(
    "ks_test",
    """with p as (select (l_quantity - 25.5) / 14.4 as z, count(*) as n from lineitem group by 1),
       c as (select z, n, sum(n) over (order by z) as upto, sum(n) over () as total from p),
       s as (select z, n, upto, total, i, z / 2000 as h, exp(-pow(z * i / 2000, 2) / 2) / sqrt(2 * pi())
                    * case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end as part from c, range(0, 2001) r(i)),
       f as (select z, any_value(n) as n, any_value(upto) as upto, any_value(total) as total, 0.5 + any_value(h) / 3 * sum(part) as cdf
             from s group by z)
       select round(max(greatest(upto / total - cdf, cdf - (upto - n) / total)), 6) as statistic from f""",
)
def ks_test(t: Tables):
    rows = t.lineitem.selectExpr("(l_quantity - 25.5) / 14.4 as z")
    return KolmogorovSmirnovTest.test(rows, "z", "norm", 0.0, 1.0).select(
        F.round("statistic", 6).alias("statistic")
    )


@query(
    "kde",
    """select point::double as point, round(avg(exp(-pow((l_quantity - point) / 3.0, 2) / 2)) / (3.0 * sqrt(2 * pi())), 6) as density
       from lineitem, (values (5), (25), (60)) v(point) group by point""",
)
def kde(t: Tables):
    return stats.kernel_density(t.lineitem, "l_quantity", [5, 25, 60], 3.0).select(
        "point", F.round("density", 6).alias("density")
    )


_SHARE = "('0x' || substr(md5('7:' || event_id), 1, 8))::bigint / 4294967296.0"


@query(
    "sample_strata",
    f"""select event_id, 'strata' as kind from events
        where {_SHARE} < case event_type when 'view' then 0.1 when 'click' then 0.6 else 0 end
        union all (select event_id, 'fixed' from events order by {_SHARE}, event_id limit 100)""",
)
def sample_strata(t: Tables):
    rows = t.events.select("event_id", "event_type")
    strata = stats.sample_strata(rows, "event_type", {"view": 0.1, "click": 0.6}, ["event_id"], 7)
    fixed = stats.sample_fixed(rows, 100, ["event_id"], 7)
    return strata.select("event_id", F.lit("strata").alias("kind")).unionByName(
        fixed.select("event_id", F.lit("fixed").alias("kind"))
    )


_FRACTIONS = {"view": 0.13, "click": 0.5, "error": 0.001}
_POISSON = [sum(math.exp(-0.8) * 0.8**j / math.factorial(j) for j in range(i + 1)) for i in range(11)]


@query(
    "sample_exact",
    f"""select event_id, event_type from (
          select event_id, event_type, row_number() over (partition by event_type order by {_SHARE}, event_id) as r,
                 count(*) over (partition by event_type) as n from events)
        where r <= ceil(round(n * case event_type {" ".join(f"when '{k}' then {v}" for k, v in _FRACTIONS.items())} else 0 end, 9))""",
)
def sample_exact(t: Tables):
    return stats.sample_exact(t.events.select("event_id", "event_type"), "event_type", _FRACTIONS, ["event_id"], 7)


@query(
    "sample_replace",
    f"""select event_id, unnest(range(1, n + 1))::integer as copy from (
          select event_id, {" + ".join(f"({_SHARE} >= {x}::double)::integer" for x in _POISSON)} as n from events)""",
)
def sample_replace(t: Tables):
    """Poisson counts of rate 0.8; the SQL has the distribution's levels spelled out."""
    return stats.sample_with_replacement(t.events.select("event_id"), 0.8, ["event_id"], 7)


@query(
    "curve_areas",
    """with s as (select round(l_quantity) as score, count(*) filter (l_linestatus = 'O') as p, count(*) filter (l_linestatus <> 'O') as n
                  from lineitem group by 1),
       c as (select score, sum(p) over w as tp, sum(n) over w as fp from s window w as (order by score desc)),
       d as (select *, coalesce(lag(tp) over w, 0) as tp0, coalesce(lag(fp) over w, 0) as fp0, tp / (tp + fp) as prec,
                    coalesce(lag(tp / (tp + fp)) over w, tp / (tp + fp)) as prec0 from c window w as (order by score desc))
       select round(sum((fp - fp0) * (tp + tp0) / 2) / (max(tp) * max(fp)), 6) as area_roc,
              round(sum((tp - tp0) * (prec + prec0) / 2) / max(tp), 6) as area_pr from d""",
)
def curve_areas(t: Tables):
    """How well the quantity tells open lines; whole quantities, so most scores are ties."""
    rows = t.lineitem.selectExpr("round(l_quantity) as score", "l_linestatus = 'O' as y")
    return stats.curve_areas(rows, "score", "y").select(F.round("area_roc", 6).alias("area_roc"), F.round("area_pr", 6).alias("area_pr"))


@query(
    "vector_parquet",
    """select i::integer as i, round(avg(v), 6) as mean from (
         select generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings) group by i""",
)
def vector_parquet(t: Tables):
    stored = Scratch(t.spark, "vectors").write(_vectors(t)).df
    mean = stored.select(Summarizer.mean(F.col("features")).alias("m"))
    return mean.select(F.posexplode(vector_to_array("m")).alias("i", "mean")).select(
        "i", F.round("mean", 6).alias("mean")
    )


@query(
    "metrics",
    """with p as (select l_linestatus = 'O' as y, l_quantity > 25 as p from lineitem),
       c as (select count(*) filter (y and p) as tp, count(*) filter (not y and p) as fp,
                    count(*) filter (y and not p) as fn, count(*) filter (not y and not p) as tn from p)
       select (tp + tn)::double / (tp + fp + fn + tn) as accuracy, tp::double / (tp + fp) as precision,
              tp::double / (tp + fn) as recall, 2.0::double * tp / (2 * tp + fp + fn) as f1 from c""",
)
def metrics(t: Tables):
    rows = t.lineitem.selectExpr("l_linestatus = 'O' as y", "l_quantity > 25 as p")
    return stats.binary_metrics(rows, "y", "p")


_CLASSES = """with p as (select l_returnflag as y, case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end as p from lineitem),
       c as (select y as label, count(*) as n, count(*) filter (y = p) as hits from p group by y),
       s as (select p as label, count(*) as said from p group by p),
       m as (select label, n, hits, coalesce(hits / said::double, 0) as precision, hits / n::double as recall,
                    2.0::double * hits / (n + coalesce(said, 0)) as f1 from c left join s using (label))"""


def _flags(t: Tables):
    return t.lineitem.selectExpr("l_returnflag as y", "if(l_quantity < 17, 'A', if(l_quantity < 34, 'N', 'R')) as p")


@query("multiclass_metrics", _CLASSES + " select label, n, hits, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from m")
def multiclass_metrics(t: Tables):
    found = stats.multiclass_metrics(_flags(t), "y", "p")
    return found.select("label", "n", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "weighted_metrics",
    _CLASSES
    + """ select round(sum(hits) / sum(n)::double, 9) as accuracy, round(sum(n * precision) / sum(n), 9) as precision,
                 round(sum(n * recall) / sum(n), 9) as recall, round(sum(n * f1) / sum(n), 9) as f1 from m""",
)
def weighted_metrics(t: Tables):
    found = stats.weighted_metrics(stats.multiclass_metrics(_flags(t), "y", "p"))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(
    "confusion",
    """select l_returnflag as label, case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end as predicted,
              count(*) as n from lineitem group by 1, 2""",
)
def confusion(t: Tables):
    return stats.confusion(_flags(t), "y", "p")


@query(
    "regression_metrics",
    """select round(avg(pow(l_extendedprice - 1500 * l_quantity, 2)), 2) as mse, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) as mae,
              round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) as r2 from lineitem""",
)
def regression_metrics(t: Tables):
    rows = t.lineitem.selectExpr("l_extendedprice", "1500 * l_quantity as guess")
    found = stats.regression_metrics(rows, "l_extendedprice", "guess")
    return found.select(F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


@query(
    "ranking_metrics",
    """with c as (select user_id, event_type, count(*) as n, max(cast(props->>'$.k' as bigint)) >= 90 as rel
                  from events group by 1, 2),
       r as (select *, row_number() over (partition by user_id order by n desc, event_type) as i from c),
       h as (select *, count(*) filter (rel) over (partition by user_id order by i) as so_far from r),
       u as (select user_id, count(*) filter (rel and i <= 3) as hits, count(*) filter (rel) as n_rel,
                    coalesce(sum(1 / log2(i + 1)) filter (rel and i <= 3), 0) as dcg,
                    coalesce(sum(so_far / i::double) filter (rel), 0) as found from h group by user_id),
       b as (select *, case least(n_rel, 3) when 1 then 1 when 2 then 1 + 1 / log2(3) else 1.5 + 1 / log2(3) end as best from u)
       select round(avg(hits / 3.0), 6) as precision, round(avg(case when n_rel > 0 then hits / n_rel::double else 0 end), 6) as recall,
              round(avg(case when n_rel > 0 then dcg / best else 0 end), 6) as ndcg,
              round(avg(case when n_rel > 0 then found / n_rel else 0 end), 6) as map from b""",
)
def ranking_metrics(t: Tables):
    """Event types of a user by frequency against those with a high `k`: five items at most."""
    types = t.events.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(F.get_json_object("props", "$.k").cast("bigint")) >= 90).alias("rel"),
    )
    lists = types.groupBy("user_id").agg(
        F.expr("transform(array_sort(collect_list(struct(-n as o, event_type))), x -> x.event_type)").alias("ranked"),
        F.expr("collect_list(if(rel, event_type, null))").alias("relevant"),
    )
    return stats.ranking_metrics(lists, "ranked", "relevant", 3).select(
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "map")]
    )
