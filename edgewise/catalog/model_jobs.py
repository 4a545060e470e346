"""Queries: models over `pyspark.ml`. Each returns a small table about the fit.

Solver output depends on floating-point order, so most have no SQL counterpart.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, classification as cl, clustering as cu, regression as rg
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    ClusteringEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import CountVectorizer, Tokenizer, VectorAssembler
from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.catalog.registry import Tables, query
from edgewise.operators import descent, isotonic, machines, topics
from edgewise.operators.products import largest_products
from edgewise.operators.text import ALL_TERMS
from edgewise.plans.scratch import Scratch

_RESULT = "model string, metric string, value double"


def _own_session(t: Tables) -> Tables:
    """The tables in a new session with the same settings.

    A classifier's model carries its training summary into the tasks, and that the session of its
    rows; a session that has observed a figure cannot be sent.
    """
    own = t.spark.newSession()
    for key, value in t.spark.conf.getAll.items():
        if own.conf.get(key, None) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return Tables(own, t.folder)


#: Most rows of a task of a learner: what it keeps, and reads in every round, grows with them.
PART_ROWS = 250_000
#: Fewer than these are not worth a task of their own.
FEW_ROWS = 100_000
#: Rows of a task where a search deals them out.
EVEN_ROWS = 1_000_000


@contextmanager
def _spread(rows: DataFrame) -> Iterator[DataFrame]:
    """`rows` in tasks of PART_ROWS or less, for all cores, however the files are cut; few rows stay where they are.

    They are cached without the vectors, which are made from them where they are read.
    """
    plain = rows.drop("features")
    total = plain.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = max(-(-total // PART_ROWS), min(cores, -(-total // FEW_ROWS)))
    if n <= 1:
        yield rows
        return
    kept = plain.repartition(n).persist()
    try:
        yield _assembled(kept)
    finally:
        kept.unpersist()


def _evenly(rows: DataFrame) -> DataFrame:
    """`rows` as their files are cut, or dealt out anew if one task has over a quarter more than a core's share of them.

    `rows` come straight from files, whose rows a task counts without reading them.
    """
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if sum(sizes) <= FEW_ROWS or max(sizes) <= 1.25 * sum(sizes) / cores:
        return rows
    return rows.repartition(max(cores, -(-sum(sizes) // EVEN_ROWS)))


def _assembled(rows: DataFrame) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_tax", "flag"]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def _lines(t: Tables) -> DataFrame:
    """Line items: is the line open, from quantity, discount, tax and price."""
    rows = t.lineitem.selectExpr(
        "double(l_linestatus = 'O') as label",
        "l_extendedprice / 1000 as price",
        "l_quantity",
        "l_discount",
        "l_tax",
        "double(array_position(array('A', 'N', 'R'), l_returnflag) - 1) as flag",
    )
    return _assembled(rows)


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id",
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"),
    )


def _scores(t: Tables, rows: DataFrame, jobs: dict) -> DataFrame:
    """Fit each estimator and evaluate it: `{name: (estimator, metric, evaluator)}`."""
    out = []
    for name, (estimator, metric, evaluator) in jobs.items():
        out.append((name, metric, float(evaluator.evaluate(estimator.fit(rows).transform(rows)))))
    return t.spark.createDataFrame(out, _RESULT)


def _accuracy(label: str = "label"):
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")


def _rmse(label: str = "price"):
    return RegressionEvaluator(labelCol=label, metricName="rmse")


def dense_ids(rows: DataFrame, column: str, out: str) -> DataFrame:
    """`(column, out)`: distinct values with numbers from 0 on, as int.

    Values are numbered inside hash parts, and the parts are moved behind each other by
    their counts, so no task sees all values.
    """
    parts = 64
    part = F.pmod(F.xxhash64(column), F.lit(parts))
    distinct = Scratch(rows.sparkSession, "ids").write(rows.select(column).na.drop().distinct().withColumn("_part", part)).df
    # one row per part
    before, at = {}, 0
    for row in sorted(distinct.groupBy("_part").count().collect()):
        before[row["_part"]], at = at, at + row["count"]
    shift = rows.sparkSession.createDataFrame(list(before.items()), "_part long, _shift long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return distinct.withColumn("_i", within).join(F.broadcast(shift), "_part").select(
        column, (F.col("_i") + F.col("_shift")).cast("int").alias(out)
    )


@query("logreg")
def logreg(t: Tables):
    """Binary with its summary, and multinomial over the return flag."""
    rows = _lines(_own_session(t))
    binary = cl.LogisticRegression(maxIter=10, regParam=0.01, elasticNetParam=0.5).fit(rows)
    multi = cl.LogisticRegression(
        labelCol="flag", family="multinomial", maxIter=10, regParam=0.01
    ).fit(rows)
    return t.spark.createDataFrame(
        [
            ("binary", "auc", float(binary.summary.areaUnderROC)),
            ("binary", "rounds", float(binary.summary.totalIterations)),
            ("multinomial", "accuracy", float(multi.summary.accuracy)),
        ],
        _RESULT,
    )


@query(
    "linreg",
    """select round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
              round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem""",
)
def linreg(t: Tables):
    """Least squares by the normal equation; the generalised form must agree."""
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        t.lineitem.select("l_quantity", "l_extendedprice")
    )
    plain = rg.LinearRegression(labelCol="l_extendedprice", solver="normal").fit(rows)
    general = rg.GeneralizedLinearRegression(labelCol="l_extendedprice", family="gaussian").fit(rows)
    if abs(plain.coefficients[0] - general.coefficients[0]) > 1e-3 * abs(plain.coefficients[0]):
        raise ValueError("the two fits disagree")
    return t.spark.createDataFrame(
        [(round(float(plain.coefficients[0]), 4), round(float(plain.intercept), 3))],
        "slope double, intercept double",
    )


@query("trees")
def trees(t: Tables):
    shape = {"seed": 1}
    few = {**shape, "maxIter": 10}
    with _spread(_lines(_own_session(t))) as rows:
        return _scores(
            t,
            rows,
            {
                "tree classifier": (cl.DecisionTreeClassifier(**shape), "accuracy", _accuracy()),
                "forest classifier": (
                    cl.RandomForestClassifier(numTrees=10, **shape), "accuracy", _accuracy()
                ),
                "boosted classifier": (cl.GBTClassifier(**few), "accuracy", _accuracy()),
                "tree regressor": (rg.DecisionTreeRegressor(labelCol="price", **shape), "rmse", _rmse()),
                "forest regressor": (
                    rg.RandomForestRegressor(labelCol="price", numTrees=10, **shape), "rmse", _rmse()
                ),
                "boosted regressor": (rg.GBTRegressor(labelCol="price", **few), "rmse", _rmse()),
            },
        )


@query("linear_models")
def linear_models(t: Tables):
    rows = _lines(_own_session(t))
    base = cl.LogisticRegression(maxIter=10)
    return _scores(
        t,
        rows,
        {
            "svm": (cl.LinearSVC(maxIter=10), "accuracy", _accuracy()),
            "naive bayes": (cl.NaiveBayes(), "accuracy", _accuracy()),
            "perceptron": (
                cl.MultilayerPerceptronClassifier(layers=[4, 5, 2], maxIter=100, seed=1),
                "accuracy",
                _accuracy(),
            ),
            "one-vs-rest": (
                cl.OneVsRest(classifier=base, labelCol="flag"), "accuracy", _accuracy("flag")
            ),
        },
    )


@query("fm")
def fm(t: Tables):
    options = {"stepSize": 0.01, "seed": 1}
    jobs = {
        "fm classifier": (cl.FMClassifier(**options), "accuracy", _accuracy()),
        "fm regressor": (rg.FMRegressor(labelCol="price", **options), "rmse", _rmse()),
    }
    few = _lines(_own_session(t))
    with _spread(few) as rows:
        if rows is few:
            return _scores(t, rows, jobs)
        models = machines.fit(rows, [job[0] for job in jobs.values()])
        out = [
            (name, metric, float(judge.evaluate(model.transform(rows))))
            for (name, (_, metric, judge)), model in zip(jobs.items(), models, strict=True)
        ]
    return t.spark.createDataFrame(out, _RESULT)


@query("survival_isotonic")
def survival_isotonic(t: Tables):
    """Order size as survival time, open lines as censored; price rising with quantity."""
    rows = _lines(t).withColumn("censor", F.col("label"))
    aft = rg.AFTSurvivalRegression(labelCol="price", censorCol="censor")
    scored = _scores(t, rows, {"aft": (aft, "rmse", _rmse())})
    points = rows.selectExpr("l_quantity as x", "price as y", "1.0D as w")
    curve = isotonic.fitted(points, isotonic.isotonic(points))
    # one row a quantity
    rated = rows.join(F.broadcast(curve), rows.l_quantity == curve.x)
    rmse = rated.agg(F.sqrt(F.avg(F.pow(F.col("price") - F.col("fitted"), 2)))).first()[0]
    return scored.unionByName(t.spark.createDataFrame([("isotonic", "rmse", rmse)], _RESULT))


@query(
    "isotonic",
    """with p as (select l_quantity::double as x, avg(sin(l_orderkey) * l_quantity) as y, count(*) as w from lineitem group by 1),
       c as (select *, row_number() over (order by x) as i, sum(w) over (order by x) as cw, sum(w * y) over (order by x) as cs from p),
       seg as (select a.i as a, b.i as b, (b.cs - a.cs + a.w * a.y) / (b.cw - a.cw + a.w) as m from c a join c b on a.i <= b.i),
       low as (select c.i, seg.a, min(seg.m) as m from c join seg on seg.a <= c.i and seg.b >= c.i group by c.i, seg.a)
       select x, round(max(m), 6) as fitted from low join c using (i) group by x""",
)
def isotonic_fit(t: Tables):
    """Best rising curve of a noisy figure over quantity; the SQL takes the largest smallest mean around each point."""
    points = t.lineitem.selectExpr("double(l_quantity) as x", "sin(l_orderkey) * l_quantity as y", "1.0D as w")
    blocks = isotonic.isotonic(points, chunk=8)
    return isotonic.fitted(points, blocks).select("x", F.round("fitted", 6).alias("fitted"))


@query("cluster")
def cluster(t: Tables):
    rows = _points(t)
    jobs = {
        "k-means": (cu.KMeans(k=4, seed=1), "silhouette", ClusteringEvaluator()),
        "bisecting": (cu.BisectingKMeans(k=4, seed=1), "silhouette", ClusteringEvaluator()),
        "mixture": (cu.GaussianMixture(k=2, seed=1), "silhouette", ClusteringEvaluator()),
    }
    rows.persist()
    scored = _scores(t, rows, jobs)
    rows.unpersist()
    tokens = Tokenizer(inputCol="text", outputCol="tokens").transform(t.documents.select("text"))
    counts = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=ALL_TERMS, minDF=5)
    # each round of the fit reads the counts again
    counted = counts.fit(tokens).transform(tokens).select("features").persist()
    model = cu.LDA(k=10, maxIter=10, seed=1).fit(counted)
    lda = [("topics", "log perplexity", topics.log_perplexity(model, counted))]
    counted.unpersist()
    return scored.unionByName(t.spark.createDataFrame(lda, _RESULT))


def _gradient_sql(rounds: int, step: float) -> str:
    """Rounds of the mean gradient, one after the other."""
    columns = ["1.0::double", "l_quantity / 50", "l_discount * 10"]
    w = [", ".join("0.0::double as w%d" % i for i in range(3))]
    parts = [f"p as materialized (select {', '.join(f'{c} as x{i}' for i, c in enumerate(columns))}, (l_linestatus = 'O')::integer as y from lineitem)"]
    parts.append(f"m0 as (select {w[0]})")
    for r in range(rounds):
        margin = " + ".join(f"w{i} * x{i}" for i in range(3))
        moved = ", ".join(f"any_value(w{i}) + {step} * avg((y - 1 / (1 + exp(-({margin})))) * x{i}) as w{i}" for i in range(3))
        parts.append(f"m{r + 1} as materialized (select {moved} from p, m{r})")
    rows = " union all ".join(f"select {i} as i, round(w{i}, 6) as weight from m{rounds}" for i in range(3))
    return f"with {', '.join(parts)} {rows}"


@query("logistic_gradient", _gradient_sql(5, 2.0))
def logistic_gradient(t: Tables):
    """Five rounds of batch gradient."""
    rows = t.lineitem.selectExpr("array(1.0D, l_quantity / 50, l_discount * 10) as x", "int(l_linestatus = 'O') as y")
    model = descent.logistic_gradient(rows, 2.0, rounds=5).state
    return model.select(F.posexplode("w").alias("i", "weight")).select("i", F.round("weight", 6).alias("weight"))


def _lloyd_sql(k: int, rounds: int) -> str:
    parts = [
        "x as materialized (select vec_id as r, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings)",
        f"c0 as materialized (select (row_number() over (partition by i order by r) - 1)::integer as j, i, x as c from x where r < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized (select r, arg_min(j, (d, j)) as j from (select r, j, sum((x - c) * (x - c)) as d from x join c{n} using (i) group by r, j) group by r)")
        parts.append(
            f"c{n + 1} as materialized (select o.j, o.i, coalesce(m, c) as c from c{n} o left join (select j, i, avg(x) as m from a{n} join x using (r) group by j, i) using (j, i))"
        )
    return f"with {', '.join(parts)} select r as vec_id, j as cluster from a{rounds}"


@query("lloyd", _lloyd_sql(4, 5))
def lloyd(t: Tables):
    """Five rounds of k-means from the first four vectors, then the clusters."""
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    start = rows.where("vec_id < 4").selectExpr("int(vec_id) as cluster", "x as c")
    centres = descent.lloyd(rows, start, rounds=5).state
    return descent.assigned(rows, centres).select("vec_id", "cluster")


@query("recommend")
def recommend(t: Tables):
    """Customers rate suppliers by the number of lines bought; three suppliers each.

    The learner takes int ids, so both are numbered densely first.
    """
    bought = (
        t.lineitem.join(t.orders, F.expr("l_orderkey = o_orderkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.count(F.lit(1)).cast("float").alias("rating"))
    )
    users, items = dense_ids(bought, "o_custkey", "user"), dense_ids(bought, "l_suppkey", "item")
    ratings = bought.join(users, "o_custkey").join(items, "l_suppkey").select("user", "item", "rating")
    model = ALS(
        userCol="user", itemCol="item", ratingCol="rating", rank=4, maxIter=5, seed=1,
        coldStartStrategy="drop",
    ).fit(ratings)
    factors = (f.select("id", F.col("features").alias("x")) for f in (model.userFactors, model.itemFactors))
    listed = largest_products(*factors, 3).select("user", "item", F.round(F.col("product").cast("float"), 3).alias("rating"))
    return listed.join(users, "user").join(items, "item").selectExpr("o_custkey as user", "l_suppkey as item", "rating")


_TYPES = ["click", "error", "purchase", "signup", "view"]
_SUBSETS = [c for k in range(1, 6) for c in combinations(_TYPES, k)]
_SUPPORT = 0.1


def _baskets(t: Tables) -> DataFrame:
    """Event types of a user's day; five items at most."""
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.collect_set("event_type").alias("items")
    )


_ITEMSETS_SQL = (
    "with b as (select list(distinct event_type) as items from events group by user_id, ts::date) "
    + " union all ".join(
        f"select '{','.join(c)}' as items, count(*) as n from b where list_has_all(items, {list(c)})"
        for c in _SUBSETS
    )
)


@query(
    "itemsets",
    f"""select * from ({_ITEMSETS_SQL}) where n >= {_SUPPORT} *
        (select count(*) from (select distinct user_id, ts::date from events))""",
)
def itemsets(t: Tables):
    model = FPGrowth(itemsCol="items", minSupport=_SUPPORT, minConfidence=0.5).fit(_baskets(t))
    return model.freqItemsets.select(
        F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("n")
    )


_ITEM_LISTS = {",".join(c): c for c in _SUBSETS}
_RULES = [
    (whole, ",".join(x for x in c if x != then), then)
    for whole, c in _ITEM_LISTS.items()
    if len(c) > 1
    for then in c
]


@query(
    "association_rules",
    f"""with f as ({_ITEMSETS_SQL}),
        r(whole, given, consequent) as (values {", ".join(str(r) for r in _RULES)})
        select r.given, r.consequent as then, round(w.n / g.n, 6) as confidence
        from r join f w on w.items = r.whole join f g on g.items = r.given
        where w.n / g.n >= 0.3 and
              w.n >= {_SUPPORT} * (select count(*) from (select distinct user_id, ts::date from events))""",
)
def association_rules(t: Tables):
    model = FPGrowth(itemsCol="items", minSupport=_SUPPORT, minConfidence=0.3).fit(_baskets(t))
    return model.associationRules.select(
        F.array_join(F.array_sort("antecedent"), ",").alias("given"),
        F.array_join("consequent", ",").alias("then"),
        F.round("confidence", 6).alias("confidence"),
    )


@query("sequences")
def sequences(t: Tables):
    """Frequent orders of event types over the days of a user."""
    return _sequences(t, 5)


@query(
    "sequences_of_two",
    """with f as (select distinct user_id, ts::date as day, event_type as e from events),
       p as (select user_id, e as sequence from f
             union select a.user_id, a.e || ',' || b.e from f a join f b on a.user_id = b.user_id and a.day = b.day and a.e < b.e
             union select a.user_id, a.e || ';' || b.e from f a join f b on a.user_id = b.user_id and a.day < b.day)
       select sequence, count(*) as n from p group by sequence having count(*) >= 0.5 * (select count(distinct user_id) from events)""",
)
def sequences_of_two(t: Tables):
    """One event type, two on a day, or one before the other."""
    return _sequences(t, 2)


def _sequences(t: Tables, longest: int) -> DataFrame:
    days = _baskets(t).groupBy("user_id").agg(
        F.expr("transform(array_sort(collect_list(struct(day, items))), x -> x.items)").alias(
            "sequence"
        )
    )
    spans = PrefixSpan(minSupport=0.5, maxPatternLength=longest).findFrequentSequentialPatterns(days)
    return spans.select(
        F.array_join(F.expr("transform(sequence, s -> array_join(array_sort(s), ','))"), ";").alias(
            "sequence"
        ),
        F.col("freq").alias("n"),
    )


@query("tune")
def tune(t: Tables):
    """Pipeline with a parameter grid, by cross validation and by one split."""
    columns = ["l_quantity", "l_discount", "l_tax", "flag"]
    model = cl.LogisticRegression(maxIter=10)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), model])
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 0.1]).build()
    judge = BinaryClassificationEvaluator()
    searches = [
        CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1, parallelism=2),
        TrainValidationSplit(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, trainRatio=0.8, seed=1),
    ]
    own = _own_session(t)
    rows = _evenly(_lines(own).drop("features", "price")).persist()
    # a fit is many short jobs: one search works while the other waits for its driver
    with ThreadPool(len(searches)) as pool:
        folds, split = pool.map(lambda search: inheritable_thread_target(own.spark)(search.fit)(rows), searches)
    rows.unpersist()
    out = [(f"folds {i}", "auc", float(v)) for i, v in enumerate(folds.avgMetrics)]
    out += [(f"split {i}", "auc", float(v)) for i, v in enumerate(split.validationMetrics)]
    return t.spark.createDataFrame(out, _RESULT)
