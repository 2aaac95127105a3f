"""Statistical and learning operators."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.allocate import top_share
from ..operators.running import percentiles, ranked
from ..operators.regress import least_squares, repeat_index, repeat_index_by, spline_basis
from ..operators.simulate import poisson_weight
from ..operators.weighted import uniform
from ..registry import query, table
from ..session import scratch
from .aggregates import HASH, scored
from .projections import PAIRS_SQL, pairs


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).filter("is_valid").withColumn("py", F.year("prev_o_orderdate").cast("long"))


@query("M04_repeat_index")
def repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    index = repeat_index(p, F.col("o_totalprice"), F.col("prev_o_totalprice"), "y", "py", list(range(1995, 2002)), 1 / F.col("gap"))
    return spark.createDataFrame([(int(y), round(v, 6)) for y, v in index], "y long, value double")


#: Seeds of an ensemble, draws of the repeat index, trees of the forest.
N_SEEDS, N_REPEAT, N_TREES = 30, 200, 300


@query("M05_repeat_index_bootstrap")
def repeat_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One solve for each draw, of sums that one aggregate makes for all draws; a unit's pairs share its weight."""
    return repeat_draws(_pairs(spark, sf_dir), N_REPEAT)


def repeat_draws(pairs: DataFrame, draws: int) -> DataFrame:
    p = pairs.select("o_custkey", "o_totalprice", "prev_o_totalprice", "y", "py", "gap", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    p = p.withColumn("w", poisson_weight(uniform("m05", F.col("draw"), F.col("o_custkey"))) / F.col("gap")).filter("w > 0")
    index = repeat_index_by(p, "draw", F.col("o_totalprice"), F.col("prev_o_totalprice"), "y", "py", list(range(1995, 2002)), F.col("w"))
    return pairs.sparkSession.createDataFrame([(draw, int(y), round(v, 6)) for draw, of in sorted(index.items()) for y, v in of], "draw int, y long, value double")


@query("M06_fixed_effects", """
WITH d AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey) AS x, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_partkey) AS y FROM lineitem)
SELECT round(sum(x * y) / sum(x * x), 2) AS slope FROM d""")
def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The within estimator: what is left after each unit's mean."""
    w = Window.partitionBy("l_partkey")
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - F.avg("l_quantity").over(w)).alias("x"), (F.col("l_extendedprice") - F.avg("l_extendedprice").over(w)).alias("y"))
    return spark.createDataFrame([(round(least_squares(d, [F.col("x")], F.col("y"))[0], 2),)], "slope double")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants: balance, order count and spend, with a proxy decision. Income must be positive and no column may be missing."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spend"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    f = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("bal"), F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.log1p(F.coalesce("spend", F.lit(0.0))).alias("spend"), F.col("c_nationkey").alias("nation"))
    return f.withColumn("label", (F.col("bal") + F.col("n") / 5 + F.col("spend") / 10 + (F.col("id") % 7) / 3 > 8).cast("int"))


def validated(df: DataFrame, required: list[str], positive: list[str]) -> DataFrame:
    """df, if it has the columns; rows that break a domain raise an error when they are read."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    for c in positive:
        df = df.withColumn(c, F.when(F.col(c) > 0, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} must be positive: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("double")))
    return df


@query("S17_validated_features", "SELECT o_custkey AS id, count(*) AS n, round(ln(1 + sum(o_totalprice)), 6) AS spend FROM orders GROUP BY 1")
def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return validated(o, ["id", "n", "total"], ["total"]).select("id", "n", F.round(F.log1p("total"), 6).alias("spend"))


@query("S18_feature_builder", "SELECT c_custkey AS id, ln(1 + abs(c_acctbal))::DOUBLE > 8 AS rich, (c_mktsegment = 'BUILDING')::BIGINT AS building, round((c_acctbal + 1000) / 11000, 6) AS scaled FROM customer")
def builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.log1p(F.abs(b)) > 8).alias("rich"), (F.col("c_mktsegment") == "BUILDING").cast("long").alias("building"), F.round((b + 1000) / 11000, 6).alias("scaled"))


def with_splines(f: DataFrame) -> tuple[DataFrame, list[str]]:
    basis = {f"b{i}": c for i, c in enumerate(spline_basis(F.col("bal"), [-0.5, 2.0, 4.5, 7.0, 9.5]))}
    return f.withColumns(basis), [*basis, "n", "spend"]


def _fit(f: DataFrame, weight: str | None = None):
    f, names = with_splines(f)
    v = VectorAssembler(inputCols=names, outputCol="x").transform(f)
    lr = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.001, maxIter=40, standardization=True)
    return (lr.setWeightCol(weight) if weight else lr).fit(v), v


@query("M19_spline_logistic")
def spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, v = _fit(features(spark, sf_dir))
    return model.transform(v).select("id", F.round(vector_to_array("probability")[1], 4).alias("p"), "label")


@query("M20_interactions")
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of basis columns as further features."""
    f, names = with_splines(features(spark, sf_dir))
    f = f.withColumns({"b0_n": F.col("b0") * F.col("n"), "b0_spend": F.col("b0") * F.col("spend")})
    v = VectorAssembler(inputCols=[*names, "b0_n", "b0_spend"], outputCol="x").transform(f)
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.001, maxIter=40).fit(v)
    return model.transform(v).select("id", F.round(vector_to_array("probability")[1], 4).alias("p"))


def merit(bal: Column, n: Column) -> Column:
    """A fixed scoring model."""
    return 1 / (1 + F.exp(-(0.8 * bal + 0.5 * n - 7)))


COUNTER_SQL = "WITH f AS (SELECT c_custkey AS id, c_acctbal / 1000 AS bal, c_nationkey FROM customer), pr AS (SELECT p_size / 5.0 AS n FROM part WHERE p_partkey < 32)"


@query("M22_counterfactual_score", COUNTER_SQL + " SELECT id, round(avg(1 / (1 + exp(-(0.8 * bal + 0.5 * n - 7)))), 6) AS score FROM f, pr GROUP BY 1")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over reference profiles: what would be scored if the context were another's. The profiles are a stated 32."""
    pr = table(spark, sf_dir, "part").filter("p_partkey < 32").select((F.col("p_size") / 5.0).alias("n"))
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("bal"))
    return f.crossJoin(F.broadcast(pr)).groupBy("id").agg(F.round(F.avg(merit(F.col("bal"), F.col("n"))), 6).alias("score"))


@query("M23_retained_context", COUNTER_SQL + " SELECT id, round(avg(1 / (1 + exp(-(0.8 * bal + 0.5 * (0.75 * n + 0.25 * c_nationkey) - 7)))), 6) AS score FROM f, pr GROUP BY 1")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the own context is kept."""
    pr = table(spark, sf_dir, "part").filter("p_partkey < 32").select((F.col("p_size") / 5.0).alias("n"))
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("bal"), "c_nationkey")
    return f.crossJoin(F.broadcast(pr)).groupBy("id").agg(F.round(F.avg(merit(F.col("bal"), 0.75 * F.col("n") + 0.25 * F.col("c_nationkey"))), 6).alias("score"))


@query("M24_seed_ensemble")
def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N_SEEDS fits on hash-weighted rows; the score is their mean."""
    f = features(spark, sf_dir).cache()
    total = None
    for seed in range(N_SEEDS):
        model, v = _fit(f.withColumn("w", poisson_weight(uniform("m24", seed, F.col("id"))).cast("double")), "w")
        if total is None:
            total = v.select("id", "x")
        total = model.setProbabilityCol(f"p{seed}").setPredictionCol("").setRawPredictionCol("").transform(total)
    return total.select("id", F.round(sum((vector_to_array(f"p{seed}")[1] for seed in range(N_SEEDS)), F.lit(0.0)) / N_SEEDS, 4).alias("score"))


@query("M26_stratified_folds", f"SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY {HASH.format(chr(39) + 'fold' + chr(39) + ', doc_id')}, doc_id) % 5)::BIGINT AS fold FROM labels")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ranked(table(spark, sf_dir, "labels").select("doc_id", "quality", uniform("fold", F.col("doc_id")).alias("u")), ["quality"], [F.col("u"), F.col("doc_id")], "n")
    return n.select("doc_id", (F.col("n") % 5).alias("fold"))


@query("M27_weight_interval")
def weight_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 to 95 % interval of each logistic weight over N_SEEDS refits on hash-weighted rows."""
    f = features(spark, sf_dir).cache()
    rows = [(seed, i, float(w)) for seed in range(N_SEEDS) for i, w in enumerate(_fit(f.withColumn("w", poisson_weight(uniform("m27", seed, F.col("id"))).cast("double")), "w")[0].coefficients)]
    return percentiles(spark.createDataFrame(rows, "seed int, term int, w double"), ["term"], "w", {"low": 0.05, "high": 0.95}).select("term", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("K08_model_as_json", """
WITH d AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey) AS x, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_partkey) AS y FROM lineitem)
SELECT round(sum(x * y) / sum(x * x), 2) AS slope FROM d""")
def as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is its coefficients in a document: written, read with its schema, and the same."""
    path = scratch(spark, "model")
    fixed_effects(spark, sf_dir).write.json(path)
    return spark.read.schema("slope double").json(path)


@query("M28_pareto_sweep", """
WITH g AS (SELECT c_custkey AS id, c_nationkey % 2 AS grp, c_acctbal AS merit, c_custkey % 100 * 100.0 AS proxy, l / 4.0 AS lam, b / 10.0 AS budget FROM customer, (SELECT unnest([0, 2, 4]) AS l), (SELECT unnest([3, 4]) AS b)),
r AS (SELECT *, (row_number() OVER (PARTITION BY lam, budget ORDER BY lam * merit + (1 - lam) * proxy DESC, id) <= round_even(budget * count(*) OVER (PARTITION BY lam, budget), 0))::INT AS pick, (row_number() OVER (PARTITION BY lam, budget ORDER BY merit DESC, id) <= round_even(budget * count(*) OVER (PARTITION BY lam, budget), 0))::INT AS ref FROM g)
SELECT lam, budget, round(avg((pick = ref)::INT), 6) AS agreement, round(abs(avg(pick) FILTER (grp = 0) - avg(pick) FILTER (grp = 1)), 6) AS gap FROM r GROUP BY 1, 2""")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend by budget, all at once; agreement with a proxy reference is true by construction at a share of 1."""
    grid = F.explode(F.array(*[F.struct(F.lit(a / 4.0).alias("lam"), F.lit(b / 10.0).alias("budget")) for a in (0, 2, 4) for b in (3, 4)]))
    g = table(spark, sf_dir, "customer").withColumn("g", grid).select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).alias("grp"), F.col("c_acctbal").alias("merit"), (F.col("c_custkey") % 100 * 100.0).alias("proxy"), "g.lam", "g.budget")
    by, budget = ["lam", "budget"], F.col("budget")
    blend = F.col("lam") * F.col("merit") + (1 - F.col("lam")) * F.col("proxy")
    r = top_share(top_share(g, budget, [blend.desc(), F.asc("id")], "pick", by), budget, [F.desc("merit"), F.asc("id")], "ref", by)
    rate = lambda k: F.avg(F.when(F.col("grp") == k, F.col("pick")))
    return r.groupBy("lam", "budget").agg(F.round(F.avg((F.col("pick") == F.col("ref")).cast("int")), 6).alias("agreement"), F.round(F.abs(rate(0) - rate(1)), 6).alias("gap"))


@query("M29_isotonic_calibrator")
def calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scored(spark, sf_dir).select("doc_id", F.col("quality").cast("double").alias("label"), "p")
    v = VectorAssembler(inputCols=["p"], outputCol="x").transform(z)
    return IsotonicRegression(featuresCol="x", labelCol="label").fit(v).transform(v).select("doc_id", F.round("prediction", 6).alias("calibrated"))


@query("M30_depth2_gate")
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = VectorAssembler(inputCols=["bal", "n"], outputCol="x").transform(features(spark, sf_dir))
    return DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=2, seed=42).fit(v).transform(v).select("id", F.col("prediction").cast("int").alias("said"))


@query("M31_forest_baseline")
def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = VectorAssembler(inputCols=["bal", "n", "spend"], outputCol="x").transform(features(spark, sf_dir))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=N_TREES, minInstancesPerNode=20, seed=42).fit(v).transform(v).select("id", F.col("prediction").cast("int").alias("said"))


@query("M17_boosting")
def boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient boosting without monotone constraints, which the library does not have: fitted on earlier years, scored on the last."""
    p = _pairs(spark, sf_dir).select("o_orderkey", "y", "gap", F.ln("prev_o_totalprice").alias("lp"), F.ln("o_totalprice").alias("label"))
    v = VectorAssembler(inputCols=["gap", "lp"], outputCol="x").transform(p)
    model = GBTRegressor(featuresCol="x", labelCol="label", maxIter=5, maxDepth=3, seed=42).fit(v.filter("y < 2000"))
    return model.transform(v.filter("y >= 2000")).select("o_orderkey", F.round("prediction", 4).alias("forecast"))


@query("M35_policy_hypotheses", """
WITH s AS (SELECT c_custkey AS id, c_acctbal AS merit, c_acctbal + k / 100.0 * (c_custkey % 50) * 100 AS alt, k, b / 100.0 AS budget FROM customer, (SELECT unnest([-15, -5, 5, 15]) AS k), (SELECT unnest([39, 41]) AS b)),
r AS (SELECT k, budget, (row_number() OVER (PARTITION BY k, budget ORDER BY merit DESC, id) <= round_even(budget * count(*) OVER (PARTITION BY k, budget), 0)) AS now_, (row_number() OVER (PARTITION BY k, budget ORDER BY alt DESC, id) <= round_even(budget * count(*) OVER (PARTITION BY k, budget), 0)) AS then_ FROM s)
SELECT k::BIGINT AS retention, budget, count(*) FILTER (now_ <> then_) AS changed FROM r GROUP BY 1, 2""")
def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("retention"), F.lit(b / 100.0).alias("budget")) for k in (-15, -5, 5, 15) for b in (39, 41)]))
    s = table(spark, sf_dir, "customer").withColumn("g", grid).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("merit"), "g.retention", "g.budget")
    s = s.withColumn("alt", F.col("merit") + F.col("retention") / 100.0 * (F.col("id") % 50) * 100)
    by, budget = ["retention", "budget"], F.col("budget")
    r = top_share(top_share(s, budget, [F.desc("merit"), F.asc("id")], "now_", by), budget, [F.desc("alt"), F.asc("id")], "then_", by)
    return r.groupBy("retention", "budget").agg(F.count_if(F.col("now_") != F.col("then_")).alias("changed"))


@query("M36_counterfactual_allocation", COUNTER_SQL + ", s AS (SELECT id, c_nationkey, round(avg(1 / (1 + exp(-(0.8 * bal + 0.5 * n - 7)))), 6) AS score FROM f, pr GROUP BY 1, 2) SELECT id, (row_number() OVER (ORDER BY score DESC, id) <= round_even(0.4 * count(*) OVER (), 0))::INT AS granted FROM s")
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_share(counterfactual(spark, sf_dir), 0.4, [F.desc("score"), F.asc("id")]).select("id", "granted")
