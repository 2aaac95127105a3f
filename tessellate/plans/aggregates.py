"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.indices import laspeyres, midpoint_change, paasche, shift_share
from ..operators.metrics import auc, binary_metrics, calibration_error, indicator, wilson
from ..operators.running import percentiles, running, with_percentiles
from ..operators.weighted import uniform, weighted_mean, weighted_percentiles
from ..registry import query, table
from .joins import CELLS_SQL, SERIES_SQL, cells, series, two_periods
from .projections import PAIRS_SQL, READINGS_SQL, STATUS_SQL, pairs, readings, status_for

def year(c: str):
    return F.year(c).cast("long")


@query("A01_count_median", "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n, round(median(o_totalprice), 4) AS med FROM orders GROUP BY 1")
def count_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(year("o_orderdate").alias("y"), "o_totalprice")
    return with_percentiles(o.groupBy("y").agg(F.count("*").alias("n")), o, ["y"], "o_totalprice", {"m": 0.5}).select("y", "n", F.round("m", 4).alias("med"))


@query("A02_mixed_profile", "SELECT year(o_orderdate)::BIGINT AS y, round(median(o_totalprice), 4) AS med, round(avg((o_orderstatus = 'F')::INT), 6) AS share_f, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS mean_f, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def mixed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    o = table(spark, sf_dir, "orders").withColumn("y", year("o_orderdate"))
    stats = o.groupBy("y").agg(F.round(F.avg(f.cast("int")), 6).alias("share_f"), F.round(F.avg(F.when(f, F.col("o_totalprice"))), 2).alias("mean_f"), F.count_distinct("o_custkey").alias("customers"))
    return with_percentiles(stats, o, ["y"], "o_totalprice", {"m": 0.5}).withColumn("med", F.round("m", 4)).drop("m")


@query("A03_first_year", "SELECT o_custkey, min(year(o_orderdate))::BIGINT AS first_year FROM orders GROUP BY 1")
def first_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(year("o_orderdate")).alias("first_year"))


@query("A04_share_table", "SELECT year(o_orderdate)::BIGINT AS y, round(avg((o_orderpriority = '1-URGENT')::INT), 6) AS urgent, round(avg((o_orderpriority = '2-HIGH')::INT), 6) AS high, round(avg((o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))::INT), 6) AS rest FROM orders GROUP BY 1")
def share_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("rest")
    p = o.withColumn("kind", kind).groupBy(year("o_orderdate").alias("y")).pivot("kind", ["urgent", "high", "rest"]).count().fillna(0)
    n = F.col("urgent") + F.col("high") + F.col("rest")
    return p.select("y", *[F.round(F.col(c) / n, 6).alias(c) for c in ("urgent", "high", "rest")])


BOTH_SQL = CELLS_SQL.rstrip() + """,
part_cell AS (SELECT * FROM cell WHERE hash_free(brand, y)),
b AS (
  SELECT coalesce(c.y, p.y + 1) AS y, coalesce(c.brand, p.brand) AS brand, coalesce(c.beds, p.beds) AS beds, coalesce(c.n, 0) AS n, c.mean, coalesce(p.n, 0) AS n_prev, p.mean AS mean_prev
  FROM part_cell c FULL JOIN part_cell p ON c.brand = p.brand AND c.beds = p.beds AND c.y = p.y + 1),
bb AS (SELECT * FROM b WHERE y > (SELECT min(y) FROM cell) AND y <= (SELECT max(y) FROM cell)),
t AS (SELECT y, sum(n) AS tn, sum(n_prev) AS tp FROM bb GROUP BY y),
s AS (SELECT bb.*, n / tn AS s, n_prev / tp AS sp, coalesce(mean, 0) AS m, coalesce(mean_prev, 0) AS p FROM bb JOIN t USING (y))
SELECT y, round(sum(CASE WHEN n > 0 AND n_prev > 0 THEN sp * (m - p) ELSE 0 END), 4) AS within, round(sum(CASE WHEN n > 0 AND n_prev > 0 THEN (s - sp) * m ELSE 0 END), 4) AS mix,
       round(sum(CASE WHEN n > 0 AND n_prev > 0 THEN 0 ELSE s * m - sp * p END), 4) AS entry, round(sum(s * m - sp * p), 4) AS change FROM s GROUP BY y"""


@query("A05_shift_share", BOTH_SQL.replace("hash_free(brand, y)", "(length(brand) + ascii(right(brand, 1)) + y + beds) % 7 <> 0"))
def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some segments are left out of some years, so that entry has something to say."""
    c = cells(spark, sf_dir).filter((F.char_length("brand") + F.ascii(F.right("brand", F.lit(1))) + F.col("y") + F.col("beds")) % 7 != 0)
    ends = cells(spark, sf_dir).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    p = c.select((F.col("y") + 1).alias("y"), "brand", "beds", F.col("n").alias("n_prev"), F.col("mean").alias("mean_prev"))
    b = c.select("y", "brand", "beds", "n", "mean").join(p, ["y", "brand", "beds"], "full_outer").fillna(0, ["n", "n_prev"])
    b = b.crossJoin(F.broadcast(ends)).filter("y > lo and y <= hi")
    return shift_share(b, "y", "n", "mean", "n_prev", "mean_prev").select("y", *[F.round(x, 4).alias(x) for x in ("within", "mix", "entry", "change")])


@query("A06_fisher", CELLS_SQL + """
SELECT c.y, round(100 * (sum(c.mean * p.n) / sum(p.mean * p.n) - 1), 4) AS laspeyres, round(100 * (sum(c.mean * c.n) / sum(p.mean * c.n) - 1), 4) AS paasche,
       round(100 * (sqrt(sum(c.mean * p.n) / sum(p.mean * p.n) * (sum(c.mean * c.n) / sum(p.mean * c.n))) - 1), 4) AS fisher
FROM cell c JOIN cell p ON c.brand = p.brand AND c.beds = p.beds AND c.y = p.y + 1 GROUP BY 1""")
def fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = two_periods(cells(spark, sf_dir), ["brand", "beds"], ["n", "mean"])
    la, pa = laspeyres(F.col("mean"), F.col("mean_prev"), F.col("n_prev")), paasche(F.col("mean"), F.col("n"), F.col("mean_prev"))
    pct = lambda x: F.round(100 * (x - 1), 4)
    return m.groupBy("y").agg(pct(la).alias("laspeyres"), pct(pa).alias("paasche"), pct(F.sqrt(la * pa)).alias("fisher"))


@query("A07_growth_summary", PAIRS_SQL + "SELECT y, is_renewal, count(*) AS n, round(median(growth), 4) AS med, round(sum(growth * o_totalprice) / sum(o_totalprice), 2) AS weighted FROM p WHERE is_valid GROUP BY ALL")
def growth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).filter("is_valid")
    stats = p.groupBy("y", "is_renewal").agg(F.count("*").alias("n"), F.round(weighted_mean(F.col("growth"), F.col("o_totalprice")), 2).alias("weighted"))
    return with_percentiles(stats, p, ["y", "is_renewal"], "growth", {"m": 0.5}).withColumn("med", F.round("m", 4)).drop("m")


@query("A08_percentile_spread", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9) - quantile_cont(o_totalprice, 0.1), 4) AS spread FROM orders GROUP BY 1")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"low": 0.1, "high": 0.9})
    return q.select("o_orderpriority", F.round(F.col("high") - F.col("low"), 4).alias("spread"))


@query("A09_validity_funnel", PAIRS_SQL + """, f AS (SELECT count(*) AS total, count(*) FILTER (no_previous) AS no_previous, count(*) FILTER (bad_value) AS bad_value, count(*) FILTER (bad_gap) AS bad_gap, count(*) FILTER (NOT is_valid) AS any_reason, count(*) FILTER (is_valid) AS valid FROM p)
SELECT step, n FROM (UNPIVOT f ON total, no_previous, bad_value, bad_gap, any_reason, valid INTO NAME step VALUE n)""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    f = p.agg(F.count("*").alias("total"), *[F.count_if(F.col(c)).alias(c) for c in ("no_previous", "bad_value", "bad_gap")], F.count_if(~F.col("is_valid")).alias("any_reason"), F.count_if(F.col("is_valid")).alias("valid"))
    return f.unpivot([], ["total", "no_previous", "bad_value", "bad_gap", "any_reason", "valid"], "step", "n")


LINES_SQL = "WITH t AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, o_totalprice, coalesce(v, 0) AS v FROM orders LEFT JOIN t ON o_orderkey = l_orderkey)"


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the total of their lines."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", year("o_orderdate").alias("y"), "o_totalprice")
    return o.join(t, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


@query("A10_reconstruct_total", f"{LINES_SQL} SELECT y, count(*) AS n, round(avg((abs(v - o_totalprice) <= 100000)::INT), 6) AS within FROM j GROUP BY 1")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = (F.abs(F.col("v") - F.col("o_totalprice")) <= 100000).cast("int")
    return rebuilt(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg(near), 6).alias("within"))


@query("A11_subtotal_row", f"{LINES_SQL} SELECT coalesce(y::VARCHAR, 'all') AS y, count(*) AS n, round(avg(v), 2) AS mean FROM j GROUP BY ROLLUP (y)")
def subtotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt(spark, sf_dir).rollup("y").agg(F.count("*").alias("n"), F.round(F.avg("v"), 2).alias("mean")).withColumn("y", F.coalesce(F.col("y").cast("string"), F.lit("all")))


@query("A12_best_parameter", f"{LINES_SQL}, g AS (SELECT k, avg((abs(v * k - o_totalprice) <= 50000)::INT) AS hit FROM j, (VALUES (0.5), (1.0), (1.5), (2.0)) AS t(k) GROUP BY 1) SELECT k::DOUBLE AS k, round(hit, 6) AS hit FROM g ORDER BY hit DESC, k LIMIT 1")
def best_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = rebuilt(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0)))))
    g = j.groupBy("k").agg(F.avg((F.abs(F.col("v") * F.col("k") - F.col("o_totalprice")) <= 50000).cast("int")).alias("hit"))
    return g.agg(F.max(F.struct("hit", (-F.col("k")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("k"), F.round("b.hit", 6).alias("hit"))


@query("A13_concession_profile", "SELECT l_returnflag, l_linestatus, round(avg((l_discount > 0)::INT), 6) AS penetration, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS depth, round(avg(l_discount), 6) AS drag FROM lineitem GROUP BY 1, 2")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg((d > 0).cast("int")), 6).alias("penetration"), F.round(F.avg(F.when(d > 0, d)), 6).alias("depth"), F.round(F.avg(d), 6).alias("drag"))


@query("A14_midpoint_decomposition", """
WITH a AS (SELECT year(l_shipdate)::BIGINT AS y, avg((l_discount > 0)::INT) AS pen, avg(CASE WHEN l_discount > 0 THEN l_discount END) AS dep FROM lineitem GROUP BY 1),
l AS (SELECT *, lag(pen) OVER (ORDER BY y) AS p0, lag(dep) OVER (ORDER BY y) AS d0 FROM a)
SELECT y, round((pen - p0) * (dep + d0) / 2, 8) AS by_penetration, round((dep - d0) * (pen + p0) / 2, 8) AS by_depth, round(pen * dep - p0 * d0, 8) AS change FROM l WHERE p0 IS NOT NULL""")
def midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window is over one row a year."""
    d = F.col("l_discount")
    a = table(spark, sf_dir, "lineitem").groupBy(year("l_shipdate").alias("y")).agg(F.avg((d > 0).cast("int")).alias("pen"), F.avg(F.when(d > 0, d)).alias("dep"))
    w = Window.orderBy("y")
    a = a.withColumns({"p0": F.lag("pen").over(w), "d0": F.lag("dep").over(w)}).filter("p0 is not null")
    x, z = midpoint_change(F.col("pen"), F.col("dep"), F.col("p0"), F.col("d0"))
    return a.select("y", F.round(x, 8).alias("by_penetration"), F.round(z, 8).alias("by_depth"), F.round(F.col("pen") * F.col("dep") - F.col("p0") * F.col("d0"), 8).alias("change"))


@query("A15_quarter_dispersion", "WITH q AS (SELECT year(l_shipdate)::BIGINT AS y, quarter(l_shipdate) AS q, avg(l_discount) AS v FROM lineitem GROUP BY ALL) SELECT y, count(*) AS quarters, round(stddev_samp(v), 8) AS within_year, round(avg(v), 6) AS mean FROM q GROUP BY 1")
def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.avg("l_discount").alias("v"))
    return q.groupBy("y").agg(F.count("*").alias("quarters"), F.round(F.stddev("v"), 8).alias("within_year"), F.round(F.avg("v"), 6).alias("mean"))


@query("A16_pivot_median", "SELECT year(o_orderdate)::BIGINT AS y, round(median(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(median(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o, round(median(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY 1")
def pivot_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(year("o_orderdate").alias("y"), F.lower("o_orderstatus").alias("s"), "o_totalprice")
    return percentiles(o, ["y", "s"], "o_totalprice", {"m": 0.5}).groupBy("y").pivot("s", ["f", "o", "p"]).agg(F.round(F.first("m"), 4))


@query("A17_group_record", "SELECT o_orderpriority, count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(stddev_samp(o_totalprice), 2) AS sd, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1")
def group_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("lo"), F.round(F.max("o_totalprice"), 2).alias("hi"), F.round(F.stddev("o_totalprice"), 2).alias("sd"), F.count_distinct(F.year("o_orderdate")).alias("years"))


@query("A18_inventory", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, min(year(o_orderdate))::BIGINT AS lo, max(year(o_orderdate))::BIGINT AS hi, count(*) AS n FROM orders GROUP BY 1")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.min(year("o_orderdate")).alias("lo"), F.max(year("o_orderdate")).alias("hi"), F.count("*").alias("n"))


@query("A19_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("A20_leave_one_out", SERIES_SQL.rstrip() + """, t AS (SELECT a.y, a.v - b.v AS d FROM s a JOIN s b ON a.y = b.y AND a.seg = 'AUTOMOBILE' AND b.seg = 'BUILDING')
SELECT count(*) AS n, round(avg(abs(d - (sd - d) / (c - 1))), 4) AS mae FROM t, (SELECT sum(d) AS sd, count(*) AS c FROM t)""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the others is (sum - own) / (n - 1): no loop."""
    s = series(spark, sf_dir)
    t = s.filter("seg = 'AUTOMOBILE'").select("y", F.col("v").alias("a")).join(s.filter("seg = 'BUILDING'").select("y", F.col("v").alias("b")), "y").withColumn("d", F.col("a") - F.col("b"))
    w = Window.partitionBy(F.lit(0))
    t = t.withColumns({"sd": F.sum("d").over(w), "c": F.count("*").over(w)})
    return t.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("d") - (F.col("sd") - F.col("d")) / (F.col("c") - 1))), 4).alias("mae"))


@query("A21_error_summary", SERIES_SQL + "SELECT c.seg, count(*) AS n, round(avg(abs(c.v - p.v)), 2) AS mae, round(avg(p.v - c.v), 2) AS bias, round(max(abs(c.v - p.v)), 2) AS worst FROM s c JOIN s p ON c.seg = p.seg AND c.y = p.y + 1 GROUP BY 1")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of carrying the last year forward, by segment."""
    e = two_periods(series(spark, sf_dir), ["seg"], ["v"]).withColumn("e", F.col("v_prev") - F.col("v"))
    return e.groupBy("seg").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 2).alias("mae"), F.round(F.avg("e"), 2).alias("bias"), F.round(F.max(F.abs("e")), 2).alias("worst"))


@query("A22_weighted_percentile", """
WITH m AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS tot FROM m)
SELECT l_returnflag, round(min(v) FILTER (run >= tot * 0.5), 2) AS p50, round(min(v) FILTER (run >= tot * 0.9), 2) AS p90 FROM r GROUP BY 1""")
def weighted_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    p = weighted_percentiles(li, "l_extendedprice", "l_quantity", {"p50": 50, "p90": 90}, ["l_returnflag"])
    return p.select("l_returnflag", F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"))


HASH = "(concat('0x', substr(md5(concat_ws('~', {0})), 1, 8))::BIGINT / 4294967296.0)"


@query("A23_draw_summaries", f"""
WITH d AS (SELECT draw, c_custkey, {HASH.format("'a23', draw, c_custkey")} AS u, c_acctbal FROM customer, (SELECT unnest(range(0, 8)) AS draw))
SELECT draw::BIGINT AS draw, round(median(u), 6) AS med, round(median(CASE WHEN u > 0.5 THEN u END), 6) AS masked, round(sum(u * abs(c_acctbal)) / sum(abs(c_acctbal)), 6) AS weighted FROM d GROUP BY 1""")
def draw_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries_of_draws(table(spark, sf_dir, "customer"))


def summaries_of_draws(customers: DataFrame) -> DataFrame:
    c = customers.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(7))))
    d = c.withColumn("u", uniform("a23", F.col("draw"), F.col("c_custkey")))
    w = F.abs("c_acctbal")
    d = d.withColumn("draw", F.col("draw").cast("long"))
    stats = with_percentiles(d.groupBy("draw").agg(F.round(F.sum(F.col("u") * w) / F.sum(w), 6).alias("weighted")), d, ["draw"], "u", {"m": 0.5})
    return with_percentiles(stats, d.filter("u > 0.5"), ["draw"], "u", {"above": 0.5}).select("draw", F.round("m", 6).alias("med"), F.round("above", 6).alias("masked"), "weighted")


@query("A24_variance_split", """
WITH g AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1),
t AS (SELECT sum(n * m) / sum(n) AS mm FROM g)
SELECT round(sqrt(sum(n * v) / sum(n)), 4) AS within, round(sqrt(sum(n * pow(m - mm, 2)) / sum(n)), 4) AS between_groups FROM g, t""")
def variance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"), F.var_pop("c_acctbal").alias("v"))
    n, m = F.col("n"), F.col("m")
    return g.agg(F.round(F.sqrt(F.sum(n * F.col("v")) / F.sum(n)), 4).alias("within"), F.round(F.sqrt(F.sum(n * m * m) / F.sum(n) - F.pow(F.sum(n * m) / F.sum(n), 2)), 4).alias("between_groups"))


@query("A25_marginal_effect", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS effect FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[a], [b]], a, b).agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("effect"))


@query("A26_two_level_report", "SELECT p_brand, p_size % 5 AS beds, grouping(p_size % 5)::BIGINT AS is_total, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY GROUPING SETS ((p_brand), (p_brand, p_size % 5))")
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("beds", F.col("p_size") % 5)
    a, b = F.col("p_brand"), F.col("beds")
    return p.groupingSets([[a], [a, b]], a, b).agg(F.grouping("beds").cast("long").alias("is_total"), F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("A27_inverse_error_weights", SERIES_SQL.rstrip() + """,
e AS (SELECT c.seg, c.y, abs(c.v - p.v) AS e, row_number() OVER (PARTITION BY c.seg ORDER BY c.y DESC) - 1 AS k FROM s c JOIN s p ON c.seg = p.seg AND c.y = p.y + 1),
d AS (SELECT seg, sum(pow(0.5, k) * e) / sum(pow(0.5, k)) AS decayed FROM e GROUP BY 1)
SELECT seg, round(decayed, 2) AS decayed, round((1 / decayed) / sum(1 / decayed) OVER (), 6) AS w FROM d""")
def inverse_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = two_periods(series(spark, sf_dir), ["seg"], ["v"]).withColumn("e", F.abs(F.col("v") - F.col("v_prev")))
    e = e.withColumn("p", F.pow(F.lit(0.5), F.row_number().over(Window.partitionBy("seg").orderBy(F.desc("y"))) - 1))
    d = e.groupBy("seg").agg((F.sum(F.col("p") * F.col("e")) / F.sum("p")).alias("d"))
    return d.select("seg", F.round("d", 2).alias("decayed"), F.round((1 / F.col("d")) / F.sum(1 / F.col("d")).over(Window.partitionBy(F.lit(0))), 6).alias("w"))


@query("A28_shrunk_mean", "SELECT c_nationkey::BIGINT AS nation, round(sum(c_acctbal) / (count(*) + 10), 4) AS shrunk FROM customer GROUP BY 1")
def shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.round(F.sum("c_acctbal") / (F.count("*") + 10), 4).alias("shrunk"))


@query("A29_slope_origin", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(q * F.col("l_extendedprice")) / F.sum(q * q), 4).alias("slope"))


@query("A30_indicator_suppressed", """
WITH x AS (SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS segment, c_custkey % 3 AS third, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS b FROM customer),
c AS (SELECT nation, segment, third, count(*) FILTER (b > 5000) AS num, count(*) FILTER (b IS NOT NULL) AS den, count(*) FILTER (b IS NULL) AS missing FROM x GROUP BY ALL)
SELECT nation, segment, third, CASE WHEN num > 0 AND num < 5 THEN NULL ELSE num END AS numerator, CASE WHEN den > 0 AND den < 5 THEN NULL ELSE den END AS denominator, missing, (num > 0 AND num < 5) OR (den > 0 AND den < 5) AS withheld FROM c""")
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 3).alias("third"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("b"))
    return x.groupBy("nation", "segment", "third").agg(*[v.alias(k) for k, v in indicator(F.col("b") > 5000, F.col("b").isNotNull()).items()])


@query("A31_kind_inference", """
SELECT event_type, bool_and(regexp_matches(props, '^\\{"k": [0-9]+\\}$')) AS all_json, min(regexp_extract(props, '([0-9]+)', 1)::BIGINT) AS lo, max(regexp_extract(props, '([0-9]+)', 1)::BIGINT) AS hi,
       CASE WHEN bool_and(regexp_matches(props, '[0-9]')) THEN 'number' ELSE 'text' END AS kind FROM events GROUP BY 1""")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("props", r"([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.bool_and(F.col("props").rlike(r'^\{"k": [0-9]+\}$')).alias("all_json"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.when(F.bool_and(F.col("props").rlike("[0-9]")), "number").otherwise("text").alias("kind"))


SCORED_SQL = "WITH z AS (SELECT doc_id, quality, lang, least(0.99, n_chars / (n_chars + 1000.0)) AS p FROM labels JOIN documents USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a deterministic score from the length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    p = F.least(F.lit(0.99), F.col("n_chars") / (F.col("n_chars") + 1000.0))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "quality", "lang", p.alias("p"))


@query("A32_grouped_scorer", f"{SCORED_SQL} SELECT coalesce(lang, 'all') AS grp, count(*) AS n, count(*) FILTER ((p >= 0.5) = (quality = 1)) AS hits, count(*) FILTER (p >= 0.9 AND quality = 0) AS wrong_accepted FROM z GROUP BY GROUPING SETS ((), (lang))")
def grouped_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, lang = scored(spark, sf_dir), F.col("lang")
    p, q = F.col("p"), F.col("quality")
    r = z.groupingSets([[], [lang]], lang).agg(F.count("*").alias("n"), F.count_if((p >= 0.5) == (q == 1)).alias("hits"), F.count_if((p >= 0.9) & (q == 0)).alias("wrong_accepted"))
    return r.select(F.coalesce("lang", F.lit("all")).alias("grp"), "n", "hits", "wrong_accepted")


@query("A33_calibration_error", f"{SCORED_SQL}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS c, avg(quality) AS a FROM z GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_error(scored(spark, sf_dir), "p", "quality").select(F.round("ece", 6).alias("ece"))


@query("A34_choose_threshold", f"{SCORED_SQL}, r AS (SELECT p, avg(quality) OVER (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) AS acc FROM z) SELECT round(min(p), 6) AS tau FROM r WHERE acc >= 0.8")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running accuracy over labelled rows, most confident first."""
    runs = running(scored(spark, sf_dir), [], [F.desc("p"), F.col("doc_id")], {"right": "quality", "seen": F.lit(1)})
    return runs.filter(F.col("right") / F.col("seen") >= 0.8).agg(F.round(F.min("p"), 6).alias("tau"))


@query("A35_band_table", "SELECT CASE WHEN p_size < 10 THEN '<10' WHEN p_size < 35 THEN '10-34' ELSE '35+' END AS band, p_brand, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(p_retailprice), 4) END AS mean FROM part GROUP BY 1, 2")
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").groupBy(F.when(s < 10, "<10").when(s < 35, "10-34").otherwise("35+").alias("band"), "p_brand").agg(F.count("*").alias("n"), F.when(F.count("*") >= 20, F.round(F.avg("p_retailprice"), 4)).alias("mean"))


@query("A36_confusion_matrix", f"{READINGS_SQL}, s AS (SELECT event_type, {STATUS_SQL} AS s FROM r) SELECT event_type, round(avg((s = 'KNOWN')::INT), 6) AS known, round(avg((s = 'TO_REVIEW')::INT), 6) AS to_review, round(avg((s = 'ILLEGIBLE')::INT), 6) AS illegible, round(avg((s = 'NOT_SUPPLIED')::INT), 6) AS not_supplied FROM s GROUP BY 1")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"KNOWN": "known", "TO_REVIEW": "to_review", "ILLEGIBLE": "illegible", "NOT_SUPPLIED": "not_supplied"}
    c = readings(spark, sf_dir).withColumn("s", status_for(F.col("v"), F.col("conf"))).groupBy("event_type").pivot("s", list(names)).count().fillna(0)
    total = sum((F.col(k) for k in names), F.lit(0))
    return c.select("event_type", *[F.round(F.col(k) / total, 6).alias(v) for k, v in names.items()])


VOTES_SQL = "WITH v AS (SELECT l_orderkey AS item, l_returnflag AS said, l_linenumber::BIGINT AS engine FROM lineitem)"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("said"), F.col("l_linenumber").cast("long").alias("engine"))


@query("A37_majority_vote", f"{VOTES_SQL} SELECT item, said, n FROM (SELECT item, said, count(*) AS n, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, min(engine), said DESC) AS r FROM v GROUP BY 1, 2) WHERE r = 1")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most votes; among equals the value of the engine with the highest priority."""
    c = votes(spark, sf_dir).groupBy("item", "said").agg(F.count("*").alias("n"), (-F.min("engine")).alias("p"))
    return c.groupBy("item").agg(F.max(F.struct("n", "p", "said")).alias("b")).select("item", "b.said", "b.n")


@query("A38_group_gaps", f"{SCORED_SQL} SELECT round(avg((p >= 0.5)::INT) FILTER (lang = 'en') - avg((p >= 0.5)::INT) FILTER (lang <> 'en'), 6) AS rate_gap, round(avg((p >= 0.5)::INT) FILTER (lang = 'en' AND quality = 1) - avg((p >= 0.5)::INT) FILTER (lang <> 'en' AND quality = 1), 6) AS opportunity_gap FROM z")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, en, good = (F.col("p") >= 0.5).cast("int"), F.col("lang") == "en", F.col("quality") == 1
    of = lambda c: F.avg(F.when(c, said))
    return scored(spark, sf_dir).agg(F.round(of(en) - of(~en), 6).alias("rate_gap"), F.round(of(en & good) - of(~en & good), 6).alias("opportunity_gap"))


@query("A39_auc", f"""{SCORED_SQL}, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS mid FROM z),
a AS (SELECT lang, (sum(mid) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / nullif(sum(quality) * (count(*) - sum(quality)), 0) AS auc FROM r GROUP BY 1)
SELECT lang, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS proxy FROM a""")
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("auc")
    return auc(scored(spark, sf_dir), "p", "quality", ["lang"]).select("lang", F.round(a, 6).alias("auc"), F.round(F.greatest(a, 1 - a), 6).alias("proxy"))


@query("A40_binary_metrics", f"""{SCORED_SQL}, c AS (SELECT count(*) AS n, sum(((p >= 0.5) = (quality = 1))::INT) AS hits, sum((p >= 0.5 AND quality = 1)::INT) AS tp, sum((p >= 0.5 AND quality = 0)::INT) AS fp, sum((p < 0.5 AND quality = 1)::INT) AS fn, sum((p < 0.5 AND quality = 0)::INT) AS tn, -avg(quality * ln(p) + (1 - quality) * ln(1 - p)) AS ll, avg(pow(p - quality, 2)) AS br FROM z)
SELECT round(hits / n, 6) AS accuracy, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1, round(ll, 6) AS log_loss, round(br, 6) AS brier,
       round((hits / n + 1.9208 / n - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) AS low, round((hits / n + 1.9208 / n + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) AS high FROM c""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scored(spark, sf_dir)
    q = F.col("quality")
    low, high = wilson(F.count_if((F.col("p") >= 0.5) == (q == 1)), F.count("*"))
    return z.agg(*[F.round(v, 6).alias(k) for k, v in binary_metrics(q, F.col("p")).items()], F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("A41_group_correlations", "SELECT l_returnflag, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_quantity, l_tax), 6) AS quantity_tax, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem GROUP BY 1")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda a, b: F.round(F.corr(f"l_{a}", f"l_{b}"), 6).alias(f"{a}_{b}")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(pair("quantity", "discount"), pair("quantity", "tax"), pair("discount", "tax"))


@query("A42_binned_rate", f"{SCORED_SQL}, b AS (SELECT ceil(p * 5)::BIGINT AS bin, count(*) AS n, avg(quality) AS r FROM z WHERE p > 0 AND p <= 1 GROUP BY 1) SELECT bin, n, round(r, 6) AS rate, round(sqrt(r * (1 - r) / n), 6) AS se FROM b")
def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins are closed on the right; what is outside has none."""
    b = scored(spark, sf_dir).filter("p > 0 and p <= 1").groupBy(F.ceil(F.col("p") * 5).alias("bin")).agg(F.count("*").alias("n"), F.avg("quality").alias("r"))
    return b.select("bin", "n", F.round("r", 6).alias("rate"), F.round(F.sqrt(F.col("r") * (1 - F.col("r")) / F.col("n")), 6).alias("se"))


@query("A43_vote_stability", f"""
WITH s AS (SELECT c_custkey, seed, ({HASH.format("'a43', seed, c_custkey")} + c_acctbal / 10000 > 0.9)::INT AS vote FROM customer, (SELECT unnest(range(0, 10)) AS seed)),
t AS (SELECT c_custkey, sum(vote) AS v FROM s GROUP BY 1)
SELECT round(avg((v IN (0, 10))::INT), 6) AS unanimous, count(*) FILTER (v NOT IN (0, 10)) AS split, count(*) FILTER (v = 5) AS even FROM t""")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    t = s.groupBy("c_custkey").agg(F.sum((uniform("a43", F.col("seed"), F.col("c_custkey")) + F.col("c_acctbal") / 10000 > 0.9).cast("int")).alias("v"))
    sure = F.col("v").isin(0, 10)
    return t.agg(F.round(F.avg(sure.cast("int")), 6).alias("unanimous"), F.count_if(~sure).alias("split"), F.count_if(F.col("v") == 5).alias("even"))


@query("A44_status_counts", "SELECT user_id, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["error", "purchase", "view"]).count().fillna(0)


@query("A45_coverage_by_type", """
SELECT t, sum(a)::BIGINT AS parts, sum(b)::BIGINT AS lines, sum(c)::BIGINT AS big FROM (
  SELECT p_type AS t, 1 AS a, 0 AS b, 0 AS c FROM part UNION ALL SELECT p_type, 0, 1, (l_quantity > 25)::INT FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("t"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey"))
    parts = p.groupBy("t").agg(F.count("*").alias("parts"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("big"))
    lines = li.groupBy("t").agg(F.lit(0).cast("long").alias("parts"), F.count("*").alias("lines"), F.count_if(F.col("l_quantity") > 25).alias("big"))
    return parts.unionByName(lines).groupBy("t").agg(*[F.sum(c).alias(c) for c in ("parts", "lines", "big")])


@query("A46_level_votes", "SELECT l_linenumber::BIGINT AS a, (p_size % 7)::BIGINT AS b, count(*) FILTER (l_quantity > 25) AS conform FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def level_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 7).cast("long").alias("b"))
    return table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_linenumber").cast("long").alias("a"), "b").agg(F.count_if(F.col("l_quantity") > 25).alias("conform"))


@query("A47_placement_modes", "SELECT bx, by_, n, round(mean, 4) AS mean FROM (SELECT floor(l_extendedprice / 5000)::BIGINT AS bx, floor(l_quantity / 10)::BIGINT AS by_, count(*) AS n, avg(l_discount) AS mean FROM lineitem GROUP BY 1, 2) ORDER BY n DESC, bx, by_ LIMIT 5")
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five fullest cells: a top-k report."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).alias("bx"), F.floor(F.col("l_quantity") / 10).alias("by_")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean"))
    return g.orderBy(F.desc("n"), "bx", "by_").limit(5)


@query("A48_premium", CELLS_SQL + ", l AS (SELECT y, sum(total) / sum(n) AS lvl FROM cell GROUP BY 1) SELECT c.y, brand, beds, round(mean / lvl - 1, 6) AS premium FROM cell c JOIN l ON c.y = l.y + 1 WHERE c.n >= 30")
def premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    level = c.groupBy((F.col("y") + 1).alias("y")).agg((F.sum("total") / F.sum("n")).alias("lvl"))
    return c.filter("n >= 30").join(level, "y").select("y", "brand", "beds", F.round(F.col("mean") / F.col("lvl") - 1, 6).alias("premium"))


@query("A49_disagreement", SERIES_SQL + "SELECT y, round(max(v) - min(v), 2) AS disagreement FROM s GROUP BY 1")
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).groupBy("y").agg(F.round(F.max("v") - F.min("v"), 2).alias("disagreement"))


@query("A50_scored_funnel", "SELECT coalesce(lang, 'Total') AS grp, count(*) AS known, count(*) FILTER (n_chars > 500) AS read, count(*) FILTER (n_chars > 1500) AS extracted, count(*) FILTER (n_chars > 5000) AS reported FROM documents GROUP BY ROLLUP (lang)")
def scored_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").rollup("lang").agg(F.count("*").alias("known"), F.count_if(n > 500).alias("read"), F.count_if(n > 1500).alias("extracted"), F.count_if(n > 5000).alias("reported")).select(F.coalesce("lang", F.lit("Total")).alias("grp"), "known", "read", "extracted", "reported")


@query("A51_grid_axes", "SELECT p_size::BIGINT AS label, count(*) AS n, round(avg(p_retailprice), 4) AS pos FROM part GROUP BY 1 HAVING max(p_retailprice) - min(p_retailprice) <= 1000")
def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated label is an axis only if its places agree."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("pos"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("d"))
    return g.filter("d <= 1000").drop("d")


@query("A52_vocabulary", "SELECT p_type, string_agg(DISTINCT w, ' ' ORDER BY w) AS vocab FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("w"))
    return w.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("vocab"))


@query("A53_shape_histogram", "SELECT shape, n FROM (SELECT regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 5) ORDER BY n DESC, shape LIMIT 14")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only shapes shared by five or more, the 14 most frequent: a report that names nobody."""
    shape = F.regexp_replace(F.regexp_replace("c_name", "[0-9]", "9"), "[A-Za-z]", "A")
    return table(spark, sf_dir, "customer").groupBy(shape.alias("shape")).agg(F.count("*").alias("n")).filter("n >= 5").orderBy(F.desc("n"), "shape").limit(14)


@query("A54_forensics", """
WITH x AS (SELECT c_custkey, c_acctbal AS a, c_nationkey AS b FROM customer),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x),
v AS (SELECT a, sum((c_custkey % 2 = 0)::INT) AS n0, sum((c_custkey % 2 = 1)::INT) AS n1 FROM x GROUP BY 1),
f AS (SELECT sum(n0) OVER w / sum(n0) OVER () AS f0, sum(n1) OVER w / sum(n1) OVER () AS f1 FROM v WINDOW w AS (ORDER BY a ROWS UNBOUNDED PRECEDING))
SELECT round((SELECT corr(ra, rb) FROM r), 6) AS spearman, round((SELECT max(abs(f0 - f1)) FROM f), 6) AS ks""")
def forensics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation and the two-sample Kolmogorov-Smirnov distance, from counts of each value: the running sums have one row a value."""
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))

    def mid(c: str) -> DataFrame:
        n = x.groupBy(c).agg(F.count("*").alias("n"))
        return running(n, [], [F.col(c)], {"upto": "n"}).select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    rho = x.join(mid("a"), "a").join(mid("b"), "b").agg(F.round(F.corr("ra", "rb"), 6).alias("spearman"))
    v = x.groupBy("a").agg(*[F.sum((F.col("c_custkey") % 2 == i).cast("int")).alias(f"n{i}") for i in (0, 1)])
    runs = running(v, [], [F.col("a")], {"r0": "n0", "r1": "n1"}, {"t0": "r0", "t1": "r1"})
    ks = runs.agg(F.round(F.max(F.abs(F.col("r0") / F.col("t0") - F.col("r1") / F.col("t1"))), 6).alias("ks"))
    return rho.crossJoin(ks)
