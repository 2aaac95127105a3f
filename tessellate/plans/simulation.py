"""Bootstrap, cohorts, scenarios and forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.draws import IN_PLACE, LANES, Lanes, Units, as_uniform, below, blocks, for_stretches
from ..operators.running import largest_group, percentiles, with_percentiles
from ..operators.simulate import cluster_bootstrap_median, poisson_steps, poisson_weight, regulated
from ..operators.weighted import uniform, weighted_percentiles
from ..registry import query, table
from ..session import cut
from .aggregates import HASH
from .joins import SERIES_SQL, series
from .projections import PAIRS_SQL, notice_share_before, pairs

#: Counts of draws.
N_BOOTSTRAP, N_SIMULATIONS = 1000, 5000
SCENARIOS = (("low", 0.02, 0.25), ("mid", 0.05, 0.5), ("high", 0.09, 0.25))
POISSON_SQL = "CASE " + " ".join(f"WHEN u < {t!r} THEN {k}" for k, t in enumerate(poisson_steps())) + f" ELSE {len(poisson_steps())} END"


def more_draws(sql: str, few: int, many: int) -> str:
    return sql.replace(f"unnest(range(0, {few})) AS draw", f"unnest(range(0, {many})) AS draw")


BOOT_SQL = PAIRS_SQL.rstrip() + f""",
d AS (SELECT draw, growth AS v, {POISSON_SQL} AS w FROM (SELECT draw, growth, {HASH.format("'m01', draw, o_custkey")} AS u FROM p, (SELECT unnest(range(0, 8)) AS draw) WHERE is_valid AND y = 1998)),
m AS (SELECT draw, v, sum(w) AS w FROM d WHERE w > 0 GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY draw ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY draw) AS tot FROM m),
b AS (SELECT draw::BIGINT AS draw, min(v) FILTER (run >= tot * 0.5) AS med FROM r GROUP BY 1)
"""


def bootstrap(spark: SparkSession, sf_dir: str, draws: int = N_BOOTSTRAP) -> DataFrame:
    p = pairs(spark, sf_dir).filter("is_valid and y = 1998").select("o_custkey", "growth")
    return cluster_bootstrap_median(p, "o_custkey", "growth", draws, "m01").select(F.col("draw").cast("long").alias("draw"), F.col("percentile").alias("med"))


@query("M01_cluster_bootstrap", more_draws(BOOT_SQL, 8, N_BOOTSTRAP) + "SELECT draw, round(med, 4) AS med FROM b")
def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap(spark, sf_dir).select("draw", F.round("med", 4).alias("med"))


@query("M02_interval_width", more_draws(BOOT_SQL, 8, N_BOOTSTRAP) + "SELECT round(quantile_cont(med, 0.95) - quantile_cont(med, 0.05), 4) AS width FROM b")
def width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(bootstrap(spark, sf_dir), [], "med", {"low": 0.05, "high": 0.95}).select(F.round(F.col("high") - F.col("low"), 4).alias("width"))


@query("M03_row_bootstrap_ratio")
def row_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in every draw; without SQL, which is too slow for so many (row_ratios is tested with few)."""
    return row_ratios(table(spark, sf_dir, "lineitem"))


def row_ratios(lines: DataFrame, draws: int = N_BOOTSTRAP) -> DataFrame:
    d = lines.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    w = poisson_weight(uniform("m03", F.col("draw"), F.col("l_orderkey"), F.col("l_linenumber")))
    return d.withColumn("w", w).groupBy(F.col("draw").cast("long").alias("draw")).agg(F.round(F.sum(F.col("w") * F.col("l_discount")) / F.sum(F.col("w") * F.col("l_tax")), 6).alias("ratio"))


COHORT_SQL = """
WITH last AS (SELECT o_custkey AS unit, max(o_orderdate)::DATE AS d, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS pr FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1),
cohort AS (SELECT * FROM last WHERE d >= DATE '2000-01-01')
"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's last known record, if the next one starts in the year of interest."""
    by = F.struct("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    last = o.groupBy(F.col("o_custkey").alias("unit")).agg(F.max("o_orderdate").cast("date").alias("d"), F.max_by("o_totalprice", by).alias("v"), F.max_by("o_orderpriority", by).alias("pr"))
    return last.filter("d >= date '2000-01-01'")


@query("M07_cohort", COHORT_SQL + "SELECT unit, strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') AS next_start, v, pr FROM cohort")
def cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).select("unit", F.date_format(F.date_add("d", 1), "yyyy-MM-dd").alias("next_start"), "v", "pr")


@query("M08_renewal_probability", PAIRS_SQL + """
SELECT o_orderpriority AS pr, n, round(CASE WHEN n >= 500 THEN r ELSE (SELECT avg(is_renewal::INT) FROM p WHERE NOT no_previous) END, 6) AS prob FROM (SELECT o_orderpriority, count(*) AS n, avg(is_renewal::INT) AS r FROM p WHERE NOT no_previous GROUP BY 1)""")
def renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By group where it is reliable, else pooled."""
    p = pairs(spark, sf_dir).filter("not no_previous").withColumn("r", F.col("is_renewal").cast("int"))
    g = p.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("r").alias("r"), F.sum("r").alias("s"))
    w = Window.partitionBy(F.lit(0))
    return g.select(F.col("o_orderpriority").alias("pr"), "n", F.round(F.when(F.col("n") >= 500, F.col("r")).otherwise(F.sum("s").over(w) / F.sum("n").over(w)), 6).alias("prob"))


@query("M09_penetration_sensitivity", "WITH a AS (SELECT year(l_shipdate)::BIGINT AS y, avg((l_discount > 0)::INT) AS pen, avg(l_discount) AS drag FROM lineitem GROUP BY 1), k AS (SELECT y, -ln(1 - pen) / drag AS k, row_number() OVER (ORDER BY y DESC) AS n FROM a WHERE pen < 1) SELECT round(avg(k), 4) AS k FROM k WHERE n <= 3")
def penetration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    a = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("y")).agg(F.avg((d > 0).cast("int")).alias("pen"), F.avg(d).alias("drag")).filter("pen < 1")
    k = a.orderBy(F.desc("y")).limit(3).select((-F.ln(1 - F.col("pen")) / F.col("drag")).alias("k"))
    return k.agg(F.round(F.avg("k"), 4).alias("k"))


POOL_SQL = "pool AS (SELECT o_orderpriority AS pr, list(x ORDER BY x) AS xs FROM (SELECT DISTINCT o_orderpriority, l_discount AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0) GROUP BY 1)"


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positive discounts of each priority, distinct and sorted: a handful of values a group."""
    li = table(spark, sf_dir, "lineitem").filter("l_discount > 0").select("l_orderkey", "l_discount")
    j = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("pr")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("pr").agg(F.array_sort(F.collect_set("l_discount")).alias("xs"))


@query("M10_two_margin_draw", COHORT_SQL.rstrip() + f""", {POOL_SQL},
d AS (SELECT draw, unit, {HASH.format("'ext', draw, unit")} AS u1, {HASH.format("'int', draw, unit")} AS u2, xs FROM cohort JOIN pool USING (pr), (SELECT unnest(range(0, {N_SIMULATIONS})) AS draw))
SELECT draw::BIGINT AS draw, unit, CASE WHEN u1 < 0.7 THEN xs[1 + least(floor(u2 * len(xs)), len(xs) - 1)::INT] ELSE 0.0 END AS drag FROM d""")
def two_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether, and how deep: the depth is drawn from the group's own pool."""
    return margins(spark, sf_dir)


def margins(spark: SparkSession, sf_dir: str, draws: int = N_SIMULATIONS) -> DataFrame:
    """Each task draws for its units, which are dealt out evenly."""
    c = cohort(spark, sf_dir).join(pools(spark, sf_dir), "pr").select("unit", "xs")
    unit = c.schema["unit"].dataType.simpleString()
    return c.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(lambda batches: depths(batches, draws), f"draw long, unit {unit}, drag double")


def depths(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[pa.RecordBatch]:
    """For batches of unit and pool (xs): draw, unit and the depth, which is hashed only where there is one."""
    for batch in (b.slice(k, LANES) for b in batches for k in range(0, b.num_rows, LANES)):
        units, xs = batch["unit"], batch["xs"]
        lanes, starts, sizes = Lanes(units), xs.offsets.to_numpy()[:-1], xs.value_lengths().to_numpy()
        values = xs.values.to_numpy(zero_copy_only=False)
        for first, count in blocks(0, draws, lanes.n):
            some, drag = lanes.bits("ext", first, count) < below(0.7), np.zeros((count, lanes.n))
            which = np.nonzero(some)[1]
            place = np.minimum((as_uniform(lanes.bits("int", first, count, some)) * sizes[which]).astype(np.int64), sizes[which] - 1)
            drag[some] = values[starts[which] + place]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, first + count), lanes.n)), units.take(pa.array(np.tile(np.arange(lanes.n), count))), pa.array(drag.ravel())], ["draw", "unit", "drag"])


SIM_SQL = COHORT_SQL.rstrip() + f""",
s AS (
  SELECT sc, draw, unit, v, {HASH.format("'renew', draw, unit")} < 0.65 AS renew, base + 0.04 * ({HASH.format("'growth', draw, unit")} - 0.5) AS g
  FROM cohort, (SELECT unnest(range(0, 10)) AS draw), (VALUES ('low', 0.02, 0.25), ('mid', 0.05, 0.5), ('high', 0.09, 0.25)) AS t(sc, base, weight)),
e AS (SELECT sc, draw, unit, v, renew, 100 * CASE WHEN renew THEN least(g, 0.06) ELSE g END AS growth FROM s),
dr AS (SELECT sc, draw, median(growth) AS med, avg(renew::INT) AS renewals, sum(v * growth) / sum(v) AS weighted FROM e GROUP BY 1, 2)
"""


def simulated(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The cohort in every draw and scenario. The scenario is not part of the hash key: the scenarios have common random numbers."""
    sc = F.explode(F.array(*[F.struct(F.lit(name).alias("sc"), F.lit(b).alias("base"), F.lit(w).alias("weight")) for name, b, w in SCENARIOS]))
    d = cohort(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("s", sc)
    u = lambda tag: uniform(tag, F.col("draw"), F.col("unit"))
    d = d.select(F.col("s.sc").alias("sc"), F.col("s.weight").alias("weight"), F.col("draw").cast("long").alias("draw"), "unit", "v", (u("renew") < 0.65).alias("renew"), (F.col("s.base") + 0.04 * (u("growth") - 0.5)).alias("g"))
    return d.withColumn("growth", 100 * regulated(F.col("g"), F.lit(0.06), F.col("renew")))


def draws(spark: SparkSession, sf_dir: str, n: int = N_SIMULATIONS) -> DataFrame:
    """Per scenario and draw: the median, the share of renewals and the weighted mean of the cohort's growth. A cohort that a task can hold is drawn in place, each task
    with a stretch of the draws; a larger one as rows."""
    c = cut(cohort(spark, sf_dir).select("unit", "v"))
    if largest_group(c, []) > IN_PLACE:
        g, v, d = F.col("growth"), F.col("v"), simulated(spark, sf_dir, n)
        stats = d.groupBy("sc", "draw").agg(F.avg(F.col("renew").cast("int")).alias("renewals"), (F.sum(v * g) / F.sum(v)).alias("weighted"), F.first("weight").alias("weight"))
        return with_percentiles(stats, d, ["sc", "draw"], "growth", {"med": 0.5})
    return for_stretches(c, n, outcomes, "sc string, draw long, med double, renewals double, weighted double, weight double")


def outcomes(units: pa.StructArray, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """The scenarios' outcomes for the draws from first to before last."""
    v, lanes, rows = units.field("v").to_numpy(zero_copy_only=False).astype(float), Units(units.field("unit")), []
    known = units.field("v").is_valid().to_numpy(zero_copy_only=False)
    v, total = np.where(known, v, 0.0), np.where(known, v, 0.0).sum()
    low, high = (lanes.n - 1) // 2, lanes.n // 2
    for at, count in blocks(first, last, lanes.n):
        renew, e = lanes.bits("renew", at, count) < below(0.65), 0.04 * (as_uniform(lanes.bits("growth", at, count)) - 0.5)
        renewals = renew.mean(axis=1)
        for sc, base, weight in SCENARIOS:
            g = base + e
            g = 100 * np.where(renew, np.minimum(g, 0.06), g)
            weighted = g @ v / total if known.any() else [None] * count
            g.partition((low, high), axis=1)
            rows += zip([sc] * count, range(at, at + count), ((g[:, low] + g[:, high]) / 2).tolist(), renewals.tolist(), [x if x is None else float(x) for x in weighted], [weight] * count, strict=True)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["sc", "draw", "med", "renewals", "weighted", "weight"])


@query("M11_cohort_simulation", more_draws(SIM_SQL, 10, N_SIMULATIONS) + "SELECT sc, draw::BIGINT AS draw, round(med, 6) AS med, round(renewals, 6) AS renewals, round(weighted, 6) AS weighted FROM dr")
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draws(spark, sf_dir).select("sc", "draw", *[F.round(c, 6).alias(c) for c in ("med", "renewals", "weighted")])


@query("M12_scenario_mixture", more_draws(SIM_SQL, 10, N_SIMULATIONS).rstrip() + f""",
w AS (SELECT med AS v, CASE sc WHEN 'mid' THEN 0.5 ELSE 0.25 END / {N_SIMULATIONS} AS w FROM dr),
r AS (SELECT v, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER () AS tot FROM (SELECT v, sum(w) AS w FROM w GROUP BY v))
SELECT round(min(v) FILTER (run >= tot * 0.310025), 6) AS p31, round(min(v) FILTER (run >= tot * 0.520025), 6) AS p52, round(min(v) FILTER (run >= tot * 0.870025), 6) AS p87 FROM r""")
def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenarios' draws pooled with their prior weights; quantiles between the steps of the weights, where rounding cannot matter."""
    return mixed(spark, sf_dir)


def mixed(spark: SparkSession, sf_dir: str, n: int = N_SIMULATIONS) -> DataFrame:
    d = draws(spark, sf_dir, n).select("med", (F.col("weight") / n).alias("w"))
    p = weighted_percentiles(d, "med", "w", {f"p{q}": q + 0.0025 for q in (31, 52, 87)}, [])
    return p.select(*[F.round(f"p{q}", 6).alias(f"p{q}") for q in (31, 52, 87)])


RULES_SQL = SERIES_SQL.rstrip() + """,
h AS (SELECT *, lag(v) OVER w AS l1, avg(v) OVER (PARTITION BY seg ORDER BY y ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3 FROM s WINDOW w AS (PARTITION BY seg ORDER BY y)),
f AS (SELECT seg, y, v, 'carry' AS rule, l1 AS forecast FROM h UNION ALL SELECT seg, y, v, 'mean3', m3 FROM h UNION ALL SELECT seg, y, v, 'half', (l1 + m3) / 2 FROM h)
"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rules side by side, one row for each: no loop over rules."""
    w = Window.partitionBy("seg").orderBy("y")
    h = series(spark, sf_dir).withColumns({"carry": F.lag("v").over(w), "mean3": F.avg("v").over(w.rowsBetween(-3, -1))}).withColumn("half", (F.col("carry") + F.col("mean3")) / 2)
    return h.unpivot(["seg", "y", "v"], ["carry", "mean3", "half"], "rule", "forecast")


@query("M13_candidate_rules", RULES_SQL + "SELECT seg, y, rule, round(forecast, 2) AS forecast FROM f WHERE forecast IS NOT NULL")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).filter("forecast is not null").select("seg", "y", "rule", F.round("forecast", 2).alias("forecast"))


@query("M14_backtest", RULES_SQL + "SELECT rule, count(*) AS n, round(avg(abs(forecast - v)), 2) AS mae, round(avg(forecast - v), 2) AS bias FROM f WHERE forecast IS NOT NULL AND y BETWEEN 1998 AND 2000 GROUP BY 1")
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir).filter("forecast is not null and y between 1998 and 2000")
    e = F.col("forecast") - F.col("v")
    return f.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 2).alias("mae"), F.round(F.avg(e), 2).alias("bias"))


@query("M15_best_baseline", RULES_SQL + "SELECT seg, rule FROM (SELECT seg, rule, row_number() OVER (PARTITION BY seg ORDER BY avg(abs(forecast - v)), rule) AS r FROM f WHERE forecast IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = forecasts(spark, sf_dir).filter("forecast is not null").groupBy("seg", "rule").agg(F.avg(F.abs(F.col("forecast") - F.col("v"))).alias("e"))
    return e.groupBy("seg").agg(F.min_by("rule", F.struct("e", "rule")).alias("rule"))


@query("M16_robustness", SIM_SQL + "SELECT cap, round(avg(CASE WHEN renew THEN least(g, cap) ELSE g END) * 100, 6) AS growth FROM s, (VALUES (0.04), (0.06), (0.08)) AS c(cap) WHERE sc = 'mid' GROUP BY 1")
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-runs under changed settings are rows of a parameter, not a loop."""
    s = simulated(spark, sf_dir).filter("sc = 'mid'").withColumn("cap", F.explode(F.array(*map(F.lit, (0.04, 0.06, 0.08)))))
    return s.groupBy("cap").agg(F.round(F.avg(regulated(F.col("g"), F.col("cap"), F.col("renew"))) * 100, 6).alias("growth"))


@query("M18_loss_to_lease", """
WITH c AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, year(l_shipdate)::BIGINT AS y, p_brand, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT y + 1 AS y, p_brand, median(v) AS med FROM c GROUP BY ALL)
SELECT l_orderkey, line, round(v / med - 1, 6) AS loss FROM c JOIN m USING (y, p_brand)""")
def loss_to_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value against its segment's median of the year before."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    c = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.year("l_shipdate").cast("long").alias("y"), "p_brand", F.col("l_extendedprice").alias("v"))
    m = percentiles(c.select((F.col("y") + 1).alias("y"), "p_brand", "v"), ["y", "p_brand"], "v", {"med": 0.5})
    return c.join(m, ["y", "p_brand"]).select("l_orderkey", "line", F.round(F.col("v") / F.col("med") - 1, 6).alias("loss"))


@query("M33_drift_index", """
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
b AS (SELECT l_shipdate < TIMESTAMP '1998-01-01' AS base, (l_extendedprice > e[1])::INT + (l_extendedprice > e[2])::INT + (l_extendedprice > e[3])::INT + (l_extendedprice > e[4])::INT AS bin FROM lineitem, q),
c AS (SELECT bin, count(*) FILTER (base) / sum(count(*) FILTER (base)) OVER () AS p, count(*) FILTER (NOT base) / sum(count(*) FILTER (NOT base)) OVER () AS q FROM b GROUP BY bin)
SELECT round(sum((p - q) * ln(p / q)), 8) AS psi FROM c""")
def drift_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The population stability index over the base period's quantile bins."""
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("base"))
    e = percentiles(li.filter("base"), [], "l_extendedprice", {f"e{i}": i / 5 for i in range(1, 5)}).select(F.array(*[f"e{i}" for i in range(1, 5)]).alias("e"))
    bin_ = sum(((F.col("l_extendedprice") > F.col("e")[i]).cast("int") for i in range(4)), F.lit(0))
    c = li.crossJoin(F.broadcast(e)).groupBy(bin_.alias("bin")).agg(F.count_if("base").alias("a"), F.count_if(~F.col("base")).alias("b"))
    w = Window.partitionBy(F.lit(0))
    p, q = F.col("a") / F.sum("a").over(w), F.col("b") / F.sum("b").over(w)
    return c.select(((p - q) * F.ln(p / q)).alias("x")).agg(F.round(F.sum("x"), 8).alias("psi"))


@query("R15_regulatory_cap", SIM_SQL + "SELECT sc, renew, round(avg(growth), 6) AS growth, count(*) AS n FROM e GROUP BY 1, 2")
def regulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulated(spark, sf_dir).groupBy("sc", "renew").agg(F.round(F.avg("growth"), 6).alias("growth"), F.count("*").alias("n"))


@query("R16_rent_anchor", COHORT_SQL.rstrip() + """,
w AS (SELECT unit, d, (d - INTERVAL 6 MONTH)::DATE AS f, (d - INTERVAL 3 MONTH)::DATE AS t FROM cohort)
SELECT unit, round(least(greatest(date_diff('day', f, DATE '2000-03-01') / date_diff('day', f, t), 0.0), 1.0) * 2.0 + (1 - least(greatest(date_diff('day', f, DATE '2000-03-01') / date_diff('day', f, t), 0.0), 1.0)) * 5.0, 6) AS uniform, CASE WHEN f < DATE '2000-03-01' THEN 2.0 ELSE 5.0 END::DOUBLE AS earliest, CASE WHEN t < DATE '2000-03-01' THEN 2.0 ELSE 5.0 END::DOUBLE AS latest FROM w""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of the old or the new regime by the notice date, in three readings."""
    cut = F.lit("2000-03-01").cast("date")
    rate = lambda m: (lambda s: s * 2.0 + (1 - s) * 5.0)(notice_share_before(F.col("d"), F.lit(12), cut, m))
    return cohort(spark, sf_dir).select("unit", *[F.round(rate(m), 6).alias(m) for m in ("uniform", "earliest", "latest")])
