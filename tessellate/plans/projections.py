"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pairs import pair_table
from ..operators.running import percentiles
from ..registry import query, table

PAIRS_SQL = """
WITH lagged AS (
  SELECT *, lag(o_orderdate) OVER w AS pd, lag(o_totalprice) OVER w AS pv, lag(o_orderpriority) OVER w AS pp
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
gaps AS (SELECT *, date_diff('day', pd::DATE, o_orderdate::DATE) / 365.25 AS gap FROM lagged),
flags AS (
  SELECT *, pd IS NULL AS no_previous, coalesce(o_totalprice <= 0 OR pv <= 0, false) AS bad_value, coalesce(gap <= 0.5 OR gap >= 2.5, false) AS bad_gap FROM gaps),
p AS (
  SELECT *, NOT (no_previous OR bad_value OR bad_gap) AS is_valid, o_orderpriority IS NOT DISTINCT FROM pp AS is_renewal,
         CASE WHEN NOT (no_previous OR bad_value OR bad_gap) THEN (pow(o_totalprice / pv, 1 / gap) - 1) * 100 END AS growth,
         year(o_orderdate)::BIGINT AS y FROM flags)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair_table(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")
    return p.withColumn("y", F.year("o_orderdate").cast("long"))


@query("P01_derived_columns", "SELECT l_orderkey, l_linenumber::BIGINT AS line, year(l_shipdate)::BIGINT AS y, round(1 - (l_extendedprice * (1 - l_discount)) / l_extendedprice, 6) AS concession_share FROM lineitem")
def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    effective = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.year("l_shipdate").cast("long").alias("y"), F.round(1 - effective / F.col("l_extendedprice"), 6).alias("concession_share"))


@query("P02_nearest_bucket", "SELECT p_partkey, CASE WHEN p_size <= 9 THEN 6 WHEN p_size <= 15 THEN 12 WHEN p_size <= 21 THEN 18 ELSE 24 END::BIGINT AS bucket FROM part")
def nearest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.array_min(F.transform(F.array(*map(F.lit, (6, 12, 18, 24))), lambda b: F.struct(F.abs(b - F.col("p_size")).alias("d"), b.alias("b"))))["b"]
    return table(spark, sf_dir, "part").select("p_partkey", near.cast("long").alias("bucket"))


@query("P03_surrogate_id", "SELECT o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS in_year, year(o_orderdate)::BIGINT AS y FROM orders")
def surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy(y).orderBy("o_orderdate", "o_orderkey")).cast("long").alias("in_year"), y.cast("long").alias("y"))


@query("P04_annualised_growth", PAIRS_SQL + "SELECT o_orderkey, round(growth, 4) AS growth FROM p WHERE is_valid")
def annualised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).filter("is_valid").select("o_orderkey", F.round("growth", 4).alias("growth"))


@query("P05_validity_flags", PAIRS_SQL + "SELECT o_orderkey, no_previous, bad_value, bad_gap, is_valid FROM p")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("o_orderkey", "no_previous", "bad_value", "bad_gap", "is_valid")


@query("P06_conditional_growth", PAIRS_SQL + "SELECT o_orderkey, round(growth, 4) AS growth, CASE WHEN is_renewal THEN round(growth, 4) END AS renewal_growth FROM p")
def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.round("growth", 4)
    return pairs(spark, sf_dir).select("o_orderkey", g.alias("growth"), F.when(F.col("is_renewal"), g).alias("renewal_growth"))


@query("P07_open_interval", "SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem WHERE l_discount > 0.02 AND l_discount < 0.07 AND l_quantity > 5 AND l_quantity < 20")
def open_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = F.col("l_discount"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").filter((d > 0.02) & (d < 0.07) & (q > 5) & (q < 20)).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("P08_outlier_policy", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders)
SELECT o_orderkey, round(greatest(least(o_totalprice, b), a), 4) AS winsorised, CASE WHEN o_totalprice BETWEEN a AND b THEN o_totalprice END AS trimmed FROM orders, q""")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantiles are one row, broadcast."""
    o = table(spark, sf_dir, "orders")
    v = F.col("o_totalprice")
    q = percentiles(o, [], "o_totalprice", {"a": 0.05, "b": 0.95})
    return o.crossJoin(F.broadcast(q)).select("o_orderkey", F.round(F.greatest(F.least(v, "b"), "a"), 4).alias("winsorised"), F.when(v.between(F.col("a"), F.col("b")), v).alias("trimmed"))


@query("P09_group_label", "SELECT c_custkey, CASE WHEN n_regionkey IN (0, 2) THEN 'remote' ELSE 'centre' END AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey")
def group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("n_regionkey").isin(0, 2), "remote").otherwise("centre").alias("grp"))


@query("P10_bands_with_unknown", "SELECT p_partkey, CASE WHEN x IS NULL THEN 'unknown' WHEN x < 10 THEN '<10' WHEN x < 20 THEN '10-19' WHEN x < 35 THEN '20-34' ELSE '35+' END AS band FROM (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_size END AS x FROM part)")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    band = F.when(x.isNull(), "unknown").when(x < 10, "<10").when(x < 20, "10-19").when(x < 35, "20-34").otherwise("35+")
    return table(spark, sf_dir, "part").select("p_partkey", band.alias("band"))


def status_for(value, confidence, high: float = 0.95, low: float = 0.6):
    """KNOWN from `high` on; TO_REVIEW between; ILLEGIBLE below; without a value NOT_SUPPLIED if sure of it."""
    return F.when(value.isNull() & (confidence >= high), "NOT_SUPPLIED").when(value.isNull(), "TO_REVIEW").when(confidence >= high, "KNOWN").when(confidence >= low, "TO_REVIEW").otherwise("ILLEGIBLE")


READINGS_SQL = "WITH r AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS v, (event_id * 7919 % 1000) / 1000.0 AS conf FROM events)"
STATUS_SQL = "CASE WHEN v IS NULL AND conf >= 0.95 THEN 'NOT_SUPPLIED' WHEN v IS NULL THEN 'TO_REVIEW' WHEN conf >= 0.95 THEN 'KNOWN' WHEN conf >= 0.6 THEN 'TO_REVIEW' ELSE 'ILLEGIBLE' END"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as field readings: some without a value, each with a confidence."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"), ((F.col("event_id") * 7919 % 1000) / 1000.0).alias("conf"))


@query("P11_status", f"{READINGS_SQL} SELECT event_id, {STATUS_SQL} AS status FROM r")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", status_for(F.col("v"), F.col("conf")).alias("status"))


@query("P12_status_guards", f"""{READINGS_SQL}, s AS (SELECT *, {STATUS_SQL} AS s FROM r)
SELECT event_id, CASE WHEN s = 'NOT_SUPPLIED' AND conf < 0.98 THEN 'TO_REVIEW' WHEN s = 'KNOWN' AND v > 400 THEN 'TO_REVIEW' ELSE s END AS status FROM s""")
def status_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unsure blank and a value that breaks its format are never accepted without review."""
    s = status_for(F.col("v"), F.col("conf"))
    guarded = F.when((s == "NOT_SUPPLIED") & (F.col("conf") < 0.98), "TO_REVIEW").when((s == "KNOWN") & (F.col("v") > 400), "TO_REVIEW").otherwise(s)
    return readings(spark, sf_dir).select("event_id", guarded.alias("status"))


@query("P13_page_verdict", f"""{READINGS_SQL}, page AS (SELECT user_id, avg(conf) AS score FROM r GROUP BY 1)
SELECT event_id, round(CASE WHEN score < 0.5 THEN least(conf, 0.9) ELSE conf END, 6) AS conf, CASE WHEN score < 0.5 AND ({STATUS_SQL}) = 'KNOWN' THEN 'TO_REVIEW' ELSE {STATUS_SQL} END AS status FROM r JOIN page USING (user_id)""")
def page_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's score caps its readings' confidence and demotes what it had accepted. The score is below 0.5 by whole thousandths: a sum of fractions that should be
    just 0.5 falls to either side by the order of rows. Readings without a page have no verdict."""
    r = readings(spark, sf_dir).filter("user_id is not null")
    page, thousandths = Window.partitionBy("user_id"), F.rint(F.col("conf") * 1000).cast("long")
    r = r.withColumn("low", F.sum(thousandths).over(page) < 500 * F.count("conf").over(page))
    s = status_for(F.col("v"), F.col("conf"))
    return r.select("event_id", F.round(F.when(F.col("low"), F.least("conf", F.lit(0.9))).otherwise(F.col("conf")), 6).alias("conf"), F.when(F.col("low") & (s == "KNOWN"), "TO_REVIEW").otherwise(s).alias("status"))


@query("P14_legal_window", "SELECT o_orderkey, (month(o_orderdate) >= 4 AND month(o_orderdate) <= 11) OR (month(o_orderdate) = 3 AND day(o_orderdate) >= 2) AS inside FROM orders")
def legal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, d = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", (((m >= 4) & (m <= 11)) | ((m == 3) & (d >= 2))).alias("inside"))


def notice_share_before(end, months, cut, mode: str = "uniform"):
    """The share of a lease's notice window that lies before a date. The window: 6 to 3 months before the end of a lease of at least 12
    months, 2 to 1 months before a shorter one's. earliest and latest: whether the window's first or last day lies before."""
    long = months >= 12
    first = F.when(long, F.add_months(end, -6)).otherwise(F.add_months(end, -2))
    last = F.when(long, F.add_months(end, -3)).otherwise(F.add_months(end, -1))
    if mode == "earliest":
        return (first < cut).cast("double")
    if mode == "latest":
        return (last < cut).cast("double")
    return F.least(F.greatest(F.datediff(cut, first) / F.datediff(last, first), F.lit(0.0)), F.lit(1.0))


@query("P15_notice_share", """
WITH l AS (SELECT o_orderkey, o_orderdate::DATE AS e, CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 12 END AS m FROM orders),
w AS (SELECT *, CASE WHEN m >= 12 THEN e - INTERVAL 6 MONTH ELSE e - INTERVAL 2 MONTH END::DATE AS f, CASE WHEN m >= 12 THEN e - INTERVAL 3 MONTH ELSE e - INTERVAL 1 MONTH END::DATE AS t FROM l)
SELECT o_orderkey, round(least(greatest(date_diff('day', f, DATE '1998-01-01') / date_diff('day', f, t), 0.0), 1.0), 6) AS uniform, (f < DATE '1998-01-01')::INT::DOUBLE AS earliest, (t < DATE '1998-01-01')::INT::DOUBLE AS latest FROM w""")
def notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m, cut = F.col("o_orderdate").cast("date"), F.when(F.col("o_orderkey") % 3 == 0, 6).otherwise(12), F.lit("1998-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(notice_share_before(e, m, cut), 6).alias("uniform"), notice_share_before(e, m, cut, "earliest").alias("earliest"), notice_share_before(e, m, cut, "latest").alias("latest"))


def relation(a, b, relative: float = 0.0, absolute: float = 0.0):
    """`?` if either is missing, `=` within the tolerance, else `!`."""
    return F.when(a.isNull() | b.isNull(), "?").when(F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(a) * relative), "=").otherwise("!")


COMPARE_SQL = "WITH c AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS p, l_quantity + (l_partkey % 5) - 2 AS s FROM lineitem)"


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity")).alias("p"), (F.col("l_quantity") + F.col("l_partkey") % 5 - 2).alias("s"))


@query("P16_tolerance_relation", f"{COMPARE_SQL} SELECT l_orderkey, line, CASE WHEN p IS NULL OR s IS NULL THEN '?' WHEN abs(p - s) <= greatest(1.0, abs(p) * 0.05) THEN '=' ELSE '!' END AS rel FROM c")
def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("l_orderkey", "line", relation(F.col("p"), F.col("s"), 0.05, 1.0).alias("rel"))


@query("P17_gap_severity", f"{COMPARE_SQL} SELECT l_orderkey, line, CASE WHEN s < p THEN 'critical' ELSE 'minor' END AS severity, CASE WHEN s < p THEN 'less' ELSE 'more' END AS direction, concat('qty ', p::BIGINT, ' -> ', s::BIGINT) AS text FROM c WHERE p <> s")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p"), F.col("s")
    text = F.format_string("qty %d -> %d", p.cast("long"), s.cast("long"))
    return compared(spark, sf_dir).filter(p != s).select("l_orderkey", "line", F.when(s < p, "critical").otherwise("minor").alias("severity"), F.when(s < p, "less").otherwise("more").alias("direction"), text.alias("text"))


@query("P18_known_at", "SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1")
def known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut-off is a plain comparison on the stored column, so it reaches the scan."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return o.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query("P19_vintage_cutoff", "SELECT y, v, strftime(CASE v WHEN 'december' THEN make_date(y - 1, 12, 31) WHEN 'january' THEN make_date(y, 1, 31) ELSE make_date(y - 1, 10, 31) END, '%Y-%m-%d') AS cutoff FROM (SELECT DISTINCT year(o_orderdate)::BIGINT AS y FROM orders), (VALUES ('december'), ('january'), ('october')) AS t(v)")
def vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y")).distinct()
    y = F.col("y").cast("int")
    day = F.when(F.col("v") == "december", F.make_date(y - 1, F.lit(12), F.lit(31))).when(F.col("v") == "january", F.make_date(y, F.lit(1), F.lit(31))).otherwise(F.make_date(y - 1, F.lit(10), F.lit(31)))
    return years.withColumn("v", F.explode(F.array(*map(F.lit, ("december", "january", "october"))))).withColumn("cutoff", F.date_format(day, "yyyy-MM-dd"))


@query("P20_one_hot_aligned", "SELECT c_custkey, (c_mktsegment = 'AUTOMOBILE')::BIGINT AS is_automobile, (c_mktsegment = 'BUILDING')::BIGINT AS is_building, (c_mktsegment = 'FURNITURE')::BIGINT AS is_furniture FROM customer")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns are those of the training vocabulary, whatever the target holds."""
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", *[(seg == v).cast("long").alias(f"is_{v.lower()}") for v in ("AUTOMOBILE", "BUILDING", "FURNITURE")])


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Without the columns whose names begin so."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


@query("P21_drop_by_prefix", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_prefix(table(spark, sf_dir, "lineitem"))


def without_prefix(lines: DataFrame) -> DataFrame:
    x = lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_tax").alias("x_tax"), F.col("l_discount").alias("x_discount"))
    return drop_prefixed(x, "x_")


@query("P22_standardise", """
WITH h AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, h WHERE c_custkey % 2 = 1""")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    h = c.filter("c_custkey % 2 = 0").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))
    return c.filter("c_custkey % 2 = 1").crossJoin(F.broadcast(h)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("P23_blend_grid", "SELECT c_custkey, l / 10.0 AS lambda, round(l / 10.0 * c_acctbal + (1 - l / 10.0) * (c_custkey % 100), 4) AS score FROM customer, (SELECT unnest(range(0, 11)) AS l)")
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid is an array exploded in place: no join."""
    lam = F.col("l") / 10.0
    return table(spark, sf_dir, "customer").withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(10)))).select("c_custkey", lam.alias("lambda"), F.round(lam * F.col("c_acctbal") + (1 - lam) * (F.col("c_custkey") % 100), 4).alias("score"))


def concession_paths(cpi, drag):
    """indexed: rises with prices; ratchet: never below what it was; midpoint: between."""
    return {"indexed": cpi, "midpoint": (cpi + F.greatest(cpi, drag)) / 2, "ratchet": F.greatest(cpi, drag)}


@query("P24_trajectories", """
WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, (l_tax * 100) AS cpi, (l_discount * 100) AS drag FROM lineitem)
SELECT l_orderkey, line, path, round(CASE path WHEN 'indexed' THEN cpi WHEN 'midpoint' THEN (cpi + greatest(cpi, drag)) / 2 ELSE greatest(cpi, drag) END, 6) AS v FROM x, (VALUES ('indexed'), ('midpoint'), ('ratchet')) AS t(path)""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), *[F.round(v, 6).alias(k) for k, v in concession_paths(F.col("l_tax") * 100, F.col("l_discount") * 100).items()])
    return x.unpivot(["l_orderkey", "line"], ["indexed", "midpoint", "ratchet"], "path", "v")


@query("P26_quality_gate", "SELECT page_id, length(html) BETWEEN 1000 AND 20000 AND contains(html, '<title>') AS ok FROM pages")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("html")
    return table(spark, sf_dir, "pages").select("page_id", (n.between(1000, 20000) & F.col("html").contains("<title>")).alias("ok"))


def cells(spark: SparkSession, sf_dir: str, customers: DataFrame, *third: str) -> DataFrame:
    x = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cell = x.groupBy("n_regionkey", "c_nationkey", "c_mktsegment", *third).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    parent = x.groupBy("n_regionkey").agg(F.count("*").alias("pn"), F.avg("c_acctbal").alias("pm"))
    j = cell.join(parent, "n_regionkey")
    n, pn = F.col("n"), F.col("pn")
    return j.select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("segment"), *third, "n", F.when(n >= 5, "cell").when(pn >= 5, "parent").otherwise("none").alias("level"), F.round(F.when(n >= 5, F.col("m")).when(pn >= 5, F.col("pm")), 4).alias("mean"))


#: The third attribute: the balance in steps of 1000.
@query("P27_small_cells_to_parent", """
WITH x AS (SELECT *, floor(c_acctbal / 1000)::BIGINT AS band FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT n_regionkey, c_nationkey, c_mktsegment, band, count(*) AS n, avg(c_acctbal) AS m FROM x GROUP BY ALL),
p AS (SELECT n_regionkey, count(*) AS pn, avg(c_acctbal) AS pm FROM x GROUP BY ALL)
SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS segment, band, n, CASE WHEN n >= 5 THEN 'cell' WHEN pn >= 5 THEN 'parent' ELSE 'none' END AS level, round(CASE WHEN n >= 5 THEN m WHEN pn >= 5 THEN pm END, 4) AS mean FROM c JOIN p USING (n_regionkey)""")
def small_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, table(spark, sf_dir, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 1000)), "band")
