"""Rule engines and resolvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table
from .projections import COMPARE_SQL, compared

RESULT_SQL = COMPARE_SQL.replace("FROM lineitem)", "FROM lineitem), x AS (SELECT *, CASE WHEN p IS NULL THEN 'unknown' WHEN p = s THEN 'conform' WHEN s < p THEN 'critical' ELSE 'minor' END AS verdict FROM c)")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("p"), F.col("s")
    return compared(spark, sf_dir).withColumn("verdict", F.when(p.isNull(), "unknown").when(p == s, "conform").when(s < p, "critical").otherwise("minor"))


@query("R02_result_confidence", RESULT_SQL + " SELECT l_orderkey, line, round(least(greatest(0.99 * CASE verdict WHEN 'conform' THEN 1.0 WHEN 'minor' THEN 0.8 WHEN 'critical' THEN 0.7 ELSE 0.3 END * CASE WHEN line > 4 THEN 0.1 ELSE 1.0 END, 0.05), 0.99), 6) AS conf FROM x")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of factors, clamped."""
    v = F.col("verdict")
    f = F.when(v == "conform", 1.0).when(v == "minor", 0.8).when(v == "critical", 0.7).otherwise(0.3) * F.when(F.col("line") > 4, 0.1).otherwise(1.0)
    return results(spark, sf_dir).select("l_orderkey", "line", F.round(F.least(F.greatest(0.99 * f, F.lit(0.05)), F.lit(0.99)), 6).alias("conf"))


@query("R03_name_distrust", RESULT_SQL + " SELECT line, count(*) FILTER (verdict = 'conform') AS confirmed, count(*) FILTER (verdict IN ('critical', 'minor')) AS contradicted, count(*) FILTER (verdict <> 'unknown') < 5 OR count(*) FILTER (verdict = 'conform') / count(*) FILTER (verdict <> 'unknown') > 0.2 AS trusted FROM x GROUP BY 1")
def distrust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing by name is kept for a type only where it is confirmed often enough, on enough pairs."""
    v = F.col("verdict")
    yes, known = F.count_if(v == "conform"), F.count_if(v != "unknown")
    return results(spark, sf_dir).groupBy("line").agg(yes.alias("confirmed"), (known - yes).alias("contradicted"), ((known < 5) | (F.try_divide(yes, known) > 0.2)).alias("trusted"))


@query("R04_best_reading", """
WITH v AS (SELECT p_type, var, avg((abs(l_quantity * f - 25) < 10)::INT) AS agree FROM lineitem JOIN part ON l_partkey = p_partkey, (VALUES ('each', 1.0), ('total', 2.0), ('half', 0.5)) AS t(var, f) GROUP BY ALL)
SELECT p_type, var, round(agree, 6) AS agree FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY agree DESC, var) AS n FROM v) WHERE n = 1""")
def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings in one run, as rows of a variant; each type keeps the one that agrees most."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("var"), F.lit(f).alias("f")) for n, f in (("each", 1.0), ("total", 2.0), ("half", 0.5))]))
    j = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("v", v)
    a = j.withColumn("hit", (F.abs(F.col("l_quantity") * F.col("v.f") - 25) < 10).cast("int")).groupBy("p_type", F.col("v.var").alias("var")).agg(F.avg("hit").alias("agree"))
    b = a.groupBy("p_type").agg(F.min(F.struct((-F.col("agree")).alias("a"), "var")).alias("b"))
    return b.select("p_type", "b.var", F.round(-F.col("b.a"), 6).alias("agree"))


@query("R05_coverage_gate", RESULT_SQL + ", g AS (SELECT l_orderkey, avg((verdict = 'conform')::INT) AS share FROM x GROUP BY 1) SELECT l_orderkey, line, CASE WHEN share < 0.2 THEN 'sheet' ELSE verdict END AS report FROM x JOIN g USING (l_orderkey)")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of which too little is found is reported as a whole, not element by element."""
    share = F.avg((F.col("verdict") == "conform").cast("int")).over(Window.partitionBy("l_orderkey"))
    return results(spark, sf_dir).withColumn("share", share).select("l_orderkey", "line", F.when(F.col("share") < 0.2, "sheet").otherwise(F.col("verdict")).alias("report"))


BOOK_SQL = "WITH b AS (SELECT o_custkey AS patient, o_orderkey AS page, o_orderdate::DATE AS d, lead(o_orderdate) OVER w::DATE AS nxt, o_totalprice AS v, o_orderpriority AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


def booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patient's pages in order, each with the date of the next."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("page"), F.col("o_orderdate").cast("date").alias("d"), F.lead("o_orderdate").over(w).cast("date").alias("nxt"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("pr"))


@query("R06_cross_page_dates", BOOK_SQL + """
SELECT patient, page, rule FROM (
  SELECT patient, page, CASE WHEN nxt < d THEN 'D1' WHEN nxt = d THEN 'D2' WHEN date_diff('day', d, nxt) > 700 THEN 'D4' WHEN strftime(d + INTERVAL 280 DAY, '%Y') <> strftime(d + INTERVAL 287 DAY, '%Y') THEN 'D5' END AS rule FROM b WHERE nxt IS NOT NULL) WHERE rule IS NOT NULL""")
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due date = first day + 280, term = due date + 7; the first rule that a page breaks."""
    d, n = F.col("d"), F.col("nxt")
    rule = F.when(n < d, "D1").when(n == d, "D2").when(F.datediff(n, d) > 700, "D4").when(F.year(F.date_add(d, 280)) != F.year(F.date_add(d, 287)), "D5")
    return booklet(spark, sf_dir).filter("nxt is not null").select("patient", "page", rule.alias("rule")).filter("rule is not null")


@query("R07_same_fact_twice", "WITH f AS (SELECT user_id, event_type, event_id, value, (event_id * 7919 % 1000) AS conf FROM events) SELECT user_id, event_type, arg_max(event_id, (conf, event_id)) AS kept, count(DISTINCT value) > 1 AS conflict FROM f GROUP BY 1, 2")
def same_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The more confident reading of one fact wins."""
    e = table(spark, sf_dir, "events").withColumn("conf", F.col("event_id") * 7919 % 1000)
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("conf", "event_id")).alias("kept"), (F.count_distinct("value") > 1).alias("conflict"))


@query("R08_soft_visit_rules", BOOK_SQL + " SELECT patient, page, CASE WHEN date_diff('day', d, nxt) <> 28 THEN 'R1' END AS r1, abs(round_even(date_diff('day', d, nxt) / 7.0, 0) - 4 - (v / 10000)) > 30 AS h1 FROM b WHERE nxt IS NOT NULL")
def soft_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.datediff("nxt", "d")
    return booklet(spark, sf_dir).filter("nxt is not null").select("patient", "page", F.when(gap != 28, "R1").alias("r1"), (F.abs(F.bround(gap / 7.0) - 4 - F.col("v") / 10000) > 30).alias("h1"))


@query("R09_range_flags", BOOK_SQL + " SELECT page, CASE WHEN v < 5000 THEN 'V1' WHEN v > 400000 THEN 'V2' WHEN regexp_matches(pr, '^[12]-') AND v < 50000 THEN 'V3' END AS flag FROM b")
def range_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return booklet(spark, sf_dir).select("page", F.when(v < 5000, "V1").when(v > 400000, "V2").when(F.col("pr").rlike("^[12]-") & (v < 50000), "V3").alias("flag"))


def ticks(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(*[F.sum((F.col("event_type") == t).cast("int")).alias(n) for t, n in (("error", "none_"), ("purchase", "a"), ("signup", "b"), ("view", "c"))])


#: All events, by user and day: over its whole record nearly every user would have every tick.
DAY_BOXES_SQL = "WITH k AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, sum((event_type = 'error')::INT) AS none_, sum((event_type = 'purchase')::INT) AS a, sum((event_type = 'signup')::INT) AS b, sum((event_type = 'view')::INT) AS c FROM events GROUP BY 1, 2)"


def day_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "user_id", "day")


def status_of_ticks() -> Column:
    n, any_ = F.col("none_") > 0, F.col("a") + F.col("b") + F.col("c") > 0
    return F.when(n & ~any_, "NOT_APPLICABLE").when(n, "CONFLICT").otherwise("FILLED")


@query("R10_not_applicable", DAY_BOXES_SQL + " SELECT user_id, day, CASE WHEN none_ > 0 AND a + b + c = 0 THEN 'NOT_APPLICABLE' WHEN none_ > 0 THEN 'CONFLICT' ELSE 'FILLED' END AS status FROM k")
def not_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_boxes(spark, sf_dir).select("user_id", "day", status_of_ticks().alias("status"))


def choice_of_ticks() -> Column:
    n = sum(((F.col(c) > 0).cast("int") for c in "abc"), F.lit(0))
    return F.when(n == 0, "none").when(n == 1, "one").otherwise("several")


@query("R11_exclusive_group", DAY_BOXES_SQL + " SELECT user_id, day, CASE WHEN (a > 0)::INT + (b > 0)::INT + (c > 0)::INT = 0 THEN 'none' WHEN (a > 0)::INT + (b > 0)::INT + (c > 0)::INT = 1 THEN 'one' ELSE 'several' END AS choice FROM k")
def exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_boxes(spark, sf_dir).select("user_id", "day", choice_of_ticks().alias("choice"))


@query("R12_twin_type", "SELECT page_id, CASE WHEN regexp_extract(url, '/(en|fr|de|es)/', 1) = '' THEN 'unknown' WHEN regexp_extract(html, 'lang=\"([a-z]+)\"', 1) = regexp_extract(url, '/(en|fr|de|es)/', 1) THEN 'same' ELSE 'twin' END AS kind FROM pages")
def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that a page's content says against the one of its place."""
    u, h = F.regexp_extract("url", "/(en|fr|de|es)/", 1), F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(u == "", "unknown").when(u == h, "same").otherwise("twin").alias("kind"))


@query("R13_human_verdicts", RESULT_SQL + ", h AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_suppkey % 2 = 0 THEN 'rejected' ELSE 'confirmed' END AS said FROM lineitem WHERE l_partkey % 13 = 0) SELECT x.l_orderkey, x.line, CASE said WHEN 'confirmed' THEN concat(verdict, '+') ELSE verdict END AS verdict FROM x LEFT JOIN h ON x.l_orderkey = h.l_orderkey AND x.line = h.line WHERE said IS NULL OR said <> 'rejected'")
def human_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected findings go, confirmed ones are marked, the rest stays."""
    h = table(spark, sf_dir, "lineitem").filter("l_partkey % 13 = 0").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_suppkey") % 2 == 0, "rejected").otherwise("confirmed").alias("said"))
    j = results(spark, sf_dir).join(h, ["l_orderkey", "line"], "left").filter("said is null or said <> 'rejected'")
    return j.select("l_orderkey", "line", F.when(F.col("said") == "confirmed", F.concat("verdict", F.lit("+"))).otherwise(F.col("verdict")).alias("verdict"))


def publishable(df: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """df, if it has none of the forbidden columns; an error before anything is written otherwise."""
    if bad := {c.lower() for c in df.columns} & {c.lower() for c in forbidden}:
        raise ValueError(f"not to be published: {sorted(bad)}")
    return df


@query("R14_publication_lint", "SELECT c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 5")
def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("n")).filter("n >= 5")
    return publishable(g, ("c_custkey", "c_name"))


@query("H01_field_comparison", "SELECT c_custkey, concat(lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')), '@example.org') AS expected, c_mktsegment = 'BUILDING' AS exempt FROM customer")
def field_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that should follow from others, built by rule."""
    name = F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]+", "."))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(name, F.lit("@example.org")).alias("expected"), (F.col("c_mktsegment") == "BUILDING").alias("exempt"))


@query("H02_rule_verdict", RESULT_SQL + " SELECT l_orderkey, line, CASE WHEN verdict = 'unknown' THEN 'AMBIGUOUS' WHEN verdict = 'conform' THEN 'COMPLIANT' WHEN abs(p - s) <= 1 THEN 'JUSTIFIED_GAP' ELSE 'ANOMALY' END AS verdict FROM x")
def rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    said = F.when(v == "unknown", "AMBIGUOUS").when(v == "conform", "COMPLIANT").when(F.abs(F.col("p") - F.col("s")) <= 1, "JUSTIFIED_GAP").otherwise("ANOMALY")
    return results(spark, sf_dir).select("l_orderkey", "line", said.alias("verdict"))


FACTS_SQL = "WITH f AS (SELECT user_id AS subject, event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS authority, ts, value FROM events)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "event_id", F.when(t == "error", 1).when(t == "purchase", 2).otherwise(3).alias("authority"), "ts", "value")


def current(f: DataFrame) -> DataFrame:
    """The current truth of each subject: the highest authority, then the latest."""
    return f.groupBy("subject").agg(F.max_by(F.struct("event_id", "value"), F.struct((-F.col("authority")).alias("a"), "ts", "event_id")).alias("b")).select("subject", "b.event_id", "b.value")


@query("H03_authority_resolver", FACTS_SQL + " SELECT subject, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY authority, ts DESC, event_id DESC) AS n FROM f) WHERE n = 1")
def resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(facts(spark, sf_dir))


@query("H04_state_diff", FACTS_SQL + """,
a AS (SELECT subject, event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY authority, ts DESC, event_id DESC) AS n FROM f WHERE ts < TIMESTAMP '2024-01-10') WHERE n = 1),
b AS (SELECT subject, event_id FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY authority, ts DESC, event_id DESC) AS n FROM f WHERE ts < TIMESTAMP '2024-01-20') WHERE n = 1)
SELECT subject, CASE WHEN a.event_id IS NULL THEN 'new' WHEN b.event_id IS NULL THEN 'removed' WHEN a.event_id = b.event_id THEN 'same' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (subject)""")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two frozen states say of each subject."""
    f = facts(spark, sf_dir)
    at = lambda day, name: current(f.filter(F.col("ts") < F.lit(day).cast("timestamp_ntz"))).select("subject", F.col("event_id").alias(name))
    a, b = F.col("a"), F.col("b")
    j = at("2024-01-10", "a").join(at("2024-01-20", "b"), "subject", "full_outer")
    return j.select("subject", F.when(a.isNull(), "new").when(b.isNull(), "removed").when(a == b, "same").otherwise("changed").alias("kind"))
