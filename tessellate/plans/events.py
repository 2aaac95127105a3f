"""State and event operators in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lifecycle import checked, rate_limited, replayed
from ..operators.online import arbitrated, prequential, proposals
from ..operators.outbox import client_queue, flushed, released
from ..registry import query, table
from .aggregates import scored
from .joins import SERIES_SQL, series

STEPS_SQL = "WITH s AS (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst, ts FROM events)"
LEGAL = (("signup", "view"), ("view", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"), ("error", "view"), ("view", "error"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(w).alias("src"), F.col("event_type").alias("dst"), "ts")


@query("E01_legal_transitions", f"{STEPS_SQL} SELECT event_id, coalesce((src, dst) IN ({', '.join(map(str, LEGAL))}), false) AS legal FROM s")
def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame(LEGAL, "src string, dst string")
    return checked(steps(spark, sf_dir), t).select("event_id", "legal")


@query("E02_replay", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "event_type")


@query("E03_idempotent_upsert", "SELECT user_id, event_type, min(event_id) AS first_id, count(*) - 1 AS acknowledged FROM events GROUP BY 1, 2")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated key has no effect but an acknowledgement."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), (F.count("*") - 1).alias("acknowledged"))


TRIES_SQL = """WITH RECURSIVE tries AS (SELECT user_id, floor(epoch(ts) / 600)::BIGINT AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) / 600)::BIGINT, event_id) AS i FROM events),
r AS (
  SELECT user_id, 0::BIGINT AS i, 'ENREGISTRÉ' AS state, 0 AS attempts, NULL::BIGINT AS next_try, false AS late, 0 AS early FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT x.user_id, x.i, CASE WHEN state = 'SYNCHRONISÉ' OR t < next_try THEN state WHEN ok THEN 'SYNCHRONISÉ' WHEN attempts + 1 >= 5 THEN 'ÉCHEC_SYNCHRO' ELSE state END,
         CASE WHEN state = 'SYNCHRONISÉ' OR coalesce(t < next_try, false) OR ok THEN attempts ELSE attempts + 1 END,
         CASE WHEN state = 'SYNCHRONISÉ' OR coalesce(t < next_try, false) THEN next_try WHEN ok THEN NULL ELSE t + least(600, pow(2, least(attempts + 1, 30)))::BIGINT END,
         CASE WHEN state = 'SYNCHRONISÉ' OR coalesce(t < next_try, false) OR NOT ok THEN late ELSE state = 'ÉCHEC_SYNCHRO' END,
         CASE WHEN state <> 'SYNCHRONISÉ' AND coalesce(t < next_try, false) THEN early + 1 ELSE early END
  FROM r JOIN tries x ON x.user_id = r.user_id AND x.i = r.i + 1)
"""


@query("E04_backoff", TRIES_SQL + "SELECT user_id, arg_max(state, i) AS state, arg_max(attempts, i)::BIGINT AS attempts, coalesce(arg_max(coalesce(next_try, -1), i), -1)::BIGINT AS next_try, arg_max(late, i) AS late, arg_max(early, i)::BIGINT AS early FROM r GROUP BY 1")
def retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a try of its user's record; a purchase is the answer."""
    t = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000).alias("t"), (F.col("event_type") == "purchase").alias("ok"))
    return flushed(t, "user_id", "t", "event_id", "ok").select("user_id", "state", F.col("attempts").cast("long").alias("attempts"), F.coalesce("next_try", F.lit(-1).cast("long")).alias("next_try"), "late", F.col("early").cast("long").alias("early"))


@query("E05_release_in_flight", """
WITH l AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) AS d, max(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) AS a FROM events GROUP BY 1)
SELECT user_id, d IS NOT NULL AND coalesce(a < d, true) AS was_in_flight, 0::BIGINT AS in_flight, CASE WHEN d IS NOT NULL AND coalesce(a < d, true) THEN d END AS send_again FROM l""")
def release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click dispatches; a purchase or an error answers."""
    kind = F.col("event_type")
    return released(table(spark, sf_dir, "events"), "user_id", F.col("event_id"), kind == "click", kind.isin("purchase", "error"))


@query("E12_prequential", """
WITH z AS (SELECT floor(doc_id / 100)::BIGINT AS batch, least(floor(least(0.99, n_chars / (n_chars + 1000.0)) * 20), 19)::INT AS bin, quality FROM labels JOIN documents USING (doc_id)),
c AS (SELECT batch, bin, count(*) AS n, sum(quality) AS good FROM z GROUP BY 1, 2),
f AS (SELECT b.batch, g.bin, coalesce(n, 0) AS n, coalesce(good, 0) AS good FROM (SELECT DISTINCT batch FROM c) b CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) g LEFT JOIN c ON c.batch = b.batch AND c.bin = g.bin),
s AS (SELECT *, coalesce(sum(n) OVER w, 0) AS seen, coalesce(sum(good) OVER w, 0) AS was FROM f WINDOW w AS (PARTITION BY bin ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, sum(seen) OVER v AS upto, sum(was) OVER v AS hits FROM s WINDOW v AS (PARTITION BY batch ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, min(bin) FILTER (hits >= 0.6 * upto AND upto > 0) OVER (PARTITION BY batch) AS tau FROM u)
SELECT batch, any_value(tau)::BIGINT AS tau, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (bin >= tau), 0)::BIGINT AS n_auto, coalesce(sum(good) FILTER (bin >= tau), 0)::BIGINT AS n_right FROM t GROUP BY 1""")
def recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows in batches of a hundred ids, each judged by what the ones before it showed."""
    z = scored(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 100))
    return prequential(z, "batch", "p", "quality", 0.6).withColumn("tau", F.col("tau").cast("long"))


SESSION_SQL = """WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 86400 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM g)"""


@query("E06_sessions", f"{SESSION_SQL} SELECT user_id, min(event_id) FILTER (new = 1) AS first_event, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, sess")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day without events ends a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("new", F.when(t - F.lag(t).over(w) <= 86400 * 1000000, 0).otherwise(1))
    e = e.withColumn("sess", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "sess").agg(F.min(F.when(F.col("new") == 1, F.col("event_id"))).alias("first_event"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("sess")


@query("E07_rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) >= 3 AS limited FROM events")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limited(table(spark, sf_dir, "events"), "event_type", "ts", 600, 3).select("event_id", "limited")


@query("E08_bounded_cache", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five answers of each: the cache is the feature."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("user_id", "event_id")


@query("E09_visible_latest", "SELECT user_id, event_type, arg_max(event_id, ts) AS latest FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of what a role may see."""
    return table(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max_by("event_id", "ts").alias("latest"))


@query("E10_previous_validated", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events")
def previous_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("prev"))


@query("E11_match_proposal", """
WITH q AS (SELECT s_suppkey AS qid, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN concat(substr(s_name, 1, 3), 'X', substr(s_name, 5)) ELSE s_name END AS code, floor(s_acctbal / 2000)::BIGINT AS band FROM supplier),
c AS (
  SELECT qid, s_suppkey AS id, levenshtein(code, s_name) AS d, (floor(s_acctbal / 2000)::BIGINT = band)::INT + (s_suppkey % 5 = qid % 5)::INT AS agree, (floor(s_acctbal / 2000)::BIGINT <> band)::INT + (s_suppkey % 5 <> qid % 5)::INT AS clash
  FROM q JOIN supplier USING (s_nationkey)),
k AS (SELECT *, round(-d + 0.8 * agree - clash, 6) AS score FROM c WHERE d <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r, lead(score) OVER (PARTITION BY qid ORDER BY score DESC, id) AS nxt, least(count(*) OVER (PARTITION BY qid), 2) AS n FROM k)
SELECT q.qid, CASE WHEN id IS NULL THEN 'NO_MATCH' WHEN d = 0 AND clash = 0 AND (n = 1 OR nxt < score - 1) THEN 'CONFIRM_MATCH' ELSE 'CHOOSE_MATCH' END AS kind, id AS best, score, coalesce(n, 0)::BIGINT AS n FROM q LEFT JOIN r ON q.qid = r.qid AND r.r = 1""")
def proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers looked up by a code that may be misread, among those of their nation; balance band and a digit are the facts."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.floor(F.col("s_acctbal") / 2000).alias("band"), (F.col("s_suppkey") % 5).alias("digit"))
    wrong = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.substring("s_name", 1, 3), F.lit("X"), F.expr("substring(s_name, 5)"))).otherwise(F.col("s_name"))
    q = s.select(F.col("s_suppkey").alias("qid"), wrong.alias("qcode"), "s_nationkey", F.col("band").alias("qband"), F.col("digit").alias("qdigit"))
    pairs = q.join(s, "s_nationkey").withColumn("d", F.levenshtein("qcode", "s_name"))
    return proposals(pairs, "qid", "s_suppkey", "d", [("qband", "band"), ("qdigit", "digit")])


@query("M34_engine_arbitration", """
WITH e AS (
  SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_partkey % 4 > 0 THEN (l_quantity::INT % 3)::VARCHAR END AS a, (l_suppkey % 3)::VARCHAR AS b, CASE WHEN l_suppkey % 2 = 0 THEN concat(' ', l_partkey % 3) END AS c,
         -(l_partkey % 7)::DOUBLE AS sa, -(l_suppkey % 7)::DOUBLE AS sb, -(l_orderkey % 7)::DOUBLE AS sc, l_tax AS ink FROM lineitem),
f AS (SELECT *, trim(c) AS d FROM e)
SELECT l_orderkey, line,
       CASE WHEN a IS NOT DISTINCT FROM b OR a IS NOT DISTINCT FROM d THEN a WHEN b = d THEN b WHEN a IS NULL AND ink < 0.02 THEN NULL
            WHEN sb >= sa + 3 AND sb >= sc AND sb > sa THEN b WHEN sc >= sa + 3 AND sc > sb THEN c ELSE a END AS value,
       CASE WHEN a IS NOT DISTINCT FROM b AND a IS NOT DISTINCT FROM d THEN 3 WHEN a IS NOT DISTINCT FROM b OR a IS NOT DISTINCT FROM d OR b = d THEN 2 ELSE 1 END::BIGINT AS agree FROM f""")
def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engines' readings of every line, one of them blank at times."""
    text, score = lambda x: x.cast("string"), lambda x: -(F.col(x) % 7).cast("double")
    k = lambda x, n: F.col(x) % n
    readings = {"own": (F.when(k("l_partkey", 4) > 0, text(F.col("l_quantity").cast("int") % 3)), score("l_partkey")), "second": (text(k("l_suppkey", 3)), score("l_suppkey")), "third": (F.when(k("l_suppkey", 2) == 0, F.concat(F.lit(" "), text(k("l_partkey", 3)))), score("l_orderkey"))}
    value, agree = arbitrated(readings, "own", F.trim, F.col("l_tax"), blank=0.02)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), value.alias("value"), agree.alias("agree"))


@query("E13_message_dedup", "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).dropDuplicates()


FACT_SQL = SERIES_SQL.rstrip() + ", f AS (SELECT seg, y, v, make_date(y + 1, 1, 20) AS published FROM s)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's figure, known from the twentieth of the next January."""
    return series(spark, sf_dir).withColumn("published", F.make_date((F.col("y") + 1).cast("int"), F.lit(1), F.lit(20)))


@query("E15_vintage_replay", FACT_SQL + " SELECT vint, seg, max(y) AS last_year, count(*) AS known FROM f, (VALUES ('january', DATE '1999-01-31'), ('december', DATE '1998-12-31'), ('october', DATE '1998-10-31')) AS t(vint, cutoff) WHERE published <= cutoff GROUP BY 1, 2")
def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known at each cut-off, all cut-offs in one pass."""
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("vint"), F.lit(d).cast("date").alias("cutoff")) for n, d in (("january", "1999-01-31"), ("december", "1998-12-31"), ("october", "1998-10-31"))]))
    f = facts(spark, sf_dir).withColumn("t", v).filter(F.col("published") <= F.col("t.cutoff"))
    return f.groupBy(F.col("t.vint").alias("vint"), "seg").agg(F.max("y").alias("last_year"), F.count("*").alias("known"))


CODES = {"error": 503, "signup": 422, "view": 429, "click": 404, "purchase": 200}


@query("E16_error_classes", f"""
WITH e AS (SELECT event_id, user_id, ts, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items())} END AS code FROM events),
a AS (SELECT *, CASE WHEN code IS NULL OR code IN (401, 408, 429) OR code >= 500 THEN 'retry' WHEN code BETWEEN 400 AND 499 THEN 'manual' ELSE 'done' END AS action FROM e),
r AS (SELECT *, sum((action = 'done')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT event_id, action, CASE WHEN action = 'retry' THEN least(60, 2 * pow(2, least(sum((action = 'retry')::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 20)))::BIGINT END AS wait FROM r""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permanent errors go to a person, the rest is tried again, later with each failure in a row."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), F.col("event_type"))
    return client_queue(table(spark, sf_dir, "events").withColumn("code", code), "user_id", ["ts", "event_id"], "code").select("event_id", "action", "wait")


@query("S15_latest_per_year", FACT_SQL + " SELECT y, arg_max(seg, (v, seg)) AS top FROM f GROUP BY 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("y").agg(F.max_by("seg", F.struct("v", "seg")).alias("top"))


@query("S16_published_series", FACT_SQL + " SELECT seg, max(y) AS y, round(arg_max(v, y), 2) AS v FROM f WHERE published <= DATE '1999-06-30' GROUP BY 1")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = facts(spark, sf_dir).filter("published <= date '1999-06-30'")
    return k.groupBy("seg").agg(F.max("y").alias("y"), F.round(F.max_by("v", "y"), 2).alias("v"))


@query("X01_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS win, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "6 hours"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("win"), "event_type", "n")
