"""Sources, sinks and streams, by round trips over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.weighted import uniform
from ..registry import query, table
from ..session import scratch
from ..sources import readers, sinks, xlsx
from ..streaming import streams
from .aggregates import HASH

RENAME = {"hUnit": "unit_id", "sName": "name", "sFrom": "start"}


@query("S01_csv_scan", "SELECT o_orderkey AS unit_id, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS start FROM orders")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, read with its schema, renamed, dates parsed."""
    path = scratch(spark, "csv")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hUnit"), F.col("o_orderpriority").alias("sName"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("sFrom")).write.option("header", True).csv(path)
    df = readers.read_csv(spark, path, "hUnit long, sName string, sFrom string", RENAME, ("start",))
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("S02_month_start", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders")
def month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(readers.month_start(F.date_format("o_orderdate", "yyyy-MM")), "yyyy-MM-dd").alias("month"))


@query("S03_typed_dates", "SELECT l_orderkey, l_linenumber::BIGINT AS line, strftime(l_shipdate, '%Y-%m-%d') AS ship FROM lineitem")
def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_lines(table(spark, sf_dir, "lineitem"))


def typed_lines(lines: DataFrame) -> DataFrame:
    return lines.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship"))


@query("S04_header_cleanup", "SELECT c_custkey AS customer, c_acctbal AS balance FROM customer")
def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance (CAD)"), F.col("c_name").alias("name (text)"))
    return readers.clean_header(raw, ("name",))


@query("S05_json_documents", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON, read with its schema and exploded."""
    path = scratch(spark, "json")
    sinks.nested(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id", "event_type"], "fields").write.json(path)
    d = readers.read_lines(spark, path, "user_id long, fields array<struct<event_id: bigint, event_type: string>>")
    return d.select("user_id", F.explode("fields").alias("f")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("f.event_id").alias("last"))


@query("S06_json_lines", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.json(path)
    return readers.read_lines(spark, path, "event_id long, event_type string, value double").withColumn("value", F.round("value", 6))


@query("S09_discover_files", "SELECT 'colonne' AS type, 'shop' AS kind, 'NIV-2@3' AS levels UNION ALL SELECT 'dalle', 'plan', ''")
def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found below a folder, and what their paths say."""
    path = scratch(spark, "files")
    one = table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).coalesce(1)
    one.write.text(f"{path}/atelier/X_COLONNE-NIV-2@3.d")
    one.write.text(f"{path}/plan/X_DALLE.d")
    f = readers.discover(spark, path, "part-*")
    folder = F.element_at(F.split("path", "/"), -2)
    kinds = f.select(F.lower(F.regexp_extract(folder, r"(?i)(colonne|dalle|mur|radier)", 1)).alias("type"), "kind", F.array_join(F.regexp_extract_all(folder, F.lit(r"NIV-?\d+(?:@\d+)?"), 0), "|").alias("levels"))
    return kinds


@query("S08_known_list_xlsx", "SELECT n_nationkey::BIGINT AS nation, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def known_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known list as a spreadsheet: written from the nations, read back with its columns."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    path = scratch(spark, "known")
    sinks.write_bytes(spark, f"{path}/known.xlsx", xlsx.sheet_bytes([["nation", "name", None, "region"], *[[r["n_nationkey"], r["n_name"], None, r["n_regionkey"]] for r in n]]))
    return xlsx.read_xlsx(spark, path, ["nation", "name", "region"]).select(F.col("nation").cast("long").alias("nation"), "name", F.col("region").cast("long").alias("region"))


@query("S20_idempotent_ingestion", "SELECT event_id, event_type FROM events")
def ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files in which every event comes twice, into a keyed table; the stream is run again and adds nothing."""
    path = scratch(spark, "ingest")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.write.parquet(f"{path}/in")
    e.write.mode("append").parquet(f"{path}/in")
    for _ in range(2):
        source = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        streams.upsert_into(source, f"{path}/out", "event_id", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("X02_stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows over a file stream, complete at the end of what is there."""
    path = scratch(spark, "windows")
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{path}/in")
    counts = streams.tumbling_counts(spark.readStream.schema(e.schema).parquet(f"{path}/in"), "ts", "1 day", ["event_type"])
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    flat.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


LEGAL = {("view", "click"), ("click", "view"), ("view", "view"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("error", "view"), ("signup", "view"), ("view", "signup")}


@query("X03_stream_transitions")
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state over a stream: an illegal step is reported and changes nothing."""
    path = scratch(spark, "steps")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{path}/in")
    s = streams.transitions(spark.readStream.schema(e.schema).parquet(f"{path}/in"), "user_id", "event_type", "ts", LEGAL)
    streams.collected(s, f"{path}/out", f"{path}/state")
    return spark.read.schema("user_id long, src string, dst string, legal boolean").parquet(f"{path}/out")


@query("S21_generated_values", f"SELECT i::BIGINT AS id, floor({HASH.format(chr(39) + 'gen' + chr(39) + ', i')} * 300 + 2500)::BIGINT AS grams, CASE WHEN {HASH.format(chr(39) + 'kind' + chr(39) + ', i')} < 0.5 THEN 'a' ELSE 'b' END AS kind FROM (SELECT unnest(range(0, 1000)) AS i)")
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return spark.range(1000).select("id", F.floor(uniform("gen", i) * 300 + 2500).alias("grams"), F.when(uniform("kind", i) < 0.5, "a").otherwise("b").alias("kind"))


@query("K01_predictions", "SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 100)::INT AS granted FROM customer")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.allocate import top_share

    path = scratch(spark, "predictions")
    c = table(spark, sf_dir, "customer")
    n = c.count()
    sinks.write_predictions(top_share(c, 100 / n, [F.desc("c_acctbal"), F.asc("c_custkey")]), path, "c_custkey", "granted", 100)
    return spark.read.schema("c_custkey long, granted int").option("header", True).csv(path)


@query("K02_guarded_aggregate", "SELECT c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 5")
def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "aggregate")
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("n")).filter("n >= 5")
    sinks.write_aggregate(g, path, ("c_custkey",), "n")
    return spark.read.schema("nation long, n long").option("header", True).csv(path)


@query("K03_answer_json", "SELECT concat('{\"orders\":', count(*), ',\"customers\":', count(DISTINCT o_custkey), '}') AS answer FROM orders")
def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_answer(table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers")))


@query("K05_nested_export", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "nested")
    sinks.nested(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_totalprice"], "orders").write.json(path)
    back = readers.read_lines(spark, path, "o_custkey long, orders array<struct<o_orderkey: bigint, o_totalprice: double>>")
    total = F.aggregate("orders", F.lit(0.0), lambda acc, x: acc + x["o_totalprice"])
    return back.select("o_custkey", F.size("orders").cast("long").alias("n"), F.round(total, 2).alias("total"))


@query("K06_findings_csv", "SELECT l_orderkey AS element, l_returnflag AS finding FROM lineitem")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exported(spark, table(spark, sf_dir, "lineitem"))


def exported(spark: SparkSession, lines: DataFrame) -> DataFrame:
    path = scratch(spark, "findings")
    sinks.write_findings(lines.select(F.col("l_orderkey").alias("element"), F.col("l_returnflag").alias("finding")), path)
    return spark.read.schema("element long, finding string").option("header", True).option("sep", ";").option("enforceSchema", True).csv(path)


@query("K07_keyed_upsert", "SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second with what the first had: only new keys are added."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    known = e.filter("user_id % 2 = 0")
    return known.unionByName(sinks.new_rows(e, known, "user_id"))


@query("K09_atomic_publish", "SELECT n_nationkey::BIGINT AS nation, n_name FROM nation WHERE n_regionkey < 3")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "publish")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), "n_name", "n_regionkey")
    for most in (1, 3):
        sinks.publish(n.filter(F.col("n_regionkey") < most).drop("n_regionkey"), path)
    return sinks.read_published(spark, path)


@query("K10_sealed_documents", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted, written, read and opened again."""
    path, key = scratch(spark, "sealed"), b"0123456789abcdef"
    table(spark, sf_dir, "documents").select("doc_id", sinks.sealed(F.col("text"), key).alias("payload")).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", F.sha2(sinks.opened(F.col("payload"), key), 256).alias("sha"))


@query("K11_split_tables", "SELECT (doc_id % 5 = 0) AS holdout, count(*) AS n FROM labels GROUP BY 1")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "split")
    table(spark, sf_dir, "labels").withColumn("holdout", F.col("doc_id") % 5 == 0).write.partitionBy("holdout").parquet(path)
    return spark.read.schema("doc_id long, quality int, toxic int, holdout boolean").parquet(path).groupBy("holdout").agg(F.count("*").alias("n"))
