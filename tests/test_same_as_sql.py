"""Queries against their SQL on small tables that hold what the given ones do not."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tessellate import catalog


def both(spark, path, name, table):
    got = catalog.QUERIES[name](spark, str(path))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE[name])
    order = [c[0] for c in want.description]
    key = lambda r: [str(x) for x in r]
    return sorted((tuple(r) for r in got.select(*order).collect()), key=key), sorted(want.fetchall(), key=key)


def test_revisions(spark, tmp_path):
    """Crowded places, and ids on both sides of 100000."""
    r = random.Random(7)
    rows = [(k, [r.random() / 200, r.random() / 200], k % 3 if k % 50 else None) for k in [*range(600), *range(100_000, 100_300)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = both(spark, tmp_path, "J23_revision_diff", "embeddings")
    assert got == want and len(want) == 4


def events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, micros long, user_id long, event_type string, value double").select("event_id", F.timestamp_micros("micros").cast(TimestampNTZType()).alias("ts"), "user_id", "event_type", "value").write.parquet(str(path / "events.parquet"))


def test_fragments(spark, tmp_path):
    """Parts of seconds decide what is in reach and what comes first; times, pieces and users that are missing."""
    r, start = random.Random(3), int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()) * 10**6
    rows, at = [], start
    for k in range(400):
        at += r.choice([7_200_000_000, 7_200_500_000, 7_199_600_000, 400_000, 500_000, 90_000_000_000]) + r.randrange(3) * 100_000
        rows.append((r.randrange(10**6), at if k % 40 else None, r.choice([1, 2, None]), r.choice(["a", "b", None]), 1.0))
    events(spark, tmp_path, [*rows, (-1, start, 9, None, 1.0), (-2, start + 1, 9, None, 1.0)])
    got, want = both(spark, tmp_path, "J30_row_fragments", "events")
    assert got == want


def test_page_verdicts(spark, tmp_path):
    """Pages whose mean is exactly 0.5 in any order of rows, which sums of fractions miss, are not capped; the others as the SQL has them, and readings without a page go."""
    r = random.Random(5)
    exact, other = [], [(10_000 + k, 0, r.choice([1, 2, 3, None]), "view", r.choice([1.0, 500.0])) for k in range(300)]
    at = {i * 7919 % 1000: i for i in range(1000)}
    for page in range(200):
        # with each reading the one that makes 1000 thousandths of both
        exact += [(at[x] + 1000 * page, 0, page, "view", 1.0) for k in r.sample(range(1, 1000), 7) for x in (k, 1000 - k)]
    r.shuffle(exact)
    for name, rows in (("exact", exact), ("other", other)):
        (tmp_path / name).mkdir()
        events(spark, tmp_path / name, rows)
    got, want = both(spark, tmp_path / "other", "P13_page_verdict", "events")
    assert got == want and len(got) < 300
    got = catalog.QUERIES["P13_page_verdict"](spark, str(tmp_path / "exact")).collect()
    assert len(got) == len(exact) and all(x["conf"] == x["event_id"] * 7919 % 1000 / 1000 for x in got)
    assert sum(x["conf"] > 0.9 for x in got) > 50


def test_running_numbers(spark, tmp_path):
    """Numbers of more than five digits, as lpad has them."""
    events_of = spark.range(260_000).select(F.col("id").alias("event_id"), F.lit(0).alias("micros"), F.lit(1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events_of.write.parquet(str(tmp_path / "events.parquet"))
    got, want = both(spark, tmp_path, "W19_running_number", "events")
    assert got == want and len(want) == 260_000
