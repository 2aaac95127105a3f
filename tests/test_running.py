"""Running sums, ranks and percentiles against plain windows, by one sort and by ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.operators import running
from tessellate.operators.allocate import top_share
from tessellate.operators.lifecycle import rate_limited
from tessellate.operators.running import percentiles, ranked, with_percentiles
from tessellate.operators.weighted import weighted_percentiles


@pytest.fixture(params=[10**6, 0], ids=["one sort", "ranges"])
def way(request, monkeypatch):
    monkeypatch.setattr(running, "ONE_SORT", request.param)
    return request.param


def rows_of(n, seed=1):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(40)]), i) for i in range(n)]


def test_ranked(spark, way):
    rows = rows_of(3000)
    df = spark.createDataFrame(rows, "g string, v int, id long").withColumns({"range_of_row": F.lit("x"), "group_0": F.lit(2)}).repartition(7)
    got = {r["id"]: (r["n"], r["of"]) for r in ranked(df, ["g"], [F.desc_nulls_last("v"), F.col("id")], "n", "of").collect()}
    for g in ("a", "b", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[i] for _, _, i in mine] == [(k, len(mine)) for k in range(1, len(mine) + 1)]
    assert ranked(df.limit(0), ["g"], [F.col("id")], "n").count() == 0


@pytest.mark.parametrize("batch", [16, 3])
def test_grants_are_exact_on_wide_rows(spark, monkeypatch, way, batch):
    """Many rows and wide columns: no row and no grant is lost, with adaptive execution on."""
    n = 200_000
    wide = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 512) for k in range(2)])
    df = spark.range(n).select("id", (F.col("id") * 7919 % 10007).alias("score"), wide.alias("x"), F.lit("pad" * 40).alias("y"))
    with_parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(batch))
    try:
        out = top_share(df, 0.4, [F.desc("score"), F.asc("id")])
        got = out.agg(F.count("*"), F.count_distinct("id"), F.sum("granted"), F.min(F.when(F.col("granted") == 1, F.col("score"))), F.max(F.when(F.col("granted") == 0, F.col("score")))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_parts)
    assert tuple(got[:3]) == (n, n, round(0.4 * n)) and got[3] >= got[4]
    assert top_share(df, F.lit(0.25), [F.col("score"), F.col("id")], "top", ["y"]).agg(F.sum("top")).first()[0] == n // 4
    with pytest.raises(ValueError):
        top_share(df, 1.5, [F.col("id")])


def test_percentiles(spark, way):
    rows = rows_of(2000, 2)
    df = spark.createDataFrame([*rows, ("none", None, -1), ("one", 5, -2)], "g string, v int, id long").repartition(5)
    shares = {"low": 0.1, "mid": 0.5, "top": 1.0}
    got = {r["g"]: (r["low"], r["mid"], r["top"]) for r in with_percentiles(df.select("g").distinct(), df, ["g"], "v", shares).collect()}
    for g in ("a", "b", None):
        v = [x for k, x, _ in rows if k == g and x is not None]
        assert got[g] == pytest.approx([np.percentile(v, 100 * p) for p in shares.values()])
    assert got["none"] == (None, None, None) and got["one"] == (5.0, 5.0, 5.0)
    assert percentiles(df.limit(0), [], "v", {"m": 0.5}).first()["m"] is None and percentiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_weighted_percentiles(spark, way):
    r = random.Random(5)
    rows = [("g", float(r.randrange(30)), float(r.randrange(4))) for _ in range(500)]
    got = weighted_percentiles(spark.createDataFrame(rows, "g string, v double, w double"), "v", "w", {"p25": 25, "p90": 90}, ["g"]).first()
    v = sorted((x, w) for _, x, w in rows)
    total, at = sum(w for _, w in v), {}
    for p in (25, 90):
        run = 0
        for x, w in v:
            run += w
            if w and run >= total * p / 100:
                at[f"p{p}"] = x
                break
    assert (got["p25"], got["p90"]) == (at["p25"], at["p90"])


def test_rate_limit_by_stretches(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), 1_700_000_000 + r.randrange(5000)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("t", F.timestamp_seconds("s"))
    got = {x["id"]: x["limited"] for x in rate_limited(df, "k", "t", 60, 4).collect()}
    assert got == {i: sum(k == k2 and s - 60 <= s2 <= s for _, k2, s2 in rows) >= 4 for i, k, s in rows}
