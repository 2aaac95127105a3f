"""Draws hashed in NumPy against hashlib and the SQL expression."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellate.operators import draws, simulate
from tessellate.operators.weighted import uniform
from tessellate.plans import simulation


def plain(tag, draw, unit):
    return int.from_bytes(hashlib.md5("~".join(map(str, [tag, draw, *([] if unit is None else [unit])])).encode()).digest()[:4], "big")


@pytest.mark.parametrize("units", [pa.array([0, 7, None, -12, 10**18, 123456]), pa.array([11, 22, 33]), pa.array(["a", "é" * 30, "x" * 51, None])])
def test_bits(units):
    for lanes in (draws.Lanes(units), draws.Units(units)):
        got = {}
        for first, count in draws.blocks(0, 112, len(units)):
            got |= {first + k: row.tolist() for k, row in enumerate(lanes.bits("ext", first, count))}
        assert got == {d: [plain("ext", d, x) for x in units.to_pylist()] for d in range(112)}
    only = np.zeros((3, len(units)), bool)
    only[0, 1] = only[2, 0] = True
    assert draws.Lanes(units).bits("int", 10, 3, only).tolist() == [plain("int", d, units[k].as_py()) for d, k in ((10, 1), (12, 0))]


def test_uniforms_of_expressions(spark):
    want = [r[0] for r in spark.range(50).select(uniform("m01", F.lit(123), F.col("id"))).collect()]
    assert draws.as_uniform(draws.Units(pa.array(range(50))).bits("m01", 123, 1)[0]).tolist() == want
    assert [bool(x) for x in draws.Units(pa.array(range(50))).bits("m01", 123, 1)[0] < draws.below(0.65)] == [u < 0.65 for u in want]


def test_depths_are_spread_over_tasks(spark, sf_dir):
    """The draws of a table with few files are not left to few tasks."""
    assert simulation.margins(spark, sf_dir, 3).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism * 4


def test_depths_of_any_batch():
    units, pools = pa.array([5, None, 7]), pa.array([[0.1, 0.2, 0.3], [0.5], [0.6, 0.7]])
    got = [r for b in simulation.depths(iter([pa.RecordBatch.from_arrays([units, pools], ["unit", "xs"]).slice(k) for k in (0, 1)]), 12) for r in b.to_pylist()]
    rows = [*zip(units.to_pylist(), pools.to_pylist(), strict=True)]
    want = [(d, u, xs[min(int(plain("int", d, u) / 2**32 * len(xs)), len(xs) - 1)] if plain("ext", d, u) / 2**32 < 0.7 else 0.0) for k in (0, 1) for d in range(12) for u, xs in rows[k:]]
    key = lambda r: (r[0], r[1] or 0, r[2])
    assert sorted([(r["draw"], r["unit"], r["drag"]) for r in got], key=key) == sorted(want, key=key)


def test_outcomes_of_a_cohort():
    """The outcomes that the tasks find for their draws, with a unit and a value missing, against plain sums; all draws, in blocks of unequal sizes."""
    units, v = [5, None, 7, 123456], [10.0, 2.5, None, 4.0]
    rows = pa.StructArray.from_arrays([pa.array(units), pa.array(v)], ["unit", "v"])
    got = {(r["sc"], r["draw"]): r for b in simulation.outcomes(rows, 8, 103) for r in b.to_pylist()}
    assert len(got) == 3 * 95
    for (sc, draw), r in got.items():
        base = {name: b for name, b, _ in simulation.SCENARIOS}[sc]
        renew = [plain("renew", draw, u) / 2**32 < 0.65 for u in units]
        g = [100 * (min(x, 0.06) if y else x) for x, y in zip([base + 0.04 * (plain("growth", draw, u) / 2**32 - 0.5) for u in units], renew, strict=True)]
        assert r["med"] == pytest.approx(np.median(g)) and r["renewals"] == np.mean(renew)
        assert r["weighted"] == pytest.approx(sum(x * y for x, y in zip(v, g, strict=True) if x is not None) / 16.5)
    assert list(simulation.outcomes(rows, 3, 3)) == []


def test_stretches_hold_all_rows_and_draws(spark):
    """Rows reach every task whole, as arrays of many rows, and every draw has one task."""

    def seen(rows, first, last):
        yield pa.RecordBatch.from_arrays([pa.array(range(first, last), pa.int64()), pa.array([sum(x["id"] for x in rows.to_pylist())] * (last - first), pa.int64())], ["draw", "total"])

    for n in (1, 2, 37):
        got = draws.for_stretches(spark.range(30_000).selectExpr("id", "null n"), n, seen, "draw long, total long").collect()
        assert sorted(r["draw"] for r in got) == list(range(n)) and {r["total"] for r in got} == {sum(range(30_000))}
    assert draws.for_stretches(spark.range(0), 5, seen, "draw long, total long").count() == 0


@pytest.mark.parametrize("in_place", [2_000_000, 0])
def test_bootstrap_medians(spark, monkeypatch, in_place):
    """A unit's rows share its weight (a missing unit is one), equal values add up, and a draw without mass has no median."""
    monkeypatch.setattr(simulate, "IN_PLACE", in_place)
    rows = [(5, 2.0), (5, 1.0), (None, 3.0), (None, 1.0), (8, 4.0)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(3)
    want, steps = {}, simulate.poisson_steps()
    for d in range(60):
        w = [(v, sum(plain("m01", d, u) / 2**32 >= s for s in steps)) for u, v in sorted(rows, key=lambda r: r[1])]
        total = sum(x for _, x in w)
        if total:
            want[d] = min(v for v, _ in w if sum(x for y, x in w if y <= v) >= total / 2 and any(x for y, x in w if y == v))
    assert 0 < len(want) < 60
    got = simulate.cluster_bootstrap_median(df, "k", "v", 60, "m01")
    assert {r["draw"]: r["percentile"] for r in got.collect()} == want
    assert ("MapInArrow" in got._jdf.queryExecution().toString()) == (in_place > 0)
    with pytest.raises(Exception, match="needs numbers"):
        simulate.cluster_bootstrap_median(spark.createDataFrame([(1, None)], "k long, v double"), "k", "v", 5, "m01").collect()
