"""The reference's counts of draws, and what does not depend on the count."""

import pytest

from tessellate import catalog
from tessellate.plans import models, simulation


@pytest.mark.parametrize(("name", "draws"), [("M01_cluster_bootstrap", 1000), ("M03_row_bootstrap_ratio", 1000), ("M10_two_margin_draw", 5000), ("M11_cohort_simulation", 5000)])
def test_draws(spark, sf_dir, name, draws):
    assert catalog.QUERIES[name](spark, sf_dir).select("draw").distinct().count() == draws


def test_every_row_is_drawn(spark):
    lines = spark.range(500).selectExpr("id l_orderkey", "1 l_linenumber", "if(id < 250, 2.0, 40.0) l_quantity", "if(id < 250, 0.0, 1.0) l_discount", "1.0 l_tax")
    ratios = [r["ratio"] for r in simulation.row_ratios(lines, 50).collect()]
    assert len(ratios) == 50 and all(0.3 < x < 0.7 for x in ratios)


def test_ensemble_of_all_seeds(spark, sf_dir):
    assert models.N_SEEDS == 30
    got = catalog.QUERIES["M24_seed_ensemble"](spark, sf_dir)
    assert got.filter("score between 0 and 1").count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
