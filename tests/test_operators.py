import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.functions import callouts, strings
from tessellate.operators.allocate import top_share
from tessellate.operators.asof import asof_backward
from tessellate.operators.lifecycle import TRANSITIONS, backoff, checked, transition_table
from tessellate.operators.matching import compare_bars, greedy_pairs, monotone_alignment, subset_to
from tessellate.operators.metrics import calibration_error, indicator
from tessellate.operators.pairs import annualised_growth_pct, pair_table
from tessellate.operators.weighted import weighted_percentile
from tessellate.plans.models import validated
from tessellate.plans.projections import concession_paths, notice_share_before
from tessellate.plans.rules import publishable
from tessellate.sources import sinks
from tessellate.sources.readers import Settings


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("values, weights, p, expected", [([99, 10, -99, 20], [0, 1, 0, 3], 0, 10), ([99, 10, -99, 20], [0, 1, 0, 3], 50, 20), ([99, 10, -99, 20], [0, 1, 0, 3], 100, 20), ([20, 10], [300, 100], 50, 20)])
def test_weighted_percentile(spark, values, weights, p, expected):
    df = spark.createDataFrame([(float(v), float(w)) for v, w in zip(values, weights, strict=True)], "v double, w double")
    assert weighted_percentile(df, "v", "w", p, []).first()["percentile"] == expected


def test_weighted_percentile_refuses(spark):
    df = spark.createDataFrame([(1.0, -1.0)], "v double, w double")
    with pytest.raises(ValueError):
        weighted_percentile(df, "v", "w", 101, [])
    with pytest.raises(Exception, match="weights of at least 0"):
        weighted_percentile(df, "v", "w", 50, []).collect()
    assert weighted_percentile(df.filter("v > 1"), "v", "w", 50, []).first()["percentile"] is None


def test_paths(spark):
    r = one(spark, *[x.alias(k) for k, x in concession_paths(F.lit(7.0), F.lit(9.0)).items()])
    assert (r["indexed"], r["midpoint"], r["ratchet"]) == (7, 8, 9)
    r = one(spark, *[x.alias(k) for k, x in concession_paths(F.lit(10.0), F.lit(9.0)).items()])
    assert set(r) == {10}


def test_notice_windows(spark):
    ends = [("2026-03-31", 12), ("2026-06-30", 12), ("2026-09-30", 12), ("2026-02-28", 6)]
    df = spark.createDataFrame(ends, "e string, m int").withColumn("e", F.to_date("e")).coalesce(1)
    cut = F.lit("2026-01-01").cast("date")
    got = df.select(*[notice_share_before(F.col("e"), F.col("m"), cut, m).alias(m) for m in ("uniform", "earliest", "latest")]).collect()
    assert [r["uniform"] for r in got] == pytest.approx([1, 2 / 90, 0, 4 / 31])
    assert [r["earliest"] for r in got] == [1, 1, 0, 1]
    assert [r["latest"] for r in got] == [1, 0, 0, 0]


def test_growth_guards(spark):
    g = annualised_growth_pct(F.lit(110.0), F.lit(100.0), F.lit(0.5))
    assert one(spark, g.alias("g"))["g"] == pytest.approx((1.1**2 - 1) * 100)
    assert one(spark, annualised_growth_pct(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("g"))["g"] is None


def test_pairs_conserve_rows(spark):
    df = spark.createDataFrame([(1, "2020-01-01", 1, 10.0, "a"), (1, "2021-01-01", 2, 11.0, "a"), (1, "2021-01-01", 3, 12.0, "b"), (2, "2020-01-01", 4, 5.0, "a")], "u int, d string, i int, v double, p string").withColumn("d", F.to_date("d"))
    p = {r["i"]: r for r in pair_table(df, "u", "d", "i", "v", "p").collect()}
    assert len(p) == 4 and p[2]["is_valid"] and not p[3]["is_valid"] and p[3]["bad_gap"] and p[4]["no_previous"] and p[2]["is_renewal"] and not p[3]["is_renewal"]


def test_asof_ties(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("z", 5, 3), (None, 5, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("k", 5, 10), ("k", 5, 11), ("k", 3, 12), ("k", 9, 13)], "k string, t int, rid int")
    got = {r["id"]: r["r_rid"] for r in asof_backward(left, right, "k", "t", "t", ["rid"], "rid").collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None}


@pytest.mark.parametrize("n, rate", [(1, 0.4), (5, 0.5), (7, 0.5), (40, 0.4), (101, 0.0), (33, 1.0)])
def test_grants_are_exact(spark, n, rate):
    df = spark.range(n).withColumn("s", F.col("id") % 3)
    for parts in (1, 5):
        got = top_share(df.repartition(parts), rate, [F.desc("s"), F.asc("id")])
        assert got.agg(F.sum("granted")).first()[0] == round(rate * n)
    grouped = top_share(df, rate, [F.asc("id")], by=["s"]).groupBy("s").agg(F.sum("granted").alias("g"), F.count("*").alias("n")).collect()
    assert all(r["g"] == round(rate * r["n"]) for r in grouped)


def test_calibration(spark):
    df = spark.createDataFrame([(0.95, 1), (0.95, 0), (1.0, 1)], "c double, ok int")
    assert calibration_error(df, "c", "ok").first()["ece"] == pytest.approx(abs(2.9 / 3 - 2 / 3))


def test_missing_is_not_negative(spark):
    rows = [(150.0,)] * 6 + [(None,)] * 6
    r = spark.createDataFrame(rows, "x double").agg(*[v.alias(k) for k, v in indicator(F.col("x") > 140, F.col("x").isNotNull()).items()]).first()
    assert (r["numerator"], r["denominator"], r["missing"]) == (6, 6, 6)
    r = spark.createDataFrame([(150.0,)] * 3 + [(1.0,)] * 9, "x double").agg(*[v.alias(k) for k, v in indicator(F.col("x") > 140, F.col("x").isNotNull()).items()]).first()
    assert r["numerator"] is None and r["withheld"]


CALLOUTS = [
    ("8-25M", {"quantity": 8, "size": "25M"}), ("12(6)-15M", {"quantity": 12, "sub": 6}), ("12 (6) -15M", {"quantity": 12, "sub": 6}), ("(8) 25M VERT.", {"quantity": 8, "role": "vert"}), ("8–25M", {"quantity": 8}), ("8 - 25M", {"quantity": 8}),
    ("10M@300 c/c", {"spacing": 300, "quantity": None}), ("20M@300mm c/c", {"spacing": 300}), ("15M A 300 C/C", {"spacing": 300}), ("ARM. 15M 300 c/c", {"spacing": 300, "quantity": None}), ("15M AT 250 o.c.", {"spacing": 250}), ("15M 200 (c.c.)", {"spacing": None}),
    ("10M aux 150", {"spacing": 150}), ('10M@12" c/c', {"spacing": 305}), ("10M @ 8'' c/c", {"spacing": 203}), ('15M @ 7 1/2"', {"spacing": 190}), ("15M @ 30", {"spacing": None}), ("LIG.: 10M@300 c/c", {"role": "ligature"}),
    ("8-20M x 3000 SUP.", {"quantity": 8, "length": 3000, "role": "sup"}), ("8-20M × 3000", {"length": 3000}), ("8-25M LG 3600", {"length": 3600}), ("8-25M L=3600", {"length": 3600}), ("5-20M2400 @ 250", {"quantity": 5, "size": "20M", "spacing": 250, "length": 2400}),
    ("COL. 400 x 600 8-25M", {"quantity": 8, "length": None}), ('T: 24 15M 15A12 @12"', {"quantity": 24, "spacing": 305, "mark": "15A12", "role": "sup", "length": None}), ("B: 24 15M 20-6", {"quantity": 24, "length": 6248, "role": "inf"}), ("8 25M 3600", {"quantity": 8, "length": 3600, "mark": None}),
    ("6 20M 20A01B2", {"quantity": 6, "mark": "20A01B2", "length": None}), ("12-15M B12 @ 300 INF.", {"quantity": 12, "spacing": 300, "mark": "B12", "role": "inf"}), ("2x4 25M 25A301", {"quantity": 8, "mark": "25A301"}), ("V: 8 25M 360", {"quantity": 8, "length": None, "mark": "360", "role": "vert"}),
    ("NIV 2 15M @ 300", {"quantity": None, "spacing": 300}), ("DALLE HAUTS 15M @ 300", {"role": "sup"}), ("15M", {"quantity": None, "spacing": None, "conf": 0.5}), ("4 15M DOWELS", {"role": "goujon", "conf": 0.95}),
]


@pytest.mark.parametrize("text, expected", CALLOUTS)
def test_callouts(text, expected):
    bars = callouts.bars_of(text)
    assert len(bars) == 1 and expected.items() <= bars[0].items(), bars


@pytest.mark.parametrize("text, expected", [
    ("10M @ 300 15M @ 200", [("10M", None, 300), ("15M", None, 200)]), ("4-25M + 2-20M INF", [("25M", 4, None), ("20M", 2, None)]), ("8-25M 12-15M @ 300 mm 6 10M", [("25M", 8, None), ("15M", 12, 300), ("10M", 6, None)]),
    ("15M @ 300 8-25M", [("15M", None, 300), ("25M", 8, None)]),
])
def test_callouts_of_one_line(text, expected):
    assert [(b["size"], b["quantity"], b["spacing"]) for b in callouts.bars_of(text)] == expected


def test_repair(spark):
    cases = {"8-2OM e 300": "8-20M @ 300", "1SMe250 I5M@200 2OMPa": "15M @ 250 15M @ 200 2OMPa", "8~2OM": "8-20M", "3–IOM": "3-10M", "7OM": "7OM", "SOME 12 MM": "SOME 12 MM", "": "", "12-25M @ 300": "12-25M @ 300"}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").coalesce(1)
    assert [r[0] for r in df.select(callouts.repaired(F.col("t"))).collect()] == [*cases.values(), None]


@pytest.mark.parametrize("text", ["BETON 25MPa", "10MM", "115M", "35MPa / C-1", "3.25M", "", None])
def test_no_callouts(text):
    assert callouts.bars_of(text) == []


def test_levels(spark):
    df = spark.createDataFrame([("X_COLONNE-NIV-2@3",), ("X_DALLE TRÉFOND",), ("X_RADIERS 1@2",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(callouts.levels(F.col("t"))).collect()] == [["2", "3"], ["TREFOND"], []]


def test_canonical_forms(spark):
    cases = {
        "1 / 2 / 24": "01/02/2024", "01.02.2024": "01/02/2024", "1-2-2024": "01/02/2024", "120 / 80": "120/80", "62,5 KG": "62.5 kg", "62.5kgs": "62.5 kg", "3 Semaines": "3 sa", "40": "40", "12 g/l": "12 g/l", "Oui": "oui", "O": "oui", "Néant": "neant", "-": None, "": None, "  ": None, None: None,
        "٣٫٥ g": "3.5 g", "d’Août": "d'aout", "1/2/3/4": "1/2/3/4", "2024": "2024", "1-2": "1-2", "+": "+",
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string").coalesce(1)
    assert [r[0] for r in df.select(strings.canonical(F.col("v"))).collect()] == [*cases.values()]


def test_labels_bays_and_sheets(spark):
    text = ["COLONNE C-12 ET C13A VOIR S-501 TYPE 1 P4", "BETON: 35MPa / C-1", "COL. B-12, B-13", "B/3", "C.1-12", "1/2 c/c", "VOIR S-501 ET S-602A", None]
    df = spark.createDataFrame([(t,) for t in text], "t string").coalesce(1)
    got = df.select(strings.element_labels(F.col("t"), "C").alias("l"), strings.grid_refs(F.col("t")).alias("g"), strings.sheet_ids(F.col("t")).alias("s")).collect()
    assert [r["l"] for r in got[:2]] == [["C12", "C13A"], []] and [r["g"] for r in got[1:6]] == [[], ["B-12", "B-13"], ["B-3"], ["C.1-12"], []] and got[6]["s"] == ["S-501", "S-602A"] and got[7]["l"] is None


def test_codes():
    d = strings.code_distance_of
    assert d("2026-823-001", "2026-823-001") == 0 and d("2026-823-001", "2026-823-007") < 1 and d("2026-823-001", "2026-416-002") > 2


def test_scanner(spark):
    df = spark.createDataFrame([("CB609814",), ("06 00 76 13 48",), ("49 Rue Al Qods, Kénitra",), ("104/74",), ("3626 g",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in df.select(strings.scan(F.col("t"), F.lit("note"))).collect()]
    assert got[:5] == [["CIN"], ["PHONE"], ["ADDRESS"], [], []]
    assert one(spark, strings.norm_code(F.lit("٢٠٢٦/٨٢٣/٠٠١")).alias("c"))["c"] == "2026-823-001"


def bar(size, quantity=None, spacing=None, length=None):
    return {"size": size, "quantity": quantity, "spacing": spacing, "length": length}


@pytest.mark.parametrize("plan, shop, expected", [
    (bar("25M", 8), [bar("25M", 6)], ("quantity", "critical")), (bar("25M", 8), [bar("25M", 10)], ("quantity", "minor")), (bar("25M", 8), [bar("25M", 4), bar("25M", 4)], None), (bar("25M", 8), [bar("20M", 3)], ("absence", "major")),
    (bar("15M", None, 200), [bar("15M", None, 250)], ("spacing", "critical")), (bar("15M", None, 200), [bar("15M", None, 150)], ("spacing", "minor")), (bar("25M", 8), [bar("20M", 8)], ("size", "critical")),
    (bar("25M", 8, None, 3000), [bar("25M", 8, None, 3010)], None), (bar("25M", 8, None, 3000), [bar("25M", 8, None, 2700)], ("length", "major")),
])
def test_bar_cascade(plan, shop, expected):
    gaps = compare_bars([plan], shop)["gaps"]
    assert [(a, s) for a, _, _, s in gaps] == ([expected] if expected else [])


def test_bar_cascade_as_a_whole():
    role = lambda b, r: b | {"role": r}
    out = compare_bars([bar("25M", 8), bar("10M", None, 300)], [bar("25M", 8), bar("10M", 14, 300)])
    assert (out["checked"], out["gaps"]) == (2, [])
    assert compare_bars([bar("25M", 20)], [bar("25M", 4)] * 5) == {"checked": 1, "unknown": 0, "multiples": 0, "gaps": []}  # spread over five marks
    assert compare_bars([bar("25M", 20)], [bar("25M", 6), bar("25M", 6), bar("25M", 6)])["gaps"] == [("quantity", "20", "18", "critical")]  # all marks together come closer
    assert compare_bars([bar("25M", 8)], [bar("25M", 24)])["multiples"] == 1 and compare_bars([bar("25M", 2)], [bar("25M", 26)])["gaps"] == [("quantity", "2", "26", "minor")]
    assert compare_bars([bar("15M", None, 300)], [bar("15M", 24)])["unknown"] == 1 and compare_bars([bar("15M", None, 300)], [])["unknown"] == 1
    assert compare_bars([bar("20M", 8)], [bar("25M", 8)])["gaps"] == [("size", "20M", "25M", "major")] and compare_bars([bar("25M", 8)], [])["gaps"] == [("absence", "25M", None, "major")]
    two = compare_bars([role(bar("15M", 8), "sup"), role(bar("15M", 8), "inf")], [role(bar("15M", 8), "inf"), role(bar("15M", 8), "sup")])
    assert two["checked"] == 2
    assert compare_bars([role(bar("15M", 8), "sup")], [role(bar("15M", 4), "inf"), role(bar("15M", 4), "inf")])["gaps"] == [("quantity", "8", "4", "critical")]  # marks of another role do not add up
    assert compare_bars([bar("15M", None, 300), bar("15M", None, 300)], [bar("15M", 9, 300)])["checked"] == 2 and compare_bars([bar("15M", 9, 300), bar("15M", 9, 300)], [bar("15M", 9, 300)])["gaps"] == [("absence", "15M", None, "major")]


def test_matching(spark):
    assert subset_to([3, 5, 7], 12) == (1, 2) and subset_to([8], 9) is None and subset_to([4] * 5, 20) == (0, 1, 2, 3, 4) and subset_to([1, 2, 3, 6], 6) == (3,)
    df = spark.createDataFrame([("g", 1, 1, 0.1), ("g", 1, 2, 0.2), ("g", 2, 1, 0.2), ("g", 2, 2, 0.9)], "g string, a long, b long, c double")
    assert {(r["a"], r["b"]) for r in greedy_pairs(df, ["g"], "a", "b", "c").collect()} == {(1, 1), (2, 2)}
    assert monotone_alignment(np.array([[0, 5.0, 0], [4, 0, 0], [0, 0, 3]])) == [(0, 1), (2, 2)]


def test_lifecycle(spark):
    steps = spark.createDataFrame([("CAPTURÉ", "EN_ATTENTE_IA"), ("SYNCHRONISÉ", "CAPTURÉ"), (None, "VALIDÉ")], "src string, dst string").coalesce(1)
    assert {r["dst"]: r["legal"] for r in checked(steps, transition_table(spark)).collect()} == {"EN_ATTENTE_IA": True, "CAPTURÉ": False, "VALIDÉ": False}
    assert len(TRANSITIONS) == 12
    assert [one(spark, backoff(F.lit(k)).alias("b"))["b"] for k in (0, 3, 9, 10, 50)] == [1, 8, 512, 600, 600]


def test_guards(spark, tmp_path):
    df = spark.range(3).withColumn("granted", F.lit(1))
    with pytest.raises(ValueError):
        sinks.write_predictions(df, str(tmp_path / "p"), "id", "granted", 2)
    with pytest.raises(ValueError):
        publishable(df, ("ID",))
    with pytest.raises(ValueError):
        sinks.write_aggregate(df, str(tmp_path / "a"), (), "granted")
    with pytest.raises(ValueError):
        validated(df, ["missing"], [])
    with pytest.raises(Exception, match="must be positive"):
        validated(df, ["id"], ["id"]).collect()
    (tmp_path / "s.json").write_text('{"radius": 1, "other": 2}')
    with pytest.raises(ValueError):
        Settings.load(tmp_path / "s.json")
    (tmp_path / "s.json").write_text('{"radius": 1}')
    assert Settings.load(tmp_path / "s.json").radius == 1
    assert math.isclose(Settings().length_tolerance, 0.02)


def test_publish_keeps_the_old_version_until_the_new_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    sinks.publish(spark.range(3), path)
    broken = spark.range(5).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.publish(broken, path)
    assert sinks.read_published(spark, path).count() == 3
    sinks.publish(spark.range(7), path)
    assert sinks.read_published(spark, path).count() == 7


def test_upsert_stops_at_a_broken_table(spark, tmp_path):
    from tessellate.streaming import streams

    e = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    e.write.parquet(f"file://{tmp_path}/in")
    source = lambda: spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/in")
    streams.upsert_into(source(), f"file://{tmp_path}/out", "k", f"file://{tmp_path}/one").awaitTermination()
    streams.upsert_into(source(), f"file://{tmp_path}/out", "k", f"file://{tmp_path}/two").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    (tmp_path / "out" / "part-broken.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017
        streams.upsert_into(source(), f"file://{tmp_path}/out", "k", f"file://{tmp_path}/three").awaitTermination()


def test_outbox_replay(spark):
    from tessellate.operators.outbox import flushed

    tries = [("a", t, False) for t in (0, 1, 2, 6, 14, 30, 62)] + [("a", 700, True), ("a", 701, False), ("b", 0, True), ("c", 0, False), ("c", 1, True), ("c", 2, True)]
    df = spark.createDataFrame([(i, t, k, ok) for k, (i, t, ok) in enumerate(tries)], "item string, t long, k long, ok boolean")
    got = {r["item"]: tuple(r)[1:] for r in flushed(df, "item", "t", "k", "ok").collect()}
    assert got == {"a": ("SYNCHRONISÉ", 6, None, True, 1), "b": ("SYNCHRONISÉ", 0, None, False, 0), "c": ("SYNCHRONISÉ", 1, None, False, 1)}


def test_repeat_draws_are_single_fits(spark):
    from tessellate.operators.regress import repeat_index
    from tessellate.operators.simulate import poisson_weight
    from tessellate.operators.weighted import uniform
    from tessellate.plans.models import repeat_draws

    p = spark.range(400).selectExpr("id % 90 o_custkey", "100 + id * 7 % 50 o_totalprice", "90 + id * 3 % 50 prev_o_totalprice", "1996 + id % 6 y", "1995 + id % 6 py", "1.0 gap")
    got = {(r["draw"], r["y"]): r["value"] for r in repeat_draws(p, 4).collect()}
    for draw in range(4):
        alone = repeat_index(p.withColumn("w", poisson_weight(uniform("m05", draw, F.col("o_custkey")))), F.col("o_totalprice"), F.col("prev_o_totalprice"), "y", "py", list(range(1995, 2002)), F.col("w"))
        assert [got[draw, y] for y, _ in alone] == pytest.approx([v for _, v in alone], abs=1e-5)


def test_xlsx_of_other_writers(spark, tmp_path):
    """Shared strings, cells that are left out, and a column that is missing."""
    import zipfile

    from tessellate.sources import xlsx

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>sheet</t></si><si><r><t>no</t></r><r><t>te</t></r></si><si><t>S-501 &amp; co</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c></row><row/><row><c r="C4"><v>7.5</v></c></row></sheetData></worksheet>')
    got = xlsx.read_xlsx(spark, f"file://{tmp_path}/a.xlsx", ["note", "sheet"])
    assert [tuple(r) for r in got.collect()] == [(None, "S-501 & co"), ("7.5", None)]
    with pytest.raises(Exception, match="lacks"):
        xlsx.read_xlsx(spark, f"file://{tmp_path}/a.xlsx", ["other"]).collect()
