"""Phone and card forms that the given tables do not hold."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

pytest.importorskip("public_tokenizers")
from tessellate.llm import pseudonyms

PHONES = ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824", "743.555.3824", "1-743-555-3824", "+33 6 12 34 56 78", "+33612345678", "+33 (0)6 12 34 56 78", "0033 6 12 34 56 78", "0033612345678", "06 12 34 56 78", "06.12.34.56.78", "0612345678", "+49 30 1234567", "+49 (0) 30 123456", "030 1234567", "089/1234567", "0171-2345678", "(030) 1234567", "+34 612 345 678", "612 345 678", "912 34 56 78"]
CARDS = ["3782 822463 10005", "3782-822463-10005", "378282246310005", "4417 7442 8035 1547", "3056 930902 5904"]
OTHERS = ["1234567890123456", "0054994038693466", "999.1.1.1", "2025-13-40", "1.234.567", "12 345", "3782 822463 10006", "2019-2020", "10-20-30", "20240131", "+5 %", "1,234,567.89", "+1234"]


def test_forms(spark):
    values = [(i, f"Tel {v}, ok. {v}") for i, v in enumerate(PHONES + CARDS + OTHERS)]
    out, name = pseudonyms.pseudonymised(spark.createDataFrame(values, "doc_id long, text string"), "secret")
    got = {r["doc_id"]: r[name] for r in out.collect()}
    for i, v in enumerate(PHONES + CARDS):
        kind = "phone" if i < len(PHONES) else "card"
        assert [(x["kind"], x["value"]) for x in got[i]["values"]] == [(kind, v)] * 2, v
        p = got[i]["values"][0]["pseudonym"]
        assert p != v and "".join("0" if c.isdigit() else c for c in p) == "".join("0" if c.isdigit() else c for c in v)
        assert got[i]["text"] == f"Tel {p}, ok. {p}"
    for i, v in enumerate(OTHERS, len(PHONES + CARDS)):
        assert got[i]["text"] == f"Tel {v}, ok. {v}" and not got[i]["values"], v


def test_what_follows_stays(spark):
    text = "call (743) 555-3824x12 or +1 743 555 3824 2024, +33 6 12 34 56 78 2024"
    out, name = pseudonyms.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), "secret")
    assert [v["value"] for v in out.first()[name]["values"]] == ["(743) 555-3824", "+1 743 555 3824", "+33 6 12 34 56 78"]


VALUES = [
    "jo@x.org", "JO@x.org", "Jo.Ann-7@X.org", "a" * 70 + "9@y.net", "_@z.com", "1987-03-09", "1899-12-31", "2299-12-31", "2024-02-29", "2023-02-29", "28/09/2025", "09/28/2025", "03/04/2000", "03.04.2000", "31.12.2299", "31/04/2000", "13/13/2000", "01/02/2300",
    "1.2.3.4", "01.2.3.4", "255.255.255.255", "256.1.1.1", "123-45-6789", "000-12-3456", "666-12-3456", "899-99-9999", "900-12-3456", "665-01-0001", "667-01-0001", "123-00-6789", "123-45-0000", *PHONES, *CARDS, *OTHERS,
]


def test_against_plain_version(spark, sf_dir):
    """op4 over a whole table, and forms that the table does not hold, against one value at a time."""
    from plain_pseudonyms import pseudonymised

    from tessellate.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    kinds = set()
    for r in queries.op4_feistel_pseudonyms(spark, sf_dir).collect():
        text, counts = pseudonymised(texts[r["doc_id"]], queries.PSEUDONYM_KEY)
        assert r["text"] == text and {k: r[f"n_{k}"] for k in counts} == counts
        kinds |= counts.keys()
    assert kinds >= {"email", "ip", "phone", "card"}
    out, name = pseudonyms.pseudonymised(spark.createDataFrame([(i, f"x: {v}, y") for i, v in enumerate(VALUES)], "doc_id long, text string"), "k")
    for r in out.collect():
        assert r[name]["text"] == pseudonymised(f"x: {VALUES[r['doc_id']]}, y", "k")[0], VALUES[r["doc_id"]]
    assert pseudonyms.pseudonymised(spark.createDataFrame([], "doc_id long, text string, private int"), "k")[0].count() == 0


def test_inverse():
    from plain_pseudonyms import digits, feistel

    for n in range(1, 14):
        for i in range(40):
            d = str(i * 7919**2 % 10**n).zfill(n)
            assert digits(digits(d, "k", "t"), "k", "t", back=True) == d
    for a, b in [(0, 0), (188, 772), (5, 600)]:
        assert feistel(*feistel(a, b, 189, 773, "k", "t"), 189, 773, "k", "t", back=True) == (a, b)


def test_different_values_differ(spark):
    """All two-letter addresses, all dates of forty years in three layouts, and all social security numbers of a slice of areas: as many pseudonyms, all valid."""
    from pyspark.sql import functions as F

    two = spark.range(26 * 26).selectExpr("concat(char(97 + id % 26), char(97 + id div 26), '@x.org') v")
    days = spark.range(14600).selectExpr("date_add(date '1990-01-01', cast(id as int)) d")
    dates = days.selectExpr("explode(array(date_format(d, 'dd/MM/yyyy'), date_format(d, 'MM/dd/yyyy'), date_format(d, 'yyyy-MM-dd'))) v").distinct()
    numbers = spark.range(40000).selectExpr("concat(lpad(660 + id % 10, 3, '0'), '-', lpad(1 + id div 10 % 99, 2, '0'), '-', lpad(1 + id * 7919 % 9999, 4, '0')) v").distinct()
    for values, form in ((two, "^[a-z]{2}@x.org$"), (dates, r"^(\d\d/\d\d/\d{4}|\d{4}-\d\d-\d\d)$"), (numbers.filter("v not like '666%'"), r"^(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}$")):
        got = values.select("v", pseudonyms.pseudonym(F.col("v"), "k").alias("p"))
        n, different, fit = got.agg(F.count("v"), F.count_distinct("p"), F.count_if(F.col("p").rlike(form))).first()
        assert n == different == fit
    got = dates.select("v", pseudonyms.pseudonym(F.col("v"), "k").alias("p")).filter("v like '%/%'")
    assert got.filter("coalesce(try_to_date(p, 'dd/MM/yyyy'), try_to_date(p, 'MM/dd/yyyy')) is null").count() == 0
    assert numbers.filter("v like '666%'").select(pseudonyms.pseudonym(F.col("v"), "k").alias("p")).filter("p is not null").count() == 0
