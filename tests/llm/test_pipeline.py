"""Each stage of the pipeline against a plain version, on the stage's own input; and what its queries return."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    before, columns = pairs(docs), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "best_fit_packing":
            break
        after = pairs(docs)
        assert docs.columns == columns and len(after) > 0
        if name == "quality_rules":
            assert set(after) < set(before) and all(len(t.split()) >= 50 for _, t in after)
        elif name == "line_dedup":
            clean = brute.line_dedup(before)
            assert dict(after) == {i: t for (i, _), t in clean.items() if t}
        elif name == "ngram_jaccard_join":
            assert {i for i, _ in after} == {c for _, _, c in brute.components(before)}
        else:
            judged = {i: brute.contamination(t, bench) for i, t in before}
            assert {i for i, _ in after} == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
        before = after
    assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in before}
    assert docs.agg({"length": "max"}).first()[0] <= 1024


def test_run_is_the_stages(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() > 0


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


ROWS = "doc_id long, text string, lang string, source string, n_chars long, Component_ID int, repeated_at string, kept_id int, rules string, benchmark_hits int"


def odd_tables(spark, path, rows):
    spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, "x", 2, "y", 3) for i, t in rows], ROWS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "bench " + " ".join(f"q{i}" for i in range(30))), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_odd_inputs(spark, tmp_path):
    """Null and empty texts and ids, repeated rows, clashing columns, very long texts, and what each stage does with them."""
    prose = lambda seed, n=90: " ".join(f"{'the of and to' .split()[i % 4] if i % 3 == 0 else f'word{seed}x{i}'}" for i in range(n))
    lines = prose(7, 60) + "\n" + prose(8, 60) + "\n" + prose(9, 60)
    rows = [
        (1, prose(1)), (1, prose(1)), (2, prose(1)), (3, prose(3)), (4, None), (5, ""), (None, prose(4)), (None, None), (6, "short text"), (7, lines), (8, "first line here\n" + lines), (9, prose(5, 20000)), (10, lines),
        (11, prose(6) + " bench " + " ".join(f"q{i}" for i in range(30))),
    ]
    sf = odd_tables(spark, f"file://{tmp_path}/odd", rows)
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns
        kept[name] = sorted((r["doc_id"] or 0, len(r["text"])) for r in docs.collect())
    ids = lambda name: [i for i, _ in kept[name]]
    assert ids("quality_rules") == [0, 1, 1, 2, 3, 7, 8, 9, 10, 11]
    assert ids("line_dedup") == [0, 1, 1, 2, 3, 7, 8, 9, 11] and dict(kept["line_dedup"])[8] == len("first line here")
    assert ids("ngram_jaccard_join") == [0, 1, 3, 7, 8, 9, 11] and ids("benchmark_decontamination") == [0, 1, 3, 7, 8, 9]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {None, 1, 3, 7, 8, 9}


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, f"file://{tmp_path}/none", [])).count() == 0
