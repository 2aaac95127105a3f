import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tessellate.llm import components, decontaminate, jaccard_join, line_dedup, packing, pseudonyms, quality_knn, quality_rules, queries, sharding, token_files, tokens, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", None, " ", "\n\n", "a", "A a. B! b?", " § b §", "x  y", "<|endoftext|> z", "é é", "A  B\t\tC \n d ", "1234 5'll don't", "word " * 3000, "L" * 20000]
SCHEMA = "doc_id long, text string, n_words string, Rules int"


def table(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def odd_rows():
    rows = list(enumerate(ODD)) + [(3, "same"), (3, "same"), (None, "without id " * 9), (None, None)]
    return rows


def family(seed, n, words=120, edits=2):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder(path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    for kept in (0, 1000):
        ids, begin = tokens.Encoder(path, kept).encode(pa.array(ODD * 2))
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in ODD * 2]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_letters_go_to_the_model(path, monkeypatch):
    from tokenizers import Tokenizer

    plain, enc, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(8)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    words = [*letters, "Stra\u00dfe", "\u00c9COLE", "x" * 5000, *("".join(r.choices(letters, k=r.randrange(1, 12))) for _ in range(3000))]
    near = ["\u00aa\u00ba\u00b5", "a\u0301b", "\u0130I", "a\u00d7b", "\u017f", "don't", "x\0y", "\ufb01n", "a\u0345", "\u0178\u00ff", "12a", "\u03a3\u03c2"]
    for text in (*near, *(f"{w}{white}{x}{white}{w}" for w in near for x in words[-3:] for white in (" ", "\n", "\t", "  "))):
        assert enc.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    enc = tokens.Encoder(path)
    monkeypatch.setattr(enc, "in_rows", None)  # the way by texts, not needed here
    monkeypatch.setattr(enc, "one_by_one", None)
    for text in (" ".join(words), " ".join(words * 2)):
        assert enc.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_steps_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(ODD)], ["text"])
    assert [x for s in tokens.steps(iter([batch]), "text", 10) for x in s.column("text").to_pylist()] == ODD


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTE)
    rows = odd_rows()
    got = packing.pack(table(spark, rows).repartition(3), BYTE).collect()
    want = sorted((repr(i), tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    docs = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        docs.setdefault(r["sequence_id"], []).append(r)
    for pieces in docs.values():
        at = 0
        for r in pieces:
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= 1024
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in want)
    long = sorted((r for r in got if r["doc_id"] == 12), key=lambda r: r["piece"])
    assert [r["length"] for r in long[1:]] == [1024] * (len(long) - 1) and long[0]["start"] == 0
    assert b"".join(bytes(r["ids"]) for r in long) == np.array(next(x for i, x in want if i == "12"), "<u4").tobytes()
    packing.BROADCAST_BYTES, kept = 0, packing.BROADCAST_BYTES
    try:
        again = packing.pack(table(spark, rows).repartition(3), BYTE).select("sequence_id", "offset", "length").collect()
    finally:
        packing.BROADCAST_BYTES = kept
    assert sorted(map(tuple, again)) == sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert packing.pack(table(spark, []), BYTE).count() == 0


def test_plan_is_tight():
    r = random.Random(5)
    counts = {}
    for _ in range(5000):
        n = r.randrange(1, 1025)
        counts[n] = counts.get(n, 0) + 1
    bins = packing.plan(counts, 1024)
    used = {}
    for inside, times in bins:
        assert sum(inside) <= 1024
        for n in inside:
            used[n] = used.get(n, 0) + times
    assert used == counts
    assert sum(t for _, t in bins) <= 1.01 * -(-sum(n * c for n, c in counts.items()) // 1024)


def plain_pack(lengths, capacity):
    """One bin after the other from all single pieces: the largest that fits, again and again; then two for the smallest if they fit its gap more tightly."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        inside, gap = [], capacity
        while (n := next((x for x in left if x <= gap), None)) is not None:
            inside.append(n)
            left.remove(n)
            gap -= n
        if gap and len(inside) > 1:
            room, best = gap + inside[-1], None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if inside[-1] < a + b <= room and (best is None or a + b > sum(best)):
                        best = (a, b)
            if best:
                left.append(inside.pop())
                for x in best:
                    left.remove(x)
                    inside.append(x)
                left.sort(reverse=True)
        bins.append(inside)
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_against_plain_best_two_fit(seed):
    """As many bins as packing piece by piece, or fewer than one in fifty more (equal lengths are packed together); the fill of the first bin is the same."""
    r = random.Random(seed)
    lengths = [r.choice([r.randrange(1, 40), r.randrange(1, 101), 100]) for _ in range(r.randrange(1, 160))]
    counts = {n: lengths.count(n) for n in lengths}
    plan, plain = packing.plan(counts, 100), plain_pack(lengths, 100)
    assert sum(plan[0][0]) == sum(plain[0])
    assert sum(t for _, t in plan) <= len(plain) + max(1, len(plain) // 50)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD)
    rows = odd_rows()
    path = f"file://{tmp_path}/files"
    token_files.write(table(spark, rows), path, WORD, files=3)
    got = token_files.read(spark, path).collect()
    by = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in by:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in by] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = sorted((repr(i), brute.crc([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    assert sorted((repr(r["doc_id"]), zlib.crc32(bytes(r["ids"]))) for r in got) == want
    assert token_files.lookup(spark, path, 99) is None and token_files.lookup(spark, path, 12) == [*plain.encode(ODD[12], add_special_tokens=False).ids, 2]
    assert token_files.lookup(spark, path, 5) == [*plain.encode(ODD[5], add_special_tokens=False).ids, 2]
    empty = f"file://{tmp_path}/empty"
    token_files.write(table(spark, []), empty, WORD)
    assert token_files.read(spark, empty).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    cases = [
        ("http://a.NET/x", "net/", "block"), ("https://www.example.net/en/1?q", "example.net/en/", "allow"), ("https://www.example.net/en", "net/", "block"), ("http://example.com/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", None, "allow"), ("http://x.org/fr/a#b", "org/fr/", "allow"), ("http://x.org/en/", None, "allow"), ("http://net", None, "allow"), ("net/x", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://a.net/" + "p/" * 5000, "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, (u, _, _) in enumerate(cases * 2)], "page_id long, url string, key string")
    for small in (16_000_000, 0):
        url_filter.BROADCAST_BYTES = small
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
        assert got == {i: (r, v) for i, (_, r, v) in enumerate(cases * 2)}
    url_filter.BROADCAST_BYTES = 16_000_000
    clash = pages.select("page_id", "url", "key", *[F.lit("old").alias(n) for n in ("best", "u_host", "found_host", "Host", "rule", "c_key", "block")])
    got = url_filter.judge(clash, rules)
    assert got.columns == [*clash.columns, "host_", "path", "rule_", "verdict"] and {r["page_id"]: (r["rule_"], r["verdict"]) for r in got.collect()} == {i: (r, v) for i, (_, r, v) in enumerate(cases * 2)}
    both = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), ("\u00c9.org", "/", "block")], rules.schema)
    assert {r["url"]: r["verdict"] for r in url_filter.judge(pages.select("url").union(spark.createDataFrame([("http://\u00c9.ORG/",), ("http://\u00e9.org/",)], "url string")), both).collect() if r["url"] in ("http://net", "http://\u00c9.ORG/", "http://\u00e9.org/")} == {"http://net": "allow", "http://\u00c9.ORG/": "block", "http://\u00e9.org/": "allow"}
    assert url_filter.judge(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(cases) * 2
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(5000).select(F.concat(F.lit("other"), "id").alias("key"))
    blocks = url_filter.bloom(keys, "key", 320)
    assert url_filter.passes(keys, "key", blocks, 320, True).count() == 5000
    assert url_filter.passes(others, "key", blocks, 320, True).count() < 250


def test_sharding(spark):
    rows = spark.range(4000).select((F.col("id") % 3900).alias("doc_id"), F.col("id").alias("tie")).unionByName(spark.createDataFrame([(None, 1), (None, 2)], "doc_id long, tie long"))
    got = sharding.assign(rows, "doc_id", tie=("tie",)).collect()
    assert len(got) == 4002
    shard_of, grown_of, slots = {}, {}, {}
    for r in got:
        assert shard_of.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert all(150 < len(s) < 360 for s in slots.values())
    assert 120 < sum(r["grown_shard"] == 16 for r in got) < 360
    assert sharding.assign(rows.limit(0), "doc_id", tie=("tie",)).count() == 0
    clash = sharding.assign(rows.withColumns({"SLOT": F.lit(1), "slot_part": F.lit("x"), "first_of_shard": F.lit("y")}), "doc_id", tie=("tie",))
    assert set(clash.columns) == {"doc_id", "tie", "SLOT", "slot_part", "first_of_shard", "shard", "grown_shard", "slot_"}
    assert sorted((r["shard"], r["slot_"]) for r in clash.collect()) == sorted((r["shard"], r["slot"]) for r in got)


def plain_draw(key, children):
    """The child of least -ln(u) / weight, u from md5(name ~ key)."""
    u = lambda n: (int(hashlib.md5(f"{n}~{'' if key is None else key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    return min(children, key=lambda n: -math.log(u(n)) / children[n]) if len(children) > 1 else next(iter(children))


def plain_shard(key, tree):
    total = lambda racks: sum(sum(s.values()) for s in racks.values())
    r = plain_draw(key, {r: total(k) for r, k in tree.items()})
    k = plain_draw(key, {f"{r}/{k}": sum(s.values()) for k, s in tree[r].items()}).rsplit("/", 1)[1]
    return int(plain_draw(key, {f"{r}/{k}/{s}": w for s, w in tree[r][k].items()}).rsplit("/", 1)[1])


def test_sharding_query(spark, sf_dir):
    """op6 against plain descents of the same trees."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_hash_tree_sharding(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        i, data = r["doc_id"], texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == plain_shard(i, sharding.grid(16)) and r["grown_shard"] == plain_shard(i, sharding.grid(17))
    for shard in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_a_weight_moves_rows_of_its_subtree_only(spark):
    """A rack's shard gets heavier while its rack's and region's other weights shrink to the same sum: only rows within that rack move. A heavier region draws rows only into itself."""
    tree = sharding.grid(16)
    within = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    a, b = within["r1"]["k0"]
    within["r1"]["k0"][a], within["r1"]["k0"][b] = 1.5, 0.5
    heavy = {r: {k: {s: w * (2 if r == "r2" else 1) for s, w in x.items()} for k, x in racks.items()} for r, racks in tree.items()}
    keys = spark.range(3000)
    rows = keys.select("id", *[sharding.shard_of(F.col("id"), t).alias(n) for n, t in (("old", tree), ("new", within), ("heavy", heavy))]).collect()
    moved = {(r["old"], r["new"]) for r in rows if r["old"] != r["new"]}
    assert moved == {(b, a)}
    drawn = {(r["old"], r["heavy"]) for r in rows if r["old"] != r["heavy"]}
    assert drawn and all(new in range(8, 12) and old not in range(8, 12) for old, new in drawn)
    assert all((r["old"], r["new"], r["heavy"]) == tuple(plain_shard(r["id"], t) for t in (tree, within, heavy)) for r in rows[:500])


def test_quality_rules(spark):
    good = "The house is on the hill and it was built by the people of that town . " * 2 + " ".join(f"word{i} of the" for i in range(40))
    rows = [(1, good), (2, "a | b"), (3, None), (4, ""), (5, "spam " * 200), (6, good.upper()), (7, " ".join(f"x{i}###" for i in range(90))), (8, good), (9, good + " z" * 60000)]
    out, name = quality_rules.judged(table(spark, rows))
    got = {r["doc_id"]: r[name] for r in out.collect()}
    assert {i for i, s in got.items() if s["kept"]} == {1, 8}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and got[5]["n_repeat_words"] == 200 and got[9]["n_repeat_words"] >= 60000
    kept = quality_rules.keep_good(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_words", "Rules"] and kept.count() == 2
    assert quality_rules.keep_good(table(spark, [])).count() == 0


def test_line_dedup(spark):
    passage = "one line\ntwo lines\nthree lines\nfour lines"
    rows = [(1, f"start\n{passage}\nend"), (2, f"{passage}\nother"), (3, f"x\n\ny\n{passage}"), (4, "short\ntext"), (5, None), (6, ""), (7, passage), (None, passage + "\ntail"), (8, "a\nb\nc\na\nb\nc\nd"), (4, "short\ntext"), (9, "u\nu\nu\nu\nu")]
    sentences = "  Here a first sentence stands. And then, a second one? It ends with a third that has some more words, so that all is long! "
    rows += [(10, "before it. " + "Words of its own come first. " * 2 + sentences + "Last."), (11, "Quite other words, so many that this line is long as well." + sentences + "And then other words follow to the end of it. \r\nnext"), (12, "x. y. z. " + "w " * 30), (13, "x. y. z. " + "v " * 30), (14, "x.\ny.\nz."), (15, "\tx. \ny.\n z.")]
    clash = table(spark, rows).withColumns({"l_id": F.lit(1), "l_hash": F.lit(2), "repeated_id": F.lit(3), "cleaned": F.lit(4), "window": F.lit(5)})
    out, name = line_dedup.cleaned(clash.repartition(3))
    assert out.columns == [*clash.columns, name]
    got = {(r["doc_id"], r["text"]): r[name]["text"] for r in out.collect()}
    assert got == brute.line_dedup(rows)
    kept = line_dedup.dedupe(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_words", "Rules"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14]
    assert "second one" not in got[11, rows[-5][1]] and got[13, rows[-3][1]] == rows[-3][1]
    assert line_dedup.dedupe(table(spark, [])).count() == 0


def test_passages_inside_lines_go(spark):
    """Runs of over 50 words, as sentences, planted at any place of long and short lines."""
    r = random.Random(11)

    def prose(n):
        out = []
        while n > 0:
            k = min(n, r.randrange(3, 22))
            out.append(" ".join(f"w{r.randrange(10**6)}" for _ in range(k)) + ".")
            n -= k
        return out

    passages = [prose(r.randrange(50, 120)) for _ in range(40)]
    rows, planted = [], []
    for i in range(120):
        p = passages[i % 40]
        a, b = prose(r.randrange(1, 200)), prose(r.randrange(1, 200))
        whole = " ".join([*a, *p, *b])
        if i % 3 == 0:
            whole = "\n".join([" ".join(a), " ".join(p), " ".join(b)])
        rows.append((i, whole))
        planted.append((i, " ".join(p), " ".join(a), " ".join(b)))
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedupe(table(spark, rows).repartition(3)).collect()}
    left = 0
    for i, p, a, b in planted:
        if i < 40:
            assert got[i] == rows[i][1]
        else:
            w, full = got[i].split(), p.split()
            left += any(tuple(full[k : k + 50]) in set(zip(*[w[o:] for o in range(50)], strict=False)) for k in range(len(full) - 49))
            assert a in got[i] and b in got[i]
    assert left <= 2


def test_decontamination(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 20, 13, 5, 1])] + [(9, None), (10, "..."), (2, "Twice listed, " + " ".join(word() for _ in range(12)))]
    text = " ".join(word() for _ in range(60))
    rows = [(1, text), (2, f"{text} {items[0][1].upper()}! {text}"), (3, f"{items[1][1]}"), (4, None), (5, ""), (6, f"a {items[3][1]} b {items[2][1]}"), (7, items[4][1]), (8, " ".join(items[0][1].split()[:12])), (2, "again"), (None, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 100):
        out, name = decontaminate.matched(table(spark, rows), bench, block_bytes=block)
        got = sorted((repr(x["doc_id"]), x[name]["n_words"], x[name]["n_hit"], x[name]["items"]) for x in out.collect())
        assert got == sorted((repr(i), *brute.contamination(t, items)) for i, t in rows)
    best = {x["doc_id"]: x[name] for x in out.collect()}
    assert best[3]["match_words"] == 20 and best[3]["match_item"] == "1" and best[3]["match_start"] == 0
    clean = decontaminate.clean(table(spark, rows), bench)
    assert clean.columns == ["doc_id", "text", "n_words", "Rules"] and {r["doc_id"] for r in clean.collect()} >= {4, 5}
    assert decontaminate.clean(table(spark, []), bench).count() == 0 and decontaminate.clean(table(spark, rows), bench.limit(0)).count() == len(rows)


def jaccard_rows():
    rows = []
    for f in range(6):
        rows += [(len(rows) + k, t) for k, t in enumerate(family(f, 7, 40 + 60 * f, 4))]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + k, passage + " " + t) for k, t in enumerate(family(99, 1, 70) + family(98, 1, 60) + family(97, 1, 50) + [x for s in range(12) for x in family(200 + s, 1, 30 + 2 * s)])]
    rows += [(2000, "one two"), (2001, "One  TWO"), (2002, "one two three"), (2003, ""), (2004, None), (2005, " \n"), (2006, rows[0][1]), (None, rows[0][1]), (2007, rows[0][1]), (0, rows[0][1]), (2008, "a b c d e"), (2009, "a b c d e f"), (2010, "y " * 9000)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"COARSE": (6.0, 0.1, 4, 2), "SEEN": 1}, {"SMALL": 2, "PIVOTS": 1, "OUTSIDE": 3, "MEMBERS": 4}, {"SMALL": 2, "PIVOTS": 1, "COARSE": (30.0, 0.0, 3, 1), "PART_BYTES": 2000, "BROADCAST_ROWS": 0}])
def test_jaccard_join(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rows = jaccard_rows()
    got = jaccard_join.join(table(spark, rows).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute.components(rows)


def test_jaccard_keep_one(spark):
    rows = jaccard_rows()
    clash = table(spark, rows).withColumns({"__id": F.lit(1), "kept_id": F.lit(2), "component_id": F.lit(3)})
    kept = jaccard_join.keep_one(clash)
    assert kept.columns == clash.columns
    want = {c for _, n, c in brute.components(rows) if n} | {2003, 2004, 2005}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert jaccard_join.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("scheme", [jaccard_join.COARSE, (6.0, 0.1, 4, 2), (4.0, 0.0, 2, 1), jaccard_join.FINE])
def test_linked_sets_share_signatures(scheme):
    """Sets as far apart as links allow share g signatures by the enumeration, or a feature of their prefixes."""
    r = np.random.default_rng(4)
    signer = jaccard_join.Signer(75, scheme)
    by_subsets = 0
    for size in [3, 4, 5, 8, 15, 16, 17, 40, 63, 64, 70, 100, 255, 256, 300, 900, 1024, 1100] * 6:
        differ = int(r.integers(0, signer.spoiled(np.array([size]))[0] + 1))
        lost = int(r.integers(0, differ + 1))
        a = np.unique(r.integers(1, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[lost:], r.integers(1, 1 << 63, differ - lost, dtype=np.uint64)]))
        if 100 * (len(a) - lost) < 75 * len(np.union1d(a, b)) or not differ:
            continue
        sig, entity, g = signer.sign(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.array([0, 4], np.uint64), np.arange(2))
        of = lambda key, poor: {int(s): int(n) for s, e, n in zip(sig, entity, g, strict=True) if int(e) & ~3 == key and (int(e) & 3 == 2) == poor}  # noqa: E731, B023
        x, y = of(0, False), of(4, False)
        shared = x.keys() & y.keys()
        if of(0, True) and of(4, True):
            assert shared or of(0, True).keys() & of(4, True).keys()
        else:
            by_subsets += 1
            assert len(shared) >= max(min(x.values(), default=1), min(y.values(), default=1))
    assert by_subsets > 20


def test_bitmaps_bound_the_distance():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 60, r.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.8], r.integers(0, 1 << 60, r.integers(1, 60), dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard_join.bitmap(s), np.uint8) for s in (a, b))
        n = min(len(x), len(y))
        assert np.bitwise_count(jaccard_join.folded(x, n) ^ jaccard_join.folded(y, n)).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 301)] + [(500, 500 + k) for k in range(1, 30)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(4)
    both = [{r["key"]: r["component"] for r in components.components(links, n).collect()} for n in (10**6, 0)]
    assert both[0] == both[1] and both[0][40] == 0 and both[0][200] == 100 and both[0][529] == 500
    assert components.components(links.limit(0)).count() == 0


def test_pseudonyms(spark):
    text = "Call +1 (017) 555-7713 or mail jo.72@mail3.example.com, card 4417744280351547, ip 169.122.221.182, born 1987-03-09, due 28/09/2025; not 1234567890123456, 999.1.1.1, 2025-13-40."
    rows = [(1, text), (2, "again 4417744280351547 and 1987-03-09."), (3, None), (4, ""), (5, "no values"), (1, text), (6, "7" * 100000)]
    out, name = pseudonyms.pseudonymised(table(spark, rows), "secret")
    got = {r["doc_id"]: r[name] for r in out.collect()}
    kinds = {(v["kind"], v["value"]): v["pseudonym"] for s in got.values() for v in s["values"]}
    assert {k for k, _ in kinds} == {"phone", "email", "card", "ip", "date"}
    changed = got[1]["text"]
    for (_, value), p in kinds.items():
        assert value not in changed and len(p) >= 7 and p != value
    assert "1234567890123456" in changed and "999.1.1.1" in changed and "2025-13-40" in changed and changed.startswith("Call +")
    card = kinds["card", "4417744280351547"]
    assert card in got[2]["text"] and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "no values" and got[6]["text"] == "7" * 100000
    other = {r["doc_id"]: r[name] for r in pseudonyms.pseudonymised(table(spark, rows), "else")[0].collect()}
    assert other[1]["text"] != changed


def test_pseudonyms_are_permutations(spark):
    codes = spark.range(100000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("d"))
    assert codes.select(pseudonyms.permuted_digits(F.col("d"), "k", "t").alias("p")).filter("p rlike '^[0-9]{5}$'").distinct().count() == 100000
    days = spark.range(5000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.select(pseudonyms.pseudonym(F.col("d"), "k").alias("p")).filter("try_to_date(p) is not null").distinct().count() == 5000


def test_votes_are_exact(spark, sf_dir):
    """op9 against cosines with every labelled vector, one document at a time."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_knn.fit(docs, labels.filter(~quality_knn.held_out(F.col("doc_id"))), "doc_id", "text", "quality")
    got = {r["doc_id"]: r for r in queries.op9_quality_knn(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got.keys() == {r["doc_id"] for r in rows}
    for r in rows:
        x = quality_knn.terms(pa.array([r["text"]], pa.string()))[0].astype(float) * model.weight
        v = x @ model.axes.astype(float)
        v /= max(np.sqrt((v * v).sum()), 1e-12)
        cosine = sorted(((float((v * y).sum()), float(q)) for y, q in zip(model.vectors.astype(float), model.labels, strict=True)), reverse=True)
        near = cosine[: model.neighbours]
        if cosine[model.neighbours - 1][0] - cosine[model.neighbours][0] > 1e-5:  # the neighbours are not tied
            want = sum(max(c, 1e-6) ** 4 * q for c, q in near) / sum(max(c, 1e-6) ** 4 for c, _ in near)
            assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-3)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)


def test_labelled_ids_that_repeat_are_bounded(spark):
    docs = spark.range(600).selectExpr("id % 3 doc_id", "concat('text ', id) text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels, "doc_id", "text", "quality")
    assert len(model.labels) == 2


def test_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_knn.fit(docs, labels.filter(~quality_knn.held_out(F.col("doc_id"))), "doc_id", "text", "quality")
    out, name = quality_knn.scored(docs, model)
    held = out.join(labels, "doc_id").filter(quality_knn.held_out(F.col("doc_id"))).select("quality", name).collect()
    pos, neg = ([r[name] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in pos for b in neg]) > 0.9
    out, name = quality_knn.scored(table(spark, odd_rows()), model)
    assert all(0 <= r[name] <= 1 for r in out.collect())
    none = quality_knn.fit(docs, labels.limit(0), "doc_id", "text", "quality")
    assert {r[0] for r in quality_knn.scored(docs, none)[0].select("quality_score").distinct().collect()} == {0.5}
    assert quality_knn.scored(table(spark, []), model)[0].count() == 0
