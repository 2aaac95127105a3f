"""The queries opN_<name> with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, line_dedup, packing, pseudonyms, quality_knn, quality_rules, sharding, token_files, url_filter
from .common import read, scratch

#: The listed rules (host, path, verdict).
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


#: Production takes its own secret; queries have a fixed one, so that their results can be compared.
PSEUDONYM_KEY = "tessellate"


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op3_partenum_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents")).drop("set_key", "text_hash")


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = pseudonyms.pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    s = F.col(name)
    count = lambda kind: F.size(F.filter(s["values"], lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", s["text"].alias("text"), *map(count, ("email", "date", "ip", "phone", "ssn", "card")))


def op5_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = line_dedup.cleaned(read(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col(name)
    return out.select("doc_id", s["n_lines"].cast("long").alias("n_lines"), s["n_removed"].cast("long").alias("n_removed"), s["text"].alias("text"))


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.assign(rows, "doc_id", tie=("text_crc32", "size"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = quality_rules.judged(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(name)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~quality_knn.held_out(F.col("doc_id")))
    out, name = quality_knn.scored(docs, quality_knn.fit(docs, labels, "doc_id", "text", "quality"))
    return out.select("doc_id", quality_knn.held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = decontaminate.matched(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    s = F.col(name)
    return out.select("doc_id", s["n_words"].alias("n_words"), s["n_hit"].alias("n_hit"), F.size(s["items"]).cast("long").alias("n_items"), decontaminate.items_sha256(s).alias("items_sha256"), decontaminate.contaminated(s).alias("contaminated"), s["match_words"].cast("long").alias("match_words"), s["match_item"].alias("match_item"), s["match_start"].cast("long").alias("match_start"))


QUERIES = {f.__name__: f for f in (op1_best_two_fit_packing, op2_url_filter, op3_partenum_jaccard_join, op4_feistel_pseudonyms, op5_line_window_dedup, op6_hash_tree_sharding, op7_quality_rules, op8_token_files, op9_quality_knn, op10_suffix_array_decontamination)}


def _op2_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return rf"""
WITH seen AS (
  SELECT page_id, row_number() OVER () AS rid,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(r_host, r_path, said) AS (VALUES {rules}),
fits AS (
  SELECT rid, r_host || r_path AS rule, said, row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS place
  FROM seen JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM seen LEFT JOIN fits ON seen.rid = fits.rid AND place = 1"""


def _op7_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    t = {x.ratio: x for x in quality_rules.THRESHOLDS}
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p + o) AS n FROM win JOIN twice USING (rid, g), (VALUES (0), (1), (2)) AS off(o) GROUP BY rid),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([{stop}], lower(rtrim(x, '.,;:!?'))))) AS n_stop,
         len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_upper
  FROM d LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN {t["mean_word_length"].low} AND {t["mean_word_length"].high} AND n_symbols / n_words <= {t["symbol_ratio"].high}
       AND n_stop / n_words >= {t["stop_word_ratio"].low} AND n_dup_lines / n_lines <= {t["dup_line_ratio"].high} AND n_upper / n_words <= {t["upper_word_ratio"].high} AS kept
FROM b"""


_OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
ln AS (SELECT rid, unnest(ls) AS line, unnest(range(len(ls))) AS l FROM (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM d)),
n AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM ln),
w AS (SELECT rid, l, CASE WHEN words > {line_dedup.LONG} THEN list_filter(string_split(regexp_replace(line, '([.!?][\x20\x09-\x0D]+)', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ELSE [line] END AS ps FROM n WHERE words > 0),
u AS (SELECT rid, l, len(ps) = 1 AS whole, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM w),
x AS (SELECT *, list_filter(regexp_split_to_array(piece, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, row_number() OVER (PARTITION BY rid ORDER BY l, k) AS q FROM u),
docs AS (SELECT rid, list(array_to_string(ws, ' ') ORDER BY q) AS g, list(len(ws) ORDER BY q) AS n, list(whole ORDER BY q) AS whole FROM x GROUP BY rid),
win AS (
  SELECT rid, p, g[p] || chr(10) || g[p + 1] || chr(10) || g[p + 2] AS g FROM (SELECT *, unnest(range(1, len(g) - 1)) AS p FROM docs)
  WHERE n[p] + n[p + 1] + n[p + 2] >= {line_dedup.LEAST} OR whole[p] OR whole[p + 1] OR whole[p + 2]),
later AS (SELECT rid, p FROM (SELECT rid, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM win JOIN d USING (rid)) WHERE n > 1),
gone AS (SELECT DISTINCT rid, p + o AS q FROM later, (VALUES (0), (1), (2)) AS off(o)),
kept AS (SELECT rid, l, string_agg(piece, '' ORDER BY q) AS line FROM x ANTI JOIN gone USING (rid, q) GROUP BY rid, l),
rest AS (SELECT rid, string_agg(line, chr(10) ORDER BY l) AS kept FROM kept GROUP BY rid),
c AS (SELECT rid, count(*) AS c FROM gone GROUP BY rid),
r AS (
  SELECT doc_id, text AS old, coalesce(len(g), 0)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_removed, CASE WHEN c > 0 THEN coalesce(kept, '') ELSE text END AS text
  FROM d LEFT JOIN docs USING (rid) LEFT JOIN c USING (rid) LEFT JOIN rest USING (rid))
SELECT documents.doc_id, n_lines, n_removed, r.text FROM documents JOIN r ON documents.doc_id IS NOT DISTINCT FROM r.doc_id AND documents.text IS NOT DISTINCT FROM r.old"""

_OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, p AS o, least(len(w), 13) AS k, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
win AS (
  SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks WHERE len(w) >= k)),
found AS (SELECT rid, item, p, o, win.k FROM win JOIN bw ON win.k = bw.k AND win.g = bw.g),
runs AS (SELECT rid, item, p, k, o - p AS diagonal, p - row_number() OVER (PARTITION BY rid, item, o - p, k ORDER BY p) AS island FROM (SELECT DISTINCT rid, item, p, o, k FROM found)),
matches AS (SELECT rid, item, min(p) - 1 AS start, count(*) + any_value(k) - 1 AS words FROM runs GROUP BY rid, item, diagonal, k, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY words DESC, item, start) AS n FROM matches) WHERE n = 1),
hits AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM found) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY rid),
r AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
         coalesce(words, 0)::BIGINT AS match_words, item AS match_item, start::BIGINT AS match_start FROM dw LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid) LEFT JOIN best USING (rid))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM r"""

ORACLE = {"op5_line_window_dedup": _OP5_SQL, "op10_suffix_array_decontamination": _OP10_SQL, "op2_url_filter": _op2_sql(), "op7_quality_rules": _op7_sql()}
