"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import callouts, strings
from ..registry import query, table

MARKED_SQL = f"translate(replace(replace(text, 'œ', 'oe'), 'Œ', 'Oe'), '{strings.MARKED}', '{strings.PLAIN}')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("F01_strip_accents", f"SELECT doc_id, md5({MARKED_SQL}) AS h FROM documents")
def accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(strings.strip_accents(F.col("text"))).alias("h"))


@query("F02_upper_plain", f"SELECT doc_id, md5(upper({MARKED_SQL.replace('(text', "(replace(text, 'ß', 'ss')")})) AS h FROM documents")
def upper_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(strings.norm_text(F.col("text"))).alias("h"))


@query("F03_slug", f"SELECT doc_id, trim(regexp_replace(lower({MARKED_SQL.replace('text', 'source || chr(32) || lang')}), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", strings.slug(F.concat_ws(" ", "source", "lang")).alias("slug"))


@query("F04_ascii_digits", "SELECT c_custkey, c_custkey::VARCHAR AS digits FROM customer")
def digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back: keys written in Arabic digits are read again."""
    arabic = F.translate(F.col("c_custkey").cast("string"), "0123456789", strings.ARABIC_DIGITS)
    return table(spark, sf_dir, "customer").select("c_custkey", strings.ascii_digits(arabic).alias("digits"))


@query("F05_canonical_form", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date, concat(o_custkey % 90 + 10, '/', o_custkey % 60 + 30) AS pressure, concat(o_custkey % 100, '.5 kg') AS amount FROM orders")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    text = lambda c: c.cast("string")
    raw = {"date": F.date_format("o_orderdate", "d - M - yyyy"), "pressure": F.concat(text(k % 90 + 10), F.lit(" /  "), text(k % 60 + 30)), "amount": F.concat(text(k % 100), F.lit(",5KG"))}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[strings.canonical(v).alias(n) for n, v in raw.items()])


@query("F06_norm_code", "SELECT s_suppkey, trim(regexp_replace(upper(s_name), '[\\s./_#]', '-', 'g'), '-') AS code FROM supplier")
def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", strings.norm_code(F.translate("s_name", "#", "_")).alias("code"))


@query("F07_code_distance", "SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE 1.0 END, 6) AS d FROM supplier")
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confusable last character costs 0.4, any other 1."""
    s = table(spark, sf_dir, "supplier")
    a, b = F.concat("s_name", F.lit("1")), F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "7").otherwise("9"))
    return s.select("s_suppkey", F.round(strings.code_distance(a, b), 6).alias("d"))


@query("F08_levenshtein", "SELECT p_partkey, levenshtein(p_brand, p_type)::BIGINT AS d, levenshtein(p_brand, concat(p_brand, p_size)) <= 2 AS near FROM part")
def levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.levenshtein("p_brand", F.concat(F.col("p_brand"), F.col("p_size").cast("string"))) <= 2
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_brand", "p_type").cast("long").alias("d"), near.alias("near"))


@query("F09_identifier_scan", "SELECT doc_id, regexp_matches(upper(text), '\\b[A-Z]{1,2}\\s?[0-9]{5,7}\\b') AS cin FROM documents")
def scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.array_contains(strings.scan(F.col("text"), F.lit("note")), "CIN").alias("cin"))


@query("P25_redaction", """
SELECT doc_id, CASE WHEN source = 'src3' THEN 'NOT_SUPPLIED' WHEN bad THEN 'TO_REVIEW' ELSE 'KEPT' END AS status, source = 'src3' OR bad AS redacted FROM (SELECT doc_id, source, regexp_matches(upper(text), '\\b[A-Z]{1,2}\\s?[0-9]{5,7}\\b') AS bad FROM documents)""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value in an identifier field is never kept; one that looks like an identifier elsewhere goes to review."""
    field = F.when(F.col("source") == "src3", F.lit("inline.patiente")).otherwise(F.lit("inline.note"))
    ident, hit = strings.is_identifier_field(field), F.array_contains(strings.scan(F.col("text"), F.lit("lieu")), "CIN")
    return docs(spark, sf_dir).select("doc_id", F.when(ident, "NOT_SUPPLIED").when(hit, "TO_REVIEW").otherwise("KEPT").alias("status"), (ident | hit).alias("redacted"))


SIZE_SQL = "CASE p_size % 3 WHEN 0 THEN '15M' WHEN 1 THEN '20M' ELSE '25M' END"


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callouts in eight forms, written from parts: what the grammar must read is known."""
    n, size = (F.col("p_size") % 12 + 1).cast("string"), F.when(F.col("p_size") % 3 == 0, "15M").when(F.col("p_size") % 3 == 1, "20M").otherwise("25M")
    mm, long = (F.col("p_size") * 5 + 100).cast("string"), (F.col("p_size") * 40 + 1000).cast("string")
    feet = F.concat((F.col("p_size") % 20 + 1).cast("string"), F.lit("-"), (F.col("p_size") % 12).cast("string"))
    forms = [
        (n, "-", size, " @ ", mm, " HAUT"), ("ARM. (", n, ") ", size, " ", mm, " c/c"), ("2x", n, " ", size, " 25A301"), ("T: ", n, " ", size, ' 20A12 @ 12"'), (n, "–", size, " LG ", long, " ÉTRIERS"), ("NIV 2 ", size, " A ", mm, " C/C BAS TOP"), ("B: ", n, "(3) ", size, " ", feet),
        (size, " @ ", mm, " 10M @ 200 + ", n, "-35M x ", long),
    ]
    line = F.lit(None)
    for k, parts in enumerate(forms):
        line = F.when(F.col("p_partkey") % 8 == k, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise(line)
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callouts.find_bars(written(spark, sf_dir), "line").withColumn("place", F.col("place").cast("long"))


WRITTEN_SQL = f"""
WITH p AS (SELECT p_partkey, p_partkey % 8 AS form, p_size % 12 + 1 AS n, {SIZE_SQL} AS size, p_size * 5 + 100 AS mm, p_size * 40 + 1000 AS long, round_even((12 * (p_size % 20 + 1) + p_size % 12) * 25.4, 0) AS feet FROM part),
b AS (
  SELECT p_partkey, 0 AS place, size, CASE form WHEN 5 THEN NULL WHEN 7 THEN NULL WHEN 2 THEN 2 * n ELSE n END AS quantity, CASE form WHEN 6 THEN 3 END AS sub, CASE WHEN form IN (0, 1, 5, 7) THEN mm WHEN form = 3 THEN 305 END AS spacing,
         CASE form WHEN 4 THEN long WHEN 6 THEN feet END AS length, CASE form WHEN 2 THEN '25A301' WHEN 3 THEN '20A12' END AS mark, CASE form WHEN 0 THEN 'sup' WHEN 3 THEN 'sup' WHEN 4 THEN 'ligature' WHEN 5 THEN 'inf' WHEN 6 THEN 'inf' END AS role, CASE form WHEN 5 THEN 0.855 ELSE 0.95 END AS conf FROM p
  UNION ALL SELECT p_partkey, 1, '10M', NULL, NULL, 200, NULL, NULL, NULL, 0.855 FROM p WHERE form = 7
  UNION ALL SELECT p_partkey, 2, '35M', n, NULL, NULL, long, NULL, NULL, 0.95 FROM p WHERE form = 7)
"""


@query("F10_callout_grammar", WRITTEN_SQL + "SELECT p_partkey, place::BIGINT AS place, size, quantity::BIGINT AS quantity, sub::BIGINT AS sub, mark, conf::DOUBLE AS conf FROM b")
def grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("p_partkey", "place", "bar.size", F.col("bar.quantity").cast("long").alias("quantity"), F.col("bar.sub").cast("long").alias("sub"), "bar.mark", "bar.conf")


@query("F11_spacing", WRITTEN_SQL + "SELECT p_partkey, place::BIGINT AS place, spacing::BIGINT AS spacing FROM b")
def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("p_partkey", "place", F.col("bar.spacing").cast("long").alias("spacing"))


@query("F12_length_feet", WRITTEN_SQL + "SELECT p_partkey, place::BIGINT AS place, length::BIGINT AS length FROM b")
def length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("p_partkey", "place", F.col("bar.length").cast("long").alias("length"))


@query("F13_ocr_repair", "SELECT p_partkey, concat(p_size % 12 + 1, '-', CASE p_size % 3 WHEN 0 THEN 15 WHEN 1 THEN 20 ELSE 25 END, 'M @ ', 100 + p_size * 5, CASE WHEN p_partkey % 2 = 0 THEN ' 2OMPa' ELSE '' END) AS text FROM part")
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callouts with confused characters, put right; what is no callout stays."""
    k = F.col("p_size") % 3
    noisy = F.when(k == 0, "-ISMe").when(k == 1, "–2OM a ".replace("a", "Q")).otherwise("~2SM&")
    line = F.concat((F.col("p_size") % 12 + 1).cast("string"), noisy, (F.col("p_size") * 5 + 100).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " 2OMPa").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", callouts.repaired(line).alias("text"))


@query("F14_role_keyword", WRITTEN_SQL + "SELECT p_partkey, place::BIGINT AS place, role FROM b")
def role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("p_partkey", "place", "bar.role")


@query("F15_labels", "SELECT p_partkey, concat('C', p_size) AS labels, concat(chr(65 + p_size % 26), '-', p_size % 90 + 1) AS bays, concat('S-', 100 + p_size, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END) AS sheets FROM part")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element labels, grid references and sheet numbers of one title, none taken for another."""
    k = F.col("p_size")
    text = lambda c: c.cast("string")
    title = F.concat(F.lit("COLONNE C"), text(k), F.lit(" BETON 35MPa / C-1 AXE "), F.char(F.lit(65) + k % 26), F.lit("/"), text(k % 90 + 1), F.lit(" c/c 1/2 VOIR S-"), text(k + 100), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise(""), F.lit(" TYPE 1"))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.array_join(v, "|").alias(n) for n, v in (("labels", strings.element_labels(title, "C")), ("bays", strings.grid_refs(title)), ("sheets", strings.sheet_ids(title)))])


@query("F16_levels", "SELECT p_partkey, concat_ws('|', (p_size % 9)::VARCHAR, (p_size % 9 + 1)::VARCHAR) AS levels FROM part")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("X_COLONNE-NIV-"), (F.col("p_size") % 9).cast("string"), F.lit("@"), (F.col("p_size") % 9 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(callouts.levels(title), "|").alias("levels"))


@query("F17_type_keywords", """
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'fondation' WHEN 1 THEN 'mur de refend' WHEN 2 THEN 'mur de refend' WHEN 3 THEN 'colonne' WHEN 4 THEN 'poutre' WHEN 5 THEN 'dalle' END AS by_title,
       CASE p_size % 8 WHEN 1 THEN 'fondation' WHEN 3 THEN 'poutre' WHEN 4 THEN 'mur de refend' WHEN 5 THEN 'colonne' WHEN 6 THEN 'dalle' END AS by_sheet FROM part""")
def type_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of what a sheet shows, by its title's first keyword and by its number's series."""
    title = F.get(F.array(*map(F.lit, ("Semelles et radiers", "Murs cisaillements", "CONCENTRATION COLONNES", "COLONNES NIV 2", "Poutres", "DALLE TRÉFOND", "NOTES"))), F.col("p_size") % 7)
    sheet = F.concat(F.lit("S-"), (F.col("p_size") % 8).cast("string"), F.lit("01"))
    return table(spark, sf_dir, "part").select("p_partkey", strings.type_of_title(title).alias("by_title"), strings.type_of_sheet(sheet).alias("by_sheet"))


@query("F18_format_repair", "SELECT p_partkey, concat('1', p_size % 10, '0') AS best FROM part")
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a noisy number: confused characters back to digits, kept if they are in range."""
    noisy = F.concat(F.lit("I"), (F.col("p_size") % 10).cast("string"), F.lit("O"))
    candidates = F.array(noisy, F.translate(noisy, "IlOoSsBZ", "11005582"))
    good = F.filter(candidates, lambda c: c.rlike(r"^\d{3}$"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(good, F.lit(0)).alias("best"))


@query("F19_field_grammar", "SELECT page_id, regexp_matches(url, '^https?://[a-z0-9.-]+/(en|fr|de|es)/[0-9]+(\\.html|/)?([?#].*)?$') AS grammatical, coalesce(try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), 0) BETWEEN 100 AND 900 AS plausible FROM pages")
def field_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    n = F.coalesce(F.regexp_extract(u, "/([0-9]+)", 1).try_cast("long"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", u.rlike(r"^https?://[a-z0-9.-]+/(en|fr|de|es)/[0-9]+(\.html|/)?([?#].*)?$").alias("grammatical"), n.between(100, 900).alias("plausible"))


@query("F20_describe_bar", WRITTEN_SQL + "SELECT p_partkey, place::BIGINT AS place, concat(CASE WHEN quantity IS NULL THEN '' ELSE concat(quantity, '-') END, size, CASE WHEN spacing IS NULL THEN '' ELSE concat('@', spacing) END, CASE WHEN length IS NULL THEN '' ELSE concat(' L=', length::BIGINT) END) AS text FROM b")
def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("p_partkey", "place", callouts.describe(F.col("bar")).alias("text"))


@query("F21_french_number", "SELECT c_custkey, replace(replace(replace(format('{:,.2f}', c_acctbal), ',', chr(8239)), '.', ','), '-', chr(8722)) AS text FROM customer")
def french(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", strings.french_number(F.col("c_acctbal")).alias("text"))


@query("F22_grid_label_value", "SELECT p_partkey, (p_size % 26 + 1 + 26)::DOUBLE AS v FROM part")
def grid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("A"), F.char(F.lit(65) + F.col("p_size") % 26))
    return table(spark, sf_dir, "part").select("p_partkey", strings.label_value(label).alias("v"))


@query("F23_bay_key", "SELECT p_partkey, concat(chr(65 + p_size % 26), ':', p_size) AS bay FROM part")
def bays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both notations of a bay meet in one key."""
    axis, row = F.char(F.lit(65) + F.col("p_size") % 26), F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(axis, F.lit("-Z/"), row)).otherwise(F.concat(axis, F.lit(".1-"), row))
    k = strings.bay_key(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", k["axis"], k["row"].cast("string")).alias("bay"))


@query("F24_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("F25_shape_mask", "SELECT o_orderkey, regexp_replace(regexp_replace(o_orderpriority, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape FROM orders")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.shape(F.col("o_orderpriority")).alias("shape"))


@query("F26_glyph_repair", """
WITH v AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1),
b AS (SELECT DISTINCT w, concat('_', substr(w, 2)) AS broken FROM v)
SELECT broken, w AS best FROM (SELECT b.broken, v.w, row_number() OVER (PARTITION BY broken ORDER BY n DESC, v.w) AS r FROM (SELECT DISTINCT broken FROM b) b JOIN v ON substr(v.w, 2) = substr(b.broken, 2)) WHERE r = 1""")
def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word with its first glyph missing becomes the most frequent word that fits: an equi-join on the rest of the word."""
    v = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).withColumn("rest", F.expr("substring(w, 2)"))
    return v.groupBy("rest").agg(F.min(F.struct((-F.col("n")).alias("n"), "w")).alias("b")).select(F.concat(F.lit("_"), F.col("rest")).alias("broken"), F.col("b.w").alias("best"))


@query("F30_dates", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS days, strftime(o_orderdate::DATE + 280, '%Y-%m-%d') AS due, floor(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 7)::BIGINT AS week, quarter(o_orderdate)::BIGINT AS q, strftime(last_day(o_orderdate::DATE), '%d/%m/%Y') AS month_end FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    days = F.datediff(d, F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.cast("long").alias("days"), F.date_format(F.date_add(d, 280), "yyyy-MM-dd").alias("due"), F.floor(days / 7).alias("week"), F.quarter(d).cast("long").alias("q"), F.date_format(F.last_day(d), "dd/MM/yyyy").alias("month_end"))


@query("F31_maths", "SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) AS log1p, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sigmoid, greatest(least(c_acctbal, 5000), 0) AS clipped, greatest(3.0, round_even(0.02 * abs(c_acctbal), 0)) AS tolerance FROM customer")
def maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.log1p(F.abs(x)), 6).alias("log1p"), F.round(1 / (1 + F.exp(-x / 1000)), 6).alias("sigmoid"), F.greatest(F.least(x, F.lit(5000.0)), F.lit(0.0)).alias("clipped"), F.greatest(F.lit(3.0), F.bround(0.02 * F.abs(x))).alias("tolerance"))


@query("F32_json_maps", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, bit_count(xor(event_id, user_id))::BIGINT AS bits FROM events")
def json_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload read with its schema; the distance of two hashes as the bits in which they differ."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.bit_count(F.col("event_id").bitwiseXOR(F.col("user_id"))).cast("long").alias("bits"))


@query("F33_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set against all rows of its block."""
    return cosine_of(*query_vectors(spark, sf_dir))


def query_vectors(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    a = e.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    return a, e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y")), dot


def cosine_of(a: DataFrame, b: DataFrame, dot) -> DataFrame:
    return a.join(b, "label").select("a", "b", F.round(dot(F.col("x"), F.col("y")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y"))), 4).alias("cosine"))
