"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of what it lets pass.

A rule is (host, path, verdict); it fits a host and all its subdomains if the url's path starts with the rule's, and the longest
fitting rule wins. Each distinct (host, path) gives its candidate keys: every host suffix with every path prefix that ends at a
slash, no deeper than the deepest rule. A block of the filter is eight 32-bit words; a key sets one bit in each word of one
block. Keys that pass meet the rules in a join on the key itself, so a false positive is dropped there. Cases:

* null url or one without `://`: host and path are empty; no rule fits; the default verdict holds.
* empty and very long urls: whole; only as many labels and prefixes are tried as some rule has.
* ties: rules of one length that fit one url are told apart by host length, then by the rule's text; a rule listed twice counts once, one listed
  with different verdicts has the last of them in order of text (`block` before `allow`). Rules' hosts are lower-cased as those of urls (A-Z).
* repeated rows: judged alike, each kept. Empty tables: no rows, or the default for all.
* extra columns and clashing names: `judge` carries all columns; one that it adds gets an underscore more where its name is taken.
* one host or url with a third of all rows: urls are made distinct (partial sums first) before anything is expanded; the join
  back is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added_names, free_name, let, lower_ascii

#: Sides under this many bytes are broadcast; their size is measured first.
BROADCAST_BYTES = 16_000_000
WORDS = 8
SALTS = tuple(range(1, WORDS + 1))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _prefix(path: Column) -> Column:
    """A path up to and with its last slash."""
    return F.regexp_extract(path, r"^(?s:.*/)?", 0)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block."""
    h = F.xxhash64(key)
    place = lambda s: F.pmod(F.shiftright(F.xxhash64(h, F.lit(s)), 32), F.lit(32)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(s)) for s in SALTS]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's blocks that hold any key: block int, w0 to w7 long. Each task merges its own bits first."""
    bits = keys.select(_block(F.col(key), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def passes(candidates: DataFrame, key: str, filter_blocks: DataFrame, blocks: int, small: bool) -> DataFrame:
    """The candidates that the filter cannot rule out."""
    other = filter_blocks.withColumnRenamed("block", "__block")
    joined = candidates.join(F.broadcast(other) if small else other, _block(F.col(key), blocks) == F.col("__block"))
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col(key))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return joined.filter(hit).drop("__block", *[f"w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", bits_per_key: int = 16, names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """pages with host, path, the rule that wins (host then path, else null) and its verdict. rules: host, path, verdict."""
    host, path, rule, said = added_names(pages, names)
    listed = rules.filter("host is not null and path is not null and verdict is not null").select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_said"))
    listed = listed.groupBy("r_host", "r_path").agg(F.max("r_said").alias("r_said")).withColumn("key", F.concat_ws("\n", "r_host", _prefix(F.col("r_path"))))
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("r_path") + 40), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)).alias("labels"), F.coalesce(F.max(F.char_length(F.col("r_path")) - F.char_length(F.translate("r_path", "/", ""))), F.lit(0)).alias("slashes")).first()
    blocks = max(1, -(-size["n"] * bits_per_key // (32 * WORDS)))
    small, tiny_filter = size["bytes"] <= BROADCAST_BYTES, blocks * (WORDS + 2) * 8 <= BROADCAST_BYTES

    seen = pages.withColumns({host: host_of(F.col(f"`{url_col}`")), path: path_of(F.col(f"`{url_col}`"))})
    urls = seen.filter(F.col(host) != "").select(F.col(host).alias("u_host"), F.col(path).alias("u_path")).distinct()
    labels = F.split("u_host", r"\.")
    suffixes = let(labels, lambda a: F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.lit(max(1, size["labels"])))), lambda k: F.array_join(F.slice(a, F.size(a) - k + 1, k), ".")))
    steps = F.split("u_path", "/")
    prefixes = let(steps, lambda a: F.transform(F.sequence(F.lit(0), F.least(F.size(a) - 1, F.lit(size["slashes"]))), lambda k: F.concat(F.array_join(F.slice(a, F.lit(1), k), "/"), F.when(k > 0, F.lit("/")).otherwise(F.lit("")))))
    candidates = urls.withColumn("c_host", F.explode(suffixes)).withColumn("c_key", F.explode(F.transform(prefixes, lambda p: F.concat_ws("\n", F.col("c_host"), p)))).drop("c_host")

    maybe = passes(candidates, "c_key", bloom(listed, "key", blocks), blocks, tiny_filter)
    if small:
        exact = maybe.join(F.broadcast(listed), F.col("c_key") == F.col("key"))
    else:  # a hot key's candidates are dealt over 16 copies of its rules
        dealt = maybe.withColumn("salt", F.pmod(F.xxhash64("u_host", "u_path"), F.lit(16)))
        copies = listed.withColumn("r_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        exact = dealt.join(copies, (F.col("c_key") == F.col("key")) & (F.col("salt") == F.col("r_salt")))
    fits = exact.filter(F.expr("startswith(u_path, r_path)"))
    text = F.concat("r_host", "r_path")
    best = fits.groupBy("u_host", "u_path").agg(F.max(F.struct(F.char_length(text).alias("length"), F.char_length("r_host").alias("in_host"), text.alias("text"), F.col("r_said").alias("said"))).alias("best"))
    of_host, of_path, found = (free_name(seen, x) for x in ("found_host", "found_path", "found_rule"))
    best = best.select(F.col("u_host").alias(of_host), F.col("u_path").alias(of_path), F.col("best").alias(found))
    out = seen.join(best, (F.col(host) == F.col(of_host)) & (F.col(path) == F.col(of_path)), "left")
    return out.withColumns({rule: F.col(found)["text"], said: F.coalesce(F.col(found)["said"], F.lit(default))}).drop(of_host, of_path, found)
