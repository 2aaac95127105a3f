"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions.

Every statistic of a text is a built-in expression over its words and lines, so that the whole rule set is one scan-side
projection: no shuffle, no user function, memory bounded by one text. Cases:

* null text: no words, no lines; it fails the base rules. Empty text: the same.
* very long texts: linear, except for one sort of the 3-word windows of the text.
* ties and repeated rows: each row is judged by itself. Empty table: no rows.
* extra columns and clashing names: `judged` adds one struct column under a name that the table does not use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, words_of

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in is that it for was on are as with by this be at from or an which have not "
    "le la les de des du et un une en que qui dans pour sur par au aux est "
    "el los las del y una con se no su lo como más al "
    "der die das und ist ein eine den dem von zu mit auf für nicht sich im"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Threshold:
    """A ratio must lie within [low, high]; None: unbounded."""

    ratio: str
    low: float | None
    high: float | None


THRESHOLDS = (
    Threshold("mean_word_length", 2.0, 15.0),
    Threshold("symbol_ratio", None, 0.25),
    Threshold("stop_word_ratio", 0.04, None),
    Threshold("dup_line_ratio", None, 0.5),
    Threshold("upper_word_ratio", None, 0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text; equal windows meet as neighbours after one sort by hash."""

    def covered(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["h"].eqNullSafe(F.get(s, k)["h"])
        twice = F.filter(s, lambda x, j: same(j, j - 1) | same(j, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered))


def statistics(text: Column) -> Column:
    """A struct of the counts that the rules are made of."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")

    def counts(words: Column, lines: Column) -> Column:
        plain = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: plain(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: (F.char_length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_upper_words"),
        )

    return let(words_of(text), lambda w: let(lines, lambda ls: counts(w, ls)))


def ratios(s: Column) -> dict[str, Column]:
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "mean_word_length": part(s["word_chars"], s["n_words"]),
        "symbol_ratio": part(s["n_symbols"], s["n_words"]),
        "stop_word_ratio": part(s["n_stop_words"], s["n_words"]),
        "dup_line_ratio": part(s["n_dup_lines"], s["n_lines"]),
        "upper_word_ratio": part(s["n_upper_words"], s["n_words"]),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def verdict(s: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """True if the base rules and every threshold hold."""
    ok, values = ~base_failed(s), ratios(s)
    for t in thresholds:
        if t.low is not None:
            ok = ok & (values[t.ratio] >= t.low)
        if t.high is not None:
            ok = ok & (values[t.ratio] <= t.high)
    return ok


def judgement(text: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """A struct of the counts, base_failed and kept: one expression that counts once, wherever it stands and whatever of it is used."""
    fields = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper_words")
    return let(statistics(text), lambda s: F.struct(*[s[f].alias(f) for f in fields], base_failed(s).alias("base_failed"), verdict(s, thresholds).alias("kept")))


def judged(docs: DataFrame, text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> tuple[DataFrame, str]:
    """docs with one struct column more (its name comes second): the counts, base_failed and kept."""
    name = free_name(docs, "rules")
    return docs.withColumn(name, judgement(F.col(f"`{text_col}`"), thresholds)), name


def keep_good(docs: DataFrame, text_col: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs, with its columns, that pass."""
    return docs.filter(judgement(F.col(f"`{text_col}`"), thresholds)["kept"])
