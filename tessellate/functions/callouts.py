"""The grammar of reinforcement callouts: one line of text, many bars.

A line is cut into tokens (numbers, sizes, marks, signs, units, words). Every size opens a callout; the tokens before it are read backwards for its quantity, those behind
it, up to where the next callout begins, forwards for spacing, length, mark and role."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bar sizes, keywords of roles (the first in the text wins, with or without a plural s), and what a one-letter tag stands for.
SIZES = "10|15|20|25|30|35|45|55"
ROLES = {
    "ligature": "LIG LIGATURE ETRIER CADRE EPINGLE TIE STIRRUP SPIRALE",
    "goujon": "GOUJON DOWEL ATTENTE",
    "sup": "SUP SUPERIEUR SUPERIEURE HAUT TOP",
    "inf": "INF INFERIEUR INFERIEURE BAS BOT BOTTOM",
    "vert": "VERT VERTICAL VERTICALE VERTICAUX",
    "hor": "HOR HORIZ HORIZONTAL HORIZONTALE HORIZONTAUX",
}
TAGS = {"T": "sup", "B": "inf", "V": "vert", "H": "hor"}
MM_PER_INCH = 25.4
#: What is plausible, in mm (spacings in inches: in inches).
SPACING_MM, SPACING_INCHES, LENGTH_MM = range(40, 1501), (2, 60), range(200, 20001)
#: Words before a number that say what it counts, so that it is no quantity; words that stand for the sign of spacing.
NUMBERED = {"NIV", "NIVEAU", "LEVEL", "TYPE", "DETAIL", "AXE", "NO", "LG", "L"}
AT_WORDS = {"A", "AT", "AUX"}

_ROLE_OF = {w + s: role for role, words in ROLES.items() for w in words.split() for s in ("", "S")}
_TOKENS = re.compile(
    rf"""
      (?P<size>(?<![\w.,/])(?:{SIZES})\s?M(?:(?P<glued>\d{{3,5}}))?(?![A-Za-z0-9]))
    | (?P<feet>(?<![\w.,/-])\d{{1,2}}-\d{{1,2}}(?![\w.,/"'-]))
    | (?P<centres>\(?\b(?:[cC]\s?/\s?[cC]|[oO]\.?[cC]\b\.?)\)?)
    | (?P<fraction>(?<![\w.,/])\d+/\d+(?![\w.,/]))
    | (?P<number>(?:(?<![\w.,/])|(?<=\d[xX×]))\d+(?![\w.,/]|\.\d)(?!\s?[MN]Pa)|(?<![\w.,/])\d+(?=[xX×]\s?\d|mm\b|M\b))
    | (?P<mark>(?<![\w.,/])(?=[A-Z0-9-]*\d)(?=\d*[A-Z])[A-Z0-9]+(?:-\d+[A-Z]?)?(?!\w))
    | (?P<inch>"|''|”|″)
    | (?P<mm>mm\b)
    | (?P<at>@)
    | (?P<times>[xX×](?=\s?\d))
    | (?P<dash>[-–—])
    | (?P<open>\() | (?P<close>\))
    | (?P<colon>:)
    | (?P<word>[^\W\d_]+)
    | (?P<other>\S)
    """,
    re.VERBOSE,
)
FIELDS = "size string, quantity int, sub int, spacing int, length int, mark string, role string, conf double"
_PLAIN = str.maketrans("ÀÂÉÈÊËÎÏÔÙÛÇ", "AAEEEEIIOUUC")


class Token(NamedTuple):
    kind: str
    text: str

    @property
    def number(self) -> int:
        return int(self.text)


def tokens_of(line: str) -> list[Token]:
    """A glued length is a token of its own, behind its size."""
    out = []
    for m in _TOKENS.finditer(line):
        kind = "size" if m["size"] else m.lastgroup
        text = m[0].upper().translate(_PLAIN) if kind == "word" else m[0]
        if kind == "word" and text in AT_WORDS:
            kind = "at_word"
        out.append(Token(kind, text[:2] + "M" if kind == "size" else text))
        if m["size"] and m["glued"]:
            out.append(Token("glued", m["glued"]))
    return out


class Count(NamedTuple):
    """What stands before a size: where it begins, the quantity, the part of it in brackets, whether a dash joins it, whether a number was refused."""

    begin: int
    quantity: int | None = None
    sub: int | None = None
    dashed: bool = False
    refused: bool = False


def count_before(tokens: list[Token], size: int) -> Count:
    """Read backwards: an optional dash; a number, brackets around a number, a number and brackets, or a product of two numbers."""
    kinds = [t.kind for t in tokens]
    end = size - (size > 0 and kinds[size - 1] == "dash")
    dashed, small = end < size, lambda i: 0 <= i and kinds[i] == "number" and 0 < tokens[i].number <= 999
    if end >= 3 and kinds[end - 3 : end] == ["open", "number", "close"]:
        if small(end - 4):
            return Count(end - 4, tokens[end - 4].number, tokens[end - 2].number, dashed)
        return Count(end - 3, tokens[end - 2].number, None, dashed)
    if not small(end - 1):
        return Count(size)
    if end >= 3 and kinds[end - 2] == "times" and small(end - 3):
        return Count(end - 3, tokens[end - 3].number * tokens[end - 1].number, None, dashed)
    before = tokens[end - 2] if end >= 2 else Token("none", "")
    if not dashed and (before.kind in ("at", "at_word", "times") or before.text in NUMBERED):
        return Count(size, refused=True)
    return Count(end - 1, tokens[end - 1].number, None, dashed)


def spacing_in(tail: list[Token]) -> tuple[int | None, set[int]]:
    """A number behind a sign of spacing, in inches or mm, or one before `c/c`; and the tokens that it takes."""
    kind = lambda i: tail[i].kind if 0 <= i < len(tail) else ""
    for i, t in enumerate(tail):
        if t.kind != "number" or len(t.text) > 4:
            continue
        end, part = i + 1, 0.0
        if kind(end) == "fraction":
            top, bottom = map(int, tail[end].text.split("/"))
            end, part = (end + 1, top / bottom) if bottom else (end, 0.0)
        signed = kind(i - 1) in ("at", "at_word")
        if kind(end) == "inch":
            inches = t.number + part
            if signed and SPACING_INCHES[0] <= inches <= SPACING_INCHES[1]:
                return round(inches * MM_PER_INCH), set(range(i - 1, end + 1))
            continue
        unit = i + 2 if kind(i + 1) == "mm" else i + 1
        if (signed or kind(unit) == "centres") and len(t.text) >= 2 and t.number in SPACING_MM:
            return t.number, set(range(i - signed, unit + (kind(unit) == "centres")))
    return None, set()


def length_in(tail: list[Token], used: set[int]) -> tuple[int | None, set[int]]:
    """Glued to the size, behind x, LG or L, or right behind the size: feet-inches, or four and more digits."""
    for i, t in enumerate(tail):
        before = tail[i - 1] if i else Token("start", "")
        named = before.kind == "times" or before.text in ("LG", "L") or (before.text in ("=", ".") and i > 1 and tail[i - 2].text in ("LG", "L"))
        if i in used:
            continue
        if t.kind == "feet" and (before.kind == "start" or named):
            feet, inches = map(int, t.text.split("-"))
            if inches < 12:
                return round((12 * feet + inches) * MM_PER_INCH), {i}
        if t.kind == "glued" or (t.kind == "number" and ((named and len(t.text) >= 3) or (before.kind == "start" and len(t.text) >= 4))):
            if int(t.text) in LENGTH_MM:
                return int(t.text), {i}
    return None, set()


def role_in(tokens: list[Token]) -> str | None:
    return next((_ROLE_OF[t.text] for t in tokens if t.text in _ROLE_OF), None)


def callouts_of(line: str) -> Iterator[dict]:
    tokens = tokens_of(line)
    sizes = [i for i, t in enumerate(tokens) if t.kind == "size"]
    counts = [count_before(tokens, i) for i in sizes]
    last = 0
    for k, (at, count) in enumerate(zip(sizes, counts, strict=True)):
        head, stop = tokens[last : count.begin], counts[k + 1].begin if k + 1 < len(sizes) else len(tokens)
        tail = last_tail = tokens[at + 1 : stop]
        spacing, used = spacing_in(tail)
        length, taken = length_in(tail, used)
        used = used | taken
        mark = next((t.text for i, t in enumerate(tail) if t.kind == "mark" and i not in used), None)
        if mark is None and count.quantity and not count.dashed and tail and tail[0].kind == "number" and 0 not in used and len(tail[0].text) <= 3:
            mark = tail[0].text  # a mark of digits alone
        tag = TAGS.get(head[-2].text) if len(head) > 1 and head[-1].kind == "colon" else None
        informative = count.quantity is not None or spacing is not None or length is not None
        conf = (0.95 if informative else 0.5) * (0.9 if count.refused else 1.0)
        yield {"size": tokens[at].text, "quantity": count.quantity, "sub": count.sub, "spacing": spacing, "length": length, "mark": mark, "role": role_in(last_tail) or role_in(head) or tag, "conf": round(conf, 3)}
        last = stop


def bars_of(line: str | None) -> list[dict]:
    """Every callout of a line, in order."""
    return list(callouts_of(line or ""))


def find_bars(lines: DataFrame, text_col: str) -> DataFrame:
    """One row for each callout: the line's columns, its place (from 0), and the bar's fields."""

    @F.pandas_udf(f"array<struct<{FIELDS.replace(' ', ':')}>>".replace(",:", ", "))
    def bars(text: pd.Series) -> pd.Series:
        return text.map(bars_of)

    return lines.select("*", F.posexplode(bars(F.col(text_col))).alias("place", "bar"))


#: Characters that recognition takes for digits, and the digits; for the sign of spacing; for a dash.
DIGIT_LIKE, DIGITS = "OoIl|SsZB", "001115528"
AT_LIKE, DASH_LIKE = "eEaQ&©＠@", "~_=–—"


def repaired(text: Column) -> Column:
    """Recognition's confusions in callouts put right: two characters before an M that give a size when digit-like ones are read as digits become that size, with the
    dash before and the sign of spacing behind it. Whatever gives no size stays as it is."""
    dash, pair, at = rf"(?:(?<=\d)\s?[{DASH_LIKE}]\s?|(?<![A-Za-z0-9.,/]))", rf"[0-9{DIGIT_LIKE}]{{2}}", rf"(?:\s?[{AT_LIKE}]\s?(?=\d{{1,4}}(?!\d))|(?![A-Za-z0-9]))"
    like = rf"{dash}{pair}\s?M{at}"

    def put_right(found: Column) -> Column:
        size = F.translate(F.regexp_extract(found, rf"({pair})\s?M", 1), DIGIT_LIKE, DIGITS)
        before = F.when(found.rlike(f"^\\s?[{DASH_LIKE}]"), "-").otherwise("")
        behind = F.when(F.regexp_extract(found, "M(.*)$", 1) != "", " @ ").otherwise("")
        return F.when(size.rlike(f"^(?:{SIZES})$"), F.concat(before, size, F.lit("M"), behind)).otherwise(found)

    kept, found = F.split(text, like), F.transform(F.regexp_extract_all(text, F.lit(like), 0), put_right)
    return F.array_join(F.zip_with(kept, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def describe(bar: Column) -> Column:
    """The compact notation, e.g. `8-25M@300 L=2400`."""
    n = F.when(bar["quantity"].isNotNull(), F.concat(bar["quantity"].cast("string"), F.lit("-"))).otherwise(F.lit(""))
    s = F.when(bar["spacing"].isNotNull(), F.concat(F.lit("@"), bar["spacing"].cast("string"))).otherwise(F.lit(""))
    length = F.when(bar["length"].isNotNull(), F.concat(F.lit(" L="), bar["length"].cast("string"))).otherwise(F.lit(""))
    return F.concat(n, bar["size"], s, length)


def levels(text: Column) -> Column:
    """Storey names of a title, canonical: a range gives both ends."""
    t = F.translate(F.upper(F.translate(text, "éèêÉÈÊ", "eeeEEE")), "_", " ")
    bound = r"(?<![A-Z0-9])NIV(?:EAU)?[ .-]*(\d{1,2})\s*@\s*(\d{1,2})(?![A-Z0-9])"
    pair = F.array(F.regexp_extract(t, bound, 1), F.regexp_extract(t, bound, 2))
    token = r"(?<![A-Z0-9])(NIV(?:EAU)?[ .-]*\d{1,2}|SS[ -]?\d?|RDC|TOIT|TREFOND|FDN|FONDATIONS?|MEZZ)(?![A-Z0-9])"
    name = lambda x: F.when(x.startswith("NIV"), F.regexp_extract(x, r"(\d+)", 1).cast("int").cast("string")).when(x.startswith("SS"), F.concat(F.lit("SS"), F.coalesce(F.nullif(F.regexp_extract(x, r"(\d)", 1), F.lit("")), F.lit("1")))).when(x.startswith("F"), F.lit("FDN")).otherwise(x)
    return F.when(t.rlike(bound), pair).otherwise(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(token), 1), name)))
