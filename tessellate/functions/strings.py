"""Text functions: canonical forms, codes, scanners, shapes, labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic-Indic and Persian digits, in order.
ARABIC_DIGITS, PERSIAN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
#: Latin letters with marks, and what they are without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Pairs of characters that are easily taken for each other.
CONFUSABLE = ("01", "17", "38", "56", "69", "49", "0O", "1I", "5S", "8B", "2Z", "-/")
#: Identity card, phone and address patterns, and fields that name places.
CARD_ID = r"\b[A-Z]{1,2}\s?\d{5,7}\b"
PHONE = r"(?:\+212|0)\s?[5-7](?:[\s.-]?\d{2}){4}\b"
ADDRESS = r"(?i)\b(rue|avenue|av\.|bd|boulevard|hay|douar|quartier|lot)\b"
PLACE_FIELDS = ("etablissement", "region", "province", "lieu")
IDENTIFIER_FIELDS = ("parturiente", "patiente", "cin", "adresse", "telephone", "nom_du_mari")


def strip_accents(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_replace(text, "œ", "oe"), "Œ", "Oe"), MARKED, PLAIN)


def norm_text(text: Column) -> Column:
    return F.upper(strip_accents(text))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS + PERSIAN_DIGITS, "0123456789" * 2)


def norm_code(code: Column) -> Column:
    return F.btrim(F.regexp_replace(ascii_digits(F.upper(F.coalesce(code, F.lit("")))), r"[\s./_]", "-"), F.lit("-"))


#: Units as they are written, and their one form; answers, and theirs.
UNITS = {"kg": "kg", "kgs": "kg", "g": "g", "gr": "g", "cm": "cm", "mm": "mm", "semaine": "sa", "semaines": "sa", "sa": "sa", "mois": "mois", "ans": "ans", "an": "ans", "%": "%", "bpm": "bpm"}
ANSWERS = {"oui": "oui", "o": "oui", "yes": "oui", "non": "non", "n": "non", "no": "non"}


def canonical(value: Column) -> Column:
    """One form for one fact. A value is taken apart into its runs of digits and what stands between them; what that skeleton looks like says what it is:
    a date (three runs between single signs; years of two digits are of this century), a pressure (two runs over a slash), a number (with a decimal sign, perhaps, and a
    unit, which has one form), else text in plain lower case, in which answers have one form. A dash or nothing is null."""
    v = F.btrim(F.regexp_replace(F.translate(ascii_digits(value), "،٫", ",."), r"\s+", " "))
    tight = F.regexp_replace(v, r" ?([/.,-]) ?", "$1")
    runs, skeleton = F.regexp_extract_all(tight, F.lit("[0-9]+"), 0), F.regexp_replace(tight, "[0-9]+", "9")
    run, width = lambda i: F.get(runs, F.lit(i)), lambda i: F.char_length(F.get(runs, F.lit(i)))
    two = lambda x: F.lpad(x, 2, "0")
    is_date = skeleton.isin("9/9/9", "9-9-9", "9.9.9") & (width(0) <= 2) & (width(1) <= 2) & width(2).isin(2, 4)
    date = F.concat_ws("/", two(run(0)), two(run(1)), F.when(width(2) == 2, F.concat(F.lit("20"), run(2))).otherwise(run(2)))
    is_pressure = (skeleton == "9/9") & width(0).between(2, 3) & width(1).between(2, 3)
    unit = F.btrim(F.regexp_replace(F.lower(v), "^[0-9]+( ?[.,] ?[0-9]+)?", ""))
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit), unit)
    digits = F.when(skeleton.rlike("^9[.,]9"), F.concat_ws(".", run(0), run(1))).otherwise(run(0))
    text = F.translate(strip_accents(F.lower(v)), "’", "'")
    answer = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ANSWERS.items() for x in pair]), text), text)
    is_number = skeleton.rlike("^9([.,]9)?( ?[^0-9 ][^0-9]*)?$") & ~skeleton.rlike("^9[/-]")
    said = F.when(is_date, date).when(is_pressure, F.concat_ws("/", run(0), run(1))).when(is_number, F.btrim(F.concat_ws(" ", digits, known))).otherwise(answer)
    return F.when(v.isNull() | v.isin("", "-", "–", "—"), None).otherwise(said)


#: Keywords of element types, the first that a title holds counts; series of sheet numbers.
TYPE_KEYWORDS = (("mur de refend", "CONCENTRATION CISAILLEMENT REFEND MUR"), ("fondation", "SEMELLE RADIER FONDATION PIEU"), ("colonne", "COLONNE"), ("poutre", "POUTRE"), ("dalle", "DALLE"))
SHEET_SERIES = {"1": "fondation", "3": "poutre", "4": "mur de refend", "5": "colonne", "6": "dalle"}


def type_of_title(title: Column) -> Column:
    plain, out = norm_text(title), F.lit(None).cast("string")
    for kind, words in reversed(TYPE_KEYWORDS):
        out = F.when(plain.rlike("|".join(words.split())), kind).otherwise(out)
    return out


def type_of_sheet(sheet: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SHEET_SERIES.items() for x in pair]), F.regexp_extract(sheet, "^[A-Z]-(\\d)\\d\\d", 1))


def sheet_ids(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit("(?<![A-Z0-9])S-\\d{3}[A-Z]?(?![A-Z0-9])"), 0)


def grid_refs(text: Column) -> Column:
    """`B-12`, `B/3` and `C.1-12`, as `B-12`; concrete classes behind a strength are none."""
    found = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9./-])(?<!MPa ?/ ?)([A-Z](?:\\.\\d)?[-/]\\d{1,2})(?![A-Za-z0-9/.-])"), 1)
    return F.transform(found, lambda x: F.translate(x, "/", "-"))


def element_labels(text: Column, letters: str) -> Column:
    """Labels of the given initial letters without their dash: `C-12` and `C13A`; concrete classes behind a strength are none."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9./-])(?<!MPa ?/ ?)([{letters}]-?\\d{{1,3}}[A-Z]?)(?![A-Za-z0-9/-])"), 1), lambda x: F.translate(x, "-", ""))


def scan(text: Column, key: Column) -> Column:
    """What kinds of personal identifiers a value looks like; the names of facilities are no addresses."""
    place = F.lit(False)
    for p in PLACE_FIELDS:
        place = place | key.contains(p)
    return F.array_compact(F.array(F.when(F.upper(text).rlike(CARD_ID), "CIN"), F.when(text.rlike(PHONE), "PHONE"), F.when(text.rlike(ADDRESS) & ~place, "ADDRESS")))


def is_identifier_field(key: Column) -> Column:
    out = F.lit(False)
    for p in IDENTIFIER_FIELDS:
        out = out | key.contains(p)
    return out


def shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "A")


def label_value(label: Column) -> Column:
    """A grid label as a number: A is 1, Z 26, AA 27; digits are themselves; `B.1` is 2.1."""
    head, tail = F.substring_index(label, ".", 1), F.when(label.contains("."), F.substring_index(label, ".", -1))
    letters = F.aggregate(F.split(head, ""), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))
    whole = F.when(head.rlike(r"^\d+$"), F.try_to_number(head, F.lit("99999999")).cast("double")).when(head.rlike("^[A-Z]+$"), letters)
    return whole + F.coalesce(F.when(tail.rlike(r"^\d$"), tail.cast("double")), F.lit(0.0)) / 10


def bay_key(text: Column) -> Column:
    """The bay of either notation: `B-C/12` and `B.1-12` are both (B, 12)."""
    a = F.regexp_extract(text, r"^([A-Z]+)-[A-Z]+/(\d+)$", 1)
    b = F.regexp_extract(text, r"^([A-Z]+)(?:\.\d+)?-(\d+)$", 1)
    row = F.when(a != "", F.regexp_extract(text, r"^([A-Z]+)-[A-Z]+/(\d+)$", 2)).otherwise(F.regexp_extract(text, r"^([A-Z]+)(?:\.\d+)?-(\d+)$", 2))
    return F.when((a != "") | (b != ""), F.struct(F.when(a != "", a).otherwise(b).alias("axis"), row.cast("int").alias("row")))


def french_number(x: Column, digits: int = 2) -> Column:
    """Thin spaces between thousands, a decimal comma, a true minus sign."""
    return F.translate(F.format_number(x, digits), ",.-", " ,−")


_CHEAP = {*CONFUSABLE, *(p[::-1] for p in CONFUSABLE)}


def code_distance_of(a: str, b: str) -> float:
    """Edit distance; exchanging two characters that are easily confused costs 0.4."""
    row = list(map(float, range(len(b) + 1)))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            swap = last + (0.0 if x == y else 0.4 if x + y in _CHEAP else 1.0)
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, swap)
    return row[-1]


def code_distance(a: Column, b: Column) -> Column:
    """The distance of two codes in their normal form; in Arrow batches, as no expression holds a table of costs."""

    def distances(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([code_distance_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(distances, "double")(norm_code(a), norm_code(b))
