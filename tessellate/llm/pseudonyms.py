"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network.

Found are e-mail addresses, ISO and day-month-year dates, IPv4 addresses, phone numbers, social security numbers and card numbers
(13 to 19 digits, in one piece, in groups of four or as 4-6-5 and 4-6-4). Phone numbers have 8 to 15 digits: after a country code (+ or 00, then
groups of any size), with an area code in brackets, as 3-3-4, or national with groups (French 0x xx xx xx xx, also in one piece; German area code
and number; Spanish 9 digits). National numbers in one piece without a leading zero are not told from other numbers and stay, as do runs of 16 and
more digits. A value that passes its check (calendar, octets without leading zeros, areas and serials, Luhn sum) is replaced by another that
passes it, with the same layout of digits and separators; equal values get equal pseudonyms everywhere, and different ones of a layout differ. A phone number's
check is the count of its digits. Of an e-mail address the part before `@` changes. IBANs are not searched. The key
is a parameter; the same key gives the same permutation. All of it is built-in expressions: a text is split at its values, the
values are replaced, and the parts are joined again. Cases:

* null text: null, no values. Empty texts: as they are. Very long texts: whole, one pass of a pattern over them.
* texts without a digit or `@` are not searched. Numbers that fail their check stay as they are and are not counted.
* repeated rows and ties: each row by itself. Empty table: no rows. Extra columns: carried; the struct column added has a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
DAY_DATE = r"(?<![\d./])\d{2}[/.]\d{2}[/.]\d{4}(?![\d/])"
IPV4 = r"(?<![\d.])(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}(?!\.?\d)"
#: Known by their marks: area code in brackets, French and Spanish numbers after their country codes, any number after a country code.
MARKED = (
    r"(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}",
    r"(?:\+|00)33[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d{2}){4}",
    r"(?:\+|00)34[ .-]?\d{3}(?:(?:[ .-]?\d{3}){2}|(?:[ .-]?\d{2}){3})",
    r"\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}",
    r"(?:\+|00(?=[1-9]))\d(?:[ ./-]{0,2}\(?\d\)?){7,14}",
    r"\(0\d{1,4}\)[ ./-]?\d{2,8}(?:[ .-]\d{2,5}){0,4}",
)
#: Known by their groups: 3-3-4; French, German and Spanish national numbers.
GROUPED = (
    r"(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}",
    r"0\d(?:[ .-]?\d{2}){4}",
    r"0\d{2,4}(?:[ /-]| / )\d{3,8}(?:[ -]\d{2,4}){0,2}",
    r"[6-9]\d{2}(?:[ .-]\d{3}){2}",
    r"[6-9]\d{2}(?:[ .-]\d{2}){3}",
)
PHONE = r"(?<![\w+])(?=(?:[^\w\r\n]{0,3}\d){8})(?:(?:" + "|".join(MARKED) + r")(?!\d)|(?<!\d[.,/-])(?:" + "|".join(GROUPED) + r")(?!\d|[./-]\d))"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD_FORM = r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})"
CARD = r"(?<![\w-])" + CARD_FORM + r"(?!\w)"
ANY = "|".join((EMAIL, ISO_DATE, DAY_DATE, IPV4, SSN, CARD, PHONE))
ROUNDS = 10
#: Days from 1900-01-01 to 2299-12-31: 189 * 773. Of these, those whose day is at most 12 (day and month can change places): 400 years * 144; the others: 9 * 9833.
FIRST_DAY, DAYS = "1900-01-01", (189, 773)
FIRST_YEAR, EITHER, LATE = 1900, (400, 144), (9, 9833)
#: Areas of social security numbers: 001 to 665 and 667 to 899; groups 01 to 99 and serials 0001 to 9999 are one number.
AREAS, REST = 898, 99 * 9999


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: Column) -> Column:
    """A permutation of the pairs (a, b), a < size_a and b < size_b: each round adds a keyed hash of one half to the other."""

    def step(s: Column, i: Column) -> Column:
        of = lambda half: F.conv(F.substring(F.md5(F.concat_ws("~", F.lit(key), tag, i.cast("string"), half.cast("string"))), 1, 15), 16, 10).cast("long")
        even = i % 2 == 0
        turned = F.when(even, F.pmod(s["a"] + of(s["b"]), size_a)).otherwise(F.pmod(s["b"] + of(s["a"]), size_b))
        return let(turned, lambda t: F.struct(F.when(even, t).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(t).alias("b")))

    start = F.struct(F.coalesce(a.cast("long"), F.lit(0).cast("long")).alias("a"), F.coalesce(b.cast("long"), F.lit(0).cast("long")).alias("b"))
    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.array(start), lambda s, i: F.array(step(F.get(s, 0), i)), lambda s: F.get(s, 0))


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """A digit string of the same length: its halves through the network."""

    def halves(n: Column) -> Column:
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        m = F.floor(n / 2).cast("int")
        pair = feistel(F.substring(digits, F.lit(1), m), F.substring(digits, m + 1, n - m), ten(m), ten(n - m), key, F.concat(F.lit(tag), n.cast("string")))
        return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), m, F.lit("0")), F.lpad(p["b"].cast("string"), n - m, F.lit("0"))))

    return let(F.char_length(digits), halves)


def permuted_text(text: Column, key: str, tag: Column) -> Column:
    """Letters and digits of a text for others, in their places and cases: a Feistel network over positions, in which each round adds keyed hashes of one half to the
    other's letters (mod 26) and digits (mod 10). So for any length different texts of one layout have different results."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def changed(s: Column) -> Column:
        size = F.size(s)
        half = F.floor(size / 2).cast("int")

        def step(acc: Column, t: Column) -> Column:
            even = t % 2 == 0
            other = F.array_join(F.when(even, F.slice(acc, half + 1, size - half)).otherwise(F.slice(acc, F.lit(1), half)), ".")
            shifts = F.sha2(F.concat_ws("~", F.lit(key), F.lit("text"), tag, t.cast("string"), other), 512)
            draw = lambda h, i: F.conv(F.substring(h, ((i % 32) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
            base = lambda i: F.when(F.get(s, i)["digit"], 10).otherwise(26)
            return let(shifts, lambda h: F.transform(acc, lambda x, i: F.when((i < half) == even, F.pmod(x + draw(h, i) + F.floor(i / 32).cast("int"), base(i))).otherwise(x)))

        mixed = F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(s, lambda x: x["v"]), step)
        char = lambda x, v: F.when(x["digit"], v.cast("string")).when(x["upper"], F.upper(F.substring(F.lit(letters), v + 1, F.lit(1)))).otherwise(F.substring(F.lit(letters), v + 1, F.lit(1)))
        return F.zip_with(s, mixed, char)

    def symbol(c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(digit.alias("digit"), c.rlike("[A-Z]").alias("upper"), F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97).cast("int").alias("v"))

    def placed(new: Column) -> Column:
        """The new characters in the places of the old ones."""
        step = lambda acc, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct((acc["n"] + 1).alias("n"), F.concat(acc["out"], F.get(new, acc["n"])).alias("out"))).otherwise(F.struct(acc["n"].alias("n"), F.concat(acc["out"], c).alias("out")))
        return F.reduce(F.split(text, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step)["out"]

    symbols = F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("[A-Za-z0-9]")), symbol)
    return let(symbols, lambda s: F.when(F.size(s) == 0, text).otherwise(let(changed(s), placed)))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; a multiple of ten for a valid number."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.reduce(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda s, i: s + F.coalesce(value(i), F.lit(0)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def laid_out(value: Column, digits: Column) -> Column:
    """digits in the places where value has its own."""

    def char(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        return F.when(c.rlike(r"\d"), F.substring(digits, F.char_length(digits_of(F.substring(value, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(value)), char), "")


def _card(value: Column, key: str) -> Column:
    def changed(d: Column) -> Column:
        body = permuted_digits(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card")
        full = let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, laid_out(value, full))

    return let(digits_of(value), changed)


def _ip(value: Column, key: str) -> Column:
    def changed(p: Column) -> Column:
        part = lambda i: F.get(p, i).cast("int")
        two = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, F.lit("ip"))
        dotted = let(two, lambda t: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(t[h] / 256), F.pmod(t[h], F.lit(256)))]))
        return F.when(F.forall(p, lambda x: x.cast("int") < 256), dotted)

    return let(F.split(value, r"\."), changed)


def _ssn(value: Column, key: str) -> Column:
    """Area (not 000, 666 or from 900 on), and group and serial (neither 0) as one number."""

    def changed(p: Column) -> Column:
        area, group, serial = (F.get(p, i).cast("int") for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        pair = feistel(F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(AREAS), F.lit(REST), key, F.lit("ssn"))
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        text = let(pair, lambda t: F.concat_ws("-", pad(F.when(t["a"] < 665, t["a"] + 1).otherwise(t["a"] + 2), 3), pad(F.floor(t["b"] / 9999) + 1, 2), pad(t["b"] % 9999 + 1, 4)))
        return F.when(valid, text)

    return let(F.split(value, "-"), changed)


def _days_before(month: Column) -> Column:
    """Of the days from FIRST_DAY on that are later than a month's 12th, those before the month-th month (from 0)."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.datediff(F.add_months(first, month), first) - 12 * month


def _late_day(n: Column) -> Column:
    """The n-th of those days."""
    guess = F.floor(n * 4800 / (LATE[0] * LATE[1])).cast("int")
    month = F.array_max(F.filter(F.transform(F.sequence(guess - 2, guess + 2), lambda m: F.greatest(m, F.lit(0))), lambda m: _days_before(m) <= n))
    return let(month, lambda m: F.date_add(F.add_months(F.lit(FIRST_DAY).cast("date"), m), (n - _days_before(m) + 12).cast("int")))


def _date(value: Column, key: str) -> Column:
    """A date of the same layout. Where day and month could change places the pseudonym is such a date too, else it is none: two layouts never meet."""
    start = F.lit(FIRST_DAY).cast("date")
    among = lambda n, size, tag: feistel(F.floor(n / size[1]), F.pmod(n, F.lit(size[1])), F.lit(size[0]), F.lit(size[1]), key, F.lit(tag))
    within = lambda day: (day >= start) & (F.year(day) < FIRST_YEAR + EITHER[0])
    iso = F.try_to_date(value, "yyyy-MM-dd")
    moved = lambda day: let(among(F.datediff(day, start), DAYS, "date"), lambda p: F.date_format(F.date_add(start, (p["a"] * DAYS[1] + p["b"]).cast("int")), "yyyy-MM-dd"))
    x, sep, y, year = F.substring(value, 1, 2).try_cast("int"), F.substring(value, 3, 1), F.substring(value, 4, 2).try_cast("int"), F.substring(value, 7, 4).try_cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    written = lambda a, b, y: F.concat(two(a), sep, two(b), F.substring(value, 6, 1), F.lpad(y.cast("string"), 4, "0"))
    either = let(feistel(year - FIRST_YEAR, (x - 1) * 12 + y - 1, F.lit(EITHER[0]), F.lit(EITHER[1]), key, F.lit("either")), lambda p: written(F.floor(p["b"] / 12) + 1, p["b"] % 12 + 1, p["a"] + FIRST_YEAR))
    months = lambda d: (F.year(d) - FIRST_YEAR) * 12 + F.month(d) - 1
    late = lambda d: let(among(_days_before(months(d)) + F.dayofmonth(d) - 13, LATE, "late"), lambda p: let(p["a"] * LATE[1] + p["b"], _late_day))
    plain = F.concat(two(x), F.lit("/"), two(y), F.lit("/"), F.lpad(year.cast("string"), 4, "0"))
    day_first, month_first = F.try_to_date(plain, "dd/MM/yyyy"), F.try_to_date(plain, "MM/dd/yyyy")
    dated = lambda d, turned: F.when(within(d), let(late(d), lambda m: written(F.month(m), F.dayofmonth(m), F.year(m)) if turned else written(F.dayofmonth(m), F.month(m), F.year(m))))
    slashed = F.when(x.between(1, 12) & y.between(1, 12), F.when(year.between(FIRST_YEAR, FIRST_YEAR + EITHER[0] - 1), either)).when(day_first.isNotNull(), dated(day_first, False)).otherwise(dated(month_first, True))
    return F.when(value.rlike(r"^\d{4}-"), F.when(within(iso), moved(iso))).otherwise(slashed)


def _email(value: Column, key: str) -> Column:
    """The part before `@`; the domain, in lower case, is part of the key."""
    return F.concat(permuted_text(F.substring_index(value, "@", 1), key, F.lower(F.substring_index(value, "@", -1))), F.lit("@"), F.substring_index(value, "@", -1))


def kind_of(value: Column) -> Column:
    return F.when(value.contains("@"), "email").when(value.rlike(f"^(?:{ISO_DATE})$"), "date").when(value.rlike(f"^(?:{DAY_DATE})$"), "date").when(value.rlike(f"^(?:{IPV4})$"), "ip").when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(f"^{CARD_FORM}$") & ~(value.rlike("^00[1-9]") & (F.char_length(digits_of(value)) < 16) & (F.pmod(luhn_sum(digits_of(value)), F.lit(10)) != 0)), "card").otherwise("phone")


def pseudonym(value: Column, key: str) -> Column:
    """Another value of the format, or null if the value is not a valid one."""
    number = lambda tag: let(permuted_digits(digits_of(value), key, tag), lambda d: laid_out(value, d))
    phone = F.when(F.char_length(digits_of(value)).between(8, 17), number("phone"))
    kind = kind_of(value)
    return F.when(kind == "email", _email(value, key)).when(kind == "date", _date(value, key)).when(kind == "ip", _ip(value, key)).when(kind == "phone", phone).when(kind == "ssn", _ssn(value, key)).otherwise(_card(value, key))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one struct column more (its name comes second): text, and values: an array of (kind, value, pseudonym)."""
    name, parts, found = free_name(docs, "private"), free_name(docs, "private_parts"), free_name(docs, "private_found")
    text = F.col(f"`{text_col}`").cast("string")
    some = text.rlike("[0-9@]")
    cut = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), 0)))
    cut = cut.withColumn(parts, F.when(F.size(found) > 0, F.split(text, ANY)))
    value = lambda v: let(pseudonym(v, key), lambda p: F.struct(F.when(p.isNotNull(), kind_of(v)).alias("kind"), v.alias("value"), F.coalesce(p, v).alias("pseudonym")))
    cut = cut.withColumn(found, F.when(F.size(found) > 0, F.transform(found, value)))
    joined = F.array_join(F.zip_with(parts, F.transform(found, lambda x: x["pseudonym"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = cut.withColumn(name, F.struct(F.when(F.col(found).isNull(), text).otherwise(joined).alias("text"), F.filter(F.coalesce(found, F.array()), lambda x: x["kind"].isNotNull()).alias("values")))
    return out.drop(parts, found), name
