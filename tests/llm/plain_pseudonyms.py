"""Pseudonyms value by value, in plain Python, and their inverses where they are permutations of numbers."""

import datetime
import hashlib

import regex

from tessellate.llm import pseudonyms as P

START = datetime.date(1900, 1, 1)


def feistel(a, b, size_a, size_b, key, tag, back=False):
    f = lambda i, half: int(hashlib.md5(f"{key}~{tag}~{i}~{half}".encode()).hexdigest()[:15], 16)
    for i in reversed(range(P.ROUNDS)) if back else range(P.ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            a = (a + sign * f(i, b)) % size_a
        else:
            b = (b + sign * f(i, a)) % size_b
    return a, b


def digits(d, key, tag, back=False):
    m = len(d) // 2
    a, b = feistel(int(d[:m] or 0), int(d[m:]), 10**m, 10 ** (len(d) - m), key, f"{tag}{len(d)}", back)
    return (str(a).zfill(m) if m else "") + str(b).zfill(len(d) - m)


def text(value, key, tag):
    places = [i for i, c in enumerate(value) if c.isascii() and c.isalnum()]
    v = [int(value[i]) if value[i].isdigit() else ord(value[i].lower()) - 97 for i in places]
    base, half = [10 if value[i].isdigit() else 26 for i in places], len(places) // 2
    for t in range(P.ROUNDS):
        other = v[half:] if t % 2 == 0 else v[:half]
        h = hashlib.sha512("~".join([key, "text", tag, str(t), ".".join(map(str, other))]).encode()).hexdigest()
        v = [(x + int(h[i % 32 * 4 : i % 32 * 4 + 4], 16) + i // 32) % base[i] if (i < half) == (t % 2 == 0) else x for i, x in enumerate(v)]
    out = list(value)
    for i, x in zip(places, v, strict=True):
        c = str(x) if value[i].isdigit() else chr(97 + x)
        out[i] = c.upper() if value[i].isupper() else c
    return "".join(out)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def laid_out(value, new):
    left = iter(new)
    return "".join(next(left) if c.isdigit() else c for c in value)


def day_of(year, month, day):
    try:
        return datetime.date(year, month, day)
    except ValueError:
        return None


LATE = [d for d in (START + datetime.timedelta(n) for n in range(146097)) if d.day > 12]
LATE_AT = {d: i for i, d in enumerate(LATE)}


def date(value, key):
    if value[4:5] == "-":
        d = day_of(*map(int, value.split("-")))
        if not d or not 0 <= (d - START).days < 146097:
            return None
        a, b = feistel(*divmod((d - START).days, 773), 189, 773, key, "date")
        return str(START + datetime.timedelta(a * 773 + b))
    x, y, year = int(value[:2]), int(value[3:5]), int(value[6:])
    written = lambda x, y, year: f"{x:02d}{value[2]}{y:02d}{value[5]}{year:04d}"
    if 1 <= x <= 12 and 1 <= y <= 12:
        if not 1900 <= year < 2300:
            return None
        a, b = feistel(year - 1900, (x - 1) * 12 + y - 1, 400, 144, key, "either")
        return written(b // 12 + 1, b % 12 + 1, a + 1900)
    d, turned = day_of(year, y, x) if y <= 12 and year else None, False
    if not d:
        d, turned = day_of(year, x, y) if x <= 12 and year else None, True
    if d not in LATE_AT:
        return None
    a, b = feistel(*divmod(LATE_AT[d], 9833), 9, 9833, key, "late")
    m = LATE[a * 9833 + b]
    return written(m.month, m.day, m.year) if turned else written(m.day, m.month, m.year)


def pseudonym(value, key):
    """(kind, pseudonym), or None for what fails its check."""
    d = "".join(c for c in value if c.isdigit())
    if "@" in value:
        name, domain = value.rsplit("@", 1)
        return "email", text(name, key, domain.lower()) + "@" + domain
    if regex.fullmatch(P.ISO_DATE, value) or regex.fullmatch(P.DAY_DATE, value):
        return (p := date(value, key)) and ("date", p)
    if regex.fullmatch(P.IPV4, value):
        p = list(map(int, value.split(".")))
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return ("ip", ".".join(map(str, (a // 256, a % 256, b // 256, b % 256)))) if max(p) < 256 else None
    if regex.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        area, group, serial = map(int, value.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        a, b = feistel(area - 1 if area < 666 else area - 2, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return "ssn", f"{a + 1 if a < 665 else a + 2:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if regex.fullmatch(P.CARD_FORM, value) and not (regex.match("00[1-9]", value) and len(d) < 16 and luhn(d)):
        if luhn(d):
            return None
        body = digits(d[:-1], key, "card")
        return "card", laid_out(value, body + str(-luhn(body + "0") % 10))
    return ("phone", laid_out(value, digits(d, key, "phone"))) if 8 <= len(d) <= 17 else None


def pseudonymised(value, key):
    """The text, and {kind: how many}."""
    counts = {}

    def put(m):
        found = pseudonym(m[0], key)
        if not found:
            return m[0]
        counts[found[0]] = counts.get(found[0], 0) + 1
        return found[1]

    return (regex.sub(P.ANY, put, value, flags=regex.ASCII) if value else value), counts
