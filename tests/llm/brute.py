"""Plain versions of the operators, for small inputs."""

import re
import zlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, percent=75):
    """{row number: (set size, least id reached)} of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (ident, _) in enumerate(rows):
        known = [x for x in groups[find(i)] if x is not None]
        out.append((ident, len(sets[i]), min(known) if known and sets[i] else ident))
    return sorted(out, key=repr)


def contamination(text, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = words(text, pattern)
    hit, ids = set(), set()
    for ident, item in items:
        x = words(item, pattern)
        k = min(window, len(x))
        for o in range(len(x) - k + 1 if x else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == x[o : o + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(ident))
    return len(w), len(hit), sorted(ids)


def lines(text, long=24):
    """[(line's number, piece, whether it is a whole line)] of the lines with a word, long ones wrapped behind sentence ends."""
    out = []
    for n, line in enumerate((text or "").split("\n")):
        if not words(line):
            continue
        pieces = re.findall(r"(?s).+?[.!?][\x20\x09-\x0D]+|.+", line) if len(words(line)) > long else [line]
        pieces = [p for p in pieces if words(p)]
        out += [(n, p, len(pieces) == 1) for p in pieces]
    return out


def line_dedup(rows, least=13):
    """{(id, text): cleaned} by first occurrences in order of id."""
    seen, out = {}, {}
    for ident, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        parts, gone = lines(text), set()
        for p in range(len(parts) - 2):
            three = parts[p : p + 3]
            key = tuple(tuple(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x, _ in three)
            if (sum(map(len, key)) >= least or any(w for _, _, w in three)) and seen.setdefault(key, (ident, text, p)) != (ident, text, p):
                gone |= {p, p + 1, p + 2}
        left = {}
        for i, (n, x, _) in enumerate(parts):
            if i not in gone:
                left[n] = left.get(n, "") + x
        out[ident, text] = "\n".join(left.values()) if gone else text
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
