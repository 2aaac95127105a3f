"""N-gram Jaccard join by PartEnum signatures, and its connected components.

The sets are the distinct word shingles of whole texts (as 64-bit hashes). Equal sets are one class. The feature domain is divided into first-level
partitions, as many as a band of sizes asks for, and each of these into n second-level parts. All subsets of n - m parts of a partition are
enumerated; what a set has in one of them, hashed, is a signature. Two sets of which |A and B| >= t * |A or B| differ in at most
d = min(|A|, |B|) * (1 - t) / t features, so at most d / (m + 1) partitions hold more than m of these, and in every other one some subset is equal in both:

* a partition is rich in a set that fills more than m of its parts: no subset is then empty. A set emits the signatures of its partitions
  in their order, up to d / (m + 1) + k rich ones, for its own band, and for the band below if a partner may be there. In the shorter
  one of two partners' lists, k rich partitions or more have a subset that is equal in both, so they share g signatures, where g is at least 1. A set with too few
  rich partitions for this (short ones, mostly) emits single features besides: the prefix of its set that any partner must meet.
* signatures that no other set has are dropped. A set keeps all but its g - 1 most frequent shared signatures; if fewer than g are
  shared it has no partner. By the same argument two partners still meet in the rarest signature that they share.
* sets that meet become pairs: all in a group of at most `SMALL`; in a larger group, every member with the few that share most. So a family of
  very many near copies costs a number of pairs in proportion to its size.
* the members of groups that are then not within one component (a passage that many documents share) are joined again with finer parts and
  far more signatures, of which far more of the frequent ones may be left out. In groups that are not settled then either, the members outside
  the largest component are held against all members, by bitmaps in blocks: no pair that could join two components is left out.
* pairs are held against each other by exact bounds (sizes; parity bitmaps, whose Hamming distance never exceeds that of the sets), then by the
  whole sets.

Signatures travel as packed records in blobs, one for each part of the hash range: 13 bytes for each signature. A task holds one part at a time; what a part gathers
of one signature that very many different sets share is those records. Exact copies are emitted once by each task. Cases:

* null and empty texts: an empty set, linked with nothing; its component is itself. Fewer words than a shingle: the whole sequence is one shingle.
* very long texts: whole; memory is bounded by one text. Ties: none matters, as links are exact and components take the least id.
* repeated rows are copies of each other. A null id gets its component's least id, or null. Empty table: no rows.
* extra columns and clashing names: only the id and the text are read; `keep_one` carries all columns and adds none.
* two different sets of one size with the same 64-bit key would be taken as equal; so would two shingles (about 3e-4 in 1e8 different ones).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .components import components
from .hashing import LOWER, NOT_SPACE, STEP_BYTES, grams, mix, words
from .packing import binary
from .tokens import flat, steps

#: A band's sizes go from WIDTH ** i to WIDTH ** (i + 1) - 1.
WIDTH = 4
#: Features of a first-level partition at a band's top, on average; by such a share of a set's size more partitions are emitted than its
#: differences can spoil; second-level parts of a partition, and how many of them a subset leaves out. COARSE is for all sets; FINE (partitions
#: of single features, nothing to leave out) for those that COARSE leaves in unsettled groups.
COARSE, FINE = (4.2, 0.04, 3, 1), (0.05, 0.6, 1, 0)
#: Groups of up to SMALL sets give all their pairs; in larger ones every member meets PIVOTS of them.
SMALL, PIVOTS = 8, 2
#: Unsettled groups are searched by blocks of about so many sets outside the largest component and so many members.
OUTSIDE, MEMBERS = 500, 2000
#: The sets to be verified are fetched by a broadcast of their ids up to so many, else by a shuffle of the texts.
BROADCAST_ROWS = 1_000_000
#: Records held by a task before it sends them on; bytes of signatures in a part; keys a task knows to be sent already.
HELD = 400_000
PART_BYTES = 64_000_000
SEEN = 1_000_000

SIGNATURE = np.dtype([("t", "<u4"), ("e", "<u8"), ("g", "u1")])
SHARED = np.dtype([("e", "<u8"), ("t", "<u4"), ("p", "<u4"), ("f", "<u4"), ("g", "u1")])
KEPT = np.dtype([("t", "<u4"), ("e", "<u8"), ("c", "<u4")])
#: g is sent as the largest of these that is not above it.
STEPS = np.floor(1.15 ** np.arange(200.0)).astype(np.int64)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text (sorted), one text after the other, and where each text's begin (and the end)."""
    data, offsets, _ = flat(texts)
    hashes, _, _, begin = words(LOWER[data], offsets, NOT_SPACE)
    n = np.diff(begin)
    made = grams(hashes, size)
    doc = np.repeat(np.arange(len(n)), n)[: len(made)]
    whole = np.arange(len(made)) + size <= begin[doc + 1]
    made, doc = made[whole], doc[whole]
    if len(short := np.flatnonzero((n > 0) & (n < size))):
        one = np.array([grams(hashes[begin[i] : begin[i + 1]], n[i])[0] for i in short], np.uint64)
        made, doc = np.append(made, mix(one + n[short].astype(np.uint64))), np.append(doc, short)
    order = np.lexsort((made, doc))
    made, doc = made[order], doc[order]
    if len(made):
        new = np.append(True, (made[1:] != made[:-1]) | (doc[1:] != doc[:-1]))
        made, doc = made[new], doc[new]
    return made, np.searchsorted(doc, np.arange(len(n) + 1))


def set_keys(made: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A key for each set, the last two bits 0."""
    sums = np.append(np.uint64(0), np.cumsum(mix(made ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    return mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(np.uint64)) & ~np.uint64(3)


def bitmap(features: np.ndarray) -> bytes:
    """How often each bit is met by a feature, modulo 2; twice as many bits as features, or more."""
    bits = 1 << max(6, int(2 * len(features) - 1).bit_length())
    return np.packbits((np.bincount((features >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(a: np.ndarray, n: int) -> np.ndarray:
    while len(a) > n:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def most_different(a: int, b: int, percent: int) -> int:
    """The largest number of features in just one of two linked sets of sizes a and b."""
    return a + b - 2 * -(-percent * (a + b) // (100 + percent))


class Signer:
    """Signatures of sets at a similarity of percent / 100."""

    def __init__(self, percent: int, scheme: tuple[float, float, int, int]):
        self.percent, (self.fill, self.share, self.subparts, self.out) = percent, scheme

    def spoiled(self, size: np.ndarray) -> np.ndarray:
        return size * (100 - self.percent) // self.percent

    def spare(self, size: np.ndarray) -> np.ndarray:
        return 1 + np.floor(self.share * size).astype(np.int64)

    def sign(self, made: np.ndarray, begin: np.ndarray, keys: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signatures of the sets numbered by keep: signature, entity (key and kind), g."""
        size = np.diff(begin)[keep]
        keep, size = keep[self.spoiled(size) > 0], size[self.spoiled(size) > 0]  # smaller sets are linked with equal ones only
        band = np.floor(np.log(np.maximum(size, 1) * (1 + 1e-9)) / np.log(WIDTH)).astype(np.int64)
        below = (band > 0) & (-(-self.percent * size // 100) <= WIDTH**band - 1)
        out, poor = [], np.zeros(len(keep), bool)
        for kind, mine, level in ((0, np.arange(len(keep)), band), (1, np.flatnonzero(below), band[below] - 1)):
            if len(mine):
                differ = self.spoiled(np.minimum(size[mine], WIDTH ** (level + 1) - 1)) // (self.out + 1)
                sig, of, rich = self._enumerated(made, begin[keep[mine]], size[mine], level, differ + self.spare(size[mine]))
                g = np.minimum(self.spare(-(-self.percent * size[mine] // 100)), rich - differ)
                poor[mine[g < 1]] = True
                out.append((sig, keys[keep[mine]][of] | np.uint64(kind), np.maximum(g, 1)[of]))
        if poor.any():
            mine = np.flatnonzero(poor)
            at, of = _ranges(begin[keep[mine]], size[mine])
            sig = mix(made[at] ^ np.uint64(0xA0761D6478BD642F))
            first = _first(sig, of, size[mine] + (-self.percent * size[mine]) // 100 + 1)
            out.append((sig[first], keys[keep[mine]][of[first]] | np.uint64(2), np.ones(first.sum(), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _enumerated(self, made: np.ndarray, start: np.ndarray, size: np.ndarray, level: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signatures of each set's partitions, in their order, up to the need-th rich one; the set each is of; rich partitions of each set."""
        at, of = _ranges(start, size)
        parts = np.ceil(WIDTH ** (level + 1.0) / self.fill).astype(np.uint64)
        h = made[at]
        cell = (h >> np.uint64(20)) % parts[of] * np.uint64(self.subparts) + (h & np.uint64(0xFFFFF)) % np.uint64(self.subparts)
        order = np.lexsort((cell, of))
        h, cell, of = h[order], cell[order], of[order]
        new = _runs(of, cell)
        content = np.add.reduceat(mix(h + np.uint64(0x9E6C63D0676A9A99)), new)
        of, part, sub = of[new], cell[new] // np.uint64(self.subparts), (cell[new] % np.uint64(self.subparts)).astype(np.int64)
        first = _runs(of, part)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(of))))
        sums, there = np.zeros((len(first), self.subparts), np.uint64), np.zeros((len(first), self.subparts), bool)
        sums[row, sub], there[row, sub] = content, True
        of, part, filled = of[first], part[first], there.sum(1)
        rich = filled > self.out
        upto = np.cumsum(rich)
        base = np.append(0, upto)[np.searchsorted(of, np.arange(len(size)))]
        sent = upto - rich - base[of] < need[of]
        of, part, filled, sums, there = of[sent], part[sent], filled[sent], sums[sent], there[sent]
        sigs, sets = [], []
        for number, left_out in enumerate(combinations(range(self.subparts), self.out)):
            left_out = list(left_out)
            some = filled > there[:, left_out].sum(1)
            rest = sums[some].sum(1, dtype=np.uint64) - sums[some][:, left_out].sum(1, dtype=np.uint64)
            sigs.append(mix(rest ^ mix(part[some] + (level[of[some]].astype(np.uint64) << np.uint64(48)) + np.uint64(number << 40))))
            sets.append(of[some])
        return np.concatenate(sigs), np.concatenate(sets), np.bincount(of, rich[sent], len(size)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places start, start + 1, ... of each range, and the range each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of


def _first(values: np.ndarray, of: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Marks the count[i] least values of each set i."""
    order = np.lexsort((values, of))
    size = np.bincount(of, minlength=len(count))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(len(order), bool)
    out[order] = rank < count[of[order]]
    return out


class Mail:
    """Records on their way to parts."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, [], 0

    def add(self, to: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((to, records))
        self.n += len(to)
        if self.n >= HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            to, records = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.argsort(to, kind="stable")
            to, records = to[order], records[order]
            new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            ends = np.append(new[1:], len(to))
            yield pa.RecordBatch.from_arrays([pa.array(to[new].astype(np.int32)), binary([records[a:b].tobytes() for a, b in zip(new.tolist(), ends.tolist(), strict=True)])], ["part", "blob"])
        self.held, self.n = [], 0


def _by_part(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each part; a partition holds one part."""
    now, blobs = None, []
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
            if part != now:
                if blobs:
                    yield now, np.frombuffer(b"".join(blobs), kind)
                now, blobs = part, []
            blobs.append(blob.as_py())
    if blobs:
        yield now, np.frombuffer(b"".join(blobs), kind)


def _dealt(df: DataFrame, partitions: int) -> DataFrame:
    """Each part in a partition of its own."""
    return df.repartitionById(partitions, "part")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def documents(docs: DataFrame, size: int) -> DataFrame:
    """docs: id, text, text_hash. Per row: id, text_hash, n (size of the set), key (0 if empty), bits (the bitmap)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            made, begin = shingles(batch.column("text"), size)
            n = np.diff(begin)
            keys = np.where(n > 0, set_keys(made, begin), 0).astype(np.uint64)
            maps = [bitmap(made[a:b]) if b > a else b"" for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(n), pa.array(keys.view(np.int64)), binary(maps)], ["id", "text_hash", "n", "key", "bits"])

    return docs.mapInArrow(found, f"id {docs.schema['id'].dataType.simpleString()}, text_hash long, n long, key long, bits binary")


def meetings(docs: DataFrame, size: int, percent: int, scheme: tuple[float, float, int, int], features: int) -> DataFrame:
    """docs: id, text; features: the sizes of their sets together. Rows (kind, x, y): kind 0: a pair of keys x < y; kind 1: key y belongs to the large group x."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-features * SIGNATURE.itemsize // PART_BYTES))
    signer = Signer(percent, scheme)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mail = set(), Mail(parts)
        for batch in steps(batches, "text", STEP_BYTES):
            made, begin = shingles(batch.column("text"), size)
            keys, keep = set_keys(made, begin), []
            for i in np.flatnonzero(np.diff(begin)).tolist():
                if (k := int(keys[i])) not in seen:
                    if len(seen) == SEEN:  # copies sent again are dropped with the others of their signature
                        seen.clear()
                    seen.add(k)
                    keep.append(i)
            sig, entity, g = signer.sign(made, begin, keys, np.array(keep, np.int64))
            records = np.empty(len(sig), SIGNATURE)
            records["t"], records["e"], records["g"] = sig & np.uint64(0xFFFFFFFF), entity, np.searchsorted(STEPS, g, "right") - 1
            yield from mail.add((sig >> np.uint64(32)).astype(np.int64) % parts, records)
        yield from mail.send()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(parts)
        for part, r in _by_part(batches, SIGNATURE):
            t, e, g = (np.ascontiguousarray(r[n]) for n in "teg")
            order = np.lexsort((e, t))
            t, e, g = t[order], e[order], g[order]
            one = _runs(t, e)
            t, e, g = t[one], e[one], g[one]
            new = _runs(t)
            f = np.diff(np.append(new, len(t)))
            f = np.repeat(f, f)
            many = f > 1
            out = np.empty(int(many.sum()), SHARED)
            out["e"], out["t"], out["p"], out["f"], out["g"] = e[many], t[many], part, f[many], g[many]
            yield from mail.add((e[many] >> np.uint64(11)).astype(np.int64) % parts, out)
        yield from mail.send()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail = Mail(parts)
        for _, r in _by_part(batches, SHARED):
            e, t, p, f, g = (np.ascontiguousarray(r[n]) for n in "etpfg")
            order = np.lexsort((p, t, f, e))
            e = e[order]
            new = _runs(e)
            n = np.diff(np.append(new, len(e)))
            rank = np.arange(len(e)) - np.repeat(new, n)
            kept = order[rank < np.repeat(n, n) - STEPS[g[order]] + 1]
            out = np.empty(len(kept), KEPT)
            central = np.minimum(np.add.reduceat(f[order].astype(np.int64), new), 0xFFFFFFFF)
            out["t"], out["e"], out["c"] = t[kept], r["e"][kept] & ~np.uint64(3), np.repeat(central, n)[rank < np.repeat(n, n) - STEPS[g[order]] + 1]
            yield from mail.add(p[kept].astype(np.int64), out)
        yield from mail.send()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in _by_part(batches, KEPT):
            t, e, c = (np.ascontiguousarray(r[n]) for n in "tec")
            order = np.lexsort((~c, e, t))  # an entity of either kind may be there: the more central counts
            t, e, c = t[order], e[order], c[order]
            one = _runs(t, e)
            t, e, c = t[one], e[one], c[one]
            order = np.lexsort((e, ~c, t))  # the most central first
            t, e = t[order], e[order]
            new = _runs(t)
            n = np.diff(np.append(new, len(t)))
            rank = np.arange(len(t)) - np.repeat(new, n)
            left = np.repeat(n, n) - rank - 1
            pairs = []
            for j in range(SMALL - 1):  # the j-th key of a group with those after it
                use = (rank == j) & (left > 0) & ((np.repeat(n, n) <= SMALL) | (j < PIVOTS))
                at, of = _ranges(np.flatnonzero(use) + 1, left[use])
                pairs.append(np.stack([e[use][of], e[at]]))
            x, y = np.concatenate(pairs, 1)
            x, y = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            one = _runs(x, y)
            big = np.flatnonzero(n > SMALL)
            group = set_keys(e, np.append(new, len(e)))[big]
            _, only = np.unique(group, return_index=True)
            at, of = _ranges(new[big[only]], n[big[only]])
            kind = np.repeat(np.array([0, 1], np.int8), [len(one), len(at)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.append(x[one], group[only][of]).view(np.int64)), pa.array(np.append(y[one], e[at]).view(np.int64))], ["kind", "x", "y"])

    blobs = "part int, blob binary"
    sent = _dealt(docs.mapInArrow(emit, blobs), parts).mapInArrow(shared, blobs)
    kept = _dealt(_dealt(sent, parts).mapInArrow(rarest, blobs), parts)
    return kept.mapInArrow(met, "kind byte, x long, y long").distinct()


def texts_of(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """key, id, text of one document for each key (of more where an id is repeated)."""
    wanted = cut(keys.distinct().join(classes.select("key", F.col("id").alias("of")), "key"))
    return docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, F.col("id").eqNullSafe(F.col("of"))).select("key", "id", "text")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (key, component) with further links: only the components that they join are looked at again."""
    names = lambda x: labels.select(F.col("key").alias(x), F.col("component").alias(f"c{x}"))
    between = cut(links.join(names("a"), "a", "left").join(names("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b"))
    joined = components(between).select(F.col("key").alias("component"), F.col("component").alias("to"))
    alone = between.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(labels, "key", "left_anti").select("key", F.col("key").alias("component"))
    return cut(labels.unionByName(alone).join(joined, "component", "left").select("key", F.coalesce("to", "component").alias("component")))


def unsettled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups (g, key) with members in more than one component: the member's component c, and the group's largest (most)."""
    now = cut(groups.join(labels, "key", "left").select("g", "key", F.coalesce("component", "key").alias("c")))
    parts = now.groupBy("g", "c").count().groupBy("g").agg(F.max_by("c", F.struct("count", "c")).alias("most"), F.count("*").alias("parts")).filter("parts > 1").select("g", "most")
    return cut(now.join(parts, "g"))


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of keys that sizes and bitmaps do not rule out. classes: key, n, bits."""

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), batch.column("bits_a"), batch.column("bits_b"), strict=True):
                fits = 100 * min(a, b) >= percent * max(a, b)
                if fits:
                    x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                    n = min(len(x), len(y))
                    fits = np.bitwise_count(folded(x, n) ^ folded(y, n)).sum() <= most_different(a, b, percent)
                keep.append(bool(fits))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(may_link, "a long, b long")


def in_blocks(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The likely pairs (a, b) of each family, the unsettled groups with one largest component: all sets outside it, with all members.

    A stated set against all rows, in blocks: each task holds a bounded block of either side, and no pair is made that a bound rules out."""
    family = mixed.groupBy("most", "key").agg(F.first("c").alias("c"))
    outside = F.col("c") != F.col("most")
    sizes = family.groupBy("most").agg(F.ceil(F.count_if(outside) / OUTSIDE).cast("int").alias("outs"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("ins"))
    rows = cut(family.join(sizes, "most").join(classes.select("key", "n", "bits"), "key"))
    block = lambda of, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    one = rows.filter(outside).withColumn("i", block("outs", 1)).withColumn("j", every("ins")).withColumn("out", F.lit(True))
    all_ = rows.withColumn("i", every("outs")).withColumn("j", block("ins", 2)).withColumn("out", F.lit(False))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        out = t["out"].to_numpy()
        key, c, n = (t[x].to_numpy() for x in ("key", "c", "n"))
        width = pc.binary_length(t["bits"]).to_numpy()
        maps = {w: np.frombuffer(b"".join(t["bits"].filter(pa.array(width == w)).to_pylist()), np.uint64).reshape(-1, w // 8) for w in np.unique(width)}
        place = np.zeros(len(key), np.int64)
        for w in maps:
            place[width == w] = np.arange((width == w).sum())
        outsiders = set(key[out].tolist())
        also_out = np.array([k in outsiders for k in key.tolist()], bool)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        inside = {w: np.flatnonzero(~out & (width == w)) for w in maps}
        for i in np.flatnonzero(out).tolist():
            for w, rows_in in inside.items():
                low = min(w, int(width[i]))
                at = rows_in[(100 * np.minimum(n[rows_in], n[i]) >= percent * np.maximum(n[rows_in], n[i])) & (c[rows_in] != c[i]) & (~also_out[rows_in] | (key[rows_in] > key[i]))]
                if len(at):
                    x = folded(maps[int(width[i])][place[i]], low // 8)
                    y = maps[w][place[at]]
                    while y.shape[1] > low // 8:
                        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                    both = n[at] + n[i]
                    most = both - 2 * -(-percent * both // (100 + percent))
                    at = at[np.bitwise_count(y ^ x).sum(1) <= most]
                    a.append(np.full(len(at), key[i]))
                    b.append(key[at])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return one.unionByName(all_).groupBy("most", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are linked. classes: key, id (of one document); docs: id, text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            made, begin = shingles(batch.column("text"), size)
            right = np.flatnonzero(set_keys(made, begin).view(np.int64) == batch.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(right)), binary([made[begin[i] : begin[i + 1]].tobytes() for i in right])], ["key", "features"])

    def do_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(pairs)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")), classes, docs)
    features = cut(texts.select("key", "text").mapInArrow(sets, "key long, features binary"))
    side = lambda x: features.select(F.col("key").alias(x), F.col("features").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(do_link, "a long, b long").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Per row of docs: id_col, n_shingles, component_id (the least id that its links reach, its own included), set_key (equal for equal sets), text_hash."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    known = cut(documents(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")), size))
    classes = cut(known.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    pairs_of = lambda found: found.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups_of = lambda found: found.filter("kind = 1").select(F.col("x").alias("g"), F.col("y").alias("key"))
    found = cut(meetings(rows, size, percent, COARSE, known.agg(F.sum("n")).first()[0] or 0))
    labels = components(verified(likely(pairs_of(found), classes, percent), classes, rows, size, percent))
    mixed = unsettled(groups_of(found), labels)
    if mixed.limit(1).count():
        again = texts_of(mixed.select("key"), classes, rows).select("id", "text")
        features = mixed.select("key").distinct().join(classes.select("key", "n"), "key").agg(F.sum("n")).first()[0]
        found = cut(meetings(again, size, percent, FINE, features))
        labels = merged(labels, verified(likely(pairs_of(found), classes, percent), classes, rows, size, percent))
        mixed = unsettled(groups_of(found), labels)
        labels = merged(labels, verified(in_blocks(mixed, classes, percent), classes, rows, size, percent))
    named = classes.select("key", "id").join(labels, "key", "left").withColumn("c", F.coalesce("component", "key"))
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    by_key = named.join(least, "c").select("key", "component_id")
    out = known.select("id", "text_hash", "n", "key").join(by_key, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("key").alias("set_key"), "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """docs, with its columns: of each group of linked documents the one with the least id (of equal rows: one). Documents without words stay."""
    ident, hashed = free_name(docs, "kept_id"), free_name(docs, "kept_text")
    marks = cut(join(docs, id_col, text_col, size, percent).filter("n_shingles > 0").select(F.col(f"`{id_col}`").alias(ident), F.col("text_hash").alias(hashed), F.col("component_id").alias("least")))
    lost = marks.filter(~F.col(ident).eqNullSafe(F.col("least"))).select(ident, hashed).distinct()
    again = marks.groupBy(ident, hashed).count().filter("count > 1").select(ident, hashed)
    of_row = F.col(f"`{id_col}`").eqNullSafe(F.col(ident)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(hashed))
    kept = docs.join(lost, of_row, "left_anti")
    if again.limit(1).count():  # equal rows: all but one go
        twice = kept.join(again, of_row, "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(again, of_row, "left_anti").unionByName(twice)
    return kept
