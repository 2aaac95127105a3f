"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through regions and racks to a shard. At each node, every child draws -ln(u) / weight from a hash
of the row's key and the child's own name; the least draw wins. A child's draw depends on nothing but its name and weight, so a
changed weight moves rows only into or out of the subtrees whose weights change. A shard that is added in a new region
takes rows only into itself. Cases:

* null key: hashed as the empty text, so that all null and empty keys share a shard. Null text: size 1, crc 0.
* repeated rows and ties: equal keys share a shard and get slots of their own. Empty table: no rows.
* extra columns and clashing names: carried; a column that `assign` adds gets an underscore more where its name is taken.
* a key with a third of all rows: its shard holds them by definition; slots are dealt in `buckets` parts by the hash of key and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added_names

#: region -> rack -> shard, with the shard's weight
Tree = dict[str, dict[str, dict[int, float]]]


def grid(shards: int, regions: int = 4, racks: int = 2, per_rack: int = 2) -> Tree:
    """The first regions * racks * per_rack shards fill a grid; each later shard is a region of its own, so that growth moves rows only into it."""
    tree: Tree = {}
    for s in range(shards):
        region, rest = divmod(s, racks * per_rack)
        region, rack = (region, rest // per_rack) if region < regions else (s - regions * (racks * per_rack - 1), 0)
        tree.setdefault(f"r{region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def uniform(key: Column, name: str) -> Column:
    """A number within (0, 1) from the first 12 hex digits of md5(name ~ key)."""
    digits = F.substring(F.md5(F.concat(F.lit(name + "~"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def draw(key: Column, children: dict[str, float]) -> Column:
    """The position of the child with the least draw; ties: the first."""
    if len(children) == 1:
        return F.lit(0)
    draws = F.array(*[F.struct((-F.ln(uniform(key, n)) / F.lit(float(w))).alias("d"), F.lit(i).alias("i")) for i, (n, w) in enumerate(children.items())])
    return F.array_min(draws)["i"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Descends the tree: one draw at each level."""
    weight = {r: sum(sum(shards.values()) for shards in racks.values()) for r, racks in tree.items()}
    in_region = []
    for r, racks in tree.items():
        in_rack = [F.get(F.array(*map(F.lit, shards)), draw(key, {f"{r}/{k}/{s}": w for s, w in shards.items()})) for k, shards in racks.items()]
        rack = draw(key, {f"{r}/{k}": sum(shards.values()) for k, shards in racks.items()})
        in_region.append(_choose(rack, in_rack))
    return _choose(draw(key, weight), in_region).cast("int")


def _choose(at: Column, among: list[Column]) -> Column:
    out = among[-1]
    for i in range(len(among) - 2, -1, -1):
        out = F.when(at == i, among[i]).otherwise(out)
    return out


def assign(docs: DataFrame, key: str = "doc_id", tie: tuple[str, ...] = (), shards: int = 16, buckets: int = 256, names: tuple[str, str, str] = ("shard", "slot", "grown_shard")) -> DataFrame:
    """docs with its shard, the shard under one more, and its slot: gapless from 0 in each shard, ordered by bucket, key and tie columns.

    A shard's rows are ranked within `buckets` parts, and each part starts where the ones before it end: shards * buckets counts, so no task sorts a whole shard."""
    shard, slot, grown, part, first, of_shard, of_part = added_names(docs, (*names, "slot_part", "slot_first", "first_of_shard", "first_of_part"))
    k = F.col(f"`{key}`")
    bucket = F.conv(F.substring(F.md5(F.concat_ws("~", F.lit("slot"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (key, *tie)])), 1, 8), 16, 10).cast("long") % buckets
    placed = docs.withColumns({shard: shard_of(k, grid(shards)), grown: shard_of(k, grid(shards + 1)), part: bucket.cast("int")})
    sizes = placed.groupBy(shard, part).count()
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias(of_shard), F.col(part).alias(of_part), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(shard, part).orderBy(k, *[F.col(f"`{c}`") for c in tie])
    ranked = placed.withColumn(slot, F.row_number().over(within) - 1)
    out = ranked.join(F.broadcast(starts), (F.col(shard) == F.col(of_shard)) & (F.col(part) == F.col(of_part)))
    return out.withColumn(slot, (F.col(slot) + F.col(first)).cast("long")).drop(of_shard, of_part, part, first)
