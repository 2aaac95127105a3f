"""Connected components of links between 64-bit keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: So many links or fewer are joined by one task (a few tens of MB); more of them by rounds of least labels over all tasks.
ONE_TASK = 400_000


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """links: a long, b long. Per key in a link: key, component (the least key that it reaches). Both ways give the same rows."""
    links = cut(links.select("a", "b").distinct())
    return cut(_joined(links) if links.count() <= one_task else _rounds(links))


def _joined(links: DataFrame) -> DataFrame:
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
        if not pairs:
            return
        keys, at = np.unique(np.concatenate(pairs, 1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(keys))
        while True:  # least labels of neighbours, then labels of labels, until nothing changes
            new = root.copy()
            np.minimum.at(new, root[a], root[b])
            np.minimum.at(new, root[b], root[a])
            new = np.minimum(new, new[root])
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[root])], ["key", "component"])

    return links.coalesce(1).mapInArrow(joined, "key long, component long")


def _rounds(links: DataFrame) -> DataFrame:
    """Each round, a key takes the least label among its own and its neighbours', then its label's label; the rounds grow as the logarithm of
    the longest path. Labels are minima with partial sums, so a key with very many links costs no task its whole list; each round
    is a table in the shared folder."""
    edges = cut(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        taken = cut(labels.join(near, "key").select("key", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        jump = taken.select(F.col("key").alias("component"), F.col("component").alias("next"))
        labels = cut(taken.join(jump, "component").select("key", "old", F.col("next").alias("component")))
        if labels.filter("component != old").limit(1).count() == 0:
            return labels.select("key", "component")
        labels = labels.select("key", "component")
