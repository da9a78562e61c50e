"""Connected components of a link table.

Up to ``ONE_TASK`` distinct links, a size that is counted first, one task (not
the driver) spreads labels over two arrays of that length. Beyond it the links go
through alternating large and small stars: every step is a grouped minimum and an
equi-join, so no group is gathered in a task and a node with very many links is
split by the skew join; each round is written to the shared folder. Both give the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

MAX_ROUNDS = 60
#: Links that one task takes, 16 bytes each.
ONE_TASK = 2_000_000


def label_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        while not np.array_equal(label[label], label):
            label = label[label]
        if np.array_equal(label, before):
            return nodes, nodes[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        nodes, label = label_nodes(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["node", "label"])


def _mark(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1] or 0


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """``node, label``: each linked node with the smallest node it can reach.

    Rows with a null end or with equal ends are no links; repeated rows count once.
    """
    e = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(f"`{u}` is not null and `{v}` is not null and u <> v").distinct()
    e = materialise(e, "links")
    before = _mark(e)
    if before[0] <= ONE_TASK:
        return materialise(e.select("u", "v").coalesce(1).mapInArrow(_in_one_task, "node long, label long"), "components")
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), F.col("u").alias("c"))
        pairs = small.select(F.col("c").alias("u"), F.col("b").alias("v")).unionByName(small.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
        e = materialise(pairs.where("u <> v").distinct(), "links")
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
