"""Connected components in Spark, by alternating large and small stars.

Every node learns the least node it can reach. A round of large stars links each node's larger
neighbours to the least of its neighbourhood, a round of small stars its smaller ones; few rounds
are needed even for chains. Rows of one node are never gathered: the least neighbour is a plain
aggregate and comes back by a join, which Spark may split where a node has very many links.
Each round is a written table in the shared folder. FEW links or less are no rounds' worth of jobs:
one task takes them all and labels their nodes the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import keep

#: Links that one task may take, 16 bytes each.
FEW = 250_000


def least_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label that each of n rows reaches by the links a-b, labels being row numbers."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def _all_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (u, v) to (node, component) of the nodes that are not their component's least."""
    links = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if links:
        u, v = (np.concatenate(c) for c in zip(*links, strict=True))
        nodes = np.unique(np.r_[u, v])
        label = least_labels(len(nodes), np.searchsorted(nodes, u), np.searchsorted(nodes, v), np.arange(len(nodes)))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): the larger (or smaller) neighbours of each u linked to the least of u and its neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, uri: str, most: int = 60) -> DataFrame:
    """edges (u, v) of longs as (node, component): the least node that a node reaches, for every linked node but that one itself."""
    now = keep(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), f"{uri}/edges")
    if now.count() <= FEW:
        return keep(now.repartition(1).mapInArrow(_all_at_once, "node long, component long"), f"{uri}/labelled")
    before = None
    for k in range(most):
        now = keep(_star(_star(now, True), False), f"{uri}/round-{k}")
        # The stars are done when a round leaves the links as they are; sums of hashes tell sets of links apart.
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
