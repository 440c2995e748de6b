"""Connected components of a graph given as a table of links.

Each partition first keeps a forest of its links, which has fewer links than nodes. As long as all forests together are
up to ``most`` links (two numbers each), one task joins them: three jobs, whatever the shape of the graph. Beyond, large-star
and small-star steps alternate. Every step is a grouped minimum and a join on the node. The minima are pre-aggregated,
and the join is one of two plain shuffles, in which adaptive execution splits the links of a hub; nothing is collected. The
steps keep who reaches whom, and every link goes to the lesser node. They end when the links are stars: each node has one
link, to a node that has none, which is then the least that it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, grouped, map_arrow

#: Links that one task joins (64 MB), and links that a task gathers before it keeps their forest only.
MOST, GATHERED = 4_000_000, 1_000_000


def components(links: DataFrame, most_steps: int = 100, most: int = MOST) -> DataFrame:
    """node, root (least node reachable) for all nodes of ``links(a, b)`` that are not roots themselves."""
    edges = durable(map_arrow(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")), _forest, "u long, v long"))
    if edges.count() <= most:
        edges = durable(map_arrow(edges.coalesce(1), _forest, "u long, v long"))
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_steps):
        if _stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = durable(_small_star(_large_star(edges)))
    raise RuntimeError("links did not settle")


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links that reach a lesser node, and the least that each reaches."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = np.arange(len(names))
    label, a, b = own, ends[: len(a)], ends[len(a) :]
    while len(a):
        np.minimum.at(label := label.copy(), np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
        a, b = label[a], label[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    moved = np.flatnonzero(label != own)
    return names[moved], names[label[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held, kept = [], 0, 0
    for b in batches:
        parts.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        held += b.num_rows
        if held > max(GATHERED, 2 * kept):
            parts = [roots_of(*map(np.concatenate, zip(*parts)))]
            held = kept = len(parts[0][0])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots_of(*map(np.concatenate, zip(*parts)))], ["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two links, or links to a node that has one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("k")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("k")))
    return ends.groupBy("n").agg(F.sum("k").alias("links"), F.count_if(F.col("k") == 0).alias("linked")).where("links > 1 or links = 1 and linked > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = grouped(both, "u", F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = grouped(edges, "u", F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    lower = edges.join(least.hint("merge"), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
