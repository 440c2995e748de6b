"""Cycles: strongly connected components of more than one file, over edges of all kinds.

A graph of up to ``kernel_edges`` distinct edges goes to one task. Beyond that, a DataFrame loop: files without an edge in
or out are trimmed, the greatest reachable-from colour is spread forward, and from each file that kept its own colour
a walk back inside the colour finds its component, which is set aside.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.operators.durable import Grown, durable
from rippletrace.operators.reach import KERNEL_EDGES
from rippletrace.plans import schema as S

LARGE = 10


def components(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """file_id, scc (the least file of the component), only for components of more than one file."""
    links = edges.where("src != dst").select("src", "dst").distinct()
    links = durable(links)  # counted, then read again
    if links.count() <= kernel_edges:
        return links.groupBy().applyInPandas(_one_task, "file_id string, scc string")
    return _loop(links)


def _one_task(t: pd.DataFrame) -> pd.DataFrame:
    names, codes = pd.factorize(pd.concat([t.src, t.dst]), sort=True)[::-1]
    m, n = len(t), len(names)
    nexts: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(codes[:m].tolist(), codes[m:].tolist()):
        nexts[a].append(b)
    # Path-based search with an explicit stack: two stacks of open files, one of them of possible roots.
    number, group, clock, groups = [0] * n, [-1] * n, 0, 0
    for start in range(n):
        if number[start]:
            continue
        clock += 1
        number[start] = clock
        path, roots, open_ = [(start, iter(nexts[start]))], [start], [start]
        while path:
            at, rest = path[-1]
            for to in rest:
                if not number[to]:
                    clock += 1
                    number[to] = clock
                    path.append((to, iter(nexts[to])))
                    roots.append(to)
                    open_.append(to)
                    break
                if group[to] < 0:
                    while number[roots[-1]] > number[to]:
                        roots.pop()
            else:
                path.pop()
                if roots[-1] == at:
                    roots.pop()
                    while True:
                        x = open_.pop()
                        group[x] = groups
                        if x == at:
                            break
                    groups += 1
    df = pd.DataFrame({"file_id": names, "group": group})
    size = df.groupby("group")["file_id"].transform("size")
    df = df[size > 1]
    return pd.DataFrame({"file_id": df.file_id, "scc": df.groupby("group")["file_id"].transform("min")})


def _trimmed(links: DataFrame) -> DataFrame:
    while True:
        before = links.count()
        links = durable(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if links.count() == before:
            return links


def _spread(colour: DataFrame, links: DataFrame) -> DataFrame:
    """The greatest colour of a file and all that reach it."""
    while True:
        more = colour.join(links, F.col("file_id") == F.col("src")).select(F.col("dst").alias("file_id"), "colour")
        new = durable(colour.unionByName(more).groupBy("file_id").agg(F.max("colour").alias("colour")))
        if new.join(colour, ["file_id", "colour"], "left_anti").isEmpty():
            return new
        colour = new


def _loop(links: DataFrame) -> DataFrame:
    done = links.select(F.col("src").alias("file_id"), F.col("src").alias("scc")).limit(0)
    links = _trimmed(links)
    while not links.isEmpty():
        files = links.select(F.col("src").alias("file_id")).union(links.select("dst")).distinct()
        colour = _spread(files.withColumn("colour", F.col("file_id")), links)
        a, b = colour.select(F.col("file_id").alias("src"), F.col("colour").alias("c1")), colour.select(F.col("file_id").alias("dst"), F.col("colour").alias("c2"))
        inside = durable(links.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour")))
        front = durable(colour.where("file_id = colour").select("file_id", "colour"))
        known = Grown(front)
        while not front.isEmpty():
            back = front.join(inside.select(F.col("dst").alias("file_id"), "src", "colour"), ["file_id", "colour"]).select(F.col("src").alias("file_id"), "colour").distinct()
            front = durable(back.join(known.rows(), ["file_id", "colour"], "left_anti"))
            known.add(front)
        found = known.rows()
        size = found.groupBy("colour").agg(F.count("*").alias("n"), F.min("file_id").alias("scc"))
        done = durable(done.unionByName(found.join(size.where("n > 1"), "colour").select("file_id", "scc")))
        gone = found.select("file_id")
        links = links.join(gone.withColumnRenamed("file_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("file_id", "dst"), "dst", "left_anti").select("src", "dst")
        links = _trimmed(durable(links))
    return done


def cycle_report(edges: DataFrame, kernel_edges: int = KERNEL_EDGES, shown: int = 10, preview: int = 5) -> DataFrame:
    """scc, size, files (sorted), shown_files, more, warning (for more than LARGE files, else null)."""
    groups = components(edges, kernel_edges).groupBy("scc").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("file_id")).alias("files"))
    head, middle, end = map(F.lit, S.CYCLE_WARNING)
    text = F.concat(head, F.col("size").cast("string"), middle, F.array_join(F.slice("files", 1, preview), " -> "), end)
    return groups.select(
        "scc", "size", "files", F.slice("files", 1, shown).alias("shown_files"), F.greatest(F.col("size") - shown, F.lit(0)).alias("more"), F.when(F.col("size") > LARGE, text).alias("warning")
    )
