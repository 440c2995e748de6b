"""Which tests a set of changed files affects: constrained reachability over the typed multigraph.

A state is (file, depth, down): depth counts the direct references followed since the last accessibility edge (at most
``max_depth``), down says that the path has gone against a view edge. From a state of a Source file, over the edge
kinds that the requested test kinds allow:

    out DirectReference       if depth < max_depth    depth + 1, same down
    out ViewEmbedding         if not down             same depth, down = false
    out AccessibilityBinding  always                  depth = 0, same down
    in ViewEmbedding          if view edges allowed   same depth, down = true

Files with a test role end a path. The answer is the least fixpoint over states, which no edge order can change.

Two ways give the same rows. A graph of up to ``kernel_edges`` edges (counted first) goes to one task, where numpy
expands whole levels: a resolve is then two small Spark jobs. Beyond that a DataFrame loop joins the frontier with the
edges, one hop a round; states that a known one dominates (no deeper, not more restricted) are dropped, as their
successors are known too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippletrace.functions.paths import is_test_class, kind_of_role
from rippletrace.operators.durable import Grown, durable
from rippletrace.plans import schema as S

KERNEL_EDGES = 2_000_000
STATES = "file_id string, depth int, down boolean"


def allowed_edges(kinds: list[str] | None) -> list[str]:
    """The edge kinds of the requested test kinds (none: all)."""
    return sorted({e for k in (kinds or S.KINDS) for e in S.EDGES_OF_KIND[k]})


def reached_states(
    nodes: DataFrame, edges: DataFrame, changed: DataFrame, kinds: list[str] | None = None, max_depth: int = 1, kernel_edges: int = KERNEL_EDGES, max_rounds: int = 10_000
) -> DataFrame:
    """STATES reached from the changed files that the graph knows."""
    allowed = allowed_edges(kinds)
    used = edges.where(F.col("kind").isin(*allowed)).select("src", "dst", "kind").distinct()
    seeds = changed.select("file_id").distinct().join(nodes, "file_id", "left_semi")
    sources = nodes.where("role = 'Source'").select("file_id")
    if allowed == [S.DIRECT] and max_depth == 1:
        return _one_hop(used, seeds, sources)
    used = durable(used)  # what follows counts it and reads it again
    return _kernel(used, seeds, sources, S.VIEW in allowed, max_depth) if used.count() <= kernel_edges else _loop(used, seeds, sources, S.VIEW in allowed, max_depth, max_rounds)


def _one_hop(edges: DataFrame, seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """Direct references to depth 1 need one join and no loop."""
    start = seeds.select("file_id", F.lit(0).alias("depth"), F.lit(False).alias("down"))
    next_ = seeds.join(sources, "file_id", "left_semi").join(edges, F.col("file_id") == F.col("src")).select(F.col("dst").alias("file_id"), F.lit(1).alias("depth"), F.lit(False).alias("down"))
    return start.unionByName(next_.distinct())


def _kernel(edges: DataFrame, seeds: DataFrame, sources: DataFrame, views: bool, max_depth: int) -> DataFrame:
    rows = edges.select(F.lit("e").alias("t"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind")
    rows = rows.unionByName(seeds.select(F.lit("s").alias("t"), F.col("file_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("kind")))
    rows = rows.unionByName(sources.select(F.lit("r").alias("t"), F.col("file_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("kind")))
    schema = T._parse_datatype_string(STATES)
    direct, view = S.DIRECT, S.VIEW

    def closure(t: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        e, seed, source = t[t.t == "e"], t[t.t == "s"].a, t[t.t == "r"].a
        names, codes = np.unique(np.concatenate([e.a, e.b, seed, source]).astype(object), return_inverse=True)
        m, width = len(e), 2 * (max_depth + 1)
        src, dst = codes[:m], codes[m : 2 * m]
        is_source = np.zeros(len(names), bool)
        is_source[codes[2 * m + len(seed) :]] = True
        kind = np.select([e.kind == direct, e.kind == view], [0, 1], 2)
        if views:  # against view edges: kind 3
            back = kind == 1
            src, dst, kind = np.concatenate([src, dst[back]]), np.concatenate([dst, src[back]]), np.concatenate([kind, np.full(back.sum(), 3)])
        keep = is_source[src]
        src, dst, kind = src[keep], dst[keep], kind[keep]
        order = np.argsort(src, kind="stable")
        dst, kind, begin = dst[order], kind[order], np.searchsorted(src[order], np.arange(len(names) + 1))
        known = np.zeros(len(names) * width, bool)
        front = np.unique(codes[2 * m : 2 * m + len(seed)]) * width
        known[front] = True
        while len(front):
            n, depth, down = front // width, front % width // 2, front % 2
            size = begin[n + 1] - begin[n]
            flat = np.repeat(begin[n], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            k, depth, down = kind[flat], np.repeat(depth, size), np.repeat(down, size)
            ok = np.select([k == 0, k == 1], [depth < max_depth, down == 0], True)
            depth = np.select([k == 0, k == 2], [depth + 1, 0], depth)
            down = np.select([k == 1, k == 3], [0, 1], down)
            to = np.unique((dst[flat] * width + depth * 2 + down)[ok])
            front = to[~known[to]]
            known[front] = True
        found = np.flatnonzero(known)
        return pd.DataFrame({"file_id": names[found // width], "depth": (found % width // 2).astype("int32"), "down": found % 2 == 1})

    return rows.groupBy().applyInPandas(closure, schema)


def _loop(edges: DataFrame, seeds: DataFrame, sources: DataFrame, views: bool, max_depth: int, max_rounds: int) -> DataFrame:
    moves = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind")
    if views:
        moves = moves.unionByName(edges.where(F.col("kind") == S.VIEW).select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit("back").alias("kind")))
    moves = durable(moves.join(sources.withColumnRenamed("file_id", "at"), "at", "left_semi"))
    front = durable(seeds.select("file_id", F.lit(0).alias("depth"), F.lit(False).alias("down")))
    reached = Grown(front)
    for _ in range(max_rounds):
        k = F.col("kind")
        step = front.join(moves, F.col("file_id") == F.col("at")).where(((k != S.DIRECT) | (F.col("depth") < max_depth)) & ((k != S.VIEW) | ~F.col("down")))
        step = step.select(
            F.col("to").alias("file_id"),
            F.when(k == S.DIRECT, F.col("depth") + 1).when(k == S.A11Y, 0).otherwise(F.col("depth")).alias("depth"),
            F.when(k == S.VIEW, False).when(k == "back", True).otherwise(F.col("down")).alias("down"),
        ).distinct()
        front = durable(step.join(reached.rows(), ["file_id", "depth", "down"], "left_anti"))
        if front.isEmpty():
            return reached.rows()
        reached.add(front)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def first_visit(nodes: DataFrame, edges: DataFrame, changed: DataFrame, kinds: list[str] | None = None, max_depth: int = 1, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """STATES as a first-in first-out walk sees them: the first state of a file counts, by the ordinal of edges and seeds
    (of equal ones by file and kind).

    For parity with tools that keep one state a file. Up to ``kernel_edges`` edges one task walks; beyond, level by level."""
    allowed = allowed_edges(kinds)
    e = durable(edges.where(F.col("kind").isin(*allowed)).select(F.lit("e").alias("t"), F.col("src").alias("a"), F.col("dst").alias("b"), "kind", "ordinal"))
    if e.count() > kernel_edges:
        return _first_visit_loop(nodes, e, changed, S.VIEW in allowed, max_depth)
    none = F.lit(None).cast("string")
    order = F.col("ordinal") if "ordinal" in changed.columns else F.lit(0)
    s = changed.join(nodes, "file_id", "left_semi").select(F.lit("s").alias("t"), F.col("file_id").alias("a"), none.alias("b"), none.alias("kind"), order.cast("long").alias("ordinal"))
    r = nodes.where("role = 'Source'").select(F.lit("r").alias("t"), F.col("file_id").alias("a"), none.alias("b"), none.alias("kind"), F.lit(0).cast("long").alias("ordinal"))
    views = S.VIEW in allowed
    direct, view = S.DIRECT, S.VIEW

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        t = t.sort_values(["ordinal", "a", "b", "kind"], kind="stable")
        out: dict[str, list] = {}
        into: dict[str, list] = {}
        for row in t[t.t == "e"].itertuples():
            out.setdefault(row.a, []).append((row.b, row.kind))
            if row.kind == view:
                into.setdefault(row.b, []).append(row.a)
        source = set(t[t.t == "r"].a)
        queue, seen = deque((a, 0, False) for a in t[t.t == "s"].a), {}
        while queue:
            n, depth, down = queue.popleft()
            if n in seen:
                continue
            seen[n] = (depth, down)
            if n not in source:
                continue
            for m, kind in out.get(n, ()):
                if kind == direct:
                    if depth < max_depth:
                        queue.append((m, depth + 1, down))
                elif kind == view:
                    if not down:
                        queue.append((m, depth, False))
                else:
                    queue.append((m, 0, down))
            if views:
                queue.extend((m, depth, True) for m in into.get(n, ()))
        return pd.DataFrame([(n, d, g) for n, (d, g) in seen.items()], columns=["file_id", "depth", "down"]).astype({"depth": "int32", "down": "bool"})

    return e.unionByName(s).unionByName(r).groupBy().applyInPandas(walk, STATES)


def _first_visit_loop(nodes: DataFrame, e: DataFrame, changed: DataFrame, views: bool, max_depth: int) -> DataFrame:
    """The walk by levels: of the ways into a file that no level before has, the first counts, by the rank of the file it
    comes from, edges out before edges against, ordinal. A level's files are sorted by that key and numbered in the order
    of the sorted partitions, so no level is gathered in one task."""
    out = e.select(F.col("a").alias("at"), F.col("b").alias("to"), "kind", "ordinal", F.lit(0).alias("phase"))
    back = e.where(F.col("kind") == S.VIEW).select(F.col("b").alias("at"), F.col("a").alias("to"), F.lit("back").alias("kind"), "ordinal", F.lit(1).alias("phase"))
    sources = nodes.where("role = 'Source'").select(F.col("file_id").alias("at"))
    moves = durable((out.unionByName(back) if views else out).join(sources, "at", "left_semi"))

    def numbered(level: DataFrame) -> DataFrame:
        return durable(level.orderBy("key").select("file_id", "depth", "down", F.monotonically_increasing_id().alias("rank")))

    order = F.col("ordinal") if "ordinal" in changed.columns else F.lit(0)
    first = changed.join(nodes, "file_id", "left_semi").groupBy("file_id").agg(F.min(F.struct(order.cast("long"), "file_id")).alias("key"))
    front = numbered(first.select("file_id", F.lit(0).alias("depth"), F.lit(False).alias("down"), "key"))
    seen = Grown(front.drop("rank"))
    while True:
        k = F.col("kind")
        step = front.join(moves, F.col("file_id") == F.col("at")).where(((k != S.DIRECT) | (F.col("depth") < max_depth)) & ((k != S.VIEW) | ~F.col("down")))
        way = F.struct("rank", "phase", "ordinal", "to", "kind")
        state = F.struct(
            F.when(k == S.DIRECT, F.col("depth") + 1).when(k == S.A11Y, 0).otherwise(F.col("depth")).alias("depth"),
            F.when(k == S.VIEW, False).when(k == "back", True).otherwise(F.col("down")).alias("down"),
        )
        level = step.groupBy(F.col("to").alias("file_id")).agg(F.min_by(state, way).alias("s"), F.min(way).alias("key")).select("file_id", "s.*", "key")
        front = numbered(level.join(seen.rows(), "file_id", "left_anti"))
        if front.isEmpty():
            return seen.rows()
        seen.add(front.drop("rank"))


def affected_tests(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """kind, file_id, target of the test files that were reached and are named like test classes."""
    hit = nodes.join(states.select("file_id").distinct(), "file_id", "left_semi").where("role != 'Source'").where(is_test_class(F.col("file_id")))
    return hit.select(kind_of_role(F.col("role")).alias("kind"), "file_id", F.col("module").alias("target"))


def impacted_keys(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """The raw identifiers that the reached Source files set or query."""
    seen = nodes.where("role = 'Source'").join(states.select("file_id").distinct(), "file_id", "left_semi")
    both = F.concat(F.coalesce("a11y_setters", F.array().cast("array<struct<id_kind:string,key:string>>")), F.coalesce("a11y_queries", F.array().cast("array<struct<id_kind:string,key:string>>")))
    return seen.select(F.explode(both).alias("i")).select(F.col("i.key").alias("key")).distinct()


def method_hits(nodes: DataFrame, tests: DataFrame, keys: DataFrame) -> DataFrame:
    """file_id, methods (by declaration) of UI tests: those that query an impacted identifier, or name a type whose page
    object (a file with that name in its path) does. Files without such a method are left out: they run whole.

    The page objects are first cut down to files with an impacted query. Of their paths all parts that are as long as a
    type's name meet the names by value, so no pair of a page and a type is looked at that doesn't match.
    """
    ui = nodes.join(tests.where("kind = 'UITest'").select("file_id"), "file_id", "left_semi")
    methods = ui.select("file_id", F.posexplode("test_methods").alias("pos", "m")).select("file_id", "pos", F.col("m.name").alias("name"), F.col("m.a11y_queries").alias("q"), F.col("m.referenced_types").alias("types"))
    direct = methods.select("file_id", "pos", F.explode("q.key").alias("key")).join(keys, "key", "left_semi").select("file_id", "pos")
    pages = nodes.select(F.col("file_id").alias("page"), F.explode("a11y_queries.key").alias("key")).join(keys, "key", "left_semi").select("page").distinct()
    types = durable(methods.select(F.explode("types").alias("type")).distinct())
    lengths = [r["n"] for r in types.select(F.length("type").alias("n")).distinct().orderBy("n").collect()]  # as many as names have lengths
    parts_of = lambda n: F.when(F.length("page") >= n, F.transform(F.sequence(F.lit(1), F.length("page") - n + 1), lambda i: F.substring("page", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = pages.select(F.explode(F.flatten(F.array(*map(parts_of, lengths)))).alias("type")).distinct() if lengths else types
    types = types.join(parts, "type", "left_semi")
    through = methods.select("file_id", "pos", F.explode("types").alias("type")).join(types, "type", "left_semi").select("file_id", "pos")
    hits = methods.join(direct.unionByName(through).distinct(), ["file_id", "pos"], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return hits.groupBy("file_id").agg(F.transform(ordered, lambda x: x["name"]).alias("methods"))


def resolve(nodes: DataFrame, edges: DataFrame, changed: DataFrame, kinds: list[str] | None = None, mode: str = "closure", max_depth: int = 1, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """kind, file_id, target, methods (null: the whole file) of the tests that the changed files affect, for the requested kinds.

    Requested kinds share one walk over the union of their edge kinds."""
    if mode == "first_visit":
        states = first_visit(nodes, edges, changed, kinds, max_depth)
    else:
        states = reached_states(nodes, edges, changed, kinds, max_depth, kernel_edges)
    wanted = list(kinds or S.KINDS)
    tests = affected_tests(nodes, states).where(F.col("kind").isin(*wanted))
    if "UITest" not in wanted:
        return tests.withColumn("methods", F.lit(None).cast("array<string>"))
    return tests.join(method_hits(nodes, tests, impacted_keys(nodes, states)), "file_id", "left").select("kind", "file_id", "target", "methods")
