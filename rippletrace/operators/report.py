"""Formats of a resolve result (kind, file_id, target, methods) and of a graph's inspection.

Rows keep their order through (kind rank, file, method place); the text forms put them together at the end, and what
they join is the report that a user reads, not the graph.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.paths import kind_rank, stem
from rippletrace.plans import schema as S


def list_lines(result: DataFrame) -> DataFrame:
    """rank, file_id, pos, line: target/Class/method, target/Class, Class/method or Class."""
    some = F.when(F.size("methods") > 0, F.col("methods"))
    rows = result.select(kind_rank(F.col("kind")).alias("rank"), "file_id", "target", F.posexplode_outer(some).alias("pos", "method"))
    return rows.select("rank", "file_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.concat_ws("/", "target", stem(F.col("file_id")), "method").alias("line"))


def xcodebuild_flags(result: DataFrame) -> DataFrame:
    """rank, file_id, pos, flag. Tests without a target have none; whole files with a space in it are quoted."""
    some = F.when(F.size("methods") > 0, F.col("methods"))
    rows = result.where("target is not null").select(kind_rank(F.col("kind")).alias("rank"), "file_id", "target", F.posexplode_outer(some).alias("pos", "method"))
    flag = F.concat(F.lit("-only-testing:"), F.concat_ws("/", "target", stem(F.col("file_id")), "method"))
    quoted = F.when(F.col("method").isNull() & flag.contains(" "), F.concat(F.lit("'"), flag, F.lit("'"))).otherwise(flag)
    return rows.select("rank", "file_id", F.coalesce("pos", F.lit(0)).alias("pos"), quoted.alias("flag"))


def joined(rows: DataFrame, column: str, separator: str) -> str:
    """The rows' text in their order; empty without rows."""
    return separator.join(r[0] for r in rows.orderBy("rank", "file_id", "pos").select(column).collect())


def write_lines(rows: DataFrame, column: str, folder: str) -> None:
    """The rows' text in their order as text files below ``folder``, sorted by the workers: for results that are too long for one string."""
    rows.orderBy("rank", "file_id", "pos").select(column).write.mode("overwrite").text(folder)


def json_files(result: DataFrame) -> DataFrame:
    """kind (lower case), files: the JSON array of {file, target, methods?} of that kind, by file."""
    whole = F.to_json(F.struct(F.col("file_id").alias("file"), "target"), {"ignoreNullFields": "false"})
    some = F.to_json(F.struct(F.col("file_id").alias("file"), "target", "methods"), {"ignoreNullFields": "false"})
    one = F.when(F.size("methods") > 0, some).otherwise(whole)
    rows = result.select(F.lower("kind").alias("kind"), F.struct("file_id", one.alias("text")).alias("r"))
    return rows.groupBy("kind").agg(F.array_sort(F.collect_list("r")).alias("r")).select("kind", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["text"]), ","), F.lit("]")).alias("files"))


def json_report(result: DataFrame) -> str:
    """{kind: [{file, target, methods?}], total}: kinds without tests are absent, a missing target is null, total counts files."""
    found = {r["kind"]: json.loads(r["files"]) for r in json_files(result).collect()}
    out = {k.lower(): found[k.lower()] for k in S.KINDS if k.lower() in found}
    return json.dumps(out | {"total": sum(map(len, out.values()))}, indent=2)


def format_result(result: DataFrame, fmt: str = "list", any_change: bool = True) -> str:
    """list, json or xcodebuild; without a changed file nothing is printed in any format."""
    if not any_change:
        return ""
    if fmt == "json":
        return json_report(result)
    return joined(list_lines(result), "line", "\n") if fmt == "list" else joined(xcodebuild_flags(result), "flag", " ")


def counts_by_kind(result: DataFrame) -> DataFrame:
    """kind, n and a row ``total``."""
    return result.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("total")).alias("kind"), "n")


def dot_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('"%s" -> "%s" [label="%s"];', "src", "dst", "kind").alias("line"))


def dot_document(edges: DataFrame) -> DataFrame:
    """line: the whole graph as a DOT document, in order of its lines."""
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, "digraph dependencies {"), (2, "}")], "part int, line string")
    return ends.unionByName(dot_lines(edges).select(F.lit(1).alias("part"), "line")).orderBy("part", "line").select("line")


def summary_text(meta: DataFrame) -> str:
    m = meta.first()
    return f"Files: {m['file_count']}\nEdges: {m['edge_count']}\nSources: {', '.join(m['data_sources_used'])}"


def inspection_text(node: DataFrame, neighbours: DataFrame) -> str:
    """Role, symbols, dependents and dependencies of one file."""
    found = node.first()
    if found is None:
        return "File is not in the graph"
    rows = neighbours.orderBy("direction", "file_id", "kind").collect()
    out = [f"Role: {found['role']}", f"Symbols: {', '.join(found['defined_symbols'] or [])}"]
    for title, direction in (("Dependents", "dependent"), ("Dependencies", "dependency")):
        own = [f"  {r['file_id']} ({r['kind']})" for r in rows if r["direction"] == direction]
        out += [f"{title}: {len(own)}", *own]
    return "\n".join(out)


def cycles_text(report: DataFrame) -> str:
    """Count of cycles and the first files of each, then the warnings."""
    rows = report.orderBy("scc").collect()
    if not rows:
        return "No dependency cycles detected."
    out = [f"Found {len(rows)} dependency cycles:"]
    for k, r in enumerate(rows, 1):
        out += ["", f"  Cycle {k} ({r['size']} files):", *(f"    {f}" for f in r["shown_files"]), *([f"    ... and {r['more']} more"] if r["more"] else [])]
    return "\n".join(out + [w for r in rows if (w := r["warning"])])
