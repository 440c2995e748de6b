"""Readers of facts: file inventories, symbol-index files, makefile dependencies, change lists, saved graphs."""

from __future__ import annotations

import json
import logging
import os
import subprocess
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.functions.paths import is_source_file, is_skipped_tracked, is_skipped_walked, module_of, relative_to, stem
from rippletrace.functions.paths import contains_any
from rippletrace.functions.symbols import repository_slug
from rippletrace.plans import schema as S


class FactSource(Protocol):
    """What an index is built from: ``read`` gives nodes (NODES, may lack columns) and raw edges (src, dst, kind)."""

    name: str

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]: ...


# --- inventories -----------------------------------------------------------------------------------------------


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True).stdout


def find_root(start: str) -> str:
    """The repository that holds a folder; without version control the folder itself."""
    try:
        return _git(start, "rev-parse", "--show-toplevel").strip()
    except (OSError, subprocess.CalledProcessError):
        return os.path.realpath(start)


def current_inventory(spark: SparkSession, root: str) -> DataFrame:
    """file_id, blob_sha of the source files: those of version control, or, where that fails, those that a walk finds, with the same content ids computed."""
    try:
        return tracked_inventory(spark, root)
    except (OSError, subprocess.CalledProcessError) as e:
        logging.getLogger("rippletrace").warning("no version control (%s): walking the folder", e)
        files = walked_inventory(spark, root)
        body = F.col("content").cast("binary")
        head = F.concat(F.lit("blob "), F.octet_length("content").cast("string")).cast("binary")
        return files.select("file_id", F.sha1(F.concat(head, F.unhex(F.lit("00")), body)).alias("blob_sha"))


def tracked_inventory(spark: SparkSession, root: str) -> DataFrame:
    """file_id, blob_sha of the tracked source files, from the version-control index."""
    rows = [(line.split("\t", 1)[1], line.split()[1]) for line in _git(root, "ls-files", "-s", "-z").split("\0") if line]
    return source_inventory(spark.createDataFrame(rows, "file_id string, blob_sha string"))


def source_inventory(listing: DataFrame) -> DataFrame:
    """The source files of a listing (file_id, ...) outside vendored and built folders."""
    return listing.where(is_source_file(F.col("file_id")) & ~is_skipped_tracked(F.col("file_id")))


def walked_inventory(spark: SparkSession, root: str) -> DataFrame:
    """file_id, content of the source files below a folder, where there is no version control."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.swift").load(root)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").cast("string").alias("content"))
    empty = [(p, "") for folder, _, names in os.walk(root) for n in names if n.endswith(".swift") and not os.path.getsize(p := os.path.join(folder, n))]  # a scan passes over empty files
    files = files.unionByName(spark.createDataFrame(empty, "path string, content string")) if empty else files
    return files.where(~is_skipped_walked(F.col("path"))).select(relative_to(F.col("path"), root).alias("file_id"), "content")


# --- changes ---------------------------------------------------------------------------------------------------


def compare_request(slug: str, base: str, head: str) -> str:
    """The code host's JSON answer to a comparison of two commits."""
    from urllib.request import Request, urlopen

    token = os.environ.get("GITHUB_TOKEN")
    headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    with urlopen(Request(f"https://api.github.com/repos/{slug}/compare/{base}...{head}", headers=headers), timeout=60) as answer:
        return answer.read().decode()


def changed_by_review(spark: SparkSession, root: str, base: str, request: Callable[[str, str, str], str] = compare_request) -> DataFrame:
    """file_id of the source files that the code host lists between ``base`` and HEAD."""
    url = spark.createDataFrame([(_git(root, "remote", "get-url", "origin").strip(),)], "url string")
    slug = url.select(repository_slug(F.col("url"))).first()[0]
    if not slug:
        raise ValueError("the remote names no repository of the code host")
    text = request(slug, base.removeprefix("origin/"), _git(root, "rev-parse", "HEAD").strip())
    return paths_of_review(spark.createDataFrame([(text,)], "json string"))


def changed_since(spark: SparkSession, root: str, base: str, request: Callable[[str, str, str], str] = compare_request) -> DataFrame:
    """file_id of source files that differ between the merge base with ``base`` and the working tree; a rename counts with both names.

    A shallow clone on a build machine (CI is set) may have no merge base; there the code host is asked."""
    try:
        merge_base = _git(root, "merge-base", base, "HEAD").strip()
    except subprocess.CalledProcessError:
        if "CI" not in os.environ or _git(root, "rev-parse", "--is-shallow-repository").strip() != "true":
            raise
        return changed_by_review(spark, root, base, request)
    fields = iter(_git(root, "diff", "--name-status", "-M", "-z", merge_base).split("\0"))
    rows = []
    for status in fields:
        if status:
            old = next(fields)
            rows.append((old, next(fields) if status[0] in "RC" else old))
    return changed_paths(spark.createDataFrame(rows, "old_path string, new_path string"))


def changed_paths(deltas: DataFrame) -> DataFrame:
    """file_id: both paths of each delta (old_path, new_path), sources only, once."""
    paths = deltas.select(F.explode(F.array_compact(F.array("old_path", "new_path"))).alias("file_id"))
    return source_inventory(paths).distinct()


def paths_of_review(response: DataFrame) -> DataFrame:
    """file_id from a code host's JSON answer (column ``json`` with files[].filename); it has no old names."""
    files = F.from_json("json", "struct<files:array<struct<filename:string>>>")["files"]
    return source_inventory(response.select(F.explode(files["filename"]).alias("file_id")).where("file_id is not null")).distinct()


# --- symbol index ----------------------------------------------------------------------------------------------


def index_pairs(spark: SparkSession, path: str) -> DataFrame:
    """from, to of a symbol-index JSON file {edges: [{from, to}], fileCount, edgeCount}; a broken file is an error."""
    read = spark.read.schema(S.INDEX_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.select(F.explode("edges").alias("e")).select("e.from", "e.to")


def parse_index_output(text: str) -> dict:
    """A helper's output: what stands after the last closing brace is not part of it."""
    return json.loads(text[: text.rindex("}") + 1])


def newest_store(stores: DataFrame, project: str) -> DataFrame:
    """path of the store (name, path, mtime) of a project, whose name begins a store's: the newest one."""
    own = stores.where((F.col("name") == project) | F.col("name").startswith(project + "-"))
    return own.agg(F.max_by("path", F.struct("mtime", "path")).alias("path")).where("path is not null")


def index_counts(occurrences: DataFrame) -> DataFrame:
    """scanned, definitions, reference_count, defined: the figures that an index run reports."""
    return occurrences.agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("role") == "definition").alias("definitions"),
        F.count_if(F.col("role") == "reference").alias("reference_count"),
        F.countDistinct(F.when(F.col("role") == "definition", F.col("usr"))).alias("defined"),
    )


# --- makefile dependencies -------------------------------------------------------------------------------------


def dependency_files(spark: SparkSession, root: str) -> DataFrame:
    """file, content of all .d files below a folder."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.d")
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def dependency_lines(files: DataFrame) -> DataFrame:
    """file, output, inputs of the first rule of each file; a file without one is left out.

    Continued lines are joined; empty lines and comments are passed over; white space separates inputs, escaped or not.
    """
    lines = F.transform(F.split(F.replace("content", F.lit("\\\n"), F.lit(" ")), "\r?\n"), F.trim)
    rules = F.filter(lines, lambda x: ~x.startswith("#") & (F.instr(x, " : ") > 0))
    df = files.select("file", F.get(rules, F.lit(0)).alias("rule")).where("rule is not null")
    inputs = F.filter(F.split(F.expr("substring(rule, instr(rule, ' : ') + 3)"), r"\s+"), lambda x: x != "")
    return df.select("file", F.trim(F.substring_index("rule", " : ", 1)).alias("output"), inputs.alias("inputs"))


def dependency_edges(lines: DataFrame, inventory: DataFrame, root: str = "") -> DataFrame:
    """An edge from each input to the source of the output, repeated ones too.

    The output's source is the file with the object's name; of several the least path. An input below ``root`` counts
    as it is; one of a toolchain's folders never does; others must be in the inventory.
    """
    by_name = inventory.groupBy(stem(F.col("file_id")).alias("name")).agg(F.min("file_id").alias("dst"))
    outputs = lines.join(by_name, stem(F.col("output")) == F.col("name")).select("dst", F.explode("inputs").alias("input"))
    inputs = outputs.where(is_source_file(F.col("input")))
    folder = root.rstrip("/") + "/"
    below = F.col("input").startswith(folder) if root else F.lit(False)
    own = inputs.where(below).select("dst", relative_to(F.col("input"), root or "/").alias("src"))
    other = inputs.where(~below & ~contains_any(F.col("input"), S.SKIPPED_INPUTS)).withColumnRenamed("input", "src")
    other = other.join(inventory.select(F.col("file_id").alias("src")).distinct(), "src", "left_semi").select("dst", "src")
    return own.unionByName(other).where("src != dst").select("src", "dst", F.lit(S.DIRECT).alias("kind"))


# --- saved graphs ----------------------------------------------------------------------------------------------

#: Saved graphs are looked for in this order.
STORE_ORDER = ("indexstore", "tree-sitter")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it lies."""
    fs, at = _files(spark, folder)
    fs.delete(at, True)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions of a saved graph, oldest first: a version is whole once its metadata, written last, is."""
    fs, at = _files(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    return [f"{path}/{n}" for n in names if n.startswith("v=") and fs.exists(_files(spark, f"{path}/{n}/metadata/_SUCCESS")[1])]


def save_graph(nodes: DataFrame, edges: DataFrame, meta: DataFrame, folder: str, parsed: DataFrame | None = None) -> str:
    """Writes nodes, edges (by kind, so that a query reads the kinds it may follow), the parser's facts and metadata below
    folder/graph-<first source>, as a new version; older ones go only when it is whole. So a graph may be read from the
    store that it is saved to, and a run that fails leaves the last one."""
    spark = nodes.sparkSession
    sources = meta.first()["data_sources_used"]
    path = f"{folder}/graph-{sources[0] if sources else 'unknown'}"
    version = f"{path}/v={time.time_ns():020d}"
    nodes.write.parquet(f"{version}/nodes")
    edges.write.partitionBy("kind").parquet(f"{version}/edges")
    if parsed is not None:
        parsed.write.parquet(f"{version}/parsed")
    meta.write.parquet(f"{version}/metadata")
    for old in _versions(spark, path)[:-1]:
        remove(spark, old)
    return version


def saved_version(spark: SparkSession, folder: str) -> str | None:
    """The folder of the preferred saved graph, or None."""
    return next((v[-1] for v in (_versions(spark, f"{folder}/graph-{name}") for name in STORE_ORDER) if v), None)


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """nodes, edges, metadata of the preferred saved graph, or None. Nodes without a module get the one of their path."""
    path = saved_version(spark, folder)
    if path is None:
        return None
    nodes = spark.read.parquet(f"{path}/nodes")
    nodes = nodes.withColumn("module", F.coalesce("module", module_of(F.col("file_id"))))
    return nodes, spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/metadata")


def load_parsed(spark: SparkSession, folder: str) -> DataFrame | None:
    """The parser's facts of the preferred saved graph, or None."""
    path = saved_version(spark, folder)
    fs, at = _files(spark, f"{path}/parsed")
    return spark.read.parquet(f"{path}/parsed") if path and fs.exists(at) else None
