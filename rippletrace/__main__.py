"""Command line: ``python -m rippletrace index | resolve | graph | verify``, on a graph saved below ``--store``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.operators import graph as G
from rippletrace.operators.cycles import cycle_report
from rippletrace.operators.durable import durable
from rippletrace.operators.report import cycles_text, dot_document, format_result, inspection_text, summary_text
from rippletrace.plans import engine
from rippletrace.plans.fact_sources import MakefileSource, SymbolIndexSource
from rippletrace.sources import facts, symbol_store
from rippletrace.sources.swift import extract_files

LOG = logging.getLogger("rippletrace")

KIND = {"unit": "Unit", "snapshot": "Snapshot", "ui": "UITest", "uitest": "UITest"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rippletrace")
    p.add_argument("--repo-root", default=".")
    p.add_argument("--store", help="folder of saved graphs; default: .rippletrace in the repository")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="build or update the graph")
    index.add_argument("--force", action="store_true", help="ignore what is saved")
    index.add_argument("--index-json", help="symbol-index pairs; without it the sources are parsed")
    index.add_argument("--index-store", help="symbol-index store to read with the helper; default: the newest that is found")
    index.add_argument("--helper-path", help="program that reads a symbol-index store; default: index-helper beside this program")
    index.add_argument("--derived-data", help="folder with .d files to add")
    resolve = sub.add_parser("resolve", help="list the tests that changes affect")
    resolve.add_argument("--base", default="origin/master")
    resolve.add_argument("--kind", action="append", choices=sorted(KIND), default=[])
    resolve.add_argument("--format", choices=["list", "json", "xcodebuild"], default="list")
    show = sub.add_parser("graph", help="look at the graph")
    show.add_argument("--file")
    show.add_argument("--cycles", action="store_true")
    show.add_argument("--dot", metavar="FOLDER", help="write the graph in DOT form, as text files, below a folder")
    verify = sub.add_parser("verify", help="list failed tests that would not have been selected")
    verify.add_argument("--base", default="origin/master")
    verify.add_argument("--failed", required=True, help="file with the paths of failed tests, one a line")
    return p


def _pairs(spark: SparkSession, root: str, inventory: DataFrame, args: argparse.Namespace) -> DataFrame | None:
    """The symbol index's pairs: of a file, or by the helper from a store. None if there is neither, unless one was asked for."""
    if args.index_json:
        return facts.index_pairs(spark, args.index_json)
    try:
        helper = symbol_store.find_helper(args.helper_path)
        store = args.index_store or symbol_store.find_store(spark, root)
        if store is None:
            raise FileNotFoundError("no symbol index was found")
        return symbol_store.run_helper(spark, helper, store, root, [r["file_id"] for r in inventory.select("file_id").toLocalIterator()])
    except (OSError, RuntimeError, ValueError) as e:
        if args.index_store or args.helper_path:
            raise
        LOG.info("no symbol index (%s): the sources are parsed", e)
        return None


def run_index(spark: SparkSession, root: str, store: str, args: argparse.Namespace) -> str:
    """Builds the graph, or brings the saved one up to date: only changed files are parsed, deleted ones go."""
    inventory = durable(facts.current_inventory(spark, root))
    saved = None if args.force else facts.load_graph(spark, store)
    parsed = None
    if saved is not None:
        nodes, _, meta = saved
        known = nodes.where("content_hash is not null")  # others are endpoints that no inventory lists
        if G.changed_files(inventory, known).isEmpty() and G.deleted_files(inventory, known).isEmpty():
            return summary_text(meta)
        parsed = facts.load_parsed(spark, store)
    files = facts.walked_inventory(spark, root).join(inventory, "file_id", "left_semi")
    parsed = durable(extract_files(files) if parsed is None else engine.update_parsed(parsed, files, inventory, known))
    broken = [r["file_id"] for r in files.select("file_id").join(parsed, "file_id", "left_anti").orderBy("file_id").limit(20).collect()]
    if broken:
        LOG.warning("files that could not be parsed, first of all: %s", ", ".join(broken))
    nodes, edges = engine.graph_of_parsed(parsed, inventory, root + "/")
    sources = ["tree-sitter"]
    pairs = _pairs(spark, root, inventory, args)
    if pairs is not None:
        parsed_nodes, parsed_edges = nodes, edges
        nodes, edges = SymbolIndexSource(pairs, inventory, root + "/").read(spark)
        nodes, edges = G.supplement(nodes, edges, parsed_nodes, parsed_edges, ["indexstore"])
        sources = ["indexstore", "treesitter-supplement"]
    if args.derived_data:
        more_nodes, more = MakefileSource(args.derived_data, inventory, root).read(spark)
        nodes, edges, sources = G.add_missing_nodes(nodes, more_nodes), edges.unionByName(more), [*sources, "dot-d"]
    nodes, edges = durable(nodes), durable(edges)
    meta = durable(G.metadata(nodes, edges, root, sources))
    facts.save_graph(nodes, edges, meta, store, parsed)
    return summary_text(meta)


def run_verify(spark: SparkSession, nodes: DataFrame, edges: DataFrame, changed: DataFrame, failed: str) -> str:
    """Failed tests (a file with one path a line) that the selection misses."""
    selected = engine.affected(nodes, edges, changed)
    missed = engine.verify_selection(selected, spark.read.text(failed).select(F.trim("value").alias("file_id")).where("file_id != ''"))
    names = [r["file_id"] for r in missed.orderBy("file_id").collect()]
    return "\n".join(["Failed but not selected:", *names]) if names else "All failed tests were selected."


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rippletrace").getOrCreate()
    root = facts.find_root(args.repo_root)
    store = args.store or f"{root}/.rippletrace"
    if args.command == "index":
        return run_index(spark, root, store, args)
    saved = facts.load_graph(spark, store)
    if saved is None:
        raise SystemExit("no graph is saved; run index first")
    nodes, edges, meta = saved
    if args.command == "resolve":
        changed = facts.changed_since(spark, root, args.base)
        if changed.isEmpty():
            return ""
        return format_result(engine.affected(nodes, edges, changed, [KIND[k] for k in args.kind] or None), args.format)
    if args.command == "verify":
        return run_verify(spark, nodes, edges, facts.changed_since(spark, root, args.base), args.failed)
    if args.dot:
        dot_document(edges).write.mode("overwrite").text(args.dot)
        return ""
    if args.file:
        return inspection_text(*engine.inspect(nodes, edges, args.file))
    return cycles_text(cycle_report(edges)) if args.cycles else summary_text(meta)


if __name__ == "__main__":
    text = main()
    if text:
        sys.stdout.write(text + "\n")
