"""The three kinds of fact sources, each a ``sources.facts.FactSource``: ``read`` gives nodes and raw edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.operators.durable import saved
from rippletrace.plans import engine
from rippletrace.sources import facts
from rippletrace.sources.swift import extract_files


@dataclass
class ParsedSource:
    """Texts (file_id, content) read by the own parser."""

    files: DataFrame
    root: str = ""
    name: str = "tree-sitter"

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        parsed = saved(extract_files(self.files))
        return engine.nodes_of_parsed(parsed, self.root), engine.edges_of_parsed(parsed)


@dataclass
class SymbolIndexSource:
    """Pairs (from, to) of a symbol index; endpoints outside the inventory become nodes too."""

    pairs: DataFrame
    inventory: DataFrame
    root: str = ""
    name: str = "indexstore"

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return engine.index_symbol_store(self.pairs, self.inventory, self.root)


@dataclass
class MakefileSource:
    """Dependency files of a build below a folder."""

    folder: str
    inventory: DataFrame
    root: str = ""
    name: str = "dot-d"

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        edges = facts.dependency_edges(facts.dependency_lines(facts.dependency_files(spark, self.folder)), self.inventory, self.root)
        return engine.nodes_of_paths(edges.select(F.explode(F.array("src", "dst")).alias("file_id")), self.root + "/"), edges
