"""Building, updating and pruning the graph: nodes (file_id, ...) and edges (src, dst, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.operators.edges import known_endpoints
from rippletrace.plans import schema as S


def first_of_each(nodes: DataFrame, order: str = "file_ordinal") -> DataFrame:
    """One node a file: the first."""
    rest = [c for c in nodes.columns if c not in ("file_id", order)]
    return nodes.groupBy("file_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("file_id", "r.*")


def build_graph(nodes: DataFrame, edges: DataFrame, order: str = "file_ordinal") -> tuple[DataFrame, DataFrame]:
    own = first_of_each(nodes, order)
    return own, known_endpoints(edges, own)


def changed_files(inventory: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files of the inventory (file_id, blob_sha) that are new or whose content differs; two unknown contents are equal."""
    old = nodes.select(F.col("file_id").alias("old_id"), F.col("content_hash").alias("old_sha"))
    both = inventory.join(old, F.col("file_id") == F.col("old_id"), "left")
    return both.where(F.col("old_id").isNull() | ~F.col("blob_sha").eqNullSafe(F.col("old_sha"))).select("file_id").distinct()


def deleted_files(inventory: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("file_id").join(inventory, "file_id", "left_anti").distinct()


def new_files(inventory: DataFrame, nodes: DataFrame) -> DataFrame:
    return inventory.select("file_id").join(nodes, "file_id", "left_anti").distinct()


def remove_outgoing(edges: DataFrame, files: DataFrame) -> DataFrame:
    return edges.join(files.select(F.col("file_id").alias("src")), "src", "left_anti").select(*edges.columns)


def remove_kind(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(~F.col("kind").isin(*kinds))


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without these files and all edges at them."""
    kept = remove_outgoing(edges, files).join(files.select(F.col("file_id").alias("dst")), "dst", "left_anti").select(*edges.columns)
    return nodes.join(files, "file_id", "left_anti"), kept


def attach_hashes(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """content_hash from the inventory; files without an entry get none."""
    shas = inventory.select("file_id", "blob_sha")
    out = nodes.join(shas, "file_id", "left").withColumn("content_hash", F.col("blob_sha")).drop("blob_sha")
    return out.select(*nodes.columns)


def patch_columns(nodes: DataFrame, patch: DataFrame, columns: list[str]) -> DataFrame:
    """These columns from the patch where it has the file; other files stay as they are."""
    new = patch.select(F.col("file_id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in columns])
    both = nodes.join(new, F.col("file_id") == F.col("p_id"), "left")
    return both.select(*[F.when(F.col("p_id").isNotNull(), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def upsert_nodes(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Known files take content, time, symbols and module of the changed ones and keep the rest; unknown ones come whole."""
    patched = patch_columns(nodes, changed, [c for c in ("content_hash", "mtime", "defined_symbols", "module") if c in nodes.columns])
    return patched.unionByName(changed.join(nodes.select("file_id"), "file_id", "left_anti").select(*nodes.columns))


def update_incremental(nodes: DataFrame, edges: DataFrame, changed_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces the outgoing edges of the changed files and upserts them. Edges that come in from elsewhere stay."""
    all_nodes = upsert_nodes(nodes, changed_nodes)
    kept = remove_outgoing(edges, changed_nodes.select("file_id"))
    return all_nodes, kept.unionByName(known_endpoints(new_edges, all_nodes).select(*edges.columns))


def replace_facts(facts: DataFrame, changed: DataFrame, new_facts: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Facts with those of changed (and deleted) files replaced: the exact way to update, as all joins run again."""
    gone = changed.select("file_id") if deleted is None else changed.select("file_id").unionByName(deleted.select("file_id"))
    return facts.join(gone.distinct(), "file_id", "left_anti").unionByName(new_facts)


def supplement(nodes: DataFrame, edges: DataFrame, parsed: DataFrame, parsed_edges: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds what only the parser sees to a symbol-index graph: its view and accessibility edges, and identifiers of known files."""
    if "indexstore" not in sources:
        return nodes, edges
    patched = patch_columns(nodes, parsed, [c for c in ("a11y_setters", "a11y_queries", "test_methods") if c in nodes.columns])
    extra = known_endpoints(parsed_edges.where(F.col("kind").isin(S.A11Y, S.VIEW)), nodes)
    return patched, remove_kind(edges, S.A11Y, S.VIEW).unionByName(extra.select(*edges.columns))


def add_missing_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    return nodes.unionByName(more.join(nodes.select("file_id"), "file_id", "left_anti").select(*nodes.columns))


def metadata(nodes: DataFrame, edges: DataFrame, repo_root: str, sources: list[str]) -> DataFrame:
    counts = nodes.agg(F.count("*").alias("file_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each
    return counts.select(
        F.lit(repo_root).alias("repo_root"), F.current_timestamp().alias("indexed_at"), "file_count", "edge_count", F.array_distinct(F.array(*map(F.lit, sources))).alias("data_sources_used")
    )


def neighbours(edges: DataFrame, file_id: str) -> DataFrame:
    """direction (dependent: uses the file, dependency: is used by it), file_id, kind."""
    out = edges.where(F.col("src") == file_id).select(F.lit("dependent").alias("direction"), F.col("dst").alias("file_id"), "kind")
    return out.unionByName(edges.where(F.col("dst") == file_id).select(F.lit("dependency").alias("direction"), F.col("src").alias("file_id"), "kind"))
