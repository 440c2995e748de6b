"""One query for each operator over the driver's tables, with the same in SQL as an independent check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.functions import paths as P
from rippletrace.functions import symbols as Y
from rippletrace.operators import cycles as C
from rippletrace.operators import edges as E
from rippletrace.operators import graph as G
from rippletrace.operators import reach as R
from rippletrace.operators import report as K
from rippletrace.operators.durable import durable, saved, shared_folder
from rippletrace.plans import adapters as A
from rippletrace.plans import engine as N
from rippletrace.plans import schema as S
from rippletrace.sources import facts
from rippletrace.sources.swift import extract_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# --- shared SQL ------------------------------------------------------------------------------------------------

FILES = f"files AS (SELECT p_partkey, {A.PART_FILE} AS file_id FROM part)"
STEM = "regexp_replace(regexp_extract(file_id, '[^/]*$'), '^(.+)[.][^.]*$', '\\1')"
ROLE = f"""CASE WHEN contains(lower(file_id), 'uitest') OR contains(lower(file_id), 'ui_test') OR contains(lower(file_id), 'e2etest') THEN 'UITest'
 WHEN NOT (contains(lower(file_id), 'tests/') OR contains(lower(file_id), '/test/')) AND NOT regexp_matches(lower({STEM}), 'tests?$') THEN 'Source'
 WHEN contains(lower(file_id), 'snapshot') THEN 'SnapshotTest' ELSE 'UnitTest' END"""
MODULE = """coalesce(list_filter(string_split(file_id, '/')[1:-2], lambda x: regexp_matches(lower(x), 'tests?$') AND lower(x) NOT IN ('tests', 'test'))[1],
 CASE WHEN regexp_matches(file_id, '(^|/)Tests/[^/]+/[^/]') THEN regexp_extract(file_id, '(?:^|/)Tests/([^/]+)/[^/]', 1) END)"""
ROLES = f"roles AS (SELECT p_partkey, file_id, {ROLE} AS role, {MODULE} AS module FROM files)"
EDGES = """edges AS (SELECT DISTINCT x.file_id AS src, y.file_id AS dst,
 CASE a.l_returnflag WHEN 'A' THEN 'DirectReference' WHEN 'N' THEN 'ViewEmbedding' ELSE 'AccessibilityBinding' END AS kind
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey
 JOIN files x ON x.p_partkey = a.l_partkey JOIN files y ON y.p_partkey = b.l_partkey)"""
CHANGED = "changed AS (SELECT file_id FROM files WHERE p_partkey % 100 = 1)"
ALLOWED = {
    "Unit": "('DirectReference')",
    "Snapshot": "('DirectReference', 'ViewEmbedding')",
    "all": "('DirectReference', 'ViewEmbedding', 'AccessibilityBinding')",
}


def _moves(kind: str) -> str:
    allowed = ALLOWED.get(kind, ALLOWED["all"])
    out = f"SELECT e.src AS a, e.dst AS b, e.kind AS k FROM edges e JOIN roles r ON r.file_id = e.src AND r.role = 'Source' WHERE e.kind IN {allowed}"
    if kind != "Unit":
        out += " UNION ALL SELECT e.dst, e.src, 'back' FROM edges e JOIN roles r ON r.file_id = e.dst AND r.role = 'Source' WHERE e.kind = 'ViewEmbedding'"
    return f"moves AS ({out})"


def _reach(kind: str) -> str:
    return f"""WITH RECURSIVE {FILES}, {ROLES}, {EDGES}, {CHANGED}, {_moves(kind)},
states AS (SELECT file_id, 0 AS depth, FALSE AS down FROM changed UNION
 SELECT m.b, CASE m.k WHEN 'DirectReference' THEN s.depth + 1 WHEN 'AccessibilityBinding' THEN 0 ELSE s.depth END,
  CASE m.k WHEN 'ViewEmbedding' THEN FALSE WHEN 'back' THEN TRUE ELSE s.down END
 FROM states s JOIN moves m ON m.a = s.file_id WHERE (m.k <> 'DirectReference' OR s.depth < 1) AND (m.k <> 'ViewEmbedding' OR NOT s.down))"""


TESTS = f"""tests AS (SELECT CASE role WHEN 'UnitTest' THEN 'Unit' WHEN 'SnapshotTest' THEN 'Snapshot' ELSE 'UITest' END AS kind, file_id, module AS target
 FROM roles WHERE role <> 'Source' AND regexp_matches({STEM}, 'Tests?$') AND file_id IN (SELECT file_id FROM states))"""
KEY = "CASE WHEN {x} % 2 = 1 THEN 'Ids.' || ({x} % 97) ELSE 'a11y_' || ({x} % 97) END"
SETTERS = """setters AS (SELECT file_id, CASE WHEN p_partkey % 2 = 1 THEN 'Symbolic' ELSE 'Literal' END AS id_kind,
 CASE WHEN p_partkey % 2 = 1 THEN 'Ids.' || (p_partkey % 97) ELSE 'a11y_' || (p_partkey % 97) END AS key FROM roles WHERE role = 'Source')"""
PAGES = "pages_ AS (SELECT file_id, 'Literal' AS id_kind, 'a11y_' || ((p_partkey * 3) % 97) AS key FROM roles WHERE role = 'Source' AND p_partkey % 5 = 0)"
METHODS = """methods AS (SELECT DISTINCT r.file_id, l.l_linenumber AS n, 'test' || l.l_linenumber AS name, CASE WHEN l.l_suppkey % 2 = 1 THEN 'Symbolic' ELSE 'Literal' END AS id_kind,
 CASE WHEN l.l_suppkey % 2 = 1 THEN 'Ids.' || (l.l_suppkey % 97) ELSE 'a11y_' || (l.l_suppkey % 97) END AS key, 'P' || l.l_suppkey AS type
 FROM roles r JOIN lineitem l ON l.l_partkey = r.p_partkey WHERE r.role = 'UITest')"""
IMPACTED = "impacted AS (SELECT DISTINCT key FROM (SELECT file_id, key FROM setters UNION ALL SELECT file_id, key FROM pages_) WHERE file_id IN (SELECT file_id FROM states))"
HITS = """hits AS (SELECT file_id, list(name ORDER BY n) AS methods FROM (SELECT DISTINCT m.file_id, m.n, m.name FROM methods m JOIN tests t ON t.file_id = m.file_id
 WHERE m.key IN (SELECT key FROM impacted) OR EXISTS (SELECT 1 FROM pages_ p WHERE contains(p.file_id, m.type) AND p.key IN (SELECT key FROM impacted))) GROUP BY file_id)"""
RESULT = f"{_reach('all')}, {TESTS}, {SETTERS}, {PAGES}, {METHODS}, {IMPACTED}, {HITS}, result AS (SELECT t.kind, t.file_id, t.target, h.methods FROM tests t LEFT JOIN hits h USING (file_id))"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph with identifiers and methods, and the changed files."""
    return durable(A.part_nodes(spark, sf_dir)), A.part_edges(spark, sf_dir), A.part_changed(spark, sf_dir)


def _light(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without identifiers and methods."""
    f = F.col("file_id")
    nodes = durable(A.part_files(spark, sf_dir).select("file_id", P.role_of_path(f).alias("role"), P.module_of(f).alias("module")))
    return nodes, A.part_edges(spark, sf_dir), A.part_changed(spark, sf_dir)


# --- predicates and projections --------------------------------------------------------------------------------


@query(f"WITH {FILES}, {ROLES} SELECT file_id, role FROM roles")
def classify_roles(spark, sf_dir):
    return A.part_files(spark, sf_dir).select("file_id", P.role_of_path(F.col("file_id")).alias("role"))


@query(
    f"WITH {FILES}, {ROLES} SELECT file_id, CASE WHEN p_partkey % 6 = 0 THEN 'SnapshotTest' ELSE role END AS role FROM roles"
)
def classify_by_imports(spark, sf_dir):
    imports = F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit("XCTest"), F.lit("SnapshotTesting"))).when(F.col("p_partkey") % 6 == 1, F.array(F.lit("SwiftUI")))
    return A.part_files(spark, sf_dir).select("file_id", P.role_of(F.col("file_id"), imports).alias("role"))


@query(f"WITH {FILES}, {ROLES} SELECT file_id, module FROM roles")
def infer_modules(spark, sf_dir):
    return A.part_files(spark, sf_dir).select("file_id", P.module_of(F.col("file_id")).alias("module"))


@query(f"WITH {FILES} SELECT file_id, regexp_matches({STEM}, 'Tests?$') AS is_test_class FROM files")
def test_class_filter(spark, sf_dir):
    return A.part_files(spark, sf_dir).select("file_id", P.is_test_class(F.col("file_id")).alias("is_test_class"))


URLS = "SELECT page_id, replace(url, 'blog', 'Pods') || CASE page_id % 4 WHEN 0 THEN '/build/a.swift' WHEN 1 THEN '/x/b.swift' WHEN 2 THEN '/checkouts/c.h' ELSE '.swiftinterface' END AS p FROM pages"
_SKIP = lambda parts: " OR ".join(f"contains(p, '{x}')" for x in parts)


@query(
    f"""SELECT page_id, NOT ({_SKIP(S.SKIPPED_TRACKED)}) AND suffix(p, '.swift') AS tracked, NOT ({_SKIP(S.SKIPPED_WALKED)}) AS walked,
 NOT ({_SKIP(S.SKIPPED_INDEXED)} OR {" OR ".join(f"prefix(p, '{x}')" for x in S.SKIPPED_INDEXED_START)} OR {" OR ".join(f"suffix(p, '{x}')" for x in S.SKIPPED_INDEXED_END)}) AS indexed FROM ({URLS})"""
)
def excluded_paths(spark, sf_dir):
    end = F.when(F.col("page_id") % 4 == 0, "/build/a.swift").when(F.col("page_id") % 4 == 1, "/x/b.swift").when(F.col("page_id") % 4 == 2, "/checkouts/c.h").otherwise(".swiftinterface")
    p = F.col("p")
    df = A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.replace("url", F.lit("blog"), F.lit("Pods")), end).alias("p"))
    return df.select("page_id", (~P.is_skipped_tracked(p) & P.is_source_file(p)).alias("tracked"), (~P.is_skipped_walked(p)).alias("walked"), (~P.is_skipped_indexed(p)).alias("indexed"))


@query(f"WITH {FILES} SELECT '/repo/' || file_id AS path, CASE WHEN starts_with(file_id, 'Tests/') THEN substr(file_id, 7) ELSE '/repo/' || file_id END AS relative FROM files")
def relativize_paths(spark, sf_dir):
    path = F.concat(F.lit("/repo/"), F.col("file_id"))
    return A.part_files(spark, sf_dir).select(path.alias("path"), P.relative_to(path, "/repo/Tests").alias("relative"))


@query("SELECT s_suppkey, regexp_replace(x, '[.](rawValue|id|identifier|value)$', '') AS stripped FROM (SELECT s_suppkey, 'Ids.K' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.rawValue' WHEN 1 THEN '.id.id' WHEN 2 THEN '.idx' WHEN 3 THEN '.value' ELSE '' END AS x FROM supplier)")
def strip_accessors(spark, sf_dir):
    k = F.col("s_suppkey")
    end = F.when(k % 5 == 0, ".rawValue").when(k % 5 == 1, ".id.id").when(k % 5 == 2, ".idx").when(k % 5 == 3, ".value").otherwise("")
    return A.table(spark, sf_dir, "supplier").select(k, Y.strip_accessor(F.concat(F.lit("Ids.K"), k, end)).alias("stripped"))


@query(
    """SELECT DISTINCT url, CASE WHEN starts_with(u, 'git@github.com:') OR starts_with(u, 'https://github.com/') OR starts_with(u, 'ssh://git@github.com/')
 THEN regexp_replace(regexp_replace(u, '^(git@github.com:|https://github.com/|ssh://git@github.com/)', ''), '([.]git)+$', '') END AS slug
 FROM (SELECT url, CASE page_id % 4 WHEN 0 THEN 'git@github.com:' WHEN 1 THEN 'https://github.com/' WHEN 2 THEN 'ssh://git@github.com/' ELSE '' END || url || CASE page_id % 3 WHEN 0 THEN '.git' ELSE '' END AS u FROM pages)"""
)
def repository_slugs(spark, sf_dir):
    k = F.col("page_id")
    head = F.when(k % 4 == 0, "git@github.com:").when(k % 4 == 1, "https://github.com/").when(k % 4 == 2, "ssh://git@github.com/").otherwise("")
    u = F.concat(head, F.col("url"), F.when(k % 3 == 0, ".git").otherwise(""))
    return A.table(spark, sf_dir, "pages").select("url", Y.repository_slug(u).alias("slug")).distinct()


@query("SELECT kind, edge_kind FROM (VALUES ('Unit', 'DirectReference'), ('Snapshot', 'DirectReference'), ('Snapshot', 'ViewEmbedding'), ('UITest', 'DirectReference'), ('UITest', 'ViewEmbedding'), ('UITest', 'AccessibilityBinding')) t(kind, edge_kind)")
def kind_edges(spark, sf_dir):
    return spark.createDataFrame([(k, e) for k, es in S.EDGES_OF_KIND.items() for e in es], "kind string, edge_kind string")


# --- joins that build edges ------------------------------------------------------------------------------------

_NAMES = ", ".join(f"'{n}'" for n in sorted(S.BUILTIN_NAMES))
SYMBOLS = """refs AS (SELECT DISTINCT 'Docs/D' || doc_id || '.swift' AS file_id, unnest(regexp_extract_all(text, '(^|[^A-Za-z])([A-Z][a-z]{3,})', 2)) AS symbol FROM documents),
 defs AS (SELECT file_id, min(symbol) AS symbol FROM refs GROUP BY file_id)"""
_REFS = f"r.symbol NOT IN ({_NAMES}) AND r.file_id <> d.file_id"


@query(f"WITH {SYMBOLS} SELECT d.file_id AS src, r.file_id AS dst, 'DirectReference' AS kind FROM refs r JOIN defs d ON d.symbol = r.symbol WHERE {_REFS}")
def symbol_edges(spark, sf_dir):
    refs, defs = A.document_symbols(spark, sf_dir)
    return E.symbol_edges(refs, defs)


@query(
    f"WITH {SYMBOLS}, twice AS (SELECT * FROM refs UNION ALL SELECT * FROM refs WHERE length(symbol) % 4 = 0) SELECT d.file_id AS src, r.file_id AS dst, 'ViewEmbedding' AS kind FROM twice r JOIN defs d ON d.symbol = r.symbol WHERE {_REFS}"
)
def view_edges(spark, sf_dir):
    refs, defs = A.document_symbols(spark, sf_dir)
    return E.view_edges(refs.unionAll(refs.where("length(symbol) % 4 = 0")), defs)


@query(f"WITH {SYMBOLS}, two AS (SELECT file_id, symbol FROM defs UNION SELECT file_id, max(symbol) FROM refs GROUP BY file_id), e AS (SELECT d.file_id AS src, r.file_id AS dst FROM refs r JOIN two d ON d.symbol = r.symbol WHERE {_REFS}) SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst HAVING count(*) > 1")
def edge_multiplicity(spark, sf_dir):
    refs, defs = A.document_symbols(spark, sf_dir)
    two = defs.union(refs.groupBy("file_id").agg(F.max("symbol"))).distinct()
    return E.repeated_edges(refs, two)


A11Y_FACTS = f"""WITH {FILES}, {ROLES}, {SETTERS}, {PAGES}, {METHODS},
facts AS (SELECT DISTINCT file_id, 'setter' AS side, id_kind, key FROM setters UNION SELECT file_id, 'query', id_kind, key FROM pages_ UNION SELECT file_id, 'query', id_kind, key FROM methods),
al AS (SELECT alias, arg_max(target, s_suppkey) AS target FROM (SELECT CASE WHEN s_nationkey = 0 THEN 'Ids' ELSE 'Alias' || s_nationkey END AS alias, 'Ids' || (s_suppkey % 3) AS target, s_suppkey FROM supplier) GROUP BY alias),
co AS (SELECT path, arg_max(literal, o) AS literal FROM (SELECT 'Ids.' || (s_suppkey % 97) AS path, 'a11y_' || (s_suppkey % 97) AS literal, s_suppkey AS o FROM supplier
 UNION ALL SELECT 'Ids' || (s_suppkey % 3) || '.' || (s_suppkey % 97), 'a11y_' || ((s_suppkey * 2) % 97), s_suppkey FROM supplier) GROUP BY path),
ex AS (SELECT f.*, CASE WHEN id_kind = 'Symbolic' THEN al.target || substr(f.key, length(string_split(f.key, '.')[1]) + 1) END AS expanded FROM facts f LEFT JOIN al ON f.id_kind = 'Symbolic' AND al.alias = string_split(f.key, '.')[1]),
ke AS (SELECT ex.*, list_sort(list_distinct(list_filter([ex.key, ex.expanded, c1.literal, c2.literal], lambda x: x IS NOT NULL))) AS keys FROM ex
 LEFT JOIN co c1 ON ex.id_kind = 'Symbolic' AND c1.path = ex.key LEFT JOIN co c2 ON c2.path = ex.expanded)"""


@query(f"{A11Y_FACTS} SELECT DISTINCT side, id_kind, key, keys FROM ke")
def canonical_keys(spark, sf_dir):
    facts_ = A.a11y_facts(spark, sf_dir).select("side", "id_kind", "key").distinct()
    return E.canonical_keys(facts_, A.typealiases(spark, sf_dir), A.constants(spark, sf_dir)).withColumn("keys", F.array_sort("keys"))


@query(f"{A11Y_FACTS}, one AS (SELECT DISTINCT file_id, side, unnest(keys) AS name FROM ke) SELECT DISTINCT s.file_id AS src, q.file_id AS dst, 'AccessibilityBinding' AS kind FROM one s JOIN one q ON s.name = q.name AND s.side = 'setter' AND q.side = 'query' AND s.file_id <> q.file_id")
def a11y_edges(spark, sf_dir):
    return E.a11y_edges(saved(A.a11y_facts(spark, sf_dir)), A.typealiases(spark, sf_dir), A.constants(spark, sf_dir))


@query("SELECT CASE WHEN s_nationkey = 0 THEN 'Ids' ELSE 'Alias' || s_nationkey END AS alias, 'Ids' || (max(s_suppkey) % 3) AS target FROM supplier GROUP BY s_nationkey")
def alias_last_wins(spark, sf_dir):
    return E.last_wins(A.typealiases(spark, sf_dir), "alias", "target")


OCC = """occ AS (SELECT 's:' || l_suppkey AS usr, ['class', 'struct', 'enum', 'function'][(l_orderkey % 4 + 1)::INT] AS sym_kind, CASE WHEN l_linenumber = 1 THEN 'definition' ELSE 'reference' END AS role,
 'Sources/P' || l_partkey || '.swift' AS path, l_orderkey AS ord FROM lineitem),
 project AS (SELECT 'Sources/P' || p_partkey || '.swift' AS path FROM part WHERE p_partkey % 3 <> 0)"""


@query(
    f"""WITH {OCC}, d AS (SELECT usr, arg_max(path, (ord, path)) AS src FROM occ JOIN project USING (path) WHERE role = 'definition' AND sym_kind IN ('class', 'struct', 'enum', 'protocol', 'typealias') GROUP BY usr)
SELECT DISTINCT d.src, o.path AS dst, 'DirectReference' AS kind FROM d JOIN occ o ON o.usr = d.usr AND o.role = 'reference' AND o.path <> d.src JOIN project p ON p.path = o.path"""
)
def usr_edges(spark, sf_dir):
    project = A.table(spark, sf_dir, "part").where("p_partkey % 3 != 0").select(F.concat(F.lit("Sources/P"), "p_partkey", F.lit(".swift")).alias("path"))
    return E.usr_edges(A.occurrences(spark, sf_dir), project)


@query(f"WITH {OCC} SELECT count(*) AS scanned, count(*) FILTER (role = 'definition') AS definitions, count(*) FILTER (role = 'reference') AS reference_count, count(DISTINCT usr) FILTER (role = 'definition') AS defined FROM occ")
def index_counts(spark, sf_dir):
    return facts.index_counts(A.occurrences(spark, sf_dir))


DOTD = r"""dl AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(l_partkey))) AS k, min(l_partkey) AS first FROM lineitem GROUP BY l_orderkey),
ln AS (SELECT 'O' || o || '.d' AS file, '/tmp/build/P' || first || '.o' AS output, list_transform(k, lambda x: CASE WHEN x % 9 = 0 THEN '/x/SDKs/P' || x || '.swift' WHEN x % 13 = 0 THEN 'Sources/P' || x || '.h' ELSE 'Sources/P' || x || '.swift' END) AS inputs FROM dl WHERE o % 35 <> 0)"""


@query(f"WITH {DOTD} SELECT file, output, inputs FROM ln")
def dotd_lines(spark, sf_dir):
    return facts.dependency_lines(A.dependency_files(spark, sf_dir))


@query(
    f"""WITH {DOTD}, inv AS (SELECT 'Sources/P' || p_partkey || '.swift' AS f, 'P' || p_partkey AS name FROM part UNION ALL SELECT 'Lib/P' || p_partkey || '.swift', 'P' || p_partkey FROM part WHERE p_partkey % 10 = 0),
b AS (SELECT name, min(f) AS dst FROM inv GROUP BY name), e AS (SELECT b.dst, unnest(ln.inputs) AS src FROM ln JOIN b ON b.name = regexp_extract(ln.output, '([^/]+)[.]o$', 1))
SELECT src, dst, 'DirectReference' AS kind FROM e WHERE suffix(src, '.swift') AND NOT contains(src, '/SDKs/') AND src <> dst AND src IN (SELECT f FROM inv)"""
)
def dotd_edges(spark, sf_dir):
    return facts.dependency_edges(facts.dependency_lines(A.dependency_files(spark, sf_dir)), A.dependency_inventory(spark, sf_dir))


INDEX_JSON = "SELECT o_orderkey, '{\"edges\":[{\"from\":\"Sources/P' || (o_orderkey % 50) || '.swift\",\"to\":\"' || CASE o_orderkey % 3 WHEN 0 THEN '/usr/lib' WHEN 1 THEN 'Sources' ELSE 'x/Pods' END || '/P' || (o_custkey % 70) || '.swift\"}],\"fileCount\":1,\"edgeCount\":1}' AS js FROM orders"


@query("SELECT 'Sources/P' || (o_orderkey % 50) || '.swift' AS src, 'Sources/P' || (o_custkey % 70) || '.swift' AS dst, 'DirectReference' AS kind FROM orders WHERE o_orderkey % 3 = 1")
def index_edges(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    folder = F.when(F.col("o_orderkey") % 3 == 0, "/usr/lib").when(F.col("o_orderkey") % 3 == 1, "Sources").otherwise("x/Pods")
    js = F.format_string('{"edges":[{"from":"Sources/P%d.swift","to":"%s/P%d.swift"}],"fileCount":1,"edgeCount":1}', F.col("o_orderkey") % 50, folder, F.col("o_custkey") % 70)
    pairs = o.select(F.explode(F.from_json(js, S.INDEX_FILE)["edges"]).alias("e")).select("e.from", "e.to")
    return E.edges_from_index(pairs)


@query("SELECT max(c_name) AS path FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')")
def newest_store(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    stores = c.select(F.concat("c_mktsegment", F.lit("-"), "c_custkey").alias("name"), F.col("c_name").alias("path"), F.col("c_custkey").alias("mtime"))
    return facts.newest_store(stores, "BUILDING")


_K = lambda d: f"'P' || (p_partkey + {d})"


@query(
    f"""SELECT 'Sources/P' || p_partkey || '.swift' AS file_id, 'Source' AS role, ['SwiftUI'] AS imports, list_sort([{_K(0)}, {_K(0)} || '.Key']) AS defines,
 list_sort(['A' || p_partkey, 'Key', {_K(0)}, {_K(1)}, {_K(3)}]) AS references_, [{_K(2)}, {_K(2)}] AS view_embeddings, 'a11y_' || (p_partkey % 97) AS setter, 'Ids.P' || p_size AS query_,
 {_K(0)} || '.Key.b=k' || p_size AS constant, {_K(0)} || '.Key' AS target FROM part"""
)
def extracted_facts(spark, sf_dir):
    p = extract_files(A.part_sources(spark, sf_dir))
    b = F.concat(F.regexp_extract("file_id", r"(P\d+)", 1), F.lit(".Key.b"))
    return p.select(
        "file_id", "role", "imports", "defines", F.col("references").alias("references_"), "view_embeddings", F.array_join("a11y_setters.key", ",").alias("setter"),
        F.array_join("a11y_queries.key", ",").alias("query_"), F.concat(b, F.lit("="), F.element_at("constants", b)).alias("constant"), F.array_join(F.map_values("typealiases"), ",").alias("target"),
    )


_M = "'Sources/Marks/M' || p_partkey || '.swift'"
_T = "'App/AppUITests/P' || p_partkey || 'UITests.swift'"


@query(
    f"""SELECT {_M} AS file_id, 'Source' AS role, 'Literal:set_' || p_partkey || ',Symbolic:Ids.k' || p_size AS setters, 'Literal:q_' || p_partkey AS queries_, '' AS methods FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT {_T}, 'UITest', '', 'Literal:set_' || (p_partkey + 3), 'testSet(Literal:a11y_' || (p_partkey % 97) || ',Symbolic:Ids.k' || p_size || ')Page' || p_size || ';testOther()Page' || (p_partkey % 7) FROM part WHERE p_partkey % 4 = 0"""
)
def extracted_identifiers(spark, sf_dir):
    """Identifiers that are assigned, looked up by accessors, and looked up by test methods."""
    p = extract_files(A.marks_and_tests(spark, sf_dir))
    shown = lambda ids: F.array_join(F.transform(ids, lambda i: F.concat(i["id_kind"], F.lit(":"), i["key"])), ",")
    method = lambda m: F.concat(m["name"], F.lit("("), shown(m["a11y_queries"]), F.lit(")"), F.array_join(m["referenced_types"], ","))
    return p.select("file_id", "role", shown(F.col("a11y_setters")).alias("setters"), shown(F.col("a11y_queries")).alias("queries_"), F.array_join(F.transform("test_methods", method), ";").alias("methods"))


_P = lambda d: f"'Sources/P' || (p_partkey + {d}) || '.swift'"
PROJECT = f"""WITH own AS (SELECT p_partkey FROM part),
s AS (SELECT {_P(0)} AS f, 'a11y_' || (p_partkey % 97) AS k FROM part UNION ALL SELECT {_M}, 'set_' || p_partkey FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT {_M}, 'Ids.k' || p_size FROM part WHERE p_partkey % 3 = 0),
q AS (SELECT {_T} AS f, 'a11y_' || (p_partkey % 97) AS k FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT {_T}, 'Ids.k' || p_size FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT {_T}, 'set_' || (p_partkey + 3) FROM part WHERE p_partkey % 4 = 0)
SELECT {_P(1)} AS src, {_P(0)} AS dst, 'DirectReference' AS kind FROM part WHERE p_partkey + 1 IN (FROM own) UNION ALL SELECT {_P(3)}, {_P(0)}, 'DirectReference' FROM part WHERE p_partkey + 3 IN (FROM own)
UNION ALL SELECT {_P(2)}, {_P(0)}, 'ViewEmbedding' FROM part, range(2) WHERE p_partkey + 2 IN (FROM own)
UNION ALL SELECT DISTINCT s.f, q.f, 'AccessibilityBinding' FROM s JOIN q ON s.k = q.k"""


@query(PROJECT)
def index_full(spark, sf_dir):
    """A project from its texts: parsing, all edge joins, known endpoints."""
    return N.index_sources(A.project_sources(spark, sf_dir))[1]


@query(PROJECT)
def index_incremental(spark, sf_dir):
    """The same project from the facts of an older state, of which only changed files are parsed: the edges are those of the full index."""
    files, before = A.project_sources(spark, sf_dir), A.project_before(spark, sf_dir)
    stored = saved(extract_files(before))  # as an index run leaves them
    inventory = files.select("file_id", F.sha1("content").alias("blob_sha"))
    return N.graph_of_parsed(N.update_parsed(stored, files, inventory, before.select("file_id", F.sha1("content").alias("content_hash"))), inventory)[1]


# --- inventories and changes -----------------------------------------------------------------------------------

INVENTORY = f"""ev AS (SELECT 'Src/U' || user_id || '.swift' AS file_id, ts, event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE md5(props) END AS sha FROM events),
now_ AS (SELECT file_id, sha AS blob_sha FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_id % 7 <> 0),
then_ AS (SELECT file_id, sha AS content_hash FROM ev WHERE ts < TIMESTAMP '{A.CUTOFF}' AND NOT suffix(file_id, '3.swift') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query(f"WITH {INVENTORY} SELECT n.file_id FROM now_ n LEFT JOIN then_ t USING (file_id) WHERE t.file_id IS NULL OR n.blob_sha IS DISTINCT FROM t.content_hash")
def changed_files(spark, sf_dir):
    return G.changed_files(*A.inventories(spark, sf_dir))


@query(f"WITH {INVENTORY} SELECT file_id FROM then_ WHERE file_id NOT IN (SELECT file_id FROM now_)")
def deleted_files(spark, sf_dir):
    return G.deleted_files(*A.inventories(spark, sf_dir))


@query(f"WITH {INVENTORY} SELECT file_id FROM now_ WHERE file_id NOT IN (SELECT file_id FROM then_)")
def new_files(spark, sf_dir):
    return G.new_files(*A.inventories(spark, sf_dir))


@query(f"WITH {INVENTORY} SELECT t.file_id, n.blob_sha AS content_hash FROM then_ t LEFT JOIN now_ n USING (file_id)")
def attach_hashes(spark, sf_dir):
    now, then = A.inventories(spark, sf_dir)
    return G.attach_hashes(then, now)


@query(
    f"""WITH d AS (SELECT ['Src', 'Pods', 'x/Pods', 'a/.build'][(event_id % 4 + 1)::INT] AS fo, user_id, event_id, CASE WHEN event_id % 6 = 0 THEN '.md' ELSE '.swift' END AS e FROM events),
p AS (SELECT CASE WHEN event_id % 5 <> 0 THEN fo || '/U' || user_id || e END AS p FROM d UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN fo || '/V' || user_id || e WHEN event_id % 7 <> 0 THEN fo || '/U' || user_id || e END FROM d)
SELECT DISTINCT p AS file_id FROM p WHERE suffix(p, '.swift') AND NOT ({_SKIP(S.SKIPPED_TRACKED)})"""
)
def diff_paths(spark, sf_dir):
    return facts.changed_paths(A.deltas(spark, sf_dir))


@query("SELECT DISTINCT 'Src/U' || user_id || '.swift' AS file_id FROM events WHERE event_id % 2 = 0")
def github_files(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    end = F.when(F.col("event_id") % 2 == 0, ".swift").otherwise(".md")
    js = F.concat(F.lit('{"files":[{"filename":"Src/U'), "user_id", end, F.lit('","status":"modified"},{"status":"x"}]}'))
    return facts.paths_of_review(e.select(js.alias("json")))


# --- graph maintenance -----------------------------------------------------------------------------------------

GRAPH = f"WITH {FILES}, {ROLES}, {EDGES}, {CHANGED}"


@query(f"{GRAPH} SELECT (SELECT count(*) FROM files) AS file_count, (SELECT count(*) FROM edges) AS edge_count, ['indexstore', 'dot-d'] AS data_sources_used")
def graph_summary(spark, sf_dir):
    nodes, edges, _ = _light(spark, sf_dir)
    return G.metadata(nodes, edges, "/repo", ["indexstore", "dot-d", "indexstore"]).select("file_count", "edge_count", "data_sources_used")


@query(f"{GRAPH} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(spark, sf_dir):
    return A.part_edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{GRAPH}, one AS (SELECT file_id FROM files WHERE p_partkey = 1) SELECT 'dependent' AS direction, dst AS file_id, kind FROM edges WHERE src IN (SELECT file_id FROM one) UNION ALL SELECT 'dependency', src, kind FROM edges WHERE dst IN (SELECT file_id FROM one)")
def neighbors(spark, sf_dir):
    one = A.part_files(spark, sf_dir).where("p_partkey = 1").first()["file_id"]
    return G.neighbours(A.part_edges(spark, sf_dir), one)


@query(f"{GRAPH} SELECT * FROM edges WHERE src NOT IN (SELECT file_id FROM changed)")
def remove_outgoing(spark, sf_dir):
    _, edges, changed = _light(spark, sf_dir)
    return G.remove_outgoing(edges, changed)


@query(f"{GRAPH} SELECT * FROM edges WHERE src NOT IN (SELECT file_id FROM changed) AND dst NOT IN (SELECT file_id FROM changed)")
def remove_nodes(spark, sf_dir):
    return G.remove_files(*_light(spark, sf_dir))[1]


@query(f"{GRAPH} SELECT * FROM edges WHERE kind <> 'ViewEmbedding'")
def remove_by_kind(spark, sf_dir):
    return G.remove_kind(A.part_edges(spark, sf_dir), S.VIEW)


@query(f"{GRAPH} SELECT * FROM edges WHERE src IN (SELECT file_id FROM roles WHERE role = 'Source') AND dst IN (SELECT file_id FROM roles WHERE role = 'Source')")
def known_endpoints(spark, sf_dir):
    nodes, edges, _ = _light(spark, sf_dir)
    return E.known_endpoints(edges, nodes.where("role = 'Source'"))


@query(f"{GRAPH} SELECT * FROM edges WHERE src NOT IN (SELECT file_id FROM changed) UNION ALL SELECT x.file_id, y.file_id, 'DirectReference' FROM changed JOIN files x USING (file_id) JOIN files y ON y.p_partkey BETWEEN x.p_partkey + 1 AND x.p_partkey + 20")
def incremental_update(spark, sf_dir):
    nodes, edges, changed = _light(spark, sf_dir)
    files = A.part_files(spark, sf_dir)
    near = files.join(changed, "file_id", "left_semi").select(F.col("file_id").alias("src"), F.explode(F.sequence(F.col("p_partkey") + 1, F.col("p_partkey") + 20)).alias("p_partkey"))
    new = near.join(files, "p_partkey").select("src", F.col("file_id").alias("dst")).unionByName(changed.select(F.col("file_id").alias("src"), F.lit("Gone.swift").alias("dst")))
    new = new.withColumn("kind", F.lit(S.DIRECT))
    return G.update_incremental(nodes, edges, nodes.join(changed, "file_id", "left_semi"), new)[1]


@query(
    f"{GRAPH} SELECT file_id, role, CASE WHEN file_id IN (SELECT file_id FROM changed) THEN 'New' ELSE module END AS module FROM roles UNION ALL SELECT file_id || '.new', 'Source', 'New' FROM changed"
)
def upsert_nodes(spark, sf_dir):
    nodes, _, changed = _light(spark, sf_dir)
    new = changed.select("file_id", F.lit("UITest").alias("role"), F.lit("New").alias("module"))
    return G.upsert_nodes(nodes, new.unionByName(changed.select(F.concat("file_id", F.lit(".new")).alias("file_id"), F.lit("Source").alias("role"), F.lit("New").alias("module"))))


@query(f"{GRAPH} SELECT * FROM edges WHERE kind = 'DirectReference' UNION ALL SELECT dst, src, kind FROM edges WHERE kind <> 'DirectReference'")
def supplement(spark, sf_dir):
    nodes, edges, _ = _light(spark, sf_dir)
    parsed = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")
    return G.supplement(nodes, edges, nodes, parsed, ["indexstore"])[1]


@query(f"{GRAPH}, {METHODS}, m AS (SELECT file_id, count(DISTINCT n) AS n FROM methods GROUP BY file_id) SELECT r.file_id, CASE WHEN role = 'Source' THEN 'n' || r.file_id ELSE '' END AS setter, 0::INT AS n_queries, coalesce(m.n, 0)::INT AS n_methods FROM roles r LEFT JOIN m USING (file_id)")
def patched_identifiers(spark, sf_dir):
    """A symbol-index graph takes the parser's identifiers where the parser knows the file; other files keep theirs."""
    nodes, edges, _ = _graph(spark, sf_dir)
    own = F.array(F.struct(F.lit("Literal").alias("id_kind"), F.concat(F.lit("n"), "file_id").alias("key")))
    parsed = nodes.where("role = 'Source'").withColumn("a11y_setters", own).withColumn("a11y_queries", F.expr(N.EMPTY_IDENTIFIERS))
    out = G.supplement(nodes, edges, parsed, edges, ["indexstore"])[0]
    return out.select("file_id", F.array_join("a11y_setters.key", ",").alias("setter"), F.size("a11y_queries").alias("n_queries"), F.size("test_methods").alias("n_methods"))


@query(f"WITH {FILES}, {ROLES} SELECT file_id, CASE WHEN p_partkey % 3 = 0 THEN 'UITest' ELSE role END AS role FROM roles")
def built_nodes(spark, sf_dir):
    """Of a file's nodes the first counts."""
    files = A.part_files(spark, sf_dir)
    node = lambda df, role, at: df.select("file_id", role.alias("role"), F.lit(at).alias("file_ordinal"))
    nodes = node(files, P.role_of_path(F.col("file_id")), 1).unionByName(node(files.where("p_partkey % 3 = 0"), F.lit("UITest"), 0)).unionByName(node(files.where("p_partkey % 5 = 0"), F.lit("none"), 2))
    return G.build_graph(nodes, A.part_edges(spark, sf_dir))[0]


@query(
    f"""WITH {FILES}, {DOTD}, inv AS (SELECT 'Sources/P' || p_partkey || '.swift' AS f, 'P' || p_partkey AS name FROM part UNION ALL SELECT 'Lib/P' || p_partkey || '.swift', 'P' || p_partkey FROM part WHERE p_partkey % 10 = 0),
b AS (SELECT name, min(f) AS dst FROM inv GROUP BY name), e AS (SELECT b.dst, unnest(ln.inputs) AS src FROM ln JOIN b ON b.name = regexp_extract(ln.output, '([^/]+)[.]o$', 1)),
d AS (SELECT src, dst FROM e WHERE suffix(src, '.swift') AND NOT contains(src, '/SDKs/') AND src <> dst AND src IN (SELECT f FROM inv)),
every AS (SELECT file_id FROM files UNION SELECT src FROM d UNION SELECT dst FROM d) SELECT file_id, {ROLE} AS role FROM every"""
)
def makefile_nodes(spark, sf_dir):
    """Ends of makefile edges that the graph doesn't know become nodes; the rest stay."""
    nodes = N.nodes_of_paths(A.part_files(spark, sf_dir))
    edges = facts.dependency_edges(facts.dependency_lines(A.dependency_files(spark, sf_dir)), A.dependency_inventory(spark, sf_dir))
    return G.add_missing_nodes(nodes, N.nodes_of_paths(edges.select(F.explode(F.array("src", "dst")).alias("file_id")))).select("file_id", "role")


@query(f"{GRAPH} SELECT src, dst, kind FROM edges")
def stored_graph(spark, sf_dir):
    """A graph that is saved and loaded again."""
    nodes, edges, _ = _light(spark, sf_dir)
    folder = f"{shared_folder(spark)}/stored_{uuid.uuid4().hex}"
    facts.save_graph(nodes, edges, G.metadata(nodes, edges, "/repo", ["tree-sitter"]), folder)
    out = durable(facts.load_graph(spark, folder)[1].select("src", "dst", "kind"))
    facts.remove(spark, folder)
    return out


# --- reachability ----------------------------------------------------------------------------------------------


def _tests(spark, sf_dir, kinds):
    nodes, edges, changed = _light(spark, sf_dir)
    return R.affected_tests(nodes, R.reached_states(nodes, edges, changed, kinds)).where(F.col("kind").isin(*(kinds or S.KINDS)))


@query(f"{_reach('Unit')}, {TESTS} SELECT * FROM tests WHERE kind = 'Unit'")
def resolve_unit(spark, sf_dir):
    return _tests(spark, sf_dir, ["Unit"])


@query(f"{_reach('Snapshot')}, {TESTS} SELECT * FROM tests WHERE kind = 'Snapshot'")
def resolve_snapshot(spark, sf_dir):
    return _tests(spark, sf_dir, ["Snapshot"])


@query(f"{RESULT} SELECT * FROM result WHERE kind = 'UITest'")
def resolve_ui(spark, sf_dir):
    return R.resolve(*_graph(spark, sf_dir), ["UITest"])


@query(f"{RESULT} SELECT * FROM result")
def resolve_all(spark, sf_dir):
    return R.resolve(*_graph(spark, sf_dir))


@query(f"{_reach('all')} SELECT file_id, depth::INT AS depth, down FROM states")
def reached_states(spark, sf_dir):
    return R.reached_states(*_light(spark, sf_dir))


@query(f"{_reach('all')} SELECT count(DISTINCT file_id) AS files_visited FROM states")
def files_visited(spark, sf_dir):
    return R.reached_states(*_light(spark, sf_dir)).agg(F.countDistinct("file_id").alias("files_visited"))


@query(f"{_reach('all')}, {TESTS} SELECT kind, count(*) AS n FROM tests GROUP BY kind UNION ALL SELECT 'total', count(*) FROM tests")
def tests_by_kind(spark, sf_dir):
    return K.counts_by_kind(_tests(spark, sf_dir, None))


@query(f"{_reach('all')}, {SETTERS}, {PAGES}, {IMPACTED} SELECT key FROM impacted")
def impacted_keys(spark, sf_dir):
    nodes, edges, changed = _graph(spark, sf_dir)
    return R.impacted_keys(nodes, R.reached_states(nodes, edges, changed))


@query(f"{RESULT} SELECT file_id, methods FROM hits")
def ui_methods(spark, sf_dir):
    return R.resolve(*_graph(spark, sf_dir), ["UITest"]).where("methods is not null").select("file_id", "methods")


@query(f"{_reach('Unit')}, {TESTS} SELECT file_id FROM roles WHERE role = 'UnitTest' AND p_partkey % 4 = 0 AND file_id NOT IN (SELECT file_id FROM tests WHERE kind = 'Unit')")
def missed_tests(spark, sf_dir):
    """Failed tests that the selection left out."""
    files = A.part_files(spark, sf_dir)
    failed = files.where((P.role_of_path(F.col("file_id")) == "UnitTest") & (F.col("p_partkey") % 4 == 0))
    return N.verify_selection(_tests(spark, sf_dir, ["Unit"]), failed)


# --- cycles ----------------------------------------------------------------------------------------------------

CLOSURE = f"""{GRAPH.replace("WITH", "WITH RECURSIVE")}, one AS (SELECT DISTINCT src, dst FROM edges),
tc AS (SELECT src AS a, dst AS b FROM one UNION SELECT tc.a, t.dst FROM tc JOIN one t ON t.src = tc.b),
mutual AS (SELECT x.a, x.b FROM tc x JOIN tc y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
scc AS (SELECT a AS file_id, least(a, min(b)) AS scc FROM mutual GROUP BY a),
report AS (SELECT scc, count(*) AS size, list(file_id ORDER BY file_id) AS files FROM scc GROUP BY scc)"""


@query(f"{CLOSURE} SELECT scc, size, files FROM report")
def cycles(spark, sf_dir):
    return C.cycle_report(A.part_edges(spark, sf_dir)).select("scc", "size", "files")


@query(
    f"""{CLOSURE} SELECT scc, files[1:10] AS shown_files, greatest(size - 10, 0) AS more, CASE WHEN size > 10 THEN '{S.CYCLE_WARNING[0]}' || size || '{S.CYCLE_WARNING[1]}' || array_to_string(files[1:5], ' -> ') || '{S.CYCLE_WARNING[2]}' END AS warning FROM report"""
)
def cycle_warnings(spark, sf_dir):
    return C.cycle_report(A.part_edges(spark, sf_dir)).select("scc", "shown_files", "more", "warning")


# --- formats ---------------------------------------------------------------------------------------------------

CLASS = STEM


@query(f"{RESULT} SELECT concat_ws('/', target, {CLASS}, m) AS line FROM (SELECT *, unnest(coalesce(methods, [NULL])) AS m FROM result)")
def format_list(spark, sf_dir):
    return K.list_lines(R.resolve(*_graph(spark, sf_dir))).select("line")


@query(f"""{RESULT} SELECT CASE kind WHEN 'Unit' THEN 0 WHEN 'Snapshot' THEN 1 ELSE 2 END AS rank, file_id, i AS pos, concat_ws('/', target, {CLASS}, ms[i + 1]) AS line
 FROM (SELECT *, coalesce(methods, [NULL]) AS ms, unnest(range(len(coalesce(methods, [NULL])))) AS i FROM result)""")
def report_order(spark, sf_dir):
    """What orders the lines of a report: kind, file, declaration of the method."""
    return K.list_lines(R.resolve(*_graph(spark, sf_dir)))


@query(f"{RESULT} SELECT '-only-testing:' || concat_ws('/', target, {CLASS}, m) AS flag FROM (SELECT *, unnest(coalesce(methods, [NULL])) AS m FROM result WHERE target IS NOT NULL)")
def format_xcodebuild(spark, sf_dir):
    return K.xcodebuild_flags(R.resolve(*_graph(spark, sf_dir))).select("flag")


@query(
    f"""{RESULT} SELECT lower(kind) AS kind, '[' || string_agg('{{"file":"' || file_id || '","target":' || CASE WHEN target IS NULL THEN 'null' ELSE '"' || target || '"' END
 || CASE WHEN methods IS NULL THEN '' ELSE ',"methods":["' || array_to_string(methods, '","') || '"]' END || '}}', ',' ORDER BY file_id) || ']' AS files FROM result GROUP BY kind"""
)
def format_json(spark, sf_dir):
    return K.json_files(R.resolve(*_graph(spark, sf_dir)))


@query(f"{GRAPH} SELECT '\"' || src || '\" -> \"' || dst || '\" [label=\"' || kind || '\"];' AS line FROM edges")
def dot_export(spark, sf_dir):
    return K.dot_lines(A.part_edges(spark, sf_dir))


@query()
def first_visit_states(spark, sf_dir):
    """Order-dependent by definition, so it has no SQL; tests hold it against the fixtures."""
    nodes, edges, changed = _light(spark, sf_dir)
    ordered = edges.withColumn("ordinal", F.xxhash64("src", "dst", "kind"))
    return R.first_visit(nodes, ordered, changed)
