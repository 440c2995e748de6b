"""Paths, fact readers, extraction, edge joins and graph upkeep."""

import pytest
from pyspark.sql import functions as F

from rippletrace.functions import paths as P
from rippletrace.functions import symbols as Y
from rippletrace.operators import edges as E
from rippletrace.operators import graph as G
from rippletrace.plans import adapters
from rippletrace.plans import engine as N
from rippletrace.plans import schema as S
from rippletrace.plans.fact_sources import MakefileSource, ParsedSource, SymbolIndexSource
from rippletrace.sources import facts, swift, symbol_store
from rippletrace.sources.swift import parse, role_of
from rippletrace.streaming import changes

D, V, A = S.DIRECT, S.VIEW, S.A11Y

ROLES = {
    "Sources/CartService.swift": "Source",
    "Tests/CartServiceTests.swift": "UnitTest",
    "Tests/SnapshotTests/ProfileScreenSnapshotTests.swift": "SnapshotTest",
    "UITests/CheckoutUITests.swift": "UITest",
    "Sources/Latest.swift": "UnitTest",
    "Sources/GuiTester.swift": "UITest",
    "Tests/Mocks/CartSpy.swift": "UnitTest",
    "Sources/Contest.data.swift": "Source",
    "LoginTest.swift": "UnitTest",
    ".swift": "Source",
}
MODULES = {
    "App/AppUITests/Tests/More/SomeUITests.swift": "AppUITests",
    "Packages/Networking/Tests/NetworkingTests/APIClientTests.swift": "NetworkingTests",
    "Tests/FooTests/BarTest.swift": "FooTests",
    "App/AppE2ETests/Tests/OnboardingE2ETests.swift": "AppE2ETests",
    "Sources/CartService.swift": None,
    "Tests/Foo/BarTest.swift": "Foo",
    "Tests/BarTest.swift": None,
    "x/tests/Tests/Foo/a/B.swift": "Foo",
}


def test_roles_and_modules(spark):
    df = spark.createDataFrame([(p,) for p in {*ROLES, *MODULES}], "p string").select("p", P.role_of_path(F.col("p")).alias("r"), P.module_of(F.col("p")).alias("m"), P.is_test_class(F.col("p")).alias("t"))
    got = {r.p: r for r in df.collect()}
    assert {p: got[p].r for p in ROLES} == ROLES
    assert {p: got[p].m for p in MODULES} == MODULES
    assert all(got[p].r == role_of(p, []) for p in got)
    assert not got["Sources/Latest.swift"].t and got["Tests/Foo/BarTest.swift"].t
    one = spark.createDataFrame([("Tests/SomeTests.swift", ["SnapshotTesting"]), ("UITests/A.swift", None)], "p string, i array<string>")
    assert [r[0] for r in one.select(P.role_of(F.col("p"), F.col("i"))).collect()] == ["SnapshotTest", "UITest"]


def test_root_folders_are_kept(spark):
    df = spark.createDataFrame([("Pods/x.swift",), ("a/Pods/x.swift",)], "p string")
    assert [r[0] for r in df.select(P.is_skipped_tracked(F.col("p"))).collect()] == [False, True]


def test_symbols(spark):
    df = spark.createDataFrame([("T",), ("String",), ("Foo",), ("é",)], "n string")
    assert [r[0] for r in df.select(Y.is_builtin(F.col("n"))).collect()] == [True, True, False, False]


def edges_of(spark, text):
    return spark.createDataFrame([(x[0], x[2], {"D": D, "V": V, "A": A}[x[1]]) for x in text.split()], "src string, dst string, kind string")


def ids(spark, text):
    return spark.createDataFrame([(x,) for x in text], "file_id string")


def test_repeated_edges_by_groups(spark):
    """Groups of files that define the same symbols, files that use them, own uses, built-in names, a null file."""
    refs = [(f"R{k}", x) for k in range(40) for x in ("Aa", "Bb", "Cc", "String", "Dd") if (k + len(x) * ord(x[0])) % 3] + [("D1", "Aa"), ("D1", "Bb"), (None, "Aa"), (None, "Bb")]
    defs = [(f"D{k}", x) for k in range(9) for x in (("Aa", "Bb"), ("Bb", "Cc", "String"), ("Dd", "Aa", "Cc"))[k % 3]] + [("D20", "Zz"), ("D20", "Aa")]
    r, d = spark.createDataFrame(refs, "file_id string, symbol string"), spark.createDataFrame(defs, "file_id string, symbol string")
    want = E.symbol_edges(r, d).groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")
    got = [tuple(x) for x in E.repeated_edges(r, d).collect()]
    assert sorted(got) == sorted(tuple(x) for x in want.collect()) and {n for _, _, n in got} == {2, 3}


@pytest.mark.parametrize(
    "start,action,want",
    [
        ("ADB AAC BDD CAD DAE BDE", lambda s, e: G.remove_kind(e, A), "ADB BDD BDE"),
        ("ADB BDC CDD", lambda s, e: G.remove_files(ids(s, "ABCD"), e, ids(s, "B"))[1], "CDD"),
        ("ADB ADC ADD BDD", lambda s, e: G.remove_outgoing(e, ids(s, "A")), "BDD"),
        ("ADB ADC BDC", lambda s, e: G.update_incremental(ids(s, "ABC"), e, ids(s, "A"), edges_of(s, "ADB ADC ADZ"))[1], "ADB ADC BDC"),
        ("ADB ADC BDC", lambda s, e: G.update_incremental(ids(s, "ABC"), e, ids(s, "A"), edges_of(s, "ADB").limit(0))[1], "BDC"),
    ],
)
def test_upkeep(spark, start, action, want):
    got = sorted(f"{r.src}{r.kind[0]}{r.dst}" for r in action(spark, edges_of(spark, start)).collect())
    assert got == want.split()


def test_build_keeps_the_first_node_and_parallel_edges(spark):
    nodes = spark.createDataFrame([("A", "x", 1), ("A", "y", 0), ("B", "z", 2)], "file_id string, role string, file_ordinal int")
    n, e = G.build_graph(nodes, edges_of(spark, "ADB ADB ADC"))
    assert {(r.file_id, r.role) for r in n.collect()} == {("A", "y"), ("B", "z")} and e.count() == 2
    assert G.metadata(n, e, "/r", ["a", "b", "a"]).first()[3:] == (2, ["a", "b"])


def test_change_detection(spark):
    inv = spark.createDataFrame([("same", "1"), ("none", None), ("diff", "2"), ("new", None)], "file_id string, blob_sha string")
    old = spark.createDataFrame([("same", "1"), ("none", None), ("diff", "1"), ("gone", "3")], "file_id string, content_hash string")
    names = lambda df: sorted(r.file_id for r in df.collect())
    assert names(G.changed_files(inv, old)) == ["diff", "new"] and names(G.deleted_files(inv, old)) == ["gone"] and names(G.new_files(inv, old)) == ["new"]


def test_supplement_is_idempotent_and_bound_to_the_index(spark):
    schema = "file_id string, a11y_setters array<string>"
    nodes, parsed = spark.createDataFrame([("A", []), ("B", [])], schema), spark.createDataFrame([("A", ["k"]), ("Z", ["q"])], schema)
    e, p = edges_of(spark, "ADB AVB"), edges_of(spark, "BVA BAA ADA ZVA")
    n1, e1 = G.supplement(nodes, e, parsed, p, ["indexstore"])
    n2, e2 = G.supplement(n1, e1, parsed, p, ["indexstore"])
    show = lambda df: sorted(map(str, df.collect()))
    assert show(e1) == show(e2) == show(edges_of(spark, "ADB BVA BAA")) and show(n1) == show(n2)
    assert G.supplement(nodes, e, parsed, p, ["tree-sitter"])[1] is e


def test_canonical_keys(spark):
    i = spark.createDataFrame([("Literal", "Ids.a"), ("Symbolic", "Ids.a"), ("Symbolic", "X.a"), ("Symbolic", "Z.q")], "id_kind string, key string")
    al = spark.createDataFrame([("X", "Old", 1), ("X", "Ids", 2)], "alias string, target string, file_ordinal int")
    co = spark.createDataFrame([("Ids.a", "lit", 1)], "path string, literal string, file_ordinal int")
    got = {(r.id_kind, r.key): sorted(r["keys"]) for r in E.canonical_keys(i, al, co).collect()}
    assert got == {("Literal", "Ids.a"): ["Ids.a"], ("Symbolic", "Ids.a"): ["Ids.a", "lit"], ("Symbolic", "X.a"): ["Ids.a", "X.a", "lit"], ("Symbolic", "Z.q"): ["Z.q"]}


def test_dependency_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.d").write_text("# c\n\n/b/Foo.o : Sources/Foo.swift \\\n  Sources/Bar.swift /repo/Lib/In.swift /x/SDKs/S.swift Sources/Gone.swift a.h\nsecond : no\n")
    (tmp_path / "y.d").write_text("nothing: here\n")
    lines = facts.dependency_lines(facts.dependency_files(spark, str(tmp_path)))
    inv = ids(spark, ["Sources/Foo.swift", "Sources/Bar.swift"])
    assert {(r.src, r.dst) for r in facts.dependency_edges(lines, inv, "/repo").collect()} == {("Sources/Bar.swift", "Sources/Foo.swift"), ("Lib/In.swift", "Sources/Foo.swift")}
    assert lines.count() == 1


def test_symbol_index(spark, tmp_path):
    path = tmp_path / "i.json"
    path.write_text('{"edges":[{"from":"A.swift","to":"B.swift"},{"from":"/usr/x.swift","to":"B.swift"}],"fileCount":2,"edgeCount":2}')
    nodes, edges = N.index_symbol_store(facts.index_pairs(spark, str(path)), spark.createDataFrame([("A.swift", "1")], "file_id string, blob_sha string"))
    assert {(r.file_id, r.content_hash) for r in nodes.collect()} == {("A.swift", "1"), ("B.swift", None)} and edges.count() == 1
    assert facts.parse_index_output('{"edges": []} trailing')["edges"] == []


def test_store(spark, tmp_path):
    nodes, edges = N.nodes_of_paths(ids(spark, ["Tests/Foo/ATests.swift", "B.swift"])), edges_of(spark, "ADB AVB")
    assert facts.load_graph(spark, str(tmp_path)) is None
    for name in ("tree-sitter", "indexstore"):
        facts.save_graph(nodes.withColumn("module", F.lit(None).cast("string")), edges, G.metadata(nodes, edges, "/r", [name]), str(tmp_path))
    n, e, m = facts.load_graph(spark, str(tmp_path))
    assert m.first()["data_sources_used"] == ["indexstore"] and {r.module for r in n.collect()} == {"Foo", None} and e.count() == 2
    assert facts.load_parsed(spark, str(tmp_path)) is None
    # A graph may be saved to the store that it is read from; a version without metadata isn't whole.
    facts.save_graph(n, e.unionByName(e), m, str(tmp_path))
    assert facts.load_graph(spark, str(tmp_path))[1].count() == 4 and len(list((tmp_path / "graph-indexstore").iterdir())) == 1
    nodes.write.parquet(str(tmp_path / "graph-indexstore/v=99999999999999999999/nodes"))
    assert facts.load_graph(spark, str(tmp_path))[1].count() == 4


def test_newest_store(spark):
    df = spark.createDataFrame([("App-1", "/a", 1), ("App-2", "/b", 5), ("Application-3", "/c", 9)], "name string, path string, mtime long")
    assert facts.newest_store(df, "App").first()[0] == "/b" and facts.newest_store(df, "None").count() == 0


SOURCES = [
    ("A.swift", 'struct Child: View { var body: some View { Text("x").accessibilityIdentifier("pay") } }'),
    ("B.swift", "struct Screen: View { var body: some View { VStack { Child() \n Child() } } }\nlet q: Child? = nil"),
    ("App/AppUITests/PayUITests.swift", 'class PayUITests: XCTestCase { func testPay() { app.buttons["pay"].tap() }\n func testNo() { app.cells["no"].tap() } }'),
]


def test_index_from_sources(spark):
    nodes, edges = N.index_sources(spark.createDataFrame(SOURCES, "file_id string, content string"))
    got = sorted((r.src, r.kind, r.dst) for r in edges.collect())
    assert got == [("A.swift", A, "App/AppUITests/PayUITests.swift"), ("A.swift", D, "B.swift"), ("A.swift", V, "B.swift"), ("A.swift", V, "B.swift")]
    out = N.affected(nodes, edges, ids(spark, ["A.swift"])).collect()
    assert [(r.kind, r.target, r.methods) for r in out] == [("UITest", "AppUITests", ["testPay"])]
    assert N.inspect(nodes, edges, "A.swift")[1].count() == 4


def test_each_text_is_parsed_once_by_many_tasks(spark, tmp_path):
    """A file notes the rows that reach the parser, over all readers of its facts."""
    noted = str(tmp_path / "noted")

    def note(batches):
        for b in batches:
            with open(noted, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    files = spark.createDataFrame(SOURCES, "file_id string, content string")
    N.index_sources(files.mapInArrow(note, files.schema))[1].collect()
    with open(noted) as f:
        assert len(f.read()) == len(SOURCES)
    assert adapters.project_sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_incremental_facts_equal_a_full_index(spark):
    facts_ = lambda rows: {"symbol_defs": spark.createDataFrame(rows, "file_id string, symbol string")}
    inv = lambda rows: spark.createDataFrame(rows, "file_id string, blob_sha string")
    old, new = [("A", "a1"), ("B", "b"), ("C", "c")], [("A", "a2"), ("B", "b"), ("D", "d")]
    got = N.index_incremental(facts_(old), inv([("A", "1"), ("B", "1"), ("D", "1")]), inv([("A", "0"), ("B", "1"), ("C", "1")]), facts_(new))
    assert sorted(map(tuple, got["symbol_defs"].collect())) == sorted(new)


def test_extraction():
    p = parse(
        "B.swift",
        """import SwiftUI
class Foo<T: Bar>: Base { // class Ghost {}
  enum Keys: String { case a, b = "bee"; enum Deep: String { case z } }
  func go(_ p: Param, q: Int = 1) -> Ret? { let v = y as? Cast; view.accessibilityIdentifier = Ids.login.rawValue
    Text("x").accessibilityIdentifier("pay_\\(n)"); Text("x").accessibilityIdentifier("ok"); element(Keys.a.id); Plain() }
}
extension Foo.Keys { struct Inner {} }
typealias Al = Ids.Sub
/* nested /* still */ class No {} */
let s = \"\"\"
class Not {}
\"\"\"
""",
    )
    assert p["defines"] == ["Foo", "Foo.Keys", "Inner", "Keys.Deep"]
    assert {"Bar", "Base", "Param", "Ret", "Cast", "Foo", "Sub"} <= set(p["references"]) and not {"Plain", "Ghost", "No", "Not", "Int"} & set(p["references"])
    assert p["a11y_setters"] == [{"id_kind": "Symbolic", "key": "Ids.login"}, {"id_kind": "Literal", "key": "ok"}]
    assert p["a11y_queries"] == [{"id_kind": "Symbolic", "key": "Keys.a"}]
    assert p["constants"] == {"Foo.Keys.a": "a", "Foo.Keys.b": "bee", "Foo.Keys.Deep.z": "z"} and p["typealiases"] == {"Al": "Ids.Sub"}
    assert p["imports"] == ["SwiftUI"] and p["role"] == "Source"
    view = parse("V.swift", 'struct MyView: View { var body: some View { ChildView(name: "test") \n OtherView() } }')
    assert view["view_embeddings"] == ["ChildView", "OtherView"]
    assert parse("F.swift", "class Foo { }")["defines"] == ["Foo"] and parse("E.swift", "")["defines"] == []


def test_stream_of_changes(spark, tmp_path):
    schema = "file_id string, ts long, blob_sha string, deleted boolean"
    spark.createDataFrame([("A", 1, "a", False), ("B", 1, "b", False), ("A", 2, "a2", False), ("B", 3, None, True), ("A", 2, "a1", False), ("C", 4, None, True), ("C", 4, "c", False)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    changes.maintain_inventory(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()] == [("A", "a2")]


def test_command_line(spark, tmp_path, monkeypatch):
    import subprocess

    from rippletrace.__main__ import main

    root = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    for name, text in SOURCES:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-qm", "one")
    at = ["--repo-root", str(root), "--store", str(tmp_path / "store")]
    assert main([*at, "index"], spark) == "Files: 3\nEdges: 4\nSources: tree-sitter"
    assert main([*at, "resolve", "--base", "main"], spark) == ""
    (root / "A.swift").write_text(SOURCES[0][1] + "\n// changed")
    assert main([*at, "resolve", "--base", "main"], spark) == "AppUITests/PayUITests/testPay"
    assert main([*at, "resolve", "--base", "main", "--kind", "ui", "--format", "xcodebuild"], spark) == "-only-testing:AppUITests/PayUITests/testPay"
    assert "Dependents: 4" in main([*at, "graph", "--file", "A.swift"], spark) and main([*at, "graph", "--cycles"], spark) == "No dependency cycles detected."
    (tmp_path / "failed").write_text("App/AppUITests/PayUITests.swift\nOther.swift\n")
    assert main([*at, "verify", "--base", "main", "--failed", str(tmp_path / "failed")], spark) == "Failed but not selected:\nOther.swift"
    assert main([*at, "graph", "--dot", str(tmp_path / "dot")], spark) == ""
    dot = [r.value for r in spark.read.text(str(tmp_path / "dot")).collect()]
    assert dot[0] == "digraph dependencies {" and dot[-1] == "}" and len(dot) == 6
    git("commit", "-qam", "two")
    assert main([*at, "index"], spark).startswith("Files: 3") and main([*at, "graph"], spark).startswith("Files: 3")
    # Only what changed is parsed, and the graph is that of a full index: a changed, a new and a deleted file.
    (root / "A.swift").write_text("struct Other {}")
    (root / "C.swift").write_text("let c: Child? = nil\nstruct Child {}")
    (root / "App/AppUITests/PayUITests.swift").unlink()
    git("add", "-A")
    parsed = []
    full, old = swift.extract_files, engine_parse(parsed)
    monkeypatch.setattr(N, "extract_files", old)
    assert main([*at, "index"], spark) == "Files: 3\nEdges: 3\nSources: tree-sitter"
    assert set(parsed) == {"A.swift", "C.swift"}
    monkeypatch.setattr(N, "extract_files", full)
    rows = lambda: sorted(map(tuple, facts.load_graph(spark, str(tmp_path / "store"))[1].collect()))
    now = rows()
    assert main([*at, "index", "--force"], spark) == "Files: 3\nEdges: 3\nSources: tree-sitter" and rows() == now


def engine_parse(seen):
    """extract_files that notes what it is given."""

    def run(files):
        seen.extend(r.file_id for r in files.select("file_id").collect())
        return swift.extract_files(files)

    return run


def test_a_broken_file_is_left_out(spark, monkeypatch):
    files = spark.createDataFrame([("A.swift", "struct A {}"), ("B.swift", "\ud800x".encode("utf-16", "surrogatepass").decode("utf-16", "replace")), ("C.swift", None), (None, "struct D {}")], "file_id string, content string")
    got = {r.file_id: r.defines for r in swift.extract_files(files).collect()}
    assert got == {"A.swift": ["A"], "B.swift": [], "C.swift": []}


def test_without_version_control(spark, tmp_path):
    """A folder without version control is walked; contents have the ids that version control would give them."""
    import subprocess

    for name in ("plain", "repo"):
        (tmp_path / name / "build").mkdir(parents=True)
        (tmp_path / name / "A.swift").write_text("let é = 1\n")
        (tmp_path / name / "B.swift").write_text("")
        (tmp_path / name / "build/C.swift").write_text("x")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "repo"), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "A.swift", "B.swift")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert facts.find_root(str(tmp_path / "plain")) == str(tmp_path / "plain")
    assert rows(facts.current_inventory(spark, str(tmp_path / "plain"))) == rows(facts.current_inventory(spark, str(tmp_path / "repo")))


def test_changes_of_a_shallow_clone(spark, tmp_path, monkeypatch):
    """Without a merge base a build machine asks the code host; elsewhere that is an error."""
    import subprocess

    git = lambda at, *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    git(one, "init", "-q", "-b", "main")
    for k in "ab":
        (one / f"{k}.swift").write_text(k)
        git(one, "add", ".")
        git(one, "commit", "-qm", k)
    git(one, "checkout", "-q", "--orphan", "other")
    git(one, "commit", "-qm", "apart")
    subprocess.run(["git", "clone", "-q", "--depth", "1", "--no-single-branch", f"file://{one}", str(two)], check=True, capture_output=True)
    git(two, "remote", "set-url", "origin", "git@github.com:own/er.git")
    asked = []

    def request(*what):
        asked.append(what)
        return '{"files": [{"filename": "a.swift"}, {"filename": "Pods/x.swift"}, {"filename": "x/Pods/y.swift"}, {"status": "x"}, {"filename": "r.md"}]}'

    monkeypatch.delenv("CI", raising=False)
    with pytest.raises(subprocess.CalledProcessError):
        facts.changed_since(spark, str(two), "origin/main", request)
    monkeypatch.setenv("CI", "1")
    assert sorted(r.file_id for r in facts.changed_since(spark, str(two), "origin/main", request).collect()) == ["Pods/x.swift", "a.swift"]
    assert asked[0][:2] == ("own/er", "main") and len(asked[0][2]) == 40


def test_symbol_stores_and_their_helper(spark, tmp_path):
    """The newest store by name, else one in the repository; the helper's lists and output."""
    import os

    root, home = tmp_path / "App", tmp_path / "home"
    root.mkdir()
    assert symbol_store.find_store(spark, str(root), str(home)) is None
    local = root / "DerivedData/Index.noindex/DataStore"
    local.mkdir(parents=True)
    assert symbol_store.find_store(spark, str(root), str(home)) == str(local)
    for name, at in (("App-1", 5), ("App-2", 9), ("Application-3", 20)):
        store = home / symbol_store.HOME_STORES / name / symbol_store.STORE
        store.mkdir(parents=True)
        os.utime(store, (at, at))
    assert "App-2" in symbol_store.find_store(spark, str(root), str(home))
    helper = tmp_path / "index-helper"
    helper.write_text('#!/bin/sh\ntest "$3 $4" = "--repo-root $0.root" && exit 3\nf=$(head -n 1 "$6")\ntest -n "$8" && s=$(tail -n 1 "$8")\necho "{\\"edges\\": [{\\"from\\": \\"$f\\", \\"to\\": \\"${s:-none}\\"}]} done"\n')
    helper.chmod(0o755)
    assert symbol_store.find_helper(str(helper)) == str(helper)
    with pytest.raises(FileNotFoundError):
        symbol_store.find_helper(str(tmp_path / "no"))
    rows = lambda *a: [tuple(r) for r in symbol_store.run_helper(spark, str(helper), "/s", *a).collect()]
    assert rows("/r", ["A.swift", "B.swift"]) == [("A.swift", "none")] and rows("/r", ["A.swift"], ["A.swift", "Z.swift"]) == [("A.swift", "Z.swift")]
    with pytest.raises(RuntimeError):
        rows(f"{helper}.root", ["A.swift"])


def test_fact_sources(spark, tmp_path):
    inv = spark.createDataFrame([("A.swift", "1"), ("B.swift", "2")], "file_id string, blob_sha string")
    (tmp_path / "x.d").write_text("/b/A.o : B.swift\n")
    pairs = spark.createDataFrame([("A.swift", "B.swift"), ("/usr/x", "B.swift")], "`from` string, `to` string")
    sources = [ParsedSource(spark.createDataFrame(SOURCES, "file_id string, content string")), SymbolIndexSource(pairs, inv), MakefileSource(str(tmp_path), inv)]
    got = {s.name: s.read(spark) for s in sources}
    assert {k: (n.count(), e.count()) for k, (n, e) in got.items()} == {"tree-sitter": (3, 4), "indexstore": (2, 1), "dot-d": (2, 1)}
    assert all({"file_id", "role", "module"} <= set(n.columns) and e.columns == ["src", "dst", "kind"] for n, e in got.values())


def test_verify_selection(spark):
    selected = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "file_id string, kind string")
    assert sorted(r.file_id for r in N.verify_selection(selected, ids(spark, ["A", "C", "C", "D"])).collect()) == ["C", "D"]
