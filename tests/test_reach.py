"""Reachability on small graphs: the fixtures in all modes, properties on random graphs, methods and formats."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rippletrace.operators import cycles as C
from rippletrace.operators import reach as R
from rippletrace.operators import report as K
from rippletrace.plans import schema as S

D, V, A = S.DIRECT, S.VIEW, S.A11Y
ROLE = {"S": "Source", "U": "UnitTest", "N": "SnapshotTest", "I": "UITest"}


def node(file_id, role, setters=(), queries=(), methods=(), module=None):
    lit = lambda xs: [("Literal", x) for x in xs]
    return (f"{file_id}.swift", file_id, ROLE[role], module, [], None, None, lit(setters), lit(queries), [(n, lit(q), list(t)) for n, q, t in methods])


def graph(spark, nodes, edges, changed):
    n = spark.createDataFrame(nodes, S.NODES)
    e = spark.createDataFrame([(f"{a}.swift", f"{b}.swift", k, i) for i, (a, k, b) in enumerate(edges)], S.EDGES)
    return n, e, spark.createDataFrame([(f"{c}.swift",) for c in changed], "file_id string")


LOGIN = [("testLogin", ["login_button"], []), ("testSignup", ["signup_button"], [])]
CASES = {
    "T1": ([node("CartService", "S"), node("NetworkProtocol", "S"), node("CartServiceTests", "U")], [("NetworkProtocol", D, "CartService"), ("CartService", D, "CartServiceTests")], ["CartService"], ["Unit"], {("Unit", "CartServiceTests", None)}),
    "T2": ([node("A", "S"), node("B", "S"), node("ATests", "U"), node("BTests", "U")], [("A", D, "B"), ("A", D, "ATests"), ("B", D, "BTests")], ["A"], ["Unit"], {("Unit", "ATests", None)}),
    "T3": ([node("ProfileAvatar", "S"), node("ProfileScreen", "S"), node("ProfileScreenSnapshotTests", "N")], [("ProfileAvatar", V, "ProfileScreen"), ("ProfileScreen", D, "ProfileScreenSnapshotTests")], ["ProfileAvatar"], ["Snapshot"], {("Snapshot", "ProfileScreenSnapshotTests", None)}),
    "T4": (
        [node(x, "S") for x in ("Icon", "Avatar", "Header", "ProfileScreen", "SettingsScreen")] + [node("SettingsSnapshotTests", "N")],
        [("Icon", V, "Avatar"), ("Avatar", V, "Header"), ("Header", V, "ProfileScreen"), ("ProfileScreen", V, "SettingsScreen"), ("SettingsScreen", D, "SettingsSnapshotTests")],
        ["Icon"], ["Snapshot"], {("Snapshot", "SettingsSnapshotTests", None)},
    ),
    "T5": ([node("Service", "S"), node("ServiceTests", "U"), node("ServiceSnapshotTests", "N")], [("Service", D, "ServiceTests"), ("Service", D, "ServiceSnapshotTests")], ["Service"], None, {("Unit", "ServiceTests", None), ("Snapshot", "ServiceSnapshotTests", None)}),
    "T6": ([node("A", "S"), node("B", "S"), node("ATests", "U"), node("BTests", "U")], [("A", D, "B"), ("B", D, "A"), ("A", D, "ATests"), ("B", D, "BTests")], ["B"], ["Unit"], {("Unit", "BTests", None)}),
    "T7": ([node("LoginView", "S", ["login_button"]), node("UI/LoginUITests", "I", methods=LOGIN)], [("LoginView", A, "UI/LoginUITests")], ["LoginView"], ["UITest"], {("UITest", "UI/LoginUITests", ("testLogin",))}),
    "T8": ([node("LoginService", "S"), node("LoginView", "S", ["login_button"]), node("UI/LoginUITests", "I", methods=LOGIN[:1])], [("LoginService", D, "LoginView"), ("LoginView", A, "UI/LoginUITests")], ["LoginService"], ["UITest"], {("UITest", "UI/LoginUITests", ("testLogin",))}),
    "T9": (
        [node("Container", "S"), node("Wrapper", "S"), node("ChildView", "S", ["child_button"]), node("UI/ChildUITests", "I", methods=[("testChild", ["child_button"], [])])],
        [("Container", D, "Wrapper"), ("ChildView", V, "Wrapper"), ("ChildView", A, "UI/ChildUITests")], ["Container"], ["UITest"], {("UITest", "UI/ChildUITests", ("testChild",))},
    ),
    "T10": ([node("Container", "S"), node("Wrapper", "S"), node("ChildView", "S"), node("ChildTests", "U")], [("Container", D, "Wrapper"), ("ChildView", V, "Wrapper"), ("ChildView", D, "ChildTests")], ["Container"], ["Unit"], set()),
    "changed test selects itself": ([node("ATests", "U"), node("Mock", "U")], [], ["ATests", "Mock", "Gone"], None, {("Unit", "ATests", None)}),
    "page object": (
        [node("View", "S", ["k"]), node("Pages/LoginPage", "S", queries=["k"]), node("XUITests", "I", methods=[("testA", [], ["LoginPage"]), ("testB", [], ["OtherPage"])])],
        [("View", A, "XUITests")], ["View"], ["UITest"], {("UITest", "XUITests", ("testA",))},
    ),
    "no method hit": ([node("View", "S", ["k"]), node("XUITests", "I", methods=[("testA", ["z"], [])])], [("View", A, "XUITests")], ["View"], ["UITest"], {("UITest", "XUITests", None)}),
    "nothing changed": ([node("A", "S"), node("ATests", "U")], [("A", D, "ATests")], [], None, set()),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("mode,kernel", [("closure", R.KERNEL_EDGES), ("first_visit", R.KERNEL_EDGES)])
def test_fixture(spark, case, mode, kernel):
    nodes, edges, changed, kinds, want = CASES[case]
    out = R.resolve(*graph(spark, nodes, edges, changed), kinds, mode, kernel_edges=kernel)
    assert {(r.kind, r.file_id.removesuffix(".swift"), r.methods and tuple(r.methods)) for r in out.collect()} == want


@pytest.mark.parametrize("case", ["T4", "T9"])
def test_distributed_loop(spark, case):
    nodes, edges, changed, kinds, want = CASES[case]
    out = R.resolve(*graph(spark, nodes, edges, changed), kinds, kernel_edges=0)
    assert {(r.kind, r.file_id.removesuffix(".swift"), r.methods and tuple(r.methods)) for r in out.collect()} == want


def random_graph(spark, seed, n=14, m=40):
    rng = random.Random(seed)
    nodes = [node(f"F{i}", rng.choice("SSSSUNI")) for i in range(n)]
    edges = [(f"F{rng.randrange(n)}", rng.choice([D, V, A]), f"F{rng.randrange(n)}") for _ in range(m)]
    return nodes, edges, graph(spark, nodes, edges, [f"F{rng.randrange(n)}"])


@pytest.mark.parametrize("seed", range(4))
def test_ways_agree_and_cover_the_walk(spark, seed):
    nodes, edges, g = random_graph(spark, seed)
    role = {x[0]: x[2] for x in nodes}
    seeds = {r.file_id for r in g[2].collect()}
    want, todo = set(), [(s, 0, False) for s in seeds]
    while todo:
        n, d, down = state = todo.pop()
        if state in want:
            continue
        want.add(state)
        if role[n] == "Source":
            for a, k, b in ((f"{a}.swift", k, f"{b}.swift") for a, k, b in edges):
                if a == n and not (k == D and d >= 1) and not (k == V and down):
                    todo.append((b, d + 1 if k == D else 0 if k == A else d, False if k == V else down))
                if b == n and k == V:
                    todo.append((a, d, True))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(R.reached_states(*g)) == want
    assert rows(R.reached_states(*g, kernel_edges=0)) == want
    nodes_, edges_, changed = g
    assert {r.file_id for r in R.first_visit(*g).collect()} <= {x[0] for x in want}
    same = edges_.withColumn("ordinal", F.xxhash64("src", "dst", "kind") % 5)
    assert rows(R.first_visit(nodes_, same, changed, kernel_edges=0)) == rows(R.first_visit(nodes_, same, changed))


@pytest.mark.parametrize("kernel", [R.KERNEL_EDGES, 0])
def test_cycles(spark, kernel):
    edges = [(f"L{i:02}", f"L{(i + 1) % 11:02}") for i in range(11)] + [("A", "B"), ("B", "A"), ("B", "C"), ("C", "L00"), ("X", "X"), ("M", "N"), ("N", "O"), ("O", "M"), ("O", "A")]
    df = spark.createDataFrame([(a, b, D) for a, b in edges], "src string, dst string, kind string")
    out = {r.scc: r for r in C.cycle_report(df, kernel).collect()}
    assert {k: r.files for k, r in out.items()} == {"A": ["A", "B"], "M": ["M", "N", "O"], "L00": [f"L{i:02}" for i in range(11)]}
    assert out["L00"].more == 1 and len(out["L00"].shown_files) == 10
    assert out["L00"].warning.startswith("Dependency cycle detected (11 files):\n  L00 -> L01 -> L02 -> L03 -> L04 -> ...") and out["A"].warning is None


RESULT = [
    ("UITest", "UI/My Login.swift", "App UITests", None), ("UITest", "UI/B.swift", "T", ["testA", "testB"]), ("Unit", "ATests.swift", None, None),
    ("Unit", "a.b.Tests.swift", "U", []), ("UITest", "UI/C.swift", None, ["testC"]),
]


def test_formats(spark):
    df = spark.createDataFrame(RESULT, "kind string, file_id string, target string, methods array<string>")
    assert K.format_result(df) == "ATests\nU/a.b.Tests\nT/B/testA\nT/B/testB\nC/testC\nApp UITests/My Login"
    assert K.format_result(df, "xcodebuild") == "-only-testing:U/a.b.Tests -only-testing:T/B/testA -only-testing:T/B/testB '-only-testing:App UITests/My Login'"
    out = json.loads(K.format_result(df, "json"))
    assert list(out) == ["unit", "uitest", "total"] and out["total"] == 5
    assert out["unit"] == [{"file": "ATests.swift", "target": None}, {"file": "a.b.Tests.swift", "target": "U"}]
    assert out["uitest"][0] == {"file": "UI/B.swift", "target": "T", "methods": ["testA", "testB"]}
    assert K.format_result(df, "json", any_change=False) == ""
    assert json.loads(K.format_result(df.limit(0), "json")) == {"total": 0}
    assert {r.kind: r.n for r in K.counts_by_kind(df).collect()} == {"Unit": 2, "UITest": 3, "total": 5}
