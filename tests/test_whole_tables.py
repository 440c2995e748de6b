"""Queries against brute force over whole tables: no row is left out, whatever its keys."""

import random
from collections import Counter

import pytest
from rippletrace.operators import edges as E
from rippletrace.plans import adapters as A
from rippletrace.plans.queries import QUERIES

SUPPLIERS = [(s, s % 25) for s in range(1, 301)]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    parts = [(k, rng.randint(1, 50)) for k in range(1, 121)]
    lines = [(o, n, rng.randint(1, 120), rng.randint(1, 30), rng.choice("ANR")) for o in range(1, 71) for n in range(1, rng.randint(2, 6))]
    lines += [(71, n, p, 5, "A") for n, p in enumerate((1, 100, 1), 1)]
    return parts, lines


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(tables[0], "p_partkey long, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame(tables[1], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    return at


def got(spark, folder, name, *columns):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in QUERIES[name](spark, folder).select(*columns).collect())


def test_occurrences_of_all_suppliers(spark, folder, tables):
    kinds = ("class", "struct", "enum", "function")
    occ = [(s, kinds[o % 4], n == 1, p, o) for o, n, p, s, _ in tables[1]]
    path = lambda p: f"Sources/P{p}.swift"
    defined = {}
    for s, kind, is_def, p, o in occ:
        if is_def and kind != "function" and p % 3:
            defined[s] = max(defined.get(s, (0, "")), (o, path(p)))
    want = {(defined[s][1], path(p), "DirectReference") for s, _, is_def, p, _ in occ if not is_def and s in defined and p % 3 and path(p) != defined[s][1]}
    assert want and got(spark, folder, "usr_edges", "src", "dst", "kind") == Counter(want)
    n = sum(d for _, _, d, _, _ in occ)
    counts = QUERIES["index_counts"](spark, folder).first()
    assert (counts.scanned, counts.definitions, counts.reference_count, counts.defined) == (len(occ), n, len(occ) - n, len({s for s, _, d, _, _ in occ if d}))


def test_dependency_files_of_all_orders(spark, folder, tables):
    keys = {}
    for o, _, p, _, _ in tables[1]:
        keys.setdefault(o, set()).add(p)
    of = lambda p: f"/x/SDKs/P{p}.swift" if p % 9 == 0 else f"Sources/P{p}.h" if p % 13 == 0 else f"Sources/P{p}.swift"
    lines = Counter((f"O{o}.d", f"/tmp/build/P{min(k)}.o", tuple(of(p) for p in sorted(k))) for o, k in keys.items() if o % 35)
    assert got(spark, folder, "dotd_lines", "file", "output", "inputs") == lines
    home = lambda p: f"Lib/P{p}.swift" if p % 10 == 0 else f"Sources/P{p}.swift"
    edges = Counter((of(p), home(min(k)), "DirectReference") for o, k in keys.items() if o % 35 for p in k if p % 9 and p % 13 and of(p) != home(min(k)))
    assert got(spark, folder, "dotd_edges", "src", "dst", "kind") == edges


def test_symbols_of_all_documents(spark, tmp_path):
    rng = random.Random(6)
    pool = ["Alpha", "Betas", "Gammas", "Deltas", "Epsilon", "Zetas", "Thetas", "Iotas", "Kappa", "Lambda", "Sigmas", "Omegas"]
    docs = [(i, " ".join(rng.choice(["so", "it", *pool]) for _ in range(6)), rng.choice(["en", "de", None])) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    refs = {f"Docs/D{i}.swift": {w for w in t.split() if w in pool} for i, t, _ in docs}
    refs = {f: ws for f, ws in refs.items() if ws}
    pairs = lambda defs, times: Counter((d, r) for d, ds in defs.items() for r, ws in refs.items() if r != d for w in ds & ws for _ in range(times(w)))
    one, two = {f: {min(ws)} for f, ws in refs.items()}, {f: {min(ws), max(ws)} for f, ws in refs.items()}
    assert got(spark, str(tmp_path), "symbol_edges", "src", "dst") == pairs(one, lambda w: 1)
    assert got(spark, str(tmp_path), "view_edges", "src", "dst") == pairs(one, lambda w: 1 + (len(w) % 4 == 0))
    assert got(spark, str(tmp_path), "edge_multiplicity", "src", "dst", "n") == Counter((*p, n) for p, n in pairs(two, lambda w: 1).items() if n > 1)


def test_cycles_over_all_edges(spark, folder, tables):
    name = {r.p_partkey: r.file_id for r in A.part_files(spark, folder).collect()}
    at = {(o, n): p for o, n, p, _, _ in tables[1]}
    reach = {p: set() for p in name}
    for (o, n), p in at.items():
        if at.get((o, n + 1), p) != p:
            reach[p].add(at[o, n + 1])
    far = any(abs(a - b) > 40 for a, bs in reach.items() for b in bs)
    while any(more - reach[a] for a in reach if (more := set().union(*(reach[b] for b in reach[a])))):
        reach = {a: bs.union(*(reach[b] for b in bs)) for a, bs in reach.items()}
    groups = {tuple(sorted(name[b] for b in {a} | {b for b in reach[a] if a in reach[b]})) for a in reach}
    want = {g for g in groups if len(g) > 1}
    assert far and want and got(spark, folder, "cycles", "scc", "size", "files") == Counter((g[0], len(g), g) for g in want)
    assert got(spark, folder, "cycle_warnings", "scc", "shown_files", "more") == Counter((g[0], g[:10], max(0, len(g) - 10)) for g in want)


def test_constants_of_all_suppliers(spark, folder):
    last = {}
    for s, _ in sorted(SUPPLIERS):
        last |= {f"Ids.{s % 97}": f"a11y_{s % 97}", f"Ids{s % 3}.{s % 97}": f"a11y_{s * 2 % 97}"}
    alias = {"Ids" if n == 0 else f"Alias{n}": f"Ids{s % 3}" for s, n in sorted(SUPPLIERS)}

    def keys(kind, key):
        head, _, tail = key.partition(".")
        long = f"{alias[head]}.{tail}" if kind == "Symbolic" and head in alias else None
        return tuple(sorted({key, long, last.get(key) if kind == "Symbolic" else None, last.get(long)} - {None}))

    facts = A.a11y_facts(spark, folder).collect()
    want = {(f.side, f.id_kind, f.key, keys(f.id_kind, f.key)) for f in facts}
    assert any(len(w[3]) > 2 for w in want) and got(spark, folder, "canonical_keys", "side", "id_kind", "key", "keys") == Counter(want)
    named = {s: {(f.file_id, k) for f in facts if f.side == s for k in keys(f.id_kind, f.key)} for s in ("setter", "query")}
    edges = {(a, b) for a, x in named["setter"] for b, y in named["query"] if x == y and a != b}
    assert got(spark, folder, "a11y_edges", "src", "dst") == Counter(edges)


def test_a11y_edges_deals_each_query_once(spark, tmp_path):
    """A file's queries are dealt to be made distinct, to meet groups and as groups met; not by method, and not by every name."""
    parts = [(k, 3 if k % 2 else 0) for k in range(1, 401)]
    items = [(o, 1 + o % 7, k, o, "A") for k, _ in parts for o in range(1, 41)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    sc = spark.sparkContext
    store, no_quantiles = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, no_quantiles, None))}
    before = stages()
    rows = QUERIES["a11y_edges"](spark, str(tmp_path)).count()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    dealt = sum(n for k, n in stages().items() if k not in before)
    assert rows > 20_000 and dealt < 50 * 200 * 40


def test_a11y_edges_of_repeated_and_odd_identifiers(spark):
    facts = [("a", "setter", "Literal", "x"), ("a", "setter", "Literal", "x"), ("b", "setter", None, "y"), ("c", "setter", "Symbolic", "I.k"), ("d", "setter", "Literal", None)]
    facts += [("q", "query", "Literal", "x"), ("q", "query", "Literal", "x"), ("q", "query", None, "x"), ("r", "query", None, "y"), ("r", "query", "Literal", "z"), ("s", "query", "Literal", None), ("a", "query", "Literal", "x")]
    facts = spark.createDataFrame(facts, "file_id string, side string, id_kind string, key string")
    aliases = spark.createDataFrame([("I", "J", 1)], "alias string, target string, file_ordinal long")
    constants = spark.createDataFrame([("J.k", "z", 1)], "path string, literal string, file_ordinal long")
    assert Counter((e.src, e.dst) for e in E.a11y_edges(facts, aliases, constants).collect()) == Counter([("a", "q"), ("b", "r"), ("c", "r")])


def rows_dealt(spark, f):
    """What f returns, and the rows of all shuffles meanwhile."""
    sc = spark.sparkContext
    store, no_quantiles = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, no_quantiles, None))}
    before, out = stages(), f()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_a11y_edges_deals_a_query_and_group_once(spark, tmp_path):
    """Of the groups that a file meets by several identifiers, each is dealt once: rows were dealt to be made distinct, and again to meet the groups."""
    parts = [(k, 3 if k % 2 else 0) for k in range(1, 401)]
    items = [(o, 1 + o % 7, k, o, "A") for k, _ in parts for o in range(1, 98)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    rows, dealt = rows_dealt(spark, lambda: QUERIES["a11y_edges"](spark, str(tmp_path)).count())
    assert rows > 20_000 and dealt < 32_000


@pytest.mark.parametrize("name", ["index_full", "index_incremental"])
def test_an_index_deals_no_pairs(spark, tmp_path, name):
    """Each of 400 files sets an identifier of its own and one that all 300 tests query: the 120,000 pairs are made, but not dealt."""
    spark.createDataFrame([(k, 7) for k in range(1200)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows, dealt = rows_dealt(spark, lambda: QUERIES[name](spark, str(tmp_path)).where("kind = 'AccessibilityBinding'").count())
    assert rows > 120_000 and dealt < 60_000


@pytest.mark.parametrize("cell", [1, 3, 16384])
def test_a11y_edges_of_files_that_share_several_identifiers(spark, monkeypatch, cell):
    """Files set and query many of the same identifiers, by several names; a pair is there once however many cells its files fall into."""
    monkeypatch.setattr(E, "FILES_A_CELL", cell)
    pick = lambda f, side: [(f"f{f}", side, "Symbolic" if i % 3 == 0 else "Literal", f"I.{i}" if i % 3 == 0 else f"k{i}") for i in range(12) if (f * 7 + i * (3 if side == "setter" else 5)) % 11 < 4]
    facts = [x for f in range(30) for side in ("setter", "query") for x in pick(f, side)]
    constants = {"I.0": "k1", "I.3": "k1", "J.6": "k2", "J.9": "k4"}
    names = lambda kind, key: {key} if kind == "Literal" else {key, "J" + key[1:], constants.get(key), constants.get("J" + key[1:])} - {None}
    of = {s: {(f, n) for f, side, kind, key in facts if side == s for n in names(kind, key)} for s in ("setter", "query")}
    want = {(a, b) for a, x in of["setter"] for b, y in of["query"] if x == y and a != b}
    facts = spark.createDataFrame(facts + facts[:20], "file_id string, side string, id_kind string, key string")
    aliases = spark.createDataFrame([("I", "J", 1)], "alias string, target string, file_ordinal long")
    constants = spark.createDataFrame([(p, v, 1) for p, v in constants.items()], "path string, literal string, file_ordinal long")
    assert len(want) > 200 and Counter((e.src, e.dst) for e in E.a11y_edges(facts, aliases, constants).collect()) == Counter(want)
