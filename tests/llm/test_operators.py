"""Each operator against brute force, SQL or held-out accuracy, and on awkward rows: nulls, empty and very long texts,
repeated rows, ties, clashing extra columns, tables without rows."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rippletrace.llm import chat_snapshots, chunks, decontaminate, jaccard_join, language_id, packing, quality_rules, repeats, token_counts, toxicity, url_filter
from rippletrace.llm.common import Memo
from tests.compare import same
from tests.conftest import SMALL
from tests.llm.test_repeats_local import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, key long, fp string, chunk string"


def table(spark, texts, **more):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or ""), "x", 1, "f", "c") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def awkward(rng=random.Random(5)):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(60), text(30)
    edited = [" ".join(w if rng.random() > p else word() for w in base.split()) for p in (0.01, 0.02, 0.03, 0.05, 0.1) for _ in range(6)]
    texts = [None, "", "  \n\t ", "one", "ONE", "a b c d", "a b c d e", "A B c d E", "a b c d e f g h", "a b c d e f g i", text(7), base, base, base.upper(), *edited]
    texts += [passage + " " + text(40) for _ in range(5)] + [text(20) + "\n" + passage for _ in range(3)] + [text(3000), "x" * 5000, "é ß 中文 🙂 " * 30, "\u00a0 \x0b\x0c\r a\u2003b"]
    rows = list(enumerate(texts))
    rows += [(None, base), (None, None), rows[11], rows[11], (10_000, text(12))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3, "n_chars")


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).limit(0)


def words(t):
    return (t or "").encode().split()


# --- 9 ---------------------------------------------------------------------------------------------------------


def shingles(t):
    w = [x.lower() for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            group[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(s), least.get(root(i), None) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("short", [8, 2])
def test_jaccard_components(docs, rows, short):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, short=short).collect()), key=repr)
    assert got == brute_components(rows)


def test_jaccard_on_a_large_group(spark):
    """A group of near copies around a base, with short lists switched off, so that all rounds run."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        p = rng.choice([0.0, 0.01, 0.02, 0.04, 0.08])
        rows.append((i, " ".join(w if rng.random() > p else f"n{rng.randrange(10**6)}" for w in base)))
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows), short=1).collect()), key=repr)
    assert got == brute_components(rows)


def test_small_sets_by_subsets(spark):
    """Light sets of all sizes around the boundary: every pair that links is found by subsets or lists."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        n = rng.randint(1, 14)
        rows.append((i, " ".join(f"t{k + rng.choice([0, 0, 0, 0, 0, 50])}" for k in range(n + 4))))
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows)).collect()), key=repr)
    assert got == brute_components(rows)


def test_boundary_follows_cost():
    assert jaccard_join.boundary(0.0) < jaccard_join.boundary(50.0)
    assert all(jaccard_join.overlap(n, m) * 7 >= 3 * (n + m) > (jaccard_join.overlap(n, m) - 1) * 7 for n in range(1, 30) for m in range(1, 30))


def test_one_of_each_class(docs, rows):
    """Exact copies go whether their id is null, shared or their own; rows without words all stay."""
    named = brute_components(rows)
    got = jaccard_join.one_of_each_class(docs)
    kept = [r.doc_id for r in got.collect()]
    empty = [doc for doc, n, _ in named if not n]
    want = {doc for doc, n, c in named if n and doc is not None and doc == c}
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted(kept, key=repr) == sorted([*want, *empty], key=repr)


def test_rows_that_share_an_id_are_documents_each(spark):
    """Two texts under one id: each class keeps its row, and a near copy of either goes."""
    rng = random.Random(14)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c = text(), text(), text()
    near = lambda t: " ".join(["other", *t.split()[1:]])
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, c), (None, near(c)), (None, a), (None, None), (5, None), (5, None)]
    want = sorted([(1, a), (1, b), (None, None), (5, None), (5, None)], key=repr)
    for parts in (1, 3):
        got = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each_class(table(spark, rows).repartition(parts)).collect()), key=repr)
        assert [r for r in got if r[1] not in (c, near(c))] == want and sum(r[1] in (c, near(c)) for r in got) == 1
        assert {r[1] for r in got} - {c} == {a, b, None, near(c)} - {c} or c in {r[1] for r in got}
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_join.one_of_each_class(plain).count() == 6 and jaccard_join.one_of_each_class(plain).columns == ["doc_id", "text"]


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_components_by_steps_and_in_one_task(spark, most):
    """Chains, stars, copies of links and links to oneself; least nodes by a plain walk. Few links take few jobs."""
    from rippletrace.llm.components import components

    links = [(k, k + 1) for k in range(0, 300) if k % 50] + [(-5, k) for k in range(1000, 1100)] + [(2**62, -(2**62)), (7, 7), (1000, -5), (9000, 8000), (9000, 7000)]
    root = {n: n for link in links for n in link}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    sc = spark.sparkContext
    sc.setJobGroup(f"components {most}", "")
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), most=most).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"components {most}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {n: r for n, r in root.items() if n != r}
    assert most == 0 or jobs <= 5


def test_a_template_in_many_unlike_documents(spark):
    """Long lists whose sets are mostly not linked: all rounds of centres run, and no link is lost."""
    rng = random.Random(17)
    words = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    template, bodies = words(24), [words(14) for _ in range(40)]
    rows = [(i, " ".join(template[:12] + bodies[i % 40][: rng.choice([13, 14])] + template[12:])) for i in range(120)]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(table(spark, rows), short=2).collect()), key=repr)
    assert got == brute_components(rows)


@pytest.mark.parametrize("sizes", [(200, 64), (3_000, 1), (1_000_000, 500)])
def test_any_layout_gives_the_same(docs, rows, sizes):
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs, sizes=sizes).collect()), key=repr)
    assert got == brute_components(rows)


def test_layout_keeps_questions_whole():
    """From 1 MB to 10 PB: a chunk has entries for every bucket, and chunks and buckets fit into a worker."""
    for total in (10**k for k in range(6, 17)):
        for partitions in (8, 200, 20_000):
            chunk, buckets = chunks.layout(total, partitions)
            assert 2_000_000 <= chunk <= 2**30 and buckets >= 2 * partitions
            assert buckets == 2 * partitions or (chunk / 32 / buckets >= 7.9 and total / buckets < 8e9)


# --- 5 ---------------------------------------------------------------------------------------------------------


def brute_digests(rows):
    """By (id, hash of the text where an id is null or shared), the rule of the operator; equal rows count as a multiset."""
    ids = [i for i, _ in rows]
    order = sorted(rows, key=lambda r: (2**63 - 1 if r[0] is None else r[0], signed(r[1]) if r[0] is None or ids.count(r[0]) > 1 else 0))
    return sorted(((i, *b) for (i, _), b in zip(order, brute([(i, (t or "").encode()) for i, t in order]))), key=repr)


def signed(text):
    import xxhash

    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("how", [{}, {"sizes": (300, 64)}, {"crowd": 1, "many": 3, "sizes": (4_000, 1)}])
def test_repeats(spark, docs, rows, how):
    """Whatever the table's layout, also for rows that share an id."""
    rng = random.Random(20)
    shared = " ".join(f"v{rng.randrange(10**5)}" for _ in range(60))
    more = [(None, f"{k} {shared} {k}") for k in range(4)] + [(77, f"{shared} {k}") for k in range(3)]
    for parts in (1, 4):
        own = docs.unionByName(table(spark, more)).repartition(parts, "text")
        got = sorted((tuple(r) for r in repeats.repeat_digest(own, **how).collect()), key=repr)
        assert got == brute_digests([*rows, *more])


def test_cleaned_texts(spark, docs, rows):
    own = docs.withColumn("n_removed", F.lit(77)).withColumn("text2", F.col("text"))
    out = repeats.without_repeats(own)
    assert out.schema == own.schema and {r.n_removed for r in out.collect()} == {77}
    digest = sorted((r.doc_id, r.kept_sha256) for r in repeats.repeat_digest(docs).collect() if r.doc_id is not None)
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect() if r.doc_id is not None) == digest
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert sorted(((r.doc_id, r.text2, r.n_chars) for r in out.collect()), key=repr) == sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=repr)
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    two = repeats.without_repeats(plain, count="gone")
    assert two.columns == ["doc_id", "text", "gone"] and two.count() == len(rows)
    with pytest.raises(ValueError):
        repeats.without_repeats(own, count="n_removed")


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    special = [(20_000, "It's <|endoftext|> don't \u0130 Σς e\u0301 '' !!'s 12ab"), (20_001, "<|startoftext|>x")]
    df = docs.where("doc_id is not null and doc_id != 11").unionByName(table(spark, special))
    texts = dict([r for r in rows if r[0] not in (None, 11)] + special)
    got = packing.harmonic_packing(df).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        want = np.array(encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in parts) == want and all(p.doc_tokens * 4 == len(want) for p in parts)
        assert all(p.ids_crc32 == zlib.crc32(want[4 * p.start : 4 * (p.start + p.length)]) for p in parts)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([p.length for p in parts])
        assert [p.offset for p in parts] == [0, *ends[:-1]] and ends[-1] <= 4096
        assert ends[-1] & (ends[-1] - 1) == 0  # no padding: whole sequences or powers of two


def test_packing_spellings_share_an_entry():
    """A-Z are lower-cased before the table, but not where a letter could compose with a mark or a special token would appear."""
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = packing.word_ids("word_bpe_49k.json")
    assert set(packing.words("The THE the \xc9t\xe9 \xc9T\xe9".encode())) == {b"the", "\xc9t\xe9".encode()}
    apart = ["J\u030c A", "H\u0331 B", "<|ENDOFTEXT|> C", "\u212a D"]
    assert all(packing.words(t.encode()) == t.encode().split() for t in apart)
    rng = random.Random(8)
    signs = ["aA", "J", "h", "S", "t", "\xc9", "\xe9", "\xdf", "\xd7", "\xb5", "\xa0", "'s", "'S", "'", ".", ",", "!?", "<|", "|>", "7", " ", "  \n", "<|endoftext|>", "<|EndOfText|>", "\u030c", "\u0301", "\u0130", "\u03a3", "\u212a"]
    mixed = ["".join(rng.choice(signs[: rng.choice((24, 29))]) for _ in range(rng.randint(0, 9))) for _ in range(3_000)]
    for text in [*apart, "It's DON'T dogs', (x) a.b C3PO, 12,5% Wort.", *mixed]:
        assert b"".join(map(ids, packing.words(text.encode()))) == np.array(encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("capacity", [1, 2, 64, 4096])
def test_harmonic_classes(capacity):
    """Bins hold k pieces of (capacity / (k + 1), capacity / k] and at most fillers of their gap; a document is cut once at most besides whole sequences."""
    rng = random.Random(capacity)
    bins, sizes, rows = packing.HarmonicBins(capacity, 5), {}, []
    for doc in range(3_000):
        sizes[doc] = n = rng.choice([1, 2, rng.randint(1, 3 * capacity), rng.randint(1, max(1, capacity // 7)), capacity])
        rows += bins.document(doc, np.arange(n, dtype="<u4").tobytes())
        assert sum(len(x) for x in bins.open.values()) <= 2 * capacity**1.5 and len({x[5] for x in rows[-1:]}) <= 1
    closed = {x[5] for x in rows}
    rows += bins.rest()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r[5], []).append(r)
        by_doc.setdefault(r[0], []).append(r)
    assert sorted(by_seq) == list(range(5, 5 + len(by_seq)))
    for seq, parts in by_seq.items():
        assert [p[6] for p in parts] == [0, *np.cumsum([p[2] for p in parts])[:-1]]
        total = sum(p[2] for p in parts)
        if seq in closed:
            (k,) = {p[7] for p in parts} - {0}
            own = [p[2] for p in parts if p[7]]
            assert total == capacity and len(own) == k and all(capacity < (k + 1) * n <= capacity * (k + 1) / k for n in own)
            assert all(p[1] == 0 or p[1] + p[2] <= sizes[p[0]] for p in parts)
        else:
            assert total & (total - 1) == 0 and {p[7] for p in parts} == {0}
    for doc, parts in by_doc.items():
        parts.sort(key=lambda p: p[1])
        assert [p[1] for p in parts] == [0, *np.cumsum([p[2] for p in parts])[:-1]] and sum(p[2] for p in parts) == sizes[doc]
        assert b"".join(p[8] for p in parts) == np.arange(sizes[doc], dtype="<u4").tobytes()
        if all(p[5] in closed for p in parts):
            assert len(parts) <= sizes[doc] // capacity + 2
    assert max(seq for seq in by_seq) - max(closed, default=4) <= 2 * capacity**0.5 + 15


# --- 6 ---------------------------------------------------------------------------------------------------------


def unigram_library(pieces):
    """The tokenizers library's unigram model with the same pieces; its byte pieces can't be reached as text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    held = {"<unk>": -1e6} | {f"<0x{b:02X}>": -1e6 for b in range(256)} | dict(pieces)
    t = Tokenizer(models.Unigram(list(held.items()), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=False)])
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


def test_token_counts(spark, docs, rows):
    count = unigram_library(token_counts.vocabulary("piece_bpe_32k.model"))
    odd = [(20_000, "<s> </s> <unk> <0x41> <0x0A>x"), (20_001, "internationalization " * 20_000), (20_002, "y" * 200_000), (20_003, "\u2581\u2581 \u2581a")]
    own = docs.unionByName(table(spark, odd))
    want = sorted(((i, count(x)) for i, x in [*rows, *odd] if i != 20_003), key=repr)
    got = {r.doc_id: r for r in token_counts.token_counts(own).where("doc_id >= 20000").collect()}
    assert sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(own).where("doc_id is null or doc_id != 20003").collect()), key=repr) == want
    assert got[20_001].n_tokens <= 3 * 20_000 and got[20_000].n_tokens > 12 and got[20_003].n_tokens > 0


def test_token_counts_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    count = unigram_library(token_counts.vocabulary("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {r.doc_id: count(r.text) for r in docs.collect()}


def test_scores_are_log_probabilities():
    pieces = token_counts.vocabulary("piece_bpe_32k.model")
    assert sum(np.exp(s) for _, s in pieces) == pytest.approx(1) and not {"<s>", "</s>", "<unk>", "<0x00>", "<0xFF>"} & {p for p, _ in pieces}
    count = token_counts.counter(pieces)
    assert count("\u2581internationalization")[0] == 2 and count("\u2581of")[0] == 1


def test_count_ties():
    """Equal scores: the candidate with the earlier start (the longer last piece) stays, as in the library."""
    from tokenizers import Tokenizer, models

    rng = random.Random(1)
    pieces = [("<unk>", 0.0)] + sorted({("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))), -float(rng.randint(1, 3))) for _ in range(30)})
    pieces = list(dict(pieces).items())
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    count = token_counts.counter(pieces)
    for _ in range(200):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        if "a" in dict(pieces) and "b" in dict(pieces):
            assert count(w)[0] == len(t.encode(w).ids), w


# --- 1 ---------------------------------------------------------------------------------------------------------


def smith_waterman(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = random.Random(4)
    for _ in range(60):
        a, b = (np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 12))]) for _ in range(2))
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def leak_case(rates, n_docs=60):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    items = [" ".join(word() for _ in range(rng.randint(12, 40))) for _ in range(8)]
    docs = []
    for i in range(n_docs):
        item = rng.choice(items).split()
        p = rates[i % len(rates)]
        copy = [x for w in item for x in ([w] if rng.random() > p else rng.choice([[word()], [], [w, word()]]))]
        body = [word() for _ in range(30)]
        docs.append((i, " ".join(body + (copy if i % 3 else item[: len(item) // 4]) + body[::-1])))
    return items, docs


def shares(items, texts):
    """The score of every pair, by brute force."""
    out = {}
    for doc, text in texts:
        for k, item in enumerate(items):
            a, b = decontaminate.words_of(item), decontaminate.words_of(text)
            out[doc, k] = smith_waterman(a, b) / (2 * len(a))
    return out


@pytest.mark.parametrize("block", [500_000, 60])
def test_leaks(spark, block):
    """Whatever is found has its exact score; nothing under the threshold is found; what has three words in a row is found."""
    items, texts = leak_case([0.0, 0.1, 0.2])
    bench = spark.createDataFrame([*enumerate(items), (90, None), (92, ""), (0, items[0]), (None, items[1])], "item_id long, text string")
    docs = table(spark, [*texts, (None, items[0]), (500, None), (501, ""), (502, f"{items[2]} " * 400), (502, f"{items[2]} " * 400)])
    rows = decontaminate.find_leaks(docs, bench, block=block).collect()
    got = {(r.doc_id, r.item_id): r.score for r in rows}
    want = {k: v for k, v in shares(items, texts).items() if v >= 0.5}
    assert {k: v for k, v in got.items() if k[0] in dict(texts) and k[1] is not None} == pytest.approx(want) and len(want) >= 35
    assert got[None, 0] == 1.0 and got[502, 2] == 1.0 and {d for d, k in got if k is None} == {d for d, k in got if k == 1}
    assert sum((r.doc_id, r.item_id) == (None, 0) for r in rows) == 2 and sum((r.doc_id, r.item_id) == (502, 2) for r in rows) == 2
    kept = decontaminate.without_leaks(docs, bench, block=block)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in [*texts, (500, 0), (501, 0)]} - {d for d, _ in got}


def test_recall_of_edited_copies(spark):
    """Of all pairs over the threshold, by how much was edited; only copies without three words in a row are missed."""
    items, texts = leak_case([0.05, 0.1, 0.2, 0.3, 0.4], 300)
    rng = random.Random(2)
    thirds = [(1_000 + k, " ".join(w if j % 3 != 2 else f"z{rng.randrange(10**6)}" for j, w in enumerate(a.split()))) for k, a in enumerate(items)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(spark, [*texts, *thirds]), bench).collect()}
    want = {k for k, v in shares(items, texts).items() if v >= 0.5}
    runs = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    assert got <= want | {(1_000 + k, k) for k in range(len(items))} and len(got & want) >= 0.98 * len(want)
    assert all(not runs(dict(texts)[d].split()) & runs(items[k].split()) for d, k in want - got)
    every_third = {k for k, v in shares(items, thirds).items() if v >= 0.5}
    assert every_third and not got & every_third  # the stated limit of seeds of three words


def test_short_items_word_for_word(spark):
    bench = spark.createDataFrame([(1, "Grand Total"), (2, "only"), (3, "grand total"), (4, "..."), (5, "a b c")], "item_id long, text string")
    docs = table(spark, [(1, "the grand, total of"), (2, "grand the total"), (3, "(Only) this"), (4, "a b"), (None, "x a B c x grand total")])
    got = {(r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, 1.0, 1, 3), (1, 3, 1.0, 1, 3), (3, 2, 1.0, 0, 1), (None, 1, 1.0, 5, 7), (None, 3, 1.0, 5, 7), (None, 5, 1.0, 1, 4)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {2, 4}


def test_leaks_with_short_runs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (11, 15, 15, 20, 30)]
    copies = [[w if k % 4 != 3 else word() for k, w in enumerate(a)] for a in items]  # intact runs of three words
    copies += [[w for k, x in enumerate(a) for w in ([x] if k < 8 else [x, word()])] for a in items]  # drifts far from where its run begins
    copies += [[w if rng.random() > 0.25 else word() for w in a] for a in items for _ in range(20)]
    texts = [(i, " ".join([word() for _ in range(9)] + c + [word() for _ in range(9)])) for i, c in enumerate(copies)]
    bench = spark.createDataFrame([(k, " ".join(a)) for k, a in enumerate(items)], "item_id long, text string")
    want = {}
    for doc, text in texts:
        b = text.split()
        for k, a in enumerate(items):
            share = smith_waterman(a, b) / (2 * len(a))
            if share >= 0.5 and {tuple(a[i : i + 3]) for i in range(len(a) - 2)} & {tuple(b[i : i + 3]) for i in range(len(b) - 2)}:
                want[doc, k] = share
    assert all((k, k) in want and (5 + k, k) in want for k in range(5))
    docs = table(spark, texts)
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, bench).collect()} == pytest.approx(want)
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {d for d, _ in texts} - {d for d, _ in want}


# --- 2 ---------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://EXAMPLE.com/en/7x", "http://a.example.com/en/8", "https://xexample.com/en/7", "http://com/en/", "http://x.net/de/8", "http://example.net/de/8?q",
    "http://example.net/de/9#f", "http://a.org/es/", "http://a.org/ES/", "x://y://z.org/es/", "http://example.org?x/es/", "http://user@h.net:80/de/1", "http://ünï.com/en/é\nb", "http://x.com/en/7",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>spam farm cheap pills en de</p>") for i, u in enumerate(URLS)] + [(None, URLS[3], None)], "page_id long, url string, html string")
    out = url_filter.filter_urls(pages).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        host, path, rule = brute_url(URLS[r.page_id] if r.page_id is not None else URLS[3])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]) and r.verdict == (rule[1] if rule else r.verdict) and r.verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    clash = url_filter.filter_urls(pages.select("*", *[F.lit(1).alias(c) for c in ("host", "path", "words", "name", "w", "k1", "held", "rule")])).collect()
    assert sorted(map(repr, clash)) == sorted(map(repr, out))


def test_segmentation():
    s = url_filter.Segmenter({"cheap": 50, "pills": 40, "spam": 30, "farm": 30, "a": 5, "re": 9})
    assert s.split("cheappills") == ("cheap", "pills") and s.split("spamfarm") == ("spam", "farm") and "".join(s.split("zzcheapq")) == "zzcheapq" and s.split("") == ()


def brute_url_filter(pages, buckets):
    """words, block_score and verdict of each page, in plain Python."""
    import regex

    counts = {}
    for _, _, html in pages:
        text = regex.sub(r"(?is)<script\b.*?(</script\s*>|$)|<style\b.*?(</style\s*>|$)|<!--.*?(-->|$)|<[^>]*>|&[a-z0-9#]{1,32};", " ", html or "").lower()
        for w in regex.findall(r"[\p{L}\p{M}]+", text):
            counts[w] = counts.get(w, 0) + 1
    s = url_filter.Segmenter(counts)
    rows = []
    for page, url, _ in pages:
        host, path, rule = brute_url(url)
        words = [f"{side}:{w}" for side, name in url_filter.names_of(host, path) for w in ((name,) if name[0] == "0" else s.split(name))]
        rows.append((page, words, rule and rule[1]))
    n, docs = np.ones((2, buckets)), [0, 0]
    for _, words, verdict in rows:
        if verdict:
            docs[verdict == "block"] += 1
            for w in words:
                n[int(verdict == "block"), zlib.crc32(w.encode()) % buckets] += 1
    odds = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    out = []
    for page, words, verdict in rows:
        z = np.log((docs[1] + 1) / (docs[0] + 1)) + sum(odds[zlib.crc32(w.encode()) % buckets] for w in words)
        score = 1 / (1 + np.exp(-np.clip(z, -50, 50))) if all(docs) else 0.0
        out.append((page, words, score, verdict or ("block" if score > 0.5 else "allow")))
    return out


def same_urls(got, want):
    key = lambda r: repr(r[:2])
    got = sorted(((r.page_id, r.words, r.block_score, r.verdict) for r in got), key=key)
    want = sorted(want, key=key)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)


@pytest.mark.parametrize("buckets", [1 << 16, 7])
def test_url_verdicts_equal_brute_force(spark, buckets):
    """Segments, scores and verdicts, on all pages of the smallest table and on odd ones: other scripts, escapes, markup, long names, repeats."""
    table_ = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    odd = [(10_000 + i, u, "<script>var spam='x'</script><!-- zz --><p>spam&nbsp;farm für f\u00fcr \u4e2d\u6587 a b &amp; cheap pills") for i, u in enumerate(URLS)]
    odd += [(20_000, "http://spamf\u00fcrfarm.de/%C3%BCber/f%C3%BCrspam", None), (20_001, "http://xn--frspam-3ya.com/en/1", ""), (20_002, "http://xn--.com/a", None), (None, "http://a.b/" + "spamfarm" * 700, "x"), (20_003, "http://a.b/c", "word " * 50_000 + "w" * 60)]
    odd += [odd[3], odd[3]]
    pages = [tuple(r) for r in table_.collect()] + odd
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), buckets=buckets).collect()
    same_urls(got, brute_url_filter(pages, buckets))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_urls_of_one_decided_class(spark):
    """Rules that decide only one class teach nothing: the rest is allowed."""
    pages = [(1, "http://a.com/en/1", "a"), (2, "http://b.com/en/2", "b"), (3, "http://c.io/x", "c"), (4, None, None)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_every_word_counts_at_any_size(spark):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("bcdfghjklm") for _ in range(n))
    rare = sorted({letters(9) for _ in range(60_000)})
    texts = [*(" ".join(rare[k : k + 2_000]) for k in range(0, len(rare), 2_000)), "spam farm " * 50]
    urls = [f"http://{rare[k]}{rare[-k]}.net/{rare[2 * k]}spam/12" for k in range(1, 30)]
    pages = [(k, urls[k % len(urls)], t) for k, t in enumerate(texts)] + [(1_000, "http://spamfarm.net/", None), (1_001, "http://spamfarm.net/", None)]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    same_urls(out, brute_url_filter(pages, 1 << 16))
    assert sum(f"h:{rare[k]}" in r.words for r in out for k in range(1, 30)) >= 29


# --- 3 and 10 --------------------------------------------------------------------------------------------------


def held(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def labelled(spark, n=700):
    rng = random.Random(6)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["zogwump", "zogwumpy", "krazzit", "krazzits"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(bad) if toxic and rng.random() < 0.05 + (k == 3) else word() for k in range(rng.randint(20, 120)))))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(spark)
    long = [(9003, rows[1][1] * 2_000), (9004, "zogwump krazzit " * 50_000)]
    docs = table(spark, [*rows, (None, "zogwump"), (9000, None), (9001, ""), (9002, "zogwumpie krazzitty " * 3 + "therin on the an " * 5), *long])
    own = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, own, toxicity.is_held_out).collect()}
    assert len(got) == len(rows) + 6 and all(got[i].held_out == (held(i, 4) == 2) for i, _ in rows) and not got[None].held_out
    right = [(got[i].predicted == y) for i, y in labels if held(i, 4) == 2]
    assert sum(right) / len(right) > 0.9
    assert got[9000].score == got[9001].score and got[9002].predicted == 1  # spellings never seen share n-grams
    assert got[9003].predicted == 0 and got[9004].predicted == 1
    twice = toxicity.score_toxicity(docs.unionByName(docs.where("doc_id in (1, 9002)")), own, toxicity.is_held_out).where("doc_id in (1, 9002)").collect()
    assert len(twice) == 4 and len({(r.doc_id, r.score) for r in twice}) == 2
    kept = toxicity.without_toxic(docs, own, toxicity.is_held_out)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got.values() if not r.predicted)


def test_toxicity_without_labels(spark, none):
    docs, own = table(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, own, toxicity.is_held_out).collect()} == {0}
    assert toxicity.score_toxicity(docs, own.limit(0), toxicity.is_held_out).count() == 2 and toxicity.score_toxicity(none, own, toxicity.is_held_out).count() == 0


def test_language(spark):
    rng = random.Random(2)
    sounds = {"xx": ["ba", "lo", "mi"], "yy": ["krz", "sto", "ęcz"], "zz": ["öö", "ää", "ttu"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[l]) for _ in range(3)) for _ in range(rng.randint(3, 40))), l, "s", 1, "x", 1, "f", "c") for i, l in enumerate(rng.choice(sorted(sounds)) for _ in range(300))]
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "123 !!", "yy"), (1003, "öö ää", None), (None, "krzsto krz", "yy"), (1004, "½ ²", "xx"), (1005, "① _ ٣", None), (1006, "\u4e2d" * 40, None), (1007, "balomi " * 100_000, None)]
    odd += [rows[0][:3], rows[0][:3]]
    df = spark.createDataFrame(rows + [(i, t, l, "s", 1, "x", 1, "f", "c") for i, t, l in odd], DOCS)
    got = {r.doc_id: r for r in language_id.identify(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()}
    assert all(got[r[0]].held_out == (held(r[0], 3) == 1) for r in rows)
    right = [got[r[0]].lang_pred == r[2] for r in rows if held(r[0], 3) == 1]
    assert sum(right) / len(right) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004, 1005, 1007)] == ["und", "und", "und", "zz", "yy", "und", "und", "xx"] and got[1000].score == got[1005].score == 0
    assert got[1006].rejected and got[1006].decision == "und" and got[1006].lang_pred in sounds and not got[rows[0][0]].rejected and got[rows[0][0]].decision == rows[0][2]
    unlearnt = language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"}


def test_every_language_is_learnt(spark):
    """More languages than any fixed number: each is predicted, the rarest with one labelled row."""
    rng = random.Random(21)
    own = {f"l{k}": [chr(0x3400 + 7 * k + j) for j in range(7)] for k in range(260)}
    text = lambda l: " ".join("".join(rng.choice(own[l]) for _ in range(3)) for _ in range(12))
    rows = [(k, text(l), l) for k, l in enumerate([*own, *own, "l0", "l0"])]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") >= 260).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: l for k, _, l in rows}


# --- 4 and 7 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def con(rows, tmp_path_factory):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    df = pd.DataFrame([(i, t, s) for i, t in quality_texts(rows) for s in ("s",)], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    con.execute("create table documents as select * from df")
    turns = pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con.execute("create table conversations as select * from turns")
    return con


def quality_texts(rows):
    footer = "Read MORE  at our site"
    own = [r for r in rows if r[0] is not None and r[0] != 11]
    more = [(30_000 + i, f"line number {i} has some words\n{footer}\n  {footer.lower()} \nlast of {i}") for i in range(30)]
    return own + more + [(40_000, footer + "\n" + footer), (40_001, "w " * 40), (40_002, "a b c d e f g h i j k a b c d e z"), (40_001, "w " * 40)]


def test_quality_rules(spark, rows, con):
    docs = table(spark, quality_texts(rows))
    out = quality_rules.line_frequency_rules(docs)
    same(out.select(*quality_rules.COLUMNS), con, quality_rules.OP4_SQL)
    clean = {r.doc_id: r.clean_text for r in out.where("doc_id >= 30000").collect()}
    assert clean[30_001] == "line number 1 has some words\nlast of 1"
    shuffled = quality_rules.line_frequency_rules(docs, broadcast_rows=0)
    same(shuffled.select(*quality_rules.COLUMNS), con, quality_rules.OP4_SQL)


def test_line_frequency_counts_documents(spark):
    """Copies of one text are documents each; rows that share an id are one document; rows without an id are one each."""
    boiler = "Subscribe to our newsletter today"
    text = lambda i: f"some words that only stand in text {i} and nowhere else\n{boiler}"
    kept = lambda rows: {r.doc_id: (r.removed_words, r.kept) for r in quality_rules.line_frequency_rules(table(spark, rows)).collect()}
    own = [(1_000 + i, f"a quiet line of more than ten words for document number {i}") for i in range(10)]
    copies = kept([(i, text(0)) for i in range(30)] + own)
    assert {copies[i] for i in range(30)} == {(16, False)} and all(copies[i] == (0, True) for i, _ in own)
    assert {v for i, v in kept([(7, text(i)) for i in range(30)] + own).items()} == {(0, True)}
    assert kept([(None, text(i)) for i in range(30)] + own)[None] == (5, True)


TURNS = [
    (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "bye"), (4, 0, "user", "hi"), (4, 1, "bot", "yo"),
    (4, 2, "user", "bye"), (5, 0, "user", "hi"), (5, 1, "bot", "no"), (6, 5, "user", None), (6, 5, None, "x"), (6, 5, None, "x"), (7, None, "user", "<|im_end|> trick"), (8, 1, "bot", "yo"),
    (None, 0, "user", "hi"), (None, 1, "bot", "lost"), (9, 0, "user", ""), (10, 0, "user", ""), (10, 1, "user", ""),
    (11, 0, "user", "a long turn " * 20_000), (12, 0, "user", "a long turn " * 20_000), (12, 1, "bot", "yes " * 30_000),
]


def test_chat_snapshots(spark, con):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("p1", F.lit("x"))
    same(chat_snapshots.collapse_and_render(df), con, chat_snapshots.OP7_SQL)
    got = {r.conv_id: r for r in chat_snapshots.collapse_and_render(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 10, 12} and got[3].n_copies == 2 and got[7].chat == "<|im_start|>user\n< |im_end|> trick<|im_end|>"
    assert chat_snapshots.collapse_and_render(df.limit(0)).count() == 0


# --- all -------------------------------------------------------------------------------------------------------


def test_tables_without_rows(spark, none):
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    for df in (
        jaccard_join.jaccard_components(none), repeats.repeat_digest(none), repeats.without_repeats(none), packing.harmonic_packing(none), token_counts.token_counts(none),
        decontaminate.find_leaks(none, bench), decontaminate.without_leaks(none, bench.limit(0)), quality_rules.line_frequency_rules(none), language_id.identify(none, F.lit(False)),
    ):
        assert df.count() == 0
    assert decontaminate.find_leaks(table(spark, [(1, "a b c d e")]), bench.limit(0)).count() == 0


def test_memo_is_bounded():
    m = Memo(lambda w: w * 2, 3)
    assert [m[i] for i in (1, 2, 3, 4, 1, 5, 6, 7)] == [2, 4, 6, 8, 2, 10, 12, 14] and len(m) <= 3 and len(m.old) <= 3
