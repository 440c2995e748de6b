"""The dialogue of repeats.py without Spark, against brute force, also for crowded contexts and texts of low entropy."""

import hashlib
import random

import numpy as np
import pytest

from rippletrace.llm import repeats as R
from rippletrace.llm.chunks import pack_chunk, unsqueeze


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha256) of each row, rows in corpus order."""
    seen, out = set(), []
    for _, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            s = t[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def dialogue(chunks, buckets, crowd, many):
    def gather(asked):  # bucket -> [(chunk, bytes)] in the order of chunks
        by = {}
        for c, found in enumerate(asked):
            for b, x in found:
                by.setdefault(b, []).append((c, x))
        return by

    def reply(asked, f):
        got = [[] for _ in chunks]
        for b, found in sorted(gather(asked).items()):
            for (c, _), r in zip(found, f(b, [x for _, x in found])):
                got[c].append((b, r))
        return got

    first = reply([list(R._question(buckets, crowd)(c)) for c in chunks], lambda b, q: R._reply(q, many))
    state, second = [], []
    for k, c in enumerate(chunks):
        rows = R._second(buckets, crowd)(k, c, first[k]).to_pylist()
        state.append([(r["bucket"], unsqueeze(r["blob"])) for r in rows if r["bucket"] < 0])
        second.append([(r["bucket"], unsqueeze(r["blob"])) for r in rows if r["bucket"] >= 0])
    third = reply(second, lambda b, q: (R._combine if b < buckets else R._single)(q))
    out = []
    for k, c in enumerate(chunks):
        out += R._digest(c, *R._marks(c, buckets, third[k], state[k])).to_pylist()
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 7)))
    text = lambda n: b" ".join(word() for _ in range(n))
    passage, base = text(40), text(120)
    rows = []
    for i in range(60):
        kind = rng.randrange(9)
        t = [
            lambda: text(rng.randint(0, 90)),
            lambda: base,
            lambda: text(rng.randint(0, 30)) + passage + text(rng.randint(0, 30)),
            lambda: b" ".join(w if rng.random() > 0.05 else word() for w in base.split()),
            lambda: b"a" * rng.randint(90, 400),
            lambda: b"ab" * rng.randint(40, 200) + passage,
            lambda: b"\0" * rng.randint(0, 200) + passage[:150],
            lambda: passage[rng.randint(0, 60) :] + base[rng.randint(0, 300) :],
            lambda: b"",
        ][kind]()
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,crowd,buckets,many,part", [(1, 64, 3, 4096, 8192), (2, 1, 5, 4096, 8192), (3, 2, 1, 3, 8192), (4, 0, 4, 4096, 8192), (5, 64, 40, 4096, 8192), (6, 64, 1, 4096, 7), (7, 64, 2, 5, 1)])
def test_dialogue_equals_brute_force(monkeypatch, seed, crowd, buckets, many, part):
    """Contexts crowded in a chunk or only in all, and buckets taken in parts."""
    monkeypatch.setattr(R, "PART", part)
    rows = corpus(seed)
    chunks = [pack_chunk([i for i, _ in part], [len(t) for _, t in part], b"".join(t for _, t in part)) for part in (rows[k : k + 13] for k in range(0, len(rows), 13))]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dialogue(chunks, buckets, crowd, many)}
    ordered = sorted(rows)
    assert got == {i: b for (i, _), b in zip(ordered, brute(ordered))}


def test_dictionary_ranks_are_a_suffix_array():
    """Ranks order the suffixes of all phrases as their bytes do, each closed by its trigger's number."""
    rng = random.Random(5)
    phrases = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    ends = np.array([rng.randrange(3) for _ in phrases])
    rank, close = R.dictionary_ranks(phrases, ends)
    suffixes = [([x + 3 for x in p[k:]] + [int(e)], int(rank[c - (len(p) - k)])) for p, e, c in zip(phrases, ends, close) for k in range(len(p) + 1)]
    assert all((a < b) == (i < j) and (a == b) == (i == j) for a, i in suffixes for b, j in suffixes)


def test_parse_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (60, 8), dtype=np.uint8)
    rank, common = R.sorted_rows(rows)
    by = [rows[i].tolist() for i in np.argsort(rank)]
    prefix = lambda a, b: next((k for k in range(8) if a[k] != b[k]), 8)
    assert by == sorted(by) and common.tolist() == [0, *(prefix(a, b) for a, b in zip(by, by[1:]))]
    lo, hi = np.array([0, 3, 10, 0]), np.array([1, 9, 59, 59])
    assert R._least_between(common, lo, hi).tolist() == [min(common[a + 1 : b + 1]) for a, b in zip(lo, hi)]


def test_an_edge_of_few_phrases_in_each_of_many_chunks():
    """A passage behind another text in every document: each chunk has few phrases of its trigger context, all together many."""
    rng = random.Random(8)
    word = lambda: bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 7)))
    text = lambda n: b" ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, text(rng.randint(5, 30)) + passage + text(rng.randint(5, 30))) for i in range(90)]
    chunks = [pack_chunk([i for i, _ in part], [len(t) for _, t in part], b"".join(t for _, t in part)) for part in (rows[k : k + 3] for k in range(0, len(rows), 3))]
    for many in (20, 4096):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dialogue(chunks, 4, 16, many)}
        assert got == {i: b for (i, _), b in zip(rows, brute(rows))}
