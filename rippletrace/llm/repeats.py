"""Exact removal of repeated byte strings (suffix-array deduplication by prefix-free parsing).

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller doc_id, or in the same
document before. Strings are those of the input; they may overlap; matches never cross documents.

Parsing. A rolling hash runs over all windows of ``WINDOW`` bytes. The trigger of a start p is the window with the least
hash (the first among equals) of those that begin in the ``SPAN`` bytes from p on. It lies inside the string at p and
depends on that string alone, so equal strings have the same trigger at the same distance. (A trigger by the hash's
remainder would leave phrases of any length in even text; the least hash bounds them by SPAN.) Successive starts with
one trigger form a phrase, which ends in its trigger; the phrases are the dictionary, their sequence is the parse.

1. Dictionary. Chunks of documents ask buckets of trigger contexts for each distinct phrase with what its strings cover of
   the parse behind it. One that occurs earlier goes with all its starts: highly repetitive text ends here, at a few
   bytes a phrase. A first occurrence whose trigger context no other phrase has is unique: it stays.
2. Corpus order. First occurrences that share a trigger context meet in a bucket. It builds the suffix array of its part
   of the dictionary (``dictionary_ranks``: prefix doubling over the phrases, each ended by its trigger) and that of
   the parse behind their triggers (``sorted_rows``, with common prefix lengths). A start's place in corpus order
   is that of its phrase's suffix, and among equal suffixes that of the parse behind; so sorting by both ranks gives
   the suffix array of the corpus, and neighbours in it with a common prefix of LENGTH bytes are equal strings. Of each
   run of them the first of the corpus stays.
3. A trigger context with more than ``CROWD`` phrases in one chunk, or ``MANY`` in all (the edge of a passage that a great
   many documents share), would gather without bound; its starts are asked one by one, by the hash of their string, of
   buckets that these hashes spread over. So a context sends at most CROWD entries a chunk to its bucket in step 1, at
   most MANY in all in step 2, and a string one entry a chunk in step 3.

What a chunk holds more than once it asks once, so a passage in a third of all documents is one entry a chunk.
Phrases and strings are compared by 64-bit hashes in 1 and 3, and byte by byte in 2.

Memory: a worker holds a chunk (``layout``; at least the longest document) some ten times, or a bucket's questions.

Defined results: null text is empty. Rows that share a doc_id count as documents one after another, ordered by a hash of
their text, whatever the table's layout (rows alike in both are the same); so do null ids, after all others. Texts
under LENGTH bytes stay whole. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .chunks import NULL_ID, answer, ask, by_bucket, chunked, extra_of, layout_of, open_chunk, place, planes, ranks_of, rows_of, rows_of_chunk, squeeze, told, unplanes
from .common import documents, durable, mix

LENGTH, WINDOW, SPAN = 100, 12, 64
CORE = LENGTH - SPAN + 1
BLOCK = 1 << 19
CROWD, MANY = 16, 4096
PART = 1 << 13
B = 0xD1342543DE82EF95
ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of B, of its inverse modulo 2^64, and a random 64-bit number for each byte."""
    n = BLOCK + 2 * (LENGTH + SPAN) + 2
    up, down = np.full(n, B, np.uint64), np.full(n, pow(B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), mix(np.arange(1, 257, dtype=np.uint64))


class Hashes:
    """Hashes of the substrings of some bytes."""

    def __init__(self, b: np.ndarray):
        self.up, down, table = _powers()
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[b] * down[: len(b)], dtype=np.uint64)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.up[lo] + (hi - lo).astype(np.uint64) * ODD)


def _triggers(h: Hashes, starts: int) -> np.ndarray:
    """The trigger of each of the first ``starts`` places; the bytes reach LENGTH beyond."""
    n = starts + SPAN - 1
    v = mix((h.sums[WINDOW : n + WINDOW] - h.sums[:n]) * h.up[:n])  # the rolling hash of the window at each place
    v = (v & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    k = 1
    while k < SPAN:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Parse:
    """The phrases of a chunk in corpus order: lo and hi (first and last start), trigger, text hash, context hash, doc."""

    def __init__(self, blob: bytes, crowd: int):
        self.ids, self.at, self.raw = open_chunk(blob)
        self.ranks = ranks_of(blob)
        rows = np.lexsort((self.ranks, self.ids))
        parts = [p for r in rows for p in self._document(int(self.at[r]), int(self.at[r + 1]), int(r))]
        self.lo, self.hi, self.trigger, self.text, self.context, self.row = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
        self.doc, self.rank = self.ids[self.row], self.ranks[self.row]
        # What occurs earlier in this chunk is known to go.
        order = np.argsort(self.text, kind="stable")
        again = np.zeros(len(order), bool)
        again[order[1:]] = self.text[order[1:]] == self.text[order[:-1]]
        self.again = again
        # Contexts with many phrases.
        first = np.flatnonzero(~again)
        c, inverse, n = np.unique(self.context[first], return_inverse=True, return_counts=True)
        self.crowded = np.zeros(len(order), bool)
        self.crowded[first] = (n > crowd)[inverse] if len(c) else False

    def _document(self, begin: int, end: int, row: int) -> Iterator[tuple]:
        last = end - LENGTH + 1  # after the last start
        for s in range(begin, last, BLOCK):
            e = min(last, s + BLOCK)
            b = np.frombuffer(self.raw, np.uint8, min(end, e + LENGTH + SPAN) - s, s)
            h = Hashes(b)
            t = _triggers(h, e - s)
            lo = np.concatenate([[0], np.flatnonzero(np.diff(t)) + 1])
            hi = np.concatenate([lo[1:], [e - s]]) - 1
            t = t[lo]
            yield lo + s, hi + s, t + s, h.of(lo, hi + LENGTH), h.of(t, t + CORE), np.full(len(lo), row)

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases to ask for, in the order of buckets (corpus order within one), with bucket and more bits. Of a crowded context only one phrase goes, as a notice."""
        plain = np.flatnonzero(~self.again & ~self.crowded)
        full = np.flatnonzero(self.crowded)
        notice = full[np.unique(self.context[full], return_index=True)[1]] if len(full) else full
        which = np.concatenate([plain, notice])
        bucket, rest = place(self.context[which], buckets)
        order = np.lexsort((which, bucket))
        return which[order], bucket[order], rest[order]

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All starts of some phrases, in corpus order, with the hash of their string and their row."""
        size = self.hi[which] - self.lo[which] + 1
        starts = np.repeat(self.lo[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hashes = np.empty(len(starts), np.uint64)
        rows = np.searchsorted(self.at, starts, side="right") - 1
        order = np.argsort(starts, kind="stable")
        for lo in range(0, len(self.raw), BLOCK):
            part = order[np.searchsorted(starts[order], lo) : np.searchsorted(starts[order], lo + BLOCK)]
            if len(part):
                h = Hashes(np.frombuffer(self.raw, np.uint8, min(len(self.raw) - lo, BLOCK + LENGTH), lo))
                hashes[part] = h.of(starts[part] - lo, starts[part] - lo + LENGTH)
        return starts, hashes, rows


def _question(buckets: int, crowd: int):
    def question(blob: bytes) -> Iterator[tuple[int, bytes]]:
        p = Parse(blob, crowd)
        which, bucket, rest = p.asked(buckets)
        for b, part in by_bucket(bucket):
            w = which[part]
            flag = p.crowded[w].astype(np.uint8)
            yield b, np.int64(len(w)).tobytes() + flag.tobytes() + planes(p.doc[w]) + planes(p.rank[w]) + planes(rest[part]) + p.text[w].tobytes()

    return question


def _corpus_order(doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of entries that come by chunk and then by place."""
    return np.lexsort((rank, doc)) if rank.any() else np.argsort(doc, kind="stable")


def _later(key: np.ndarray, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether an entry with the same key comes before in corpus order."""
    order = _corpus_order(doc, rank)
    order = order[np.argsort(key[order], kind="stable")]
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    return later


GOES, SHARED, CROWDED = 1, 2, 3


def _reply(questions: list[bytes], many: int = MANY) -> list[bytes]:
    """For each phrase: 0 unique, GOES, SHARED (first, but its context has other phrases) or CROWDED."""
    sizes, flags, docs, ranks, rests, texts = [], [], [], [], [], []
    for q in questions:
        n = int(np.frombuffer(q, np.int64, 1)[0])
        sizes.append(n)
        flags.append(np.frombuffer(q, np.uint8, n, 8))
        docs.append(unplanes(q[8 + n :], np.int64, n))
        ranks.append(unplanes(q[8 + 9 * n :], np.int64, n))
        rests.append(unplanes(q[8 + 17 * n :], np.uint32, n))
        texts.append(np.frombuffer(q[8 + 21 * n :], np.uint64, n))
    flag, doc, rank, rest, text = (np.concatenate(x) for x in (flags, docs, ranks, rests, texts))
    # The same bits of the context are part of the key: the phrase alone would do.
    later = _later(text, doc, rank)
    out = np.where(later, GOES, 0).astype(np.uint8)
    first = np.flatnonzero(~later)
    c, inverse, n = np.unique(rest[first], return_inverse=True, return_counts=True)
    out[first[n[inverse] > 1]] = SHARED
    crowded = np.union1d(rest[flag > 0], c[n > many])
    out[np.isin(rest, crowded)] = CROWDED
    ends = np.cumsum(sizes)
    return [out[e - n : e].tobytes() for e, n in zip(ends, sizes)]


def _second(buckets: int, crowd: int):
    """What a chunk knows after the first answers (bucket -1), its questions about shared contexts (buckets from 0) and about single strings (from ``buckets``)."""

    def use(chunk: int, blob: bytes, answers: list[tuple[int, bytes]]) -> pa.Table:
        p = Parse(blob, crowd)
        which, _, _ = p.asked(buckets)
        said = np.frombuffer(b"".join(a for _, a in answers), np.uint8)
        code = np.zeros(len(p.lo), np.uint8)
        code[which] = said
        code[p.crowded] = CROWDED
        code[p.again] = GOES
        gone = np.flatnonzero(code == GOES)
        shared = np.flatnonzero(code == SHARED)
        bucket, _ = place(p.context[shared], buckets)
        shared = shared[np.argsort(bucket, kind="stable")]
        out: list[tuple[int, bytes]] = []
        b = np.frombuffer(p.raw, np.uint8)
        for n, part in by_bucket(np.sort(bucket)):
            w = shared[part]
            left, right = _contexts(b, p.trigger[w], p.lo[w])
            spans = np.stack([p.trigger[w] - p.lo[w], p.trigger[w] - p.hi[w]]).astype(np.uint8)
            out.append((n, np.int64(len(w)).tobytes() + spans.tobytes() + planes(p.doc[w]) + planes(p.rank[w]) + left.tobytes() + right.tobytes()))
        starts, hashes, rows = p.strings(np.flatnonzero(code == CROWDED))
        own = _later(hashes, p.ids[rows], p.ranks[rows])
        single_bucket, _ = place(hashes, buckets)
        ask_for = np.flatnonzero(~own)
        ask_for = ask_for[np.argsort(single_bucket[ask_for], kind="stable")]
        for n, part in by_bucket(single_bucket[ask_for]):
            w = ask_for[part]
            out.append((buckets + n, np.int64(len(w)).tobytes() + planes(p.ids[rows[w]]) + planes(p.ranks[rows[w]]) + hashes[w].tobytes()))
        known = [np.stack([p.lo[gone], p.hi[gone]]), np.stack([starts[own], starts[own]]), np.stack([p.lo[shared], p.hi[shared]]), np.stack([p.trigger[shared], p.trigger[shared]]), np.stack([starts[ask_for], starts[ask_for]])]
        head = np.array([k.shape[1] for k in known], np.int64).tobytes()
        out.append((-1, head + b"".join(np.ascontiguousarray(k).tobytes() for k in known)))
        return rows_of([chunk] * len(out), [x for x, _ in out], [squeeze(x) for _, x in out])

    return use


def _contexts(b: np.ndarray, trigger: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SPAN - 1 bytes before each trigger from it backwards (0 before the phrase), and the LENGTH bytes from it on (0 after the end)."""
    back = trigger[:, None] - 1 - np.arange(SPAN - 1)
    left = np.where(back >= lo[:, None], b[np.maximum(back, 0)], 0).astype(np.uint8)
    on = trigger[:, None] + np.arange(LENGTH)
    right = np.where(on < len(b), b[np.minimum(on, len(b) - 1)], 0).astype(np.uint8)
    return left, right


def sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each byte row in lexicographic order, and by rank the common prefix length with the row before (0 for the first).

    For what follows triggers these are the suffix array of the parse and its common prefixes, as far as LENGTH bytes reach."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{width}").reshape(n), kind="stable")
    ordered = rows[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, np.concatenate([[0], common])


def dictionary_ranks(phrases: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary, as the rank of every suffix of its text, and the place of each phrase's end in that text.

    The text is the phrases one after another, each closed by its trigger, which ``ends`` numbers; two suffixes have the
    same rank if their phrases' bytes from there on and their triggers are equal. Prefix doubling: ranks by 1, 2, 4, ... symbols."""
    size = np.fromiter(map(len, phrases), np.int64, len(phrases)) + 1
    close = np.cumsum(size) - 1
    rank = np.frombuffer(b"\0".join(phrases) + b"\0", np.uint8).astype(np.int64) + len(ends) + 1
    rank[close] = ends + 1  # below all bytes
    end = np.repeat(close, size)
    here = np.arange(len(rank))
    k = 1
    while k < size.max():
        ahead = here + k
        inside = ahead <= end
        key = rank * (rank.max() + 1)
        key[inside] += rank[ahead[inside]]
        rank = np.unique(key, return_inverse=True)[1] + 1
        k *= 2
    return rank, close


def _least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of x[lo + 1 .. hi] (lo < hi), by minima over powers of two."""
    levels = [x]
    while 2 << (len(levels) - 1) <= len(x):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    level = np.frexp(hi - lo)[1] - 1
    out = np.empty(len(lo), x.dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(levels[k][lo[own] + 1], levels[k][hi[own] + 1 - (1 << k)])
    return out


def repeated_starts(left: np.ndarray, right: np.ndarray, least: np.ndarray, most: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """For each phrase's starts (by rising start), whether their string is also that of a start of lower corpus rank.

    ``left``: bytes before the trigger, backwards; ``right``: LENGTH bytes from it on; starts lie ``most`` to ``least`` bytes before it."""
    n = len(left)
    contexts = np.unique(np.ascontiguousarray(right[:, :CORE]).view(f"V{CORE}").reshape(n), return_inverse=True)[1].reshape(n)
    forward = np.ascontiguousarray(left[:, ::-1])
    of_suffix, close = dictionary_ranks([forward[i, SPAN - 1 - m :].tobytes() for i, m in enumerate(most.tolist())], contexts)
    of_parse, common = sorted_rows(right)
    size = most - least + 1
    begin = np.cumsum(size) - size
    entry = np.repeat(np.arange(n), size)
    before = np.repeat(most, size) - (np.arange(size.sum()) - np.repeat(begin, size))
    suffix = of_suffix[np.repeat(close, size) - before]
    order = np.lexsort((of_parse[entry], suffix))  # the suffix array of the corpus
    a, b = order[:-1], order[1:]
    same = suffix[a] == suffix[b]
    x, y = of_parse[entry[a[same]]], of_parse[entry[b[same]]]
    same[same] = _least_between(common, x, y) >= LENGTH - before[b[same]] if len(x) else False
    run = np.concatenate([[0], np.cumsum(~same)])
    corpus = rank[entry[order]]
    first = np.minimum.reduceat(corpus, np.flatnonzero(np.concatenate([[True], ~same])))
    later = np.empty(len(order), bool)
    later[order] = corpus != first[run]
    return np.split(later, begin[1:])


def _combine(questions: list[bytes]) -> list[bytes]:
    """For each start of each phrase (by rising start), whether its string occurs earlier. Whole contexts are taken some thousand phrases at a time."""
    sizes, spans, docs, ranks, lefts, rights = [], [], [], [], [], []
    for q in questions:
        n = int(np.frombuffer(q, np.int64, 1)[0])
        sizes.append(n)
        spans.append(np.frombuffer(q, np.uint8, 2 * n, 8).reshape(2, n))
        docs.append(unplanes(q[8 + 2 * n :], np.int64, n))
        ranks.append(unplanes(q[8 + 10 * n :], np.int64, n))
        at = 8 + 18 * n
        lefts.append(np.frombuffer(q, np.uint8, n * (SPAN - 1), at).reshape(n, SPAN - 1))
        rights.append(np.frombuffer(q, np.uint8, n * LENGTH, at + n * (SPAN - 1)).reshape(n, LENGTH))
    most, least = np.concatenate(spans, axis=1).astype(np.int64)
    doc, left, right = np.concatenate(docs), np.concatenate(lefts), np.concatenate(rights)
    n = len(doc)
    corpus = np.empty(n, np.int64)
    corpus[_corpus_order(doc, np.concatenate(ranks))] = np.arange(n)
    context = np.ascontiguousarray(right[:, :CORE]).view(f"V{CORE}").reshape(n)
    order = np.argsort(context, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], context[order[1:]] != context[order[:-1]]]))
    flat: list[np.ndarray | None] = [None] * n
    lo = 0
    while lo < n:  # up to the last context that begins within PART phrases, or one context
        k = np.searchsorted(new, lo + PART, side="right") - 1
        hi = n if lo + PART >= n else int(new[k]) if new[k] > lo else int(new[k + 1]) if k + 1 < len(new) else n
        part = order[lo:hi]
        for i, later in zip(part.tolist(), repeated_starts(left[part], right[part], least[part], most[part], corpus[part])):
            flat[i] = later
        lo = hi
    ends = np.cumsum(sizes)
    return [np.packbits(np.concatenate(flat[e - k : e])).tobytes() for e, k in zip(ends, sizes)]


def _single(questions: list[bytes]) -> list[bytes]:
    sizes = [int(np.frombuffer(q, np.int64, 1)[0]) for q in questions]
    doc, rank = (np.concatenate([unplanes(q[8 + 8 * k * n :], np.int64, n) for q, n in zip(questions, sizes)]) for k in (0, 1))
    key = np.concatenate([np.frombuffer(q, np.uint64, n, 8 + 16 * n) for q, n in zip(questions, sizes)])
    later = _later(key, doc, rank)
    ends = np.cumsum(sizes)
    return [np.packbits(later[e - n : e]).tobytes() for e, n in zip(ends, sizes)]


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _marks(blob: bytes, buckets: int, answers: list[tuple[int, bytes]], state: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """ids, offsets and bytes of a chunk, and which bytes go."""
    ids, at, raw = open_chunk(blob)
    known, begin = [], 40
    for n in np.frombuffer(state[0][1], np.int64, 5):
        known.append(np.frombuffer(state[0][1], np.int64, 2 * int(n), begin).reshape(2, int(n)))
        begin += 16 * int(n)
    gone, own, shared, trigger, asked = known
    pieces = [gone, own]
    size = shared[1] - shared[0] + 1
    if len(size):
        bucket, _ = place(_context_hash(raw, trigger[0]), buckets)
        each = dict(answers)
        starts = np.repeat(shared[0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        later = np.concatenate([_bits(each[n], int(size[part].sum())) for n, part in by_bucket(bucket)])
        pieces.append(np.stack([starts[later]] * 2))
    if asked.shape[1]:
        h = _string_hash(raw, asked[0])
        bucket, _ = place(h, buckets)
        each = dict(answers)
        later = np.concatenate([_bits(each[buckets + n], part.stop - part.start) for n, part in by_bucket(bucket)])
        pieces.append(asked[:, later])
    lo, hi = np.concatenate(pieces, axis=1)
    change = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(hi + LENGTH, minlength=len(raw) + 1)
    return ids, at, raw, np.cumsum(change)[:-1] > 0


def _context_hash(raw: bytes, at: np.ndarray) -> np.ndarray:
    return _hash_at(raw, at, CORE)


def _string_hash(raw: bytes, at: np.ndarray) -> np.ndarray:
    return _hash_at(raw, at, LENGTH)


def _hash_at(raw: bytes, at: np.ndarray, size: int) -> np.ndarray:
    out = np.empty(len(at), np.uint64)
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    for lo in range(0, len(raw), BLOCK):
        part = order[np.searchsorted(ordered, lo) : np.searchsorted(ordered, lo + BLOCK)]
        if len(part):
            h = Hashes(np.frombuffer(raw, np.uint8, min(len(raw) - lo, BLOCK + size), lo))
            out[part] = h.of(at[part] - lo, at[part] - lo + size)
    return out


def _text_rank(docs: DataFrame) -> Column | None:
    """A hash of the text for rows whose id is null or comes again, else 0; None if all ids are there once."""
    again = durable(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").select("doc_id"))
    return None if again.isEmpty() else F.xxhash64(F.coalesce("text", F.lit("")))


def marked(docs: DataFrame, use, schema, extra: list[str] | None = None, crowd: int = CROWD, many: int = MANY, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``use(blob, ids, offsets, bytes, gone)`` for each chunk of the documents. ``sizes``: bytes of a chunk and number of buckets, else by ``layout``."""
    chunk_bytes, buckets = sizes or layout_of(docs)
    chunks = chunked(docs, chunk_bytes, extra, _text_rank(docs))
    first = answer(ask(chunks, _question(buckets, crowd)), lambda questions: _reply(questions, many))
    second = durable(told(chunks, [first], _second(buckets, crowd), "chunk long, bucket long, blob binary"))

    def reply(key, questions: list[bytes]) -> list[bytes]:
        return (_combine if key < buckets else _single)(questions)

    third = answer(second.where("bucket >= 0"), reply, with_key=True)
    state = second.where("bucket < 0")

    def finish(chunk: int, blob: bytes, state: list, answers: list) -> pa.Table:
        return use(blob, *_marks(blob, buckets, answers, state))

    return told(chunks, [state, third], finish, schema)


def _digest(blob: bytes, ids: np.ndarray, at: np.ndarray, raw: bytes, gone: np.ndarray) -> pa.Table:
    b = np.frombuffer(raw, np.uint8)
    total = np.concatenate([[0], np.cumsum(gone)])
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    inner = at[:-1][at[:-1] < len(raw)]
    rise[inner] = gone[inner]
    rises = np.concatenate([[0], np.cumsum(rise)])
    kept = [hashlib.sha256(b[at[k] : at[k + 1]][~gone[at[k] : at[k + 1]]].tobytes()).hexdigest() for k in range(len(ids))]
    return pa.table(
        [pa.array(ids, mask=ids == NULL_ID), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(rises[at[1:]] - rises[at[:-1]]), pa.array(kept, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def repeat_digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return marked(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **how)


def without_repeats(docs: DataFrame, count: str | None = None) -> DataFrame:
    """The rows with repeated strings cut out of ``text`` (a character that a cut splits goes whole); all columns stay. ``count`` adds a column of that name with the bytes that went; the table must not have it yet."""
    if count in docs.columns:
        raise ValueError(f"the table has a column {count}")
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    names, schema = docs.columns, docs.schema
    id_type = to_arrow_type(schema["doc_id"].dataType)

    def cleaned(blob: bytes, ids: np.ndarray, at: np.ndarray, raw: bytes, gone: np.ndarray) -> pa.Table:
        b, null = np.frombuffer(raw, np.uint8), extra_of(blob)[1]
        texts = [None if null[k] else b[at[k] : at[k + 1]][~gone[at[k] : at[k + 1]]].tobytes().decode("utf-8", "ignore").encode() for k in range(len(ids))]
        out = rows_of_chunk(blob, names, texts)
        out = out.set_column(names.index("doc_id"), "doc_id", out.column("doc_id").cast(id_type))
        total = np.concatenate([[0], np.cumsum(gone)])
        return out.append_column(count, pa.array(total[at[1:]] - total[at[:-1]])) if count else out

    return marked(docs, cleaned, StructType([*schema.fields, StructField(count, LongType())] if count else schema.fields), extra)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(documents(spark, sf_dir))
