"""Benchmark decontamination: n-gram hits, then Smith-Waterman alignment.

Every word n-gram of a test item is a seed, so any copy that keeps n words in a row is met. Where a document has a
seed, the item is aligned with the words around (match 2, mismatch -1, gap -1); the score is the best local
alignment's share of a perfect one's. The words around reach as far as an alignment of the threshold's score can.
Windows that have too few of the item's words for the threshold are left out before, which is exact. An item of fewer
than n words has no seed; it is found where it stands word for word, with score 1. (A copy in which no n words of the item
are left in a row, as when every third word is changed, isn't met by seeds of three; the tests measure the recall.)

The benchmark is the stated query set: its distinct texts go to the workers in blocks of about ``block`` n-grams, so any
size of it has bounded memory (an item is held whole), and all documents are read for each block. Found texts are joined
with the items that have them, so repeated items cost no more than their rows.

Words are the pieces between white space, lower-cased, without punctuation around them.

Defined results: null or empty texts and items match nothing. Repeated rows give repeated results; an item_id that comes
twice counts as two items. Null ids stay. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, documents, map_arrow, mix, shared_memo

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: The ASCII characters that EDGE takes.
ASCII_EDGE = bytes(c for c in range(128) if not chr(c).isalnum())
MATCH, OTHER = 2, 1
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_of(text: str) -> list[str]:
    return [w for w in (EDGE.sub("", x.decode()).lower() for x in text.encode().split()) if w]


class Items:
    """A block of the benchmark: the words' numbers (from 1) and the n-grams of the items."""

    def __init__(self, rows: list[tuple[tuple[int, int], str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.names = [i for i, _ in rows]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int64) for _, t in rows]
        self.codes = [grams(w, n)[1] for w in self.words]
        self.known = np.unique(np.concatenate(self.codes)) if self.codes else np.zeros(0, np.uint64)
        self.key = hash(tuple(self.names))
        # Items without a seed, by length: their only gram's code -> items.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < n:
                self.short.setdefault(len(w), {}).setdefault(int(grams(w, len(w))[1][0]), []).append(k)
        # Every n-gram's items and places, by n-gram.
        item = np.repeat(np.arange(len(self.codes)), [len(c) for c in self.codes])
        place = np.concatenate([np.arange(len(c)) for c in self.codes]) if self.codes else np.zeros(0, np.int64)
        number = np.searchsorted(self.known, np.concatenate(self.codes)) if self.codes else np.zeros(0, np.int64)
        order = np.argsort(number, kind="stable")
        self.all_item, self.all_place = item[order], place[order]
        self.all_at = np.searchsorted(number[order], np.arange(len(self.known) + 1))


def grams(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the n-grams without an unknown word (0)."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids > 0
    whole = known[: len(ids) - n + 1].copy()
    for k in range(1, n):
        whole &= known[k : len(ids) - n + 1 + k]
    at = np.flatnonzero(whole)
    code = np.zeros(len(at), np.uint64)
    for k in range(n):
        code += ids[at + k].astype(np.uint64) * np.uint64(FACTORS[k % len(FACTORS)] + 2 * k)
    return at, mix(code)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment of a with b, and where it ends in b (exclusive, the first such place)."""
    steps = np.arange(len(b), dtype=np.int64) * OTHER
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        cell = np.maximum(row[:-1] + np.where(b == x, MATCH, -OTHER), row[1:] - OTHER)
        cell = np.maximum.accumulate(np.maximum(cell, 0) + steps) - steps
        row[1:] = cell
        top = int(cell.max())
        if top > best:
            best, end = top, int(cell.argmax()) + 1
    return best, end


def windows(item: np.ndarray, begin: np.ndarray, items: Items, ids: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, int]]:
    """For hits (item, where it would begin), sorted: item, window, its first word.

    Each gap costs OTHER, so an alignment that reaches the threshold has at most ``slack`` of them and lies within its hit's window."""
    k = 0
    while k < len(item):
        i, first = int(item[k]), int(begin[k])
        own = items.words[i]
        slack = int(MATCH * len(own) * (1 - threshold) / OTHER) + 1
        last = first
        while k < len(item) and item[k] == i and begin[k] <= first + slack:
            last = int(begin[k])
            k += 1
        a, b = max(0, first - slack), min(len(ids), last + len(own) + slack)
        if _common(own, ids[a:b]) >= threshold * len(own):
            yield i, ids[a:b], a


def score(own: np.ndarray, window: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """Share of a perfect alignment, first and last word (exclusive) of the best local one, if it reaches the threshold."""
    perfect = MATCH * len(own)
    best, end = align(own, window)
    if best < threshold * perfect:
        return None
    _, back = align(own[::-1], window[:end][::-1])
    return best / perfect, end - back, end


def _found(ids: np.ndarray, items: Items, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """item, score, first and last word (exclusive) of the copies in a text, one for each window that has one."""
    for size, held in items.short.items():
        at, code = grams(ids, size)
        _, first = np.unique(code, return_index=True)
        for k in first.tolist():
            for i in held.get(int(code[k]), ()):
                yield i, 1.0, int(at[k]), int(at[k]) + size
    at, code = grams(ids, items.n)
    if not len(at) or not len(items.known):
        return
    number = np.minimum(np.searchsorted(items.known, code), len(items.known) - 1)
    hit = items.known[number] == code
    if not hit.any():
        return
    item, begin = _hits(at[hit], items.all_at[number[hit]], items.all_at[number[hit] + 1], items.all_item, items.all_place)
    for i, window, first in windows(item, begin, items, ids, threshold):
        found = score(items.words[i], window, threshold)
        if found:
            yield i, found[0], first + found[1], first + found[2]


def _hits(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """item and begin of all hits, by item and begin; each n-gram at ``at`` has the entries lo to hi."""
    many = hi - lo
    flat = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(at, many) - place[flat]
    order = np.lexsort((begin, item[flat]))
    return item[flat][order], begin[order]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection as multisets, an upper bound of the words that an alignment matches."""
    u, n = np.unique(a, return_counts=True)
    b = b[b > 0]
    at = np.minimum(np.searchsorted(u, b), len(u) - 1)
    m = np.bincount(at[u[at] == b], minlength=len(u))
    return int(np.minimum(n, m).sum())


def _reader(items: Items):
    """bytes of a text -> numbers of its words."""

    def make():
        number = {w.encode(): n.to_bytes(8, "little") for w, n in items.vocabulary.items()}.get
        none = bytes(8)

        def of(word: bytes) -> bytes:
            w = word.strip(ASCII_EDGE).lower() if word.isascii() else EDGE.sub("", word.decode()).lower().encode()
            return number(w, none) if w else b""

        return of

    look = shared_memo(f"benchmark {items.key}", make).__getitem__
    return lambda raw: np.frombuffer(b"".join(map(look, raw.split())), np.int64)


def _keyed(benchmark: DataFrame) -> DataFrame:
    """item_id, text, k1, k2: two hashes stand for a text."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("second"), "text"))


def blocks(docs: DataFrame, benchmark: DataFrame, n: int, block: int) -> Iterator[Broadcast]:
    """Broadcast ``Items`` of the distinct texts, a block at a time."""
    texts = _keyed(benchmark).select("k1", "k2", "text").distinct()
    size = texts.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-int(size) // block))
    for k in range(parts):
        own = texts.where(F.pmod("k1", F.lit(parts)) == k).orderBy("k1", "k2").collect() if parts > 1 else texts.orderBy("k1", "k2").collect()
        yield docs.sparkSession.sparkContext.broadcast(Items([((r["k1"], r["k2"]), r["text"]) for r in own], n))


FOUND = "doc_id long, k1 long, k2 long, score double, start_word long, end_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = 3, block: int = 500_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, score (0 to 1), start_word and end_word of the best copy, for all pairs of at least the threshold. Texts are read once for each block."""

    def run_of(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = broadcast.value
            read = _reader(items)
            for b in batches:
                raw, at = byte_rows(b.column("text"))
                rows = []
                for k, doc in enumerate(b.column("doc_id").to_pylist()):
                    best: dict[int, tuple[float, int, int]] = {}
                    for i, share, start, end in _found(read(raw[at[k] : at[k + 1]]), items, threshold):
                        best[i] = max(best.get(i, (0.0, 0, 0)), (share, -start, end))
                    rows += [(doc, *items.names[i], share, -start, end) for i, (share, start, end) in best.items()]
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in FOUND.split(", ")])

        return run

    out = None
    for items in blocks(docs, benchmark, n, block):
        found = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run_of(items), FOUND)
        out = found if out is None else out.unionByName(found)
    names = _keyed(benchmark).select("item_id", "k1", "k2")
    names = F.broadcast(names) if names.count() <= broadcast_rows else names.hint("merge")
    return out.join(names, ["k1", "k2"]).select("doc_id", "item_id", "score", "start_word", "end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, n: int = 3, block: int = 500_000) -> DataFrame:
    """The rows of docs that hold no item of the benchmark; all columns stay."""

    def run_of(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = broadcast.value
            read = _reader(items)
            for b in batches:
                raw, at = byte_rows(b.column("text"))
                yield b.filter(pa.array([next(_found(read(raw[at[k] : at[k + 1]]), items, threshold), None) is None for k in range(b.num_rows)], pa.bool_()))

        return run

    out = docs
    for items in blocks(docs, benchmark, n, block):
        out = map_arrow(out, run_of(items), docs.schema)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
