"""Exact Jaccard self-join over word shingles: a size-aware heavy-light join, and the classes that its links form.

Two documents link when their sets of word shingles have a Jaccard similarity of ``num / den`` or more.

1. Chunks of documents ask buckets of shingle hashes how many distinct sets hold each shingle (an upper bound from 24
   bits past the bucket: it can only be too high, which costs time and loses nothing). A shingle of one set cannot be
   shared, so a set needs enough others; most sets end here.
2. Light (small) sets list their fixed-size subsets: for each size that a partner may have, all subsets as large as
   the overlap that this pair of sizes must reach. Equal subsets prove a link, so nothing is verified.
3. Heavy (large) sets are put on the inverted lists of the rarest shingles that they must share (prefix rule), and the
   lists are scanned. The boundary is the size up to which the subsets of a set cost less than its share of list
   entries and verifications, from the mean list length that step 1 measured.
4. A list of up to ``short`` sets gives all pairs that sizes and positions allow. A longer list, as a group of
   thousands of near copies makes, gives first the pairs with its most central set, whose exact verification joins
   nearly the whole group; then, while it still holds sets of different classes, the pairs of such sets with one
   centre of another class, and then with 64, 4096, ... more centres (by hash), until all of the list have been
   centres. Pairs inside a class need no look, as they can't change it, so a class is whole without listing its pairs;
   a centre has been compared with all of its list and leaves it.

Equal sets are one entry (identity: size and a 64-bit sum of mixed shingle hashes); shingles are 64-bit hashes.

Defined results: null or empty text, or white space only, is an empty set, in a class of its own. Repeated rows are
equal sets. A null doc_id has a class like any other row, but names one only if the class has no other id. Rows that
share a doc_id are documents each, and name the same class only if they are linked. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import NULL_ID, answer, ask, by_bucket, chunked, layout_of, open_chunk, place, planes, rows_with, told, unplanes
from .common import documents, durable, grouped, map_arrow, mix, shared_memo
from .components import components

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
NUM, DEN = 3, 4
LISTED = "kind int, key long, fp long, n int, pos int, doc_id long, tokens binary"


def _word_hash():
    import xxhash

    return lambda w: xxhash.xxh3_64_digest(w)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text; A-Z count as a-z. Fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(shared_memo("word hashes", _word_hash).__getitem__, words)), np.uint64)
    odd = ODD if size <= len(ODD) else mix(np.arange(1, size + 1, dtype=np.uint64))
    k = min(size, len(h))
    total = h[: len(h) - k + 1] * odd[0]
    for i in range(1, k):
        total = total + h[i : len(h) - k + 1 + i] * odd[i]
    return np.unique(mix(total + np.uint64(k)))


def identity(tokens: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    total = int(mix(tokens ^ ODD[0]).sum(dtype=np.uint64)) + len(tokens) * int(ODD[1])
    return int(mix(np.array([total & (2**64 - 1)], np.uint64))[0].astype(np.int64))


def least_size(n: int) -> int:
    return -(-NUM * n // DEN)


def overlap(n: int, m: int) -> int:
    return -(-NUM * (n + m) // (NUM + DEN))


def partner_sizes(n: int) -> range:
    return range(least_size(n), DEN * n // NUM + 1)


def subset_cost(n: int) -> int:
    return sum(comb(n, overlap(n, m)) for m in partner_sizes(n))


def boundary(mean_list: float, verify: float = 8.0, most: int = 16) -> int:
    """The largest size whose subsets cost less than its entries on inverted lists with the pairs that these bring."""
    heavy = lambda n: (n - least_size(n) + 1) * (1 + mean_list * verify)
    return max((n for n in range(1, most + 1) if subset_cost(n) <= heavy(n)), default=0)


def _sets(blob: bytes, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    ids, at, raw = open_chunk(blob)
    for k in range(len(ids)):
        tokens = shingle_set(raw[at[k] : at[k + 1]], size)
        yield int(ids[k]), identity(tokens) if len(tokens) else 0, tokens


def _distinct_tokens(blob: bytes, size: int) -> tuple[list, np.ndarray, np.ndarray]:
    sets = list(_sets(blob, size))
    once = {fp: t for _, fp, t in sets if len(t)}
    tokens, counts = np.unique(np.concatenate(list(once.values())), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return sets, tokens, counts


def _question(size: int, buckets: int):
    def question(blob: bytes) -> Iterator[tuple[int, bytes]]:
        _, tokens, counts = _distinct_tokens(blob, size)
        bucket, rest = place(tokens, buckets)
        many = np.minimum(counts, 255).astype(np.uint8)
        for b, part in by_bucket(bucket):
            yield b, planes(rest[part])[: 3 * (part.stop - part.start)] + many[part].tobytes()

    return question


def _reply(questions: list[bytes]) -> list[bytes]:
    """A class of frequency for each entry: 0 for one set, else the bits of the number of sets."""
    sizes = [len(q) // 4 for q in questions]
    rest = np.concatenate([unplanes(q[: 3 * n] + bytes(n), np.uint32, n) for q, n in zip(questions, sizes)])
    many = np.concatenate([np.frombuffer(q, np.uint8, n, 3 * n) for q, n in zip(questions, sizes)]).astype(np.int64)
    order = np.argsort(rest, kind="stable")
    new = np.concatenate([[True], np.diff(rest[order]) != 0]) if len(rest) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    total = np.add.reduceat(many[order], begins) if len(begins) else np.zeros(0, np.int64)
    level = np.where(total == 1, 0, np.ceil(np.log2(np.maximum(total, 1))) + 1).astype(np.uint8)
    out = np.empty(len(rest), np.uint8)
    out[order] = level[np.cumsum(new) - 1] if len(rest) else level
    ends = np.cumsum(sizes)
    return [out[e - n : e].tobytes() for e, n in zip(ends, sizes)]


def _subset_keys(tokens: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Hash of each subset that a partner of some size must share, with the smaller of both sizes."""
    mixed = [int(x) for x in mix(tokens)]
    mask = (1 << 64) - 1
    for m in partner_sizes(n):
        lo, hi, c = min(n, m), max(n, m), overlap(n, m)
        salt = (lo << 32 | hi) * 0x9E3779B97F4A7C15
        for subset in combinations(mixed, c):
            yield int(mix(np.array([(sum(subset) + salt) & mask], np.uint64))[0].astype(np.int64)), lo


def _listing(size: int, light: int):
    """Rows of kind 0: entry on an inverted list; 1: subset of a light set; 2: the shared shingles of a candidate; 3: document (key: its chunk, pos: its place there)."""

    def use(chunk: int, blob: bytes, answers: list[tuple[int, bytes]]) -> pa.Table:
        sets, tokens, _ = _distinct_tokens(blob, size)
        level = np.frombuffer(b"".join(a for _, a in answers), np.uint8)
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        blobs: list[bytes | None] = []

        def put(kind: int, key, fp: int, n: int, pos, doc=NULL_ID, own: bytes | None = None) -> None:
            k = len(key)
            for c, v in zip(cols, (np.full(k, kind), np.asarray(key, np.int64), np.full(k, fp), np.full(k, n), np.asarray(pos), np.full(k, doc))):
                c.append(v)
            blobs.extend([own] * k)

        seen = set()
        for at, (doc, fp, own) in enumerate(sets):
            n = len(own)
            put(3, [chunk], fp, n, [at], doc)
            if not n or fp in seen:
                continue
            seen.add(fp)
            of = level[np.searchsorted(tokens, own)]
            shared = np.count_nonzero(of)
            if shared < least_size(n):
                continue
            order = np.argsort(of, kind="stable")  # rarest first, then by hash: one order for all sets
            kept = own[order[n - shared :]]
            if n <= light:
                keys = list(_subset_keys(own[of > 0], n))
                put(1, [k for k, _ in keys], fp, n, [lo for _, lo in keys])
            if max(partner_sizes(n)) > light:
                prefix = n - least_size(n) + 1
                entries = own[order[n - shared : prefix]]
                put(0, entries.view(np.int64), fp, n, np.arange(n - shared, prefix))
                put(2, [0], fp, n, [0], own=np.sort(kept).tobytes())
        flat = [np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(cols, (np.int32, np.int64, np.int64, np.int32, np.int32, np.int64))]
        arrays = [pa.array(x) for x in flat[:5]] + [pa.array(flat[5], mask=flat[5] == NULL_ID), pa.array(blobs, pa.binary())]
        return pa.table(arrays, names=["kind", "key", "fp", "n", "pos", "doc_id", "tokens"])

    return use


def _possible(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles that share the one at places i and j can link: sizes, and the prefix of this pair of sizes."""
    need = F.floor((NUM * (n + m) + NUM + DEN - 1) / F.lit(NUM + DEN))
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (i <= n - need) & (j <= m - need)


def _pairs(df: DataFrame, other: str) -> DataFrame:
    return df.select(F.least("fp", other).alias("a"), F.greatest("fp", other).alias("b")).distinct()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column("ta"), b.column("tb")
        size = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
        keep = []
        for k in range(b.num_rows):
            x, y = (np.frombuffer(v[k].as_buffer(), np.uint64) for v in (a, c))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = np.count_nonzero(both[1:] == both[:-1])
            keep.append(common * (NUM + DEN) >= NUM * size[k])
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by the exact overlap."""
    a = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ta", "tb"), _overlaps, "a long, b long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.withColumnRenamed("root", "found")
    return rows.join(named, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("found", "fp")).drop("node", "found")


class Classes:
    """The durable chunks of the documents, a row for each document (doc_id, fp, n, key, pos), and the root of each set that isn't its own."""

    def __init__(self, chunks: DataFrame, rows: DataFrame, roots: DataFrame):
        self.chunks, self.rows, self.roots = chunks, rows, roots

    def best(self) -> DataFrame:
        """root, p: the document that names each class (doc_id, nulls last, then its set and place)."""
        first = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("fp").alias("set"), "key", "pos", "doc_id")
        of_set = self.rows.where("n > 0").groupBy("fp").agg(F.min(first).alias("p"))
        self.named = _rooted(of_set, self.roots)
        return grouped(self.named, "root", F.min("p").alias("p"))


def _classes(docs: DataFrame, size: int, short: int, extra: list[str] | None = None, sizes: tuple[int, int] | None = None) -> Classes:
    chunk_bytes, buckets = sizes or layout_of(docs)
    chunks = chunked(docs, chunk_bytes, extra)
    answers = durable(answer(ask(chunks, _question(size, buckets)), _reply))
    light = boundary(_mean_list(answers))
    listed = durable(told(chunks, [answers], _listing(size, light), LISTED))
    sets = listed.where("kind = 2").groupBy("fp").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))

    # Light sets: an equal subset proves the link to the least set of the smaller size.
    subsets = listed.where("kind = 1").select("key", "fp", "n", F.col("pos").alias("lo")).distinct()
    first = grouped(subsets, "key", F.min(F.struct("n", "fp")).alias("p"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"), "p")
    links = subsets.join(first.hint("merge"), F.col("key") == F.col("k")).where("p.n = lo and p.fp != fp").select(F.col("p.fp").alias("a"), F.col("fp").alias("b")).distinct()

    # Heavy sets: inverted lists with their number of sets and most central set.
    entries = listed.where("kind = 0").groupBy("key", "fp").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    heads = grouped(entries, "key", F.count("*").alias("c"), F.min(F.struct("pos", "n", "fp")).alias("p")).where("c > 1")
    heads = heads.select(F.col("key").alias("k"), "c", F.col("p.fp").alias("p_fp"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"))
    lists = durable(entries.join(heads.hint("merge"), F.col("key") == F.col("k")).drop("k"))
    col = F.col
    with_head = lists.where(col("fp") != col("p_fp")).where(_possible(col("n"), col("pos"), col("p_n"), col("p_pos")))
    other = lists.where("c between 3 and %d" % short).select(col("key").alias("k"), col("fp").alias("o_fp"), col("n").alias("o_n"), col("pos").alias("o_pos"))
    within = lists.where("c between 3 and %d" % short).join(other, (col("key") == col("k")) & (col("fp") < col("o_fp"))).where(_possible(col("n"), col("pos"), col("o_n"), col("o_pos")))
    seen = durable(_pairs(with_head, "p_fp").unionByName(_pairs(within, "o_fp")).distinct())
    roots = components(links.unionByName(_verified(seen, sets)))

    # A set's draw on a list, in [0, 1): below ``done`` / c it has been a centre there.
    draw = F.pmod(F.xxhash64("key", "fp"), F.lit(1 << 40)) / float(1 << 40)
    long, done, centres = lists.where(col("c") > short).drop("p_fp", "p_n", "p_pos").withColumn("draw", draw), 0, 0
    while True:
        rows = _rooted(long.where(col("draw") * col("c") >= done), roots)
        open_ = grouped(rows, "key", F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select(col("key").alias("k"), "r1")
        long = durable(rows.join(open_.hint("merge"), col("key") == col("k")).drop("k"))
        if long.isEmpty():
            break
        if centres:
            partner = long.where(col("draw") * col("c") < done + centres)
            partner = partner.select(col("key").alias("k"), col("fp").alias("o_fp"), col("n").alias("o_n"), col("pos").alias("o_pos"), col("root").alias("o_root"))
            done += centres
        else:  # of another class than the greatest
            best = grouped(long.where("root != r1"), "key", F.min(F.struct("pos", "n", "fp", "root")).alias("p"))
            partner = best.select(col("key").alias("k"), col("p.fp").alias("o_fp"), col("p.n").alias("o_n"), col("p.pos").alias("o_pos"), col("p.root").alias("o_root"))
        centres = 64 * max(1, centres)
        more = long.join(partner.hint("merge"), (col("key") == col("k")) & (col("root") != col("o_root"))).where(_possible(col("n"), col("pos"), col("o_n"), col("o_pos")))
        more = durable(_pairs(more, "o_fp").join(seen, ["a", "b"], "left_anti"))
        seen = seen.unionByName(more)
        # The stars so far stand for all links so far.
        roots = components(roots.select(col("node").alias("a"), col("root").alias("b")).unionByName(_verified(more, sets)))
        long = long.drop("root", "r1")
    return Classes(chunks, listed.where("kind = 3").select("doc_id", "fp", "n", "key", "pos"), roots)


def jaccard_components(docs: DataFrame, size: int = 5, short: int = 8, sizes: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included) for each row. ``sizes``: bytes of a chunk and number of buckets, else by ``layout``."""
    c = _classes(docs, size, short, None, sizes)
    col = F.col
    least = c.best().select(col("root").alias("r"), col("p.doc_id").alias("component_id"))
    of_set = c.named.join(least.hint("merge"), col("root") == col("r")).select(col("fp").alias("s"), "component_id")
    out = c.rows.join(of_set.hint("merge"), (col("fp") == col("s")) & (col("n") > 0), "left")
    return out.select("doc_id", col("n").cast("long").alias("n_shingles"), F.when(col("n") > 0, col("component_id")).otherwise(col("doc_id")).alias("component_id"))


def one_of_each_class(docs: DataFrame, size: int = 5, short: int = 8) -> DataFrame:
    """One row of each class, whole and with all its columns: that of the least doc_id (null ids come last), of rows that
    share it the one with the least set hash, of equal ones the first of the table. Rows without words, being linked with
    nothing, all stay. Works on rows, so rows that share an id but not their words don't stand for each other."""
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    c = _classes(docs, size, short, extra)
    kept = c.best().select(F.col("p.key").alias("chunk"), F.col("p.pos").alias("place")).unionByName(c.rows.where("n = 0").select(F.col("key").alias("chunk"), F.col("pos").alias("place")))
    return rows_with(c.chunks, kept, docs.select("doc_id", "text", *extra).schema).select(*docs.columns)


def _mean_list(answers: DataFrame) -> float:
    """Mean number of sets on the list of a shared shingle, from the answers (classes of frequency)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .chunks import unsqueeze

        for b in batches:
            level = np.frombuffer(b"".join(unsqueeze(x) for x in b.column("blob").to_pylist()), np.uint8)
            level = level[level > 0].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([float(len(level))]), pa.array([float((2.0 ** (level - 1)).sum())])], ["n", "total"])

    r = map_arrow(answers, run, "n double, total double").agg(F.sum("n"), F.sum("total")).first()
    return r[1] / r[0] if r[0] else 1.0


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS t FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.t)
SELECT r.d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.t) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d
"""
