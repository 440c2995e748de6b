"""Toxicity by a bag of subwords: fastText's classifier, trained in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams (with word boundaries) and of the word
itself; a text's vector is the mean over its words; a linear softmax scores it. Embeddings and softmax are trained
jointly by Adam on the cross-entropy. A word that was never seen shares n-gram vectors with the words it resembles.

At prediction the model is linear in the words, so each worker keeps a bounded table word -> logit and averages it:
one look-up a word.

The fit takes at most ``positives`` and ``negatives`` labelled rows (by hash of the id). Their ids reach the driver, and
then their counts of distinct words; of a text with more than ``words_a_text`` distinct words the fit takes that many of
them, by hash (scores always use whole texts). So rows and bytes of the fit are bounded at any size. The prior is set back
to that of all labelled rows.

Defined results: a text without words (null, empty) has the score of the prior. Labels that are null, or of null ids, are not learnt;
if a document has several labels the largest counts. Without any label of either kind every score is the prior (0 if
there is none). A null doc_id is not held out. Repeated rows stay. A table without rows gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, documents, map_arrow, remainder, shared_memo

BUCKETS = 1 << 17
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    w = f"<{word}>".encode()
    grams = {w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)} | {w}
    return [zlib.crc32(g) % buckets for g in grams]


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: Distinct words with a space between, their counts (32 bits each), the number of all words.
Counts = tuple[str, bytes, int]


def word_counts(text: str, most: int) -> Counts:
    """``most`` of the distinct words, by hash."""
    words = _words(text)
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    held = count if len(count) <= most else sorted(count, key=lambda w: (zlib.crc32(w.encode()), w))[:most]
    return " ".join(held), np.array([count[w] for w in held], np.int32).tobytes(), len(words)


class Bag:
    """Texts as a sparse matrix over distinct words, and those words as one over the buckets that enough texts have: rare ones would only learn noise."""

    def __init__(self, texts: list[Counts], least_texts: int):
        ids: dict[str, int] = {}
        self.word = np.concatenate([np.array([ids.setdefault(w, len(ids)) for w in held.split()], np.int32) for held, _, _ in texts])
        self.weight = np.concatenate([np.frombuffer(n, np.int32).astype(np.float32) / max(1, total) for _, n, total in texts])
        self.doc_at = np.concatenate([[0], np.cumsum([len(n) // 4 for _, n, _ in texts])]).astype(np.int64)
        parts = [np.array(subwords(w), np.int32) for w in ids]
        self.pieces = np.array([len(x) for x in parts], np.float32)
        bucket = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        word_at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        held = np.zeros(BUCKETS, np.int32)
        for k in range(len(texts)):
            own = self.word[self.doc_at[k] : self.doc_at[k + 1]]
            held[np.unique(bucket[_ranges(word_at, own)[0]])] += 1
        self.common = np.flatnonzero(held >= least_texts)
        number = np.full(BUCKETS, -1, np.int32)
        number[self.common] = np.arange(len(self.common))
        kept = number[bucket] >= 0
        self.bucket = number[bucket[kept]]
        self.word_at = np.concatenate([[0], np.cumsum(kept)])[word_at]


def _ranges(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows ``which`` of a flat sparse matrix, and where each row begins among them."""
    size = at[which + 1] - at[which]
    begin = np.concatenate([[0], np.cumsum(size)])
    return np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(at[which], size), begin


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of x between the begins; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    return (total[begin[1:]] - total[begin[:-1]]).astype(np.float32)


def _spread(index: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, x[:, d], n) for d in range(x.shape[1])], 1).astype(np.float32)


def train(texts: list[Counts], labels: list[int], prior: float, dims: int = 4, steps: int = 260, rate: float = 0.02, scale: float = 40.0, least_texts: int = 3, shrink: float = 0.015, batch: int = 128) -> dict:
    """The logit of class 1 that each bucket adds to a word's mean, and the bias. ``scale`` multiplies text vectors, so that a few words among many can turn the result at a usual step size."""
    rng = np.random.default_rng(7)
    y = np.array(labels)
    bag = Bag(texts, least_texts)
    n = len(bag.common)
    e = np.zeros((n, dims), np.float32)
    w = (rng.standard_normal((dims, 2)) * 0.3).astype(np.float32)
    bias = np.log(np.array([1 - y.mean(), y.mean()]) + 1e-9).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, bias)]
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            which = order[lo : lo + batch]
            flat, doc_begin = _ranges(bag.doc_at, which)
            words, local = np.unique(bag.word[flat], return_inverse=True)
            weight = bag.weight[flat][:, None] * scale
            sub, word_begin = _ranges(bag.word_at, words)
            buckets, pieces = bag.bucket[sub], bag.pieces[words][:, None]
            vectors = _sums(e[buckets], word_begin) / pieces
            hidden = _sums(vectors[local] * weight, doc_begin)
            z = hidden @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(which)), y[which]] -= 1
            p /= len(which)
            to_words = _spread(local, np.repeat(p @ w.T, np.diff(doc_begin), axis=0) * weight, len(words)) / pieces
            to_buckets = _spread(buckets, np.repeat(to_words, np.diff(word_begin), axis=0), n)
            touched = np.flatnonzero(np.bincount(buckets, minlength=n))
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for (m, v), param, g, rows in zip(state, (e, w, bias), (to_buckets[touched], hidden.T @ p, p.sum(0)), (touched, slice(None), slice(None))):
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.999 * v[rows] + 0.001 * g * g
                param[rows] -= rate * fix * m[rows] / (np.sqrt(v[rows]) + 1e-8)
            norm = np.linalg.norm(e[touched], axis=1, keepdims=True)
            e[touched] *= np.maximum(0, 1 - shrink / np.maximum(norm, 1e-9))  # group lasso: what only fits noise goes to 0
    shift = np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    bucket = np.zeros(BUCKETS, np.float32)
    bucket[bag.common] = (e @ (w[:, 1] - w[:, 0])) * scale
    return {"bucket": bucket, "bias": float(bias[1] - bias[0] + shift), "key": zlib.crc32(bucket.tobytes())}


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [word_counts(t, most) for t in b.column("text").to_pylist()]
            columns = [pa.array([w for w, _, _ in held], pa.string()), pa.array([n for _, n, _ in held], pa.binary()), pa.array([t for _, _, t in held], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *columns], ["doc_id", "toxic", "words", "counts", "total"])

    return run


def learn_model(docs: DataFrame, labels: DataFrame, learn, positives: int = 1500, negatives: int = 4500, words_a_text: int = 4096) -> dict:
    """``learn``: a boolean column over doc_id. The sample is drawn from the labels alone, then its bounded set of ids fetches the words."""
    own = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in own.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    plain = {"key": 0, "bucket": None, "prior": float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-50.0 if prior == 0 else 50.0)}
    if not 0 < prior < 1:
        return plain
    h = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003))
    share = lambda most, k: int(1_000_003 * min(1.0, most / n[k])) + 1
    some = own.where(F.when(F.col("toxic") > 0, h < share(positives, 1)).otherwise(h < share(negatives, 0))).limit(2 * (positives + negatives))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"))), "doc_id")
    counted = map_arrow(texts.select("doc_id", "toxic", "text"), _counted(words_a_text), "doc_id long, toxic long, words string, counts binary, total long")
    rows = counted.orderBy("doc_id", "total", "words").limit(4 * (positives + negatives)).collect()
    y = [int(r["toxic"] > 0) for r in rows]
    return plain | train([(r["words"], bytes(r["counts"]), r["total"]) for r in rows], y, prior) if 0 < sum(y) < len(y) else plain


def _scorer(model: dict):
    """Text column -> scores."""
    bucket = model["bucket"]
    memo = shared_memo(f"toxicity {model['key']}", lambda: lambda w: float(bucket[subwords(w)].mean()))

    def score(texts: pa.Array) -> np.ndarray:
        raw, at = byte_rows(texts)
        logit = np.full(len(texts), model["prior"])
        for k in range(len(texts) if bucket is not None else 0):
            words = _words(raw[at[k] : at[k + 1]].decode("utf-8", "replace"))
            if words:
                logit[k] = model["bias"] + sum(map(memo.__getitem__, words)) / len(words)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    return score


def _run(broadcast, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(broadcast.value)
        for b in batches:
            score = of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. ``held_out(column)``: whether rows of that id are kept from learning."""
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = learn_model(docs, labels, ~out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return map_arrow(rows, _run(docs.sparkSession.sparkContext.broadcast(model), threshold), SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score below the threshold; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(learn_model(docs, labels, ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scorer(model.value)
        for b in batches:
            yield b.filter(pa.array(of(b.column("text")) < threshold))

    return map_arrow(docs, run, docs.schema)


def is_held_out(doc_id):
    return remainder(doc_id, 4) == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), is_held_out)
