"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (1 to 3 bytes of the lower-cased letters in
UTF-8, damped counts). Each language has several centroids from spherical k-means; a text takes the language of the
centroid with the largest cosine. A text that lies further from its centroid than nearly all training texts of it is
rejected: ``decision`` is then ``und``, while ``lang_pred`` names the nearest language all the same.

Every language of a labelled row is learnt. The fit uses at most ``per_language`` rows of each (by hash of the id, so any
corpus size gives an even sample), fewer where ``sample_rows`` in all would be passed, but 8 at least. The workers turn
the sample into damped counts of fixed width, so what reaches the driver is bounded in bytes as well. With many languages
each has fewer centroids (``centroids`` in all, one each at least). Prediction streams over all rows and whole texts
with the model broadcast: 32 kB a centroid.

Defined results: null text, or text without a letter (str.isalpha), is ``und`` with score 0; so is any text if nothing
was learnt. A null doc_id is neither learnt from nor held out. Repeated rows stay. A table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, documents, map_arrow, remainder

DIMENSIONS = 1 << 13
#: Letters, and other characters that count as numbers only.
WORDLIKE = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, decision string"


#: ASCII bytes that are no letters become spaces.
SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in WORDLIKE.finditer(text) for c in m.group())


def letters_of(text: str) -> bytes:
    """The lower-cased text in UTF-8, its words with one space around each."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(SPACES).split()) + b" "


def gram_counts(raw: bytes) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of the bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    h = [((x + np.uint32(salt)) * np.uint32(2654435761)) >> shift for x, salt in ((b, 1 << 24), (two, 1 << 25), (three, 1 << 26))]
    return np.bincount(np.concatenate(h), minlength=DIMENSIONS)


def damped(raw: bytes) -> np.ndarray:
    return np.log1p(gram_counts(raw).astype(np.float32))


def _normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the first centre is the mean's nearest row, each next the row furthest from all so far."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def fit(counts: np.ndarray, langs: list[str], clusters: int = 8, rounds: int = 8, reject_share: float = 0.002) -> dict:
    """idf, centroids, the language of each and the least cosine that is not rejected, from damped counts."""
    idf = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))) + 1).astype(np.float32)
    by = np.array(langs)
    names, centres, least = [], [], []
    for lang in sorted(set(langs)):
        x = _normalised(counts[by == lang].astype(np.float32) * idf)
        c = _kmeans(x, clusters, rounds)
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            own = (x @ c[j])[near == j]
            names.append(lang)
            centres.append(c[j])
            least.append(float(np.quantile(own, reject_share)) * 0.9 if len(own) else 0.0)
    return {"idf": idf, "names": names, "centres": np.array(centres, np.float32).reshape(len(names), DIMENSIONS), "least": least}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, lang and the damped counts (16 bits each) of texts."""
    for b in batches:
        x = [damped(letters_of(t)).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(x, pa.binary())], ["h", "lang", "x"])


def learn_model(docs: DataFrame, learn, per_language: int = 500, sample_rows: int = 12_000, clusters: int = 8, centroids: int = 1600) -> dict:
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.xxhash64(F.lit("sample"), "doc_id").alias("h"), "lang", "text")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n = langs.count()
    if not n:
        return fit(np.zeros((0, DIMENSIONS), np.float16), [])
    most = max(8, min(per_language, sample_rows // n))
    # Each language by its own share, so that a frequent one doesn't crowd out the others.
    share = F.floor(1_000_003 * F.least(F.lit(1.0), most / F.col("n"))) + 1
    some = rows.join(F.broadcast(langs.select(F.col("lang").alias("l"), share.alias("share"))), F.col("lang") == F.col("l")).where(F.pmod("h", F.lit(1_000_003)) < F.col("share"))
    found = map_arrow(some.select("h", "lang", "text"), _features, "h long, lang string, x binary").orderBy("h", "lang", "x").limit(2 * most * n).collect()
    counts = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float16).reshape(len(found), DIMENSIONS)
    return fit(counts, [r["lang"] for r in found], max(1, min(clusters, centroids // n)))


def _run(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        names, least = m["names"], np.array(m["least"])
        for b in batches:
            texts = b.column("text")
            lang, score, rejected, decision = [], [], [], []
            for lo in range(0, b.num_rows, 128):
                raw, at = byte_rows(texts.slice(lo, 128))
                part = [raw[at[k] : at[k + 1]].decode("utf-8", "replace") for k in range(len(at) - 1)]
                ok = [bool(names) and has_letter(t) for t in part]
                x = _normalised(np.stack([damped(letters_of(t)) for t, o in zip(part, ok) if o]) * m["idf"]) if any(ok) else np.zeros((0, DIMENSIONS), np.float32)
                cos = x @ m["centres"].T
                best = iter(cos.argmax(1)) if len(x) else iter(())
                top = iter(cos.max(1)) if len(x) else iter(())
                for o in ok:
                    j, s = (int(next(best)), float(next(top))) if o else (0, 0.0)
                    lang.append(names[j] if o else "und")
                    score.append(min(1.0, max(0.0, s)))
                    rejected.append(not o or s < least[j])
                    decision.append("und" if rejected[-1] else lang[-1])
            names_ = ["doc_id", "held_out", "lang_pred", "score", "rejected", "decision"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(decision, pa.string())], names_)

    return run


def identify(docs: DataFrame, held_out, per_language: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine), rejected, decision. ``held_out``: a boolean column; its rows are not learnt from."""
    out = F.coalesce(held_out, F.lit(False))
    model = learn_model(docs, ~out & F.col("doc_id").isNotNull(), per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return map_arrow(rows, _run(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), remainder(F.col("doc_id"), 3) == 1)
