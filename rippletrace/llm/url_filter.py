"""URL filter: rules, then host word segmentation with naive Bayes.

Rules are pairs of a host and a path; one fits its host with all subdomains where the path starts with the rule's, and
the longest that fits decides. Urls that no rule fits are scored: names in the host and path are split into words by
unigram Viterbi (words of the pages' own text are the lexicon), and a multinomial naive Bayes over the hashed words,
taught by the urls that rules decide, gives the verdict.

Words are runs of letters (of any script) of any length, lower-cased: of the pages' text without scripts, styles,
comments, tags and character references, and, as names, of the host (international labels decoded) and of the path
(percent-decoded). Runs of digits are names of their own, by length alone.

Every word of the pages counts at any size: the substrings of the distinct names that are as long as some word are joined
with all word counts, each name is split once with the words that it holds, and the splits are joined back to the urls.
Only the counts' total, the distinct word lengths and ``buckets`` counts for each class reach the driver.

Defined results: a null url, or one without ``://``, has an empty host and path; it fits no rule, and its score is
the prior's. Unless rules decide urls of both classes there is nothing to learn, and what no rule fits is allowed with
score 0. Repeated rows and null ids stay. No rows give none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, durable, map_arrow

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What of a page is no text.
MARKUP = r"(?is)<script\b.*?(</script\s*>|$)|<style\b.*?(</style\s*>|$)|<!--.*?(-->|$)|<[^>]*>|&[a-z0-9#]{1,32};"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, by_rule. The list of rules is a parameter, at most a few hundred."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("by_rule", verdict)


def word_counts(pages: DataFrame) -> DataFrame:
    """w, n: the words of the pages' texts."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), MARKUP, " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}\p{M}]+")).alias("w")).where("w != ''")
    return words.groupBy("w").agg(F.count("*").alias("n"))


class Segmenter:
    """Splits a name into its most likely words; a piece outside the lexicon costs ten times more for each letter.

    ``counts`` may hold only the words that a name can have; ``total`` and ``longest`` are then those of the whole lexicon."""

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -log(n / total) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1) if longest is None else longest
        self.unknown = log(total)

    def split(self, name: str) -> tuple[str, ...]:
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                piece = name[start:end]
                cost = self.cost.get(piece)
                if cost is None:
                    cost = self.unknown + log(10) * len(piece)
                options.append((best[start] + cost, start))
            b, c = min(options)
            best.append(b)
            cut.append(c)
        out, end = [], len(name)
        while end:
            out.append(name[cut[end] : end])
            end = cut[end]
        return tuple(reversed(out))


def names_of(host: str, path: str) -> list[tuple[str, str]]:
    """(side, name): runs of letters, and runs of digits as zeros."""
    import regex

    labels = []
    for label in host.split("."):
        try:
            labels.append(label.encode("ascii").decode("idna") if label.startswith("xn--") else label)
        except UnicodeError:
            labels.append(label)
    found = [(side, name) for side, text in (("h", ".".join(labels)), ("p", unquote(path))) for name in regex.findall(r"[\p{L}\p{M}]+|\p{Nd}+", text.lower())]
    return [(side, "0" * len(name) if name[0].isdecimal() else name) for side, name in found]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of host and path, numbered."""
    for b in batches:
        rows = []
        for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
            rows += [(host, path, k, side, name) for k, (side, name) in enumerate(names_of(host, path))]
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "path", "at", "side", "name"])


def _pieces(lengths: list[int]):
    """Every substring of a name that is as long as a word, with the name's two hashes; a long name gives several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, k1, k2 in zip(*(b.column(c).to_pylist() for c in ("name", "k1", "k2"))):
                for n in lengths:
                    for lo in range(0, len(name) - n + 1, 4096):
                        found = sorted({name[k : k + n] for k in range(lo, min(lo + 4096, len(name) - n + 1))})
                        yield pa.RecordBatch.from_arrays([pa.array([k1] * len(found), pa.int64()), pa.array([k2] * len(found), pa.int64()), pa.array(found, pa.string())], ["k1", "k2", "w"])

    return run


def _split(total: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("name").to_pylist()
            words = [Segmenter({x["w"]: x["n"] for x in held}, total, longest).split(name) for name, held in zip(names, b.column("held").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return run


def url_words(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """host, path, words of the distinct urls that have names."""
    counts = durable(word_counts(pages))
    size = counts.agg(F.sum("n").alias("total"), F.array_sort(F.collect_set(F.length("w"))).alias("lengths")).first()
    of_url = durable(map_arrow(urls.select("host", "path").distinct(), _names, "host string, path string, at long, side string, name string"))
    names = durable(of_url.where("name not like '0%'").select("name").distinct().select("name", F.xxhash64("name").alias("k1"), F.xxhash64(F.lit("second"), "name").alias("k2")))
    pieces = map_arrow(names, _pieces(size["lengths"]), "k1 long, k2 long, w string").distinct()
    held = pieces.join(counts, "w").groupBy("k1", "k2").agg(F.collect_list(F.struct("w", "n")).alias("held"))
    none = F.array().cast(held.schema["held"].dataType)
    both = names.join(held, ["k1", "k2"], "left").select("name", F.coalesce("held", none).alias("held"))
    splits = durable(map_arrow(both, _split(size["total"] or 0, max(size["lengths"], default=1)), "name string, words array<string>"))
    both = of_url.join(splits.withColumnRenamed("name", "s"), F.col("name") == F.col("s"), "left")
    words = F.transform(F.coalesce("words", F.array("name")), lambda w: F.concat("side", F.lit(":"), w))
    rows = both.select("host", "path", F.struct("at", words.alias("words")).alias("x")).groupBy("host", "path").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return durable(rows.select("host", "path", F.flatten("x.words").alias("words")))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(buckets)).cast("int")


def learn(segmented: DataFrame, buckets: int) -> tuple[np.ndarray, float]:
    """The log-odds of ``block`` that a hashed word adds, and of the prior."""
    known = segmented.where("by_rule is not null")
    side = (F.col("by_rule") == "block").cast("int").alias("side")
    words = known.select(side, F.explode("words").alias("word")).groupBy("side", _bucket(buckets).alias("bucket")).agg(F.count("*").alias("n"))
    n = np.ones((2, buckets))
    for r in words.collect():
        n[r["side"], r["bucket"]] += r["n"]
    docs = {r["side"]: r["n"] for r in known.groupBy(side).agg(F.count("*").alias("n")).collect()}
    odds = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    if not docs.get(1) or not docs.get(0):
        return np.zeros(buckets), -np.inf
    return odds, log((docs[1] + 1) / (docs[0] + 1))


def _verdict(model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, prior = model.value
        memo = Memo(lambda w: float(odds[zlib.crc32(w.encode()) % buckets]), 50_000)
        for b in batches:
            logit = np.array([prior + sum(map(memo.__getitem__, ws)) for ws in b.column("words").to_pylist()], np.float64)
            score = np.where(np.isfinite(logit), 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0.0)
            verdict = [r or ("block" if s > 0.5 else "allow") for r, s in zip(b.column("by_rule").to_pylist(), score)]
            names = ["page_id", "host", "path", "rule", "words"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(score, pa.float64()), pa.array(verdict, pa.string())], [*names, "block_score", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, buckets: int = 1 << 16) -> DataFrame:
    """page_id, host, path, rule, words (segments), block_score, verdict."""
    ruled = with_rules(pages, rules)
    words = url_words(ruled, pages).select(F.col("host").alias("u_host"), F.col("path").alias("u_path"), "words")
    both = ruled.join(words, (F.col("host") == F.col("u_host")) & (F.col("path") == F.col("u_path")), "left")
    segmented = durable(both.select(*ruled.columns, F.coalesce("words", F.array().cast("array<string>")).alias("words")))
    model = pages.sparkSession.sparkContext.broadcast(learn(segmented, buckets))
    return map_arrow(segmented, _verdict(model, buckets), "page_id long, host string, path string, rule string, words array<string>, block_score double, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("words")
