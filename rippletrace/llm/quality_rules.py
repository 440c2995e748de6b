"""Quality rules with cross-document line frequency (DataFrame operations only, no Python on executors).

Base rules count words, symbols, repeated lines and repeated five-word windows inside each row with array
functions: no shuffle. Then each row's distinct normalised lines are hashed; for every host the number of distinct
documents that hold a line is counted; lines above the limits are removed, and a document that loses too much is
rejected.

A document is a doc_id of a host. Rows whose id no other row has are counted where they are, so that a line in a third
of all documents is one partial sum a task; only rows with an id that comes again are grouped by id before.

Defined results: null text counts as empty (no words, base_failed). Null hosts form one group. A row without a doc_id
is a document of its own, and stays. Rows that share an id give a result each and count as one document. A table
without rows gives none.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, documents, durable

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator. Unlike a projection it is never inlined, and so an array that a
    lambda refers to is computed once and not once for each element."""
    alias = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(alias)))


def normal_lines(text: Column) -> Column:
    """The lines of a text, each in lower case, with one space for a run of white space and none at the ends.

    All but the split works on the whole text at once (a lambda over lines would be interpreted, line by line), and the
    pattern only on texts that have what it replaces."""
    low = F.lower(text)
    odd = reduce(or_, (text.contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")))
    spaces = F.when(odd, F.regexp_replace(low, r"[\x20\t\x0B\f\r]{2,}|[\t\x0B\f\r]", " ")).otherwise(low)
    return F.split(F.trim(F.replace(F.replace(spaces, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))), "\n")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, host, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the hash of the text."""
    df = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    df = _held(df, bare=F.trim("text", F.lit(" \t\n\x0b\f\r")))
    words = F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", f"{WS_CLASS}+"))
    df = _held(df, word=F.transform(words, lambda w: F.xxhash64(w)), word_chars=F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)))
    starts = F.when(F.size("word") < WINDOW, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("word") - WINDOW))
    df = _held(df, window=F.transform(starts, lambda i: F.xxhash64(*[F.get("word", i + k) for k in range(WINDOW)])))
    # Only texts in which some window comes again are sorted.
    again = F.size(F.array_distinct("window")) < F.size("window")
    df = _held(df, ordered=F.when(again, F.sort_array(F.transform("window", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("ordered", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WS_CLASS.replace("[", "[^")))
    df = df.select(
        "doc_id", "host", "text",
        F.xxhash64("text").alias("text_hash"),
        F.size("word").cast("long").alias("n_words"),
        "word_chars",
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: key of the document's row, place and hash of the normalised line, its words."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("text_hash"), F.posexplode(normal_lines(text)).alias("place", "line")).where("line != ''")
    return df.select("doc_id", "host", "text_hash", "place", F.xxhash64("line").alias("line_hash"), F.size(F.split("line", " ")).alias("words"))


def _documents(docs: DataFrame, broadcast_rows: int) -> DataFrame:
    """doc_id, host, lines (hashes of a row's distinct normalised lines), again (whether other rows have the same id)."""
    lines = F.transform(F.array_remove(F.array_distinct(normal_lines(F.coalesce("text", F.lit("")))), ""), lambda x: F.xxhash64(x))
    rows = docs.select("doc_id", F.col("source").alias("host"), lines.alias("lines"))
    ids = durable(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice")))
    n = ids.count()
    if not n:
        return rows.withColumn("again", F.lit(False))
    marked = rows.join(F.broadcast(ids) if n <= broadcast_rows else ids, F.col("doc_id") == F.col("twice"), "left")
    return marked.select("doc_id", "host", "lines", F.col("twice").isNotNull().alias("again"))


def frequent_lines(docs: DataFrame, min_docs: int, min_share: float, broadcast_rows: int = 1_000_000) -> DataFrame:
    """host, line_hash, n_docs of the lines that more than ``min_docs`` and more than ``min_share`` of a host's documents hold."""
    rows = _documents(docs, broadcast_rows)

    def counted(key: list[str], held: DataFrame) -> DataFrame:
        alone = held.where("not again").select(*key)
        shared = held.where("again").select(*key, "doc_id").distinct().select(*key)
        return alone.unionByName(shared).groupBy(*key).agg(F.count("*").alias("n_docs"))

    counts = counted(["host", "line_hash"], rows.select("doc_id", "host", "again", F.explode("lines").alias("line_hash"))).where(F.col("n_docs") > min_docs)
    hosts = counted(["host"], rows).withColumnRenamed("n_docs", "host_docs")
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).where(F.col("n_docs") > min_share * F.col("host_docs")).select(counts["host"], "line_hash", "n_docs")


def line_frequency_rules(
    docs: DataFrame, min_docs: int = 20, min_share: float = 0.02, least_left: float = 0.5, least_words: int = 10, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """The columns of base_rules, removed_words, removed_lines (hashes), clean_text and kept.

    A document is depleted when fewer than ``least_words`` words, or less than ``least_left`` of its words, are left.
    The frequent lines are broadcast only if there are at most ``broadcast_rows`` of them (their count is taken
    first); beyond that Spark joins by shuffle, where adaptive execution splits skewed lines.
    """
    limits = durable(frequent_lines(docs, min_docs, min_share, broadcast_rows))
    small = limits.count() <= broadcast_rows
    f = (F.broadcast(limits) if small else limits).select(F.col("host").alias("f_host"), F.col("line_hash").alias("f_line"))
    hits = _lines(docs).join(f, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line_hash") == F.col("f_line")))
    key = ["doc_id", "host", "text_hash"]
    # A place of a repeated row counts once; what is grouped by row is at most its lines.
    places = hits.groupBy(*key, "place").agg(F.first("line_hash").alias("line_hash"), F.first("words").alias("words"))
    lost = places.groupBy(*key).agg(F.sum("words").alias("lost"), F.collect_set("line_hash").alias("removed_lines"))
    base = base_rules(docs)
    both = base.join(lost, _same(base, lost, key), "left")
    removed = F.coalesce("lost", F.lit(0))
    left = F.col("n_words") - F.col("removed_words")
    hashes = F.transform(normal_lines(F.col("text")), lambda x: F.xxhash64(x))
    pairs = F.filter(F.arrays_zip(F.split("text", "\n").alias("line"), hashes.alias("hash")), lambda x: ~F.array_contains("removed_lines", x["hash"]))
    clean = F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(pairs, lambda x: x["line"]), "\n"))
    out = both.select(*[base[c] for c in base.columns], "removed_lines", removed.alias("removed_words")).withColumn("clean_text", clean)
    return out.withColumn("kept", ~F.col("base_failed") & (left >= least_words) & (left >= least_left * F.col("n_words")))


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & a[k].eqNullSafe(b[k])
    return on


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]


def op4_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(documents(spark, sf_dir)).select(*COLUMNS)


OP4_SQL = r"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'row ' || r ELSE 'id ' || doc_id END AS doc FROM n),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g
        FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM dup, range(5) t(k) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY r),
nl AS (SELECT r, lower(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g')) AS line FROM worded),
held AS (SELECT d.host, d.doc, nl.line FROM nl JOIN d USING (r)),
lc AS (SELECT host, line, count(DISTINCT doc) AS n FROM held GROUP BY host, line),
hc AS (SELECT host, count(DISTINCT doc) AS n FROM d GROUP BY host),
f AS (SELECT lc.host, lc.line FROM lc JOIN hc ON lc.host IS NOT DISTINCT FROM hc.host WHERE lc.n > 20 AND lc.n > 0.02 * hc.n),
lost AS (SELECT d.r, sum(len(string_split(nl.line, ' '))) AS n FROM nl JOIN d USING (r) JOIN f ON f.line = nl.line AND f.host IS NOT DISTINCT FROM d.host GROUP BY d.r),
b AS (SELECT d.r, d.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dl.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(lost.n, 0)::BIGINT AS removed_words
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dl USING (r) LEFT JOIN lost USING (r)),
c AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       (NOT base_failed AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.5 * n_words) AS kept FROM c
"""
