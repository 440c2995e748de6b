"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces inside a word; dynamic programming carries, for each end, the
best score and how many pieces it takes, and never the pieces. Ties follow the tokenizers library's unigram model:
for an end, candidates come by rising start and only a strictly better score replaces one; a character that no
one-character piece covers costs the least score less 10 and counts as its UTF-8 bytes (byte fallback).

What is counted: a unigram tokenizer. Text is split at white space (space, U+0009 to U+000D), the word mark is put
before each word, and a word's tokens are its most likely pieces. Pieces and scores come from a sentencepiece file;
its control, unknown and byte pieces are no text and stay out. A unigram file has log-probabilities, which are taken as
they are. A BPE file (the installed one) has minus the merge rank instead, which is no likelihood; there the ranks
are made one by the Zipf-Mandelbrot law, p(rank) ~ 1 / (rank + 2.7), as merges come by falling frequency. Nothing is
trained: counts depend on the file alone. They are near, but not equal to, those of the file's own merges.

Words are independent of each other, so a worker counts a word once and keeps a bounded table of counts. A word costs
time in proportion to its length times the longest piece, and memory in proportion to its length.

Defined results: null or empty text has 0 tokens and score 0. Repeated rows and null ids stay. No rows give none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_rows, documents, map_arrow, shared_memo

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SCHEMA = "doc_id long, n_tokens long, score double"


def vocabulary(model_file: str, offset: float = 2.7) -> list[tuple[str, float]]:
    """The text pieces of a sentencepiece file with their log-probabilities; ranks become some by Zipf-Mandelbrot."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model_file))
    text = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in text]
    if not all(s == int(s) for _, s in pieces):
        return pieces
    total = log(sum(1 / (offset - s) for _, s in pieces))
    return [(p, -log(offset - s) - total) for p, s in pieces]


def counter(pieces: list[tuple[str, float]]):
    """word (str, with its mark) -> (pieces of the best path, its score)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    score_of = {}
    for p, s in pieces:
        if p and p not in score_of:
            score_of[p] = s
            automaton.add_word(p, (len(p), s))
    automaton.make_automaton()
    unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
    single = {p for p in score_of if len(p) == 1}
    matches = automaton.iter if score_of else lambda w: ()
    none = float("-inf")

    def count(word: str) -> tuple[int, float]:
        n = len(word)
        best, many = [0.0] + [none] * n, [0] * (n + 1)
        done = 0  # ends up to here are final
        for end, (size, score) in matches(word):
            while done < end:  # characters before this end that only the unknown piece may reach
                _unknown(word, done, best, many)
                done += 1
            s = best[end + 1 - size] + score
            if s > best[end + 1]:
                best[end + 1], many[end + 1] = s, many[end + 1 - size] + 1
        while done < n:
            _unknown(word, done, best, many)
            done += 1
        return many[n], best[n]

    def _unknown(word: str, at: int, best: list[float], many: list[int]) -> None:
        c = word[at]
        if c not in single and best[at] + unknown > best[at + 1]:
            best[at + 1], many[at + 1] = best[at] + unknown, many[at] + len(c.encode())

    return count


def _make(model_file: str):
    count, pack = counter(vocabulary(model_file)), struct.Struct("<dd").pack
    return lambda w: pack(*count(MARK + w.decode()))


def _run(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared_memo(f"counts {model_file}", lambda: _make(model_file)).__getitem__
        for b in batches:
            raw, at = byte_rows(b.column("text"))
            n, score = [], []
            for k in range(b.num_rows):
                x = np.frombuffer(b"".join(map(of, raw[at[k] : at[k + 1]].split())), np.float64)
                n.append(int(x[0::2].sum()))
                score.append(float(x[1::2].sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, model_file: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, score of the best path."""
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _run(model_file), SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
