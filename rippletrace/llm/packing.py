"""Harmonic packing of tokenised documents into sequences of a fixed length.

A document gives whole sequences while it has ``capacity`` tokens or more. What is left of it falls, by its length, into
a reciprocal-capacity class: class k has the lengths in (capacity / (k + 1), capacity / k], and a bin of class k takes
exactly k of them, whatever they are. A bin that has its k is short of less than capacity / (k + 1) tokens; the next
document closes that gap with its first tokens (whole, if it is shorter than the gap). So every sequence is full, at
most one bin waits for a gap at any time, and a document is cut at most once besides its whole sequences. Each worker
fills the bins of its own rows and shares nothing, so there is no shuffle. What is left in a worker's open bins at its
end is laid out by falling class into full sequences; the last tokens form sequences whose lengths are powers of two.

Memory: one batch of rows and the open bins. floor(capacity / length) has under 2 sqrt(capacity) values, so these are
under 128 bins of 4096 tokens. A lost task gives the same sequences again, as they depend on its rows alone.

``harmonic_class`` is k for what was put into a bin of class k, and 0 for what closes a gap or is laid out at a
worker's end.

Defined results: null or empty text is the end token alone. Repeated rows are packed each for itself. A null doc_id
stays. A table without rows gives none.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, byte_rows, documents, map_arrow, shared_memo

CAPACITY = 4096
END = (2).to_bytes(4, "little")
NUMBERS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "harmonic_class")


#: Words of these characters are unchanged by the tokenizer's normalizer but for their case, which is one to one here.
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The tokenizer's own word pattern, for lower-case text of those characters.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Most words: letters, and marks behind them, of PLAIN. These are the two parts, as no contraction ends in a mark.
USUAL = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([\x21-\x2f:;=>?@\x5b-\x60\x7b-\x7e]*)")
#: The first byte of a character from U+0100 on.
FAR = re.compile(rb"[\xc4-\xff]")


def words(text: bytes) -> list[bytes]:
    """The text's words, with A-Z lower-cased where no id depends on that, so that all spellings share an entry.

    In characters before U+0100 nothing composes with a letter, and special tokens are the only others that have case."""
    return (text if b"<|" in text or not text.isascii() and FAR.search(text) else text.lower()).split()


def word_ids(tokenizer_file: str):
    """word (bytes without white space) -> its ids as little-endian 32-bit numbers.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words one after another.
    Nor does a token span the parts into which its pattern cuts a word, so those have a table of their own, which
    serves all spellings and all punctuation around a part. Other words, and those that hold a special token's
    marks, are given to the tokenizer whole.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer_file))
    pieces = tokenizer.model.tokenize
    # The tokenizer writes each byte as a character: printable ones as themselves, the rest from U+0100 on.
    shown = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or c >= 0xAE]
    spelt = {c: c for c in shown} | {c: 256 + k for k, c in enumerate(c for c in range(256) if c not in set(shown))}
    packed = [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size())]

    def whole(text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(text: str) -> bytes:
        return b"".join([packed[t.id] for t in pieces(text if text.isascii() else text.encode().decode("latin-1").translate(spelt))])

    of_part = Memo(part).__getitem__

    def ids(word: bytes) -> bytes:
        text = word.decode()
        if usual := USUAL.fullmatch(text):
            letters, marks = usual.groups()
            return of_part(letters.lower()) + of_part(marks) if marks else of_part(letters.lower())
        if "<|" in text or not PLAIN.fullmatch(text):
            return whole(text)
        return b"".join(map(of_part, PARTS.findall(text.lower())))

    return ids


class HarmonicBins:
    """Open bins by class. ``document`` and ``rest`` return the rows (NUMBERS, ids) of the sequences that they finish."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple] = []
        self.gap = 0

    def document(self, doc: int | None, ids: bytes) -> list[tuple]:
        total, start, out = len(ids) // 4, 0, []
        while total - start >= self.capacity:
            out += self._close([self._piece(doc, ids, start, self.capacity, 1)])
            start += self.capacity
        if self.gap and start < total:
            size = min(self.gap, total - start)
            self.waiting.append(self._piece(doc, ids, start, size, 0))
            self.gap -= size
            start += size
            if not self.gap:
                out += self._close(self.waiting)
                self.waiting = []
        if start < total:
            k = self.capacity // (total - start)
            bin_ = self.open.setdefault(k, [])
            bin_.append(self._piece(doc, ids, start, total - start, k))
            if len(bin_) == k:
                del self.open[k]
                self.gap = self.capacity - sum(len(p[3]) for p in bin_) // 4
                if self.gap:
                    self.waiting = bin_
                else:
                    out += self._close(bin_)
        return out

    def rest(self) -> list[tuple]:
        pieces = self.waiting + [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[3]) for p in pieces) // 4
        self.open, self.waiting, self.gap, out, at = {}, [], 0, [], 0
        while left:
            want, own = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                doc, total, start, ids, _ = pieces[at]
                own.append((doc, total, start, ids[: 4 * want], 0))
                if len(ids) > 4 * want:
                    pieces[at] = (doc, total, start + want, ids[4 * want :], 0)
                else:
                    at += 1
                want -= len(own[-1][3]) // 4
            out += self._close(own)
        return out

    @staticmethod
    def _piece(doc: int | None, ids: bytes, start: int, size: int, k: int) -> tuple:
        return doc, len(ids) // 4, start, ids[4 * start : 4 * (start + size)], k

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for doc, total, start, ids, k in pieces:
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at, k, ids))
            at += len(ids) // 4
        self.next += 1
        return out


def _packer(tokenizer_file: str, capacity: int, with_ids: bool):
    names = [*NUMBERS, *["ids"] * with_ids]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * (len(NUMBERS) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.binary())] * with_ids, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared_memo(f"ids {tokenizer_file}", lambda: word_ids(tokenizer_file)).__getitem__
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 33)
        for b in batches:
            raw, at = byte_rows(b.column("text"))
            rows, held = [], 0
            for k, doc in enumerate(b.column("doc_id").to_pylist()):
                ids = b"".join(map(ids_of, words(raw[at[k] : at[k + 1]]))) + END
                rows += bins.document(doc, ids)
                held += len(ids)
                if held > 8_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)
        yield batch(bins.rest())

    return run


def harmonic_packing(docs: DataFrame, tokenizer_file: str = "word_bpe_49k.json", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """A row for each piece; ``ids`` has its token ids (little-endian, 32 bits each). ``capacity`` is a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = ", ".join(f"{n} long" for n in NUMBERS) + ", ids binary" * with_ids
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _packer(tokenizer_file, capacity, with_ids), schema)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing(documents(spark, sf_dir), with_ids=False)
