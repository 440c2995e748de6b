"""Chunks: some MB of documents in one durable row, and a dialogue between chunks and buckets of a key range.

Global questions about small pieces of text (is this shingle in another document? where did this string start
first?) would need a row a piece. Instead each chunk asks with one packed blob for each bucket of hashed keys; a
bucket answers all chunks with one blob each. What a chunk holds twice it asks once, so a piece that a third of all
documents share is one entry a chunk.

Chunks and buckets both grow with the square root of the corpus (``layout``), so a chunk's question to a bucket keeps
``ENTRIES`` entries or more at any size, and both still fit into a worker: at 100 TB a chunk is 57 MB of text and a
bucket has the questions about 450 MB.

The chunks are written to the checkpoint folder first, so a lost task reads the same chunk again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_rows, durable, give_back, map_arrow, ship

CHUNK_BYTES, BUCKET_BYTES = 2_000_000, 64_000_000
#: A question's least number of entries for a bucket, at about one entry for TEXT_AN_ENTRY bytes.
ENTRIES, TEXT_AN_ENTRY = 8, 32
NULL_ID = np.iinfo(np.int64).max


def squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def unsqueeze(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def pack_chunk(ids: list[int | None], sizes: list[int], raw: bytes, extra: bytes = b"", ranks: list[int] | None = None) -> bytes:
    head = np.array([[NULL_ID if i is None else i for i in ids], sizes, ranks or [0] * len(ids)], np.int64)
    return np.array([len(ids), len(extra)], np.int64).tobytes() + head.tobytes() + extra + squeeze(raw)


def _head(blob: bytes) -> tuple[np.ndarray, int, int]:
    n, more = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    return np.frombuffer(blob, np.int64, 3 * n, 16).reshape(3, n), 16 + 24 * n, more


def ranks_of(blob: bytes) -> np.ndarray:
    """What orders rows that share an id."""
    return _head(blob)[0][2]


def open_chunk(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """ids (null: NULL_ID), n + 1 offsets, and the bytes of all texts."""
    (ids, sizes, _), begin, more = _head(blob)
    return ids, np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int64), unsqueeze(blob[begin + more :])


def extra_of(blob: bytes) -> tuple[pa.Table | None, np.ndarray]:
    """The other columns of a chunk's rows (None without any), and which texts are null."""
    (_, sizes, _), begin, more = _head(blob)
    return pa.ipc.open_stream(unsqueeze(blob[begin : begin + more])).read_all() if more else None, sizes < 0


def rows_of_chunk(blob: bytes, names: list[str], texts: list[bytes | None] | None = None, which: np.ndarray | None = None) -> pa.Table:
    """Rows of a chunk with their columns (``names``, in that order); ``texts`` instead of their own, ``which`` of them."""
    ids, at, raw = open_chunk(blob)
    others, null = extra_of(blob)
    which = np.arange(len(ids)) if which is None else which
    if texts is None:
        texts = [None if null[k] else raw[at[k] : at[k + 1]] for k in which]
    else:
        texts = [texts[k] for k in which]
    own = {"doc_id": pa.array(ids[which], mask=ids[which] == NULL_ID), "text": pa.array(texts, pa.binary()).cast(pa.string())}
    rest = others.take(pa.array(which)) if others is not None else None
    return pa.table([own[n] if n in own else rest.column(n) for n in names], names=names)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, extra: list[str] | None = None, rank: Column | None = None) -> DataFrame:
    """chunk long, blob binary; durable. ``extra``: columns that the chunk's rows keep besides doc_id and text. ``rank``: a number that orders rows of the same id."""
    extra = extra or []
    names = [f"x{k}" for k in range(len(extra))]  # no name of the table can clash with those used here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        ids, sizes, ranks, parts, others, held = [], [], [], [], [], 0

        def row() -> pa.RecordBatch:
            kept = b""
            if extra:
                sink = pa.BufferOutputStream()
                whole = pa.Table.from_batches(others).rename_columns(extra)
                with pa.ipc.new_stream(sink, whole.schema) as writer:
                    writer.write_table(whole)
                kept = squeeze(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([pack_chunk(ids, sizes, b"".join(parts), kept, ranks)], pa.binary())], ["chunk", "blob"])

        for b in batches:
            raw, at = byte_rows(b.column("text"))
            null = b.column("text").is_null().to_pylist()
            rest, first = b.select(names), 0
            for k, (doc, rank_) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("rank").to_pylist())):
                text = raw[at[k] : at[k + 1]]
                if ids and held + len(text) > chunk_bytes:
                    others.append(rest.slice(first, k - first))
                    yield row()
                    chunk += 1
                    ids, sizes, ranks, parts, others, held, first = [], [], [], [], [], 0, k
                ids.append(doc)
                ranks.append(rank_)
                sizes.append(-1 if null[k] else len(text))
                parts.append(text)
                held += len(text)
            others.append(rest.slice(first))
        if ids:
            yield row()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(0) if rank is None else rank).cast("long").alias("rank"), *[F.col(f"`{c}`").alias(n) for c, n in zip(extra, names)])
    return durable(map_arrow(own, run, "chunk long, blob binary"))


def corpus_bytes(docs: DataFrame) -> int:
    """About the bytes of the texts: three times the files' size by the optimizer's statistics, or a sum where it has none."""
    known = int(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 3 * known if known < 1 << 58 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def layout(total: int, partitions: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
    """Bytes of a chunk, and the number of buckets: enough to occupy all shuffle partitions and for BUCKET_BYTES of text each, few enough that a chunk has ``ENTRIES`` for each."""
    buckets = max(2 * partitions, min(total // BUCKET_BYTES, isqrt(total // 2048)))
    return max(chunk_bytes, min(1 << 30, ENTRIES * TEXT_AN_ENTRY * buckets) if buckets > 2 * partitions else 0), buckets


def layout_of(docs: DataFrame) -> tuple[int, int]:
    return layout(corpus_bytes(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def place(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 64-bit key, and 24 more bits of it; both rise with the key."""
    wide = (keys >> np.uint64(24)) * np.uint64(buckets)
    return (wide >> np.uint64(40)).astype(np.int64), ((wide >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.uint32)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of a sorted array of bucket numbers."""
    if len(bucket):
        edges = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)]):
            yield int(bucket[lo]), slice(lo, hi)


def planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers by significance: planes of sorted or alike numbers compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(dtype)


def table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in columns.values()], names=list(columns))


ROWS = "chunk long, bucket long, blob binary"


def rows_of(chunk: list, bucket: list, blob: list) -> pa.Table:
    return table({"chunk": (chunk, pa.int64()), "bucket": (bucket, pa.int64()), "blob": (blob, pa.binary())})


def ask(chunks: DataFrame, question: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """ROWS: what each chunk asks each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob")):
                asked = list(question(blob.as_py()))
                yield from rows_of([chunk] * len(asked), [x for x, _ in asked], [squeeze(x) for _, x in asked]).to_batches()
                give_back()

    return map_arrow(chunks, run, ROWS)


def answer(asked: DataFrame, reply: Callable[..., list[bytes]], with_key: bool = False) -> DataFrame:
    """ROWS: what each bucket answers each chunk that asked; ``reply`` maps the questions of a bucket (after its number, if asked for) to the answers."""
    ship(asked.sparkSession)

    def run(key, t):
        t = t.sort_by("chunk")
        questions = [unsqueeze(x) for x in t.column("blob").to_pylist()]
        replies = reply(key[0].as_py(), questions) if with_key else reply(questions)
        give_back()
        return rows_of(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), [squeeze(x) for x in replies])

    return asked.groupBy("bucket").applyInArrow(run, ROWS)


def told(chunks: DataFrame, answers: list[DataFrame], use: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``use(chunk, blob, *answers)`` for each chunk; each of the answers is the list of its (bucket, bytes) in the order of buckets."""
    ship(chunks.sparkSession)
    marked = None
    for k, a in enumerate(answers):
        part = a.select("chunk", "bucket", "blob", F.lit(k).alias("which"))
        marked = part if marked is None else marked.unionByName(part)

    def run(key, left, right):
        right = right.sort_by([("which", "ascending"), ("bucket", "ascending")])
        got: list[list[tuple[int, bytes]]] = [[] for _ in answers_range]
        for which, bucket, blob in zip(right.column("which").to_pylist(), right.column("bucket").to_pylist(), right.column("blob").to_pylist()):
            got[which].append((bucket, unsqueeze(blob)))
        out = use(left.column("chunk")[0].as_py(), left.column("blob")[0].as_py(), *got)
        give_back()
        return out

    answers_range = range(len(answers))
    return chunks.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(run, schema)


def rows_with(chunks: DataFrame, kept: DataFrame, schema) -> DataFrame:
    """The rows of the chunks at (chunk, place) of ``kept``; ``schema``: doc_id, text and the chunks' other columns."""
    ship(chunks.sparkSession)
    names, id_type = schema.names, to_arrow_type(schema["doc_id"].dataType)

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], to_arrow_type(f.dataType)) for f in schema.fields], names=names)
        out = rows_of_chunk(left.column("blob")[0].as_py(), names, which=np.sort(right.column("place").to_numpy()))
        give_back()
        return out.set_column(names.index("doc_id"), "doc_id", out.column("doc_id").cast(id_type))

    return chunks.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(run, schema)
