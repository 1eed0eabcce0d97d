"""Texts as chunks of word codes, and one dictionary of all words that the chunks ask.

A task turns its documents into chunks of about CHUNK features (words, or runs of words). A chunk has its own
list of distinct features, each once, so a frequent feature is one entry of a chunk however often it occurs.
Features are dealt to parts by a hash of their bytes; the task of a part sums the counts of all chunks, gives
each distinct feature a number and answers every chunk. What moves between tasks are packed arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm.shared import table

#: Features of a chunk, about; a longer document is a chunk of its own.
CHUNK = 1 << 20
#: Bytes of text that are cut into words at a time.
PIECE = 1 << 23
#: Bytes of text for each part of the dictionary, and most parts.
PART_BYTES, MOST_PARTS = 1 << 24, 1 << 14

_ZSTD = pa.Codec("zstd")


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; small numbers take few bytes."""
    planes = np.ascontiguousarray(np.asarray(values, "<i8")).view(np.uint8).reshape(-1, 8).T
    return _ZSTD.compress(planes.tobytes(), asbytes=True) + len(values).to_bytes(8, "little")


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[-8:], "little")
    planes = np.frombuffer(_ZSTD.decompress(packed[:-8], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """What each byte of a text becomes: a space if it separates words, with ``lower`` a small letter for A to Z."""
    out = np.arange(256, dtype=np.uint8)
    out[list(separators)] = 32
    if lower:
        out[65:91] = np.arange(97, 123)
    return out


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: ASCII that is neither digit nor small letter.
NO_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def cut(texts: pa.Array, become: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words of each text, null having none, and all words in order as one binary array."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    data, at = become[data], at - at[0]
    inside = data != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < at[-1]]
    first[begins] = inside[begins]
    places = np.flatnonzero(first)
    kept = data[inside]
    offsets = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return np.diff(np.searchsorted(places, at)), words


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about PIECE bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = np.cumsum(size) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over all 64-bit numbers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_hash(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words are not empty."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64) + np.uint64(1)
    if not len(words):
        return np.empty(0, np.uint64)
    length = np.diff(at)
    inside = np.arange(len(data)) - np.repeat(at[:-1] - at[0], length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
        return mixed(np.add.reduceat(data * powers[inside], at[:-1] - at[0]))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) * parts >> 24


def _features(n_words: np.ndarray, words: pa.Array, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Features of each document, their codes in the order of documents, and the distinct features."""
    coded = words.dictionary_encode()
    known, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if (shortest, longest) == (1, 1):
        return n_words, codes, known
    doc = np.repeat(np.arange(len(n_words)), n_words)
    single, now, names, out, shift = (codes, known), codes, known, [], 0
    for n in range(1, longest + 1):
        if n > 1:  # the run of n - 1 words that begins here and the word after it
            whole = doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.zeros(0, bool)
            here = np.flatnonzero(whole)
            pairs, now_here = np.unique(now[here] * (len(single[1]) + 1) + single[0][here + n - 1], return_inverse=True)
            left, right = np.divmod(pairs, len(single[1]) + 1)
            names = pc.binary_join_element_wise(names.take(pa.array(left)), single[1].take(pa.array(right)), b" ")
            now = np.full(len(doc), -1)
            now[here] = now_here
        if n >= shortest:
            here = np.flatnonzero(now >= 0)
            out.append((doc[here], now[here] + shift, names))
            shift += len(names)
    docs, codes = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    order = np.argsort(docs, kind="stable")
    return np.bincount(docs, minlength=len(n_words)), codes[order], pa.concat_arrays([x[2].cast(pa.binary()) for x in out])


def _chunked(parts: int, become: np.ndarray, shortest: int, longest: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def chunk(rows: list, words: list, lengths: list, number: int) -> pa.RecordBatch:
        n_words = np.concatenate(lengths)
        n, codes, known = _features(n_words, pa.concat_arrays(words), shortest, longest)
        part = part_of(_byte_hash(known), parts)
        order = np.argsort(part, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        codes = place[codes]
        row = pa.concat_arrays([r.column(0) for r in rows])
        counted = np.repeat(np.concatenate([r.column(1).to_numpy(zero_copy_only=False) for r in rows]).astype(bool), n)
        counts = np.bincount(codes[counted], minlength=len(order))
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(edges))
        offsets = pa.array(np.append(edges[used], len(order)), pa.int32())
        asks = pa.StructArray.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(offsets, known.take(pa.array(order))), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=["part", "words", "counts"])
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        chunk_id = (TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_arrays([pa.array([chunk_id]), one(row), one(pa.array(n_words, pa.int64())), one(pa.array(n, pa.int64())), pa.array([pack(codes)], pa.binary()), one(asks)], names=["chunk", "rows", "n_words", "n", "codes", "asks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, lengths, held, number = [], [], [], 0, 0
        for piece in (p for b in batches for p in pieces(b, 2)):
            n, found = cut(piece.column(2), become)
            rows.append(piece)
            words.append(found)
            lengths.append(n)
            held += len(found)
            if held >= most:
                yield chunk(rows, words, lengths, number)
                rows, words, lengths, held, number = [], [], [], 0, number + 1
        if rows:
            yield chunk(rows, words, lengths, number)

    return run


def n_parts(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    return int(min(MOST_PARTS, max(4, -(-size // PART_BYTES))))


def chunk_table(docs: DataFrame, row: Column, text_col: str, become: np.ndarray, parts: int, counted: Column | None = None, shortest: int = 1, longest: int = 1, most: int = CHUNK) -> DataFrame:
    """Written table (chunk, rows, n_words, n, codes, asks): the documents' ``row`` structs, how many words and features each has,
    the packed codes of all, and for every part the chunk's distinct features with their counts in the documents
    that are ``counted``.
    """
    slim = docs.select(row.alias("row"), (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counted"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asks = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))]))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(slim.schema["row"].dataType)), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()), T.StructField("asks", asks)])
    return table(slim.mapInArrow(_chunked(parts, become, shortest, longest, most), schema), "chunks")


def dictionary(chunks: DataFrame, parts: int, mark: Callable[[list[bytes]], list[int]] | None = None) -> DataFrame:
    """Written table of what the parts know and answer.

    A row without chunk has the distinct ``words`` of a part, their ``counts`` over all chunks and ``marks``
    (``mark`` of each distinct word, called once for it). A row with a chunk answers its ask, in its order:
    packed ``at`` (numbers within the part), ``count`` and ``marked``.
    """

    def merge(group: pa.Table) -> pa.Table:
        chunk, part = group.column("chunk").to_pylist(), group.column("part")[0].as_py()
        words = group.column("words").combine_chunks()
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        counts = np.bincount(codes, weights=group.column("counts").combine_chunks().flatten().to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)  # exact below 2 ** 53
        marks = np.array(mark(coded.dictionary.to_pylist()) if mark else [], dtype=np.int64)
        own = np.split(codes, np.cumsum(sizes)[:-1])
        return pa.table(
            {
                "part": pa.array([part] * (1 + len(chunk)), pa.int32()), "chunk": pa.array([None, *chunk], pa.int64()),
                "words": pa.array([coded.dictionary, *[None] * len(chunk)], pa.list_(pa.binary())), "counts": pa.array([counts, *[None] * len(chunk)], pa.list_(pa.int64())),
                "marks": pa.array([marks, *[None] * len(chunk)], pa.list_(pa.int64())), "at": pa.array([None, *[pack(c) for c in own]], pa.binary()),
                "count": pa.array([None, *[pack(counts[c]) for c in own]], pa.binary()), "marked": pa.array([None, *[pack(marks[c]) if mark else None for c in own]], pa.binary()),
            }
        )

    asked = chunks.select("chunk", F.explode("asks").alias("a")).select("chunk", "a.part", "a.words", "a.counts")
    schema = "part int, chunk long, words array<binary>, counts array<long>, marks array<long>, at binary, count binary, marked binary"
    return table(asked.repartition(parts, "part").groupBy("part").applyInArrow(merge, schema), "dictionary")


def answered(chunks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``finish`` of every chunk's row and the answers to it, in any order; each is one task's at a time."""
    n = max(1, chunks.count())
    left, right = (x.repartition(n, "chunk").groupBy("chunk") for x in (chunks, answers))
    return left.cogroup(right).applyInArrow(finish, schema)


def in_order(answers: pa.Table, column: str) -> np.ndarray:
    """A packed column of a chunk's answers, put together by parts: one number for each distinct feature of the chunk."""
    parts = np.argsort(answers.column("part").to_numpy(), kind="stable")
    values = answers.column(column)
    found = [unpack(values[int(k)].as_py()) for k in parts]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def per_document(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over documents of ``n`` values each."""
    at = np.concatenate(([0], np.cumsum(n)))
    return np.add.reduceat(np.append(values, 0), np.minimum(at[:-1], len(values)))[: len(n)] * (n > 0) if len(n) else np.zeros(0, values.dtype)
