"""Vectorised text helpers that run inside tasks: whole Arrow batches in, numpy arrays out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z and nothing else; UTF-8 keeps ASCII bytes apart from all others, so this acts on bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is not a digit or letter becomes a space.
LOWER_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))

BATCH_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `size` bytes of text; a longer single text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to
            pa.default_memory_pool().release_unused()


def translated(texts: pa.Array, table: bytes) -> pa.LargeStringArray:
    """texts with each byte mapped by `table`; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    body = bytes(memoryview(data)[at[0] : at[-1]]).translate(table)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(body))


def words(texts: pa.Array, table: bytes) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts in order, split at ASCII white space after `table` is applied, and the number of words in each text."""
    lists = pc.ascii_split_whitespace(translated(texts, table))
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets)
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.zeros(len(flat) + 1, np.int32)
    np.cumsum(keep.to_numpy(zero_copy_only=False), out=kept[1:])
    return flat.filter(keep), np.diff(kept[offsets - offsets[0]]).astype(np.int64)


def byte_view(strings: pa.LargeStringArray) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of an array of strings and the offsets at which each begins, with the end."""
    strings = pa.concat_arrays([strings])
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64, len(strings) + 1 + strings.offset)[strings.offset :]
    return memoryview(data if data is not None else b""), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of every i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
