"""Blocks of texts: what lets a per-word table meet whole documents cheaply.

A block is a run of documents of bounded size, packed into one compressed binary
as numbers of its distinct words.  These, not all its words, are joined to a table
by word; the answers then meet the packed block in a cogroup, where each document
is put together again.  A task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK_BYTES = 16_000_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def blocks_of(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """(doc_id, text) tables of about ``block_bytes``; one longer text is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        b = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text").cast(pa.string())], schema=SCHEMA)
        start = 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            size += int(n) + 16
            if size >= block_bytes:
                yield pa.Table.from_batches([*held, b.slice(start, i + 1 - start)])
                held, size, start = [], 0, i + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def planes(values) -> pa.Array:
    """Numbers as bytes, the lowest of all first, then the next ones: they compress better."""
    return pa.array(np.ascontiguousarray(np.asarray(values, np.int32).view(np.uint8).reshape(-1, 4).T).ravel())


def from_planes(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.reshape(4, -1).T).view(np.int32).ravel().astype(np.int64)
