"""Texts cut where no tokenizer's token can lie across, on Arrow buffers.

Tokenizers are slow and most of a block's pieces between such cuts repeat, so a
block of texts is cut, and each different piece is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer texts are handled in parts of so many bytes.
PART = 8_000_000
SPACE, LINE = 0x20, 0x0A


def filled(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as one binary array, null as empty."""
    out = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(out, pa.ChunkedArray):
        out = pa.concat_arrays(out.chunks)
    return pc.fill_null(out.cast(pa.large_binary()), b"")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, and where each text begins and the last ends."""
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def after_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Is the character before each of these positions white space, in the sense of a regular expression's ``\\s``, a control character, or SentencePiece's mark of a space?"""
    a, b, c = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    spaces = (b == 0x80) & ((a <= 0x8F) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    three = ((c == 0xE2) & (spaces | ((b == 0x81) & (a == 0x9F)))) | ((c == 0xE3) & (b == 0x80) & (a == 0x80)) | ((c == 0xE1) & (((b == 0x9A) & (a == 0x80)) | ((b == 0xA0) & (a == 0x8E))))
    mark = (c == 0xE2) & (b == 0x96) & (a == 0x81)
    return (a <= SPACE) | two | three | mark


def cut_before_space(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and how many each text has.

    A piece begins at a space or a line feed that follows another character than
    white space.  Byte-level pre-tokenizers end a token there, and so do pieces
    that hold the space's mark only at their beginning and no line feed.  A
    single space that ends a text stays with its word, for a library that adds a
    space before each text cannot be given it alone.
    """
    raw, offsets = bytes_of(texts)
    at = np.flatnonzero((raw == SPACE) | (raw == LINE))
    at = at[~after_space(raw, at)]
    full = np.diff(offsets) > 0
    begins, ends = offsets[:-1][full], offsets[1:][full]
    inside = ~np.isin(at, begins, assume_unique=True) & ~((raw[at] == SPACE) & np.isin(at + 1, ends, assume_unique=True))
    starts = np.union1d(at[inside], begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    edges = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(np.ascontiguousarray(raw))]), counts


def cut_at_space(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same for tokenizers that drop white space: runs of other characters than ASCII white space."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string(), safe=False))
    counts = np.diff(lists.offsets.to_numpy())
    return lists.flatten().cast(pa.large_binary()), counts


def in_parts(text: bytes, part: int = PART) -> list[bytes]:
    """A long text cut at spaces that follow a visible ASCII character, into parts of ``part`` bytes, or more where none is."""
    out, start = [], 0
    while len(text) - start > part:
        p = text.rfind(b" ", start + 1, start + part)
        while p > 0 and not 0x20 < text[p - 1] < 0x7F:
            p = text.rfind(b" ", start + 1, p)
        if p < 0:
            p = text.find(b" ", start + part)
            while p > 0 and not 0x20 < text[p - 1] < 0x7F:
                p = text.find(b" ", p + 1)
        if p < 0 or p + 1 >= len(text):
            break
        out.append(text[start:p])
        start = p
    return [*out, text[start:]]


def runs(batches: Iterator[pa.RecordBatch], least: int = PART, lead: bytes = b"") -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(doc_id, parts, how many parts each document has) of documents that follow each other, about ``least`` bytes at a time.

    Batches are balanced by bytes, not by rows; a longer text comes alone, in
    parts.  ``lead`` is put before every text but empty ones.
    """
    ids: list[pa.Array] = []
    held: list[pa.Array] = []
    size = 0

    def whole() -> tuple[pa.Array, pa.Array, np.ndarray]:
        return pa.concat_arrays(ids), pa.concat_arrays(held), np.ones(sum(map(len, ids)), np.int64)

    for b in batches:
        texts, start = filled(b.column("text")), 0
        if lead:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(lead, pa.large_binary()), texts, pa.scalar(b"", pa.large_binary())))
        for i, n in enumerate(np.diff(bytes_of(texts)[1]).tolist()):
            if n <= least and size + n <= least:
                size += n
                continue
            if i > start:
                ids.append(b.column("doc_id").slice(start, i - start))
                held.append(texts.slice(start, i - start))
            if ids:
                yield whole()
                ids, held, size = [], [], 0
            start = i
            if n <= least:
                size = n
                continue
            parts = pa.array(in_parts(texts[i].as_py(), least), pa.large_binary())
            yield b.column("doc_id").slice(i, 1), parts, np.array([len(parts)])
            start = i + 1
        if start < b.num_rows:
            ids.append(b.column("doc_id").slice(start))
            held.append(texts.slice(start))
    if ids:
        yield whole()
