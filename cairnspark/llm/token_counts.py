"""Token counts: how many tokens a public tokenizer makes of each text.

Texts are encoded in Arrow functions that return lengths only.  A task takes its
documents in batches balanced by bytes (a very long text comes alone, in parts),
cuts them at boundaries that no token crosses, and gives each different piece of
a batch to the tokenizer once, many in a call; what short pieces came to is kept
for the task's next batches.  Nothing is shuffled.

Which boundaries are safe depends on the tokenizer.  One that drops white space
is cut at ASCII white space; byte-level BPE before a space or a line feed after
a visible character; a SentencePiece model at the same places if its pieces hold
the space's mark only at their beginning, and no line feed.  For any other
tokenizer texts stay whole.  Strings of special tokens hold no white space; so
the library finds them, by its default, inside a piece.

Edge cases.  A null text counts as empty: 0 bytes, 0 tokens.  Ill-formed UTF-8
counts as with U+FFFD in its place.  Repeated rows, null and repeated ids are
counted each.  A table without rows gives none; other columns, whatever their
names, are not read.  Very long texts are cut into parts; only a run without any
safe boundary is encoded at once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick
from .words import PART, bytes_of, cut_at_space, cut_before_space, runs

#: A task remembers the counts of so many pieces of so many bytes at most (some 50 MB).
REMEMBERED, SHORT = 400_000, 64
#: Pieces and bytes of one call of the tokenizer.
CALL_PIECES, CALL_BYTES = 20_000, 1_000_000

Cut = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def whole_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return texts, np.ones(len(texts), np.int64)


class Tokenizer:
    """A tokenizer from its file's bytes: ``cut`` for texts, ``lengths`` of pieces."""

    def __init__(self, name: str, model: bytes):
        self.cut: Cut = whole_texts
        self.lead = b""  # stands before each text, so that every piece begins alike
        if name.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.sp = SentencePieceProcessor(model_proto=model)
            names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
            plain = "".join(self.sp.encode("a  b\nc ", out_type=str)) == "▁a▁▁b<0x0A>c▁"
            if plain and not any("\n" in p or "▁" in p.lstrip("▁") for p in names):
                self.cut, self.lead = cut_before_space, b" "
            self.lengths = self._pieces
            return
        from tokenizers import Tokenizer as Library

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Library.from_str(model.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.lengths = self._tokens
        spec = json.loads(model)
        steps = [spec.get("pre_tokenizer") or {}]
        steps = steps[0].get("pretokenizers", steps)
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
        first = steps[0] if steps else {}
        if plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
            self.cut = cut_at_space
        elif plain and spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
            self.cut = cut_before_space

    def _tokens(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[int]:
        """The library puts a space before what it encodes: it is given a piece without its own, and one it puts before a line feed does not count."""
        if self.cut is whole_texts:
            return [len(x) for x in self.sp.encode(pieces, num_threads=1)]
        found = self.sp.encode([p.removeprefix(" ") for p in pieces], num_threads=1)
        return [len(x) - (p[:1] == "\n") for x, p in zip(found, pieces, strict=True)]


def piece_lengths(pieces: pa.Array, t: Tokenizer, known: dict[bytes, int]) -> np.ndarray:
    """Tokens of each piece; ``known`` is read and added to."""
    items = pieces.to_pylist()
    out = np.fromiter((known.get(p, -1) for p in items), np.int64, len(items))
    asked = np.flatnonzero(out < 0)
    if len(known) + len(asked) > REMEMBERED:
        known.clear()
    size = np.cumsum(np.fromiter((len(items[i]) for i in asked), np.int64, len(asked)))
    edges = np.unique(np.concatenate([np.arange(0, len(asked), CALL_PIECES), np.searchsorted(size, np.arange(CALL_BYTES, size[-1] if len(size) else 0, CALL_BYTES)), [len(asked)]]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = [items[k] for k in asked[i:j]]
        n = t.lengths([p.decode("utf-8", "replace") for p in some])
        out[asked[i:j]] = n
        if len(known) < REMEMBERED:
            known.update((p, k) for p, k in zip(some, n, strict=True) if len(p) <= SHORT)
    return out


def text_lengths(texts: pa.Array, t: Tokenizer, known: dict[bytes, int]) -> np.ndarray:
    """Tokens of each text of a binary array without nulls."""
    pieces, counts = t.cut(texts)
    coded = pieces.dictionary_encode()
    tokens = piece_lengths(coded.dictionary, t, known)[coded.indices.to_numpy()]
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(tokens)])
    return total[ends] - total[ends - counts]


def count_tokens(docs: DataFrame, name: str, model: bytes, part_bytes: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``model`` is a tokenizer's file, ``name`` its name.

    The file's bytes are broadcast, so executors need no copy of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = Tokenizer(name, shared.value), {}
        for ids, texts, counts in runs(batches, part_bytes, t.lead):
            if t.cut is whole_texts and len(ids) < len(texts):
                texts, counts = pa.array([b"".join(texts.to_pylist())], pa.large_binary()), np.array([1])
            size = np.diff(bytes_of(texts)[1])
            # parts of a very long text one at a time
            tokens = text_lengths(texts, t, known) if len(ids) == len(texts) else np.concatenate([text_lengths(texts.slice(i, 1), t, known) for i in range(len(texts))])
            size, tokens = (np.add.reduceat(x, np.cumsum(counts) - counts) for x in (size, tokens))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.where(size > 0, size - len(t.lead), 0)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
