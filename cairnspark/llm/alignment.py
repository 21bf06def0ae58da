"""Alignment of two tokenizers' tokens over the same bytes.

``text`` with a space before it is encoded by byte-level BPE (A) and by a
SentencePiece model (B).  Where tokens of both end at the same byte a group
closes; a group is a list of A's ids and a list of B's.  Two tokens are linked
when their bytes overlap, and ``link_counts`` tells how often each pair of ids is
linked in the whole corpus.

The transducer.  At any byte one side leads by some unmatched bytes.  The next
token comes from the side that lags; it eats of those bytes, or eats them all
and leads itself, or ends with them, which closes the group.  A step depends on
nothing but the dangling bytes, the side and the token, so steps are memoised.
Each step that does not open a group is one link: of the leading token and the
token just read.

How it runs.  A block of documents is cut at places where tokens of both sides
end (words.py); each different piece is encoded and aligned once.  A block is
written to the shared folder as one row: the pairs of ids in it with their
counts, and, packed, its documents as lists of pieces.  Counts are summed over
blocks, and come back to each block for the pairs it has, so what is shuffled
grows with blocks times their different pairs, not with links; a pair that every
document has is one row a block.  Blocks have names only in the written table,
which a repeated task cannot change.

Edge cases.  A null or empty text has no tokens, nor has one whose bytes the
tokenizers do not give back (B turns its own mark U+2581 into a space; ill-formed
UTF-8): empty groups, zeros, and no part in the counts.  Repeated rows, null and
repeated ids each count.  Strings of special tokens are plain text.  A table
without rows gives none; other columns, whatever their names, are not read.  A
very long text is cut into parts and is a block of its own.
"""

from __future__ import annotations

import gc
import os
import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import from_planes, planes
from .common import materialize, pick
from .words import cut_before_space, runs

BLOCK = 4_000_000
#: A task remembers so many aligned pieces of so many bytes at most, and so many steps.
REMEMBERED, SHORT, STEPS = 300_000, 48, 300_000
#: Pieces encoded in one call, and put together to one text before.
CALL, JOINED = 10_000, 200
#: A pair of ids as one long.
SHIFT = 32
#: Ids have so many bits at most.
TOKEN_BITS = 24


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable Latin-1 stands for itself, every other byte for the next character from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Steps over dangling bytes; ``a`` and ``b`` are the tokens' bytes by id."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.sides = a, b
        self.clear()

    def clear(self) -> None:
        #: by number of a state: which side leads (0: A or nothing dangles), and its unmatched bytes
        self.lead, self.rest = [0], [b""]
        self.number: dict[tuple[int, bytes], int] = {(0, b""): 0}
        #: (state, token) as one number: the next state, -1 if bytes differ
        self.steps: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """Reads a token of the side that lags; of A in state 0, in which nothing dangles."""
        lead, rest = self.lead[state], self.rest[state]
        new = self.sides[1 - lead if state else 0][token]
        if rest.startswith(new):
            after = (lead, rest[len(new) :])
        elif new.startswith(rest):
            after = (1 - lead if state else 0, new[len(rest) :])
        else:
            after = None
        if after is None or not new:
            to = -1
        elif not after[1]:
            to = 0
        else:
            to = self.number.setdefault(after, len(self.lead))
            if to == len(self.lead):
                self.lead.append(after[0])
                self.rest.append(after[1])
        self.steps[state << TOKEN_BITS | token] = to
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """How many tokens of A and B are read when each group closes, and the
        links as packed pairs; None if the two sides' bytes differ."""
        if len(self.steps) > STEPS:
            self.clear()
        known, lead, step = self.steps.get, self.lead, self.step
        closed, links = [], []
        i = j = state = 0
        n, m = len(a), len(b)
        try:
            while True:
                if state == 0:
                    if i:
                        closed.append((i, j))
                    if i == n:
                        return (closed, links) if j == m else None
                    x = y = a[i]
                    i += 1
                elif lead[state] == 0:
                    y = b[j]
                    j += 1
                    other = y
                    links.append(x << SHIFT | y)
                else:
                    x = y = a[i]
                    i += 1
                    links.append(x << SHIFT | other)
                to = known(state << TOKEN_BITS | y)
                state = step(state, y) if to is None else to
                if state < 0:
                    return None
        except IndexError:  # one side's tokens end while the other leads
            return None


@dataclass(frozen=True)
class Tokenizers:
    """Files' bytes of A (tokenizers, byte-level BPE) and B (SentencePiece)."""

    a: bytes
    b: bytes


class Piece(NamedTuple):
    """An aligned piece: its groups as text, numbers of ids, and links as packed longs."""

    groups: bytes
    n_a: int
    n_b: int
    n_groups: int
    links: bytes


class Aligner:
    """Both tokenizers, loaded in a task."""

    def __init__(self, files: Tokenizers):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_proto=files.b)
        letters = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        of_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            of_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space or a line feed after its beginning; texts cannot be cut there")
        self.of_a, self.transducer = of_a, Transducer(of_a, of_b)
        self.size_a = np.array(list(map(len, of_a)), np.int64)
        self.number = list(map(str, range(max(len(of_a), len(of_b)))))
        self.known: dict[bytes, Piece | None] = {}

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """A's ids of each piece.  Pieces are cut so that their tokens are the
        same where they stand together; that takes fewer calls, and the ids are
        told apart by their bytes."""
        out: list[list[int]] = [[]] * len(texts)
        # what ends a text may end with white space
        plain = [k for k, t in enumerate(texts) if "!" <= t[-1] <= "~" or t[-1].isalnum()]
        alone = sorted(set(range(len(texts))).difference(plain))
        together = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        asked = ["".join([texts[k] for k in ks]) for ks in together] + [texts[k] for k in alone]
        for ks, x in zip([*together, *([k] for k in alone)], self.a.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            ids = x.ids
            ends = np.cumsum([len(texts[k].encode()) for k in ks])
            cuts = [0, *(np.searchsorted(np.cumsum(self.size_a[ids]), ends) + 1).tolist()]
            for k, i, j in zip(ks, cuts, cuts[1:], strict=False):
                out[k] = ids[i:j]
        return out

    def written(self, a: list[int], b: list[int], closed: list[tuple[int, int]]) -> bytes:
        name, out, i, j = self.number, [], 0, 0
        for k, n in closed:
            x = name[a[i]] if k == i + 1 else ",".join([name[t] for t in a[i:k]])
            y = name[b[j]] if n == j + 1 else ",".join([name[t] for t in b[j:n]])
            out.append(f"{x}|{y}")
            i, j = k, n
        return ";".join(out).encode()

    def pieces(self, asked: list[bytes]) -> list[Piece | None]:
        """Each piece aligned; None if its bytes do not come back.  A piece begins with a space, which B adds itself, or a line feed, before which B adds one too many."""
        out = [self.known.get(p) for p in asked]
        new = [k for k, p in enumerate(out) if p is None and asked[k] not in self.known]
        of_a, align, written, known = self.of_a, self.transducer.align, self.written, self.known
        for at in range(0, len(new), CALL):
            some = new[at : at + CALL]
            texts = [asked[k].decode("utf-8", "replace") for k in some]
            left = self.encode_a(texts)
            right = self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1)
            for k, text, a, b in zip(some, texts, left, right, strict=True):
                if text[0] == "\n":
                    b = b[1:]
                found = align(a, b)
                if found and b"".join([of_a[i] for i in a]) == asked[k]:
                    closed, links = found
                    out[k] = Piece(written(a, b, closed), len(a), len(b), len(closed), array("q", links).tobytes())
                if len(asked[k]) <= SHORT and len(known) < REMEMBERED:
                    known[asked[k]] = out[k]
        return out


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def aligned_block(ids: pa.Array, texts: pa.Array, parts: np.ndarray, aligner: Aligner) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A block's different pairs, their counts, and its documents packed."""
    cut, of_part = cut_before_space(texts)
    coded = cut.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    per_doc = sums(of_part, parts)
    found = aligner.pieces(coded.dictionary.to_pylist())
    good = np.fromiter((p is not None for p in found), bool, len(found))
    # documents with a piece that does not come back have no tokens
    whole = sums(~good[at], per_doc) == 0
    kept = np.repeat(whole, per_doc)
    at, per_doc = at[kept], np.where(whole, per_doc, 0)
    # frequent pieces get small numbers
    times = np.bincount(at, minlength=len(found))
    order = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
    number = np.zeros(len(found), np.int64)
    number[order] = np.arange(len(order))
    used = [found[i] for i in order.tolist()]
    links = np.frombuffer(b"".join([p.links for p in used]), np.int64)
    n_links = np.array([len(p.links) // 8 for p in used], np.int64)
    pairs = pa.array(links).dictionary_encode()
    which, pairs = pairs.indices.to_numpy(), pairs.dictionary.to_numpy()
    counts = np.bincount(which, weights=np.repeat(times[order], n_links), minlength=len(pairs)).astype(np.int64)
    body = {
        "doc_id": ids.to_numpy(zero_copy_only=False) if not ids.null_count else ids.to_pylist(),
        "per_doc": per_doc, "at": planes(number[at]).to_numpy(), "which": planes(which).to_numpy(), "n_links": n_links,
        "n": np.array([(p.n_a, p.n_b, p.n_groups) for p in used], np.int64).reshape(-1, 3), "groups": b"\n".join([p.groups for p in used]),
    }
    return pairs, counts, zstandard.compress(pickle.dumps(body, protocol=5), 3)


def with_counts(payload: bytes, count: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The documents of a block; ``count`` and ``best`` are those of its pairs in order."""
    body = pickle.loads(zstandard.decompress(payload))
    at, which, per_doc = from_planes(body["at"]), from_planes(body["which"]), body["per_doc"]
    of_piece = [*body["n"].T, body["n_links"], sums(best[which], body["n_links"]), sums(count[which], body["n_links"])]
    columns = [pa.array(sums(x[at], per_doc)) for x in of_piece]
    groups = np.array([*body["groups"].split(b"\n"), b""], object)
    ids = pa.array(body["doc_id"], pa.int64())
    ends = np.cumsum(per_doc)
    step = 500
    for i in range(0, len(ids), step):
        some = [b";".join(groups[at[e - n : e]].tolist()).decode() for e, n in zip(ends[i : i + step].tolist(), per_doc[i : i + step].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids.slice(i, step), pa.array(some, pa.string()), *[c.slice(i, step) for c in columns]], ROW.names)


ROW = pa.schema([("doc_id", pa.int64()), ("groups", pa.string()), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]])
COLUMNS = "doc_id long, groups string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


def aligned_blocks(docs: DataFrame, files: Tokenizers, block_bytes: int = BLOCK) -> DataFrame:
    """One row a block, written: its name, different pairs with counts, and documents."""
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = Aligner(shared.value), TaskContext.get().partitionId()
        gc.disable()  # a block is millions of small objects without cycles
        try:
            for n, (ids, texts, parts) in enumerate(runs(batches, block_bytes, b" ")):
                pairs, counts, payload = aligned_block(ids, texts, parts, aligner)
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (pairs, counts)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{n}"]), *lists, pa.array([payload], pa.binary())], ["block", "pairs", "counts", "payload"])
                pa.default_memory_pool().release_unused()
        finally:
            gc.enable()

    return materialize(pick(docs, doc_id="long", text="string").mapInArrow(run, "block string, pairs array<long>, counts array<long>, payload binary"))


def link_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: how many links hold the pair of ids, and whether no other A id is linked more often with its B id.

    A window holds the A ids of one B id: the vocabulary bounds it.
    """
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    total = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("count"))
    of_b = W.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    return total.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).cast("long").alias("best"))


def align(docs: DataFrame, files: Tokenizers, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, groups, n_a, n_b, n_groups, n_links, n_best, count_sum of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group.
    ``n_best`` counts the links whose pair is the most frequent one of its B id,
    ``count_sum`` adds up their pairs' counts.
    """
    blocks = aligned_blocks(docs, files, block_bytes)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(link_counts(blocks), "pair").select("of", "at", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros((2, right.num_rows), np.int64)
        at = right.column("at").to_numpy()
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        out = [x for p in left.column("payload").to_pylist() for x in with_counts(p, count, best)]
        return pa.Table.from_batches(out, ROW)

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, COLUMNS)
