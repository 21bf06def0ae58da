"""Language-model scoring by context-tree weighting over bytes.

The model gives the log10 probability of a text's tokens, written as bytes: its
words, lower-cased (A-Z), each with a closing space, and one end.  A byte is
decomposed into eight binary decisions, the nodes 1..255 of a tree; a decision's
contexts are its node and the 0, 1, .. ``DEPTH`` bytes before it in the text,
whether or not a word ends among them (``PAD`` stands before a text's first
byte).  Each context holds the training counts of both outcomes, and Pe, their
Krichevsky-Trofimov (KT) probability.

All depths are mixed by the context tree's recursion: Pw = Pe at ``DEPTH``, and
Pw = (Pe + prod Pw(child)) / 2 above, over the contexts that are one byte longer.
A decision's probability is that of the root, where each context weighs its own KT
estimate by Pe / (2 Pw) and leaves the rest to the longer context, or takes it all
where the longer one was never seen.  Once trained the model is fixed: a text's
own bytes do not change it, whatever the fold.

Scale.  A context and its byte are one 64-bit code, the nearest byte first, so
that sorted codes of one beginning are a subtree.  Texts are cut in blocks, stored
once.  Each block's different codes and words go, with their training counts, in
one packed row to each of many parts, by a hash of the three nearest bytes (of the
word).  A part sums over blocks, solves its subtrees from ``DEPTH`` up to depth 3,
and sends on what they add to depth 2.  Depths 0 to 2 have 65,536 contexts by 256
bytes at most, whatever the corpus; they are solved at once and broadcast.  Each
part then gives every block the probabilities of its codes and the counts of its
words, in the block's order.  Both the number of blocks and that of parts grow
with the input; a task holds one block or one part.

``base_score`` is an additive unigram score of the same tokens.

Edge cases.  A null text is scored as the empty one, which has the end only.  A
null doc_id is neither learned from nor held out.  Without training documents
every decision has probability 1/2 and the base score is 0.  Repeated rows count
each.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of
from .common import materialize, pick, py_crc_mod
from .lm import CLOSE, END_TOKEN, FOLD, HELD_OUT, OUT, PAD, SLOTS, _nodes, _prob, kt_log_block

#: The longest context, in bytes; 7 is the most that fits in a code with the byte itself.
DEPTH = 6
#: Depths up to this one are solved in one place.
TOP = 2
#: A block's bytes of text, how many of them are coded at once, a part's share of the bytes of all texts, and how many codes are solved at once.
BLOCK, PIECE, PART, AT_ONCE = 8_000_000, 4_000_000, 4_000_000, 150_000
LOG2 = math.log(2)


# ---- codes


def codes_of(flat: np.ndarray) -> np.ndarray:
    """Of each byte but the first 7 the DEPTH bytes before it, the nearest first, and itself, as one number."""
    wide = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))
    code = wide << np.uint64(8)
    code >>= np.uint64(8 * (8 - DEPTH))
    code <<= np.uint64(8)
    code |= flat[7:]
    return code


def shorter(codes: np.ndarray) -> np.ndarray:
    """The codes without their contexts' farthest byte."""
    return codes >> np.uint64(16) << np.uint64(8) | codes & np.uint64(255)


def ordered(codes: np.ndarray) -> np.ndarray:
    """argsort: by the lower half and then the upper one, each with its place in one number, which sorts faster."""
    half, low = np.uint64(32), np.uint64((1 << 32) - 1)
    place = np.arange(len(codes), dtype=np.uint64)
    x = codes << half | place
    x.sort()
    first = (x & low).astype(np.uint32)
    x = codes[first] >> half << half | place
    x.sort()
    return first[x & low]


def changes(codes: np.ndarray) -> np.ndarray:
    """Where sorted codes differ from the one before."""
    return np.append(True, codes[1:] != codes[:-1])[: len(codes)]


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes, sorted; their counts; and which one each given code is."""
    order = ordered(codes)
    codes = codes[order]
    new = changes(codes)
    at = np.empty(len(codes), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    first = np.flatnonzero(new)
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts, at


# ---- subtrees below depth TOP


class Level:
    """Sorted codes of one depth.  ``total``: how often a code's context occurs, and with its byte's
    first 1, 2, .. 8 bits; ``node``, ``first``: by number of bits each code's node, and each node's first code."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.total, self.node, self.first = codes, np.empty((len(codes), 9), np.int64), [], []
        for k in range(9):
            begins = codes >> np.uint64(8 - k)
            new = changes(begins)
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            self.total[:, k] = np.add.reduceat(counts, first)[node]
            if k < 8:
                self.node.append(node)
                self.first.append(first)

    def solve(self, below: np.ndarray | None) -> np.ndarray:
        """log Pw of each code's eight decisions; ``below``: the sums of log Pw of the longer contexts."""
        self.own = kt_log_block(self.total[:, :-1] - self.total[:, 1:], self.total[:, 1:])
        self.pw = self.own if below is None else np.logaddexp(self.own, below) - LOG2
        return self.pw

    def weight(self) -> np.ndarray:
        """Of a context's own estimate, against the longer contexts'."""
        return np.exp(self.own - self.pw - LOG2)


def subtrees(codes: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[Level, np.ndarray]], Level, np.ndarray]:
    """Levels from DEPTH to TOP + 1, each with its codes' places in the next one; the level at TOP, and the sums of log Pw below it."""
    out, below, level = [], None, Level(codes, counts)
    for d in range(DEPTH, TOP, -1):
        pw = level.solve(below)
        codes, counts, at = summed(shorter(codes), counts)
        up = Level(codes, counts)
        below = np.empty((len(codes), 8))
        for k in range(8):
            first, node = level.first[k], up.node[k]
            below[:, k] = np.bincount(node[at[first]], pw[first, k], len(up.first[k]))[node]
        out.append((level, at))
        level = up
    return out, level, below


def slices(codes: np.ndarray) -> Iterator[slice]:
    """Runs of some AT_ONCE sorted codes that cut no context of depth TOP + 1."""
    root = codes >> np.uint64(8 * (DEPTH - TOP))
    lo = 0
    while lo < len(codes):
        hi = len(codes) if lo + AT_ONCE >= len(codes) else int(np.searchsorted(root, root[lo + AT_ONCE - 1], "right"))
        yield slice(lo, hi)
        lo = hi


def heap(byte: np.ndarray) -> np.ndarray:
    """The eight nodes on the way to a byte."""
    step = np.arange(8)
    return (1 << step) | (byte[:, None] >> (8 - step))


def at_top(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted codes: slots * 256 + byte with their counts, and slots * 256 + node with what is below: sums of log Pw."""
    leaf, n, inner, s = [], [], [], []
    for x in slices(codes):
        _, top, below = subtrees(codes[x], counts[x])
        slot = top.codes.astype(np.int64) >> 8 << 8
        nodes = heap(top.codes.astype(np.int64) & 255)
        leaf.append(top.codes.astype(np.int64))
        n.append(top.total[:, 8])
        for k in range(8):
            first = top.first[k]
            inner.append(slot[first] | nodes[first, k])
            s.append(below[first, k])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (leaf, n, inner, s))


# ---- depths 0 to TOP


def short_contexts(leaf: np.ndarray, counts: np.ndarray, inner: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each slot, and a row's three numbers for each node: the probability of a one if depth 3 was
    never seen, and else what depths 0 to 2 give to it, and the weight that they leave to depth 3."""
    counts = counts.astype(np.int64)
    keep = counts > 0
    leaf, counts = leaf[keep], counts[keep]
    order, inner_order = np.argsort(leaf), np.argsort(inner)
    leaf, counts, inner, below = leaf[order], counts[order], inner[inner_order], below[inner_order]
    edge, inner_edge = (np.searchsorted(x >> 16, np.arange(257)) for x in (leaf, inner))
    row_of, rows, firsts = np.zeros(SLOTS, np.int32), [], []
    n0, s0 = np.zeros(256, np.int64), np.zeros(255)
    for c1 in np.flatnonzero(np.diff(edge)):
        part, inner_part = slice(edge[c1], edge[c1 + 1]), slice(inner_edge[c1], inner_edge[c1 + 1])
        count, sums = np.zeros(SLOTS, np.int64), np.zeros(SLOTS)
        count[leaf[part] & 0xFFFF] = counts[part]
        sums[inner[inner_part] & 0xFFFF] = below[inner_part]
        count = count.reshape(256, 256)
        used = np.flatnonzero(count.any(1))
        n1, n2, s2 = _nodes(count.sum(0)), _nodes(count[used]), sums.reshape(256, 256)[used, 1:]
        own2, own1 = kt_log_block(*n2), kt_log_block(*n1)
        s1 = (np.logaddexp(own2, s2) - LOG2).sum(0)
        s0 += np.logaddexp(own1, s1) - LOG2
        n0 += count.sum(0)
        firsts.append((c1, used, n1, _weight(own1, s1), n2, _weight(own2, s2)))
    n0 = _nodes(n0)
    p0, w0 = _prob(*n0), _weight(kt_log_block(*n0), s0)
    rows.append(np.stack([p0, p0, 0 * p0], -1)[None])
    at = 1
    for c1, used, n1, w1, n2, w2 in firsts:
        p1, seen1, p2, seen2 = _prob(*n1), sum(n1) > 0, _prob(*n2), sum(n2) > 0
        given, left = np.where(seen1, w0 * p0, p0), np.where(seen1, 1 - w0, 0)
        alone = given + left * p1
        given, left = np.where(seen2, given + left * w1 * p1, alone), np.where(seen2, left * (1 - w1), 0)
        rows.append(np.stack([alone, alone, 0 * alone], -1)[None])
        rows.append(np.stack([given + left * p2, given + left * w2 * p2, left * (1 - w2)], -1))
        row_of[c1 << 8 : (c1 + 1) << 8] = at
        row_of[(c1 << 8) + used] = at + 1 + np.arange(len(used))
        at += 1 + len(used)
    return row_of, np.concatenate(rows)


def _weight(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def code_scores(codes: np.ndarray, counts: np.ndarray, row_of: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of each sorted code after its context."""
    out = np.zeros(len(codes))
    for x in slices(codes):
        levels, _, _ = subtrees(codes[x], counts[x])
        code = levels[-1][0].codes.astype(np.int64)
        byte = code & 255
        one = (byte[:, None] >> (7 - np.arange(8)) & 1).astype(bool)
        alone, given, left = np.moveaxis(rows[row_of[code >> 16][:, None], heap(byte) - 1], -1, 0)
        alone, given = np.where(one, alone, 1 - alone), np.where(one, given, np.maximum(1 - left - given, 0))
        for i in range(len(levels) - 1, -1, -1):
            level = levels[i][0]
            if i < len(levels) - 1:
                at = levels[i][1]
                alone, given, left = alone[at], given[at], left[at]
            context = level.total[:, :-1]
            own = left * (level.total[:, 1:] + 0.5) / (context + 1)
            alone = np.where(context > 0, given + own, alone)
            if i:
                # where this depth was never seen no longer one was, and alone stands
                weight = level.weight()
                given, left = given + weight * own, left * (1 - weight)
        out[x] = np.log10(alone.prod(1))
    return out


# ---- blocks and parts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_ids, text, size): normalised texts, each with its END_TOKEN, one after the other."""
    for t in blocks_of(batches, BLOCK):
        texts = []
        for x in t.column("text").cast(pa.binary()).to_pylist():
            words = (x or b"").lower().split()
            texts.append(CLOSE.join([*words, END_TOKEN]))
        text = b"".join(texts)
        del texts
        ids = t.column("doc_id").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        cols = [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([zstandard.compress(text, 3)], pa.binary()), pa.array([len(text)])]
        yield pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "text", "size"])


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """The codes of a block's bytes, some PIECE at once."""
    pad = bytes([PAD]) * 7
    flat = np.frombuffer(pad + text.replace(END_TOKEN, END_TOKEN + pad), np.uint8)
    for lo in range(7, len(flat), PIECE):
        yield codes_of(flat[lo - 7 : lo + PIECE])[flat[lo : lo + PIECE] != PAD]


def code_counts(text: bytes, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's different codes, sorted, and how often they occur in texts to learn from; ``train`` is by byte."""
    codes, counts, lo = [], [], 0
    for code in _pieces(text):
        learn = train[lo : lo + len(code)]
        lo += len(code)
        for x, weight in ((code[learn], 1), (code[~learn], 0)):
            x.sort()
            first = np.flatnonzero(changes(x))
            codes.append(x[first])
            counts.append(np.diff(np.append(first, len(x))) * weight)
    return summed(np.concatenate(codes), np.concatenate(counts))[:2]


def code_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's different codes, sorted, and which of them each byte's is."""
    each = [pa.array(code).dictionary_encode() for code in _pieces(text)]
    codes = np.concatenate([x.dictionary.to_numpy() for x in each])
    codes, _, place = summed(codes, np.zeros(len(codes), np.int8))
    edge = np.cumsum([0, *(len(x.dictionary) for x in each)])
    return codes, np.concatenate([place[edge[i] : edge[i + 1]][x.indices.to_numpy()] for i, x in enumerate(each)])


def code_parts(codes: np.ndarray, parts: int) -> np.ndarray:
    """By the three nearest bytes, so that a part has whole subtrees."""
    return ((codes >> np.uint64(8 * (DEPTH - TOP))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """The order by part, which keeps that within each."""
    return np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")


class Block:
    """A block's documents, and its different words by part."""

    def __init__(self, ids: list[int | None], text: bytes, parts: int):
        self.folds, self.text = [py_crc_mod(i, FOLD) for i in ids], text
        self.train = np.array([x not in (None, HELD_OUT) for x in self.folds], bool)
        raw = np.frombuffer(text, np.uint8)
        self.size = np.diff(np.append(-1, np.flatnonzero(raw == END_TOKEN[0])))
        spaces = np.append(0, np.cumsum(raw == CLOSE[0], dtype=np.int32))
        self.n_words = np.diff(spaces[np.append(0, np.cumsum(self.size))])
        tokens = pa.array(text.split(), pa.binary()).dictionary_encode()
        words = np.array([*tokens.dictionary.to_pylist(), END_TOKEN], object)
        part = np.array([zlib.crc32(w) % parts for w in words], np.int64)
        order = by_part(part, parts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.word_part, self.word_of, self.end = words[order], part[order], place[tokens.indices.to_numpy()], place[-1]

    def word_counts(self) -> np.ndarray:
        """How often each word occurs in texts to learn from."""
        n = np.bincount(self.word_of[np.repeat(self.train, self.n_words)], minlength=len(self.words))
        n[self.end] = self.train.sum()
        return n


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, by planes of bytes, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns), 1)


def _unpacked(packed: bytes, *kinds: type) -> list[np.ndarray]:
    raw, wide, lo, out = np.frombuffer(zstandard.decompress(packed), np.uint8), [np.dtype(k).itemsize for k in kinds], 0, []
    n = len(raw) // sum(wide)
    for k, w in zip(kinds, wide, strict=True):
        out.append(np.ascontiguousarray(raw[lo : lo + n * w].reshape(w, n).T).view(k).ravel())
        lo += n * w
    return out


def _steps(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes, prepend=np.uint64(0))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


FRAMES = "part int, block string, codes binary, words binary, counts binary"


def _frames(parts: int):
    """Of each block a row for each part: its codes and words there, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in _each_block(batches, parts):
            codes, in_codes = code_counts(b.text, np.repeat(b.train, b.size))
            part, in_words = code_parts(codes, parts), b.word_counts()
            order = by_part(part, parts)
            codes, in_codes = codes[order], in_codes[order]
            edge, word_edge = (np.searchsorted(x, np.arange(parts + 1)) for x in (part[order].astype(np.int64), b.word_part))
            rows = []
            for p in np.flatnonzero(np.diff(edge) + np.diff(word_edge)):
                x, y = slice(edge[p], edge[p + 1]), slice(word_edge[p], word_edge[p + 1])
                rows.append((p, name, _packed(_steps(codes[x]), in_codes[x].astype(np.int32)), zstandard.compress(CLOSE.join(b.words[y]), 1), _packed(in_words[y].astype(np.int32))))
            kinds = [pa.int32(), pa.string()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _names(FRAMES))

    return run


def _each_block(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[str, Block]]:
    for b in batches:
        for name, ids, text in zip(*(b.column(c) for c in ("block", "doc_ids", "text")), strict=True):
            yield name.as_py(), Block(ids.as_py(), zstandard.decompress(text.as_py()), parts)


class Part:
    """What all blocks have of one part: different codes and words, with counts, and which of them each block has."""

    def __init__(self, codes: list[bytes], words: list[bytes], counts: list[bytes]):
        each = [_unpacked(x, np.uint64, np.int32) for x in codes]
        self.edge = np.cumsum([0, *(len(c) for c, _ in each)])
        self.codes, self.counts, self.at = summed(np.concatenate([np.cumsum(c) for c, _ in each]), np.concatenate([n for _, n in each]).astype(np.int64))
        # a block without words there has an empty one, which is no word
        text = pa.array([w for x in words for w in zstandard.decompress(x).split(CLOSE)], pa.binary()).dictionary_encode()
        n = [_unpacked(x, np.int32)[0] for x in counts]
        self.word_edge = np.cumsum([0, *(max(1, len(x)) for x in n)])
        self.word_at = text.indices.to_numpy()
        self.word_counts = np.bincount(self.word_at, np.concatenate([x if len(x) else [0] for x in n]), len(text.dictionary)).astype(np.int64)
        self.word_none = [not len(x) for x in n]


#: Keys of the rows that sum up: tokens, different ones, and from where on nodes are numbered.
TOKENS, KNOWN, INNER = -1, -2, 1 << 24
SOLVED = "part int, key long, n long, s double, blocks array<string>, codes array<binary>, words array<binary>, counts array<binary>"


def _solved(frames: pa.Table) -> pa.Table:
    """A part's rows as one, and what it adds to depth TOP and to the numbers of tokens."""
    lists = {c: frames.column(c).to_pylist() for c in ("block", "codes", "words", "counts")}
    part = Part(lists["codes"], lists["words"], lists["counts"])
    leaf, n, inner, s = at_top(part.codes, part.counts)
    key = np.concatenate([[TOKENS, KNOWN], leaf, INNER + inner]).astype(np.int64)
    n = np.concatenate([[part.word_counts.sum(), (part.word_counts > 0).sum()], n, 0 * inner]).astype(np.int64)
    s = np.concatenate([[0, 0], 0.0 * leaf, s])
    m = len(key)
    one = [pa.concat_arrays([pa.nulls(m, pa.list_(k)), pa.array([v], pa.list_(k))]) for v, k in zip(lists.values(), [pa.string()] + [pa.binary()] * 3, strict=True)]
    sums = [pa.concat_arrays([pa.array(x, k), pa.nulls(1, k)]) for x, k in ((key, pa.int64()), (n, pa.int64()), (s, pa.float64()))]
    return pa.table([pa.concat_arrays([pa.nulls(m, pa.int32()), frames.column("part").chunk(0)[:1]]), *sums, *one], _names(SOLVED))


def _answers(table):
    """(block, part, logp, c): of a block's codes in a part the log10 probabilities, of its words the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                blocks, codes, words, counts = (b.column(c)[row].as_py() for c in ("blocks", "codes", "words", "counts"))
                part = Part(codes, words, counts)
                logp = code_scores(part.codes, part.counts, *table.value).astype(np.float32)
                rows = []
                for i, name in enumerate(blocks):
                    x, y = slice(*part.edge[i : i + 2]), slice(*part.word_edge[i : i + 2])
                    c = part.word_counts[part.word_at[y]][: 0 if part.word_none[i] else None]
                    rows.append((name, _packed(logp[part.at[x]]), _packed(c)))
                out = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.binary(), pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays([out[0], b.column("part").slice(row, 1).take(pa.array(np.zeros(len(rows), np.int64))), *out[1:]], ["block", "part", "logp", "c"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte:
    the code length of a byte of the text's words, their closing spaces and the end."""
    docs = pick(docs, doc_id="long", text="string")
    blocks = materialize(docs.mapInArrow(_blocks, "block string, doc_ids array<long>, text binary, size long"))
    parts = 1 + (blocks.agg(F.sum("size")).first()[0] or 0) // PART
    blocks = blocks.drop("size")
    frames = blocks.mapInArrow(_frames(parts), FRAMES)
    solved = materialize(frames.repartition(parts, "part").groupBy("part").applyInArrow(_solved, SOLVED))
    sums = solved.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    key, n, s = (sums.column(c).to_numpy() for c in ("key", "n", "s"))
    total, distinct = (int(n[key == k].sum()) for k in (TOKENS, KNOWN))
    leaf, inner = (key >= 0) & (key < INNER), key >= INNER
    table = docs.sparkSession.sparkContext.broadcast(short_contexts(key[leaf], n[leaf], key[inner] - INNER, s[inner]))
    answers = solved.where("key is null").select("part", "blocks", "codes", "words", "counts").mapInArrow(_answers(table), "block string, part int, logp binary, c binary")
    floor = math.log10(total + 0.5 * (distinct + 1))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        logp, c = (np.concatenate([_unpacked(x, k)[0] for x in right.column(name).to_pylist()]) for name, k in (("logp", np.float32), ("c", np.int64)))
        (_, b), *_ = _each_block(iter(left.to_batches()), parts)
        n = b.n_words + 1
        edge = np.append(0, np.cumsum(b.n_words))
        of = lambda x: np.diff(np.append(0, np.cumsum(x[b.word_of]))[edge]) + x[b.end]
        base = of(np.log10(c + 0.5)) - floor * n
        codes, at = code_places(b.text)
        by_code = np.empty(len(codes), np.float32)
        by_code[by_part(code_parts(codes, parts), parts)] = logp
        own = np.add.reduceat(by_code[at], np.cumsum(b.size) - b.size, dtype=np.float64)
        ids = left.column("doc_ids").combine_chunks()
        ids = (pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        cols = [ids, [x == HELD_OUT for x in b.folds], n, of((c > 0).astype(np.int64)), np.full(len(n), total), base, own, -own * math.log2(10) / b.size]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, OUT, strict=True)], schema=OUT)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
