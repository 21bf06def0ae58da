"""Language-model scoring by context-tree weighting.

The model gives the log10 probability of a text's tokens: its words, lower-cased
(A-Z), each with a closing space, and one end.  A byte is decomposed into eight
binary decisions, the nodes 1..255 of a tree; a decision's context is its node
and the bytes before it in the word.  Contexts are exact: of depths 0 to 5
inside the word, and the whole word so far, however long.  Each holds the
training counts of both outcomes and a Krichevsky-Trofimov (KT) estimate.

Depths are mixed by how well each codes the training bits.  Over depths 0 to 2
that is the context tree's recursion, Pw = (Pe + prod Pw(child)) / 2, Pw = Pe at
depth 2, with its posterior weights.  Each longer context, of depth 3, 4 and 5
and last the whole word, with n0 and n1, mixes its own estimate and the
probability q that the shorter ones give as Pe(n0, n1) : (1 - q)^n0 q^n1.  A
context without training counts takes no part, nor does one of depth 3 to 5 that
occurs once.

Scale.  Depths 0 to 2 have 65,536 contexts by 256 bytes at most, whatever the
corpus: 64 MB, which are broadcast.  All longer ones grow with the vocabulary
and are never broadcast: distinct words are range-sorted, so that all words with
a common beginning stand together, and cut into slabs of ``SLAB`` words.  A
decision's counts are sums over a run of the sorted words; runs that go over a
slab's ends are completed by what each slab's first and last word share with
their neighbours (a row a slab reaches the driver).  Depths 3 to 5 are a table by
context, summed over the slabs' own counts, from which each slab gets its
contexts' rows.  A word's probability and count then go to the blocks of texts
that have it.

``base_score`` is an additive unigram score of the same tokens.

Edge cases.  A null text is scored as the empty one, which has the end only.  A
null doc_id is neither learned from nor held out.  Without training documents
every decision has probability 1/2 and the base score is 0.  Repeated rows count
each.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of, from_planes, planes
from .common import join_few, materialize, pick, py_crc_mod

FOLD, HELD_OUT = 5, 1
SLOTS, SYMBOLS, PAD = 1 << 16, 256, 255
#: Texts are cut in chunks; a block has so many.
CHUNK, CHUNKS = 3_000_000, 10
SLAB, SLAB_BYTES, AT_ONCE = 40_000, 4_000_000, 65_536
#: Depths that are kept as a table by context, and how often a context has to occur in the training tokens.
DEEP, REPEATS = (3, 4, 5), 2
#: The token that ends a text, and what closes a word; no word contains white space.
END_TOKEN, CLOSE = b"\n", b" "
#: Begins the key of a row that is a block's, not a word's.
BLOCK_MARK = b"\nblock "


# ---- contexts of depth 0 to 2


class Keys:
    """Keys as bytes, one after the other; each byte's key and place in it."""

    def __init__(self, keys: list[bytes]):
        self.size = np.array([len(k) for k in keys], np.int64)
        self.flat = np.frombuffer(b"".join(keys), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(keys), dtype=np.int32), self.size)

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Key, place, byte and slot (the last byte * 256 + the one before, PAD where there is none) of runs of bytes."""
        for lo in range(0, len(self.flat), AT_ONCE):
            hi = min(lo + AT_ONCE, len(self.flat))
            of = self.of[lo:hi]
            place = np.arange(lo, hi) - self.start[of]
            wide = np.concatenate([np.zeros(max(0, 2 - lo), np.uint8), self.flat[max(0, lo - 2) : hi]]).astype(np.int64)
            last, before = np.where(place > 0, wide[1:-1], PAD), np.where(place > 1, wide[:-2], PAD)
            yield of, place, wide[2:], last << 8 | before

    def deep(self, lo: int, hi: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the bytes lo..hi have ``depth`` bytes of their word before them, and their
        codes: depth, those bytes and the byte itself as one number."""
        at = np.arange(lo, hi)
        at = at[at - self.start[self.of[lo:hi]] >= depth]
        code = np.full(len(at), depth << 8 * depth, np.int64)
        for j in range(1, depth + 1):
            code |= self.flat[at - j].astype(np.int64) << 8 * (j - 1)
        return at - lo, code << 8 | self.flat[at]


def deep_counts(keys: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the keys with a count, at all DEEP depths, and how often they occur."""
    seen = np.flatnonzero(counts > 0)
    k, n = Keys([keys[i] for i in seen]), counts[seen]
    parts = []
    for d in DEEP:
        at, code = k.deep(0, len(k.flat), d)
        parts.append((code, n[k.of[at]]))
    code, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, weight, len(code)).astype(np.int64)


def decisions(code: np.ndarray, codes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each code how often its context occurs, and with its byte's first 1, 2, .. 8 bits;
    ``codes`` are sorted, ``upto`` has how often those before each of them occur, and at last all."""
    byte, first = code & 255, code >> 8 << 8
    out = np.empty((len(code), 9), np.int64)
    for k in range(9):
        lo = first + (byte >> (8 - k) << (8 - k))
        out[:, k] = upto[np.searchsorted(codes, lo + (1 << (8 - k)))] - upto[np.searchsorted(codes, lo)]
    return out


def context_counts(keys: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot * 256 + byte, n) of all bytes of the keys."""
    total = np.zeros(SLOTS * SYMBOLS, np.int64)
    for of, _, byte, slot in Keys(keys).slices():
        key, at = np.unique(slot << 8 | byte, return_inverse=True)
        total[key] += np.bincount(at, counts[of], len(key)).astype(np.int64)
    key = np.flatnonzero(total)
    return key, total[key]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after shifting x above 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


_SMALL = 1 << 16
_LOG_HALF, _LOG_WHOLE = _lgamma(np.arange(_SMALL) + 0.5) - 0.5 * math.log(math.pi), _lgamma(np.arange(_SMALL) + 1.0)


def _looked_up(n: np.ndarray, table: np.ndarray, shift: float, less: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    if large.any():
        out[large] = _lgamma(n[large] + shift) - less
    return out


def kt_log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a block with these counts."""
    half = 0.5 * math.log(math.pi)
    return _looked_up(zeros, _LOG_HALF, 0.5, half) + _looked_up(ones, _LOG_HALF, 0.5, half) - _looked_up(zeros + ones, _LOG_WHOLE, 1.0, 0.0)


def _nodes(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of both outcomes at the 255 decisions, of byte counts (.., 256)."""
    tree = np.zeros((*count.shape[:-1], 512), np.int64)
    tree[..., 256:] = count
    for i in range(7, -1, -1):
        lo = 1 << i
        tree[..., lo : 2 * lo] = tree[..., 2 * lo : 4 * lo : 2] + tree[..., 2 * lo + 1 : 4 * lo : 2]
    at = np.arange(1, 256)
    return tree[..., 2 * at], tree[..., 2 * at + 1]


def _prob(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def _mix(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Pw of a context, and the posterior weight of its own estimate."""
    return np.logaddexp(own, children) - math.log(2), 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def short_contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each slot, and a row's probabilities of a one at the 255 decisions (float32)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order].astype(np.int64), counts[order].astype(np.int64)
    row_of, rows = np.zeros(SLOTS, np.int32), []
    per_byte = []  # depth 1: log Pw, and the parts that depths 1 and 2 mix
    zero = np.zeros(256, np.int64)
    edge = np.searchsorted(keys >> 16, np.arange(257))
    n0 = zero.copy()
    for c1 in np.flatnonzero(np.diff(edge)):
        part = slice(edge[c1], edge[c1 + 1])
        d2 = np.zeros(256 * 256, np.int64)
        d2[keys[part] & 0xFFFF] = counts[part]
        d2 = d2.reshape(256, 256)
        used = np.flatnonzero(d2.any(1))
        d2, d1 = d2[used], d2.sum(0)
        n2, n1 = _nodes(d2), _nodes(d1)
        w1, own1 = _mix(kt_log_block(*n1), kt_log_block(*n2).sum(0))
        seen = (n2[0] + n2[1]) > 0
        below = np.where(seen, own1 * _prob(*n1) + (1 - own1) * _prob(*n2), _prob(*n1))
        per_byte.append((c1, used, w1, below, _prob(*n1), (n1[0] + n1[1]) > 0))
        n0 += d1
    n0 = _nodes(n0)
    _, own0 = _mix(kt_log_block(*n0), sum((x[2] for x in per_byte), np.zeros(255)))
    rows.append(_prob(*n0)[None])
    at = 1
    for c1, used, _, below, alone, seen in per_byte:
        mixed = np.concatenate([alone[None], below])
        rows.append(np.where(seen, own0 * _prob(*n0) + (1 - own0) * mixed, _prob(*n0)))
        row_of[c1 << 8 : (c1 + 1) << 8] = at
        row_of[(c1 << 8) + used] = at + 1 + np.arange(len(used))
        at += len(mixed)
    # beyond 2**24 occurrences a float32 rounds what never failed to 1, and the other outcome's logarithm would not be finite
    return row_of, np.minimum(np.concatenate(rows).astype(np.float32), np.nextafter(np.float32(1), np.float32(0)))


# ---- whole words' contexts, over sorted keys


def common_bits(keys: list[bytes]) -> np.ndarray:
    """The number of first bits that each key shares with the one before; 0 for the first."""
    sizes = np.array([len(k) for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), np.uint8)
    start = np.cumsum(sizes) - sizes
    out = np.zeros(len(keys), np.int64)
    open_, d = np.arange(1, len(keys)), 0
    while len(open_):
        open_ = open_[np.minimum(sizes[open_], sizes[open_ - 1]) > d]
        x = flat[start[open_] + d] ^ flat[start[open_ - 1] + d]
        apart = x > 0
        out[open_[apart]] = 8 * d + 7 - np.floor(np.log2(x[apart])).astype(np.int64)
        open_, d = open_[~apart], d + 1
    return out


def runs_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of runs of these sizes."""
    edge = np.append(0, np.cumsum(size))
    return np.repeat(start - edge[:-1], size) + np.arange(edge[-1])


def beginning_counts(keys: list[bytes], counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key, how many training tokens begin with its first 0, 1, ... bits; where
    each key's numbers begin, and up to how many bits they go (the last holds for all further ones).

    ``left``, ``right``: by number of bits, from 0 on, what the keys before and after share with the first and the last key.
    """
    lcp = common_bits(keys)
    shared = np.maximum(lcp, np.append(lcp[1:], 0))
    far = [np.minimum.accumulate(np.append(1 << 60, lcp[1:])), np.minimum.accumulate(np.append(1 << 60, lcp[1:][::-1]))[::-1]]
    beside = [np.minimum(f + 1, len(more)) for f, more in zip(far, (left, right), strict=True)]
    upto = np.minimum(8 * np.array([len(k) for k in keys], np.int64), np.maximum(shared, np.maximum(*beside)) + 1)
    begin = np.cumsum(upto + 1) - upto - 1
    out = np.repeat(counts, upto + 1)
    last = -1
    for u in np.unique(np.append(0, lcp)):
        # keys stand in one group for last < bits <= u as long as neighbours share u bits
        first = np.flatnonzero(np.append(True, lcp[1:] < u))
        total = np.repeat(np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))))
        own = np.flatnonzero(shared >= u)
        out[runs_of(begin[own] + last + 1, np.full(len(own), u - last))] = np.repeat(total[own], u - last)
        last = u
    for more, n in zip((left, right), beside, strict=True):
        n = np.minimum(n, upto + 1)
        out[runs_of(begin, n)] += more[runs_of(np.zeros(len(keys), np.int64), n)]
    return out, begin, upto


def _mixed(q: np.ndarray, same: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The probability of decisions that a context with these counts makes of that of the shorter ones."""
    other = total - same
    own, short = kt_log_block(other, same), same * np.log(q) + other * np.log1p(-q)
    weight = 1 / (1 + np.exp(np.clip(own - short, -700, 700)))
    return np.where(total > 0, weight * q + (1 - weight) * (same + 0.5) / (total + 1), q)


def word_scores(keys: list[bytes], counts: np.ndarray, left: np.ndarray, right: np.ndarray, row_of: np.ndarray, rows: np.ndarray, codes: np.ndarray, upto_code: np.ndarray) -> np.ndarray:
    """log10 probability of each key of a slab; ``codes`` and ``upto_code`` are those of ``decisions``."""
    n, begin, upto = beginning_counts(keys, counts, left, right)
    out, step, lo = np.zeros(len(keys)), np.arange(8), 0
    all_keys = Keys(keys)
    for of, place, byte, slot in all_keys.slices():
        bit = (byte[:, None] >> (7 - step) & 1).astype(bool)
        q = rows[row_of[slot][:, None], ((1 << step) | (byte[:, None] >> (8 - step))) - 1].astype(np.float64)
        q = np.where(bit, q, 1 - q)
        for d in DEEP:
            at, code = all_keys.deep(lo, lo + len(of), d)
            each, which = np.unique(code, return_inverse=True)
            counted = decisions(each, codes, upto_code)
            known = counted[:, 0] > 0
            at, counted = at[known[which]], counted[which[known[which]]]
            q[at] = _mixed(q[at], counted[:, 1:], counted[:, :-1])
        at = 8 * place[:, None] + np.arange(9)
        counted = n[begin[of][:, None] + np.minimum(at, upto[of][:, None])]
        out += np.bincount(of, np.log10(_mixed(q, counted[:, 1:], counted[:, :-1])).sum(1), len(keys))
        lo += len(of)
    return out


# ---- texts and tables


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = cut.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    edge = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[cut.offsets.to_numpy()]
    return flat.filter(real), np.diff(edge)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct words, every token's word, and of each document its id, number of words, and bytes."""
    held: list[tuple] = []

    def close() -> tuple:
        tokens = pa.chunked_array([x[0] for x in held]).unify_dictionaries()
        words = tokens.chunk(0).dictionary
        out = (words, np.concatenate([c.indices.to_numpy() for c in tokens.chunks]), pa.concat_arrays([x[1] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (2, 3)))
        held.clear()
        return out

    for chunk in blocks_of(batches, CHUNK):
        flat, sizes = _words(chunk.column("text").combine_chunks())
        length = np.append(0, np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64) + 1))
        edge = np.append(0, np.cumsum(sizes))
        held.append((flat.dictionary_encode(), chunk.column("doc_id").combine_chunks(), sizes, np.diff(length[edge]) + 1))
        del chunk, flat
        pa.default_memory_pool().release_unused()
        if len(held) >= CHUNKS:
            yield close()
    if held:
        yield close()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): a block's words closed, and the end, with their counts in the training fold."""
    for words, tokens, ids, sizes, _ in _blocks(batches):
        train = np.array([py_crc_mod(i, FOLD) not in (None, HELD_OUT) for i in ids.to_pylist()], bool)
        n = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words))
        key = pc.binary_join_element_wise(words.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(CLOSE, pa.large_binary())).cast(pa.binary())
        whole = pa.RecordBatch.from_arrays([pa.concat_arrays([key, pa.array([END_TOKEN])]), pa.array(np.append(n, train.sum()).astype(np.int64))], ["key", "n"])
        for i in range(0, whole.num_rows, 50_000):
            yield whole.slice(i, 50_000)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, keys, counts) of runs of sorted (key, n)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        key, n = (t.column(i).combine_chunks() for i in (0, 1))
        return pa.RecordBatch.from_arrays([key.slice(0, 1), pa.ListArray.from_arrays([0, len(key)], key), pa.ListArray.from_arrays([0, len(n)], n)], ["first", "keys", "counts"])

    for b in batches:
        while b.num_rows:
            held.append(b.slice(0, SLAB - size))
            size += held[-1].num_rows
            b = b.slice(held[-1].num_rows)
            if size >= SLAB or sum(x.nbytes for x in held) >= SLAB_BYTES:
                yield close()
                size = 0
    if held:
        yield close()


NONE = np.zeros(0, np.int64)


def _each_slab(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for k, n in zip(batch.column("keys"), batch.column("counts"), strict=True):
        yield k.values.to_pylist(), n.values.to_numpy()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slab: first and last key, tokens, tokens that begin as these two do (by bits, as
    runs), what the two share, and the numbers of keys with a count."""
    for b in batches:
        rows = []
        for keys, counts in _each_slab(b):
            n, begin, upto = beginning_counts(keys, counts, NONE, NONE)
            ends = []
            for i in (0, len(keys) - 1):
                own = n[begin[i] : begin[i] + upto[i] + 1]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                ends += [at.tolist(), own[at].tolist()]
            both = int(common_bits([keys[0], keys[-1]])[1]) if len(keys) > 1 else 8 * len(keys[0])
            rows.append((keys[0], keys[-1], int(counts.sum()), int((counts > 0).sum()), both, *ends))
        kinds = [pa.binary()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], SUMMARY)


SUMMARY = ["first", "last", "tokens", "known", "both", "first_at", "first_n", "last_at", "last_n"]


def _dense(at: list[int], n: list[int], bits: int) -> np.ndarray:
    """The counts for 0 to ``bits`` bits of what is given as runs."""
    return np.repeat(np.array(n, np.int64), np.diff(np.append(np.minimum(at, bits + 1), bits + 1)))


def shared_over_slabs(slabs: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What the keys of all slabs before and after each one (in order) share with its first
    and its last key, by the number of bits."""

    def one_way(order: list[dict], here: str, there: str) -> list[np.ndarray]:
        out = []
        for i, s in enumerate(order):
            if not i:
                out.append(NONE)
                continue
            p = order[i - 1]
            bits = int(common_bits(sorted([p[there], s[here]]))[1])
            n = _dense(p[f"{there}_at"], p[f"{there}_n"], bits)
            k = min(p["both"] + 1, len(out[-1]), len(n))
            n[:k] += out[-1][:k]
            out.append(n)
        return out

    return list(zip(one_way(slabs, "first", "last"), one_way(slabs[::-1], "last", "first")[::-1], strict=True))


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS * SYMBOLS, np.int64)
    for b in batches:
        for keys, counts in _each_slab(b):
            k, n = context_counts(keys, counts)
            total[k] += n
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["key", "n"])


def _deep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, counts in _each_slab(b):
            code, n = deep_counts(keys, counts)
            for i in range(0, len(code), 200_000):
                part = code[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part >> 8), pa.array((part & 255).astype(np.int16)), pa.array(n[i : i + 200_000])], ["ctx", "byte", "n"])


def _deep_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slab, ctx): the contexts that a slab's keys have."""
    for b in batches:
        for slab, (keys, _) in zip(b.column("slab").to_pylist(), _each_slab(b), strict=True):
            k = Keys(keys)
            ctx = np.unique(np.concatenate([k.deep(0, len(k.flat), d)[1] for d in DEEP]) >> 8)
            for i in range(0, len(ctx), 200_000):
                part = ctx[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), slab, np.int32)), pa.array(part)], ["slab", "ctx"])


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(word, c, logp) of all words and the end (binary), stored; the training tokens, and how many differ."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(_counted, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    slabs = materialize(counted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_slabs, "first binary, keys array<binary>, counts array<long>"))
    kinds = "first binary, last binary, tokens long, known long, both long, first_at array<long>, first_n array<long>, last_at array<long>, last_n array<long>"
    found = sorted(slabs.mapInArrow(_summaries, kinds).toArrow().to_pylist(), key=lambda r: r["first"])
    short = slabs.mapInArrow(_context_rows, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    table = spark.sparkContext.broadcast(short_contexts(short.column("key").to_numpy(), short.column("n").to_numpy()))
    beside = [(r["first"], i, a.tolist(), b.tolist()) for i, (r, (a, b)) in enumerate(zip(found, shared_over_slabs(found), strict=True))]
    beside = spark.createDataFrame(beside, "first binary, slab int, before array<long>, after array<long>")
    # few files, much work: slabs are dealt out again
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = join_few(slabs.repartition(parts), beside, "first").select("slab", "keys", "counts", "before", "after")
    # one exchange by context serves the sum, the lists and the join
    deep = slabs.mapInArrow(_deep_rows, "ctx long, byte short, n long").repartition("ctx").groupBy("ctx", "byte").agg(F.sum("n").alias("n"))
    deep = deep.groupBy("ctx").agg(F.collect_list(F.col("n") * 256 + F.col("byte")).alias("l"), F.sum("n").alias("t")).where(F.col("t") >= REPEATS).select("ctx", "l")
    answers = numbered.select("slab", "keys", "counts").mapInArrow(_deep_asked, "slab int, ctx long").join(deep, "ctx").select("slab", "ctx", "l")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.column("l").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten().to_numpy()
        codes = np.repeat(right.column("ctx").to_numpy(), lists.value_lengths().to_numpy()) << 8 | flat & 255
        order = np.argsort(codes)
        codes, upto = codes[order], np.append(0, np.cumsum(flat[order] >> 8))
        out = [pa.table([pa.nulls(0, t) for t in (pa.binary(), pa.int64(), pa.float64())], ["word", "c", "logp"])]
        for b in left.to_batches():
            around = zip(b.column("before"), b.column("after"), strict=True)
            for (keys, counts), (x, y) in zip(_each_slab(b), around, strict=True):
                logp = word_scores(keys, counts, x.values.to_numpy(), y.values.to_numpy(), *table.value, codes, upto)
                words = [k if k == END_TOKEN else k[:-1] for k in keys]
                out.append(pa.table([pa.array(words, pa.binary()), pa.array(counts), pa.array(logp)], ["word", "c", "logp"]))
        return pa.concat_tables(out)

    of_slab = answers.select(F.col("slab").alias("of"), "ctx", "l").groupBy("of")
    scored = materialize(numbered.groupBy("slab").cogroup(of_slab).applyInArrow(score, "word binary, c long, logp double"))
    return scored, sum(r["tokens"] for r in found), sum(r["known"] for r in found)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a block, and one with its documents as numbers of words."""
    for words, tokens, ids, sizes, n_bytes in _blocks(batches):
        one = pa.table({k: pa.LargeListArray.from_arrays([0, len(v)], v) for k, v in (("doc_id", ids), ("size", pa.array(sizes, pa.int32())), ("bytes", pa.array(n_bytes, pa.int64())), ("tokens", planes(tokens)))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as w:
            w.write_table(one)
        payload = sink.getvalue().to_pybytes()
        of, n = int(np.uint64(xxhash.xxh3_64_intdigest(payload)).view(np.int64)), len(words)
        last = np.arange(n + 1) == n
        cols = [
            pa.concat_arrays([words.cast(pa.large_binary()).cast(pa.binary()), pa.array([BLOCK_MARK + str(of).encode()])]), pa.array(np.full(n + 1, of, np.int64)),
            pa.array(np.arange(n + 1), pa.int32(), mask=last), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([payload], pa.binary())]),
        ]
        whole = pa.RecordBatch.from_arrays(cols, ["word", "block", "number", "payload"])
        for i in range(0, n + 1, 50_000):
            yield whole.slice(i, 50_000)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's words of each block, with count and log10 probability, in one compressed binary."""
    held: list[list[np.ndarray]] = []

    def close() -> pa.RecordBatch:
        block, number, c, logp = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        by = np.lexsort((number, block))
        block, number, c, logp = block[by], number[by], c[by], logp[by]
        edge = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        packed = [
            zstandard.compress(np.array([len(x)], np.int32).tobytes() + planes(np.diff(x, prepend=np.int32(0))).to_numpy().tobytes() + y.astype(np.int64).tobytes() + z.tobytes(), 3)
            for x, y, z in zip(*(np.split(v, edge[1:]) for v in (number, c, logp)), strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array([BLOCK_MARK + str(x).encode() for x in block[edge]]), pa.array(packed, pa.binary())], ["of", "packed"])

    for b in batches:
        held.append([b.column("block").to_numpy(), b.column("number").to_numpy(), b.column("c").to_numpy(), b.column("logp").to_numpy().astype(np.float32)])
        if sum(len(x[0]) for x in held) >= 500_000:
            yield close()
    if sum(len(x[0]) for x in held):
        yield close()


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte:
    the code length of a byte of the text's words, their closing spaces and the end."""
    docs = pick(docs, doc_id="long", text="string")
    scored, total, distinct = vocabulary(docs)
    end = scored.where(F.col("word") == F.lit(END_TOKEN)).first()
    floor = math.log10(total + 0.5 * (distinct + 1))
    # as in pieces.py: one exchange, whose readers use all columns
    rows = docs.mapInArrow(_numbered, "word binary, block long, number int, payload binary").repartition("word").where("word is not null")
    known = rows.join(scored, "word").select("block", "number", "c", "logp", F.length("payload").alias("none")).mapInArrow(_gathered, "of binary, packed binary")
    blocks = rows.where("payload is not null or monotonically_increasing_id() < 0")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.Table.from_batches([], OUT)]
        for payload in left.column("payload").to_pylist():
            one = {k: c[0].values for k, c in zip(*(lambda x: (x.schema.names, x.columns))(pa.ipc.open_stream(payload).read_all()), strict=True)}
            tokens, sizes = from_planes(one["tokens"].to_numpy()), one["size"].to_numpy().astype(np.int64)
            count, logp = np.full(tokens.max(initial=-1) + 1, -1, np.int64), np.zeros(tokens.max(initial=-1) + 1)
            for packed in right.column("packed").to_pylist():
                raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
                n = int(raw[:4].view(np.int32)[0])
                at = np.cumsum(from_planes(raw[4 : 4 + 4 * n]))
                count[at], logp[at] = raw[4 + 4 * n : 4 + 12 * n].copy().view(np.int64), raw[4 + 12 * n :].copy().view(np.float32)
            if (count < 0).any():
                raise ValueError("the documents gave other words when they were read again")
            edge = np.append(0, np.cumsum(sizes))
            of = lambda x: np.diff(np.append(0, np.cumsum(x))[edge])  # noqa: B023, E731
            ids, n = one["doc_id"], sizes + 1
            own = of(logp[tokens]) + end.logp
            base = of(np.log10(count + 0.5)[tokens]) + math.log10(end.c + 0.5) - floor * n
            bits = -own * math.log2(10) / one["bytes"].to_numpy()
            held = pa.array([py_crc_mod(i, FOLD) == HELD_OUT for i in ids.to_pylist()], pa.bool_())
            cols = [ids, held, n, of((count > 0)[tokens].astype(np.int64)) + int(end.c > 0), np.full(len(n), total), base, own, bits]
            out.append(pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.groupBy("word").cogroup(known.groupBy("of")).applyInArrow(finish, schema)


OUT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()),
])
