"""SentencePiece encoding and decoding by a relational lattice.

Encoding.  Text gets a leading space and spaces become the mark U+2581, as the
model's identity normaliser has it.  No piece continues over the mark or over a
line feed, so texts are cut there into words, and only distinct words are
encoded: their substrings of bounded length are exploded and equi-joined to the
piece table, edges are grouped by word, and the path through the lattice is
folded with Spark's higher-order ``aggregate``.  Texts travel in blocks
(blocks.py) as numbers of their words, and the words' ids come back to the blocks.

The fold follows the kind of model.  For a unigram model it is Viterbi.  The
installed model is BPE, for which the best sum of scores is *not* what
SentencePiece returns; so there the fold replays its merges on the same lattice:
the enabled edge of the best score, leftmost first, until none is left.  Both
are exact.  A character outside the vocabulary becomes its bytes' pieces.

Words of more than ``FOLD_CHARS`` characters do not fit the fold's bit set; they
are encoded, equally exactly, by ``encode_word`` where texts are put together.  So
is a word whose answer does not come back (a source that gives other rows when a
task is repeated), so ids are never wrong.

Decoding concatenates pieces (bytes for byte pieces), turns marks into spaces
and drops the leading one; ill-formed UTF-8 becomes U+FFFD, control ids nothing.

Edge cases.  A null text gives null ids, an empty one no ids.  A mark in the
text decodes to a space.  A null list of ids decodes to null, an id outside the
table raises.  Repeated rows are encoded each.  An empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks_of, from_planes, planes
from .common import pick

MARK, FOLD_CHARS = "▁", 60
#: Texts are cut in chunks; a block is so many chunks, or fewer if they have so many different words.
CHUNK, CHUNKS, MOST_WORDS = 3_000_000, 20, 600_000
#: Tokens whose ids are put together at a time, or those of one document.
TOKENS_AT_ONCE = 500_000
#: Begins the key of a row that is a block's, not a word's.
BLOCK_MARK = "\0block "
COARSE = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def coarse_words(text: str | None) -> list[str]:
    """Cuts at spaces and line feeds; a leading space is added to all but empty texts."""
    return COARSE.findall(MARK + text.replace(" ", MARK)) if text else []


@dataclass(frozen=True)
class PieceTable:
    """A model's pieces: text, id and score of normal ones, ids of byte pieces."""

    normal: dict[str, tuple[int, float]]
    raw: list[bytes]  # by id, what a piece decodes to
    byte: list[int]  # id of each byte
    unknown: int
    bpe: bool
    fine: bool  # no piece holds letters and other characters

    def piece_ids(self, piece: str) -> list[int]:
        """A piece's id; of an unknown character, those of its bytes."""
        hit = self.normal.get(piece)
        return [hit[0]] if hit else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def parts(self, word: str) -> list[str]:
        """What a coarse word is cut into further."""
        body = word[1:] if word[0] == MARK else word
        if not self.fine or body.isalpha():
            return [word]
        if body[:-1].isalpha():
            return [word[:-1], body[-1]]
        body = word.lstrip(MARK)
        if not body:
            return [word]
        runs = ["".join(g) for _, g in itertools.groupby(body, str.isalpha)]
        runs[0] = word[: len(word) - len(body)] + runs[0]
        return runs

    def words(self, text: str | None) -> list[str]:
        """The words that a text is cut into."""
        return [p for w in coarse_words(text) for p in self.parts(w)]

    @property
    def longest(self) -> int:
        return max(map(len, self.normal), default=1)


def load_pieces(model_file: str, bpe: bool = True) -> PieceTable:
    """Read a model file.  The number of pieces is a parameter of the model, not of the data."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    normal, raw, byte = {}, [], [sp.unk_id()] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
            byte[raw[-1][0]] = i
        elif sp.is_control(i) or sp.is_unused(i):
            raw.append(b"")
        elif sp.is_unknown(i):
            raw.append(" ⁇ ".encode())
        else:
            raw.append(piece.encode())
            normal[piece] = (i, sp.get_score(i))
    if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in normal):
        raise ValueError("a piece continues over a space or a line feed; such models are not cut into words here")
    fine = not any(a.isalpha() != b.isalpha() for p in normal for a, b in zip(p, p[1:], strict=False) if a != MARK)
    return PieceTable(normal, raw, byte, sp.unk_id(), bpe, fine)


def coarse_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The coarse words of all texts one after the other (dictionary-encoded), how
    many each text has, and the texts' order here.

    Texts without runs of spaces are split by Arrow, the others by COARSE.
    """
    texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.replace_substring(texts.cast(pa.large_string()), MARK, " "), pa.scalar("", pa.large_string()))
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, "\0"), pc.equal(texts, " ")))
    odd = pc.fill_null(odd, True).to_numpy(zero_copy_only=False)
    first, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts.take(first), " ", "\0 "), "\n", "\0\n\0"), "\0")
    flat = cut.flatten()
    real = pc.not_equal(flat, "")
    edge = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[cut.offsets.to_numpy()]
    own = [coarse_words(t[1:] if t else t) for t in texts.take(rest).to_pylist()]
    tokens = pa.concat_arrays([flat.filter(real), pa.array([w.replace(MARK, " ") for ws in own for w in ws], pa.large_string())])
    sizes = np.concatenate([np.diff(edge), np.array([len(ws) for ws in own], np.int64)]).astype(np.int64)
    return tokens.dictionary_encode(), sizes, np.concatenate([first, rest])


class WordBlock:
    """Documents as numbers of their words: first of coarse ones, and what those are cut into."""

    def __init__(self, t: PieceTable):
        self.t = t
        self.coarse: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.counts, self.parts = array("i"), array("i")
        self.doc_id: list[pa.Array] = []
        self.size: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.said: list[bytes | None] = []

    def add(self, block: pa.Table) -> None:
        texts = block.column("text").combine_chunks()
        tokens, sizes, order = coarse_tokens(texts)
        coarse, words, counts, parts, cut = self.coarse, self.words, self.counts, self.parts, self.t.parts
        at = []
        for w in pc.replace_substring(tokens.dictionary, " ", MARK).to_pylist():
            new = len(coarse)
            k = coarse.setdefault(w, new)
            at.append(k)
            if k == new:
                own = cut(w)
                counts.append(len(own))
                for p in own:
                    new = len(words)
                    i = words.setdefault(p, new)
                    parts.append(0 if i == new else i + 1)  # 0: the next new one
        at = np.array(at, np.int32)
        self.tokens.append(at[tokens.indices.to_numpy()])
        self.size.append(sizes)
        self.doc_id.append(block.column("doc_id").combine_chunks().take(pa.array(order)))
        self.said += [None if x is None else xxhash.xxh3_128_digest(x.replace(MARK, " ").encode("utf-8", "surrogatepass")) for x in texts.take(order).to_pylist()]

    def pack(self) -> tuple[pa.Array, bytes]:
        """The distinct words, and all that is needed to put the ids together."""
        words = pa.array(self.words.keys(), pa.string())
        one = {
            "doc_id": pa.concat_arrays(self.doc_id), "size": pa.array(np.concatenate(self.size), pa.int32()), "said": pa.array(self.said, pa.binary(16)),
            "tokens": planes(np.concatenate(self.tokens)), "counts": planes(self.counts), "parts": planes(self.parts), "words": words,
        }
        one = pa.table({k: pa.LargeListArray.from_arrays([0, len(v)], v) for k, v in one.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as w:
            w.write_table(one)
        return words, sink.getvalue().to_pybytes()


def word_blocks(batches: Iterator[pa.RecordBatch], t: PieceTable, chunk_bytes: int, chunks: int, most_words: int) -> Iterator[tuple[pa.Array, bytes]]:
    """Packed blocks of up to ``chunks`` chunks, or until there are ``most_words`` coarse words."""
    held, n = WordBlock(t), 0
    for chunk in blocks_of(batches, chunk_bytes):
        held.add(chunk)
        del chunk
        pa.default_memory_pool().release_unused()
        n += 1
        if n >= chunks or len(held.coarse) >= most_words:
            yield held.pack()
            held, n = WordBlock(t), 0
    if n:
        yield held.pack()


def take_lists(offsets: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the lists at ``at``."""
    size = np.diff(offsets)[at]
    out = np.append(0, np.cumsum(size))
    return out, flat[np.repeat(offsets[at] - out[:-1], size) + np.arange(out[-1])]


def put_together(payload: bytes, answers: list[bytes], t: PieceTable, raw: pa.Array) -> pa.Table:
    """doc_id, ids, round_trip of a block, given the packed ids of its words.

    A word without an answer (a single character, a long one, or one whose answer
    was lost) is encoded here, exactly.
    """
    one = {k: c[0].values for k, c in zip(*(lambda x: (x.schema.names, x.columns))(pa.ipc.open_stream(payload).read_all()), strict=True)}
    if not len(one["doc_id"]):
        return EMPTY
    packed = [unpack_ids(x) for x in answers]
    number = np.concatenate([np.zeros(0, np.int64), *[n for n, _, _ in packed]])
    size = np.concatenate([np.zeros(0, np.int64), *[s for _, s, _ in packed]])
    flat = np.concatenate([np.zeros(0, np.int32), *[f for _, _, f in packed]])
    n = len(one["words"])
    at = np.full(n, -1, np.int64)
    at[number] = np.arange(len(number))
    missing = np.flatnonzero(at < 0)
    known = [encode_word(w, t) for w in one["words"].take(pa.array(missing)).to_pylist()]
    at[missing] = len(number) + np.arange(len(missing))
    offsets = np.append(0, np.cumsum(np.concatenate([size, np.array([len(x) for x in known], np.int64)])))
    flat = np.concatenate([flat, np.array([i for x in known for i in x], np.int32)])
    # ids of words, of coarse words, of texts
    parts = from_planes(one["parts"].to_numpy())
    parts = np.where(parts == 0, np.cumsum(parts == 0) - 1, parts - 1)
    by_part, flat = take_lists(offsets, flat, at[parts])
    offsets = by_part[np.append(0, np.cumsum(from_planes(one["counts"].to_numpy())))]
    tokens, said, null = from_planes(one["tokens"].to_numpy()), one["said"].to_pylist(), one["said"].is_null().to_numpy(zero_copy_only=False)
    edge = np.append(0, np.cumsum(one["size"].to_numpy().astype(np.int64)))
    ids, same, i = [], [], 0
    while i < len(said):  # some documents at a time
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + TOKENS_AT_ONCE)))
        j = min(j, len(said))
        by_token, own = take_lists(offsets, flat, tokens[edge[i] : edge[j]])
        at = by_token[edge[i : j + 1] - edge[i]]
        ids.append(pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(null[i:j], False)), pa.array(own)))
        back = raw.take(pa.array(own))
        data, place = memoryview(back.buffers()[2] or b""), back.buffers()[1]
        place = (np.frombuffer(place, np.int64)[at] if place else np.zeros(len(at), np.int64)).tolist()
        same += [None if x is None else xxhash.xxh3_128_digest(data[min(a + 1, b) : b]) == x for x, a, b in zip(said[i:j], place, place[1:], strict=False)]
        i = j
    return pa.Table.from_arrays([one["doc_id"], pa.chunked_array(ids), pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])


EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32())), "round_trip": pa.array([], pa.bool_())})


def cut_word(word: str, cut: int, t: PieceTable) -> list[int]:
    """Ids of a word whose pieces begin at the set bits of ``cut``."""
    at = [i for i in range(len(word)) if cut >> i & 1]
    return [i for a, b in zip(at, [*at[1:], len(word)], strict=True) for i in t.piece_ids(word[a:b])]


def encode_word(word: str, t: PieceTable) -> list[int]:
    """Exact encoding of one word of any length, by a heap (BPE) or Viterbi."""
    if t.bpe:
        import heapq

        part, left, right = list(word), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (hit := t.normal.get(part[i] + part[j])):
                heapq.heappush(heap, (-hit[1], i, j, part[i] + part[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, j, text = heapq.heappop(heap)
            if part[i] and part[j] and right[i] == j and part[i] + part[j] == text:
                part[i], part[j], right[i] = text, "", right[j]
                if right[i] >= 0:
                    left[right[i]] = i
                offer(left[i])
                offer(i)
        parts = [p for p in part if p]
    else:
        best: list[tuple[float, int]] = [(0.0, 0)]
        lowest = min((s for _, s in t.normal.values()), default=0.0) - 10
        for e in range(1, len(word) + 1):
            at = [(best[s][0] + t.normal[word[s:e]][1], -s) for s in range(max(0, e - t.longest), e) if word[s:e] in t.normal]
            if word[e - 1] not in t.normal:
                at.append((best[e - 1][0] + lowest, 1 - e))
            score, s = max(at)
            best.append((score, -s))
        parts, e = [], len(word)
        while e:
            parts.append(word[best[e][1] : e])
            e = best[e][1]
        parts.reverse()
    return [i for p in parts for i in t.piece_ids(p)]


#: b is the set of positions between pieces; the best enabled edge removes the one inside it.
#: Once no edge is enabled b is negated, which ends the work.
_MERGE = """transform(array(transform(edges, x -> struct(
        shiftleft(1L, cast(shiftright(x, 8) & 255 AS int)) | shiftleft(1L, cast(x & 255 AS int)) AS ends,
        shiftleft(1L, cast(x & 255 AS int)) - shiftleft(1L, cast((shiftright(x, 8) & 255) + 1 AS int)) AS inner))),
    multi -> abs(aggregate(sequence(1, n), shiftleft(1L, n + 1) - 1L, (b, i) -> if(b < 0, b, coalesce(
        b & ~get(filter(multi, x -> (b & x.ends) = x.ends AND bit_count(b & x.inner) = 1), 0).inner, -b)))))[0]"""
#: Best (score, path) for each position: edges come by end, so a position is final before it is used.
_VITERBI = """aggregate(element_at(aggregate(array_sort(edges, (x, y) -> case when x.e != y.e then x.e - y.e else x.s - y.s end),
    transform(sequence(0, n), i -> struct(if(i = 0, 0.0D, -1e300D) AS score, cast(array() AS array<int>) AS path)),
    (best, x) -> if(best[x.s].score + x.score > best[x.e].score,
        transform(best, (v, i) -> if(i = x.e, struct(best[x.s].score + x.score AS score, concat(best[x.s].path, array(x.s)) AS path), v)), best)),
    -1).path, shiftleft(1L, n), (b, s) -> b | shiftleft(1L, s))"""


def cut_words(words: DataFrame, t: PieceTable) -> DataFrame:
    """(word, cut) of distinct words of 2 to FOLD_CHARS characters: the bits of
    ``cut`` are the positions where pieces begin, and the end."""
    spark = words.sparkSession
    order = sorted({s for _, s in t.normal.values()}, reverse=True)
    rank = {s: i for i, s in enumerate(order)}
    rows = [(p, rank[s], float(s)) for p, (_, s) in t.normal.items()]
    rows += [("", 0, 0.0)] * t.bpe  # an edge from 0 to 0, never enabled, so that every word comes back
    table = F.broadcast(spark.createDataFrame(rows, "piece string, rank long, score double"))  # bounded by the model
    least = 2 if t.bpe else 1
    n = F.char_length("word").alias("n")
    sub = words.select("word", n).select("word", "n", F.expr(f"explode(sequence(0, greatest(0, n - {least}))) AS s"))
    ends = f"sequence({least}, greatest({least}, least({t.longest}, n - s)))"
    sub = sub.select("word", "n", "s", F.expr(f"explode(if(s = 0, concat(array(0), {ends}), {ends})) AS k" if t.bpe else f"explode({ends}) AS k"))
    sub = sub.select("word", "n", "s", "k", F.expr("substring(word, s + 1, k) AS piece"))
    if t.bpe:
        # best rank first, then leftmost: the order of packed longs
        edge = F.expr("shiftleft(rank, 16) + cast(s * 256 + s + k AS long)").alias("edge")
        lattice = sub.join(table, "piece").select("word", edge).groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
        return lattice.select("word", n, "edges").select("word", F.expr(_MERGE).alias("cut"))
    lowest = order[-1] - 10 if order else -10.0
    edge = F.expr(f"struct(s, s + k AS e, coalesce(score, {lowest}D) AS score)")
    lattice = sub.join(table, "piece", "left").where("score is not null or k = 1").groupBy("word").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
    return lattice.select("word", F.expr(_VITERBI).alias("cut"))


def pack_ids(number: np.ndarray, ids: pa.ListArray) -> bytes:
    """Numbers of words in ascending order and their ids, compressed."""
    lengths = np.diff(ids.offsets.to_numpy()).astype(np.int32)
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    head = np.array([len(number)], np.int32)
    cols = [planes(x).to_numpy().tobytes() for x in (np.diff(number, prepend=np.int32(0)), lengths, flat)]
    return zstandard.compress(head.tobytes() + b"".join(cols), 5)


def unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words, how many ids each has, and the ids."""
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    n = int(raw[:4].view(np.int32)[0])
    step, size, flat = (from_planes(x) for x in np.split(raw[4:], [4 * n, 8 * n]))
    return np.cumsum(step), size, flat.astype(np.int32)


def encode(docs: DataFrame, t: PieceTable, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, ids, round_trip: whether the ids decode to the text (a mark in it as a space)."""
    docs = pick(docs, doc_id="long", text="string")
    pieces = docs.sparkSession.sparkContext.broadcast(t)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word to be encoded, and one with what is left of the block."""
        for words, payload in word_blocks(batches, pieces.value, chunk_bytes, CHUNKS, MOST_WORDS):
            of = int(np.uint64(xxhash.xxh3_64_intdigest(payload)).view(np.int64))
            length = pc.utf8_length(words)
            asked = np.flatnonzero(pc.and_(pc.greater(length, 1), pc.less_equal(length, FOLD_CHARS)).to_numpy(zero_copy_only=False))
            n = len(asked)
            last = np.arange(n + 1) == n
            cols = [
                pa.concat_arrays([words.take(pa.array(asked)), pa.array([BLOCK_MARK + str(of)])]), pa.array(np.full(n + 1, of, np.int64)),
                pa.array(np.append(asked, 0), pa.int32(), mask=last), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([payload], pa.binary())]),
            ]
            del words, payload, length, asked
            pa.default_memory_pool().release_unused()
            whole = pa.RecordBatch.from_arrays(cols, ["word", "block", "number", "payload"])
            for i in range(0, n + 1, 50_000):
                yield whole.slice(i, 50_000)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's answers for each block in one compressed binary; rows of a word follow each other."""
        held: list[tuple[np.ndarray, np.ndarray, pa.ListArray]] = []

        def flush() -> pa.RecordBatch:
            block, number = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            ids = pa.concat_arrays([x[2] for x in held])
            held.clear()
            by = np.lexsort((number, block))
            block, number = block[by], number[by].astype(np.int32)
            edge = [*np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)]
            packed = [pack_ids(number[i:j], ids.take(pa.array(by[i:j]))) for i, j in itertools.pairwise(edge)]
            return pa.RecordBatch.from_arrays([pa.array([BLOCK_MARK + str(x) for x in block[edge[:-1]]]), pa.array(packed, pa.binary())], ["of", "packed"])

        for b in batches:
            word = b.column("word").dictionary_encode()
            at = word.indices.to_numpy()
            cut = np.zeros(len(word.dictionary), np.int64)
            cut[at] = b.column("cut").to_numpy()
            ids = [cut_word(w, c, pieces.value) for w, c in zip(word.dictionary.to_pylist(), cut.tolist(), strict=True)]
            held.append((b.column("block").to_numpy(), b.column("number").to_numpy(), pa.array(ids, pa.list_(pa.int32())).take(word.indices)))
            if sum(len(x[0]) for x in held) >= 500_000:
                yield flush()
        if sum(len(x[0]) for x in held):
            yield flush()

    # words and blocks go through one exchange, which three branches read: each uses all columns and
    # none has a filter of its own that can be pushed below, so that the texts are cut once
    rows = docs.mapInArrow(cut, "word string, block long, number int, payload binary").repartition("word").where("word is not null")
    distinct = rows.groupBy("word").agg(F.count("payload").alias("p"), F.min("block").alias("b"), F.min("number").alias("n")).where("p = 0 and b is not null and n is not null")
    known = rows.join(cut_words(distinct.select("word"), t), "word").select("block", "number", "word", "cut", F.length("payload").alias("none"))
    known = known.mapInArrow(gather, "of string, packed binary")
    blocks = rows.where("payload is not null or monotonically_increasing_id() < 0")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        raw = pa.array([x.replace(MARK.encode(), b" ") for x in pieces.value.raw], pa.large_binary())
        answers = right.column("packed").to_pylist()
        return pa.concat_tables([EMPTY, *[put_together(x, answers, pieces.value, raw) for x in left.column("payload").to_pylist()]])

    return blocks.groupBy("word").cogroup(known.groupBy("of")).applyInArrow(finish, "doc_id long, ids array<int>, round_trip boolean")


def decode_ids(ids: list[int] | None, t: PieceTable) -> str | None:
    if ids is None:
        return None
    text = b"".join([t.raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def decode(encoded: DataFrame, t: PieceTable) -> DataFrame:
    """The columns of ``encoded`` (doc_id, ids, ...) and ``text``."""
    pieces = encoded.sparkSession.sparkContext.broadcast(t)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [decode_ids(x.as_py(), pieces.value) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")
