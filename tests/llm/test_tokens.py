"""Token counts against the libraries, alignment against brute force over byte offsets."""

import collections
import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from test_operators import SCHEMA, awkward, prose

from cairnspark.llm import alignment, token_counts, words
from cairnspark.llm.queries import QUERIES, model_bytes, model_file

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LETTERS = [*"abAB'.,19 \n\t é́ßΣς漢字 　\x1c\x85​▁😀", "<|endoftext|>", "<s>", "'s", "'ll", "  ", "\n\n"]


def mixed_texts(n, seed=3):
    """Short texts of everything that tokenizers treat apart."""
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "  ", "\n", " \n", "a ", "a  ", "\na"]


def library_counts(name, texts):
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=model_file(name)).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e) for e in Tokenizer.from_file(model_file(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    texts = mixed_texts(3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in token_counts.count_tokens(docs, name, model_bytes(name)).collect()}
    assert [out[i].n_tokens for i in range(len(texts))] == library_counts(name, texts)
    assert [out[i].n_bytes for i in range(len(texts))] == [len(t.encode()) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_parts_of_long_texts(spark, name):
    """Texts longer than a part, with and without places to cut at, among short ones."""
    rng = random.Random(1)
    texts = [prose(rng, 3), prose(rng, 900), prose(rng, 5), "x" * 3000, "é　" * 700, "a. " * 800 + " ", "  ".join(["b"] * 999), "", prose(rng, 700) + "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = token_counts.count_tokens(docs, name, model_bytes(name), part_bytes=1000).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == library_counts(name, texts)
    assert [r.n_bytes for r in out] == [len(t.encode()) for t in texts]
    assert max(map(len, words.in_parts(texts[1].encode(), 1000))) <= 1000


def test_a_text_of_many_megabytes(spark):
    one = "Some words, 12 of them: and more of it.\n"
    docs = spark.createDataFrame([(1, one)], "doc_id long, text string").selectExpr("doc_id", "repeat(text, 1000000) AS text")
    out = token_counts.count_tokens(docs, "word_bpe_49k.json", model_bytes("word_bpe_49k.json")).first()
    assert (out.n_bytes, out.n_tokens) == (len(one) * 1_000_000, library_counts("word_bpe_49k.json", [one])[0] * 1_000_000)


def test_other_tokenizers_take_whole_texts():
    spec = model_bytes("word_bpe_49k.json").replace(b'"Removed"', b'"Isolated"')
    assert token_counts.Tokenizer("t.json", spec).cut is token_counts.whole_texts


def test_counts_of_awkward_rows(spark):
    odd = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "'x' AS TEXT", "1 AS n_bytes", "2 AS N_TOKENS")
    got = token_counts.count_tokens(odd, "word_bpe_49k.json", model_bytes("word_bpe_49k.json")).collect()
    want = library_counts("word_bpe_49k.json", [r[1] or "" for r in awkward()])
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={r[0]}, n_bytes={len((r[1] or '').encode())}, n_tokens={n})" for r, n in zip(awkward(), want, strict=True))
    assert token_counts.count_tokens(odd.limit(0), "word_bpe_49k.json", model_bytes("word_bpe_49k.json")).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert token_counts.count_tokens(broken, "word_bpe_49k.json", model_bytes("word_bpe_49k.json")).count() == 1


@tables
def test_registered_counts(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(text)
    want = dict(zip(ids, library_counts("word_bpe_49k.json", [text[i] for i in ids]), strict=True))
    out = QUERIES["op11_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in out} == {i: (n, n > 2048) for i, n in want.items()}


def aligned_by_hand(rows):
    """Rows as the operator gives them, from byte offsets of whole texts."""
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(model_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=model_file("piece_bpe_32k.model"))
    letters = {}
    spare = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x:
            letters[chr(x)] = x
        else:
            letters[chr(spare)], spare = x, spare + 1
    bytes_a = {i: bytes(letters.get(c, 63) for c in t) for t, i in json.loads(model_bytes("byte_bpe_50k.json"))["model"]["vocab"].items()}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        return out

    found, counts = [], collections.Counter()
    for i, text in rows:
        x = spans(a.encode(" " + text, add_special_tokens=False).ids, bytes_a) if text else []
        y = spans(b.encode(text), bytes_b) if text else []
        if not text or any(b"".join(of[k] for *_, k in s) != (" " + text).encode() for s, of in ((x, bytes_a), (y, bytes_b))):
            found.append((i, [], [], [], []))
            continue
        links = [(p[2], q[2]) for p in x for q in y if max(p[0], q[0]) < min(p[1], q[1])]
        counts.update(links)
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups = [([k for s, e, k in x if lo <= s < hi], [k for s, e, k in y if lo <= s < hi]) for lo, hi in zip([0, *ends], ends)]
        found.append((i, x, y, groups, links))
    best = collections.Counter()
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    return [
        (i, ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g), len(x), len(y), len(g), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links))
        for i, x, y, g, links in found
    ]


FILES = alignment.Tokenizers(model_bytes("byte_bpe_50k.json"), model_bytes("piece_bpe_32k.model"))


def test_alignment_by_hand(spark):
    """Whole texts, in blocks of every size; texts with U+2581 have no tokens."""
    texts = mixed_texts(200) + [t.replace("▁", "") for t in mixed_texts(500, 4)] + ["a ▁ b", "naïve café 漢字 <|endoftext|></s>", "the the the\n\n  the", "it's 12 o'clock\r\n"] * 3
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = aligned_by_hand(rows)
    assert sum(not w[1] for w in want) > 5
    for size in (300, 1_000_000):
        assert sorted(map(tuple, alignment.align(docs, FILES, size).collect())) == want


def test_alignment_of_long_and_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in awkward()] + [(20, prose(rng, 400)), (21, prose(rng, 300) + " \n" + "y" * 900)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS TEXT", "1 AS block", "2 AS pair")
    want = sorted(map(str, aligned_by_hand(rows)))
    assert sorted(str(tuple(r)) for r in alignment.align(odd, FILES, 700).collect()) == want
    assert alignment.align(odd.limit(0), FILES).collect() == []
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert alignment.align(broken, FILES).first().n_a == 0


def test_steps_are_forgotten_at_the_bound(monkeypatch):
    monkeypatch.setattr(alignment, "STEPS", 3)
    t = alignment.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"c"])
    for _ in range(5):
        assert t.align([0, 1], [0, 1]) == ([(2, 2)], [0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1])
        assert t.align([0, 1, 3], [2]) == ([(3, 1)], [0 << 32 | 2, 1 << 32 | 2, 3 << 32 | 2])
        assert t.align([2, 3], [0]) is None and t.align([0], [3]) is None and t.align([], [0]) is None
        assert t.align([], []) == ([], [])


@tables
def test_registered_alignment(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1]) < 400][:25]
    files = alignment.align(spark.createDataFrame(short, "doc_id long, text string"), FILES)
    assert sorted(map(tuple, files.collect())) == sorted(aligned_by_hand(short))
    out = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, SF).collect()}
    assert len(out) == len(rows)
    for i, groups, n_a, n_b, n_groups, n_links, *_ in aligned_by_hand(short):
        r = out[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, n_links, hashlib.sha256(groups.encode()).hexdigest() if groups else "")
