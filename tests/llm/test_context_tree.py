import collections
import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest

from cairnspark.llm import context_tree as ct
from cairnspark.llm import lm
from cairnspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORDS = [a + b + c for a, b, c in itertools.product("krt", ("a", "o", "é"), ("", "lim", "n", "nta"))]


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


def written(t):
    return b" ".join([*(t or "").encode().lower().split(), b"\n"])


def model_by_hand(train, texts):
    """The context tree with dictionaries, from the docstring: log10 probability of each text."""
    count = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)

    def bits(t):
        t = written(t)
        for i, byte in enumerate(t):
            past = tuple(t[max(0, i - ct.DEPTH) : i][::-1]) + (255,) * ct.DEPTH
            node = 1
            for k in range(7, -1, -1):
                yield past, node, byte >> k & 1
                node = 2 * node + (byte >> k & 1)

    for t in train:
        for past, node, bit in bits(t):
            for d in range(ct.DEPTH + 1):
                count[past[:d], node][bit] += 1
                if d < ct.DEPTH:
                    kids[past[:d], node].add(past[: d + 1])
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def pw(c, node):
        """log Pw, and the weight of the context's own estimate."""
        if (c, node) not in memo:
            own = pe(*count[c, node])
            both = own if len(c) == ct.DEPTH else np.logaddexp(own, sum(pw(x, node)[0] for x in kids[c, node])) - math.log(2)
            memo[c, node] = both, 1 if len(c) == ct.DEPTH else math.exp(own - math.log(2) - both)
        return memo[c, node]

    def p(past, node, bit, d=0):
        n = count.get((past[:d], node), (0, 0))
        est = (n[bit] + 0.5) / (sum(n) + 1)
        if d == ct.DEPTH or (past[: d + 1], node) not in count:
            return est
        w = pw(past[:d], node)[1]
        return w * est + (1 - w) * p(past, node, bit, d + 1)

    return [sum(math.log10(p(*x)) for x in bits(t)) for t in texts]


@pytest.mark.parametrize("part", [1 << 40, 300])
def test_contexts_by_hand(spark, monkeypatch, part):
    """score() against dictionaries, over word borders, in one part and in several."""
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(16))) + rng.choice(["", "é ö", "xAbQ", " xabq\x0b\x1cx", "\n", " " + "long" * 10, " a\x01 a"])) for i in range(50)]
    rows += [(50, None), (51, ""), (52, "\x85 　x"), (None, "ka ta ra"), (7, rows[7][1])]
    want = model_by_hand([t for i, t in rows if fold(i)], [t for _, t in rows])
    monkeypatch.setattr(ct, "PART", part)
    got = ct.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (str(r[0]), round(r[1], 4))
    assert len(got) == len(rows)
    for r, (i, x, size) in zip(sorted(got, key=lambda r: key((r.doc_id, r.score))), sorted(((i, x, len(written(t))) for (i, t), x in zip(rows, want, strict=True)), key=key), strict=True):
        assert r.doc_id == i and r.score == pytest.approx(x, rel=1e-6) and r.bits_per_byte == pytest.approx(-x * math.log2(10) / size, rel=1e-6)


def test_base_is_that_of_words(spark):
    rng = random.Random(22)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(30)))) for i in range(60)] + [(60, None), (None, "ka")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    f = lambda out: sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect())
    assert f(ct.score(docs)) == f(lm.score(docs))


def test_word_order_counts(spark):
    """A text that follows the corpus's order of words costs less than the same words shuffled."""
    rng = random.Random(23)
    follows = {w: rng.sample(WORDS, 2) for w in WORDS}

    def prose():
        out = [rng.choice(WORDS)]
        while len(out) < 60:
            out.append(rng.choice(follows[out[-1]]))
        return out

    rows = [(i, " ".join(prose())) for i in range(300)]
    held = [prose() for i in range(1000, 1040)]
    ids = [i for i in itertools.islice((i for i in itertools.count(1000) if not fold(i)), 80)]
    rows += [(i, " ".join(w)) for i, w in zip(ids[:40], held, strict=True)] + [(i, " ".join(rng.sample(w, len(w)))) for i, w in zip(ids[40:], held, strict=True)]
    got = {r.doc_id: r.score for r in ct.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] > got[b] + 5 for a, b in zip(ids[:40], ids[40:], strict=True))


def test_probabilities_sum_to_no_more_than_one():
    """All short texts over a small alphabet."""
    train = ["ab a b ab", "ba ab", "a a"]
    every = [" ".join(w) for n in range(4) for w in itertools.product(["a", "b", "ab", "ba"], repeat=n)]
    assert 0.01 < sum(10**x for x in model_by_hand(train, every)) <= 1


def test_pieces_of_a_long_text(monkeypatch):
    """Codes do not depend on where a long text is cut, nor probabilities on how many are solved at once."""
    rng = random.Random(24)
    text = b"".join(written(" ".join(rng.choices(WORDS, k=n))) for n in (300, 0, 1, 50))
    train = np.array([rng.random() < 0.7 for _ in text])
    codes, counts = ct.code_counts(text, train)
    every, at = ct.code_places(text)
    flat = text.replace(b"\n", b"\n" + b"\xff" * 7)
    by_hand = [b"\xff" * 7 + flat[:i] for i, c in enumerate(flat) if c != 255]
    by_hand = [int.from_bytes(past[-1 : -ct.DEPTH - 1 : -1] + bytes([c]), "big") for past, c in zip(by_hand, text, strict=True)]
    seen = collections.Counter(c for c, t in zip(by_hand, train, strict=True) if t)
    assert codes.tolist() == every.tolist() == sorted(set(by_hand)) and every[at].tolist() == by_hand
    assert counts.tolist() == [seen[c] for c in codes.tolist()]
    leaf, n, inner, s = ct.at_top(codes, counts)
    table = ct.short_contexts(leaf, n, inner, s)
    whole = ct.code_scores(codes, counts, *table)
    monkeypatch.setattr(ct, "PIECE", 40)
    monkeypatch.setattr(ct, "AT_ONCE", 30)
    assert [x.tolist() for x in ct.code_counts(text, train)] == [codes.tolist(), counts.tolist()]
    assert [x.tolist() for x in ct.code_places(text)] == [every.tolist(), at.tolist()]
    assert len(list(ct.slices(codes))) > 5
    assert np.allclose(ct.code_scores(codes, counts, *table), whole, rtol=1e-12)


def test_scores_are_finite_after_very_many_occurrences():
    codes = np.array([0xFFFFFFFFFFFF61, 0xFFFFFFFFFFFF62], np.uint64) if ct.DEPTH == 6 else np.array([0xFFFFFFFFFFFFFF61, 0xFFFFFFFFFFFFFF62], np.uint64)
    counts = np.array([1 << 40, 0])
    score = ct.code_scores(codes, counts, *ct.short_contexts(*ct.at_top(codes, counts)))
    assert np.isfinite(score).all() and score[1] < -8 < -1e-6 < score[0] <= 0


def test_awkward_rows_and_none(spark):
    assert ct.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    # no text to learn from: every decision has probability 1/2
    i = next(i for i in itertools.count() if not fold(i))
    (r,) = ct.score(spark.createDataFrame([(i, "x", "y")], "doc_id long, text string, TEXT string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 2, 0, 0, 0) and r.bits_per_byte == pytest.approx(8)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_codes_better_than_the_base_score(spark):
    """Training documents, and held-out ones without unknown words (which the base score takes for one)."""
    out = QUERIES["op5_lm_score"](spark, SF).collect()
    train, known = [r for r in out if not r.held_out], [r for r in out if r.held_out and r.n_known == r.n_tokens]
    assert len(known) > 10
    for rows in (train, known):
        assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
