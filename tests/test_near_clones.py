"""Renamed and gapped clones: planted ones, and brute force on small files."""

import random

import numpy as np
import pytest

from cairnspark.operators import near_clones as nc

BODY = """fn total(items: &[Item], rate: f64) -> f64 {
    let mut sum = 0.0;
    for item in items.iter() {
        if item.price > 10.0 && item.kind != Kind::Gift {
            sum += item.price * rate;
        } else {
            sum += item.price;
        }
        log(item.name, sum);
    }
    return sum / count(items);
}
"""


def noise(rng, n):
    """Code that repeats nothing for long."""
    return "".join(f"{''.join(rng.choices('+-*%=<>!&|^', k=rng.randrange(1, 6)))} {rng.randrange(99)} w{rng.randrange(10**6)}\n" for _ in range(n))


def renamed(text):
    for a, b in (("sum", "acc"), ("item", "row"), ("rate", "tax"), ("10.0", "99.5"), ("total", "grand")):
        text = text.replace(a, b)
    return text


def found(spark, files, limits=nc.Limits()):
    df = spark.createDataFrame(list(files.items()), "path string, content string").repartition(3)
    return {(r.file1, r.file2): r for r in nc.near_clones(nc.source_tokens(df), limits).collect()}


def test_types_of_planted_clones(spark):
    rng = random.Random(1)
    gapped = BODY.replace("    let mut sum = 0.0;\n", "    let mut sum = 0.0;\n    check(items);\n").replace("        log(item.name, sum);\n", "")
    make = lambda body: noise(rng, 12) + body + noise(rng, 12)
    files = {"a": make(BODY), "b": make(BODY), "c": make(renamed(BODY)), "d": make(gapped.replace("log", "note")), "e": make(""), "f": "", "g": None}
    limits = nc.Limits(max_gap=9)
    got = found(spark, files, limits)
    assert {k: r.clone_type for k, r in got.items()} == {("a", "b"): "exact", ("a", "c"): "renamed", ("a", "d"): "gapped"}
    assert {k: r.rule_id for k, r in got.items()} == {("a", "b"): "DUP001", ("a", "c"): "DUP002", ("a", "d"): "DUP003"}
    exact, other = got["a", "b"], got["a", "c"]
    assert exact.similarity == 1 and exact.renamed == exact.gap_tokens == 0
    for r in (exact, other):  # the body in both files, give or take a token that is equal by chance
        assert {r.line1, r.line2} <= {12, 13} and {r.last1, r.last2} <= {24, 25}
    assert 0.95 <= other.similarity < 1 and other.renamed > 10 and got["a", "d"].gap_tokens > 0
    assert not found(spark, {k: files[k] for k in "ae"})
    # the strict preset leaves the gapped one out
    assert {r.clone_type for r in found(spark, files, nc.Limits(4, 30, 0.95)).values()} == {"exact", "renamed"}


def test_clones_inside_a_file(spark):
    rng = random.Random(2)
    got = found(spark, {"a": noise(rng, 5) + BODY + noise(rng, 9) + renamed(BODY) + noise(rng, 5)})
    assert got["a", "a"].clone_type == "renamed" and got["a", "a"].end1 <= got["a", "a"].start2
    # a run of one line is a clone of itself only where it does not overlap
    run = found(spark, {"r": "call(x, 1);\n" * 60})["r", "r"]
    assert run.end1 <= run.start2


def longest_by_hand(x, y, k):
    """All maximal runs of k and more equal tokens."""
    out = set()
    for i in range(len(x)):
        for j in range(len(y)):
            if x[i] == y[j] and (not i or not j or x[i - 1] != y[j - 1]):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if n >= k:
                    out.add((i, j, n))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_winnowing_misses_no_long_run(seed):
    rng = random.Random(seed)
    limits = nc.Limits(k=4, window=3, max_gap=0)
    x = [rng.randrange(6) for _ in range(120)]
    y = x[10:40] + [rng.randrange(6) for _ in range(60)] + x[60:90]
    a, b = (dict(zip(*map(np.ndarray.tolist, nc.winnowed(np.array(v), 4, 3)), strict=True)) for v in (x, y))
    places = sorted((p, q) for p, h in a.items() for q, g in b.items() if h == g)
    got = {(i, j, n) for [(i, j, n)] in nc.clones_of(x, y, places, False, limits)}
    want = longest_by_hand(x, y, 4)
    assert got <= want and {w for w in want if w[2] >= 4 + 3 - 1} <= got


@pytest.mark.parametrize("seed", range(20))
def test_gaps_are_crossed_as_planted(seed):
    """Edits of up to max_gap tokens, anchored on both sides, in a copy of random tokens."""
    rng = random.Random(seed)
    x = [rng.randrange(10**6) for _ in range(300)]
    y, at, gap = [], 0, 0
    for _ in range(5):
        n = rng.randrange(25, 50)
        y += x[at : at + n]
        at += n
        cut, new = rng.randrange(4), rng.randrange(4)
        y += [rng.randrange(10**6, 2 * 10**6) for _ in range(new)]
        at, gap = at + cut, gap + max(cut, new)
    y += x[at:]
    limits = nc.Limits(k=12, window=8)
    a, b = (nc.winnowed(np.array(v), 12, 8) for v in (x, y))
    places = sorted((p, q) for p, h in zip(*map(np.ndarray.tolist, a), strict=True) for q, g in zip(*map(np.ndarray.tolist, b), strict=True) if h == g)
    [blocks] = nc.clones_of(x, y, places, False, limits)
    tokens = {"raw": None, "lines": None}
    similarity, f = nc.described(blocks, tokens | {"raw": x, "lines": x}, tokens | {"raw": y, "lines": y})
    assert (f[0], f[2], f[1], f[3]) == (0, 0, len(x), len(y)) and f[10] == gap and f[11] == 0
    assert similarity == 1 if not gap else similarity < 0.95


def test_words_of_prose(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    text = " ".join(rng.choices(words, k=120))
    other = text.split()
    other[50:52] = ["something", "quite", "different"]
    rows = [(1, text), (2, text.upper()), (3, " ".join(other)), (4, None), (5, "short")]
    out = nc.near_clones(nc.word_tokens(spark.createDataFrame(rows, "doc_id long, text string")), nc.Limits(min_lines=1)).collect()
    assert {(r.file1, r.file2, r.clone_type) for r in out} == {(1, 2, "renamed"), (1, 3, "gapped")}


def test_files_that_are_looked_at(spark):
    paths = ["a/src/x.rs", "a/target/debug/x.rs", "b/node_modules/m/i.js", "c.go", "d/vendor/v.py", "e/vendored.py", "targets/x.ts", "n/.git/y.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = lambda **kw: [r.path for r in nc.analysed(df, **kw).collect()]
    assert kept() == ["a/src/x.rs", "e/vendored.py", "targets/x.ts"]
    # a segment may be anything, but is one; a pattern that is none excludes nothing
    assert kept(exclude=("a/*/x", "[")) == ["a/target/debug/x.rs", "b/node_modules/m/i.js", "d/vendor/v.py", "e/vendored.py", "targets/x.ts", "n/.git/y.py"]
    assert kept(languages=("go",)) == ["c.go"]
