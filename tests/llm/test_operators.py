"""Each operator against brute force on small tables, and its edge cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import common, graph, hamming, langid, linededup, lm, mixing, neardup, passages, pieces, quality, url_filter
from cairnspark.llm.queries import model_file

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ter", "zu", "and") for b in ("ra", "ne", "po", "") for c in ("s", "n", "tion", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward():
    """Null, empty, short, long and repeated texts, null columns, ties."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(60))
    return [
        (1, None, "en", "s1"), (2, "", "en", None), (3, " \n\t ", None, "s1"), (4, "one", "en", "s2"), (5, "\n\n", "en", "s2"), (6, long, "de", "s1"),
        (7, long, "de", "s1"), (7, long, "de", "s1"), (None, long, None, None), (8, "ÄÖ 😀 ﬁ \x1c x\x85y", "de", "s3"), (9, "x" * 5000, "en", "s3"), (10, "12 34 !!", "en", "s3"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(spark):
    """Extra columns with the names that operators use, in other cases too."""
    return spark.createDataFrame(awkward(), SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("TEXT", "size", "kept", "u", "n", "node", "lines", "token", "bucket", "score", "position")])


ROWS = {
    "quality": quality.judge_quality,
    "langid": langid.identify,
    "lm": lm.score,
    "linededup": lambda d: linededup.strip_repeats(d).select("doc_id", "n_removed_lines", "n_removed_chunks"),
    "mixing": mixing.mix,
    "neardup": neardup.near_duplicates,
    "pieces": lambda d: pieces.encode(d, TABLE),
}
TABLE = pieces.load_pieces(model_file())


@pytest.mark.parametrize("name", ROWS)
def test_awkward_rows_come_back_once(odd, name):
    assert sorted(str(r.doc_id) for r in ROWS[name](odd).collect()) == sorted(str(r[0]) for r in awkward())


@pytest.mark.parametrize("name", ROWS)
def test_empty_table(none, name):
    assert ROWS[name](none).collect() == []


@pytest.mark.parametrize("name", ROWS)
def test_clashing_columns(odd, clash, name):
    key = lambda r: str(tuple(r))
    assert sorted(map(key, ROWS[name](clash).collect())) == sorted(map(key, ROWS[name](odd).collect()))


def test_all_rows_null(spark):
    d = spark.createDataFrame([(None, None, None, None)] * 2, SCHEMA)
    for f in ROWS.values():
        assert f(d).count() == 2


# ---- 1


def tree_by_hand(urls, min_labels=5, z2=3.84, prior=5.0, reject=0.5):
    """Rejected (host, shape), from the docstring."""
    rows = [(h, re.sub("[0-9]+", "#", re.sub("^/|/$", "", p)).split("/"), b) for h, p, b in urls]
    temp, live, level = {i: () for i in range(len(rows))}, set(range(len(rows))), 0

    def differs(n, b, all_n, all_b):
        if not (all_n > n and 0 < all_b < all_n):
            return False
        gap, rate = b / n - (all_b - b) / (all_n - n), all_b / all_n
        return gap * gap >= z2 * rate * (1 - rate) * (1 / n + 1 / (all_n - n))

    while live:
        live = {i for i in live if len(rows[i][1]) > level}
        nodes = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
        for i in live:
            h, s, b = rows[i]
            kid = nodes[h, temp[i]][s[level]]
            if b is not None:
                kid[0] += 1
                kid[1] += b
        name = {}
        for node, kids in nodes.items():
            pl, pb = sum(v[0] for v in kids.values()), sum(v[1] for v in kids.values())
            if not (0 < pb < pl and pl > min_labels):
                name[node] = None
                continue
            own = {s: v for s, v in kids.items() if v[0] >= min_labels and differs(*v, pl, pb)}
            name[node] = {}
            for side in (True, False):
                like = {s: v for s, v in own.items() if (v[1] * pl > pb * v[0]) == side}
                gl, gb = sum(v[0] for v in like.values()), sum(v[1] for v in like.values())
                for s, v in like.items():
                    name[node][s] = ("is", s) if len(like) == 1 or differs(*v, gl, gb) else ("like", min(like))
        for i in list(live):
            h, s, _ = rows[i]
            names = name[h, temp[i]]
            temp[i] += ("rest",) if names is None else (names.get(s[level], "any"),)
            if names is None:
                live.discard(i)
        level += 1
    known = [b for _, _, b in urls if b is not None]
    if not known:
        return set()
    host, leaf = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for i, (h, _, b) in enumerate(rows):
        if b is not None:
            for d, k in ((host, h), (leaf, (h, temp[i]))):
                d[k][0] += 1
                d[k][1] += b
    out = set()
    for i, (h, s, _) in enumerate(rows):
        n, b = leaf[h, temp[i]]
        base = (host[h][1] + prior * sum(known) / len(known)) / (host[h][0] + prior)
        if n >= min_labels and (b + prior * base) / (n + prior) >= reject:
            out.add((h, "/".join(s)))
    return out


def test_url_tree_without_a_depth(spark):
    """Bad branches below six mixed levels; two alike ones merge, a third differs; clashing columns do no harm."""
    rng = random.Random(4)
    rate = {"casino": 0.97, "pills": 0.96, "odd": 0.6, "news": 0.03, "blog": 0.04}
    urls = [(i, "h.test", f"/a{i}/{rng.choice('xy')}/{rng.randrange(9)}/b/{rng.choice(WORDS)}/c/{k}/{rng.choice(WORDS)}.html", int(rng.random() < rate[k])) for i, k in enumerate(rng.choices(sorted(rate), k=1500))]
    pages = spark.createDataFrame([(i, f"http://{h}{p}", "x", "y") for i, h, p, _ in urls], "page_id long, URL string, template string, host string")
    labels = spark.createDataFrame([(i, b) for i, _, _, b in urls if i % 3], "page_id long, bad int")
    out = url_filter.judge_urls(pages, labels, rules=()).collect()
    got = {(r.host, re.sub("[0-9]+", "#", r.path).strip("/")) for r in out if r.verdict == "block"}
    want = tree_by_hand([(h, p, b if i % 3 else None) for i, h, p, b in urls])
    assert got == want
    bad = [r for r in out if "/casino/" in r.path or "/pills/" in r.path]
    [(template, n)] = collections.Counter(r.template for r in bad).most_common(1)
    assert all(r.verdict == "block" for r in bad) and n > len(bad) / 2 and template == "/*/*/*/*/*/*/(casino..)/*"
    clean = [r.verdict == "block" for r in out if "/news/" in r.path or "/blog/" in r.path]
    assert sum(clean) <= 0.05 * len(clean)


def test_url_tree(spark):
    rng = random.Random(1)
    urls = []
    for i in range(900):
        host = rng.choice(["a.test", "a.test", "b.test"])
        part = rng.choice(["ads", "news", "user"])
        bad = int(rng.random() < {"ads": 0.95, "news": 0.05, "user": 0.1}[part]) if rng.random() < 0.7 else None
        urls.append((i, host, f"/{part}/{rng.randrange(99)}/{rng.choice('xyz')}", bad))
    pages = spark.createDataFrame([(i, f"http://{h}{p}?q=1") for i, h, p, _ in urls], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, _, b in urls if b is not None], "page_id long, bad int")
    got = {(r.host, re.sub("[0-9]+", "#", r.path).strip("/")) for r in url_filter.judge_urls(pages, labels, rules=()).collect() if r.verdict == "block"}
    want = tree_by_hand([(h, p, b) for _, h, p, b in urls])
    assert got == want and want and all(s.startswith("ads") for _, s in want)


@pytest.mark.parametrize("name", ["*", "**", "(a..)", "\\\\", "zz"])
def test_url_names_like_wildcards(spark, name):
    """A branch whose name looks like a wildcard is a branch of its own."""
    urls = [(i, f"/{name}/a", 1) for i in range(100)] + [(100 + i, f"/{rng}/{c}", 0) for i, (rng, c) in enumerate(itertools.product("abcdefghij", "abcdefghijklmnopqrstuvwxyzABCD"))]
    pages = spark.createDataFrame([(i, f"http://h.test{p}") for i, p, _ in urls], "page_id long, url string")
    out = url_filter.judge_urls(pages, spark.createDataFrame([(i, b) for i, _, b in urls], "page_id long, bad int"), rules=()).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == set(range(100))
    want = tree_by_hand([("h.test", p, b) for _, p, b in urls])
    assert want == {("h.test", f"{name}/a")}


def test_urls_with_many_shared_segments(spark, monkeypatch):
    """60 shared segments take the rounds of none: two tables a round and one before."""
    tables, write = [], url_filter.materialize
    monkeypatch.setattr(url_filter, "materialize", lambda df: tables.append(1) or write(df))
    deep = "/x" * 60
    urls = [(i, f"{deep}/{'ads' if i % 2 else 'news'}{deep}/{i}", i % 2) for i in range(200)] + [(300, deep, 0), (301, None, None)]
    pages = spark.createDataFrame([(i, p and f"http://h.test{p}") for i, p, _ in urls], "page_id long, url string")
    out = url_filter.judge_urls(pages, spark.createDataFrame([(i, b) for i, _, b in urls if b is not None], "page_id long, bad int"), rules=()).collect()
    assert len(tables) <= 1 + 2 * 3
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i in range(200) if i % 2}
    assert {r.template for r in out if r.template} == {"/*" * 60 + "/ads/**"}


def test_a_very_long_url(spark):
    pages = spark.createDataFrame([(1, "http://h.test/")], "page_id long, url string").selectExpr("page_id", "concat(url, repeat('a/b1', 2500000)) AS url")
    out = url_filter.judge_urls(pages, spark.createDataFrame([(1, 1)], "page_id long, bad int")).first()
    assert len(out.path) == 10_000_001 and out.verdict == "allow"


def test_url_rules_and_odd_urls(spark):
    cases = {
        "http://x.net/": ("x.net", "/", "net/", "block"), "HTTP://EXAMPLE.NET/en/1": ("example.net", "/en/1", "example.net/en/", "allow"),
        "ftp://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"), "http://badexample.com/de/x": ("badexample.com", "/de/x", None, "allow"),
        "http://b.org/fr/x?y#z": ("b.org", "/fr/x", "org/fr/", "allow"), "http://b.net?x=/": ("b.net", "", None, "allow"), "no url": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


# ---- 2


@pytest.mark.parametrize("text", [None, "", "a b c a b c", "a a a a a", "x\ny\nx\n\n\nz\nx", "#a |b\tc<d>\x0bü", "a b c d " * 5])
def test_quality_counts(text):
    words = WORD.findall(text or "")
    tri = list(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    assert quality.text_counts(pa.array(["x y", text])).pop() == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), dup, len(hit))


def test_quality_fences(spark):
    """Clean documents stay, one far outside its group goes; small groups lean on their language."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 80), "en", "big") for i in range(300)] + [(500 + i, prose(rng, 80), "en", f"small{i}") for i in range(5)]
    rows += [(900, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "big"), (901, " ".join(w + "$$$" for w in prose(rng, 80).split()), "en", "small0"), (902, prose(rng, 20), "en", "big")]
    got = {r.doc_id: r.kept for r in quality.judge_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, kept in got.items() if not kept} == {900, 901, 902}


def test_fences_follow_the_spread(spark):
    """Two sources of one language: what is usual in the wide one is rejected in the narrow one, and a
    group's own quantiles gain on its language's as it grows."""
    rng = random.Random(3)
    def text(share):  # with a symbol at that share of its words
        return " ".join(w + "#" * (rng.random() < share) for w in prose(rng, 100).split())
    rows = [(i, text(rng.random() * 0.2), "en", "wide") for i in range(400)] + [(1000 + i, text(0.002), "en", "narrow") for i in range(400)]
    rows += [(5000, text(0.25), "en", "wide"), (5001, text(0.25), "en", "narrow")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept for r in quality.judge_quality(df).collect()}
    assert got[5000] and not got[5001]
    sk = quality.sketches(quality.rates(quality.document_counts(df)))
    high = {r.source: r.symbol_share_high for r in quality.thresholds(sk).collect()}
    free = {r.source: r.symbol_share_high for r in quality.thresholds(sk, prior=0).collect()}
    assert free["narrow"] < high["narrow"] < high["wide"] and free["narrow"] < free["wide"]


def planted(rng):
    """Documents as usual, and for each metric some that only it can reject."""
    plain = [(i, "\n".join(prose(rng, 9) for _ in range(rng.randrange(7, 30))), "en", f"s{i % 3}") for i in range(900)]
    # a few of the usual ones have a symbol, a line twice, a sentence twice
    usual = [(i, t + (" 5 % of it" if i % 9 == 0 else "") + ("\n" + t.split("\n")[0] if i % 8 == 0 and t.count("\n") > 20 else ""), *r) for i, t, *r in plain]
    bad = {
        "symbol_share": lambda: " ".join(w + ("#" if rng.random() < 0.2 else "") for w in prose(rng, 120).split()),
        # no three words of it come twice
        "dup_line_share": lambda: "\n".join(x for k in range(40) for x in ("ka", "zu", f"po{k} ne{k} {prose(rng, 1)}{k}")),
        "repeat_share": lambda: " ".join([(again := prose(rng, 25)), prose(rng, 60), again]),
        "word_length": lambda: " ".join(w + w + w for w in prose(rng, 120).split()),
    }
    return usual, [(10_000 + 100 * k + i, make(), "en", f"s{i}") for k, make in enumerate(bad.values()) for i in range(3)]


def test_every_fence_acts(spark):
    """Each metric's fence lies inside its range and rejects what was planted beyond it, and nothing else."""
    usual, bad = planted(random.Random(9))
    d = quality.rates(quality.document_counts(spark.createDataFrame(usual + bad, SCHEMA)))
    fences = quality.thresholds(quality.sketches(d))
    for r in fences.collect():
        assert all(0 < r[f"{m}_high"] < quality.UNIT for m in quality.SHARES) and 0 < r.word_length_low < r.word_length_high < 12 * quality.UNIT
    out = d.join(fences, ["lang", "source"])
    for k, (m, outside) in enumerate(quality.OUTSIDE.items()):
        got = {r.doc_id for r in out.where(outside).where("n_words >= 50").select("doc_id").collect()}
        mine = {i for i, *_ in bad if (i - 10_000) // 100 == k}
        assert mine <= got and not any(i < 10_000 for i in got), m


def test_no_fence_lies_beyond_its_range(spark):
    """On the driver's documents too, and no least distance decides."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in quality.thresholds(quality.sketches(quality.rates(quality.document_counts(docs)))).collect():
        assert all(0 < r[f"{m}_high"] < quality.UNIT for m in quality.SHARES)
        assert 2 * quality.UNIT < r.word_length_low and r.word_length_high < 9 * quality.UNIT


def test_counts_of_a_very_long_text():
    one = "some words in a line, twice\n"
    n, chars, _, lines, dup, rep = quality.text_counts(pa.array([one * 1_000_000]))[0]
    assert (n, chars, lines, dup, rep) == (6_000_000, 22_000_000, 1_000_000, 999_999, 6_000_000)


def test_sketches_merge_and_bound_their_error(spark):
    v = list(range(0, 5000, 7)) + [0, 1, 127, 128, 129, 10**9]
    rows = spark.createDataFrame([(x,) for x in v], "v long").select("v", quality.sketch_bucket(F.col("v")).alias("b")).collect()
    assert all(r.b <= r.v and r.v - r.b <= r.v / 64 for r in rows) and all(r.b == r.v for r in rows if r.v < 128)


# ---- 3


@pytest.mark.parametrize("k,segments,shard", [(1, 4, 50), (5, 4, 17), (7, 3, 1000), (300, 4, 64)])
def test_hamming_is_exact(spark, k, segments, shard):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    codes = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for b in rng.choices(base, k=160)] + [base[0]] * 60
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)) + [(0, signed[0]), (None, 1), (999, None)], "vec_id long, code long")
    got = collections.defaultdict(list)
    for r in hamming.topk_hamming(df, df.where("vec_id % 20 = 0"), k, segments, shard_rows=shard, query_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.vec_id))
    for q in range(0, 220, 20):
        assert got[q] == sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:k]
    assert hamming.topk_hamming(df.limit(0), df.limit(0)).count() == 0


def test_clashing_columns_of_pairs_and_passages(spark):
    """Extra columns with the operators' own names, and names in another case, change nothing."""
    rng = random.Random(24)
    codes = spark.createDataFrame([(i, rng.getrandbits(62)) for i in range(60)], "vec_id long, code long")
    odd = codes.select(F.col("vec_id").alias("VEC_ID"), F.col("code").alias("Code"), *[F.lit("x").alias(c) for c in ("shard", "block", "distance", "rank")])
    key = lambda rows: sorted(map(str, rows))
    assert key(hamming.topk_hamming(codes, codes, 3).collect()) == key(hamming.topk_hamming(odd, odd, 3).collect())
    both = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(i, prose(rng, 30) + " " + both) for i in range(3)], "doc_id long, text string")
    odd = docs.select(F.col("doc_id").alias("Doc_Id"), F.col("text").alias("TEXT"), *[F.lit("x").alias(c) for c in ("class", "home", "first", "words", "node", "k0", "parts")])
    want = key(passages.repeated_passages(docs).collect())
    assert want and want == key(passages.repeated_passages(odd).collect())


def test_hamming_stops_early():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 63, 4000, np.uint64)
    index = hamming.SegmentIndex(np.arange(4000), codes)
    ids, dist = index.search(int(codes[7]), 1)
    assert (ids[0], dist[0]) == (7, 0)


# ---- 4


def test_bundles_equal_the_definition():
    texts = ["Ab, c!", "", "zz\n zz", "Ä1b", "..."]
    for i, t in enumerate(texts):
        seq = [0] + [ord(c) if c.isalpha() else 0 for c in t.lower()] + [0]
        seq = [c for k, c in enumerate(seq) if k == 0 or c or seq[k - 1]]
        want = np.zeros(langid.DIM)
        for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
            la, lb, lc = (langid.letter_vector(x).astype(int) for x in (a, b, c))
            want += np.roll(la, 2) * np.roll(lb, 1) * lc
        got = langid.bundles(texts, np.arange(len(texts)), len(texts))[i]
        assert np.array_equal(got, want if any(seq) else 0 * want)


def test_long_texts_and_large_alphabets_are_cut(monkeypatch):
    """Windows and slices change no bundle."""
    rng = random.Random(22)
    texts = ["".join(chr(rng.choice([32, 46, rng.randrange(97, 123), rng.randrange(0x4E00, 0x5200)])) for _ in range(n)) for n in (0, 3, 400, 2500, 900)] + ["ab", " ", "é" * 1200]
    want = langid.bundles(texts, np.arange(len(texts)), len(texts))
    monkeypatch.setattr(langid, "CELLS", 10)
    assert np.array_equal(langid.bundles(texts, np.arange(len(texts)), len(texts)), want)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 700)
    assert np.array_equal(langid.bundles(texts, np.arange(len(texts)), len(texts)), want)


def test_language_held_out_accuracy(spark):
    rng = random.Random(4)
    say = {"aa": ["kalo", "lami", "mika", "olak"], "bb": ["tzur", "zrut", "rutz", "utrz"], "cc": ["ééna", "naéé", "énan", "anée"]}
    rows = [(i, " ".join(rng.choices(say[x], k=30)), x, "s") for i, x in enumerate(rng.choices(sorted(say), k=240))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows + [(1000, "123", "aa", "s")], SCHEMA)).collect()}
    assert got[1000].lang_pred == "und" and got[1000].score == 0
    for i, _, x, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].lang_pred == x and 0 < got[i].score <= 1


def test_held_out_languages_change_nothing(spark):
    rows = [(i, "kalo lami mika" if i % 2 else "tzur zrut rutz", "aa" if i % 2 else "bb", "s") for i in range(60)]
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x, "other") for i, t, x, _ in rows]
    f = lambda r: sorted((x.doc_id, x.lang_pred, x.score) for x in langid.identify(spark.createDataFrame(r, SCHEMA)).collect())
    assert f(rows) == f(lied)


# ---- 5


def model_by_hand(train, texts):
    """The mixture of contexts with dictionaries, from the docstring: log10 probability of each text's tokens."""
    tokens = lambda t: [w + b" " for w in (t or "").encode().lower().split()] + [b"\n"]
    count = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)

    def contexts(word, i):
        h = [255, 255, *word[:i]]
        deep = [("deep", d, word[i - d : i]) for d in lm.DEEP if i >= d]
        return (), (h[-1],), (h[-1], h[-2]), *deep, ("whole", word[:i])

    def bits(word):
        for i, byte in enumerate(word):
            node = 1
            for k in range(7, -1, -1):
                yield contexts(word, i), node, byte >> k & 1
                node = 2 * node + (byte >> k & 1)

    for t in train:
        for w in tokens(t):
            for cs, node, bit in bits(w):
                for c in cs:
                    count[c, node][bit] += 1
                kids[(), node].add(cs[1])
                kids[cs[1], node].add(cs[2])
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def pw(c, node):
        if (c, node) not in memo:
            own, below = pe(*count.get((c, node), (0, 0))), sum(pw(x, node)[0] for x in kids.get((c, node), ()))
            memo[c, node] = (own, 1.0) if len(c) == 2 else (np.logaddexp(own, below) - math.log(2), 1 / (1 + math.exp(min(700, below - own))))
        return memo[c, node]

    def short(cs, node, bit, d=0):
        n = count.get((cs[d], node), (0, 0))
        est = (n[bit] + 0.5) / (sum(n) + 1)
        if d == 2 or not sum(count.get((cs[d + 1], node), (0, 0))):
            return est
        w = pw(cs[d], node)[1]
        return w * est + (1 - w) * short(cs, node, bit, d + 1)

    def p(cs, node, bit):
        q = short(cs, node, bit)
        for c in cs[3:]:
            n = count.get((c, node), (0, 0))
            # of the depths in between a context counts from its second occurrence on
            if not sum(n) or c[0] == "deep" and sum(count[c, 1]) < lm.REPEATS:
                continue
            a, b = pe(*n), n[bit] * math.log(q) + n[1 - bit] * math.log(1 - q)
            w = 1 / (1 + math.exp(min(700, a - b)))
            q = w * q + (1 - w) * (n[bit] + 0.5) / (sum(n) + 1)
        return q

    memo_word = {}

    def word(w):
        if w not in memo_word:
            memo_word[w] = sum(math.log10(p(cs, node, bit)) for cs, node, bit in bits(w))
        return memo_word[w]

    return [sum(map(word, tokens(t))) for t in texts]


def test_contexts_by_hand(spark, monkeypatch):
    """score() against dictionaries, with words of up to 40 bytes and several slabs."""
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randrange(20)) + rng.choice(["", "é ö", "xAbQ", " xabq\x0b\x1cx", "\n", " " + "long" * 10, " " + "long" * 9 + "er", " a\x01 a"])) for i in range(60)] + [(60, None), (61, ""), (62, "\x85 \u3000x")]
    want = model_by_hand([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], [t for _, t in rows])
    monkeypatch.setattr(lm, "SLAB", 7)
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for (i, t), x in zip(rows, want, strict=True):
        size = sum(len(w) + 1 for w in (t or "").encode().split()) + 1
        assert got[i].score == pytest.approx(x, rel=1e-5) and got[i].bits_per_byte == pytest.approx(-x * math.log2(10) / size, rel=1e-5)


def test_probabilities_sum_to_no_more_than_one():
    """All short words over a small alphabet, and the end."""
    train = ["ab a b ab", "ba ab", "a a"]
    every = [w for n in range(1, 6) for w in map("".join, itertools.product("ab", repeat=n))]
    end = model_by_hand(train, [""])[0]
    total = sum(10 ** (x - end) for x in model_by_hand(train, every)) + 10**end
    assert 0.3 < total <= 1


def test_what_is_seen_twice_scores_higher(spark):
    """Of two texts of rare words the one that the corpus holds twice costs fewer bits."""
    rng = random.Random(15)
    rare = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(30))
    texts = [rare() for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:60])]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    got = {r.doc_id: r.bits_per_byte for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice, once = [got[i] for i in range(60) if fold(i) and fold(1000 + i)], [got[i] for i in range(60, 120) if fold(i)]
    assert max(twice) < min(once)


def test_beginnings_over_slabs():
    rng = random.Random(16)
    keys = sorted({("".join(rng.choice("ab\u00e9") for _ in range(rng.randrange(1, 6)))).encode() + b" " for _ in range(150)} | {b"\n", b"x" * 50 + b" ", b"x" * 51 + b" "})
    counts = np.array([rng.randrange(4) for _ in keys])
    slabs = [slice(i, i + 11) for i in range(0, len(keys), 11)]
    rows = []
    import pyarrow as pa

    for x in slabs:
        batch = pa.RecordBatch.from_arrays([pa.array([keys[x]], pa.list_(pa.binary())), pa.array([counts[x].tolist()], pa.list_(pa.int64()))], ["keys", "counts"])
        rows += next(lm._summaries(iter([batch]))).to_pylist()
    text = ["".join(f"{b:08b}" for b in k) for k in keys]
    for x, beside in zip(slabs, lm.shared_over_slabs(rows), strict=True):
        n, begin, upto = lm.beginning_counts(keys[x], counts[x], *beside)
        for k, t in enumerate(text[x]):
            for b in range(len(t) + 1):
                assert n[begin[k] + min(b, upto[k])] == sum(int(c) for c, o in zip(counts, text, strict=True) if o[:b] == t[:b])


def test_base_scores(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(30)), "en", "s") for i in range(60)] + awkward()[:6]
    tok = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(t or "")] + ["\n"]
    c = collections.Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6)) for i, t, *_ in rows)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want


# ---- 6


def test_pieces_equal_the_library_and_round_trip(spark, odd):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file())
    rng = random.Random(8)
    texts = [t for _, t, *_ in awkward()] + ["  two  spaces\n\n tab\t", "a▁b", "don't (stop) x². 3½ <s> </s>", "".join(chr(rng.choice([97, 98, 32, 10, 233, 8364, 128512, 20013, 0x85])) for _ in range(800)), "ab" * 70 + " end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in pieces.decode(pieces.encode(df, TABLE, chunk_bytes=4000), TABLE).collect()}
    for i, t in enumerate(texts):
        assert out[i].ids == (None if t is None else sp.encode(t))
        assert out[i].text == (None if t is None else t.replace("▁", " "))


def test_a_lost_answer_changes_no_ids():
    """A block put together without any answer, with some, and with all."""
    import pyarrow as pa

    texts = [t for _, t, *_ in awkward()] + ["language, languages and 3 language", "a  b\n\n c", "x\0y z"]
    block = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    [(words, payload)] = pieces.word_blocks(iter(block.to_batches(max_chunksize=4)), TABLE, 1000, 100, 10**6)
    words = words.to_pylist()
    raw = pa.array([x.replace("▁".encode(), b" ") for x in TABLE.raw], pa.large_binary())
    at = np.array([i for i, w in enumerate(words) if 1 < len(w) <= pieces.FOLD_CHARS][::2], np.int32)
    some = pieces.pack_ids(at, pa.array([pieces.encode_word(words[i], TABLE) for i in at], pa.list_(pa.int32())))
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file())
    for answers in ([], [some], [some, some]):
        got = {r["doc_id"]: r for r in pieces.put_together(payload, answers, TABLE, raw).to_pylist()}
        assert all(got[i]["ids"] == (None if t is None else sp.encode(t)) and got[i]["round_trip"] in (None, True) for i, t in enumerate(texts))


def test_texts_are_cut_once(spark):
    """Words and blocks go through one exchange, though three branches read it."""
    d = spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id long, text string").repartition(2)
    out = pieces.encode(d, TABLE)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 2 and len(re.findall(r"MapInArrow cut\(", plan)) == 1


def test_unigram_fold_is_the_best_path(spark):
    normal = {p: (i, s) for i, (p, s) in enumerate({"▁": -3, "a": -4, "b": -4, "c": -5, "ab": -5, "bc": -5.5, "abc": -9, "▁a": -4.5, "▁ab": -8}.items())}
    t = pieces.PieceTable(normal, [p.encode() for p in normal], [0] * 256, 0, False, False)
    words = ["▁abc", "▁abcabc", "abab", "▁", "bca", "▁abcx"]
    cut = {r.word: r.cut for r in pieces.cut_words(spark.createDataFrame([(w,) for w in words], "word string"), t).collect()}

    def value(w, at):
        ps = [w[a:b] for a, b in itertools.pairwise([*at, len(w)])]
        return sum(normal[p][1] if p in normal else -19 for p in ps) if all(p in normal or len(p) == 1 for p in ps) else -math.inf

    for w in words:
        best = max(value(w, (0, *c)) for r in range(len(w)) for c in itertools.combinations(range(1, len(w)), r))
        assert value(w, [i for i in range(len(w)) if cut[w] >> i & 1]) == pytest.approx(best)


# ---- 7


def lines_by_hand(rows, window=2, reach=8):
    import hashlib

    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) >> 1
    docs, chunks, seen, out = {}, {}, {}, {}
    for i, t in rows:
        docs.setdefault((i if i is not None else 1 << 62, t), i)
    for key in docs:
        if key[1] is None:
            continue
        ls = key[1].split("\n")
        hs, first, chunks[key] = [h(x) for x in ls], 0, []
        g = [sum(hs[k - j] * pow(linededup.BASE, j, linededup.PRIME) % linededup.PRIME if j else hs[k] for j in range(window) if k - j >= 0) % linededup.PRIME for k in range(len(ls))]
        for k in range(len(ls)):
            inside = 0 < k < len(ls) - 1
            if k == len(ls) - 1 or inside and g[k - 1] > g[k] <= g[k + 1] or inside and k % 2 == 0 and g[k - 2] == g[k - 1] == g[k] == g[k + 1]:
                if k > first and WORD.search("".join(ls[first : k + 1])):
                    c = "\n".join(ls[first : k + 1])
                    chunks[key].append((first, k, c))
                    seen[c] = min(seen.get(c, ((1 << 63, ""), 0, 0)), (key, first, k))
                first = k + 1

    def equal(a, b):
        n = 0
        while n < min(reach, len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for key, own in chunks.items():
        ls, gone = key[1].split("\n"), set()
        for a, b, c in own:
            home, x, y = seen[c]
            if (home, x) != (key, a):
                there = home[1].split("\n")
                gone |= set(range(a - equal(ls[:a][::-1], there[:x][::-1]), b + 1 + equal(ls[b + 1 :], there[y + 1 :])))
        out[docs[key], key[1]] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    return [(i, None if t is None else out[i, t]) for i, t in rows]


def test_line_dedup(spark):
    rng = random.Random(9)
    shared = [[prose(rng, 5) for _ in range(12)] for _ in range(3)]
    rows = [(i, "\n".join([prose(rng, 4) for _ in range(rng.randrange(5))] + rng.choice(shared) + [prose(rng, 4) for _ in range(rng.randrange(5))])) for i in range(40)]
    rows += [(41, rows[3][1]), (42, None), (43, ""), (44, "\n\n\n"), (45, "\n\n\n"), (46, rows[3][1] + "\n" + rows[3][1]), (3, rows[3][1])]
    got = linededup.strip_repeats(spark.createDataFrame([(*r, "x") for r in rows], "DOC_ID long, Text string, lines string")).collect()
    assert sorted((r.DOC_ID, r.Text) for r in got if r.Text) == sorted(x for x in lines_by_hand(rows) if x[1])
    assert sum(r.n_removed_lines for r in got) > 200 and len(got) == len(rows) and {r.lines for r in got} == {"x"}


def test_runs_of_repeated_lines(spark):
    """Most of a run of one line, or of a few in turn, goes; a copy of each line stays."""
    rng = random.Random(19)
    rows = [(1, "\n".join(["same"] * 96)), (2, "\n".join(["begin", *["a", "b"] * 40, "end"])), (3, "\n".join(["x", "y", "z"] * 30)), (4, "\n".join(prose(rng, 5) for _ in range(50)))]
    got = {r.doc_id: r for r in linededup.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted((r.doc_id, r.text) for r in got.values()) == sorted(lines_by_hand(rows))
    assert all(len(got[i].text.split("\n")) <= 12 and set(got[i].text.split("\n")) == set(t.split("\n")) for i, t in rows[:3]) and got[4].n_removed_lines == 0


def test_shared_passages_of_lines(spark):
    """Passages of six lines and more that two documents share go to their ends, nearly always."""
    rng = random.Random(23)
    rows, want = [], 0
    for k in range(60):
        passage = [prose(rng, 6) + str(k) for _ in range(6 + k % 10)]
        want += len(passage)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, "\n".join([prose(rng, 6) + f"<{i}" for _ in range(5)] + passage + [prose(rng, 6) + f">{i}" for _ in range(5)])))
    lost = sum(r.n_removed_lines for r in linededup.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert 0.95 * want <= lost <= want


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 70_000}" for i in range(200_000))
    [row] = linededup.strip_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_removed_lines >= 129_000 and set(row.text.split("\n")) == set(text.split("\n"))


# ---- 8


def test_mix_targets_and_order(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", s) for i, s in enumerate(["hot"] * 200 + ["b"] * 60 + ["c"] * 5 + [None] * 40 + ["Z"] * 30)] + [(999, None, "en", "empty")]
    d = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(d, rows_per_bucket=20).collect()
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    took = collections.Counter()
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        took[r.source] += r.taken
    assert all(abs(took[s] - target[s]) <= max(3, 0.02 * target[s]) for s in names)
    again = mixing.mix(d.repartition(3), rows_per_bucket=20).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    copies = mixing.mixed_documents(d).collect()
    assert collections.Counter(r.doc_id for r in copies) == collections.Counter({r.doc_id: r.copies for r in out if r.copies})


def test_very_long_documents_are_passed_over(spark):
    """Sources with documents larger than what is open still come near their targets."""
    rng = random.Random(20)
    rows = [(i, "w " * rng.randrange(50, 400), "en", f"s{i % 3}") for i in range(600)] + [(1000 + i, "w " * 40_000, "en", f"s{i % 3}") for i in range(9)]
    took, target = collections.Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), rows_per_bucket=50).collect():
        took[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(took[s] - t) <= 0.002 * t for s, t in target.items())


def test_repeated_rows_are_mixed_as_one(spark):
    d = spark.createDataFrame([(1, "a b c", "en", "s", "x"), (1, "a b c", "en", "s", "y"), (2, "d e", "en", "s", "z")], SCHEMA + ", note string")
    out = [sorted((r.doc_id, r.note) for r in mixing.mixed_documents(x).collect()) for x in (d, d.orderBy(F.desc("note")))]
    assert out[0] == out[1] and {i for i, _ in out[0]} == {1, 2} and len({n for i, n in out[0] if i == 1}) == 1


def test_positions_invert_the_schedule(spark):
    for w, knots in mixing.SCHEDULES.items():
        f = [i / 20 for i in range(21)]
        ts = [r.t for r in spark.createDataFrame([(x,) for x in f], "f double").select(mixing.position(F.col("f"), F.lit(w)).alias("t")).collect()]
        grid = np.linspace(0, 1, 20001)
        rate = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        assert np.allclose(ts, np.interp(f, area / area[-1], grid), atol=1e-3)


# ---- 9


def test_repeated_passages(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = [say(60) for _ in range(20)]
    rows = []
    for i in range(60):
        body = say(100).split()
        if i < 40:
            at = rng.randrange(100)
            body[at:at] = passage[i % 20].split()
        rows.append((i, " ".join(body)))
    changed = passage[0].split()
    changed[30] = "changed"
    rows.append((90, say(50) + "\n" + " ".join(changed) + " " + say(50)))
    rows += [(91, None), (92, ""), (93, "a b c d"), (None, rows[0][1]), (59, rows[59][1])]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r.doc_id].add((r.component_id, r.removed))
    assert set(found) == set(range(40)) | {90}
    assert all(found[i] == {(i % 20, i >= 20)} for i in range(40)) and found[90] == {(0, True)}
    words = {i: (t or "").split() for i, t in rows}
    for r in got:
        own = words[r.doc_id][r.first_word : r.first_word + r.n_words]
        # a similar paragraph may bring a word or two of its neighbourhood
        assert len(set(own) & set(passage[r.doc_id % 90 % 20].split())) >= 0.8 * len(own)
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_reach_their_ends(spark):
    """Short passages and long ones, in two foreign texts each, are reported from their first to their last word."""
    rng = random.Random(15)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(30):
        passage = say(51) if k else ["same"] * 90 + say(20)
        for i in (2 * k, 2 * k + 1):
            before = say(rng.randrange(20, 60))
            rows.append((i, " ".join(before + passage + say(40))))
            want[i] = (len(before), len(passage), 2 * k, i % 2 == 1)
    got = collections.defaultdict(list)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.first_word, r.n_words, r.component_id, r.removed))
    assert len(got) >= 58
    for i, spans in got.items():
        (first, n, home, removed), (at, size, *rest) = spans[0], want[i]
        # a similar paragraph may bring a word or two of its neighbourhood
        assert len(spans) == 1 and [home, removed] == rest and at - 3 <= first <= at and at + size <= first + n <= at + size + 3, (i, spans, want[i])


def test_recall_of_words(spark):
    """Of exact and edited passages (Jaccard 0.75 and above) in foreign texts, 0.9 of the words or more are reported, and few others."""
    rng = random.Random(16)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for size, edits in ((51, 0), (60, 1), (100, 2), (300, 6)):
        for _ in range(25):
            first = say(size)
            second = list(first)
            for at in rng.sample(range(5, size - 5), edits):
                match rng.randrange(3):
                    case 0:
                        second[at] = "edit"
                    case 1:
                        second.insert(at, "more")
                    case _:
                        del second[at]
            for text in (first, second):
                before = say(rng.randrange(20, 60))
                want[len(rows)] = (size, len(before), len(before) + len(text))
                rows.append((len(rows), " ".join(before + text + say(40))))
    got = collections.defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    for size in (51, 60, 100, 300):
        own = {i: set(range(a, b)) for i, (n, a, b) in want.items() if n == size}
        total = sum(map(len, own.values()))
        assert sum(len(got[i] & x) for i, x in own.items()) >= 0.9 * total and sum(len(got[i] - x) for i, x in own.items()) <= 0.05 * total


def test_classes_meet_in_one_exchange(spark):
    """Classes that share a band value, as brute force has them; the values cross the network once and no other column is sorted."""
    rng = random.Random(31)
    rows = [(i, rng.randrange(60), rng.randrange(60, 140), rng.randrange(140, 900)) for i in range(150)] + [(200, 7, 7, 2000), (201, 3000, 3000, 3000)]
    got = passages.meeting(spark.createDataFrame(rows, "class long, k0 long, k1 long, k2 long"))
    held = collections.defaultdict(set)
    for c, *keys in rows:
        for k in keys:
            held[k].add(c)
    want = sorted((k, c) for k, own in held.items() if len(own) > 1 for c in own)
    assert sorted((r.bucket, r.node) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().sparkPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
    assert sum(x.count("Join") for x in plan) == 0 and plan[1].split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_paragraphs_are_read_three_times(spark, monkeypatch):
    """For the classes that meet, for those that may repeat and for the hits: no other table that is written reads the cut paragraphs."""
    kept, real = [], passages.materialize

    def seen(df, *names):
        out = real(df, *names)
        kept.append((df, out))
        return out

    monkeypatch.setattr(passages, "materialize", seen)
    rng = random.Random(32)
    both = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(i, prose(rng, 30) + " " + both) for i in range(6)], "doc_id long, text string")
    assert passages.repeated_passages(docs).count() > 0
    cut = kept[0][1].inputFiles()[0].rsplit("/", 1)[0]
    assert sum(cut.removeprefix("file://") in str(df.inputFiles()) for df, _ in kept) == 3


def test_classes_are_told_apart_by_128_bits(spark):
    """One class with three values: two documents with one value, one document with each of the others."""
    rows = [(1, 0, 5, 10, 0, 1), (2, 0, 5, 11, 0, 1), (3, 0, 5, 10, 0, 1), (4, 0, 5, 12, 0, 1), (1, 1, 6, 7, 9, 1), (2, 1, 6, 7, 9, 1)]
    hits = spark.createDataFrame(rows, "doc_id long, at int, class long, k0 long, component long, home long")
    got = {(r.doc_id, r["class"], r.home) for r in passages.told_apart(hits).collect()}
    assert got == {(1, 5, 1), (3, 5, 1), (1, 6, 1), (2, 6, 1)}
    assert passages.told_apart(hits.where("class = 6")).count() == 2


def test_growth_over_edits():
    x = np.arange(40, dtype=np.uint64)
    gone, more, other = np.delete(x, [9, 10]), np.insert(x, 9, [99, 98]), np.where(x == 9, 99, x).astype(np.uint64)
    assert passages.advance(x, x, False, False) == (40, 40, False) and passages.advance(x, x, True, True) == (40, 40, True)
    assert passages.advance(x, gone, False, False)[:2] == (40, 38) and passages.advance(x, more, False, False)[:2] == (40, 42)
    assert passages.advance(x, other, False, False)[:2] == (40, 40) and passages.advance(x, np.where(x % 4 == 3, 99, x).astype(np.uint64), False, False)[:2] == (3, 3)
    assert passages.advance(x[:12], other, True, True) == (9, 9, True)


# ---- 10


def components_by_hand(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        match rng.randrange(3):
            case 0:
                w[k] = f"e{rng.randrange(40)}"
            case 1:
                del w[k]
            case _:
                w.insert(k, w[rng.randrange(len(w))])
    return " ".join(w)


@pytest.mark.parametrize("with_base", [True, False])
def test_near_copies(spark, with_base):
    """A large group of near copies, of which many miss 0.75 with each other; copies; chains; strangers."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = say(150)
    texts = [" ".join(base)] * with_base + [edited(rng, base, rng.randrange(1, 9)) for _ in range(220)]
    chain = say(120)
    for _ in range(12):
        chain = edited(rng, chain, 1).split()
        texts.append(" ".join(chain))
    texts += [" ".join(say(60)) for _ in range(60)] + ["A b c", "a B  c", "a b", "", " ", texts[5].upper().lower(), texts[5]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [rows[0], (5000, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    want = components_by_hand(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i != 5000} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values()) and got[5000].kept


def test_several_texts_of_one_doc_id(spark):
    """A document is linked through each of its texts, whatever the order of rows; its repeated rows are one."""
    rng = random.Random(17)
    a, b = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a, "x"])), (9, " ".join([*b, "x"])), (3, " ".join(["y", *b])), (11, "q r s t u v"), (11, "q r s t u v"), (None, "z"), (None, "z")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame([(*r, "extra") for r in order], "DOC_ID long, Text string, node string")
        got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
        assert got == {(7, 3, False), (8, 3, False), (9, 3, False), (3, 3, True), (11, 11, True), (None, None, True)}
        left = neardup.without_duplicates(df)
        assert left.columns == df.columns and sorted(str(r[0]) for r in left.collect()) == ["11", "3", "None", "None"]


def test_bands_and_words_differ_in_rows(spark):
    rows = [(1, "a b c d e f g"), (2, None), (None, "a b c d e f g")]
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (2, True), None: (None, True)}


def test_components(spark):
    rng = random.Random(13)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_min_max_estimates_without_bias():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 300, np.uint64)
        y = np.concatenate([x[:240], rng.integers(0, 1 << 63, 60, np.uint64)])
        gaps.append((neardup.min_max(x) == neardup.min_max(y)).mean() - 240 / 360)
    assert abs(np.mean(gaps)) < 0.03
