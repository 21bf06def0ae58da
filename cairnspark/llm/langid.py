"""Language identification with hyperdimensional profiles.

A letter is a random vector of +1 and -1, drawn from its code point.  The n-gram
abc is bound as rot(rot(A)) * rot(B) * C, a document is the bundle (sum) of its
n-grams, a language's prototype the bundle of its documents.  A document gets
the language whose prototype has the largest cosine with it.

Text is lower-cased; a run of other characters than letters is one word border,
which is a symbol of its own, and text begins and ends with a border.  Counts of
distinct n-grams, not positions, are multiplied with the n-gram vectors, by slices
of ``GRAMS_AT_ONCE`` n-grams; a text of more than ``CHARS_AT_ONCE`` characters is
taken in windows whose sums are added.  So apart from the text itself and its code
points, memory follows neither text length nor alphabet.

Edge cases.  A null text or one without a letter is ``und`` with score 0.  Ties
go to the language that sorts first.  Without a single learned language all is
``und``.  A null doc_id belongs to no fold: not learned from, not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, pick, place_of

DIM, GRAM, SEED, UNKNOWN, MIN_SCORE = 1024, 3, 20250, "und", 0.05
DOCS_AT_ONCE, CHARS_AT_ONCE, GRAMS_AT_ONCE, DENSE_GRAMS, CELLS = 512, 1_000_000, 2048, 1 << 22, 1 << 22


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def letter_vector(code_point: int, dim: int = DIM) -> np.ndarray:
    """The letter's vector; 0 is the word border."""
    return (np.random.default_rng([SEED, code_point]).integers(0, 2, dim, np.int8) * 2 - 1).astype(np.int8)


def gram_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the n-grams of all texts (one row each), and for every
    occurrence its text's and its n-gram's number."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer((" ".join(["", *low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(-1, len(low) + 1), [1, *[len(t) + 1 for t in low], 0])[: len(flat)]
    letters = np.zeros(0x110000, bool)
    letters[flat] = True
    points = np.flatnonzero(letters & _is_letter())
    number = np.zeros(0x110000, np.int64)
    number[points] = np.arange(1, len(points) + 1)
    ids = number[flat]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    ids, doc = ids[keep], doc[keep]
    n = len(points) + 1
    if len(ids) < GRAM:
        return np.empty((0, GRAM), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    mid, last = doc[1:-1], doc[2:]
    own = ((ids[1:-1] != 0) & ((mid == last) | (ids[2:] == 0))) | ((ids[1:-1] == 0) & (mid == last))
    key, mid = key[own], mid[own]
    if n**3 <= DENSE_GRAMS:
        there = np.zeros(n**3, bool)
        there[key] = True
        grams = np.flatnonzero(there)
        at = np.empty(n**3, np.int64)
        at[grams] = np.arange(len(grams))
        at = at[key]
    else:
        grams, at = np.unique(key, return_inverse=True)
    symbols = np.append(0, points)
    return symbols[np.stack([grams // (n * n), grams // n % n, grams % n], 1)], mid, at


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of n-grams given by their code points."""
    points, at = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(p), dim) for p in points])
    at = at.reshape(grams.shape)
    return np.roll(table, 2, 1)[at[:, 0]] * np.roll(table, 1, 1)[at[:, 1]] * table[at[:, 2]]


def bundles(texts: list[str], groups: np.ndarray, n_groups: int, dim: int = DIM) -> np.ndarray:
    """Sum of the n-gram vectors of each group of texts (group -1: none)."""
    out = np.zeros((n_groups, dim), np.float64 if n_groups < 64 else np.float32)
    for k in [k for k, t in enumerate(texts) if len(t) > CHARS_AT_ONCE and groups[k] >= 0]:
        out[groups[k]] += long_bundle(texts[k], dim)
    if any(len(t) > CHARS_AT_ONCE for t in texts):
        texts = [t if len(t) <= CHARS_AT_ONCE else "" for t in texts]
    grams, doc, at = gram_table(texts)
    own = groups[doc]
    doc, at = own[own >= 0], at[own >= 0]
    if n_groups * len(grams) <= CELLS:
        count = np.bincount(doc * len(grams) + at, minlength=n_groups * len(grams)).reshape(n_groups, -1) if len(grams) else None
        part = lambda i, n: count[:, i : i + n]
    else:
        by = np.argsort(at, kind="stable")
        doc, at = doc[by], at[by]

        def part(i: int, n: int) -> np.ndarray:
            lo, hi = np.searchsorted(at, (i, i + n))
            return np.bincount(doc[lo:hi] * n + at[lo:hi] - i, minlength=n_groups * n).reshape(n_groups, n)

    for i in range(0, len(grams), GRAMS_AT_ONCE):
        some = grams[i : i + GRAMS_AT_ONCE]
        out += part(i, len(some)).astype(out.dtype) @ gram_vectors(some, dim).astype(out.dtype)
    return out


def long_bundle(text: str, dim: int = DIM) -> np.ndarray:
    """The bundle of one long text, by windows over its symbols."""
    flat = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.concatenate([[0], np.where(_is_letter()[flat], flat, 0), [0]]).astype(np.int64)
    flat = flat[np.append(True, (flat[1:] != 0) | (flat[:-1] != 0))]
    out = np.zeros(dim)
    for i in range(0, len(flat) - GRAM + 1, CHARS_AT_ONCE):
        x = flat[i : i + CHARS_AT_ONCE + GRAM - 1]
        key, n = np.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:], return_counts=True)
        grams = np.stack([key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF], 1)
        for k in range(0, len(grams), GRAMS_AT_ONCE):
            out += n[k : k + GRAMS_AT_ONCE] @ gram_vectors(grams[k : k + GRAMS_AT_ONCE], dim).astype(np.float64)
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i - start + 1 >= DOCS_AT_ONCE or size >= CHARS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes of (text, lang).

    Each task sends one vector a language; they are added by component.  What
    reaches the driver is languages * dim numbers.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _pieces(texts):
                names = sorted({x for x in langs[i:j] if x is not None})
                group = np.array([-1 if x is None else names.index(x) for x in langs[i:j]], np.int64)
                for name, v in zip(names, bundles([t or "" for t in texts[i:j]], group, len(names), dim), strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = pick(docs, text="string", lang="string").where("text is not null and lang is not null").mapInArrow(add, "lang string, v array<double>")
    rows = (
        parts.select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .toArrow()
        .to_pandas()
    )
    return {str(k): g.sort_values("i").x.to_numpy() for k, g in rows.groupby("lang", sort=True) if np.any(g.x)}


def classify(texts: list[str | None], names: list[str], unit: np.ndarray, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Language and cosine of each text; ``unit`` holds the prototypes at length 1."""
    pred, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for i, j in _pieces(texts):
        v = bundles([t or "" for t in texts[i:j]], np.arange(j - i), j - i, dim)
        size = np.linalg.norm(v, axis=1)
        cos = v @ unit.T / np.maximum(size, 1e-30)[:, None]
        for k in np.flatnonzero(size > 0) if names else ():
            pred[i + k], best[i + k] = names[cos[k].argmax()], min(1.0, max(0.0, cos[k].max()))
    return pred, best


def _unit(prototypes: dict[str, np.ndarray], dim: int) -> tuple[list[str], np.ndarray]:
    names = sorted(prototypes)
    return names, np.stack([prototypes[x] / np.linalg.norm(prototypes[x]) for x in names]) if names else np.zeros((0, dim))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """doc_id, lang_pred, score: the best cosine, negative ones as 0."""
    names, unit = _unit(prototypes, dim)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, best = classify(b.column("text").to_pylist(), names, unit, dim)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return pick(docs, doc_id="long", text="string").mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, 4) == 2, F.lit(False))


def train_fold(docs: DataFrame) -> DataFrame:
    """Documents that prototypes may be learned from."""
    return pick(docs, doc_id="long", text="string", lang="string").where(crc_mod(F.col("doc_id"), 4) != 2)


def identify(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on one fold, predicted for all."""
    return predict(docs, learn(train_fold(docs), dim), dim).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float = MIN_SCORE, dim: int = DIM) -> DataFrame:
    """The rows of ``docs`` whose language is known with ``min_score`` or more, all columns kept."""
    names, unit = _unit(prototypes, dim)
    at = place_of(docs.columns, "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, best = classify(b.column(at).cast(pa.string()).to_pylist(), names, unit, dim)
            yield b.filter(pa.array([p != UNKNOWN and s >= min_score for p, s in zip(pred, best, strict=True)], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
