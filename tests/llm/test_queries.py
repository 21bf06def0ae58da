"""The registered queries on the driver's tables, and the pipeline stage by stage."""

import collections
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from oracle_compare import compare
from test_operators import awkward, components_by_hand, lines_by_hand, prose

import corpus_pipeline
from cairnspark.llm import mixing, pieces
from cairnspark.llm.oracle import ORACLES
from cairnspark.llm.queries import QUERIES, model_file

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLES[name])


@tables
def test_language_id_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in QUERIES["op4_language_id"](spark, SF).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(lang[r.doc_id] == r.lang_pred for r in out) >= 0.95 * len(out) > 0


@tables
def test_contexts_beat_guessing(spark):
    out = [r for r in QUERIES["op5_lm_score"](spark, SF).collect() if r.held_out]
    assert 1 < sum(r.bits_per_byte for r in out) / len(out) < 4


@tables
def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op6_sentencepiece"](spark, SF).collect()
    assert len(out) == len(text) and all(r.round_trip and r.ids == sp.encode(text[r.doc_id]) for r in out)


@tables
def test_passages_are_repeated(spark):
    text = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op9_substring_dedup"](spark, SF).collect()
    assert out and all(0 <= r.first_word and r.first_word + r.n_words <= len(text[r.doc_id]) and r.removed == (r.doc_id != r.component_id) for r in out)


@tables
def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_pieces"] and out.count() > 0


def documents(spark):
    import random

    rng = random.Random(21)
    shared = "\n".join(prose(rng, 6) for _ in range(8))
    rows = [(i, prose(rng, 30) + "\n" + prose(rng, 20) + ("\n" + shared + "\n" + prose(rng, 5) if i % 3 == 0 else ""), "en" if i % 2 else "de", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "s9") for i in range(12)] + [(i if i is None else i + 200, t, x, s) for i, t, x, s in awkward()]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_by_hand(spark):
    """Each stage against brute force on what its predecessor kept."""
    d = documents(spark)
    key = lambda rows: sorted(map(repr, rows))
    stage = dict(corpus_pipeline.STAGES)

    before = d.collect()
    after = corpus_pipeline.materialize(stage["language_id"](spark, d, ""))
    assert after.columns == d.columns
    letters = [r for r in before if r.text and any(c.isalpha() for c in r.text)]
    # one letter 5000 times and a text of symbols are like no language
    assert set(key(after.collect())) <= set(key(letters)) and {r.doc_id for r in letters} - {r.doc_id for r in after.collect()} <= {204, 208, 209}

    lines = corpus_pipeline.materialize(stage["line_dedup"](spark, after, ""))
    got = lines.collect()
    assert lines.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in lines_by_hand([(r.doc_id, r.text) for r in after.collect()]))

    near = corpus_pipeline.materialize(stage["near_dedup"](spark, lines, ""))
    comp = components_by_hand([(r.doc_id, r.text) for r in got if r.doc_id is not None])
    assert key(near.collect()) == key([r for r in got if r.doc_id is None] + [*{r.doc_id: r for r in got if r.doc_id is not None and comp[r.doc_id][1] == r.doc_id}.values()])

    mixed = corpus_pipeline.materialize(stage["mix_sources"](spark, near, ""))
    assert mixed.columns == d.columns
    want = collections.Counter({(r.doc_id, r.source): r.copies for r in mixing.mix(near).collect() if r.copies})
    assert collections.Counter((r.doc_id, r.source) for r in mixed.collect()) == want

    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file())
    out = stage["encode_pieces"](spark, mixed, "").collect()
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(r.doc_id), sp.encode(r.text)) for r in mixed.collect())
    assert all(r.n_pieces == len(r.ids) for r in out) and pieces.load_pieces(model_file()).bpe
