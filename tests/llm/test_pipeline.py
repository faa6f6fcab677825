"""The stages of the pipeline, each against what it must have done with its input."""

import zlib

import corpus_pipeline
from minutebook.llm.common import load, materialize
from .test_text_operators import classes_of, repeats

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tokenizer):
    docs = load(spark, FOLDER, "documents")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, FOLDER), name)
        held[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    toxic = {r.doc_id for r in load(spark, FOLDER, "labels").where("toxic = 1").collect()}
    before, after = held["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone and len(gone & toxic) >= 0.8 * len(toxic) and set(after) <= set(before)
    before, after = held["near_duplicates"]
    classes = classes_of([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == set(classes.values()) and set(after) <= set(before)
    before, after = held["repeated_passages"]
    want, old = repeats([(r.doc_id, r.text) for r in before]), {r.doc_id: r for r in before}
    assert len(after) == len(before)
    for r in after:
        [(words, removed, _)] = want[r.doc_id]
        assert len(r.text.split()) == words - removed and r.n_chars == len(r.text)
        assert removed or r.text == old[r.doc_id].text
    before, after = held["mixing"]
    assert sorted(before) == sorted(after)
    _, pieces = held["packing"]
    ids = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    # packing follows the mixture
    from minutebook.llm import mixing
    mixture = spark.createDataFrame(before, ",".join(f"{n} {t}" for n, t in load(spark, FOLDER, "documents").dtypes))
    order = [r.doc_id for r in mixing.mix(mixture).orderBy("mix.slot", "mix.start").collect()]
    assert ids == order
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert all(0 <= p.ids_crc32 <= 0xFFFFFFFF for p in pieces) and zlib.crc32(b"") == 0


def test_stages_bear_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (None, "some words", "en", None, 10, "x")],
                                "doc_id long, text string, lang string, source string, n_chars long, mix string")
    for table in (odd.limit(0), odd):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, FOLDER), name)
            assert docs.columns == table.columns
        assert docs.count() == table.count() and corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == table.count()
