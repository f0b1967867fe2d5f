"""What is in no learned language goes, what is in several stays."""

import random

import corpus_pipeline
from loomgraph.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_unlearned_scripts_and_gibberish_lower_the_score(spark):
    docs = spark.read.parquet(SF)
    rng = random.Random(4)
    gibberish = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(5, 12))) for _ in range(80))
    clean = {r.lang: r.text for r in docs.where("lang is not null and length(text) between 600 and 2000").orderBy("doc_id").collect()}
    mixed = " ".join(" ".join(t.split()[:40]) for t in clean.values())
    rows = [(-1, gibberish), (-2, "ქართული ენა არის ლამაზი " * 20), (-3, mixed), (-4, "ქართული " * 90 + clean["en"][:60]), *((-5 - i, t) for i, t in enumerate(clean.values()))]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), langid.train(docs)).collect()}
    assert len(clean) >= 3
    assert found[-2].lang_pred == "und" and found[-2].score == 0 and found[-2].learned == 0
    assert all(found[i].learned < corpus_pipeline.LEAST_SHARE for i in (-1, -4))
    assert all(found[i].learned > 0.9 for i in found if i == -3 or i < -4)


def test_clean_mixed_texts_stay(spark):
    words = {"aa": "bana kolo tiru", "bb": "xeph dwyq mnog", "cc": "ulli esso arri"}
    rows = [(10 * i + j, f"{t} {t}", lang) for i in range(40) for j, (lang, t) in enumerate(words.items())]
    text = " ".join(" ".join([t] * 4) for t in words.values())
    docs = spark.createDataFrame([*rows, (9991, text, "aa"), (9992, "ქართული ენა " * 9, None)], "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert 9991 in left and 9992 not in left
