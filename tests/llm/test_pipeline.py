import corpus_pipeline
from loomgraph.plans.scratch import Scratch


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixture", "sequences"]


def test_stages_keep_columns_and_take_effect(spark, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd, odd.select(*columns), none):
        scratch, docs = Scratch(spark), start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, docs = docs, scratch.save(stage(spark, docs, ""), name)
            if i < 4:
                assert docs.columns == start.columns
            if name == "language":
                left = {r.doc_id for r in docs.select("doc_id").collect()}
                assert not left & {8, 9, 10, 18}
                assert start is none or {1, 2, 6, 7, 15} <= left
            if name == "near_duplicates":
                assert docs.where("doc_id in (2, 3)").isEmpty()
            if name == "repeats":
                assert docs.where("n_chars <> length(text)").isEmpty() and docs.count() == before.count()
        assert docs.columns[:3] == ["doc_id", "start", "length"]
        assert docs.isEmpty() == (start is none)
