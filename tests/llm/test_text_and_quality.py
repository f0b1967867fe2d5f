import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import langid, quality, text
from loomgraph.llm.oracles import QUALITY_SQL
from tests_llm_helpers import WORD, odd_rows, register


def test_words_and_grams():
    texts = ["a b  c", None, "", " \t", "x", "a\x1cb \x85c d\u00a0e"]
    flat, offsets = text.words_of(pa.array(texts))
    want = [re.findall(WORD, t or "") for t in texts]
    assert [flat.to_pylist()[a:b] for a, b in zip(offsets, offsets[1:])] == want
    h = text.hash_words(pa.array([str(i % 7) for i in range(100)], pa.large_string()))
    for n in (1, 2, 3, 5, 13, 50):
        g = text.gram_hashes(h, n)
        assert len(g) == 100 - n + 1 and g[0] == g[7] and len(set(g.tolist())) == min(7, len(g))
    assert len(text.gram_hashes(h[:3], 5)) == 0


def base_measures(t):
    words = re.findall(WORD, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, odd):
    rng = random.Random(2)
    extra = [(100 + i, "".join(rng.choice("ab \n#|") for _ in range(rng.randrange(200)))) for i in range(40)]
    docs = odd.select("doc_id", "text").where("doc_id is null or doc_id <> 15").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = quality.quality_report(docs).collect()
    want = sorted((i, *base_measures(t)) for i, t in [*extra, *((r[0] or -1, r[1]) for r in odd_rows() if r[0] != 15)])
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in found)


def test_quality_runs_no_python(odd, none):
    plan = quality.quality_report(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality.quality_report(none).collect() == []


def test_quality_sql_agrees_on_labels(spark):
    con = register("/root/testdata/sf0.001", ["documents"])
    want = {r[0]: r[-1] for r in con.execute(QUALITY_SQL).fetchall()}
    found = {r.doc_id: r.kept for r in quality.quality_report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert found == want
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.001/labels.parquet'").fetchall())
    failed = {r[0] for r in con.execute(QUALITY_SQL).fetchall() if r[6]}
    judged = [(found[i], bool(q)) for i, q in labels.items() if i in found and i not in failed]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    sizes = [0, 1, 5, 7, 3, 0]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 4, (offsets[-1], 3)).astype(np.float32)
    labels = langid.viterbi(scores, offsets, 5.0)

    def worth(path, s):
        return sum(float(s[i, k]) for i, k in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:]))

    for a, b in zip(offsets, offsets[1:]):
        best = {(): 0.0}
        for _ in range(b - a):
            best = {(*p, k): 0 for p in best for k in range(3)}
        if b > a:
            top = max(worth(p, scores[a:b]) for p in best)
            assert abs(worth(labels[a:b].tolist(), scores[a:b]) - top) < 1e-4


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.language_report(docs).collect() if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_spans_scripts_and_odd_rows(spark, odd, none):
    model = langid.LanguageModel([], np.zeros((1 << langid.FEATURE_BITS, 0), np.float32), np.zeros((len(langid.SCRIPT_NAMES), 0), bool))
    assert {r.lang_pred for r in langid.identify(odd, model).collect()} == {"und"}
    assert langid.language_report(none).collect() == []
    rows = {(r.doc_id, r.lang_pred) for r in langid.language_report(odd).collect()}
    assert len(langid.language_report(odd).collect()) == odd.count()
    assert (8, "und") in rows and (9, "und") in rows and (18, "und") in rows
    rows = [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("кот и собака", "ru"))]
    docs = spark.createDataFrame([(2 * i + (lang == "ru"), t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.train(docs)
    mixed = spark.createDataFrame([(1, "the dog and the cat the dog кот и собака и кот")], "doc_id long, text string")
    spans = [(s["lang"], s["first_word"], s["last_word"]) for s in langid.identify(mixed, model).first().spans]
    assert spans == [("en", 0, 6), ("ru", 7, 11)]
