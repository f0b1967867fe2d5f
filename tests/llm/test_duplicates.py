import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import embedding, ngram_join, substring
from loomgraph.llm.text import hash_words
from loomgraph.plans.scratch import Scratch
from tests_llm_helpers import WORD, near_copy, odd_rows, prose


def components(ids, links):
    part = {i: i for i in ids}
    while True:
        after = dict(part)
        for a, b in links:
            low = min(after[a], after[b])
            after[a] = after[b] = low
        if after == part:
            return part
        part = after


def grams(t):
    w = re.findall(WORD, t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_bands_reach_the_recall():
    b = ngram_join.Bands.choose()
    assert (1 - 0.8**b.rows) ** b.bands <= ngram_join.MISS and b.bands * b.rows <= ngram_join.MOST_HASHES


def test_shared_counts():
    rng = np.random.default_rng(1)
    core = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(core)[: rng.integers(0, 300)], rng.integers(0, 400, rng.integers(0, 200)).astype(np.uint64)])) for _ in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (ngram_join.shared_counts(sets) == np.array(want)).all()


@pytest.mark.parametrize("whole", [22, 0])
def test_jaccard_join_against_brute_force(spark, odd, none, monkeypatch, whole):
    assert ngram_join.near_documents(none, Scratch(spark)).collect() == []
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 8)  # so that groups fall into several blocks
    monkeypatch.setattr(ngram_join, "WHOLE_CHUNKS", whole)  # 0: bucket by bucket
    rng = random.Random(7)
    base = prose(rng, 130)
    more = [(100 + i, near_copy(rng, base, i % 3)) for i in range(40)] + [(200 + i, prose(rng, 30)) for i in range(20)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in odd_rows()] + more
    sets = [(i, grams(t)) for i, t in rows]
    named = [(i, g) for i, g in sets if i is not None and g]
    near = [(x, y) for x in range(len(named)) for y in range(x) if Fraction(len(named[x][1] & named[y][1]), len(named[x][1] | named[y][1])) >= Fraction(4, 5)]
    part = components(range(len(named)), near)
    count, least = defaultdict(int), {}
    for x, y in near:
        count[x] += 1
        count[y] += 1
    for x, (i, _) in enumerate(named):
        least[part[x]] = min(i, least.get(part[x], i))
    want = [(i, len(g), least[part[x]], count[x]) for x, (i, g) in enumerate(named)] + [(i, len(g), i, 0) for i, g in sets if i is None or not g]
    found = [tuple(r) for r in ngram_join.near_documents(docs, Scratch(spark)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_keep_one(spark, odd):
    kept = ngram_join.keep_one(odd, Scratch(spark))
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 2 and ids.count(13) == 1 and 8 in ids and 9 in ids and 11 in ids and 12 not in ids


def test_keep_one_goes_by_rows(spark):
    rng = random.Random(3)
    t, u = prose(rng, 80), prose(rng, 80)
    rows = [(4, t, "a", 1), (14, u, "b", 2), (14, t, "c", 3), (14, u, "b", 9), (14, u, "a", 8), (20, "", "e", 4), (21, None, "n", 5), (None, t, "x", 6), (14, " ".join(u.split()) + " ", "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _rows long").selectExpr("*", "1 as mark", "2 as part", "3 as n", "'x' as _row0")
    for some in (docs, docs.orderBy(F.desc("_rows")).coalesce(1)):
        kept = ngram_join.keep_one(some, Scratch(spark))
        assert kept.columns == docs.columns
        left = sorted(((r.doc_id, r._row) for r in kept.collect()), key=repr)
        assert [i for i, _ in left] == [14, 20, 21, 4, None] and (4, "a") in left and left == sorted(left, key=repr)
        first = left if some is docs else first
        assert left == first
    assert ngram_join.keep_one(docs.where("false"), Scratch(spark)).collect() == []


def strip(rows):
    """Window by window, in the order of ids."""
    words = [re.findall(WORD, t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("vocabulary", [2, 12, 400])
def test_substring_dedup_against_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    passages = [prose(rng, n, vocabulary) for n in (50, 51, 49, 60, 75, 130)] + ["x " * 55, "x y " * 30]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(1, 25), vocabulary)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 9), vocabulary)]
        rows.append((rng.randrange(40), " ".join(parts)))
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == strip(rows)


def test_texts_that_swap_two_words_in_thue_morse_order_differ(spark):
    order = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(i, " ".join(f"{'foo' if o ^ i else 'bar'} u{j}" for j, o in enumerate(order))) for i in range(2)]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted(tuple(r) for r in found) == strip(rows)
    assert all(r.n_removed == 0 for r in found)


def test_each_window_goes_by_one_of_the_anchors():
    rng = random.Random(10)
    for vocabulary in (2, 50):
        words = [str(rng.randrange(vocabulary)) for _ in range(700)]
        offsets = np.array([0, 49, 49, 100, 150, 700])
        h = hash_words(pa.array(words, pa.large_string()))
        named = substring.window_anchors(substring.symbol_names(h, offsets), substring.window_starts(offsets))
        valid = [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 49)]
        at, name = substring.anchors(h, offsets)
        assert np.flatnonzero(named != substring.NONE).tolist() == valid and set(named[valid].tolist()) == set(name.tolist())
        assert all(any(substring.EDGE <= p - s < 50 - substring.EDGE and n == named[s] for p, n in zip(at, name)) for s in valid)


def test_substring_odd_rows(spark, odd, none):
    found = substring.remove_repeats(odd, Scratch(spark)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == strip([(r[0], r[1]) for r in odd_rows()])
    assert substring.remove_repeats(none, Scratch(spark)).collect() == []
    out = substring.strip_repeats(odd, Scratch(spark))
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert texts[8] is None and texts[10] == " \t\n\x0b " and texts[2] == ""


def test_equal_middles_have_equal_anchors():
    """What the guarantee rests on: equal windows share an anchor at the same place."""
    rng = random.Random(9)
    for vocabulary in (2, 3, 8, 100):
        for _ in range(60):
            window = [str(rng.randrange(vocabulary)) for _ in range(50)]
            places = []
            for _ in range(2):
                before = [str(rng.randrange(vocabulary)) for _ in range(rng.randrange(40))]
                after = [str(rng.randrange(vocabulary)) for _ in range(rng.randrange(40))]
                h = hash_words(pa.array(before + window + after, pa.large_string()))
                at, name = substring.anchors(h, np.array([0, len(h)]))
                inside = (at >= len(before)) & (at + substring.GRAM <= len(before) + 50)
                places.append(set(zip((at[inside] - len(before)).tolist(), name[inside].tolist())))
            assert places[0] & places[1]


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        v = rng.standard_normal(16)
        rows += [(3 * i, v.tolist(), i % 2), (3 * i + 1, (v + 0.08 * rng.standard_normal(16)).tolist(), i % 2)]
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + 0.03 * rng.standard_normal(16)).tolist(), 0) for i in range(60)]
    rows += [(2000 + i, [2.0, *[0.0] * 15], 1) for i in range(5)] + [(2005, [4.0, *[0.0] * 15], 1)]
    odd_ones = [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [None] * 16, 0), (3004, [], 0), (3005, centre.tolist(), None), (None, centre.tolist(), 0), (3006, [1.0, 0.0], 1), (3007, [1.0, 0.0], 1), (2000, [2.0, *[0.0] * 15], 1)]
    df = spark.createDataFrame([*rows, *odd_ones], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "2 as n", "3 as t")
    good = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in [*rows, odd_ones[-1], *odd_ones[-3:-1]]]
    near = []
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a], good[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.98:
                near.append((a, b))
    part = components(range(len(good)), near)
    count, least = defaultdict(int), {}
    for a, b in near:
        count[a] += 1
        count[b] += 1
    for a, (i, _, _) in enumerate(good):
        least[part[a]] = min(i, least.get(part[a], i))
    want = [(i, count[a], least[part[a]], i == least[part[a]]) for a, (i, _, _) in enumerate(good)]
    want += [(i, 0, i, i is not None) for i, _, _ in odd_ones[:7]]
    found = [tuple(r) for r in embedding.near_vectors(df, Scratch(spark)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert embedding.near_vectors(df.where("false"), Scratch(spark)).collect() == []


def test_tables_reach_the_recall():
    for n in (0, 1, 100, 10**6, 10**11):
        t = embedding.Tables.choose(n)
        assert (1 - embedding.meet_chance(0.2) ** t.projections) ** t.tables <= 1.001e-5
