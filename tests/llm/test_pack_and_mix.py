import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing, packing
from loomgraph.plans.scratch import Scratch
from tests_llm_helpers import odd_rows


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_units_give_the_tokenizers_ids(tokenizer):
    rng = random.Random(3)
    texts = [r[1] for r in odd_rows() if r[0] != 15] + ["".join(rng.choice(" \n\ta1'é漢\u00a0\u3000\x85s.😀") for _ in range(rng.randrange(60))) for _ in range(400)]
    mark = "<|endoftext|>"
    marked = [mark, f"a {mark} b", f"{mark}{mark}", f"x{mark}", None, "", f" \n {mark} \n tail ", "<|endoftext|", f"<|endoftext{mark}", *(f"{a}{mark}{b}" for a, b in zip(texts[-40:], texts[-39:]))]
    encoder = packing.UnitEncoder("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    for some in (texts, texts[3:9], [None], ["", ""], marked, [*marked, *texts], [mark]):
        ids, offsets = encoder.documents(pa.array(some, pa.string()))
        for i, t in enumerate(some):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == ids_of(tokenizer, t)[:-1], repr(t)


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_windows(seed):
    rng = np.random.default_rng(seed)
    held = np.bincount(rng.integers(1, 65, [0, 5, 300, 4000][seed]), minlength=65)
    plan = packing.plan_packing(held, 64)
    length = np.repeat(np.arange(65), held)
    rank = np.concatenate([np.arange(n) for n in held]) if held.sum() else np.zeros(0, np.int64)
    sequence, offset = plan.place(length, rank) if len(length) else (length, length)
    at = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        at[s].append((o, n))
    assert len(at) == plan.sequences
    for pieces in at.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 64
    if seed == 3:
        assert plan.sequences * 64 < 1.01 * length.sum()


def flat_plans():
    """Histograms of short texts, of one length, and of real ones, to be held 1 and 1000 times."""
    rng = np.random.default_rng(1)
    short = np.bincount(np.minimum(rng.lognormal(4.6, 0.5, 20_000).astype(int) + 1, 1024), minlength=1025)
    one = np.zeros(1025, np.int64)
    one[700] = 1000
    ones = np.zeros(1025, np.int64)
    ones[1] = 5000
    return [short, one, ones, np.bincount(rng.integers(1, 1025, 30_000), minlength=1025)]


@pytest.mark.parametrize("case", range(4))
def test_plan_does_not_grow_with_the_corpus(case):
    held = flat_plans()[case]
    small, large = packing.plan_packing(held), packing.plan_packing(1000 * held)
    # combinations that the small one rounds to nothing are used by the large one: three runs each at most
    assert len(large.length) <= 3 * len(packing.combinations(1024, held)) + 60 * np.count_nonzero(held)
    assert case == 3 or len(large.length) < 1.5 * len(small.length) + 6000
    assert packing.plan_packing(10 * 1000 * held).length.size <= 1.1 * len(large.length) + 100
    tokens = int((np.arange(1025) * held).sum()) * 1000
    if case in (0, 2, 3):
        assert large.sequences * 1024 < 1.02 * tokens


def test_pack_round_trip(spark, odd, none, tokenizer):
    assert packing.pack(none, Scratch(spark)).collect() == []
    more = [(900 + i, t) for i, t in enumerate(["<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "word " * 3000])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("g", F.lit(1)).withColumn("rank", F.lit(2))
    rows = packing.pack(docs, Scratch(spark)).collect()
    texts = defaultdict(list)
    for i, t, *_ in [*odd_rows(), *more]:
        texts[i].append(ids_of(tokenizer, t))
    pieces = defaultdict(int)
    for r in rows:
        fits = [x for x in texts[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert fits and r.length <= 1024
        pieces[r.doc_id] += r.length
    assert dict(pieces) == {i: sum(map(len, x)) for i, x in texts.items()}
    spots = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(spots)) == len(spots)


def targets(sizes):
    """Water filling, share by share, with weights 3, 1, 2 in the order of sources."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        left = {s for s in sizes if s not in done}
        rest = total - sum(done.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return done | share
        done |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark, odd, none):
    assert mixing.mix(none, Scratch(spark)).collect() == []
    rng = random.Random(4)
    more = spark.createDataFrame([(1000 + i, "w " * rng.randrange(30), f"s{min(i % 9, 5)}") for i in range(600)], "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source").unionByName(more)
    rows = mixing.mix(docs, Scratch(spark)).collect()
    assert len(rows) == docs.count()
    sizes, taken, big, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        big[r.source] = max(big[r.source], r["size"])
        target[r.source] = r.target
    want = targets(dict(sizes))
    for s in sizes:
        assert abs(want[s] - target[s]) < 1e-6 * (1 + want[s]) and abs(taken[s] - target[s]) <= big[s]
    again = mixing.mix(docs, Scratch(spark)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_inclusion_follows_the_probabilities(spark):
    """900 sources of the same 18 sizes, 300 of each weight, are as many draws."""
    shape = [3, 5, 8, 8, 12, 20, 20, 30, 45, 45, 60, 80, 100, 120, 150, 200, 400, 700]
    rows = [(100 * i + j, "w " * n, f"s{i:04}") for i in range(900) for j, n in enumerate(shape)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark), "draw 1:").collect()
    often, chance, words, goal = defaultdict(int), {}, defaultdict(int), {}
    for r in found:
        w, j = int(r.source[1:]) % 3, r.doc_id % 100
        whole = int(r.target // r.source_size)
        often[w, j] += r.copies - whole
        chance[w, j] = r.p
        words[r.source] += r.taken
        goal[r.source] = r.target
        assert abs(r.p - min(1, r.p)) == 0 and (r.copies == whole + 1 if r.p == 1 else r.copies in (whole, whole + 1))
    assert all(abs(words[s] - goal[s]) <= 350 for s in goal)
    used = {w for (w, _), p in chance.items() if p > 0}
    assert used
    for w in used:
        p = np.array([chance[w, j] for j in range(18)])
        rest = next(goal[s] for s in goal if int(s[1:]) % 3 == w) % sum(shape)
        assert abs((p * shape).sum() - rest) < 1e-6 * rest and len(set(np.round(p, 9))) > 5
        middle = p < 1
        assert np.allclose(p[middle] / np.array(shape)[middle], (p[middle] / np.array(shape)[middle])[0])
        share = np.array([often[w, j] for j in range(18)]) / 300
        # Pareto sampling keeps its probabilities but nearly, the more so as the cut is in words
        assert np.abs(share - p).max() < 0.13 and np.corrcoef(share, p)[0, 1] > 0.97


def test_repeat_rows_keeps_columns(spark, odd, none):
    out = mixing.repeat_rows(odd, Scratch(spark))
    assert out.columns == odd.columns
    assert out.count() == mixing.mix(odd, Scratch(spark)).agg(F.sum("copies")).first()[0]
    assert mixing.repeat_rows(none, Scratch(spark)).collect() == []


def test_mix_runs_no_python(spark, odd):
    plan = mixing.mix(odd, Scratch(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
