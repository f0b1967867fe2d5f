"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Every word gets a score for each learned language from its character 1- to 4-grams. Languages
that never use the word's script are ruled out for it. Viterbi with a penalty for each switch
then labels the words of the whole text, so that mixed-language texts come out as spans.

A word is evidence of its label if the language uses the word's script and most of the word's
3- and 4-grams were seen in it; in scripts without such n-grams of words (UNSPACED) the script is enough.

Defined results: a text that is null or has no letter, or no word that is evidence, is ``und`` with
score 0 and no spans; words without a letter are not counted and take their neighbours' label, other
words without evidence lower the score; without any training row every text is ``und``. Ties go to
the language that sorts first.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import U, passes, words_of

#: Rows a language that the model is fitted on, chosen by hash: the bound of the training sample.
TRAIN_ROWS = 1500
#: Hashed n-gram features; the model is this many times the number of languages float32 values.
FEATURE_BITS = 16
#: Words that are taken apart into n-grams at once.
STEP_WORDS = 8192
ORDERS = (1, 2, 3, 4)
#: Cost of a switch of language, in the units of the word scores.
SWITCH = 12.0
#: Share of a language's letters from which a script counts as one of its scripts.
SCRIPT_SHARE = 0.01
RULED_OUT = -50.0
#: Share of a word's n-grams of LONG or more characters that its language has seen, from which the word is evidence.
LEAST_SEEN = 0.5
LONG = 3

# Code point ranges of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
LETTERLESS = -1
#: Scripts of many characters or without spaces between words, where most 3-grams of a text are new.
UNSPACED = np.isin(SCRIPT_NAMES, ["han", "kana", "hangul", "thai", "khmer"])


@lru_cache(maxsize=1)
def _code_points() -> np.ndarray:
    """The script number of every code point that is a letter, else LETTERLESS."""
    table = np.full(sys.maxunicode + 1, LETTERLESS, np.int8)
    letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    table[letters] = len(SCRIPT_NAMES) - 1
    for name, low, high in SCRIPTS:
        span = table[low : high + 1]
        span[letters[low : high + 1]] = SCRIPT_NAMES.index(name)
    return table


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(word number, feature) of all n-grams, each word's script (LETTERLESS without a letter), and the place of the first LONG n-gram."""
    points = np.frombuffer((" " + " ".join(words) + " ").lower().encode("utf-32-le"), np.uint32)
    gap = points == 32
    at = np.cumsum(gap) - 1
    if at[-1] != len(words):  # lower-casing never makes or removes a space
        raise ValueError("words must not hold spaces")
    owner, feature, short = [], [], 0
    wide = points.astype(U)
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), U)
        for n in range(1, max(ORDERS) + 1):
            size = len(points) - n + 1
            if size <= 0:
                break
            h = (h[:size] + wide[n - 1 :] + U(1)) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(31)
            if n not in ORDERS:
                continue
            good = ~gap[:size] if n == 1 else np.ones(size, bool)
            for j in range(1, n - 1):
                good &= ~gap[j : j + size]
            if n == 2:
                good &= ~(gap[:size] & gap[1:])
            good &= at[:size] < len(words)
            owner.append(at[:size][good])
            short += len(owner[-1]) if n < LONG else 0
            feature.append(((h[good] * U(2 * n + 1)) >> U(64 - FEATURE_BITS)).astype(np.int64))
    kind = _code_points()[points]
    real = kind != LETTERLESS
    tally = np.bincount(at[real] * len(SCRIPT_NAMES) + kind[real], minlength=len(words) * len(SCRIPT_NAMES))
    tally = tally[: len(words) * len(SCRIPT_NAMES)].reshape(len(words), -1)
    script = np.where(tally.any(axis=1), tally.argmax(axis=1), LETTERLESS)
    return np.concatenate(owner), np.concatenate(feature), script, short


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # (features, langs) float32, centred log probabilities
    scripts: np.ndarray  # (scripts, langs) bool: the language uses the script
    seen: np.ndarray | None = None  # (features, langs) bool: the language's sample has the feature; None: no word is evidence

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (words, langs), which words have a letter, and of which languages each is evidence (words, langs)."""
        parts = [self._scores(words[a : a + STEP_WORDS]) for a in range(0, len(words), STEP_WORDS)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) != 1 else parts[0]

    def _scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, feature, script, short = word_features(words)
        scores = np.empty((len(words), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            scores[:, k] = np.bincount(owner, self.weights[:, k][feature], minlength=len(words))[: len(words)]
        lettered = script != LETTERLESS
        scores[~lettered] = 0
        allowed = self.scripts[np.maximum(script, 0)]
        known = lettered & allowed.any(axis=1)
        scores[lettered & ~known] = 0
        scores[known[:, None] & ~allowed] = RULED_OUT
        evidence = np.zeros(scores.shape, bool)
        if self.seen is not None:
            least = LEAST_SEEN * np.bincount(owner[short:], minlength=len(words))[: len(words)]
            for k in range(len(self.langs)):
                evidence[:, k] = np.bincount(owner[short:], self.seen[:, k][feature[short:]], minlength=len(words))[: len(words)] >= least
        return scores, lettered, (evidence | UNSPACED[script][:, None]) & allowed & lettered[:, None]


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; ``offsets`` bound the documents, which are solved side by side."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")  # documents longer than t
    n, k = scores.shape
    jumped, best_before = np.zeros((n, k), bool), np.zeros(n, np.int16)
    labels, value = np.zeros(n, np.int16), np.zeros((len(starts), k), np.float64)
    for t, m in enumerate(live):
        at = starts[:m] + t
        if t == 0:
            value[:m] = scores[at]
            continue
        now = value[:m]
        best = now.argmax(axis=1)
        top = now[np.arange(m), best][:, None] - switch
        jumped[at] = now < top
        best_before[at] = best
        value[:m] = np.maximum(now, top) + scores[at]
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        at = starts[: live[t]] + t
        now = state[: live[t]]
        labels[at] = now
        state[: live[t]] = np.where(jumped[at, now], best_before[at], now)
    return labels


def _count_features(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, n) of the sample; scripts are features below zero."""
    width = 1 << FEATURE_BITS
    total = {}
    for part in itertools.chain.from_iterable(map(passes, batches)):
        langs = part.column("lang").to_pylist()
        flat, offsets = words_of(part.column("text"))
        for lang in set(langs):
            rows = [i for i, x in enumerate(langs) if x == lang]
            words = list(itertools.chain.from_iterable(flat.slice(offsets[i], offsets[i + 1] - offsets[i]).to_pylist() for i in rows))
            if not words:
                continue
            counts, kinds = total.setdefault(lang, (np.zeros(width, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
            for a in range(0, len(words), STEP_WORDS):
                _, feature, script, _ = word_features(words[a : a + STEP_WORDS])
                counts += np.bincount(feature, minlength=width)
                kinds += np.bincount(script[script != LETTERLESS], minlength=len(SCRIPT_NAMES))
    for lang, (counts, kinds) in total.items():
        at, kind = np.flatnonzero(counts), np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(at) + len(kind))), pa.array(np.concatenate([at, -kind - 1])), pa.array(np.concatenate([counts[at], kinds[kind]]))],
            names=keys,
        )


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on about ``train_rows`` rows of each language whose crc32 of the id isn't 0 modulo 5.

    Only text and lang are learned from. The sample is drawn by hash, so reruns agree, and its
    n-gram counts are summed on the executors: what reaches the driver is bounded by the number of
    features times the number of languages.
    """
    chosen = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((1 << FEATURE_BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(train_rows / n)) for k, n in sizes.items()))
    sample = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("lang")]).select("lang", "text")
    keys = ["lang", "feature", "n"]
    counted = sample.mapInArrow(lambda it: _count_features(it, keys), "lang string, feature long, n long")
    rows = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    counts, kinds = np.zeros((1 << FEATURE_BITS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    column = {k: i for i, k in enumerate(langs)}
    for lang, feature, n in rows:
        if feature < 0:
            kinds[-feature - 1, column[lang]] = n
        else:
            counts[feature, column[lang]] = n
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * len(counts))
    scripts = kinds >= SCRIPT_SHARE * np.maximum(kinds.sum(axis=0), 1)
    scripts &= kinds > 0
    return LanguageModel(langs, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), scripts, counts > 0)


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel, switch: float, kept: list[str], with_spans: bool) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    for part in itertools.chain.from_iterable(map(passes, batches)):
        flat, offsets = words_of(part.column("text"))
        n, k = part.num_rows, len(model.langs)
        pred, score, learned, n_spans, spans = ["und"] * n, np.zeros(n), np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
        if len(flat) and k:
            coded = flat.dictionary_encode()
            table, lettered, evidence = model.word_scores(coded.dictionary.to_pylist())
            at = coded.indices.to_numpy(zero_copy_only=False)
            labels, real = viterbi(table[at], offsets, switch), lettered[at]
            owner = np.repeat(np.arange(n), np.diff(offsets))
            sure = evidence[at, labels]
            tally = np.bincount(owner[sure] * k + labels[sure], minlength=n * k).reshape(n, k)
            lettered_words = np.bincount(owner[real], minlength=n)
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(labels) != 0) | (np.diff(owner) != 0)]))
            ends = np.concatenate([cuts[1:], [len(labels)]])
            for i in np.flatnonzero(tally.any(axis=1)):
                pred[i], score[i] = model.langs[tally[i].argmax()], tally[i].max() / lettered_words[i]
                learned[i] = tally[i].sum() / lettered_words[i]
            some = tally.any(axis=1)
            n_spans = np.where(some, np.bincount(owner[cuts], minlength=n), 0)
            for a, b in zip(cuts.tolist(), ends.tolist()) if with_spans else ():
                if some[i := owner[a]]:
                    spans[i].append({"lang": model.langs[labels[a]], "first_word": a - offsets[i], "last_word": b - 1 - offsets[i]})
        told = pa.array(spans, kinds) if with_spans else pa.array(n_spans, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in kept), pa.array(pred), pa.array(score, pa.float64()), pa.array(learned, pa.float64()), told],
            names=[*kept, "lang_pred", "score", "learned", "spans" if with_spans else "n_spans"],
        )


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH, carried: tuple[str, ...] = ("doc_id",), with_spans: bool = True) -> DataFrame:
    """The ``carried`` columns and lang_pred, score, learned, spans (their number n_spans without ``with_spans``) of every whole text.

    ``score`` is the share of the lettered words that are evidence of the predicted language,
    ``learned`` the share of those that are evidence of their own label; ``spans`` are runs of words
    (numbered from 0) of one label. Rows are independent: repeated and null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = list(carried)
    own = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    spans = "spans array<struct<lang: string, first_word: long, last_word: long>>" if with_spans else "n_spans long"
    schema = own + "lang_pred string, score double, learned double, " + spans
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(lambda batches: _predict(batches, shared.value, switch, kept, with_spans), schema)


def language_report(docs: DataFrame) -> DataFrame:
    """Train and predict: doc_id, held_out, lang_pred, score, n_spans."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = identify(docs, train(docs), with_spans=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")
