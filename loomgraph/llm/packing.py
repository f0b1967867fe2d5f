"""Packing: non-negative least squares over length combinations that fill a window.

A document is its token ids and then the end id. It is cut into full windows and one tail, and the
histogram of piece lengths (window numbers, whatever the corpus) goes to the driver. There, shallow
combinations of one to three lengths that fill a window exactly are enumerated, repeat counts
``x >= 0`` with ``A x`` near the histogram are found by accelerated projected gradient descent,
counts are rounded down to what the histogram still holds, and the residual pieces are packed best
fit, longest first: a pattern is repeated as often as the pieces that are left allow, so each
residual pattern uses up a length, and there are no more patterns than lengths. The plan says, for
each length, which ranks go to which sequences; pieces get their ranks by counts of hashed groups
whose number follows the length's count, so no length, however frequent, meets in one task.

Defined results: a null text is empty and packs as its end id alone; repeated rows and ids are
packed once for each row; no rows give no rows. The literal of a token that the tokenizer's file
adds to its vocabulary (``<|endoftext|>``) becomes that token's id, as the tokenizer does by default;
with ``added=False`` it is ordinary text.
"""

from __future__ import annotations

import base64
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.text import passes
from loomgraph.plans.scratch import Scratch

WINDOW = 1024
END_ID = 0
ROUNDS = 400


@lru_cache(maxsize=4)
def _encoder(ranks_file: str):
    import public_tokenizers
    import tiktoken

    lines = map(bytes.split, open(public_tokenizers.path(ranks_file), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        widths[i] = len(token)
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


@lru_cache(maxsize=4)
def added_tokens(vocabulary_file: str | None) -> dict[str, int]:
    """The tokens that a tokenizer's file adds to its vocabulary, and their ids."""
    if vocabulary_file is None:
        return {}
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary_file), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


#: First bytes of UTF-8 characters among which there is no white space; a cut is made only next to these.
_SOLID_LEAD = np.zeros(256, bool)
_SOLID_LEAD[0x21:0x7F] = _SOLID_LEAD[0xC3:0xE0] = _SOLID_LEAD[0xE4:0xF5] = True


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before ``at`` is known not to be white space."""
    one, two, three = data[at - 1], data[at - 2], data[at - 3]
    trail = (one >= 0x80) & (one < 0xC0)
    return ((one < 0x80) & _SOLID_LEAD[one]) | (trail & (two >= 0xC3) & (two < 0xE0)) | (trail & (two >= 0x80) & (two < 0xC0) & (three >= 0xE4) & (three < 0xF0))


def _joined(strings: pa.Array) -> str:
    edges = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return bytes(memoryview(strings.buffers()[2])[edges[0] : edges[-1]]).decode() if len(strings) else ""


class UnitEncoder:
    """Ids of whole texts, put together from the ids of units that no token crosses.

    The tokenizer's pattern never joins a non-space to a following space, and joins one single
    space to the word after it. So a text may be cut before any single space between two
    non-spaces, and equal units have equal ids: each distinct unit of a pass is encoded once.
    """

    def __init__(self, ranks_file: str, vocabulary_file: str | None = None):
        self.encoding, self.widths = _encoder(ranks_file)
        self.added = added_tokens(vocabulary_file)
        self.literals = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def _distinct(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units one after the other, and the offsets of each.

        Units that start with a space and end in a non-space are encoded as one text; the bytes of
        each token tell where a unit ends.
        """
        edges = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        data = np.frombuffer(units.buffers()[2], np.uint8)
        size = np.diff(edges)
        joins = size >= 2
        at = edges[:-1][joins]
        joins[joins] = (data[at] == 32) & _SOLID_LEAD[data[at + 1]] & _solid_before(data, edges[1:][joins])
        together = units.filter(pa.array(joins))
        ids = np.array(self.encoding.encode_ordinary(_joined(together)), np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.widths[ids])])
        bounds = np.concatenate([[0], np.cumsum(size[joins])])
        token = np.searchsorted(ends, bounds)
        if (ends[token] != bounds).any():
            raise ValueError("a token crosses a unit")
        alone = [np.array(self.encoding.encode_ordinary(x), np.uint32) for x in units.filter(pa.array(~joins)).to_pylist()]
        counts = np.zeros(len(units), np.int64)
        counts[joins] = np.diff(token)
        counts[~joins] = [len(x) for x in alone]
        base = np.zeros(len(units), np.int64)
        base[joins] = token[:-1]
        base[~joins] = len(ids) + np.cumsum(counts[~joins]) - counts[~joins]
        return np.concatenate([ids, *alone]), np.stack([base, counts])

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the offsets of each text."""
        found = pc.fill_null(pc.match_substring_regex(texts, self.literals.pattern), False) if self.added else None
        if found is None or not pc.any(found).as_py():
            return self._plain(texts)
        # a text around literals is as many texts, each of them encoded alone
        parts, owner, literal = [], [], []
        for i, (text, cut) in enumerate(zip(texts.to_pylist(), found.to_pylist())):
            for j, part in enumerate(self.literals.split(text) if cut else [text]):
                parts.append("" if j % 2 else part)
                literal.append(self.added[part] if j % 2 else -1)
                owner.append(i)
        ids, offsets = self._plain(pa.array(parts, pa.large_string()))
        at = np.flatnonzero(np.array(literal) >= 0)
        ids = np.insert(ids, offsets[at], np.array(literal, np.int64)[at].astype(np.uint32))
        sizes = np.diff(offsets)
        sizes[at] = 1
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, weights=sizes, minlength=len(texts)))]).astype(np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        low, high = int(edges[0]), int(edges[-1])
        if low == high:
            return np.zeros(0, np.uint32), np.zeros(len(whole) + 1, np.int64)
        data = np.frombuffer(whole.buffers()[2], np.uint8)[:high]
        gaps = np.flatnonzero(data[low:high] == 32) + low
        gaps = gaps[(gaps > low + 2) & (gaps + 1 < high)]
        gaps = gaps[_solid_before(data, gaps) & _SOLID_LEAD[data[gaps + 1]]]
        marks = np.zeros(high - low + 1, bool)
        marks[gaps - low] = marks[edges - low] = True
        cuts = np.flatnonzero(marks) + low
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), whole.buffers()[2])
        coded = units.dictionary_encode()
        ids, (base, counts) = self._distinct(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        wide = counts[index]
        ends = np.cumsum(wide)
        place = np.repeat(base[index] - (ends - wide), wide) + np.arange(ends[-1])
        # a text's ids end with its last unit
        upto = np.concatenate([[0], ends])[np.searchsorted(cuts, edges)]
        return ids[place], upto


def _pieces(batches: Iterator[pa.RecordBatch], ranks_file: str, vocabulary_file: str | None, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = UnitEncoder(ranks_file, vocabulary_file)
    for part in itertools.chain.from_iterable(passes(b, limit=8 << 20) for b in batches):
        ids, offsets = encoder.documents(part.column("text"))
        row, start, length, crc, total = [], [], [], [], []
        for i in range(part.num_rows):
            own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
            for a in range(0, len(own), window):
                piece = own[a : a + window]
                row.append(i)
                start.append(a)
                length.append(len(piece))
                crc.append(zlib.crc32(piece.tobytes()))
                total.append(len(own))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        )


@dataclass(frozen=True)
class PackingPlan:
    """For each length, in the order of ranks: which run of ranks goes to which run of sequences.

    A run's pattern holds its length ``times`` times over, one after the other: so many ranks go to
    a sequence, and the next ones to the next.
    """

    length: np.ndarray
    rank: np.ndarray  # first rank of the run
    sequence: np.ndarray  # sequence of the first rank
    offset: np.ndarray
    times: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << np.int64(44)
        at = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        turn, nth = np.divmod(rank - self.rank[at], self.times[at])
        return self.sequence[at] + turn, self.offset[at] + nth * length


def combinations(window: int, held: np.ndarray) -> np.ndarray:
    """(n, 3) lengths a >= b >= c that fill the window, of lengths that the histogram holds; 0 stands for none."""
    have = np.flatnonzero(held)
    have = have[have > 0]
    out = []
    if held[window]:
        out.append([window, 0, 0])
    for b in have:
        a = window - b
        if a >= b and held[a]:
            out.append([a, b, 0])
    out = np.array(out, np.int64).reshape(-1, 3)
    b, c = np.meshgrid(have, have, indexing="ij")
    good = (c <= b) & (window - b - c >= b)
    b, c = b[good], c[good]
    a = window - b - c
    good = held[a] > 0
    return np.concatenate([out, np.stack([a[good], b[good], c[good]], axis=1)])


def solve_counts(combos: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - held|^2, column j of A counting combination j's lengths."""
    if not len(combos):
        return np.zeros(0)
    size, flat = len(held), combos.ravel()
    real = flat > 0
    owner = np.repeat(np.arange(len(combos)), 3)[real]
    flat = flat[real]
    forward = lambda x: np.bincount(flat, weights=x[owner], minlength=size)
    back = lambda r: np.bincount(owner, weights=r[flat], minlength=len(combos))
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A^T A bounds the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    target = held.astype(float)
    target[0] = 0
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(rounds):
        after = np.maximum(0, y - back(forward(y) - target) / (1.05 * top))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan_packing(held: np.ndarray, window: int = WINDOW) -> PackingPlan:
    """The plan for ``held[n]`` pieces of each length n up to the window."""
    left = held.astype(np.int64).copy()
    combos = combinations(window, left)
    x = solve_counts(combos, left)
    runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, offset, times
    used, sequence = np.zeros(len(left), np.int64), 0

    def put(pattern: dict[int, int], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for n, times in pattern.items():
            runs.append((n, used[n], sequence, offset, times))
            used[n] += times * repeats
            left[n] -= times * repeats
            offset += n * times
        sequence += repeats

    def repeat(j: int, most: int) -> None:
        pattern = Counter(n for n in combos[j].tolist() if n)
        repeats = min([most, *(int(left[n]) // times for n, times in pattern.items())])
        if repeats > 0:
            put(pattern, repeats)

    order = np.argsort(-x, kind="stable")
    for j in order[: np.count_nonzero(x > 0.5)].tolist():  # the integral part of the solution, then what still fits of the rest
        repeat(j, int(np.floor(x[j] + 1e-9)))
    for j in order[: np.count_nonzero(x > 0.5)].tolist():
        if x[j] - np.floor(x[j]) > 0.5:
            repeat(j, 1)
    # residual: best fit, longest first; a bit for each length that is left
    bits = sum(1 << n for n in np.flatnonzero(left[1:]).tolist()) << 1
    while bits:
        space, below, pattern = window, window, {}
        while fits := bits & ((1 << (min(space, below) + 1)) - 1):
            n = fits.bit_length() - 1
            pattern[n] = min(space // n, int(left[n]))
            space -= n * pattern[n]
            below = n - 1
        put(pattern, min(int(left[n]) // times for n, times in pattern.items()))
        for n in pattern:
            if not left[n]:
                bits &= ~(1 << n)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return PackingPlan(*table.T.copy(), sequences=sequence)


def _place(batches: Iterator[pa.RecordBatch], plan: PackingPlan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = plan.place(length, rank)
        kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])


def pack(
    docs: DataFrame,
    scratch: Scratch,
    ranks_file: str = "byte_bpe_50k.tiktoken",
    vocabulary_file: str = "byte_bpe_50k.json",
    window: int = WINDOW,
    end_id: int = END_ID,
    added: bool = True,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``ranks_file`` is a public tokenizer's file of ranks and ``vocabulary_file`` the file of the same
    vocabulary that names its added tokens; the ids are those of the latter's tokenizer. What the
    driver holds is the histogram (``window`` numbers) and the plan: at most three runs for each
    combination and, for each length, the runs of one residual pattern, however many pieces there are.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long"
    literals = vocabulary_file if added else None
    cut = docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, ranks_file, literals, window, end_id), fields)
    cut = scratch.save(cut, "pieces")
    held = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").agg(F.count("*")).collect():
        held[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(plan_packing(held, window))
    # n pieces of one length are ordered in about sqrt(n) groups of sqrt(n)
    groups = F.get(F.array(*(F.lit(int(n)) for n in np.ceil(np.sqrt(held)))), F.col("length").cast("int"))
    cut = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), groups))
    counts = cut.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("r", F.row_number().over(inner)).join(first, ["length", "g"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("r") - 1).drop("first", "r", "g")
    return ranked.mapInArrow(lambda it: _place(it, shared.value), f"{fields}, sequence_id long, offset long")
