"""Substring dedup by recompression: equal word sequences get equal interior symbols.

A text's words are named by fingerprints. Rounds then name runs of a token and pairs of neighbours
(a left one followed by a right one, by a bit of the name), so a symbol depends on its own words
only, and names agree globally without an exchange. What the surroundings can change is bounded:
a run or a pair that reaches over the edge of a passage. With the rounds used here that is
``EDGE`` words at each end, so two equal windows of 50 words share all symbols of their middle.

A high-level symbol, taken with its followers up to ``GRAM`` words, gets a name of its symbols. Each
window goes by one of them: the least name among those that start in ``SPAN`` words of its middle.
Equal windows go by equal names, so a window can repeat only if the name it goes by stands in
several documents. Spark finds those names by a partial minimum and maximum of ids. Neighbouring
windows that go by one place form a block, a symbol of 50 to 70 words that has a name of 96 bits over
all of them: a later document's block of the same name repeats all its windows at once, however many
documents have the passage. What is left are blocks at a passage's ends, where a name goes with
several blocks; the windows of each block's first document are compared one by one.

Whole documents that are equal are found by a digest of all their words and give no windows. Words,
windows and documents are compared by 64, 96 and 96 bits; an equality of these counts as equality.

Defined results: a null text has no words; rows with a null doc_id are neither compared nor changed;
rows that repeat an id are compared with smaller ids only, never with each other. A document
shorter than a window keeps its words. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import U, gram_hashes, hash_words, mix, passes, signed, words_of
from loomgraph.plans.scratch import Scratch

WINDOW = 50
#: Most words of a run that is named, and the rounds of pairs after it.
RUN_WORDS = 2
PAIR_ROUNDS = 2
#: Words of the longest symbol, and words at an end of a window that its surroundings can change:
#: what is inside of a run, then one symbol a round of pairs.
LONGEST = RUN_WORDS << PAIR_ROUNDS
EDGE = RUN_WORDS + sum(RUN_WORDS << r for r in range(PAIR_ROUNDS))
#: Least words of an anchor; it has at most GRAM - 1 + LONGEST.
GRAM = 6
#: Starts that an anchor is the least of: all of them have their anchor inside of the middle.
SPAN = WINDOW - 2 * EDGE - (GRAM - 1 + LONGEST)
NONE = ~U(0)
#: Bytes of text of one pass: a worker holds about forty numbers a word.
PASS_BYTES = 1 << 20


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from passes(batch, limit=PASS_BYTES)


def _merge(symbols: np.ndarray, widths: np.ndarray, joins: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each place of ``joins`` and its follower by one symbol of the given name."""
    symbols, widths = symbols.copy(), widths.copy()
    symbols[joins] = names
    widths[joins] += widths[joins + 1]
    kept = np.ones(len(symbols), bool)
    kept[joins + 1] = False
    return symbols[kept], widths[kept]


def recompress(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the high-level symbols and the word that each starts at; no symbol crosses a document."""
    symbols, widths = h, np.ones(len(h), np.int64)
    first = np.zeros(len(h) + 1, bool)
    first[offsets] = True  # words where a document starts, and the end
    start = np.arange(len(h))
    # runs: of exactly two equal words, as longer runs aren't named
    same = (symbols[1:] == symbols[:-1]) & ~first[1:-1]
    twice = same & ~np.concatenate([[False], same[:-1]]) & ~np.concatenate([same[1:], [False]]) if len(same) else same
    at = np.flatnonzero(twice)
    symbols, widths = _merge(symbols, widths, at, mix(symbols[at], 2))
    for r in range(PAIR_ROUNDS):
        start = np.cumsum(widths) - widths
        left = (mix(symbols, 100 + r) & U(1)) == 0
        at = np.flatnonzero(left[:-1] & ~left[1:] & ~first[start[1:]])
        symbols, widths = _merge(symbols, widths, at, mix(symbols[at], mix(symbols[at + 1], r + 3)))
    return symbols, np.cumsum(widths) - widths


def _least(values: np.ndarray, span: int, function) -> np.ndarray:
    """``function`` over each ``span`` consecutive values, by doubling (len(values) - span + 1 of them)."""
    out, width = values, 1
    while 2 * width <= span:
        out = function(out[: len(out) - width], out[width:])
        width *= 2
    rest = span - width
    return function(out[: len(out) - rest], out[rest:]) if rest else out


def symbol_names(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word the name of the high-level symbol that starts there, NONE where none does."""
    symbols, start = recompress(h, offsets)
    bounds = np.append(start, len(h))
    end = np.searchsorted(bounds, start + GRAM)  # the first symbol boundary at GRAM words or more
    last_word = offsets[np.searchsorted(offsets, start, side="right")]
    good = (end < len(bounds)) & (bounds[np.minimum(end, len(bounds) - 1)] <= last_word)
    at, end = np.flatnonzero(good), end[good]
    names = np.full(len(at), U(7))
    for j in range(GRAM):  # a symbol is of one word or more
        more = at + j < end
        names[more] = mix(names[more], symbols[at[more] + j])
    field = np.full(len(h), NONE)
    field[start[at]] = names
    return field


def window_starts(offsets: np.ndarray) -> np.ndarray:
    """Whether a window starts at each word."""
    at = np.arange(int(offsets[-1]))
    return at + WINDOW <= np.repeat(offsets[1:], np.diff(offsets))


def window_anchors(field: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The name that each window goes by, which is the least in its middle; NONE where no window starts."""
    padded = np.concatenate([field, np.full(EDGE + SPAN, NONE)])
    lows = _least(padded, SPAN, np.minimum)[EDGE : EDGE + len(field)]
    return np.where(starts, lows, NONE)


def anchors(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, name) of the symbols that some window goes by."""
    field = symbol_names(h, offsets)
    named = window_anchors(field, window_starts(offsets))
    # the greatest name among the windows that have the place in their middle
    padded = np.concatenate([np.zeros(EDGE + SPAN - 1, U), np.where(named == NONE, U(0), named)])
    best = _least(padded, SPAN, np.maximum)[: len(field)]
    chosen = np.flatnonzero((best == field) & (field != NONE))
    return chosen, field[chosen]


def _document_names(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A digest of each document's whole word sequence: 64 bits as uint64 and 32 as int32."""
    data = memoryview(np.ascontiguousarray(h)).cast("B")
    cuts = (8 * offsets).tolist()
    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:]))
    both = np.frombuffer(digests, U).reshape(-1, 2)
    return both[:, 0], (both[:, 1] >> U(32)).astype(np.uint32).view(np.int32)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k, doc_id, at): the anchors (k 0), and for each document its own name with at -1."""
    for part in _passes(batches):
        flat, offsets = words_of(part.column("text"))
        h = hash_words(flat)
        long = np.flatnonzero(np.diff(offsets) >= WINDOW)
        if not len(long):
            continue
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        at, name = anchors(h, offsets)
        doc = np.searchsorted(offsets, at, side="right") - 1
        one, two = _document_names(h, offsets)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(np.concatenate([name, one[long]]))),
                pa.array(np.concatenate([np.zeros(len(at), np.int32), two[long]])),
                pa.array(np.concatenate([ids[doc], ids[long]])),
                pa.array(np.concatenate([at - offsets[doc], np.full(len(long), -1)]).astype(np.int32)),
            ],
            names=["h", "k", "doc_id", "at"],
        )


def _fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the window at each word: 64 as uint64 and 32 as int32."""
    one, two = gram_hashes(h, WINDOW), gram_hashes(mix(h, 17), WINDOW)
    return one, (two >> U(32)).astype(np.uint32).view(np.int32)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, b1, b2, doc_id, k, start, n): n windows one after the other that go by one place of a shared name h.

    They have the words from the first window's start to the last one's end, which both windows
    cover: these two and n name the block, and equal blocks have n equal windows.
    """
    for part in _passes(batches):
        flat, offsets = words_of(part.column("text"))
        h = hash_words(flat)
        if len(h) < WINDOW:
            continue
        _, k = _document_names(h, offsets)
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        shared = np.zeros(len(h), bool)
        starts = window_starts(offsets)
        for i, (places, copies) in enumerate(zip(part.column("_places"), part.column("_copies").to_pylist())):
            low, high = int(offsets[i]), int(offsets[i + 1])
            if k[i] in copies:  # a copy of a whole document needs no windows
                starts[low:high] = False
            else:
                at = low + places.values.to_numpy(zero_copy_only=False).astype(np.int64)
                shared[at[at < high]] = True  # of rows that repeat an id, another text's places may lie beyond
        field = symbol_names(h, offsets)
        named = window_anchors(field, starts)
        going = (named != NONE) & (window_anchors(np.where(shared, field, NONE), starts) == named)
        # windows that go by one place are neighbours, SPAN of them at most; runs of more are equal names at several places
        change = np.ones(len(h), bool)
        change[1:] = (named[1:] != named[:-1]) | (going[1:] != going[:-1])
        cuts = np.append(np.flatnonzero(change), len(h))
        used = going[cuts[:-1]]
        first, last = cuts[:-1][used], cuts[1:][used]
        if not len(first):
            continue
        parts = -(-(last - first) // SPAN)
        begin = np.repeat(first - SPAN * (np.cumsum(parts) - parts), parts) + SPAN * np.arange(parts.sum())
        end = np.minimum(begin + SPAN, np.repeat(last, parts))
        one, two = _fingerprints(h)
        n = (end - begin).astype(np.int32)
        doc = np.searchsorted(offsets, begin, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(named[begin])),
                pa.array(signed(mix(mix(one[begin], one[end - 1]), n.astype(U)))),
                pa.array(mix(two[begin].view(np.uint32).astype(U), two[end - 1].view(np.uint32).astype(U)).astype(np.uint32).view(np.int32)),
                pa.array(ids[doc]),
                pa.array(k[doc]),
                pa.array((begin - offsets[doc]).astype(np.int32)),
                pa.array(n),
            ],
            names=["h", "b1", "b2", "doc_id", "k", "start", "n"],
        )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, k, start) of every window of the blocks in ``_blocks``."""
    for part in _passes(batches):
        flat, offsets = words_of(part.column("text"))
        h = hash_words(flat)
        if len(h) < WINDOW:
            continue
        _, k = _document_names(h, offsets)
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        asked = np.zeros(len(h) + 1, np.int32)
        for i, blocks in enumerate(part.column("_blocks")):
            own = blocks.values
            mine = own.field("k").to_numpy(zero_copy_only=False) == k[i]
            at = offsets[i] + own.field("start").to_numpy(zero_copy_only=False)[mine].astype(np.int64)
            np.add.at(asked, at, 1)
            np.add.at(asked, at + own.field("n").to_numpy(zero_copy_only=False)[mine], -1)
        start = np.flatnonzero(np.cumsum(asked[:-1]) > 0)
        if not len(start):
            continue
        one, two = _fingerprints(h)
        doc = np.searchsorted(offsets, start, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(one[start])), pa.array(two[start]), pa.array(ids[doc]), pa.array(k[doc]), pa.array((start - offsets[doc]).astype(np.int32))],
            names=["h1", "h2", "doc_id", "k", "start"],
        )


def _kept_words(batches: Iterator[pa.RecordBatch], names: list[str], digest: bool) -> Iterator[pa.RecordBatch]:
    for part in _passes(batches):
        marked = part.column("_marked").to_pylist()
        some = [i for i, m in enumerate(marked) if m]
        codes = {}
        if some:
            flat, offsets = words_of(part.column("text").take(pa.array(some)))
            codes = dict(zip(some, _document_names(hash_words(flat), offsets)[1].tolist()))
        n_words, n_removed, results = [], [], []
        for i, text in enumerate(part.column("text").to_pylist()):
            words = (text or "").encode().split()
            gone = 0
            if own := [(m["start"], m["n"]) for m in marked[i] or () if m["k"] == codes[i]]:
                starts, counts = np.array(own, np.int64).T
                if (starts < 0).any():
                    gone, words_kept = len(words), []
                else:
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + counts + (WINDOW - 1), -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    words_kept = list(itertools.compress(words, keep.tolist()))
                    gone = len(words) - len(words_kept)
            else:
                words_kept = words
            joined = b" ".join(words_kept)
            n_words.append(len(words))
            n_removed.append(gone)
            results.append(hashlib.sha256(joined).hexdigest() if digest else text if not gone else joined.decode())
        own = [c for c in part.schema.names if c not in ("text", "_marked")]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(results, pa.string())], names=names)


def _marks(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(_marked_id, _marked): first starts and numbers of the repeated windows of each document that has any, -1 for a whole copy.

    A name's least and greatest id are summed up before they are shuffled and written; occurrences
    then join the written names, a join whose large partitions Spark splits, so that a name which a
    third of the documents share isn't one task's work.
    """
    found = scratch.save(known.select("doc_id", "text").mapInArrow(_anchor_rows, "h long, k int, doc_id long, at int"), "anchors")
    names = found.groupBy("h", "k").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    names = scratch.save(names.drop("most"), "names")
    shared = scratch.save(found.join(names, ["h", "k"]).where("at >= 0 or least < doc_id").select("doc_id", "at", "k"), "shared")
    # rows that repeat an id with another text are told apart by k
    whole = F.col("at") < 0
    places = shared.groupBy("doc_id").agg(F.collect_list(F.when(~whole, F.col("at"))).alias("_places"), F.collect_set(F.when(whole, F.col("k"))).alias("_copies"))
    blocks = known.join(places, "doc_id").mapInArrow(_block_rows, "h long, b1 long, b2 int, doc_id long, k int, start int, n int")
    blocks = scratch.save(blocks, "blocks")

    # all windows of a block are those of the block's first document; only where a name goes with
    # several blocks may a window of a first document be in a smaller one
    heads = scratch.save(blocks.groupBy("h", "b1", "b2").agg(F.min("doc_id").alias("least")), "heads")
    several = scratch.save(heads.groupBy("h").agg(F.count("*").alias("blocks")).where("blocks > 1").select("h", F.lit(True).alias("several")), "several")
    heads = scratch.save(heads.join(several, "h", "left"), "heads")
    placed = blocks.join(heads, ["h", "b1", "b2"]).where("least < doc_id or several")
    placed = scratch.save(placed.select("doc_id", "k", "start", "n", (F.col("least") < F.col("doc_id")).alias("repeated")), "placed")
    asked = placed.where("not repeated").groupBy("doc_id").agg(F.collect_list(F.struct("k", "start", "n")).alias("_blocks"))
    windows = known.join(asked, "doc_id").mapInArrow(_window_rows, "h1 long, h2 int, doc_id long, k int, start int")
    windows = scratch.save(windows, "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    first = scratch.save(first.drop("most"), "first")
    later = windows.join(first, ["h1", "h2"]).where("least < doc_id")

    one = F.lit(1).alias("n")
    copies = shared.where("at < 0").select("doc_id", "k", F.col("at").alias("start"), one)
    marked = placed.where("repeated").drop("repeated").unionByName(later.select("doc_id", "k", "start", one)).unionByName(copies)
    return marked.groupBy(F.col("doc_id").alias("_marked_id")).agg(F.collect_list(F.struct("k", "start", "n")).alias("_marked"))


def _judged(docs: DataFrame, scratch: Scratch, names: list[str], fields: str, digest: bool) -> DataFrame:
    """All rows of ``docs`` (doc_id long, text and more), after ``_kept_words``.

    Where ``docs`` has no other column, windows are cut from, and marks joined to, the same rows in
    the same partitioning: the plan deals out the texts once and reads that exchange twice. Rows
    without an id need neither.
    """
    known = docs.where("doc_id is not null")
    # only the text is dealt out for the windows: other columns would make that exchange larger
    both = known.join(_marks(known.select("doc_id", "text"), scratch), F.col("doc_id") == F.col("_marked_id"), "left").drop("_marked_id")
    rest = docs.where("doc_id is null").withColumn("_marked", F.lit(None).cast(both.schema["_marked"].dataType))
    work = lambda it: _kept_words(it, names, digest)
    return both.mapInArrow(work, fields).unionByName(rest.mapInArrow(work, fields))


def remove_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return _judged(docs, scratch, names, "doc_id long, n_words long, n_removed long, kept_sha256 string", True)


def strip_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; untouched texts stay as they are, other columns too.

    Other columns travel under names that clash with nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(c).cast("long").alias(n) if c == "doc_id" else F.col(c).alias(n) for c, n in names.items()))
    carried = [c for c in docs.columns if c != "text"]
    out = [*(names[c] for c in carried), "n_words", "n_removed", "text"]
    fields = ", ".join([*(f"{names[c]} {'long' if c == 'doc_id' else kinds[c]}" for c in carried), "n_words long, n_removed long, text string"])
    done = _judged(plain, scratch, out, fields, False)
    return done.select(*(F.col(names[c]).cast(kinds[c]).alias(c) for c in docs.columns))


#: The same rows in DuckDB, window by window.
SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM w WHERE len(w) >= {WINDOW}),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS h FROM starts JOIN w USING (doc_id)),
repeated AS (SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, s + unnest(range({WINDOW})) AS i FROM repeated),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t, count(*) AS n FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN kept k USING (doc_id)
"""
