"""Words and their fingerprints, vectorised over Arrow batches.

A word is a maximal run outside U+0020 and U+0009 to U+000D; a null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators as a regular expression of Java, DuckDB and Python alike.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
PASS_BYTES = 4 << 20

U = np.uint64


def word_column(text: Column) -> Column:
    """The words of ``text`` as an array, without user functions."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """The number of words of ``text``, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def passes(batch: pa.RecordBatch, column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes, whole rows each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, beside others and the executor's heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the offsets of each text's words."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
        counts = np.where(empty, 0, counts)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def hash_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint for each word, the same on every machine."""
    if len(flat) == 0:
        return np.zeros(0, U)
    coded = flat.dictionary_encode()
    table = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Fingerprint of the pair (a, b), element by element; the order matters."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> U(32))) * U(0x9E3779B97F4A7C15) + (b if isinstance(b, np.ndarray) else U(b)) * U(0xC2B2AE3D27D4EB4F)
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(32)
    return x


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the ``n`` consecutive symbols that start at each place of ``h`` (len(h) - n + 1 of them).

    Built by doubling, so each place costs about 2 log n steps.
    """
    if len(h) < n:
        return np.zeros(0, U)
    out, done, power, width = None, 0, h, 1
    while True:
        if n & width:
            out = power if out is None else mix(out[: len(h) - done - width + 1], power[done : len(h) - width + 1])
            done += width
        if done == n:
            return out[: len(h) - n + 1]
        power = mix(power[: len(power) - width], power[width:])
        width *= 2


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
