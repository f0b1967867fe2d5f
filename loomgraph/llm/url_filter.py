"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And) over canonical URLs.

All rules become one automaton: a glob is a chain of positions, the chains are packed into 64-bit
words, and a step for one character is a shift, an and with the character's mask, and an or with
the positions that a wildcard lets stand. All URLs of a batch step together, so a batch costs the
length of its longest URL times the number of words, however many rules there are.

The canonical URL is ``.`` + host + path. Host: after the first ``://`` up to ``/``, ``?``, ``#``
or the end, with A to Z lower-cased; path: from there up to ``?``, ``#`` or the end.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and
gets the default verdict. Of several rules that fit, the longest wins, then the first given. Rows
are judged one by one, so repeated rows and null ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wildcards of the rule language: ``**`` any run, ``*`` any run without a slash, ``?`` one character.
ANY_RUN, HOST_RUN, ONE = "**", "*", "?"
DEFAULT = "allow"

# The rules (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_glob(rule: str) -> str:
    """The glob of a host and path rule over the canonical URL: any subdomain, any longer path."""
    return f"{HOST_RUN}.{rule}{ANY_RUN}"


@dataclass(frozen=True)
class GlobAutomaton:
    """Shift-And over several globs; ``words`` uint64 words hold all positions."""

    alphabet: np.ndarray  # code points that occur in the globs, sorted
    masks: np.ndarray  # (letters + 1, words): positions that accept the letter; the last row is any other character
    loops: np.ndarray  # (letters + 1, words): positions that a run lets stand on the letter
    start: np.ndarray  # states before the first character
    clear: np.ndarray  # all but each glob's first position: stops the shift from one glob into the next
    finals: list[tuple[int, int]]  # (word, bit) of each glob

    @staticmethod
    def build(globs: list[str]) -> GlobAutomaton:
        parsed = [_tokens(g) for g in globs]
        letters = sorted({ord(c) for g in parsed for c, _ in g if c is not None and len(c) == 1} | {ord("/")})
        at, total = {c: i for i, c in enumerate(letters)}, sum(len(g) + 1 for g in parsed)
        words = (total + 63) // 64
        masks, loops = np.zeros((len(letters) + 1, words), np.uint64), np.zeros((len(letters) + 1, words), np.uint64)
        start, clear = np.zeros(words, np.uint64), np.full(words, ~np.uint64(0))
        finals, p = [], 0
        bit = lambda i: np.uint64(1) << np.uint64(i & 63)
        for glob in parsed:
            start[p >> 6] |= bit(p)
            clear[p >> 6] &= ~bit(p)
            for c, run in [*glob, (None, "")]:
                # a state's runs: characters on which it may stand still
                if run:
                    for i in range(len(letters) + 1):
                        if run == ANY_RUN or i == len(letters) or letters[i] != ord("/"):
                            loops[i, p >> 6] |= bit(p)
                if c is None:
                    continue
                p += 1
                for i in range(len(letters) + 1) if c == "any" else [at[ord(c)]]:
                    masks[i, p >> 6] |= bit(p)
            tail = _tail(globs[len(finals)])
            if tail:
                for i in range(len(letters) + 1):
                    if tail == ANY_RUN or i == len(letters) or letters[i] != ord("/"):
                        loops[i, p >> 6] |= bit(p)
            finals.append((p >> 6, p & 63))
            p += 1
        return GlobAutomaton(np.array(letters, np.uint32), masks, loops, start, clear, finals)

    def match(self, texts: list[str]) -> np.ndarray:
        """(texts, globs) bool: the glob fits the whole text."""
        n, words = len(texts), len(self.start)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        spot = np.searchsorted(self.alphabet, points)
        known = (spot < len(self.alphabet)) & (self.alphabet[np.minimum(spot, len(self.alphabet) - 1)] == points)
        codes = np.where(known, spot, len(self.alphabet))
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.start, (n, 1))
        for t, m in enumerate(np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")):
            code, now = codes[begins[:m] + t], state[:m]
            moved = now << np.uint64(1)
            if words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.clear & self.masks[code]) | (now & self.loops[code])
        hits = np.empty((n, len(self.finals)), bool)
        for g, (w, b) in enumerate(self.finals):
            hits[order, g] = (state[:, w] >> np.uint64(b)) & np.uint64(1) == 1
        return hits


def _tokens(glob: str) -> list[tuple[str | None, str]]:
    """(character or "any", the run before it) for each character of a glob."""
    out, run, i = [], "", 0
    while i < len(glob):
        if glob.startswith(ANY_RUN, i):
            run, i = ANY_RUN, i + 2
        elif glob[i] == HOST_RUN:
            run, i = run or HOST_RUN, i + 1
        else:
            out.append(("any" if glob[i] == ONE else glob[i], run))
            run, i = "", i + 1
    return out


def _tail(glob: str) -> str:
    return ANY_RUN if glob.endswith(ANY_RUN) else HOST_RUN if glob.endswith(HOST_RUN) else ""


def _judge(batches: Iterator[pa.RecordBatch], automaton: GlobAutomaton, rules: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    for batch in batches:
        hits = automaton.match(["." + h + p for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())])
        best = np.full(batch.num_rows, -1)
        for i in reversed(rank):
            best[hits[:, i]] = i
        rule = pa.array([rules[i][1] if i >= 0 else None for i in best], pa.string())
        verdict = pa.array([rules[i][0] if i >= 0 else DEFAULT for i in best], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every URL."""
    automaton = GlobAutomaton.build([rule_glob(r) for _, r in rules])
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return parts.mapInArrow(lambda batches: _judge(batches, automaton, rules), schema)


#: The same verdicts in DuckDB, rule by rule.
FILTER_SQL = f"""
WITH parts AS (
  SELECT page_id, position('://' IN coalesce(url, '')) AS k, coalesce(url, '') AS url FROM pages),
split AS (SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM parts),
hosted AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(verdict, rule, host_part, path_part) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
fits AS (
  SELECT h.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM hosted h JOIN rules r ON (h.host = r.host_part OR ends_with(h.host, '.' || r.host_part)) AND starts_with(h.path, r.path_part) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, '{DEFAULT}') AS verdict FROM hosted h LEFT JOIN fits f USING (page_id)
"""
