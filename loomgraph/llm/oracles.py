"""DuckDB SQL of the native text operators."""

from loomgraph.llm.quality import STOP_WORDS, THRESHOLDS
from loomgraph.llm.text import WORD

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


def _verdict() -> str:
    tests = []
    for rule in THRESHOLDS:
        value = f"({rule.numerator}::DOUBLE / nullif({rule.denominator}, 0))" if rule.denominator else f"{rule.numerator}::DOUBLE"
        tests += [f"coalesce({value} {op} {float(bound)}, true)" for op, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None]
    return " AND ".join(tests)


QUALITY_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM texts),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split),
windows AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM places),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows),
covered AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS w FROM twice WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT w) AS n FROM covered GROUP BY doc_id),
measures AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(words, lambda w: lower(w) IN ({_STOPS})))::BIGINT AS n_stop_words, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_verdict()}) AS kept FROM judged
"""
