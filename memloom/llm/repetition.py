"""Quality rules by repetition coverage.

Per text, in numpy: rolling hashes of word n-grams of several lengths find the windows
that stand in the text twice or more; what counts is the share of the words' characters
that such windows cover, and the share of characters in repeated lines.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import SPACES, bounded_chunks, map_rows, table
from memloom.llm.rolling import window_hashes

#: Word n-gram length -> largest share of word characters in duplicated n-grams.
GRAM_SHARES = {5: 0.15, 7: 0.13, 10: 0.10}
#: Largest share of characters in lines that equal an earlier line.
LINE_SHARE = 0.30
#: Base rules of the contract: fewest words, window, percentage of words in repeated windows.
LEAST_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"
_HAS_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]")
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(ids: np.ndarray, width: int) -> np.ndarray:
    """Mask of the words in windows of `width` words that occur twice or more; the first counts."""
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    h = window_hashes(ids, width)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + width, -1)
    return np.cumsum(covered[:-1]) > 0


def measure(text: str) -> tuple[list[int], dict[int, int], int]:
    """(_MEASURES, covered characters by n-gram length, characters in repeated lines)."""
    words = text.encode("utf-8", errors="surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup_lines = dup_chars = 0
    for line, k in Counter(text.split("\n")).items():
        if k > 1 and _HAS_WORD.search(line):
            dup_lines += k - 1
            dup_chars += (k - 1) * len(line)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    chars = np.array([len(w.decode("utf-8", errors="surrogatepass")) for w in known], dtype=np.int64)
    chars = chars[ids] if n else np.zeros(0, dtype=np.int64)
    base = _repeated(ids, BASE_WINDOW)
    covered = {k: int(chars[base if k == BASE_WINDOW else _repeated(ids, k)].sum()) for k in GRAM_SHARES}
    return [n, word_chars, symbols, dup_lines, int(base.sum())], covered, dup_chars


def verdict(n_words: int, word_chars: int, n_repeat: int, covered: dict[int, int], dup_chars: int, chars: int) -> tuple[bool, bool, float]:
    """(base_failed, kept, largest share of characters in duplicated n-grams)."""
    failed = n_words < LEAST_WORDS or 100 * n_repeat > BASE_PERCENT * n_words
    shares = {k: c / word_chars if word_chars else 0.0 for k, c in covered.items()}
    fine = all(shares[k] <= most for k, most in GRAM_SHARES.items()) and dup_chars <= LINE_SHARE * max(1, chars)
    return failed, not failed and fine, max(shares.values())


def repetition_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_gram_share, dup_line_chars,
    base_failed, kept) for every row.

    Null and empty texts have no word and fail. Whole texts are measured, one at a time.
    Repeated rows fare alike. Empty table: empty result.
    """

    def prepare():
        def measured(t):
            base, covered, dup_chars = measure(t)
            failed, kept, share = verdict(base[0], base[1], base[4], covered, dup_chars, len(t))
            return (*base, share, dup_chars, failed, kept)

        return lambda rows: ([measured(t) for t in part] for _, part in bounded_chunks([t or "" for t in rows["t"]]))

    longs = ", ".join(f"{m} long" for m in _MEASURES)
    return map_rows(docs, key, {"t": F.col(text)}, f"{longs}, dup_gram_share double, dup_line_chars long, base_failed boolean, kept boolean", prepare)


def op6_repetition(spark, sf_dir: str) -> DataFrame:
    """Every document with its measures, base_failed and kept."""
    found = repetition_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_MEASURES, "base_failed", "kept")


def _gram(k: int) -> str:
    words = ", ".join(f"LEAD(w, {i}) OVER o" for i in range(k))
    return f"CASE WHEN LEAD(w, {k - 1}) OVER o IS NOT NULL THEN concat_ws(' ', {words}) END AS g{k}"


def _covered(k: int) -> str:
    return f"COALESCE(MAX(t{k}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), FALSE) AS c{k}"


#: Windows over words in place of rolling hashes.
OP6_SQL = rf"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents
), w AS (
  SELECT rid, u.w, u.i FROM d, LATERAL (
    SELECT UNNEST(ws) AS w, UNNEST(range(len(ws))) AS i FROM (SELECT regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS ws)
  ) u
), g AS (
  SELECT rid, w, i, {", ".join(_gram(k) for k in GRAM_SHARES)} FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), t AS (
  SELECT rid, w, i, {", ".join(f"g{k} IS NOT NULL AND COUNT(*) OVER (PARTITION BY rid, g{k}) > 1 AS t{k}" for k in GRAM_SHARES)} FROM g
), c AS (
  SELECT rid, w, {", ".join(_covered(k) for k in GRAM_SHARES)} FROM t
), s AS (
  SELECT rid, COUNT(*) AS n_words, SUM(length(w)) AS word_chars, COUNT(*) FILTER (WHERE c5) AS n_repeat_words,
         {", ".join(f"COALESCE(SUM(length(w)) FILTER (WHERE c{k}), 0) AS s{k}" for k in GRAM_SHARES)}
  FROM c GROUP BY rid
), l AS (
  SELECT rid, SUM(n - 1) AS n_dup_lines, SUM((n - 1) * length(line)) AS dup_chars FROM (
    SELECT rid, line, COUNT(*) AS n FROM (SELECT rid, UNNEST(string_split(text, chr(10))) AS line FROM d) GROUP BY rid, line
  ) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, length(text) AS chars, COALESCE(n_words, 0) AS n_words, COALESCE(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         COALESCE(n_dup_lines, 0) AS n_dup_lines, COALESCE(n_repeat_words, 0) AS n_repeat_words,
         COALESCE(dup_chars, 0) AS dup_chars, {", ".join(f"COALESCE(s{k}, 0) AS s{k}" for k in GRAM_SHARES)}
  FROM d LEFT JOIN s USING (rid) LEFT JOIN l USING (rid)
), f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, {", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in _MEASURES)}, base_failed,
       NOT base_failed AND dup_chars <= {LINE_SHARE} * GREATEST(chars, 1)
       AND {" AND ".join(f"s{k} / CAST(word_chars AS DOUBLE) <= {most}" for k, most in GRAM_SHARES.items())} AS kept
FROM f
"""
