"""Quality rules with suffix-array repetition (operator 3).

The alphabet of the suffix array is the word.  Per block of documents the words
are hashed, suffixes are sorted by prefix doubling over those still tied, and
the ranks of each doubling round give the longest common prefix of neighbours
by binary lifting.  A suffix's longest repeat is the depth of the deepest
longest-common-prefix interval that holds it, so the union of the spans that
start at each suffix and run that long is the union of all maximal repeated
substrings of the document.  No repeat crosses documents: words are hashed
together with the document they stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import (
    IS_CHAR_START,
    IS_SPACE,
    IS_SYMBOL,
    Block,
    SpanHash,
    blocks,
    bound_batches,
    mix,
    read_table,
    run_starts,
    text_function,
)

#: Words of a window that counts as repeated.
WINDOW = 8
#: Fewest words of a repeat that counts as covered, so that short phrases said over and over go too.
SHORT = 3
#: Fewest words of a document.
MIN_WORDS = 20
#: Percent of words in repeated windows that a document may hold.
MAX_REPEAT_PERCENT = 30
#: Percent of characters that repeats of at least SHORT words may cover.
MAX_COVERED_PERCENT = 35
#: Words that the longest repeat may have.
MAX_LONGEST = 100

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_chars long, longest_repeat long"
)


def suffix_levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of `symbols` and, for k = 1, 2, 4..., the rank of each suffix by its first k symbols.

    Equal ranks mean equal prefixes.  Only suffixes that are still tied are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    keys = symbols[order]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)  # a rank for each doubling is kept
    first = run_starts(keys)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels = [rank]
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    k = 1
    while len(tied):
        at = order[tied]
        after = at + k
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        key = rank[at].astype(np.int64) * (n + 1) + follow + 1
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        key = key[by]
        first = run_starts(key)
        new = np.maximum.accumulate(np.where(first, tied, 0))
        rank = rank.copy()
        rank[order[tied]] = new
        levels.append(rank)
        tied = tied[~(first & np.append(first[1:], True))]
        k *= 2
    return order, levels


def longest_repeats(symbols: np.ndarray, least: int = 1) -> np.ndarray:
    """For each position the length of the longest substring that starts there and occurs elsewhere too; under `least`: 0."""
    n = len(symbols)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order, levels = suffix_levels(symbols)
    left, right = order[:-1], order[1:]
    close = np.arange(n - 1)
    top = int(least).bit_length() - 1
    if top < len(levels):
        close = close[levels[top][left] == levels[top][right]]
    else:
        return longest
    a, b = left[close].copy(), right[close].copy()
    common = np.zeros(len(close), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[levels[j][a[inside]] == levels[j][b[inside]]]
        a[same] += 1 << j
        b[same] += 1 << j
        common[same] += 1 << j
    common[common < least] = 0
    np.maximum.at(longest, left[close], common)
    np.maximum.at(longest, right[close], common)
    return longest


def covered(longest: np.ndarray) -> np.ndarray:
    """Flags the positions that any span [i, i + longest[i]) holds."""
    n = len(longest)
    reach = np.maximum.accumulate(np.arange(n) + longest) if n else longest
    return reach > np.arange(n)


def measure(block: Block, short: int = SHORT) -> dict[str, np.ndarray]:
    """Measures of each text of a block; covered_chars are the characters in repeats of `short` words and more."""
    data, n = block.data, block.n
    starts, ends = block.words()
    doc = block.doc_of(starts)
    spans = SpanHash(data)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    symbols = (mix(spans.of(starts, ends) ^ salt[doc]) >> np.uint64(1)).astype(np.int64)
    longest = longest_repeats(symbols, min(short, WINDOW))
    inside, near = (covered(np.where(longest >= least, longest, 0)) for least in (WINDOW, short))
    chars = np.concatenate([[0], np.cumsum(IS_CHAR_START[data], dtype=np.int64)])
    size = chars[ends] - chars[starts]
    a, b, line_doc = block.lines()
    blank = np.concatenate([[0], np.cumsum(~IS_SPACE[data], dtype=np.int64)])
    full = blank[b] > blank[a]
    lines = mix(spans.of(a[full], b[full]) ^ salt[line_doc[full]])
    _, at = np.unique(lines, return_index=True)
    count = lambda x: np.bincount(x, minlength=n)[:n]
    total = lambda x, by: np.bincount(by, weights=x, minlength=n)[:n].astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, longest)
    return {
        "n_words": count(doc),
        "word_chars": total(size, doc),
        "n_symbols": block.count(IS_SYMBOL[data]),
        "n_dup_lines": count(line_doc[full]) - count(line_doc[full][at]),
        "n_repeat_words": count(doc[inside]),
        "covered_chars": total(size[near], doc[near]),
        "longest_repeat": most,
    }


def measured(texts: pa.Array, short: int = SHORT) -> list[pa.Array]:
    """The measures of texts, in the order of MEASURES."""
    parts = [measure(b, short) for b in blocks(texts)]
    names = [f.split()[0] for f in MEASURES.split(", ")]
    return [pa.array(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]), pa.int64()) for k in names]


def measures(df: DataFrame, text_col: str = "text", short: int = SHORT) -> F.Column:
    """A struct of the measures of each text of `df`."""
    bound_batches(df.sparkSession)
    return text_function(lambda texts: measured(texts, short), MEASURES, F.col(f"`{text_col}`"))


def verdict(
    of: F.Column,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
) -> tuple[F.Column, F.Column]:
    """(base_failed, kept) over a struct of measures()."""
    failed = (of["n_words"] < min_words) | (100 * of["n_repeat_words"] > max_repeat_percent * of["n_words"])
    fine = (100 * of["covered_chars"] <= max_covered_percent * of["word_chars"]) & (of["longest_repeat"] <= max_longest)
    return failed, ~failed & fine


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, **limits: int) -> DataFrame:
    """One row per row of `df` with the base measures, base_failed and kept.

    The base rule counts windows of WINDOW words; the verdict goes by all maximal
    repeats of `short` words and more and by the longest repeat.
    A null or empty text has no words, so it fails.  Repeated rows are judged each
    on its own; a null id stays null; an empty table gives no rows.  Other columns
    are not read.
    """
    of = F.col("of")
    failed, kept = verdict(of, **limits)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), measures(df, text_col, short).alias("of")).select(
        "doc_id", *[of[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), kept.alias("kept"), of["covered_chars"].alias("covered_chars"), of["longest_repeat"].alias("longest_repeat"),
    )


def keep_good(df: DataFrame, text_col: str = "text", short: int = SHORT, **limits: int) -> DataFrame:
    """The rows of `df` whose text passes quality_rules(), with the columns that `df` has.

    A null or empty text goes, as it has too few words.  Equal rows stay or go together,
    an empty table stays empty, and columns of any other names pass through.
    """
    _, kept = verdict(F.col("\x00of"), **limits)
    return df.withColumn("\x00of", measures(df, text_col, short)).filter(kept).select(*[F.col(f"`{c}`") for c in df.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).drop("covered_chars", "longest_repeat")


#: The measures in SQL: a repeat of over MAX_LONGEST words is a repeated window of one word more.
OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), pos AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d
), word AS (
  SELECT r, i, w[i] AS word,
         CASE WHEN i + {WINDOW - 1} <= len(w) THEN hash(w[i:i + {WINDOW - 1}]) END AS g8,
         CASE WHEN i + {SHORT - 1} <= len(w) THEN hash(w[i:i + {SHORT - 1}]) END AS g_short,
         CASE WHEN i + {MAX_LONGEST} <= len(w) THEN hash(w[i:i + {MAX_LONGEST}]) END AS g_long
  FROM pos
), tied AS (
  SELECT r, i, length(word) AS size,
         CASE WHEN g8 IS NOT NULL AND count(*) OVER (PARTITION BY r, g8) > 1 THEN i END AS hit,
         CASE WHEN g_short IS NOT NULL AND count(*) OVER (PARTITION BY r, g_short) > 1 THEN i END AS short_hit,
         CASE WHEN g_long IS NOT NULL AND count(*) OVER (PARTITION BY r, g_long) > 1 THEN 1 ELSE 0 END AS too_long
  FROM word
), spread AS (
  SELECT r, size, too_long,
         max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS inside,
         max(short_hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {SHORT - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS near
  FROM tied
), m AS (
  SELECT r, count(*) AS n_words, sum(size) AS word_chars, count(*) FILTER (inside) AS n_repeat_words,
         coalesce(sum(size) FILTER (near), 0) AS covered_chars, max(too_long) AS too_long
  FROM spread GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), all_of AS (
  SELECT d.doc_id, coalesce(m.n_words, 0) AS n_words, coalesce(m.word_chars, 0) AS word_chars,
         length(coalesce(d.text, '')) - length(regexp_replace(coalesce(d.text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(m.n_repeat_words, 0) AS n_repeat_words,
         coalesce(m.covered_chars, 0) AS covered_chars, coalesce(m.too_long, 0) AS too_long
  FROM d LEFT JOIN m USING (r) LEFT JOIN dup USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * covered_chars <= {MAX_COVERED_PERCENT} * word_chars AND too_long = 0 AS kept
FROM all_of
"""
