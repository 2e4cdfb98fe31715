"""Ranked lexical search by windowed bucket scoring (operator 12).

The items' terms are hashed and sorted.  One pass over the documents keeps of each
its number of terms and the postings of the items' terms alone; the corpus counts
(documents, terms, documents of each term) are sums over those rows.  The rows then
lie in doc_id order, and a task walks them in windows of WINDOW consecutive
documents.  A window's postings are inverted by term; for one item after another
they are scatter-added into one array of WINDOW 64-bit buckets, small enough for a
core's cache, while a bitset gathers which buckets are occupied.  Occupied buckets
that beat the item's least held score go to its heap of k, and are cleared.  What
leaves a task is k rows an item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import IS_DIGIT, IS_LETTER, LOWERED, SpanHash, blocks, bound_batches, cut, read_table, run_starts

K = 10
#: Documents of a window; its buckets take 64 kB.
WINDOW = 8192
#: (item, term) pairs that are searched for in one pass over the documents; the driver and each task hold them by some 40 bytes.
PASS_TERMS = 500_000
IS_TERM = IS_LETTER | IS_DIGIT


def term_counts(texts: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block: first text, terms of each text, and (text, key, times) of its distinct terms.

    With `known`, sorted keys, only terms among them come, and key is their place.
    """
    for block in blocks(texts):
        data = LOWERED[block.data]
        starts, ends = block.runs(IS_TERM[data])
        doc = block.doc_of(starts)
        n = np.bincount(doc, minlength=block.n)
        key = SpanHash(data).of(starts, ends)
        if known is not None:
            place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            found = known[place] == key if len(known) else np.zeros(len(key), bool)
            doc, key = doc[found], place[found]
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        at = np.flatnonzero(run_starts(doc) | run_starts(key))
        yield block.first, n, doc[at], key[at], np.diff(np.append(at, len(doc)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, key, times): the terms of each row of `items`, which gets a number."""
    bound_batches(items.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, doc, key, times in term_counts(b.column(2)):
                at = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(key.view(np.int64)), pa.array(times)], ["item", "item_id", "key", "times"])

    rows = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")))
    return rows.mapInArrow(made, "item long, item_id long, key long, times long")


def posting_rows(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term; terms are places among the `known` keys, a broadcast array."""
    bound_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, doc, place, tf in term_counts(b.column(1), known.value):
                some = np.flatnonzero(n)
                offsets = pa.array(np.searchsorted(doc, np.append(some, len(n))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (place.astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some + first)), pa.array(n[some]), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(made, "doc_id long, n long, terms array<int>, tf array<long>")


@dataclass
class Queries:
    """The items of one pass: of item i the terms place[bounds[i]:bounds[i + 1]], each with its weight times its repeats."""

    ids: list[int | None]
    rows: np.ndarray
    bounds: np.ndarray
    place: np.ndarray
    weight: np.ndarray
    documents: int
    terms: int


class Buckets:
    """Scores of one window of documents, an item at a time."""

    def __init__(self, n: np.ndarray, row: np.ndarray, place: np.ndarray, tf: np.ndarray, documents: int, terms: int):
        self.size = len(n)
        order = np.argsort(place, kind="stable")
        row, place, tf = row[order], place[order], tf[order]
        m = 25 + (75 * n * documents) // terms
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        at = np.flatnonzero(run_starts(place))
        self.held = place[at]
        self.lists = [(row[a:b], gain[a:b]) for a, b in zip(at, np.append(at, len(place))[1:], strict=True)]
        self.bits: list[np.ndarray | None] = [None] * len(at)
        self.score = np.zeros(self.size, np.int64)

    def _occupied(self, j: int) -> np.ndarray:
        if self.bits[j] is None:
            flags = np.zeros(self.size, bool)
            flags[self.lists[j][0]] = True
            self.bits[j] = np.packbits(flags)
        return self.bits[j]

    def harvest(self, place: np.ndarray, weight: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, score) of the k best documents with a score over `least`, earlier ones first among equals."""
        j = np.searchsorted(self.held, place)
        there = np.flatnonzero(self.held[np.minimum(j, len(self.held) - 1)] == place) if len(self.held) else []
        bits = np.zeros(-(-self.size // 8), np.uint8)
        for t in there:
            rows, gain = self.lists[j[t]]
            self.score[rows] += weight[t] * gain
            bits |= self._occupied(j[t])
        bucket = np.flatnonzero(np.unpackbits(bits, count=self.size))
        score = self.score[bucket]
        self.score[bucket] = 0
        over = score > least
        bucket, score = bucket[over], score[over]
        if len(score) > k:
            enough = score >= np.partition(score, len(score) - k)[len(score) - k]
            bucket, score = bucket[enough], score[enough]
        best = np.lexsort((bucket, -score))[:k]
        return bucket[best], score[best]


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of `size` consecutive rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - rows)
            held.append(part)
            rows += part.num_rows
            b = b.slice(part.num_rows)
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scored(asked, k: int, window: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = asked.value
        heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in q.ids]
        before = 0
        for t in _windows(batches, window):
            ids, n = t.column("doc_id"), t.column("n").to_numpy()
            lists = t.column("terms").combine_chunks()
            row = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
            tf = t.column("tf").combine_chunks().flatten().to_numpy()
            made = Buckets(n, row, lists.flatten().to_numpy(), tf, q.documents, q.terms)
            for i, heap in enumerate(heaps):
                a, b = q.bounds[i], q.bounds[i + 1]
                bucket, scores = made.harvest(q.place[a:b], q.weight[a:b], heap[0][0] if len(heap) == k else 0, k)
                for d, s in zip(bucket.tolist(), scores.tolist(), strict=True):
                    entry = (s, -(before + d), ids[d].as_py())  # places differ, so ids are never compared
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            before += t.num_rows
        found = [(int(q.rows[i]), q.ids[i], d, s) for i, heap in enumerate(heaps) for s, _, d in heap]
        columns = zip(*found, strict=True) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return score


def _ranked_pass(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, item_id, doc_id, score): some best documents for the items of `wanted`, k of each task at most."""
    spark = docs.sparkSession
    t = wanted.orderBy("item", "key").toArrow()  # about PASS_TERMS rows
    item, key = t.column("item").to_numpy(), t.column("key").to_numpy().view(np.uint64)
    known = np.unique(key)
    posts = cut(posting_rows(docs, spark.sparkContext.broadcast(known), id_col, text_col))
    total = posts.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(known), np.int64)
    for r in posts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each of the known keys at most
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    first = np.flatnonzero(run_starts(item))
    place = np.searchsorted(known, key)
    asked = Queries(
        t.column("item_id").take(pa.array(first)).to_pylist(), item[first], np.append(first, len(item)), place,
        weight[place] * t.column("times").to_numpy(), total["documents"], total["terms"] or 1,
    )
    lying = posts.withColumn("apart", F.rand(5)).repartitionByRange("doc_id", "apart")  # an id may have any number of rows
    lying = lying.sortWithinPartitions(F.asc_nulls_last("doc_id")).drop("apart")
    return lying.mapInArrow(_scored(spark.sparkContext.broadcast(asked), k, window), "item long, item_id long, doc_id long, score long")


def ranked(
    items: DataFrame, docs: DataFrame, k: int = K, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, pass_terms: int = PASS_TERMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0.

    Every row of `items` is an item, equal rows and those of one id too, and gets its
    own list; a null or empty text has no terms and no list.  Every row of `docs` is a
    document; a null id comes after all others among equal scores, a text without terms
    counts nowhere.  Equal scores go by ascending doc_id, repeated rows rank as often as
    they come.  Empty tables give no rows; other columns are not read.  Items are
    searched for in passes of about `pass_terms` terms, dealt by a hash of their number.
    """
    terms = cut(item_terms(items, item_col, "text"))
    passes = max(1, -(-terms.count() // pass_terms))
    found: DataFrame | None = None
    for p in range(passes):
        wanted = terms.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        some = _ranked_pass(docs, wanted, k, id_col, text_col, window)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = rf"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, {_TERMS.format(text="text")} AS t FROM documents
), docs AS MATERIALIZED (SELECT d, doc_id, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0),
posts AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM words) GROUP BY ALL),
total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM docs),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM posts, total GROUP BY term
), items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS.format(text="text")} AS t FROM benchmark),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
scored AS (
  SELECT i, item_id, doc_id, d,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * documents) // terms))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN posts USING (term) JOIN docs USING (d), total
  GROUP BY i, item_id, doc_id, d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= {K}
"""
