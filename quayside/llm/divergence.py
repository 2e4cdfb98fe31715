"""Divergence of sources from each other and from their language, by mergeable radix tries (operator 13).

A partition counts the terms of its documents in byte tries, one a language, whose
leaves carry a counter of occurrences and documents for every source.  A trie is
kept in the order of its walk: of each leaf, at how many bytes the walk turned off
the path to the leaf before, and the label below that node.  Tries are cut where
their paths differ in the first bytes, and the parts of all partitions meet by range
of prefix; there they merge into one trie as they come, so a task holds the distinct
terms of a prefix, not the parts.  Prefixes with very many leaves are cut deeper
first.  Merged leaves in too few documents go.  The walk of the rest, in UTF-8 order,
streams the sums of all pairs of sources and each group's best terms, earlier leaves
first among equals.  A pair's sum is made of the leaves that one of the two holds;
all other leaves give the same value, which is multiplied by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import IS_LETTER, LOWERED, SpanHash, blocks, bound_batches, cut, read_table, run_starts

LEAST_DOCS = 10
BEST = 10
SCALE = 1_000_000_000
#: Bytes by which a trie is cut before it is sent.
PREFIX = 3
#: A prefix with more leaves than this over all partitions is cut deeper.
DEEP_LEAVES = 20_000_000
#: Counters and bytes of labels that a partition's tries hold before they are sent.
HELD_COUNTERS = 2_000_000
HELD_BYTES = 32 << 20
#: Leaves of a row of the merged trie.
ROW_LEAVES = 4096
#: Nodes below this depth are not shared by leaves.
DEEPEST = 255
#: So many groups are broadcast, by some 40 bytes each.
BROADCAST_GROUPS = 100_000
#: Cells of the sums of pairs, and of leaves by sources, that a task holds.
HELD_CELLS = 2_000_000

TRIE = "lang string, prefix binary, turns binary, sizes array<int>, labels binary, leaf array<int>, sid array<long>, count array<long>, docs array<long>"


@dataclass
class Tries:
    """Leaves in order of (lang, term) and, in order of leaf and source, their counters."""

    lang: pa.Array  # string, of each leaf
    term: pa.Array  # large_binary
    leaf: np.ndarray
    sid: np.ndarray
    count: np.ndarray
    docs: np.ndarray

    def walk(self, at: np.ndarray) -> pa.RecordBatch:
        """One row for the leaves from each of `at`, sorted places, to the next: a trie in the order of its walk."""
        n = len(self.term)
        data = np.frombuffer(self.term.buffers()[2] or b"", np.uint8)
        bounds = np.frombuffer(self.term.buffers()[1], np.int64, n + 1, self.term.offset * 8) if n else np.zeros(1, np.int64)
        size = np.diff(bounds)
        turns = np.zeros(n, np.int64)
        same = np.ones(n, bool)
        same[at] = False
        going, k = np.flatnonzero(same), 0
        while len(going) and k < DEEPEST:
            going = going[(size[going] > k) & (size[going - 1] > k)]
            going = going[data[bounds[going] + k] == data[bounds[going - 1] + k]]
            k += 1
            turns[going] = k
        rest = size - turns
        starts = np.concatenate([[0], np.cumsum(rest)])
        byte = np.arange(int(starts[-1])) + np.repeat(bounds[:-1] + turns - starts[:-1], rest)
        labels = data[byte]
        edges = np.append(at, n)
        counters = np.searchsorted(self.leaf, edges)

        def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))

        def binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
            return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

        own = self.leaf - np.repeat(at, np.diff(counters))
        first = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [
                self.lang.take(first), pc.binary_slice(self.term.take(first).cast(pa.binary()), 0, PREFIX), binary(turns.astype(np.uint8), edges),
                lists(rest.astype(np.int32), edges), binary(labels, starts[edges]), lists(own.astype(np.int32), counters),
                lists(self.sid, counters), lists(self.count, counters), lists(self.docs, counters),
            ],
            [f.split()[0] for f in TRIE.split(", ")],
        )


def by_prefix(t: Tries, depth: int) -> np.ndarray:
    """Places of the leaves at which language or the first `depth` bytes change."""
    cut_off = pc.binary_slice(t.term.cast(pa.binary()), 0, depth)
    if not len(cut_off):
        return np.zeros(0, np.int64)
    new = np.ones(len(cut_off), bool)
    new[1:] = pc.or_(pc.not_equal(cut_off[1:], cut_off[:-1]), pc.not_equal(t.lang[1:], t.lang[:-1])).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def by_size(t: Tries, leaves: int) -> np.ndarray:
    """Places at which the language changes or a row has `leaves` leaves."""
    if not len(t.term):
        return np.zeros(0, np.int64)
    new = np.ones(len(t.term), bool)
    new[1:] = pc.not_equal(t.lang[1:], t.lang[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    since = np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))
    return np.flatnonzero(since % leaves == 0)


def merged(lang: pa.Array, term: pa.Array, leaf: np.ndarray, sid: np.ndarray, count: np.ndarray, docs: np.ndarray, least_docs: int = 0) -> Tries:
    """Tries of leaves in any order, equal ones summed; those in fewer than `least_docs` documents go."""
    tongues = pc.dictionary_encode(lang)
    names = tongues.dictionary
    words = pc.dictionary_encode(term)
    alphabet = np.empty(len(names), np.int64)
    alphabet[pc.sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
    place = np.empty(len(words.dictionary), np.int64)
    place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
    key = alphabet[tongues.indices.to_numpy()] * max(len(place), 1) + place[words.indices.to_numpy()] if len(term) else np.zeros(0, np.int64)
    of = key[leaf]
    order = np.lexsort((sid, of))
    of, sid, count, docs = of[order], sid[order], count[order], docs[order]
    at = np.flatnonzero(run_starts(of) | run_starts(sid))
    of, sid, count, docs = of[at], sid[at], *(np.add.reduceat(x, at) if len(at) else x[:0] for x in (count, docs))
    first = np.flatnonzero(run_starts(of))
    number = np.cumsum(run_starts(of)) - 1
    enough = (np.add.reduceat(docs, first) if len(first) else docs[:0]) >= least_docs
    kept, new = enough[number] if len(number) else np.zeros(0, bool), np.cumsum(enough) - 1
    of_leaf = of[first][enough]
    order = np.argsort(key, kind="stable")
    some = order[np.searchsorted(key[order], of_leaf)]
    return Tries(lang.take(pa.array(some)), term.take(pa.array(some)), new[number[kept]] if len(number) else number, sid[kept], count[kept], docs[kept])


def _strings(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def unwound(t: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The leaves and counters of rows of tries: lang and term of each leaf, then leaf, sid, count, docs."""
    sizes = _strings(t.column("sizes"))
    leaves = np.diff(sizes.offsets.to_numpy())
    tails = sizes.flatten().to_numpy().tolist()
    terms, j = [], 0
    for n, turns, labels in zip(leaves.tolist(), t.column("turns").to_pylist(), t.column("labels").to_pylist(), strict=True):
        last, at = b"", 0
        for i in range(n):
            size = tails[j]
            last = last[: turns[i]] + labels[at : at + size]
            terms.append(last)
            at += size
            j += 1
    row = np.repeat(np.arange(t.num_rows), leaves)
    leaf = _strings(t.column("leaf"))
    first = np.cumsum(leaves) - leaves
    number = leaf.flatten().to_numpy() + np.repeat(first, np.diff(leaf.offsets.to_numpy()))
    rest = [_strings(t.column(c)).flatten().to_numpy() for c in ("sid", "count", "docs")]
    return _strings(t.column("lang")).take(pa.array(row)), pa.array(terms, pa.large_binary()), number, *rest


class Counting:
    """The tries of some documents, by hash of the terms until they are walked."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, int], int] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.at = np.zeros(0, np.int64)  # and the place of each one's term in `terms`
        self.terms: list[pa.Array] = []
        self.rows: list[np.ndarray] = []
        self.counters = self.bytes = self.n_terms = 0

    def add(self, texts: pa.Array, langs: list[str], sids: list[int]) -> None:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sids, strict=True)], np.int64)
        for block in blocks(texts):
            data = LOWERED[block.data]
            starts, ends = block.runs(IS_LETTER[data])
            if not len(starts):
                continue
            doc = block.doc_of(starts)
            key = SpanHash(data).of(starts, ends)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            at = np.flatnonzero(run_starts(key) | run_starts(doc))
            times = np.diff(np.append(at, len(key)))
            self._learn(data, starts[order], ends[order], key)
            key, own = key[at], group[block.first : block.first + block.n][doc[at]]
            order = np.lexsort((own, key))
            key, own, times = key[order], own[order], times[order]
            at = np.flatnonzero(run_starts(key) | run_starts(own))
            self.rows.append(np.stack([key[at].view(np.int64), own[at], np.add.reduceat(times, at), np.diff(np.append(at, len(key)))]))
            self.counters += len(at)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> None:
        """Take down the terms of keys that are new."""
        at = np.flatnonzero(run_starts(key))
        place = np.minimum(np.searchsorted(self.keys, key[at]), max(len(self.keys) - 1, 0))
        at = at[self.keys[place] != key[at]] if len(self.keys) else at
        size = ends[at] - starts[at]
        bounds = np.concatenate([[0], np.cumsum(size)])
        byte = np.arange(int(bounds[-1])) + np.repeat(starts[at] - bounds[:-1], size)
        self.terms.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[byte])]))
        keys, places = np.append(self.keys, key[at]), np.append(self.at, self.n_terms + np.arange(len(at)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], places[order]
        self.n_terms += len(at)
        self.bytes += int(bounds[-1])

    def full(self) -> bool:
        return self.counters > HELD_COUNTERS or self.bytes > HELD_BYTES

    def tries(self) -> Tries:
        key, own, count, docs = np.concatenate([np.zeros((4, 0), np.int64), *self.rows], axis=1)
        names = list(self.groups)
        sid = np.array([s for _, s in names], np.int64)[own] if names else own
        tongue = {x: i for i, x in enumerate(dict.fromkeys(lang for lang, _ in names))}
        lang = np.array([tongue[x] for x, _ in names], np.int64)[own] if names else own
        place = self.at[np.searchsorted(self.keys, key.view(np.uint64))]
        spot = lang * max(self.n_terms, 1) + place
        leaves, leaf = np.unique(spot, return_inverse=True)
        words = pa.chunked_array(self.terms, pa.large_binary()).combine_chunks()
        words = words if isinstance(words, pa.Array) and not isinstance(words, pa.ChunkedArray) else pa.concat_arrays(words.chunks or [pa.array([], pa.large_binary())])
        return merged(pa.array(list(tongue), pa.string()).take(pa.array(leaves // max(self.n_terms, 1))), words.take(pa.array(leaves % max(self.n_terms, 1))), leaf, sid, count, docs)


def counted(docs: DataFrame, depth: int = PREFIX) -> DataFrame:
    """The tries of each partition of `docs`, which has text, lang and sid, cut by prefix."""
    bound_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counting()
        for b in batches:
            held.add(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())
            if held.full():
                yield from _cut(held.tries(), depth)
                held.clear()
        yield from _cut(held.tries(), depth)

    return docs.select("text", "lang", "sid").mapInArrow(made, TRIE)


def _cut(t: Tries, depth: int) -> Iterator[pa.RecordBatch]:
    at = by_prefix(t, depth)
    if len(at):
        yield t.walk(at).set_column(1, "prefix", pc.binary_slice(t.term.take(pa.array(at)).cast(pa.binary()), 0, depth))


def deeper(tries: DataFrame, deep_leaves: int = DEEP_LEAVES, depth: int = PREFIX) -> DataFrame:
    """`tries` with prefixes of over `deep_leaves` leaves cut at twice the depth, and again, until leaves alone are left or the deepest node."""
    while depth < DEEPEST:
        sizes = tries.filter(F.length("prefix") == depth).groupBy("lang", "prefix").agg(F.sum(F.size("sizes")).alias("leaves"), F.max(F.size("sizes")).alias("most"))
        hot = cut(sizes.filter((F.col("leaves") > deep_leaves) & (F.col("most") > 1)).select("lang", "prefix", F.lit(True).alias("hot")))
        if not hot.limit(1).count():
            return tries
        depth *= 2

        def again(batches: Iterator[pa.RecordBatch], at: int = depth) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from _cut(merged(*unwound(pa.Table.from_batches([b]))), at)

        marked = tries.join(hot, ["lang", "prefix"], "left")
        columns = [f.split()[0] for f in TRIE.split(", ")]
        tries = cut(marked.filter("hot is null").select(columns).unionByName(marked.filter("hot").select(columns).mapInArrow(again, TRIE)))
    return tries


def joined(tries: DataFrame, least_docs: int = LEAST_DOCS, row_leaves: int = ROW_LEAVES) -> DataFrame:
    """One trie of each language in rows of at most `row_leaves` leaves; each leaf in `least_docs` documents or more."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def key(b: pa.RecordBatch, i: int) -> tuple[str, bytes]:
            return b.column(0)[i].as_py(), b.column(1)[i].as_py()

        for b in batches:
            if not b.num_rows:
                continue
            new = pc.or_(pc.not_equal(b.column(0), b.column(0)[-1]), pc.not_equal(b.column(1), b.column(1)[-1])).to_numpy(zero_copy_only=False)
            whole = int(new.sum())  # rows are sorted: those before the last prefix
            if whole or (held and key(held[-1], -1) != key(b, -1)):
                t = merged(*unwound(pa.Table.from_batches([*held, b.slice(0, whole)])), least_docs)
                if len(t.term):
                    yield t.walk(by_size(t, row_leaves))
                held = []
            held.append(b.slice(whole))
            if len(held) > 1 and sum(x.nbytes for x in held) > HELD_BYTES:
                t = merged(*unwound(pa.Table.from_batches(held)))  # the same prefix: the parts become one
                one = t.walk(np.zeros(1, np.int64))
                held = [one.set_column(1, "prefix", held[0].column(1).slice(0, 1))]
        if held:
            t = merged(*unwound(pa.Table.from_batches(held)), least_docs)
            if len(t.term):
                yield t.walk(by_size(t, row_leaves))

    return tries.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(met, TRIE)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) in whole numbers; `count` + 2 is at most `total`, and that under 2**53."""
    rest = np.broadcast_to(count + 2, np.broadcast_shapes(np.shape(count), np.shape(total)))
    out = rest // total
    rest = rest - out * total
    for _ in range(3):  # three digits at a time, so that no product leaves 64 bits
        rest = rest * 1000
        digits = rest // total
        out = out * 1000 + digits
        rest = rest - digits * total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _streamed(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """Rows of tries with their language's sources become sums of pairs (term null) and candidate terms (other null)."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def pairs() -> Iterator[pa.RecordBatch]:
        for lang, (sids, u) in sums.items():
            for a in range(0, len(sids), max(1, 10_000 // len(sids))):
                part = u[a : a + max(1, 10_000 // len(sids))]
                i, j = np.nonzero(part)
                yield _found(lang, sids[i + a], sids[j], None, part[i, j])
        sums.clear()

    for b in batches:
        for r in range(b.num_rows):
            t = pa.Table.from_batches([b.slice(r, 1)])
            _, term, leaf, sid, count, _ = unwound(t)
            lang, n_terms, n_lang = t.column("lang")[0].as_py(), t.column("n_terms")[0].as_py(), t.column("n_lang")[0].as_py()
            roster = t.column("roster")[0].values
            sids, n = roster.field("sid").to_numpy(), roster.field("n").to_numpy()
            total = n + 2 * n_terms
            base = share(np.zeros(len(sids), np.int64), total)
            q = share(_sums(leaf, count, len(term)), np.int64(n_lang + 2 * n_terms))
            column = np.searchsorted(sids, sid)
            if lang not in sums:
                if sum(u.size for _, u in sums.values()) + len(sids) ** 2 > HELD_CELLS:
                    yield from pairs()
                sums[lang] = sids, np.zeros((len(sids), len(sids)), np.int64)
            u = sums[lang][1]
            step = max(1, HELD_CELLS // len(sids))
            for a in range(0, len(term), step):
                lo, hi = np.searchsorted(leaf, [a, a + step])
                c = np.zeros((min(step, len(term) - a), len(sids)), np.int64)
                c[leaf[lo:hi] - a, column[lo:hi]] = count[lo:hi]
                p, there = share(c, total), c > 0
                for s in range(len(sids)):
                    own = np.flatnonzero(there[:, s])
                    if not len(own):
                        continue
                    f = apart(p[own, s][:, None], p[own]) - apart(base[s], base)
                    once = ~there[own]
                    once[:, s + 1 :] = True  # what both hold counts at the first of them
                    u[s] += np.where(once, f, 0).sum(axis=0)
                    over = own[p[own, s] > q[a + own]]
                    value = apart(p[over, s], q[a + over])
                    first = np.argsort(-value, kind="stable")[:best]  # leaves are in UTF-8 order
                    yield _found(lang, np.full(len(first), sids[s]), None, term.take(pa.array(a + over[first])), value[first])
    yield from pairs()


def _sums(leaf: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, leaf, count)
    return out


def _found(lang: str, sid: np.ndarray, other: np.ndarray | None, term: pa.Array | None, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(sid), pa.nulls(n, pa.int64()) if other is None else pa.array(other), pa.nulls(n, pa.binary()) if term is None else term.cast(pa.binary()), pa.array(value)],
        ["lang", "sid", "other", "term", "value"],
    )


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    best: int = BEST,
    deep_leaves: int = DEEP_LEAVES,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other, and the terms that set it apart.

    Null texts, languages and sources are empty strings.  Every (lang, source) of the
    table is a group, also without terms; a language's only group has no rows of part
    `pair`, one in which no term is kept has pairs of value 0 and no terms.  Repeated
    rows count as often as they come.  An empty table gives no rows; other columns are
    not read.  A source is known by a 64-bit hash inside the tries.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(text_col).alias("text"), empty(lang_col).alias("lang"), empty(source_col).alias("source")).withColumn("sid", F.xxhash64("source"))
    trie = cut(joined(deeper(cut(counted(rows)), deep_leaves), least_docs))
    totals = trie.select("lang", F.explode(F.arrays_zip("sid", "count")).alias("c")).groupBy("lang", "c.sid").agg(F.sum("c.count").alias("n"))
    terms = trie.groupBy("lang").agg(F.sum(F.size("sizes")).alias("n_terms"))
    whole = totals.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    groups = rows.groupBy("lang", "source", "sid").agg(F.count("*").alias("rows")).drop("rows")
    groups = cut(
        groups.join(totals, ["lang", "sid"], "left").join(terms, "lang", "left").join(whole, "lang", "left")
        .select("lang", "source", "sid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_terms", "n_lang")])
    )
    roster = groups.groupBy("lang", "n_terms", "n_lang").agg(F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("roster"))
    roster = F.broadcast(roster) if groups.count() <= broadcast_groups else roster
    found = cut(
        trie.join(roster, "lang").mapInArrow(lambda it: _streamed(it, best), "lang string, sid long, other long, term binary, value long")
    )
    half = found.filter("other is not null").select("lang", "sid", "other", "value")
    sums = half.unionByName(half.select("lang", F.col("other").alias("sid"), F.col("sid").alias("other"), "value")).groupBy("lang", "sid", "other").agg(F.sum("value").alias("sum"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("other"), F.col("n").alias("n_other"))
    p, q = (f"(1 + ({2 * SCALE} div ({n} + 2 * n_terms)))" for n in ("n", "n_other"))
    absent = F.expr(f"CASE WHEN n_terms = 0 THEN 0 ELSE n_terms * ((({p} - {q}) * ({p} - {q})) div ({p} + {q})) END")
    pair = (
        groups.join(others, "lang").filter(F.col("sid") != F.col("other")).join(sums, ["lang", "sid", "other"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", (absent + F.coalesce("sum", F.lit(0))).alias("value"))
    )
    of = groups.select("lang", "sid", "source")
    term = found.filter("term is not null").join(of, ["lang", "sid"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).filter(F.col("rank") <= best))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), words AS MATERIALIZED (SELECT d, lang, source, term, count(*) AS c FROM (SELECT d, lang, source, unnest(t) AS term FROM rows) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM words GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS n FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, CAST(sum(w.c) AS BIGINT) AS c FROM words w JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM counts GROUP BY lang, source),
groups AS MATERIALIZED (
  SELECT lang, source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE} * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v) AS p,
         1 + ({SCALE} * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT s.lang, s.source, o.source AS other, CAST(sum(((s.p - o.p) * (s.p - o.p)) // (s.p + o.p)) AS BIGINT) AS value
    FROM shares s JOIN shares o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {BEST}
"""
