"""SimHash near-duplicates linked through pivot distance tables (operator 8).

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles.  Equal fingerprints collapse first.  Of distinct ones, two that differ
in at most `max_bits` bits agree on at least `BLOCKS - max_bits` of BLOCKS bit
blocks, so each is dealt to one bucket for every such choice of blocks.  Inside a
bucket stand the pivot tables: Hamming distances to PIVOTS reference
fingerprints.  By the triangle inequality a pair whose distances to any pivot
differ by more than `max_bits` is no link, so rows sorted by the first pivot are
paired only within that window, the largest coordinate difference discards most
of the rest, and the survivors are verified bit by bit.  A bucket returns a
spanning forest of its links, never all pairs.  The distinct fingerprints near
one text number some ten thousands at most (those within 3 of 64 bits are 43,745),
and a bucket of over TILE rows is dealt out in pairs of tiles all the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import IS_SPACE, LOWERED, Block, blocks, bound_batches, cut, mix, read_table, text_function

SEED = 42
WORDS = 3
MAX_BITS = 3
BLOCKS = 5
PIVOTS = 32
TILE = 8192
#: So many spare rows are broadcast, by 16 bytes each.
BROADCAST_ROWS = 1_000_000
#: A fingerprint with over this share of the rows is joined from a broadcast of at most HOT_SHARE rows.
HOT_SHARE = 1000

_PIVOTS = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x51ED2701))


def fingerprints(block: Block, words: int = WORDS) -> np.ndarray:
    """uint64 fingerprints of the texts of a block."""
    data = LOWERED[block.data]
    starts, ends = block.words()
    out = np.zeros(block.n, np.uint64)
    if not len(starts):
        return out
    # the words again, one space apart
    inside = ~IS_SPACE[data]
    sizes = ends - starts
    new_starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    buffer = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    at = np.flatnonzero(inside)
    buffer[np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)] = data[at]
    new_ends = new_starts + sizes
    doc = block.doc_of(starts)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    count = np.diff(np.append(first, len(doc)))
    shingles = np.maximum(count - words + 1, 1)
    opens = np.concatenate([[0], np.cumsum(shingles)[:-1]])
    word = np.arange(int(shingles.sum())) + np.repeat(first - opens, shingles)
    last = np.minimum(word + words, np.repeat(first + count, shingles)) - 1
    text = buffer.tobytes()
    spans = map(slice, new_starts[word].tolist(), new_ends[last].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, spans), repeat(SEED)), np.uint64, len(word))
    made = np.empty((len(first), 64), np.int64)
    step = 1 << 16
    made[:] = 0
    owner = np.repeat(np.arange(len(first)), shingles)
    for a in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = owner[a : a + step]
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        made[of[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    majority = 2 * made > shingles[:, None]
    out[doc[first]] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_column(spark, text: F.Column, words: int = WORDS) -> F.Column:
    """The fingerprint of each text as a signed 64-bit number."""
    bound_batches(spark)

    def made(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.concatenate([np.zeros(0, np.uint64), *[fingerprints(b, words) for b in blocks(texts)]]).view(np.int64))]

    return text_function(made, "fp long", text)["fp"]


def with_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp, said): the fingerprint and a hash of the text."""
    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), fingerprint_column(df.sparkSession, text, words).alias("fp"), F.xxhash64(text, text.isNull()).alias("said"))


def block_masks(max_bits: int = MAX_BITS, n_blocks: int = BLOCKS) -> list[int]:
    """Signed masks, one for each choice of blocks that two near fingerprints must share."""
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, n_blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _root(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def forest(group: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that join all fingerprints of a group which near pairs connect."""
    table = np.bitwise_count(fp[:, None] ^ _PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((fp, table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    n = len(fp)
    label = np.arange(n)
    i = np.arange(n - 1)
    k = 1
    while len(i):
        i = i[i + k < n]
        j = i + k
        near = (group[i] == group[j]) & (table[j, 0] - table[i, 0] <= max_bits)
        i = i[near]
        a, b = i, i + k
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        for p in range(1, PIVOTS, 8):  # the largest coordinate difference, some pivots at a time
            if not len(a):
                break
            fine = np.abs(table[a, p : p + 8] - table[b, p : p + 8]).max(axis=1) <= max_bits
            a, b = a[fine], b[fine]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        a, b = a[true], b[true]
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            label = _root(label)
        k += 1
    tied = np.flatnonzero(label != np.arange(n))
    return fp[tied], fp[label[tied]]


def _linked(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by group; whole groups are linked once a batch's worth has gathered."""
    held: list[np.ndarray] = []

    def emit(rows: np.ndarray) -> pa.RecordBatch | None:
        keys = rows[:, :4]
        new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        rows, group = rows[~alone], group[~alone]
        a, b = forest(group, np.ascontiguousarray(rows[:, 4]).view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
        rows = np.concatenate([*held, rows])
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
        whole = last[-1] + 1 if len(last) else 0
        if whole:
            yield emit(rows[:whole])
        held = [rows[whole:]]
    if held:
        yield emit(held[0])


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect all near fingerprints of `distinct`, which has a column fp of distinct values."""
    masks = block_masks(max_bits, max_bits + 2)
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    large = keyed.groupBy("c", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") > TILE)
    sized = keyed.join(large, ["c", "key"], "left")
    tiles = F.coalesce(F.ceil(F.col("rows") / (TILE // 2)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (
        sized.withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("c", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
        .repartition("c", "key", "lo", "hi")
        .sortWithinPartitions("c", "key", "lo", "hi")
    )
    return dealt.mapInArrow(lambda it: _linked(it, max_bits), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint that has a link: the smallest of its component, by labels that jump."""
    both = cut(links.select("a", "b").union(links.select("b", "a")))
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("root")))
    while True:
        heard = (
            both.join(label.withColumnRenamed("fp", "a"), "a")
            .groupBy(F.col("b").alias("fp"))
            .agg(F.min("root").alias("heard"))
        )
        met = label.join(heard, "fp", "left").select("fp", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jumped = label.select(F.col("fp").alias("root"), F.col("root").alias("far"))
        new = cut(
            met.join(jumped, "root", "left").select("fp", "old", F.least("root", "far").alias("root"))
        )
        moved = new.filter("root <> old").limit(1).count()
        label = new.select("fp", "root")
        if not moved:
            return label


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of `df`.

    A null or empty text has fingerprint zero and links like any other.  Repeated
    rows repeat.  A row with a null id has a fingerprint and takes its component's
    id, which is null if no row of the component has one.  An empty table gives no
    rows.  Other columns are not read.
    """
    prints = cut(with_fingerprint(df, id_col, text_col, words).drop("said"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    label = components(near_links(distinct.select("fp"), max_bits))
    tied = distinct.join(label, "fp")
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of_tied = tied.select("fp", "root").join(least, "root").select("fp", "component_id")
    of_all = cut(
        distinct.join(of_tied.withColumnRenamed("component_id", "joined"), "fp", "left").select(
            "fp", F.coalesce("joined", "least").alias("component_id"), "rows"
        )
    )
    hot = F.broadcast(of_all.filter(F.col("rows") * HOT_SHARE > prints.count()).drop("rows"))  # under HOT_SHARE rows
    joined = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(of_all.drop("rows"), "fp"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def spare_rows(df: DataFrame, id_col: str, text_col: str, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, said, goes): the ids and text hashes of which rows are spare, all of them (goes), or all but one.

    Of each component one row stays: the smallest id, a null one last, and of its
    texts there the one with the smallest fingerprint and hash.
    """
    prints = cut(with_fingerprint(df, id_col, text_col, words).groupBy("doc_id", "fp", "said").agg(F.count("*").alias("rows")))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "said")
    best = cut(prints.groupBy("fp").agg(F.min(rank).alias("best"), F.count("*").alias("kinds")))
    label = components(near_links(best.select("fp"), max_bits))
    tied = best.join(label, "fp")
    first = tied.groupBy("root").agg(F.min("best").alias("first"))
    far = tied.select("fp", "root").join(first, "root").select("fp", "first")
    # fingerprints with one kind of row and no link are not joined with anything; the rest are few against all rows
    stays = cut(best.join(far, "fp", "left").select("fp", F.coalesce("first", "best").alias("first"), "kinds"))
    large = F.broadcast(stays.filter(F.col("kinds") * HOT_SHARE > best.count()).drop("kinds"))  # under HOT_SHARE times the kinds of a fingerprint
    joined = prints.join(large, "fp").unionByName(prints.join(large.select("fp"), "fp", "left_anti").join(stays.drop("kinds"), "fp"))
    goes = ~rank.eqNullSafe(F.col("first"))
    return joined.filter(goes | (F.col("rows") > 1)).select("doc_id", "said", goes.alias("goes"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `df` for each component of near-duplicates, with the columns that `df` has.

    It is one with the component's smallest id; a row without an id stays only where no
    row of its component has one.  Rows of one id with other texts are other documents.
    Of rows with the same id and text one stays, of other columns the smallest by hash.
    An empty table stays empty.  Spare rows are named by id and text hash and taken
    off by a broadcast if they are few, so that texts do not move, else by a shuffle.
    """
    names, text = df.columns, F.col(f"`{text_col}`")
    spare = cut(spare_rows(df, id_col, text_col, words, max_bits).withColumnsRenamed({"doc_id": "\x00i", "said": "\x00s", "goes": "\x00goes"}))
    n = spare.count()
    if not n:
        return df
    few = n <= BROADCAST_ROWS
    marked = df.withColumn("\x00id", F.col(f"`{id_col}`").cast("long")).withColumn("\x00said", F.xxhash64(text, text.isNull()))
    same = F.col("\x00id").eqNullSafe(F.col("\x00i")) & (F.col("\x00said") == F.col("\x00s"))
    listed = lambda rows: F.broadcast(rows) if few else rows
    alone = marked.join(listed(spare), same, "left_anti").select(*[F.col(f"`{c}`") for c in names])
    twice = spare.filter(~F.col("\x00goes"))
    if not twice.limit(1).count():
        return alone
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    met = marked.join(listed(twice), same, "left_semi").select("\x00id", "\x00said", row.alias("row"))
    kept = met.groupBy("\x00id", "\x00said").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))  # copies meet as one row a task
    return alone.unionByName(kept.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)]))


def op8_simhash_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
