"""Cross-entropy difference of two language models (operator 5).

A target model, of documents labelled good, and a background model, of all
documents, are matched: the same words, orders and smoothing.  Words and pairs of
neighbours are counted one by one under hashed keys of as many bits as the corpus
needs, so the models grow with it.  Texts go in blocks; a block sums its own words
and pairs and asks for their counts in the corpus: its keys are dealt to buckets, a
bucket adds up what all blocks hold of its keys, and each block gets the sums back
in the order of its keys.  However common a word is, it stands once in what a block
asks.  No task holds more than a block with its sums, or a bucket.  Which documents
are labelled good is found by their ids alone, and each block is told its own.  A
word's probability after another mixes the pair's share, the word's share and a
floor, the same in both models.  A document is scored by the models of all other
documents: its own counts come off those of each corpus that it is in, else any
text would read like the corpus that has it.  Its score is the difference of its
losses per token, background less target: high where it reads like the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import BLOCK_BYTES, IS_LETTER, LOWERED, Block, SpanHash, blocks, bound_batches, cut, mix, read_table, run_starts, shared_path

#: The floor is that of a uniform draw of one of 2**WORD_BITS words.
WORD_BITS = 18
#: Shares of the pair's, the word's and the uniform probability.
SHARES = (0.6, 0.39, 0.01)
#: Bytes of text of a block, and its rows.
TEXT_BYTES = 6 << 20
TEXT_ROWS = 1 << 16
#: Buckets of keys: so many, and more where a bucket would sum over more tokens than BUCKET_TOKENS.
BUCKETS = 256
BUCKET_TOKENS = 2_000_000
#: Bits of a key beyond those that number the corpus's tokens: one key in 2**SPARE_BITS meets another's hash.
SPARE_BITS = 24


def spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of every token.

    Words are the runs of letters, lower-cased for a to z, and the runs of other characters but white space.
    """
    data = LOWERED[block.data]
    letter = IS_LETTER[data]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    a, b = block.runs(letter)
    c, d = block.runs(~letter & ~space)
    starts, ends = np.concatenate([a, c]), np.concatenate([b, d])
    order = np.argsort(starts, kind="stable")
    return data, starts[order], ends[order]


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word key, pair key, whether it is its document's first word) of every token; a first word has no pair.

    A part of the block at a time, as hashing takes some 50 bytes for each of text.
    """
    docs, words, pairs = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    first = 0
    while first < block.n:
        last = int(np.searchsorted(block.bounds, block.bounds[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), block.n)
        lo, hi = block.bounds[first], block.bounds[last]
        part = Block(first, block.data[lo:hi], block.bounds[first : last + 1] - lo, block.null[first:last])
        data, starts, ends = spans(part)
        h = SpanHash(data).of(starts, ends)
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        docs.append((part.doc_of(starts) + first).astype(np.int32))
        words.append(h)
        with np.errstate(over="ignore"):
            pairs.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + h))
        first = last
    doc = np.concatenate(docs)
    return doc, np.concatenate(words), np.concatenate(pairs), run_starts(doc)


def asked(word: np.ndarray, pair: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block in order, and where the key of each word, then of each pair, is among them."""
    return np.unique(np.concatenate([word, pair[~first]]) >> np.uint64(64 - bits), return_inverse=True)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Rows by blocks of about TEXT_BYTES and at most TEXT_ROWS, over the edges of batches."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            both = zip(held.columns, batch.columns, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in both], schema=batch.schema)
        whole = list(blocks(batch.column(1), TEXT_BYTES))
        closed = whole if whole and whole[-1].n >= TEXT_ROWS else whole[:-1]
        yield from ((batch.slice(b.first, b.n), b) for b in closed)
        held = None if len(closed) == len(whole) else batch.slice(whole[-1].first)
    if held is not None and held.num_rows:
        (b,) = blocks(held.column(1), max(held.nbytes, 1))
        yield held, b


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, sizes, texts): blocks of texts, compressed as they are shuffled, with the tokens of each."""
    made = TaskContext.get().partitionId() << 32
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
    for rows, b in _gathered(batches):
        sizes = np.bincount(tokens(b)[0], minlength=b.n)[: b.n].astype(np.int32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_batch(rows)
        ids, each = (pa.ListArray.from_arrays(pa.array([0, b.n], pa.int32()), x) for x in (rows.column(0), pa.array(sizes)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([made], pa.int64()), ids, each, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "ids", "sizes", "texts"]
        )
        made += 1


def _unpacked(packed: bytes) -> tuple[pa.Array, Block]:
    """(ids, texts) of a block."""
    rows = pa.ipc.open_stream(packed).read_all().combine_chunks()
    ids, text = (c.chunk(0) for c in rows.columns)
    (block,) = blocks(text, max(text.nbytes, 1))
    return ids, block


def _flagged(places: list[int] | None, n: int) -> np.ndarray:
    flags = np.zeros(n, bool)
    flags[places or []] = True
    return flags


def squeezed(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: of small numbers little is left."""
    planes = np.ascontiguousarray(x.ravel()).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def loosened(packed: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _asking(batches: Iterator[pa.RecordBatch], n_buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block, keys, counts): a block's keys of each bucket with its counts of both corpora, first all of one."""
    for batch in batches:
        for made, packed, good in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            _, b = _unpacked(packed)
            doc, word, pair, first = tokens(b)
            keys, at = asked(word, pair, first, bits)
            if not len(keys):
                continue
            mine = _flagged(good, b.n)[np.concatenate([doc, doc[~first]])]
            del doc, word, pair
            counts = np.stack([np.bincount(at, minlength=len(keys)), np.bincount(at[mine], minlength=len(keys))])
            head = min(bits, 32)
            bucket = ((keys >> np.uint64(bits - head)) * np.uint64(n_buckets) >> np.uint64(head)).astype(np.int64)  # in order, as the keys are
            opens = np.flatnonzero(run_starts(bucket))
            closes = np.append(opens[1:], len(keys))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[opens], pa.int32()),
                    pa.array(np.full(len(opens), made), pa.int64()),
                    pa.array([squeezed(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in zip(opens, closes, strict=True)], pa.binary()),
                    pa.array([squeezed(counts[:, i:j]) for i, j in zip(opens, closes, strict=True)], pa.binary()),
                ],
                ["bucket", "block", "keys", "counts"],
            )


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, bucket, counts): sums over all blocks, in the order of the keys that the block asked for.  Rows come sorted by bucket."""
    held: list[tuple[int, bytes, bytes]] = []
    now = None

    def answer() -> pa.RecordBatch:
        each = [np.cumsum(loosened(k, "<u8"), dtype=np.uint64) for _, k, _ in held]
        keys = np.concatenate(each)
        counts = np.concatenate([loosened(c, "<i8").reshape(2, -1) for *_, c in held], axis=1)
        _, at = np.unique(keys, return_inverse=True)
        sums = np.stack([np.bincount(at, weights=c)[at] for c in counts]).astype("<i8")
        edges = np.cumsum([0, *map(len, each)])
        made = [squeezed(sums[:, i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, *_ in held], pa.int64()), pa.array([now] * len(held), pa.int32()), pa.array(made, pa.binary())],
            ["block", "bucket", "counts"],
        )

    for batch in batches:
        for bucket, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != now:
                if held:
                    yield answer()
                held, now = [], bucket
            held.append(tuple(row))
    if held:
        yield answer()


def losses(b: Block, good: np.ndarray, counts: np.ndarray, totals: tuple[int, int], bits: int = 64) -> list[np.ndarray]:
    """Tokens of each text, and its loss per token in nats under the background and the target model.

    `good` flags the texts that the target holds, `counts` has the two corpora's counts of the block's
    distinct keys in order, and `totals` their tokens.
    """
    n = b.n
    doc, word, pair, first = tokens(b)
    _, at = asked(word, pair, first, bits)
    del word, pair
    word_at, pair_at = at[: len(doc)], np.zeros(len(doc), np.int64)
    pair_at[~first] = at[len(doc) :]
    size = np.bincount(doc, minlength=n)[:n]
    width = np.int64(counts.shape[1] + 1)
    own = lambda keys: np.unique(doc * width + keys, return_inverse=True, return_counts=True)[1:]
    inverse, often = own(word_at)
    own_word = often[inverse]
    inverse, often = own(np.where(first, width - 1, pair_at))
    own_pair = often[inverse]
    before, own_before = np.zeros_like(word_at), np.zeros_like(own_word)
    before[1:], own_before[1:] = word_at[:-1], own_word[:-1]
    out = []
    for k in (0, 1):
        has = good[doc] if k else np.ones(len(doc), bool)
        context = np.where(first, 0, counts[k][before] - has * own_before)
        joint = np.where(first, 0, counts[k][pair_at] - has * own_pair)
        single = (counts[k][word_at] - has * own_word) / np.maximum(totals[k] - has * size[doc], 1)
        p = SHARES[0] * (joint / np.maximum(context, 1)) + SHARES[1] * single + SHARES[2] / (1 << WORD_BITS)
        out.append(np.bincount(doc, weights=-np.log(p), minlength=n)[:n] / np.maximum(size, 1))
    return [size, *out]


def _scored(batches: Iterator[pa.RecordBatch], totals: tuple[int, int], bits: int) -> Iterator[pa.RecordBatch]:
    """A block's texts, which of them are good, and its sums by bucket."""
    for batch in batches:
        for packed, good, answers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            ids, b = _unpacked(packed)
            sums = [loosened(a["counts"], "<i8").reshape(2, -1) for a in sorted(answers or [], key=lambda a: a["bucket"])]
            counts = np.concatenate(sums, axis=1) if sums else np.zeros((2, 0), np.int64)
            size, background, target = losses(b, _flagged(good, b.n), counts, totals, bits)
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (size.astype(np.int64), target, background, background - target))],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )


def good_places(packed: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(block, good, tokens): the places of a block's documents whose id is labelled 1, and their tokens; ids meet labels without the texts."""
    good = labels.filter(F.col(f"`{label_col}`").cast("int") == 1).select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
    each = packed.select("block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("at", "doc"))
    rows = each.select("block", "at", F.col("doc.ids").alias("id"), F.col("doc.sizes").alias("size")).filter("id IS NOT NULL")
    return rows.join(good, "id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("good"), F.sum("size").alias("tokens"))


def cross_entropy_difference(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), a row for each row of `docs`.

    A null or empty text has no tokens, losses of 0 and score 0.  Repeated rows
    count and repeat; a null id is in the background only.  An empty table gives no
    rows, and without target documents their model is uniform.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = shared_path(spark, "blocks")  # a block stays what it is, and its ids are read without its texts
    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = "block long, ids array<long>, sizes array<int>, texts binary"
    two.mapInArrow(_packed, made).write.option("compression", "none").parquet(path)
    packed = spark.read.schema(made).parquet(path)
    places = cut(good_places(packed, labels, id_col, label_col))
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    totals = (total, places.agg(F.sum("tokens")).first()[0] or 0)
    n_buckets = max(BUCKETS, total // BUCKET_TOKENS)
    bits = min(64, (2 * total + 1).bit_length() + SPARE_BITS)
    texts = packed.select("block", "texts").repartition("block").join(places.select("block", "good"), "block", "left")  # made once, read twice
    asks = texts.select("block", "texts", "good").mapInArrow(lambda it: _asking(it, n_buckets, bits), "bucket int, block long, keys binary, counts binary")
    answers = asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answered, "block long, bucket int, counts binary")
    sums = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    return texts.join(sums, "block", "left").select("texts", "good", "answers").mapInArrow(
        lambda it: _scored(it, totals, bits), "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )


def op5_cross_entropy(spark, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
