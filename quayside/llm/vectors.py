"""Embedding near-duplicates by randomised-rotation binary codes (operator 11).

Equal vectors of a label collapse first.  Each distinct one is scaled to length 1,
rotated at random and kept as the signs of its coordinates, with a correction factor:
the inner product of the rotated vector and its own sign vector.  For a second
rotated vector y, <signs of x, y> / factor of x estimates <x, y> without bias, and
its error has a known spread.  A pair whose estimate lies EPSILON spreads below the
threshold is no link; all others are recomputed exactly in double precision.

Pairs are looked for in buckets of one label that agree in the signs of some more
rotated coordinates, in so many tables of other coordinates that a pair at the
threshold meets in one of them with probability MEETS, whatever the vectors are, as
the rotations are random; a small label is one bucket.  A bucket of over TILE rows is dealt out in pairs of tiles.  A
pair that already met in an earlier table is left to it, so link counts add up.  What
leaves a task is a count for each vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bound_batches, cut, read_table
from quayside.llm.simhash import HOT_SHARE, components

THRESHOLD = 0.93
SEED = 2024
#: Spreads of the estimate's error; about one pair in three million errs further.
EPSILON = 5.0
#: Error of estimates in single precision, beyond their spread.
ROUNDING = 1e-5
#: Probability that a pair at the threshold shares a bucket.
MEETS = 0.999
#: Distinct vectors of a bucket that the number of bits aims at, and those beyond which it is dealt in tiles.
ROWS = 4096
TILE = 2048
#: Pairs that are recomputed at a time.
PAIRS = 1 << 16


@lru_cache(maxsize=64)
def _signs(width: int, turn: int) -> np.ndarray:
    return np.random.default_rng((SEED, turn)).choice(np.array([-1.0, 1.0]), (3, width))


def rotate(x: np.ndarray, turn: int = 0) -> np.ndarray:
    """Rows of `x`, as wide as a power of two, turned by three rounds of random signs and a Hadamard transform; each `turn` is another rotation."""
    n, width = x.shape
    for signs in _signs(width, turn):
        x = x * signs
        half = 1
        while half < width:
            y = x.reshape(n, width // (2 * half), 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
            half *= 2
        x = x / math.sqrt(width)
    return x


def padded_width(longest: int) -> int:
    return max(64, 1 << max(longest - 1, 0).bit_length())


def unit(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list array, padded by zeros and scaled to length 1."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, initial=0)[:, None]  # so that no square leaves the doubles
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of rotated unit rows, and their correction factors."""
    return x >= 0, np.abs(x).sum(axis=1) / math.sqrt(x.shape[1])


def estimates(bits: np.ndarray, factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded rows with rotated rows `y`."""
    signs = np.where(bits, np.float32(1), np.float32(-1))
    return (signs @ y.astype(np.float32).T) / (math.sqrt(y.shape[1]) * factor[:, None]).astype(np.float32)


def spread(factor: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """The standard deviation of an estimate's error for pairs at the threshold; it is less for pairs above."""
    return np.sqrt((1 - threshold**2) * np.maximum(1 - factor**2, 0) / (width - 1)) / factor


def tables_for(bits: int, threshold: float = THRESHOLD, meets: float = MEETS) -> int:
    """Tables after which a pair at the threshold has shared a bucket with probability `meets`."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if same >= meets else math.ceil(math.log(1 - meets) / math.log(1 - same))


def keys_of(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """int32 key of each unit row in each table, from the signs of the second rotation and, where a table needs more, of further ones."""
    turns = -(-bits * tables // x.shape[1])
    signs = np.concatenate([np.zeros((len(x), 0), bool), *[rotate(x, 1 + turn) >= 0 for turn in range(turns)]], axis=1)
    own = signs[:, : bits * tables].reshape(len(x), tables, bits)
    return (own * (1 << np.arange(bits))).sum(axis=2, dtype=np.int64).astype(np.int32)


def coded(distinct: DataFrame, width: int, bits: int, tables: int) -> DataFrame:
    """`distinct`, which has uid, label, rows and v, with its code, factor and the keys of all tables."""
    bound_batches(distinct.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(b.column("v"), width)
                signs, factor = code(rotate(x))
                keys = keys_of(x, bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                packed = pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, packed, pa.array(factor), lists], ["uid", "label", "rows", "v", "code", "factor", "keys"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.select("uid", "label", "rows", "v").mapInArrow(made, f"uid long, label string, rows long, v {kind}, code binary, factor double, keys array<int>")


def _forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """`label`, the least row that each row is tied to, after the links (i, j)."""
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(up := label[label], label):
            label = up


def _tiled(width: int, threshold: float, epsilon: float):
    def linked(key: tuple, t: pa.Table) -> pa.Table:
        number, lo, hi = key[1].as_py(), key[3].as_py(), key[4].as_py()
        t = t.combine_chunks()
        column = lambda c: t.column(c).chunk(0) if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        uid, rows, own = (column(c).to_numpy() for c in ("uid", "rows", "own"))
        n = len(uid)
        x = unit(column("v"), width)
        turned = rotate(x)
        bits = np.unpackbits(np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(n, -1), axis=1, count=width).astype(bool)
        factor, keys = column("factor").to_numpy(), column("keys").flatten().to_numpy().reshape(n, -1)
        least = (threshold - epsilon * spread(factor, threshold, width) - ROUNDING).astype(np.float32)
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        links, label = np.zeros(n, np.int64), np.arange(n)
        for a in range(0, len(left), 512):
            some = left[a : a + 512]
            open_ = estimates(bits[some], factor[some], turned[right]) >= least[some][:, None]
            if lo == hi:
                open_ &= some[:, None] < right[None, :]
            i, j = np.nonzero(open_)
            i, j = some[i], right[j]
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                new = ~(keys[p, :number] == keys[q, :number]).any(axis=1)
                p, q = p[new], q[new]
                true = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[true], q[true]
                links += np.bincount(p, weights=rows[q], minlength=n).astype(np.int64) + np.bincount(q, weights=rows[p], minlength=n).astype(np.int64)
                label = _forest(n, p, q, label)
        some, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
        return pa.table({
            "a": pa.array(np.concatenate([uid[some], uid[tied]])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(uid[label[tied]])]),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(tied), np.int64)])),
        })

    return linked


def near_vectors(distinct: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, tile: int = TILE, epsilon: float = EPSILON) -> DataFrame:
    """(a, b, n): of each linked uid how many rows it links with (b null), and links (a, b) that join all that are connected.

    `distinct` has uid, label, rows (how many rows have the vector) and v, which is neither zero nor null.
    """
    sizes = distinct.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("longest")).agg(F.max("n").alias("n"), F.max("longest").alias("longest")).first()
    width = padded_width(sizes["longest"] or 1)
    bits = min(30, max(0, math.ceil(math.log2((sizes["n"] or 1) / rows))))
    with_codes = cut(coded(distinct, width, bits, tables_for(bits, threshold)))
    dealt = with_codes.select("uid", "label", "rows", "v", "code", "factor", "keys", F.posexplode("keys").alias("number", "key"))
    large = with_codes.select("label", F.posexplode("keys").alias("number", "key")).groupBy("label", "number", "key").agg(F.count("*").alias("size")).filter(F.col("size") > tile)
    tiles = F.coalesce(F.ceil(F.col("size") / (tile // 2)), F.lit(1)).cast("int")
    tiled = (
        dealt.join(large, ["label", "number", "key"], "left")
        .withColumn("tiles", tiles)
        .withColumn("own", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "number", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "uid", "rows", "v", "code", "factor", "keys", "own")
    )
    return tiled.groupBy("label", "number", "key", "lo", "hi").applyInArrow(_tiled(width, threshold, epsilon), "a long, b long, n long")


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, rows: int = ROWS, tile: int = TILE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of `df`.

    Rows are linked when their labels are equal and not null and the cosine of their
    vectors is `threshold` or more; of vectors of different lengths the shorter one is
    padded by zeros.  A null or zero vector, or one that holds null or a number that is
    not finite, links with nothing.  Rows of one id are rows of their own; repeated
    rows link with each other.  A component goes by the smallest id in it; a row
    without an id takes it too, and a component without ids has a null one.  An empty
    table gives no rows; other columns are not read.
    """
    vector = F.col(f"`{vector_col}`")
    narrow = df.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.transform(vector.cast("array<float>" if narrow else "array<double>"), lambda x: x + F.lit(0.0).cast("float" if narrow else "double"))  # -0.0 is 0.0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    bare = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), v.alias("v")).withColumn("taken", taken)
    named = bare.withColumn("h1", F.when(F.col("taken"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("taken"), F.xxhash64(F.lit("second"), "v", "label")))
    equal = named.filter("taken").groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("*").alias("rows"), F.min("vec_id").alias("least"))
    distinct = cut(cut(equal).withColumn("uid", F.monotonically_increasing_id()))
    found = cut(near_vectors(distinct.select("uid", "label", "rows", "v"), threshold, rows, tile))
    label = components(found.filter("b is not null").select("a", "b").distinct()).select(F.col("fp").alias("uid"), "root")
    counts = found.filter("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("others"))
    plain = distinct.select("uid", "h1", "h2", "rows", "least")
    tied = plain.join(label, "uid")
    first = tied.groupBy("root").agg(F.min("least").alias("first"))
    of_all = cut(
        plain.join(tied.select("uid", "root").join(first, "root").select("uid", "first"), "uid", "left").join(counts, "uid", "left")
        .select("h1", "h2", "rows", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    )
    listed = cut(named.select("vec_id", "h1", "h2"))
    hot = F.broadcast(of_all.filter(F.col("rows") * HOT_SHARE > listed.count()).drop("rows"))  # under HOT_SHARE rows
    some, rest = listed.filter("h1 is not null"), listed.filter("h1 is null")
    met = some.join(hot, ["h1", "h2"]).unionByName(some.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(of_all.drop("rows"), ["h1", "h2"]))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = met.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
), reached(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.a
"""
