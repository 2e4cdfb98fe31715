"""Ground shared by the text operators: reading, lineage cuts, byte-level text.

Text is handled as numpy arrays over the UTF-8 bytes of a bounded block of
documents: words, lines and their 64-bit hashes come from whole-array
operations, so Python never loops over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.plans.lineage import cut, shared_path  # noqa: F401  the operators take them from here

#: Bytes of text that one block holds at most, unless one document is longer.
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 2 << 20
#: Parts in which labelled_sample() thins a class.
SAMPLE_PARTS = 4096
#: Grain of the share of ids that labelled_sample() draws.
SAMPLE_GRAIN = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, as one batch may hold many long texts; a session with tighter bounds keeps them."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 4000)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def text_function(make: Callable[[pa.Array], list[pa.Array]], schema: str, text: Column) -> Column:
    """A struct of what `make` gives for an array of texts.

    Only the texts go to Python, the other columns wait in the JVM.  It counts as not
    deterministic, so that a filter on the struct does not have it computed twice.
    """
    from pyspark.sql.functions import arrow_udf

    names = [f.split()[0] for f in schema.split(", ")]

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.StructArray.from_arrays(make(texts), names)

    made.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(made, f"struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>").asNondeterministic()(text)


def id_hash(col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % modulus


# --- fixed byte classes -----------------------------------------------------
#: ASCII white space, as in the pattern [\x20\x09-\x0D].
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Characters that count as symbols.
SYMBOL_BYTES = b"#*$%&|<>"


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


IS_SPACE = byte_class(SPACE_BYTES)
IS_SYMBOL = byte_class(SYMBOL_BYTES)
IS_UPPER = byte_class(bytes(range(65, 91)))
IS_LOWER = byte_class(bytes(range(97, 123)))
IS_DIGIT = byte_class(bytes(range(48, 58)))
IS_LETTER = IS_UPPER | IS_LOWER | (np.arange(256) >= 128)
IS_CHAR_START = (np.arange(256) & 0xC0) != 0x80
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = int(_MULT)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)
        down = np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]).cumprod(dtype=np.uint64)
    return up, down


_kept_powers = lru_cache(maxsize=1)(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables that reach `n`; one for blocks is kept, longer texts make their own."""
    return _kept_powers(2 * BLOCK_BYTES) if n <= 2 * BLOCK_BYTES else _powers(n)


class SpanHash:
    """64-bit hashes of any byte spans of an array, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_VALUE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * _MIX2)


@dataclass
class Block:
    """Texts `first` to `first + n` of a batch as one array of UTF-8 bytes; a null text has no bytes."""

    first: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, n + 1 offsets
    null: np.ndarray  # bool

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes lie in each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of flagged bytes; none crosses a text's end."""
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = self.bounds[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        return np.flatnonzero(opens), np.flatnonzero(closes) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the pattern [^\\x20\\x09-\\x0D]+."""
        return self.runs(~IS_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every \\n-separated line; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        before = np.searchsorted(breaks, self.bounds)
        counts = np.diff(before) + 1
        first = before[:-1] + np.arange(self.n)
        return _placed(first, self.bounds[:-1], breaks + 1), _placed(first + counts - 1, self.bounds[1:], breaks), np.repeat(np.arange(self.n), counts)


def _placed(at: np.ndarray, these: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """`these` at the places `at`, and `rest` in order at all others."""
    out = np.empty(len(at) + len(rest), np.int64)
    others = np.ones(len(out), bool)
    others[at] = False
    out[at], out[others] = these, rest
    return out


def blocks(texts: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string array into blocks of bounded bytes, whole texts each."""
    null = np.asarray(texts.is_null())
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(first, whole[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], null[first:last])
        first = last


def grouped_sum(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n)[:n]


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Flags the first of each run of equal keys."""
    first = np.ones(len(sorted_keys), dtype=bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return first


def labelled_sample(
    docs: DataFrame, known: DataFrame, id_col: str, text_col: str, per_class: int, most_chars: int, seed: int, line_chars: int = 0
) -> tuple[DataFrame, dict[int, float]]:
    """(class, text) of a bounded sample, and how many labelled ids one drawn id of each class stands for.

    `known` has distinct ids with a column class of few values.  Of each class about
    `per_class` ids are drawn by a hash, and of their rows, equal ones once, so many
    parts by a hash of the row that their texts hold at most `most_chars` characters,
    whatever the ids' rows are; texts of over a fiftieth of that are not learned from.
    A line counts for at least `line_chars` characters.
    """
    counts = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}
    shares = {k: min(SAMPLE_GRAIN, per_class * SAMPLE_GRAIN // n + 1) for k, n in counts.items()}
    least = F.lit(0)
    for k, share in shares.items():
        least = F.when(F.col("class") == k, share).otherwise(least)
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(SAMPLE_GRAIN)) < least)
    text = F.col(f"`{text_col}`")
    known_text = F.coalesce(text, F.lit(""))
    lines = F.length(known_text) - F.length(F.replace(known_text, F.lit("\n"), F.lit(""))) + 1 if line_chars else F.lit(0)
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text"), F.greatest(F.length(known_text), lines * line_chars).alias("chars"))
        .filter(F.col("chars") <= most_chars // 50)
        .join(F.broadcast(drawn), F.col("doc") == F.col("id"))  # some per_class rows of a class
        .withColumn("key", F.xxhash64(F.lit(seed), "id", "text"))
        .withColumn("part", F.pmod("key", F.lit(SAMPLE_PARTS)))
    )
    sizes = rows.groupBy("class", "part", "key").agg(F.max("chars").alias("chars")).groupBy("class", "part").agg(F.sum("chars").alias("chars"))
    held: dict[int, int] = {}
    last: dict[int, int] = {}
    for r in sizes.orderBy("class", "part").collect():  # SAMPLE_PARTS rows of a class at most
        held[r["class"]] = held.get(r["class"], 0) + r["chars"]
        if held[r["class"]] <= most_chars:
            last[r["class"]] = r["part"]
    upto = F.lit(-1)
    for k, part in last.items():
        upto = F.when(F.col("class") == k, part).otherwise(upto)
    sample = rows.filter(F.col("part") <= upto).groupBy("key", "class").agg(F.any_value("text").alias("text")).select("class", "text")
    thinned = {k: 1.0 if held.get(k, 0) <= most_chars else SAMPLE_PARTS / (last.get(k, 0) + 1) for k in shares}
    return sample, {k: SAMPLE_GRAIN / share * thinned[k] for k, share in shares.items()}
