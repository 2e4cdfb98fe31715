"""Language identification with hyperdimensional profiles (operator 1).

Every letter has a fixed random vector of +1 and -1.  A trigram's vector binds
its letters: the first permuted twice, the second once, multiplied element by
element.  A text bundles the vectors of its trigrams; a language's prototype
bundles the unit vectors of its training texts.  A text is given the language
whose prototype has the largest cosine.

Words are padded by a space letter, and trigrams about a space are left out.
Letters other than a to z share 101 vectors, dealt by a hash of the code point.
Prototypes are learned from a sample of at most about `per_lang` rows of each
language, drawn by a hash of the id; the sample is a fraction of the rows where
a language has more, so its size does not grow with the input.  A model has at most
MAX_LANGS languages, those with most rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import blocks, bound_batches, cut, id_hash, mix, read_table

DIMENSIONS = 1024
PER_LANG = 3000
#: Languages that one pass compares with, 4 MB of prototypes; of more languages there are more passes.
PASS_LANGS = 1024
FOLDS, HELD_OUT = 3, 1
LETTERS = 128  # classes: the space, a to z, and 101 for the rest
SAMPLE_GRAIN = 1_000_000


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Class of each code point; 0 for what is no letter."""
    points = np.arange(0x110000)
    table = np.where([chr(i).isalpha() for i in points], 27 + (mix(points) % np.uint64(LETTERS - 27)).astype(np.int64), 0)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table.astype(np.uint8)


@lru_cache(maxsize=2)
def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    bits = mix(np.arange(LETTERS * dimensions, dtype=np.uint64) + np.uint64(77)) & np.uint64(1)
    return (2 * bits.astype(np.int8) - 1).reshape(LETTERS, dimensions)


def trigram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    letters = letter_vectors(dimensions)
    twice, once = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    bound = twice[codes // LETTERS**2] * once[codes // LETTERS % LETTERS] * letters[codes % LETTERS]
    return bound.astype(np.float32)


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS, most: int = 256) -> np.ndarray:
    """A bundled vector for each text, zero for one without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for at in range(0, len(texts), most):
        lowered = [t.lower() for t in texts[at : at + most]]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            continue
        middle = letter_classes()[points].astype(np.int64)
        ends = np.cumsum(sizes)
        full = sizes > 0
        before, after = np.roll(middle, 1), np.roll(middle, -1)
        before[(ends - sizes)[full]] = 0
        after[ends[full] - 1] = 0
        inside = middle > 0
        code = (before * LETTERS + middle) * LETTERS + after
        doc = np.repeat(np.arange(len(lowered)), sizes)
        keys, counts = np.unique(doc[inside] * LETTERS**3 + code[inside], return_counts=True)
        codes, column = np.unique(keys % LETTERS**3, return_inverse=True)
        row = keys // LETTERS**3
        for c in range(0, len(codes), 16384):  # bounds memory whatever the alphabet
            mine = (column >= c) & (column < c + 16384)
            vectors = trigram_vectors(codes[c : c + 16384], dimensions)
            dense = np.zeros((len(lowered), len(vectors)), np.float32)
            dense[row[mine], column[mine] - c] = counts[mine]
            out[at : at + len(lowered)] += dense @ vectors
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _bundled(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for b in blocks(batch.column(1)):
            texts = batch.column(1).slice(b.first, b.n).to_pylist()
            vectors = _unit(text_vectors([t or "" for t in texts], dimensions).astype(np.float64))
            for lang, v in zip(langs[b.first : b.first + b.n], vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + v
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "v"]
        )


def _added(t: pa.Table) -> pa.Table:
    """The sum of one language's partial bundles, in the order of their bytes, so that reruns agree."""
    parts = sorted(t.column("v").to_pylist())
    return pa.table({"lang": t.column("lang").slice(0, 1), "v": pa.array([sum(np.frombuffer(v) for v in parts).tobytes()], pa.binary())})


def prototypes(rows: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order of code points, and their unit prototypes, of `rows` with lang and text."""
    bound_batches(rows.sparkSession)
    bundles = rows.select("lang", "text").repartition(24).mapInArrow(lambda it: _bundled(it, dimensions), "lang string, v binary")
    made = {r["lang"]: np.frombuffer(r["v"]) for r in bundles.groupBy("lang").applyInArrow(_added, "lang string, v binary").collect()}  # about PASS_LANGS rows
    langs = sorted(made)
    return langs, _unit(np.array([made[x] for x in langs]).reshape(len(langs), dimensions))


def learned_rows(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> tuple[DataFrame, int]:
    """(lang, text, pass) of about `per_lang` rows of each language, drawn by a hash of the id, and how many passes the languages take."""
    lang = F.col(f"`{lang_col}`").cast("string")
    known = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang")).filter("lang IS NOT NULL")
    counts = cut(known.groupBy("lang").count())
    n = counts.count()
    share = F.least(F.lit(SAMPLE_GRAIN), F.floor(F.lit(per_lang * SAMPLE_GRAIN) / F.col("count")) + 1)
    shares = counts.select(F.col("lang").alias("known"), share.alias("share"))
    shares = F.broadcast(shares) if n <= PASS_LANGS else shares
    drawn = known.join(shares, F.col("lang") == F.col("known")).filter(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(SAMPLE_GRAIN)) < F.col("share"))
    passes = max(1, -(-n // PASS_LANGS))
    return drawn.select("lang", "text", F.pmod(F.xxhash64("lang"), F.lit(passes)).alias("pass")), passes


def _predicted(batches, model, last: bool) -> Iterator[pa.RecordBatch]:
    """The better of what a row has and the best of the model's languages; of equal cosines the first by code points.  The last pass drops the text."""
    langs, profile = model.value
    for batch in batches:
        pred: list[str] = []
        score: list[np.ndarray] = []
        for b in blocks(batch.column(2)):
            texts = [t or "" for t in batch.column(2).slice(b.first, b.n).to_pylist()]
            vectors = text_vectors(texts, profile.shape[1])
            known = (vectors != 0).any(axis=1) & bool(langs)
            cosine = _unit(vectors) @ profile.T if langs else np.zeros((len(texts), 1))
            best = cosine.argmax(axis=1)
            pred += [langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            score.append(np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0).astype(np.float64))
        if batch.num_rows:
            scores = np.concatenate(score)
            before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), pred, scores.tolist(), strict=True)
            chosen = [(p, s) if q == "und" or (p != "und" and (-s, p) < (-t, q)) else (q, t) for p, s, q, t in before]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.nulls(batch.num_rows, pa.string()) if last else batch.column(2), pa.array([c[0] for c in chosen], pa.string()), pa.array([c[1] for c in chosen], pa.float64())],
                ["doc_id", "held_out", "text", "lang_pred", "score"],
            )


def identify_language(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dimensions: int = DIMENSIONS,
    per_lang: int = PER_LANG,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of `df`.

    Prototypes are learned from the rows that are not held out and have a language
    and an id.  A null text, one without letters, and any text if there is nothing
    to learn from, is `und` with score 0.  Of equal cosines the first language by
    code points wins.  A null id is not held out.  Repeated rows repeat, an empty
    table gives no rows, and other columns are not read.
    """
    bound_batches(df.sparkSession)
    held_out = F.coalesce(id_hash(f"`{id_col}`", FOLDS) == HELD_OUT, F.lit(False))
    learn = df.filter(id_hash(f"`{id_col}`", FOLDS) != HELD_OUT)
    learned, passes = learned_rows(learn, id_col, text_col, lang_col, per_lang)
    out = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text_col}`").alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")
    )
    for p in range(passes):  # the prototypes of a pass are broadcast, and each row keeps the best so far
        langs, profile = prototypes(learned.filter(F.col("pass") == p), dimensions)
        model = df.sparkSession.sparkContext.broadcast((langs, profile.astype(np.float32)))
        out = out.mapInArrow(lambda it, model=model, last=p == passes - 1: _predicted(it, model, last), "doc_id long, held_out boolean, text string, lang_pred string, score double")
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))
