"""Toxicity grades with cumulative-link ordinal regression (operator 10).

Features of a text are the sparse set of its lower-cased words and of their
beginnings of PREFIXES bytes, hashed, so that inflections and compounds of an
insult count too.  The model has one weight for each word and an ordered threshold for each grade, all
of which share the weights: P(grade >= k) = sigmoid(w . x - threshold_k).  The
output is the expected grade, the sum of these probabilities.

Labels say toxic or not.  Grades of the toxic ones come from their dose: the
share of toxic training documents that hold a word against the share of the
others makes it a marker, and a toxic document with more occurrences of markers
than the first and second terciles has grade 2 and 3.  A column with grades of
its own can be given instead.

The model is fitted on a sample of at most about `per_class` labelled documents
of each label, drawn by a hash of the id, whose texts hold at most `most_chars`
characters; both labels weigh alike.  Features that
fewer than MIN_DOCS of them hold, or whose shares among toxic and other documents
differ by less than MIN_Z standard errors, have no weight.  Scoring reads whole
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import IS_LETTER, LOWERED, Block, SpanHash, blocks, bound_batches, id_hash, labelled_sample, mix, read_table, text_function

PER_CLASS = 4000
MOST_CHARS = 16_000_000
FOLDS, HELD_OUT = 5, 0
BITS = 22
MIN_DOCS = 4
MIN_Z = 4.5
PREFIXES = (4, 5, 6)
GRADES = 4
MARKER_ODDS = 3.0


def word_features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, occurrences) of a block's words and their beginnings, in order of document and feature."""
    data = LOWERED[block.data]
    starts, ends = block.runs(IS_LETTER[data])
    doc = block.doc_of(starts)
    spans = SpanHash(data)
    feature, docs = [spans.of(starts, ends)], [doc]
    for k in PREFIXES:
        long = ends - starts > k
        feature.append(mix(spans.of(starts[long], starts[long] + k) ^ np.uint64(k)))
        docs.append(doc[long])
    feature = (np.concatenate(feature) >> np.uint64(64 - bits)).astype(np.int64)
    doc = np.concatenate(docs)
    keys, counts = np.unique((doc << bits) | feature, return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), counts


@dataclass
class Ordinal:
    """Sorted features with their weights, and increasing thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, block: Block) -> np.ndarray:
        doc, feature, _ = word_features(block)
        if not len(self.features):
            return np.zeros(block.n)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        w = np.where(self.features[at] == feature, self.weights[at], 0.0)
        return np.bincount(doc, weights=w, minlength=block.n)[: block.n]

    def above(self, block: Block) -> np.ndarray:
        """P(grade >= k) for k = 1, 2... of each text."""
        x = self.scores(block)[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def doses(doc: np.ndarray, column: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Occurrences of marker words in each document."""
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    in1 = np.bincount(column[toxic[doc]], minlength=column.max(initial=-1) + 1)
    in0 = np.bincount(column, minlength=len(in1)) - in1
    odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    marker = (odds >= MARKER_ODDS) & (in1 >= MIN_DOCS)
    return np.bincount(doc, weights=np.where(marker[column], count, 0), minlength=len(toxic))


def grades_of(doc, column, count, toxic: np.ndarray, n_grades: int = GRADES) -> np.ndarray:
    dose = doses(doc, column, count, toxic)
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    cuts = np.quantile(dose[toxic], np.arange(1, n_grades - 1) / (n_grades - 1), method="lower")
    return np.where(toxic, 1 + (dose[:, None] > cuts[None, :]).sum(axis=1), 0)


def fit(doc: np.ndarray, column: np.ndarray, kinds: np.ndarray, grade: np.ndarray, rounds: int = 250, l2: float = 0.5) -> Ordinal:
    """Penalised maximum likelihood by Adam; gaps between thresholds stay positive as exponentials.

    Document doc[i] holds the feature kinds[column[i]].
    """
    top = int(grade.max()) if len(grade) else 0
    df = np.bincount(column, minlength=len(kinds))
    toxic = grade > 0
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    in1 = np.bincount(column[toxic[doc]], minlength=len(kinds))
    share = df / (n1 + n0)
    apart = in1 / n1 - (df - in1) / n0
    used = (df >= MIN_DOCS) & (np.abs(apart) >= MIN_Z * np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12))
    place = np.cumsum(used) - 1
    on = used[column]
    doc, column, features = doc[on], place[column[on]], kinds[used]
    if top == 0 or not len(features):
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(max(top, 1), 30.0))
    n, f = len(grade), len(features)
    theta = np.concatenate([np.zeros(f), [1.0], np.full(top - 1, -1.0)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weigh = np.where(toxic, n / (2 * n1), n / (2 * n0))
    for step in range(1, rounds + 1):
        _, grad = likelihood(theta, doc, column, grade, weigh, f, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = theta[f] + np.concatenate([[0], np.cumsum(np.exp(theta[f + 1 :]))])
    return Ordinal(features, theta[:f], cuts)


def likelihood(
    theta: np.ndarray, doc: np.ndarray, column: np.ndarray, grade: np.ndarray, weigh: np.ndarray, f: int, l2: float
) -> tuple[float, np.ndarray]:
    """(penalised log likelihood, its gradient): `theta` has f weights, the first threshold and the logs of the gaps to the next."""
    n, top = len(grade), len(theta) - f
    rows = np.arange(n)
    gaps = np.exp(theta[f + 1 :])
    cuts = theta[f] + np.concatenate([[0], np.cumsum(gaps)])
    score = np.bincount(doc, weights=theta[column], minlength=n)
    above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -60, 60)))
    above = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    slope = above * (1 - above)
    p = np.maximum(above[rows, grade] - above[rows, grade + 1], 1e-12)
    low, high = weigh * slope[rows, grade] / p, weigh * slope[rows, grade + 1] / p
    by_score = low - high
    by_cut = np.bincount(grade, weights=-low, minlength=top + 2)[1 : top + 1] + np.bincount(grade + 1, weights=high, minlength=top + 2)[1 : top + 1]
    tail = np.cumsum(by_cut[::-1])[::-1]
    grad = np.concatenate([np.bincount(column, weights=by_score[doc], minlength=f) - l2 * theta[:f], [tail[0]], tail[1:] * gaps])
    return float((weigh * np.log(p)).sum() - l2 / 2 * (theta[:f] ** 2).sum()), grad


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        words, counts = [], []
        for b in blocks(batch.column(1)):
            doc, feature, count = word_features(b)
            at = np.searchsorted(doc, np.arange(1, b.n))
            words += [x.astype(np.int32).tobytes() for x in np.split(feature, at)]
            counts += [x.astype(np.int32).tobytes() for x in np.split(count, at)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.binary()), pa.array(counts, pa.binary())], ["grade", "words", "counts"]
        )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS, graded: bool = False, most_chars: int = MOST_CHARS,
) -> Ordinal:
    """A model of a bounded sample of the labelled rows that are not held out; with `graded` the labels are grades already."""
    bound_batches(docs.sparkSession)
    label = F.col(f"`{label_col}`").cast("int")
    known = (
        labels.filter((label >= 0) & (id_hash(f"`{id_col}`", FOLDS) != HELD_OUT))
        .groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label).alias("grade"))
    )
    classes = known.withColumn("class", (F.col("grade") > 0).cast("int"))
    sample, _ = labelled_sample(docs, classes.drop("grade"), id_col, text_col, per_class, most_chars, 3) if not graded else labelled_sample(
        docs, classes.drop("class").withColumnRenamed("grade", "class"), id_col, text_col, per_class, most_chars, 3
    )
    rows = sample.mapInArrow(_featured, "grade int, words binary, counts binary").collect()  # of most_chars characters a class at most
    rows.sort(key=lambda r: (r["grade"], bytes(r["words"])))
    words = [np.frombuffer(r["words"], np.int32) for r in rows]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(w) for w in words])
    kinds = np.unique(np.concatenate([np.zeros(0, np.int32), *words]))
    column = np.concatenate([np.zeros(0, np.int32), *[np.searchsorted(kinds, w).astype(np.int32) for w in words]])
    count = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(r["counts"], np.int32) for r in rows]])
    grade = np.array([r["grade"] for r in rows], np.int64)
    del rows, words
    if not graded and len(grade):
        grade = grades_of(doc, column, count, grade > 0)
    return fit(doc, column, kinds, grade)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
    graded: bool = False,
) -> DataFrame:
    """(doc_id, held_out, expected_severity, severity, p_toxic, toxic), a row for each row of `docs`.

    severity is the likeliest grade, p_toxic the probability of grade 1 or more,
    and toxic says that it is at least one half.  A null or empty text has no words
    and gets what the thresholds alone say.  A null id is not held out.  Of several
    labels of one id the largest counts.  Without a toxic label the severity is
    about 0.  Repeated rows repeat, an empty table gives no rows, and other columns
    are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col, per_class, graded)
    held_out = F.coalesce(id_hash(f"`{id_col}`", FOLDS) == HELD_OUT, F.lit(False))
    fields = "expected_severity double, severity int, p_toxic double, toxic boolean"
    made = text_function(lambda texts: graded_texts(texts, model), fields, F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.alias("held_out"), made.alias("made"))
    return rows.select("doc_id", "held_out", "made.*")


def graded_texts(texts: pa.Array, model: Ordinal) -> list[pa.Array]:
    """(expected severity, likeliest grade, probability of grade 1 or more, whether that is at least one half) of each text."""
    above = np.concatenate([np.zeros((0, len(model.thresholds))), *[model.above(b) for b in blocks(texts)]])
    each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
    return [pa.array(x) for x in (above.sum(axis=1), each.argmax(axis=1).astype(np.int32), above[:, 0], above[:, 0] >= 0.5)]


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
