"""Line quality with a linear-chain conditional random field (operator 2).

Every line of a text is good or bad.  A line's features are its own, its
predecessor's and its successor's counts and ratios; the chain adds weights for
each pair of neighbouring states.  Forward-backward gives every line's marginal,
and the mean over a document's lines, weighted by their length, is calibrated to a
probability on the training documents.

Labels are of documents, so the lines of a bad one are latent: a document is good
if all its lines are, and bad if one at least is not.  The model first takes all
lines of bad documents for bad and then maximises the likelihood of the documents'
labels by expectation and maximisation.  So that states change inside a chain as
well, each bad training document is also seen between the halves of a good one.

The model is fitted on a sample of at most about `per_class` labelled documents
of each class, drawn by a hash of the id, whose texts hold at most `most_chars`
characters; the bounds do not grow with the input.  Training and scoring read whole
texts.  A chain's messages are passed in about the square root of its lines in
steps, and no feature matrix of a text is made, so that a text of millions of lines
costs some hundred bytes a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import (
    IS_CHAR_START,
    IS_DIGIT,
    IS_LETTER,
    IS_LOWER,
    IS_SPACE,
    IS_SYMBOL,
    IS_UPPER,
    Block,
    SpanHash,
    blocks,
    bound_batches,
    byte_class,
    id_hash,
    labelled_sample,
    mix,
    read_table,
    run_starts,
    text_function,
)

PER_CLASS = 4000
MOST_CHARS = 16_000_000
#: Characters that a line of the sample counts for at least, so that it holds 80,000 lines a class at most.
LINE_CHARS = 200
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
N_OWN = 15
#: A chain of more lines is passed along in pieces.
LONG_CHAIN = 1024
#: Rounds of fitting with all lines of bad documents bad, then with latent ones.
ROUNDS, LATENT_ROUNDS = 60, 30
#: Log odds that stand for certainty.
SURE = 60.0

_PUNCT = byte_class(b".,;:?'\"()-")
_LOUD = byte_class(b"!")


def own_features(block: Block) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray]:
    """(a column for each of the N_OWN features, document, length in characters) of every line of a block."""
    data = block.data
    a, b, doc = block.lines()
    n = len(a)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[b] - sums[a]).astype(np.float64)

    chars = count(IS_CHAR_START[data])

    def columns() -> Iterator[np.ndarray]:
        per = lambda x, y: np.divide(x, y, out=np.zeros(n), where=y > 0)
        starts, ends = block.words()
        line = np.searchsorted(a, starts, side="right") - 1
        words = np.bincount(line, minlength=n)[:n].astype(np.float64)
        yield np.log1p(words) / 5
        yield np.minimum(words, 5) / 5
        yield (words == 0).astype(np.float64)
        yield np.log1p(chars) / 7
        for marks in (IS_SYMBOL, _PUNCT, _LOUD):
            yield np.minimum(per(count(marks[data]), words), 3)
        solid = count(~IS_SPACE[data] & IS_CHAR_START[data])
        yield np.minimum(per(solid, words), 30) / 10
        yield per(count(IS_DIGIT[data]), solid)
        yield per(count(IS_LETTER[data] & IS_CHAR_START[data]), solid)
        upper = count(IS_UPPER[data])
        yield per(upper, upper + count(IS_LOWER[data]))
        yield per(np.bincount(line, weights=(ends - starts) <= 3, minlength=n)[:n], words)
        spans = SpanHash(data)
        word = spans.of(starts, ends)
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
        yield per(np.bincount(line, weights=same, minlength=n)[:n], words)
        _, first = np.unique(mix(word ^ mix(line.astype(np.uint64) + np.uint64(1))), return_index=True)
        yield 1 - per(np.bincount(line[first], minlength=n)[:n], words)
        _, first = np.unique(mix(spans.of(a, b) ^ mix(doc.astype(np.uint64) + np.uint64(7))), return_index=True)
        again = np.ones(n)
        again[first] = 0
        yield again

    return columns(), doc, chars


N_FEATURES = 3 * N_OWN + 3


@dataclass
class Chain:
    """Weights of a line's own, its predecessor's and its successor's features, of any, a first and a last line, of (from, to) states and of the first state, and the calibration."""

    weights: np.ndarray
    pair: np.ndarray
    start: float
    slope: float = 1.0
    shift: float = 0.0


def potentials(columns: Iterator[np.ndarray], doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of the good state that a line's features give it, column by column."""
    n = len(doc)
    own, before, after = np.zeros(n), np.zeros(n), np.zeros(n)
    for j, x in enumerate(columns):
        own += weights[j] * x
        before += weights[N_OWN + j] * x
        after += weights[2 * N_OWN + j] * x
    opens = run_starts(doc)
    closes = np.append(opens[1:], True)[:n]
    own += weights[-3]
    own[opens] += weights[-2]
    own[closes] += weights[-1]
    own[1:][~opens[1:]] += before[:-1][~opens[1:]]
    own[:-1][~closes[:-1]] += after[1:][~closes[:-1]]
    return own


def carried(e: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of the forward messages, log of the bad state's message) along each row of `e`, from `first` at its first column."""
    (t00, t01), (t10, t11) = pair
    odds, bad = np.empty_like(e), np.zeros_like(e)
    odds[:, 0] = first
    for t in range(1, e.shape[1]):
        f = odds[:, t - 1]
        low = np.logaddexp(t10 + f, t00)
        odds[:, t] = e[:, t] + np.logaddexp(t11 + f, t01) - low
        bad[:, t] = bad[:, t - 1] + low
    return odds, bad


def carried_far(e: np.ndarray, pair: np.ndarray, first: float) -> np.ndarray:
    """The same log odds along one long chain: the map of each piece, then the odds at the pieces' ends, then those within."""
    (t00, t01), (t10, t11) = pair
    rest = e[1:]
    size = max(1, int(np.sqrt(len(rest))))
    pieces = -(-len(rest) // size)
    grid = np.zeros(pieces * size)
    grid[: len(rest)] = rest
    grid = grid.reshape(pieces, size)
    ends = []
    for low, high in ((t00, t01), (t10, t11)):  # from each state before a piece
        a, b = np.full(pieces, low), high + grid[:, 0]
        for t in range(1, size):
            a, b = np.logaddexp(a + t00, b + t10), np.logaddexp(a + t01, b + t11) + grid[:, t]
        ends.append((a, b))
    (a0, b0), (a1, b1) = ends
    enter = np.empty(pieces)
    f = first
    for k in range(pieces):
        enter[k] = f
        f = np.logaddexp(b0[k], f + b1[k]) - np.logaddexp(a0[k], f + a1[k])
    step = grid[:, 0] + np.logaddexp(t11 + enter, t01) - np.logaddexp(t10 + enter, t00)
    return np.concatenate([[first], carried(grid, pair, step)[0].ravel()[: len(rest)]])


def _groups(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Chains that are not long in groups of similar length, with the longest of each."""
    short = np.flatnonzero((lengths > 0) & (lengths <= LONG_CHAIN))
    scale = np.ceil(np.log2(np.maximum(lengths[short], 1)))
    for g in np.unique(scale):
        of = short[scale == g]
        yield of, int(lengths[of].max())


def passed(u: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward log odds, backward log odds with a line's own, log of the partition sum of each chain of usual length).

    Works on log odds of good over bad; the backward messages are the forward ones of the reversed chain.
    """
    ahead, back, total = np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(lengths))
    for of, longest in _groups(lengths):
        steps = np.arange(longest)[None, :]
        real = steps < lengths[of][:, None]
        last = lengths[of] - 1
        at = starts[of][:, None] + np.minimum(steps, last[:, None])
        e = u[at]
        odds, bad = carried(e, chain.pair, e[:, 0] + chain.start)
        ahead[at[real]] = odds[real]
        rows = np.arange(len(of))
        total[of] = bad[rows, last] + np.logaddexp(0, odds[rows, last])
        at = starts[of][:, None] + np.maximum(last[:, None] - steps, 0)
        e = u[at]
        back[at[real]] = carried(e, chain.pair.T, e[:, 0])[0][real]
    for k in np.flatnonzero(lengths > LONG_CHAIN):
        e = u[starts[k] : starts[k] + lengths[k]]
        ahead[starts[k] : starts[k] + lengths[k]] = carried_far(e, chain.pair, e[0] + chain.start)
        back[starts[k] : starts[k] + lengths[k]] = carried_far(e[::-1], chain.pair.T, e[-1])[::-1]
    return ahead, back, total


def marginals(u: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """Probability of the good state at each line."""
    ahead, back, _ = passed(u, starts, lengths, chain)
    return 1 / (1 + np.exp(-np.clip(ahead + back - u, -SURE, SURE)))


def expectations(u: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, probabilities of the (from, to) pairs that end at each line, log partition sums)."""
    ahead, back, total = passed(u, starts, lengths, chain)
    p = 1 / (1 + np.exp(-np.clip(ahead + back - u, -SURE, SURE)))
    (t00, t01), (t10, t11) = chain.pair
    f = np.concatenate([[0.0], ahead[:-1]])
    w = np.stack([np.full(len(u), t00), t01 + back, t10 + f, t11 + f + back])
    w = np.exp(w - w.max(axis=0))
    w /= w.sum(axis=0)
    w[:, starts[lengths > 0]] = 0
    return p, w, total


def spliced(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of `x` one after another, chain lengths, whether each line is known to be good) of every chain and of each bad one between the halves of a good one."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rows, sizes, known = [np.arange(len(x))], [lengths], [np.repeat(label == 1, lengths)]
    for k, b in enumerate(bad):
        g = good[k % len(good)]
        middle = starts[g] + (lengths[g] + 1) // 2
        rows.append(np.concatenate([np.arange(starts[g], middle), np.arange(starts[b], starts[b] + lengths[b]), np.arange(middle, starts[g] + lengths[g])]))
        sizes.append([lengths[g] + lengths[b]])
        sure = np.ones(lengths[g] + lengths[b], bool)
        sure[middle - starts[g] : middle - starts[g] + lengths[b]] = False
        known.append(sure)
    return np.concatenate(rows), np.concatenate(sizes).astype(np.int64), np.concatenate(known)


def fit_chain(
    x: np.ndarray, lengths: np.ndarray, label: np.ndarray, size: np.ndarray, weight: np.ndarray | None = None, rounds: int = ROUNDS,
    latent_rounds: int = LATENT_ROUNDS, l2: float = 1.0,
) -> Chain:
    """Maximum likelihood by Adam on a bounded sample.

    `x` has the own features of all lines, `lengths` the lines of each document, `label` its class, `size` the lines'
    characters and `weight` how many documents each stands for, which the calibration goes by.
    """
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = (x - mean) / scale
    rows, chains, known = spliced(z, begins, lengths, label)
    z = z[rows]
    starts = np.concatenate([[0], np.cumsum(chains)[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(chains)), chains)
    opens, closes = run_starts(of), np.append(run_starts(of)[1:], True)
    mixed = np.bincount(of, weights=~known, minlength=len(chains)) > 0  # chains with lines not known to be good
    inner = ~opens
    theta = np.zeros(N_FEATURES + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + latent_rounds + 1):
        chain = Chain(theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1])
        u = potentials(iter(z.T), of, chain.weights)
        p, pairs, total = expectations(u, starts, chains, chain)
        if step <= rounds:
            y = known.astype(np.float64)
            now, then = y[1:], y[:-1]
            wanted = np.zeros_like(pairs)
            wanted[:, 1:] = np.stack([(1 - then) * (1 - now), (1 - then) * now, then * (1 - now), then * now]) * inner[1:]
        else:  # given that lines known to be good are, and that one line of a bad document is not
            held = np.where(known, u + SURE, u)
            y, wanted, sums = expectations(held, starts, chains, chain)
            path = np.bincount(of, weights=held, minlength=len(chains)) + chain.start + (chains - 1) * chain.pair[1, 1]
            share = np.where(mixed, np.exp(np.minimum(path - sums, 0)), 0)
            share = np.minimum(share, 1 - 1e-6)[of]  # probability that all lines are good
            y = (y - share) / (1 - share)
            wanted[3] -= share * inner
            wanted /= 1 - share
        rest = y - p
        spread = np.concatenate([z.T @ rest, z[:-1].T @ (rest[1:] * inner[1:]), z[1:].T @ (rest[:-1] * inner[1:])])
        edges = [rest.sum(), rest[opens].sum(), rest[closes].sum()]
        grad = np.concatenate([spread, edges, (wanted - pairs).sum(axis=1), [rest[opens].sum()]]) - l2 * theta
        grad /= len(chains)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    parts = theta[: 3 * N_OWN].reshape(3, N_OWN)
    off = parts @ (mean / scale)
    edges = theta[3 * N_OWN : N_FEATURES] + [-off.sum(), off[1], off[2]]  # a first line has no predecessor, a last one no successor
    chain = Chain(np.concatenate([(parts / scale).ravel(), edges]), theta[-5:-1].reshape(2, 2), float(theta[-1]))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    raw = pooled(marginals(potentials(iter(x.T), doc, chain.weights), begins, lengths, chain), doc, size, len(lengths))
    chain.slope, chain.shift = _calibrated(raw, label, np.ones(len(label)) if weight is None else weight)
    return chain


def pooled(p: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Mean of the lines' marginals, weighted by their length."""
    weight = np.maximum(size, 0.01)
    return np.bincount(doc, weights=weight * p, minlength=n)[:n] / np.bincount(doc, weights=weight, minlength=n)[:n]


def _odds(raw: np.ndarray) -> np.ndarray:
    raw = np.clip(raw, 1e-3, 1 - 1e-3)
    return np.log(raw / (1 - raw))


def _calibrated(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a light ridge."""
    z = np.stack([_odds(raw), np.ones(len(raw))], axis=1)
    weight = weight / weight.mean()
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-2
        w = w + np.linalg.solve(hess, z.T @ (weight * (label - p)) - 1e-2 * w)
    return max(float(w[0]), 1e-6), float(w[1])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(1)):
            columns, doc, chars = own_features(b)
            x = np.stack([c.astype(np.float32) for c in columns], axis=1)
            at = np.searchsorted(doc, np.arange(b.n + 1))
            rows, sizes = ([v[i:j].astype(np.float32).tobytes() for i, j in zip(at, at[1:], strict=False)] for v in (x, chars))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(b.first, b.n), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], ["label", "x", "size"]
            )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS,
    most_chars: int = MOST_CHARS,
) -> Chain | None:
    """A chain fitted on a bounded sample of the labelled rows that are not held out; None if a class has none."""
    bound_batches(docs.sparkSession)
    label = F.col(f"`{label_col}`").cast("int")
    known = (
        labels.filter(label.isin(0, 1) & (id_hash(f"`{id_col}`", FOLDS) != HELD_OUT))
        .groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label).alias("class"))
    )
    sample, weights = labelled_sample(docs, known, id_col, text_col, per_class, most_chars, 2, LINE_CHARS)
    rows = sample.mapInArrow(_trained, "label int, x binary, size binary").collect()  # of most_chars characters a class at most
    if {r["label"] for r in rows} != {0, 1}:
        return None
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, N_OWN) for r in rows]
    return fit_chain(
        np.concatenate(xs).astype(np.float64), np.array([len(x) for x in xs]), np.array([r["label"] for r in rows]),
        np.concatenate([np.frombuffer(r["size"], np.float32) for r in rows]).astype(np.float64), np.array([weights[r["label"]] for r in rows]),
    )


def score_block(block: Block, chain: Chain | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, marginal of each line, text of each line)."""
    if chain is None:
        _, _, doc = block.lines()
        return np.ones(block.n), np.ones(len(doc)), doc
    columns, doc, chars = own_features(block)
    starts = np.searchsorted(doc, np.arange(block.n))
    lengths = np.bincount(doc, minlength=block.n)
    p = marginals(potentials(columns, doc, chain.weights), starts, lengths, chain)
    odds = chain.slope * _odds(pooled(p, doc, chars, block.n)) + chain.shift
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60))), p, doc


def scored(texts: pa.Array, chain: Chain | None, lines: bool) -> list[pa.Array]:
    """The texts' scores and, with `lines`, the marginals of their lines."""
    score, marks = [np.zeros(0)], []
    for b in blocks(texts):
        s, p, doc = score_block(b, chain)
        score.append(s)
        if lines:
            marks += np.split(p, np.searchsorted(doc, np.arange(1, b.n)))
    return [pa.array(np.concatenate(score))] + ([pa.array(marks, pa.list_(pa.float64()))] if lines else [])


def score_column(spark, chain: Chain | None, text: F.Column, lines: bool = False) -> F.Column:
    """A struct (score, lines) of each text."""
    bound_batches(spark)
    return text_function(lambda texts: scored(texts, chain, lines), "score double" + ", lines array<double>" * lines, text)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = PER_CLASS,
    lines: bool = False,
) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs`; with `lines` also each line's probability to be good.

    A null text counts as empty, and an empty text is one empty line, which the
    model scores like any other.  A null id is not held out.  Of several labels of
    one id the largest counts; other labels than 0 and 1 do not.  Without labels of
    both classes every score is 1.  Repeated rows repeat, an empty table gives no
    rows, and other columns are not read.
    """
    chain = train(docs, labels, id_col, text_col, label_col, per_class)
    held_out = F.coalesce(id_hash(f"`{id_col}`", FOLDS) == HELD_OUT, F.lit(False))
    made = score_column(docs.sparkSession, chain, F.col(f"`{text_col}`"), lines)
    out = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.alias("held_out"), made.alias("made"))
    score = F.col("made.score")
    return out.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), *[F.col("made.lines").alias("line_good")] * lines)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that are predicted good, with the columns that `docs` has.

    Nulls, empty texts and a lack of labels count as in quality_scores().  Equal rows
    have one score, so they stay or go together; an empty table stays empty, and
    columns of any other names pass through.
    """
    chain = train(docs, labels, id_col, text_col, label_col)
    made = docs.withColumn("\x00made", score_column(docs.sparkSession, chain, F.col(f"`{text_col}`")))
    return made.filter(F.col("\x00made")["score"] >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality_crf(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
