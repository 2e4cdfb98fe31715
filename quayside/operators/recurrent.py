"""A recurrent text classifier that trains in the executors.

Word numbers go through an embedding, a long short-term memory and the mean of its
states over a text's words to one logit.  Training is synchronous and parallel over
rows: a barrier stage runs one task a worker, each holds its part of the rows and the
whole model and sends the gradients of its share of a batch to the first worker, which
sends back their sum in the order of ranks; every worker then takes the same step, so all
models stay equal and reruns agree.  They go by a connection of each worker to the first,
since a gathering of the barrier waits for a second; it only tells the address.  Only the
first worker gives its model to the driver.  A lost task restarts the stage from the same
seed.

A fit takes all rows: each worker lays its part into a file of its own, from which a
batch is read where it lies, so memory holds a label and a place a row.  Scoring covers
every row too, in numpy batches in the executors.
"""

from __future__ import annotations

import math
import secrets
import socket
import struct
import tempfile
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the network's sizes and its training
EMBEDDING, HIDDEN = 64, 64
EPOCHS, BATCH, RATE, SEED = 3, 128, 1e-3, 1394
PAD = 0
#: Rows that a worker lays into its file at a time.
LAID = 4096
#: Workers of a fit at most; a barrier stage needs as many free slots at once.
WORKERS = 8
#: Seconds that a worker waits for another; the slowest step takes far less.
WAIT = 600.0

Weights = dict[str, np.ndarray]


def initial(vocabulary: int, embedding: int = EMBEDDING, hidden: int = HIDDEN, seed: int = SEED, dtype=np.float32) -> Weights:
    rng, bound = np.random.default_rng(seed), 1 / math.sqrt(hidden)
    made = {"embedding": rng.normal(size=(vocabulary, embedding))}
    made |= {name: rng.uniform(-bound, bound, shape) for name, shape in (("input", (embedding, 4 * hidden)), ("state", (hidden, 4 * hidden)), ("bias", 4 * hidden), ("out", hidden), ("offset", 1))}
    made["embedding"][PAD] = 0
    return {name: w.astype(dtype) for name, w in made.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _trimmed(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns that hold words, which of them do, and each row's share of a word in its mean."""
    inside = seq != PAD
    width = int(np.flatnonzero(inside.any(axis=0))[-1]) + 1 if inside.any() else 0
    inside = inside[:, :width]
    return seq[:, :width], inside, 1 / np.maximum(inside.sum(axis=1), 1)


def _forward(w: Weights, seq: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits of padded rows, and what the way back needs."""
    seq, inside, share = _trimmed(seq)
    n, width = seq.shape
    size = len(w["out"])
    x = w["embedding"][seq]
    driven = x @ w["input"] + w["bias"]
    kind = w["out"].dtype
    gates, cells, states = (np.zeros((width, n, k), kind) for k in (4 * size, size, size))
    h, c, mean = (np.zeros((n, size), kind) for _ in range(3))
    for t in range(width):
        z = driven[:, t] + h @ w["state"]
        g = gates[t]
        g[:, : 2 * size] = _sigmoid(z[:, : 2 * size])  # in, forget
        g[:, 2 * size : 3 * size] = np.tanh(z[:, 2 * size : 3 * size])  # candidate
        g[:, 3 * size :] = _sigmoid(z[:, 3 * size :])  # out
        c = g[:, size : 2 * size] * c + g[:, :size] * g[:, 2 * size : 3 * size]
        h = g[:, 3 * size :] * np.tanh(c)
        cells[t], states[t] = c, h
        mean += (inside[:, t] * share)[:, None].astype(kind) * h
    return mean @ w["out"] + w["offset"][0], {"seq": seq, "inside": inside, "share": share, "x": x, "gates": gates, "cells": cells, "states": states, "mean": mean}


def logits(w: Weights, seq: np.ndarray) -> np.ndarray:
    return _forward(w, seq)[0]


def loss_and_gradient(w: Weights, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The summed log loss of the rows and its gradient; that of the embedding as rows of the words that occur."""
    z, kept = _forward(w, seq)
    loss = float((np.logaddexp(0, z) - label * z).sum())
    kind, size = w["out"].dtype, len(w["out"])
    dz = (_sigmoid(z) - label).astype(kind)
    gates, cells, states, inside = kept["gates"], kept["cells"], kept["states"], kept["inside"]
    width, n = gates.shape[:2]
    out = {"out": kept["mean"].T @ dz, "offset": np.array([dz.sum()], kind), "state": np.zeros_like(w["state"])}
    at_mean = dz[:, None] * w["out"]
    dh, dc, driven = np.zeros((n, size), kind), np.zeros((n, size), kind), np.zeros((n, width, 4 * size), kind)
    for t in reversed(range(width)):
        g = gates[t]
        i, f, a, o = (g[:, k * size : (k + 1) * size] for k in range(4))
        dh = dh + (inside[:, t] * kept["share"])[:, None].astype(kind) * at_mean
        bent = np.tanh(cells[t])
        dc = dc + dh * o * (1 - bent**2)
        before = cells[t - 1] if t else np.zeros_like(dc)
        d = driven[:, t]
        d[:, :size] = dc * a * i * (1 - i)
        d[:, size : 2 * size] = dc * before * f * (1 - f)
        d[:, 2 * size : 3 * size] = dc * i * (1 - a**2)
        d[:, 3 * size :] = dh * bent * o * (1 - o)
        if t:
            out["state"] += states[t - 1].T @ d
        dh, dc = d @ w["state"].T, dc * f
    flat = driven.reshape(n * width, 4 * size)
    out["bias"] = flat.sum(axis=0)
    out["input"] = kept["x"].reshape(n * width, -1).T @ flat
    words, place = np.unique(kept["seq"], return_inverse=True)
    rows = np.zeros((len(words), w["embedding"].shape[1]), kind)
    np.add.at(rows, place.ravel(), flat @ w["input"].T)
    some = words != PAD
    return loss, out | {"words": words[some].astype(np.int32), "rows": rows[some]}


DENSE = ("input", "state", "bias", "out", "offset")


def packed(n: int, loss: float, gradient: dict[str, np.ndarray]) -> bytes:
    """One worker's message: rows, loss, words, their rows and the dense gradients, in single precision."""
    words = gradient["words"]
    parts = [np.array([n, len(words)], np.int64), np.array([loss]), words, gradient["rows"].astype(np.float32), *[gradient[k].astype(np.float32) for k in DENSE]]
    return b"".join(p.tobytes() for p in parts)


def summed(messages: list[bytes], w: Weights) -> tuple[int, float, dict[str, np.ndarray]]:
    """Rows, loss and dense gradients over all workers, in the order of ranks."""
    rows, loss, total = 0, 0.0, {k: np.zeros_like(v) for k, v in w.items()}
    for data in messages:
        n, words = np.frombuffer(data, np.int64, 2)
        rows, loss, at = rows + int(n), loss + float(np.frombuffer(data, np.float64, 1, 16)[0]), 24
        which = np.frombuffer(data, np.int32, words, at)
        at += which.nbytes
        part = np.frombuffer(data, np.float32, int(words) * w["embedding"].shape[1], at).reshape(int(words), w["embedding"].shape[1])
        at += part.nbytes
        total["embedding"][which] += part
        for k in DENSE:
            part = np.frombuffer(data, np.float32, w[k].size, at).reshape(w[k].shape)
            at += part.nbytes
            total[k] += part
    return rows, loss, total


def _send(to: socket.socket, data: bytes) -> None:
    to.sendall(struct.pack("<q", len(data)) + data)


def _receive(source: socket.socket) -> bytes:
    def read(n: int) -> bytearray:
        data, at = bytearray(n), 0
        while at < n:
            got = source.recv_into(memoryview(data)[at:])
            if not got:
                raise ConnectionError("a worker has gone")
            at += got
        return data

    return bytes(read(struct.unpack("<q", read(8))[0]))


class Exchange:
    """Sums over the workers of one barrier stage: the first takes a message of each other, adds them up in the order of ranks and sends all the sum."""

    def __init__(self, context: BarrierTaskContext, rank: int, workers: int, wait: float = WAIT):
        self.rank, self.others = rank, []
        if workers == 1:
            return
        host = context.getTaskInfos()[0].address.rsplit(":", 1)[0].strip("[]")
        taker = socket.create_server(("", 0)) if rank == 0 else None
        told = context.allGather(f"{taker.getsockname()[1]} {secrets.token_hex(16)}" if taker else "")[0]
        port, token = told.split()
        if taker:
            taker.settimeout(wait)
            met: dict[int, socket.socket] = {}
            with taker:
                while len(met) < workers - 1:
                    other, _ = taker.accept()
                    other.settimeout(wait)
                    word = other.recv(64, socket.MSG_WAITALL).decode(errors="replace")
                    if word[:32] == token:  # who does not know the word is no worker
                        met[int(word[32:])] = other
                    else:
                        other.close()
            self.others = [met[r] for r in range(1, workers)]
        else:
            first = socket.create_connection((host, int(port)), wait)
            first.sendall(f"{token}{rank:032d}".encode())
            self.others = [first]
        for other in self.others:
            other.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def sum(self, message: bytes, w: Weights) -> tuple[int, float, dict[str, np.ndarray]]:
        if self.rank:
            _send(self.others[0], message)
            return summed([_receive(self.others[0])], w)
        rows, loss, total = summed([message, *map(_receive, self.others)], w)
        if self.others:
            words = np.flatnonzero(total["embedding"].any(axis=1)).astype(np.int32)
            back = packed(rows, loss, {**{k: total[k] for k in DENSE}, "words": words, "rows": total["embedding"][words]})
            for other in self.others:
                _send(other, back)
        return rows, loss, total

    def close(self) -> None:
        for other in self.others:
            other.close()


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.rate, self.steps = rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def step(self, w: Weights, gradient: Weights) -> None:
        self.steps += 1
        scale = self.rate * math.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in gradient.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            w[k] -= scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)


def _laid(rows: Iterator) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, labels) of a worker's rows, the numbers mapped from a file that goes when they do."""
    labels, width = [np.zeros(0, np.float32)], 0
    with tempfile.TemporaryFile() as file:
        for some in batched(rows, LAID):
            seq = np.array([r["seq"] for r in some], np.int32)
            if len(labels) > 1 and seq.shape[1:] != (width,):
                raise ValueError("rows are not padded to one width")
            width = seq.shape[1]
            file.write(seq.tobytes())
            labels.append(np.array([r["label"] for r in some], np.float32))
        file.flush()
        label = np.concatenate(labels)
        if not len(label) or not width:
            return np.zeros((len(label), width), np.int32), label
        return np.memmap(file, np.int32, "r", shape=(len(label), width)), label


def _worker(vocabulary: int, sizes: dict[str, int], epochs: int, batch: int, rate: float, seed: int, workers: int):
    def train(rows: Iterator) -> Iterator[tuple[int, float, dict[str, bytes] | None]]:
        context = BarrierTaskContext.get()
        rank = context.partitionId()
        seq, label = _laid(rows)
        share = max(1, batch // workers)
        steps = max(-(-int(m) // share) for m in context.allGather(str(len(label))))
        w = initial(vocabulary, seed=seed, **sizes)
        adam, rng, exchange = Adam(w, rate), np.random.default_rng((seed, rank)), Exchange(context, rank, workers)
        for epoch in range(epochs):
            order, n, total = rng.permutation(len(label)), 0, 0.0
            for s in range(steps):
                some = order[s * share : (s + 1) * share]
                mine = loss_and_gradient(w, seq[some], label[some]) if len(some) else (0.0, {"words": np.zeros(0, np.int32), "rows": np.zeros(0, np.float32), **{k: np.zeros_like(w[k]) for k in DENSE}})
                count, loss, gradient = exchange.sum(packed(len(some), *mine), w)
                adam.step(w, {k: g / max(count, 1) for k, g in gradient.items()})
                n, total = n + count, total + loss
            if rank == 0:
                yield epoch + 1, total / max(n, 1), {k: v.tobytes() for k, v in w.items()} if epoch + 1 == epochs else None
        exchange.close()

    return train


def fit_recurrent(
    rows: DataFrame, vocabulary: int, embedding: int = EMBEDDING, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED,
    workers: int | None = None, most_rows: int | None = None,
) -> tuple[Weights, list[float]]:
    """(weights, mean loss of each epoch) over `rows`, which has seq, padded word numbers under `vocabulary`, and label, 0 or 1.

    Rows with a null in either are left out; without rows the weights are the first ones and losses 0.
    Only a caller who gives `most_rows` has about so many drawn, by a hash.
    """
    sc = rows.sparkSession.sparkContext
    known = rows.select("seq", F.col("label").cast("double").alias("label")).filter("seq IS NOT NULL AND label IS NOT NULL")
    like = initial(vocabulary, embedding, hidden, seed)
    rows_known = known.count()
    if not rows_known:
        return like, [0.0] * epochs
    share = 1.0 if most_rows is None else min(1.0, most_rows / rows_known)
    drawn = known if share == 1.0 else known.filter(F.pmod(F.xxhash64(F.lit(seed), "seq", "label"), F.lit(1_000_000)) < int(share * 1_000_000))
    n = workers or max(1, min(WORKERS, sc.defaultParallelism))
    dealt = drawn.withColumn("at", F.xxhash64(F.lit(seed), "seq")).repartition(n, "at").sortWithinPartitions("at").select("seq", "label")
    sizes = {"embedding": embedding, "hidden": hidden}
    made = dealt.rdd.barrier().mapPartitions(_worker(vocabulary, sizes, epochs, batch, rate, seed, n)).collect()  # the first worker's model and a loss an epoch
    last = next(w for _, _, w in made if w)
    return {k: np.frombuffer(v, np.float32).reshape(like[k].shape) for k, v in last.items()}, [loss for _, loss, _ in sorted(made, key=lambda x: x[0])]


def scorer(weights: Weights) -> Callable[[], Callable]:
    """A factory of a numpy scorer of padded sequences, loaded once a Python worker: the probability of class 1."""

    def make() -> Callable:
        def predict(inputs):
            return _sigmoid(logits(weights, np.asarray(inputs, np.int64)).astype(np.float64))

        return predict

    return make
