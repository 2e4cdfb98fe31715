"""SentencePiece encoding and decoding by batched Viterbi (operator 9).

A vocabulary of pieces with scores is read from a SentencePiece model file; a
text's encoding is the segmentation with the largest sum of scores.  A space is
part of the word that follows it, and no piece holds a space after another
character or a line feed.  Nor does a piece cross a place where no piece of the
vocabulary has such a pair of characters, as between most Han characters.  So the
best segmentation of a text is that of the stretches between these places one by
one, and distinct stretches of a block are encoded once.  All stretches of a
length advance together: rolling hashes of every substring probe sorted piece keys
of its length, a second hash confirms, and one vectorised maximum per position over
the piece lengths stores the backpointers.  A stretch of over LONG characters, such
as an endless word, has few of its length to advance with: its pieces are found by
the same probes, and one pass over them alone finds the same path.  A character in
no piece becomes byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import IS_CHAR_START, SpanHash, blocks, bound_batches, mix, read_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The character that stands for a space in pieces.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: Characters of a stretch beyond which it goes alone.
LONG = 64
#: Bytes of text of a block.
TEXT_BYTES = 1 << 20
#: Characters of stretches that advance together.
STEP_CHARS = 200_000


@dataclass
class Pieces:
    """Pieces by length with sorted keys, their ids and scores, the byte pieces, every id's bytes, and which characters follow each other in a piece."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    byte_ids: np.ndarray
    surface: list[bytes]
    unknown: float
    kinds: np.ndarray  # of each code point, 0 for those in no piece of several characters
    joined: np.ndarray  # whether a kind follows another
    longest: int = field(init=False)
    flat: np.ndarray = field(init=False)
    ends: np.ndarray = field(init=False)

    def __post_init__(self):
        self.longest = max(self.by_length)
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.ends = np.cumsum([len(s) for s in self.surface])


def _keys(points: np.ndarray, base: int) -> np.ndarray:
    """Hash of each row of code points, by Horner's rule."""
    out = np.zeros(points.shape[0], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(points.shape[1]):
            out = out * np.uint64(base) + mix(points[:, j].astype(np.uint64) + np.uint64(1))
    return out


def make_pieces(entries: list[tuple[int, str, float]], byte_ids: dict[int, int], size: int) -> Pieces:
    """From (id, piece, score), the id of each byte and the number of ids."""
    for _, piece, _ in entries:
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses words")
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no piece for every byte")
    surface = [b""] * size
    for i, piece, _ in entries:
        surface[i] = piece.replace(SPACE, " ").encode()
    for byte, i in byte_ids.items():
        surface[i] = bytes([byte])
    by_length = {}
    for n in sorted({len(p) for _, p, _ in entries}):
        of = [e for e in entries if len(e[1]) == n]
        points = np.frombuffer("".join(p for _, p, _ in of).encode("utf-32-le"), np.uint32).reshape(-1, n)
        first, second = (_keys(points, b) for b in BASES)
        order = np.argsort(first)
        ids, scores = np.array([e[0] for e in of], np.int32), np.array([e[2] for e in of], np.float64)
        by_length[n] = first[order], second[order], ids[order], scores[order]
    least = min((s for _, _, s in entries), default=0.0)
    chars = sorted({c for _, p, _ in entries if len(p) > 1 for c in p})
    kinds = np.zeros(0x110000, np.uint16)
    kinds[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    pairs = {two for _, p, _ in entries for two in zip(p, p[1:], strict=False)}
    joined[[kinds[ord(a)] for a, _ in pairs], [kinds[ord(b)] for _, b in pairs]] = True
    return Pieces(by_length, np.array([byte_ids[b] for b in range(256)], np.int32), surface, least - UNKNOWN_PENALTY, kinds, joined)


def load_pieces(path: str = MODEL) -> Pieces:
    """Read on the driver; executors get the arrays."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    entries = [(i, model.id_to_piece(i), model.get_score(i)) for i in plain]
    byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
    return make_pieces(entries, byte_ids, size)


def _hits(points: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(piece length, whether a piece begins at each place, its scores, its ids) in rows of equal length."""
    n = points.shape[1]
    value = mix(points.astype(np.uint64) + np.uint64(1))
    rolled = [np.zeros(points.shape, np.uint64) for _ in BASES]
    for k in range(1, min(n, pieces.longest) + 1):
        with np.errstate(over="ignore"):
            for r, base in zip(rolled, BASES, strict=True):  # row i becomes the hash of the k characters from i on
                r[:, : n - k + 1] = r[:, : n - k + 1] * np.uint64(base) + value[:, k - 1 :]
        if k not in pieces.by_length:
            continue
        first, second, ids, scores = pieces.by_length[k]
        sub = rolled[0][:, : n - k + 1]
        at = np.minimum(np.searchsorted(first, sub), len(first) - 1)
        hit = (first[at] == sub) & (second[at] == rolled[1][:, : n - k + 1])
        if hit.any():
            yield k, hit, scores[at], ids[at]


def _viterbi(points: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(length of the last piece, its id) at each end position of stretches of one length; id -1 is an unknown character."""
    rows, n = points.shape
    best = np.full((rows, n + 1), -np.inf)
    best[:, 0] = 0
    length, ident = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int32)
    score_at, id_at = {}, {}
    for k, hit, scores, ids in _hits(points, pieces):
        score_at[k], id_at[k] = np.where(hit, scores, -np.inf), ids
    single = score_at.get(1, np.full((rows, n), -np.inf))
    lone = np.where(np.isfinite(single), single, pieces.unknown)
    lone_id = np.where(np.isfinite(single), id_at.get(1, -1), -1)
    for end in range(1, n + 1):
        top, size, made = best[:, end - 1] + lone[:, end - 1], np.ones(rows, np.int32), lone_id[:, end - 1].copy()
        for k, s in score_at.items():
            if 1 < k <= end:
                other = best[:, end - k] + s[:, end - k]
                better = other > top
                top = np.where(better, other, top)
                size[better] = k
                made[better] = id_at[k][better, end - k]
        best[:, end], length[:, end], ident[:, end] = top, size, made
    return length, ident


def _alone(points: np.ndarray, pieces: Pieces) -> tuple[list[int], list[int]]:
    """(starts, ids) of the pieces of one long stretch, by one pass over the pieces that it holds."""
    n = len(points)
    ends, sizes, scores, ids = [], [], [], []
    for k, hit, s, i in _hits(points[None, :], pieces):
        at = np.flatnonzero(hit[0])
        ends.append(at + k)
        sizes.append(np.full(len(at), k))
        scores.append(s[0, at])
        ids.append(i[0, at])
    order = np.lexsort((np.concatenate(sizes), np.concatenate(ends))) if ends else np.zeros(0, np.int64)
    listed = zip(*[np.concatenate(x)[order].tolist() for x in (ends, sizes, scores, ids)], strict=True) if ends else iter(())
    best, length, ident = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
    end, unknown = 0, pieces.unknown
    for e, k, s, i in [*listed, (n + 1, 0, 0.0, 0)]:
        while end < min(e, n):
            end += 1
            best[end] = best[end - 1] + unknown
        if e <= n and (best[e - k] + s > best[e] or k == 1):
            best[e], length[e], ident[e] = best[e - k] + s, k, i
    starts, made, end = [], [], n
    while end:
        made.append(ident[end])
        end -= length[end]
        starts.append(end)
    return starts[::-1], made[::-1]


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in rows of four, how many) of code points."""
    p = points.astype(np.int64)
    size = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
    rest = lambda shift: 0x80 | (p >> shift & 0x3F)
    forms = [
        [p, 0 * p, 0 * p, 0 * p], [0xC0 | p >> 6, rest(0), 0 * p, 0 * p], [0xE0 | p >> 12, rest(6), rest(0), 0 * p], [0xF0 | p >> 18, rest(12), rest(6), rest(0)],
    ]
    return np.choose(size[:, None] - 1, [np.stack(f, axis=1) for f in forms]), size


def encode_stretches(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all stretches of `points` one after another, how many each has)."""
    probed = np.where(points == ord(SPACE), np.uint32(0x10FFFF), points)  # a literal one is in no piece
    probed = np.where(points == 32, np.uint32(ord(SPACE)), probed)
    of, place, ids = [], [], []  # stretch, first character, id; -1 for an unknown character
    for n in np.unique(sizes[sizes <= LONG]):
        group = np.flatnonzero(sizes == n)
        step = max(1, STEP_CHARS // int(n))
        for a in range(0, len(group), step):
            some = group[a : a + step]
            length, ident = _viterbi(probed[starts[some][:, None] + np.arange(n)], pieces)
            live, end = np.arange(len(some)), np.full(len(some), n)
            while len(live):
                made, size = ident[live, end], length[live, end]
                end = end - size
                of.append(some[live])
                place.append(starts[some[live]] + end)
                ids.append(made)
                live, end = live[end > 0], end[end > 0]
    for k in np.flatnonzero(sizes > LONG):
        begins, made = _alone(probed[starts[k] : starts[k] + sizes[k]], pieces)
        of.append(np.full(len(made), k))
        place.append(starts[k] + np.array(begins))
        ids.append(np.array(made))
    if not of:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    stretch, at, made = (np.concatenate(x) for x in (of, place, ids))
    order = np.lexsort((at, stretch))
    stretch, at, made = stretch[order], at[order], made[order]
    code, width = utf8(points[at])
    width = np.where(made < 0, width, 1)
    first = np.cumsum(width) - width
    turn = np.arange(int(width.sum())) - np.repeat(first, width)
    row = np.repeat(np.arange(len(made)), width)
    out = np.where(made[row] < 0, pieces.byte_ids[code[row, turn]], made[row]).astype(np.int32)
    return out, np.bincount(stretch, weights=width, minlength=len(sizes))[: len(sizes)].astype(np.int64)


def led(texts: pa.Array) -> pa.Array:
    """The texts with the space that the model puts first; a null or empty one stays as it is."""
    full = pc.greater(pc.binary_length(texts), 0)
    return pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), texts)


def encode_texts(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, how many each text has)."""
    all_ids, all_counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for block in blocks(led(texts), TEXT_BYTES):
        data, n = block.data, block.n
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            all_counts.append(np.zeros(n, np.int64))
            continue
        at = np.append(np.flatnonzero(IS_CHAR_START[data]), len(data))  # of each character
        kind = pieces.kinds[np.where(points == 32, np.uint32(ord(SPACE)), np.where(points == ord(SPACE), np.uint32(0x10FFFF), points))]
        opens = np.ones(len(points), bool)
        opens[1:] = ~pieces.joined[kind[:-1], kind[1:]]
        edges = np.searchsorted(at, block.bounds[:-1])
        opens[edges[edges < len(points)]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(points))
        _, first, which = np.unique(SpanHash(data).of(at[starts], at[ends]), return_index=True, return_inverse=True)
        ids, counts = encode_stretches(points, starts[first], (ends - starts)[first], pieces)
        begin = (np.cumsum(counts) - counts)[which]
        each = counts[which]
        offset = np.cumsum(each) - each
        all_ids.append(ids[np.repeat(begin - offset, each) + np.arange(int(each.sum()))])
        doc = np.searchsorted(edges, starts, side="right") - 1
        all_counts.append(np.bincount(doc, weights=each, minlength=n)[:n].astype(np.int64))
    return np.concatenate(all_ids), np.concatenate(all_counts)


def decode_bytes(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all lists of ids one after another, how many each has)."""
    ends = pieces.ends[ids]
    begins = np.where(ids > 0, pieces.ends[ids - 1], 0)
    sizes = ends - begins
    offset = np.cumsum(sizes) - sizes
    data = pieces.flat[np.repeat(begins - offset, sizes) + np.arange(int(sizes.sum()))]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return data, np.diff(upto[edges])


def decode_ids(ids: list[int] | np.ndarray, pieces: Pieces) -> str:
    """The text of some ids, without the space that encoding puts first; bytes that are no UTF-8 become U+FFFD."""
    data, _ = decode_bytes(np.asarray(ids, np.int64), np.array([len(ids)]), pieces)
    whole = data.tobytes()
    return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def matches(texts: pa.Array, ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Whether the ids of each text decode to it; a null has none."""
    want = led(texts).fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(want.buffers()[1], np.int64, len(want) + 1, want.offset * 8)
    wanted = np.frombuffer(want.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    data, sizes = decode_bytes(ids, counts, pieces)
    same = sizes == np.diff(bounds)
    if not same.all():
        offset = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(same):
            same[k] = np.array_equal(data[offset[k] : offset[k] + sizes[k]], wanted[bounds[k] - bounds[0] : bounds[k + 1] - bounds[0]])
        return same
    wrong = np.concatenate([[0], np.cumsum(data != wanted, dtype=np.int64)])
    return wrong[bounds[1:] - bounds[0]] == wrong[bounds[:-1] - bounds[0]]


def _encoded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    pieces = shared.value
    for batch in batches:
        texts = batch.column(1)
        ids, counts = encode_texts(texts, pieces)
        same = matches(texts, ids, counts, pieces)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        null = np.asarray(texts.is_null())
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(counts), pa.array(same)], ["doc_id", "ids", "n_tokens", "round_trip"])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip), a row for each row of `df`.

    ids is null for a null text and empty for an empty one; both have 0 tokens.
    round_trip says that decoding the ids gives the text back.  Of segmentations
    with equal scores the one with the shorter last pieces wins.  Repeated rows
    repeat, an empty table gives no rows, and other columns are not read.  The
    vocabulary, a few MB whatever the input, is broadcast.
    """
    spark = df.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(load_pieces(model))
    two = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return two.mapInArrow(lambda it: _encoded(it, shared), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text), a row for each row of `df`; a null list has a null text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_pieces(model))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, shared.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    two = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return two.mapInArrow(decoded, "doc_id long, text string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))
