"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad from its own features and those of the lines before
and after it. Forward-backward gives each line's marginal; a document's quality is the mean of the
marginals weighted by line length, put on a probability scale by a one-feature logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.llm.common import bound_batches, buffers, core, fold, mix, numbered, session, word_hashes

#: Bound on the labelled documents that the model is fitted on, and on the length of each.
TRAIN_DOCS, TRAIN_CHARS = 6000, 20_000
BINS, ROUNDS = 10, 120

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _COMMA, _SHOUT, _SYMBOL, _OTHER = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[128:] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in ".?"]] = _STOP
_CLASS[[ord(c) for c in ",;:'\"()-"]] = _COMMA
_CLASS[ord("!")] = _SHOUT
FEATURES = 15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1, 65537, dtype=np.uint64)) | np.uint64(1)


def _column(starts: np.ndarray, n: int) -> np.ndarray:
    """Place of every byte in its line, modulo 65536."""
    size = np.diff(np.append(starts, n))
    return (np.arange(n) - np.repeat(starts, size)) & 0xFFFF


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-blank line, the lines' lengths, and the n + 1 offsets of each text's lines."""
    flat, off = buffers(texts)
    n = len(flat)
    if n == 0:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    starts = np.unique(np.concatenate([off[:-1][off[:-1] < n], np.flatnonzero(flat == 10) + 1]))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    kind = _CLASS[flat]
    counts = np.stack([np.add.reduceat((kind == k).view(np.uint8), starts, dtype=np.int64) for k in range(9)], 1)
    wordy = kind != _SPACE
    begins = wordy.copy()
    begins[1:] &= ~wordy[:-1]
    begins[off[:-1][off[:-1] < n]] = wordy[off[:-1][off[:-1] < n]]
    words = np.add.reduceat(begins.view(np.uint8), starts, dtype=np.int64)
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(_BYTE[flat] * _PLACE[_column(starts, n)], starts)
    word, _, word_at, _ = word_hashes(texts, lower=False)
    line = np.searchsorted(starts, word_at, "right") - 1
    again = np.flatnonzero((word[1:] == word[:-1]) & (line[1:] == line[:-1])) + 1
    repeats = np.bincount(line[again], minlength=len(starts))
    tail = np.maximum.reduceat(np.where(wordy, np.arange(n), -1), starts)
    keep = np.flatnonzero(words > 0)
    starts, ends, counts, words, hashes, tail, repeats = starts[keep], ends[keep], counts[keep], words[keep], hashes[keep], tail[keep], repeats[keep]
    lines = np.searchsorted(starts, off).astype(np.int64)
    size = (ends - starts).astype(np.float64)
    letters = counts[:, _LOWER] + counts[:, _UPPER] + counts[:, _OTHER]
    solid = np.flatnonzero(wordy)
    first = kind[solid[np.searchsorted(solid, starts)]]
    same = np.zeros(len(starts))
    if len(starts) > 1:
        same[1:] = hashes[1:] == hashes[:-1]
    x = np.stack(
        [
            np.log2(size),
            np.log2(words),
            (size - counts[:, _SPACE]) / words,
            counts[:, _UPPER] / np.maximum(letters, 1),
            counts[:, _DIGIT] / size,
            counts[:, _STOP] / words,
            counts[:, _COMMA] / words,
            counts[:, _SYMBOL] / size,
            counts[:, _SHOUT] / words,
            counts[:, _OTHER] / size,
            kind[tail],
            first,
            letters / size,
            same,
            repeats / words,
        ],
        1,
    ).astype(np.float32)
    return x, (ends - starts).astype(np.int64), lines


@dataclass
class Model:
    """Bin edges and weights of the line features, transition scores, and the logistic scale."""

    edges: list[np.ndarray]
    weights: np.ndarray  # (3 neighbours, features, bins)
    bias: float
    transition: np.ndarray
    scale: tuple[float, float]
    prior: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1)

    def emissions(self, bins: np.ndarray, off: np.ndarray) -> np.ndarray:
        """How much the features speak for good, per line."""
        f = np.arange(FEATURES)
        own = self.bias + self.weights[0, f, bins].sum(1)
        if not len(own):
            return own
        before, after = self.weights[1, f, bins].sum(1), self.weights[2, f, bins].sum(1)
        inner = np.ones(len(own), bool)
        inner[off[:-1][off[:-1] < off[1:]]] = False  # a text's first line has none before it
        own[inner] += before[np.flatnonzero(inner) - 1]
        inner = np.ones(len(own), bool)
        inner[off[1:][off[:-1] < off[1:]] - 1] = False
        own[inner] += after[np.flatnonzero(inner) + 1]
        return own


def forward_backward(emission: np.ndarray, off: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of good for every line, and the expected transitions of every text, all texts side by side."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], off[:-1][order]
    t = np.exp(transition - transition.max())
    p = 1 / (1 + np.exp(-np.clip(emission, -30, 30)))
    local = np.stack([1 - p, p], 1)
    alpha, beta = np.zeros((len(emission), 2)), np.ones((len(emission), 2))
    steps = int(size[0]) if len(size) else 0
    alive = [np.searchsorted(-size, -i, "left") for i in range(steps + 1)]  # texts with more than i lines
    for i in range(steps):
        at = start[: alive[i]] + i
        a = local[at] if i == 0 else local[at] * (alpha[at - 1] @ t)
        alpha[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((len(size), 2, 2))
    for i in range(steps - 2, -1, -1):
        k = alive[i + 1]
        at = start[:k] + i
        ahead = local[at + 1] * beta[at + 1]
        joint = alpha[at][:, :, None] * t[None] * ahead[:, None, :]
        pairs[:k] += joint / joint.sum((1, 2), keepdims=True)
        b = ahead @ t.T
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    out = np.zeros_like(pairs)
    out[order] = pairs
    return both[:, 1] / np.maximum(both.sum(1), 1e-300), out


def aggregate(marginals: np.ndarray, length: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean of the marginals weighted by length, in logits; NaN for texts without lines."""
    total = np.concatenate([[0], np.cumsum(marginals * length)])
    weight = np.concatenate([[0], np.cumsum(length)]).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (total[off[1:]] - total[off[:-1]]) / (weight[off[1:]] - weight[off[:-1]])
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(x: np.ndarray, length: np.ndarray, off: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit by gradient ascent on the label sequences' likelihood, each text weighing 1; a text's label holds for all its lines."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(FEATURES)]
    prior = float((y.sum() + 1) / (len(y) + 2))
    model = Model(edges, np.zeros((3, FEATURES, BINS + 1)), 0.0, np.zeros((2, 2)), (1.0, 0.0), prior)
    size = np.diff(off)
    if not len(x) or len(np.unique(y)) < 2:
        return model
    bins = model.binned(x)
    line_y = np.repeat(y, size).astype(float)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    doc_w = balance / len(y)
    line_w = np.repeat(doc_w / np.maximum(size, 1), size)
    index = bins + np.arange(FEATURES) * (BINS + 1)
    first = np.zeros(len(x), bool)
    first[off[:-1][size > 0]] = True
    last = np.zeros(len(x), bool)
    last[off[1:][size > 0] - 1] = True
    seen = np.zeros((len(y), 2, 2))
    seen[np.arange(len(y)), y.astype(int), y.astype(int)] = np.maximum(size - 1, 0)
    pair_w = (doc_w / np.maximum(size, 1))[:, None, None]
    squares = [np.zeros(model.weights.shape), 0.0, np.zeros((2, 2))]
    n = FEATURES * (BINS + 1)
    for _ in range(rounds):
        p, pairs = forward_backward(model.emissions(bins, off), off, model.transition)
        g = (line_y - p) * line_w
        grads = np.empty((3, n))
        nothing = np.zeros(len(g))
        shifted = [g, np.where(last, nothing, np.append(g[1:], 0)), np.where(first, nothing, np.append(0, g[:-1]))]
        for k in range(3):
            grads[k] = np.bincount(index.ravel(), np.repeat(shifted[k], FEATURES), n)
        each = [grads.reshape(model.weights.shape) - 1e-4 * model.weights, g.sum(), ((seen - pairs) * pair_w).sum(0) - 1e-3 * model.transition]
        for i, d in enumerate(each):
            squares[i] = squares[i] + d * d
        model.weights = model.weights + 0.3 * each[0] / (np.sqrt(squares[0]) + 1e-9)
        model.bias += 0.3 * each[1] / (np.sqrt(squares[1]) + 1e-9)
        model.transition = model.transition + 0.1 * each[2] / (np.sqrt(squares[2]) + 1e-9)
    z = aggregate(forward_backward(model.emissions(bins, off), off, model.transition)[0], length, off)
    ok = ~np.isnan(z)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a small ridge
        q = 1 / (1 + np.exp(-(a * z[ok] + b)))
        r, w = y[ok] - q, q * (1 - q) + 1e-9
        h = np.array([[(w * z[ok] ** 2).sum() + 1, (w * z[ok]).sum()], [(w * z[ok]).sum(), w.sum() + 1]])
        da, db = np.linalg.solve(h, np.array([(r * z[ok]).sum() - (a - 1), r.sum() - b]))
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    model.scale = (max(float(a), 1e-3), float(b))
    return model


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of good for each text; one without any line gets the share of good among the training texts."""
    x, length, off = line_features(texts)
    p, _ = forward_backward(model.emissions(model.binned(x), off), off, model.transition)
    a, b = model.scale
    out = 1 / (1 + np.exp(-(a * aggregate(p, length, off) + b)))
    return np.where(np.isnan(out), model.prior, out)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most about `train_docs` labelled documents of at most `train_chars` characters.

    The sample is drawn by a hash of the id, so it is the same on every run, and its size does not
    grow with the input. Labels other than 0 and 1 and null ids are passed over; an id with several
    labels counts with the largest. Without labels of both kinds every score is the prior.
    """
    bound_batches(session(docs))
    one = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    there = {r["_y"]: r["n"] for r in one.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not there:
        return fit(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0))
    n = sum(there.values())
    rate = min(1.0, train_docs / n)
    span = 1 << 30
    chosen = one.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(span)) < int(rate * span))
    texts = core(docs, id_col, text_col).where(F.length(F.col(f"`{text_col}`")) <= train_chars).join(F.broadcast(chosen), F.col(f"`{id_col}`") == F.col("_id")).select("_y", F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, length, off = line_features(batch.column(1))
            rows = [(x[a:b].tobytes(), length[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["y", "x", "length"])

    got = texts.mapInArrow(run, "y int, x binary, length binary").collect()  # at most train_docs rows, each bounded by train_chars
    got = sorted(got, key=lambda r: (r["y"], bytes(r["x"])))
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    length = [np.frombuffer(r["length"], np.int64) for r in got]
    off = np.concatenate([[0], np.cumsum([len(v) for v in length])]).astype(np.int64)
    return fit(np.concatenate(x) if x else np.zeros((0, FEATURES), np.float32), np.concatenate(length) if length else np.zeros(0, np.int64), off, np.array([r["y"] for r in got]))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", keep: bool = False) -> DataFrame:
    """Score every document's whole text: id and score, or with keep all columns and the score.

    Null and empty texts get the prior; every row, repeated ones too, gets one.
    """
    bound_batches(session(docs))
    if keep and score_col in docs.columns:
        raise ValueError(f"the input has a column {score_col}; name another score_col")
    rows = docs if keep else core(docs, id_col, text_col)
    at = rows.columns.index(text_col)
    names = rows.columns if keep else [id_col]
    plain = numbered(rows)
    schema = StructType([*plain.schema.fields[: len(names)], StructField("score", DoubleType())])
    spread = session(docs).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(score(spread.value, batch.column(at)))], schema.names)

    return plain.mapInArrow(run, schema).toDF(*names, score_col)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Scores of all documents by a model fitted on the labels outside fold `held` of crc32(doc_id).

    Null and empty texts get the prior; a null id is in no fold, so its held_out is null.
    """
    model = train(docs, labels.where(fold("doc_id", folds) != held))
    out = classify(docs, model)
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
