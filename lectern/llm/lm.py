"""Language-model scoring: a gated recurrent network with a class-factored softmax, in numpy.

The network scores whole documents, its state carried from window to window. The most frequent
words of the training corpus have classes of their own; every other word is in one further class,
inside which its probability follows its count over all training documents. The model is a
distribution over all texts, unseen words included.

Training grows with the corpus. Word counts, and with them the words with classes and all biases,
are exact over all training documents. Weights come from truncated backpropagation through time:
first on a small common sample, then in every partition over its share of the corpus's pieces, after
which the partitions' weights are averaged by the tokens they have seen.

Frequent words, a fixed number of them, are looked up in a broadcast table; all others travel as
(word hash, row, times) and meet their exact count in a join, from which each row's sums come back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import _LOWER, bound_batches, buffers, fold, run_hashes, session, written

#: Words in the broadcast table (16 bytes each), and words with classes, CLASSES of CLASS_SIZE.
TABLE, CLASSES, CLASS_SIZE = 1 << 18, 32, 32
#: Leading bits of a hash by which words are looked up.
LEADING = 20
#: Characters that all weights start from, the share of the corpus that learners then learn from, a learner's part of it, and a piece's length.
START_CHARS, SHARE, LEARNER_CHARS, PIECE = 2_000_000, 1.0, 4_000_000, 20_000
#: Learners whose weights are summed in one task, and the blocks that the weights are cut into for it.
PARTY, BLOCKS = 64, 16
HIDDEN, BUCKETS, WINDOW, LANES = 24, 128, 32, 128
#: Tokens whose states are held at once while texts are scored.
SCORED = 1 << 14
END = np.uint64(0)
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text, then END, and the n + 1 offsets. Words are runs without ASCII white space, A to Z lower-cased."""
    flat, off = buffers(texts)
    n = len(off) - 1
    inside = ~_BREAK[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], inside])[:-1] & ~edge[:-1] if len(flat) else inside
    after = np.concatenate([inside, [False]])[1:] & ~edge[1:] if len(flat) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    own = np.searchsorted(starts, off)
    size = ends - starts
    hashes = np.zeros(0, np.uint64)
    if len(starts):
        hashes = np.maximum(run_hashes(_LOWER[flat[inside]], size), np.uint64(1))  # 0 is END
    out = np.empty(len(hashes) + n, np.uint64)
    out_off = own + np.arange(n + 1)
    ending = np.zeros(len(out), bool)
    ending[out_off[1:] - 1] = True
    out[ending], out[~ending] = END, hashes
    return out, out_off


@dataclass
class Model:
    """words: hashes by input id, the first `explicit` of which have classes; the rest of the fields are weights."""

    words: np.ndarray
    weights: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Place in `words`, or -1. Words that share their leading bits, few in a table of TABLE words, are tried one after the other."""
        shift = np.uint64(64 - LEADING)
        starts = np.zeros((1 << LEADING) + 1, np.int32)
        np.cumsum(np.bincount((self.sorted >> shift).astype(np.int64), minlength=1 << LEADING), out=starts[1:])
        lead = (hashes >> shift).astype(np.int64)
        at, end, out = starts[lead], starts[lead + 1], np.full(len(hashes), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            same = self.sorted[at] == hashes[todo]
            out[todo[same]] = self.order[at[same]]
            at += 1
            more = ~same & (at < end)
            todo, at, end = todo[more], at[more], end[more]
        return out

    def classed(self, hashes: np.ndarray) -> np.ndarray:
        """The same for words with classes alone, which are few."""
        few = self.words[: self.explicit]
        order = np.argsort(few)
        at = order[np.minimum(np.searchsorted(few[order], hashes), max(len(few) - 1, 0))] if len(few) else np.zeros(len(hashes), np.int64)
        return np.where(few[at] == hashes, at, -1) if len(few) else np.full(len(hashes), -1, np.int64)

    @property
    def explicit(self) -> int:
        return min(len(self.words), CLASSES * CLASS_SIZE)

    def inputs(self, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Input ids: an explicit word's own, else one of BUCKETS shared ones; 0 is also the start of a text."""
        shared = CLASSES * CLASS_SIZE + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        return np.where((place >= 0) & (place < self.explicit), place, shared)


def fresh(words: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)

    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    h, n = HIDDEN, CLASSES * CLASS_SIZE
    return Model(words, {"x": small(n + BUCKETS, 3 * h), "u": small(h, 3 * h), "c": small(h, CLASSES + 1), "cb": np.zeros(CLASSES + 1, np.float32), "w": small(CLASSES, h, CLASS_SIZE), "wb": np.zeros((CLASSES, CLASS_SIZE), np.float32)})


def _negated(rows: np.ndarray) -> np.ndarray:
    """Weights of the three gates, one after the other in each row, with the signs that cell() takes: those of the two logistic gates turned."""
    out = rows.copy()
    np.negative(out[:, : 2 * HIDDEN], out=out[:, : 2 * HIDDEN])
    return out


def cell(u: np.ndarray, gx: np.ndarray, h: np.ndarray, gh: np.ndarray, gates: np.ndarray, part: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """One step of the recurrent cell for all lanes, which are the columns, so that each gate is one run of memory.

    u (transposed) and gx: signed as _negated() does. gh is overwritten; gates (z, r), r times its gate's input, the new state and the
    state after the step go to the other arrays. exp may overflow to infinity, whose reciprocal is the 0 that is meant.
    """
    n = HIDDEN
    np.matmul(u, h, out=gh)
    np.add(gx[: 2 * n], gh[: 2 * n], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[n:], gh[2 * n :], out=part)
    np.add(gx[2 * n :], part, out=new)
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= gates[:n]
    out += new


def step(w: dict[str, np.ndarray], inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The same with a row for each lane."""
    h = np.ascontiguousarray(h.T)
    gh, gates, part, new, out = (np.empty((k * HIDDEN, h.shape[1]), h.dtype) for k in (3, 2, 1, 1, 1))
    with np.errstate(over="ignore"):
        cell(_negated(w["u"]).T, _negated(w["x"][inputs]).T, h, gh, gates, part, new, out)
    return out.T, (gates[:HIDDEN], gates[HIDDEN:], new, gh[2 * HIDDEN :])


def _columns(rows: np.ndarray) -> np.ndarray:
    """(step, lane, value) as (step, value, lane), in one run of memory."""
    return np.ascontiguousarray(rows.transpose(0, 2, 1))


def _starts(reset: np.ndarray) -> tuple[list[bool], np.ndarray]:
    """Whether any lane of a step begins a text, and what each lane's state is multiplied by there."""
    return reset.any(1).tolist(), (~reset).astype(np.float32)


def _small(h: np.ndarray, w: dict[str, np.ndarray]) -> list[bool]:
    """Of each class, whether no logit of its words can overflow: |h| < 1 bounds them all."""
    inside = not len(h) or h.max() <= 1 and h.min() >= -1
    return (((np.abs(w["w"]).sum(1) + np.abs(w["wb"])).max(1) <= 80) & inside).tolist()


def _exps(h: np.ndarray, w: np.ndarray, b: np.ndarray, small: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of these, row by row. |h| < 1 bounds a logit; only where it may overflow is the largest taken off. small: known not to."""
    x = h @ w
    x += b
    if not small and (not len(b) or (np.abs(w).sum(0) + np.abs(b)).max() > 80 or len(h) and (h.max() > 1 or h.min() < -1)):
        x -= x.max(1, keepdims=True)
    e = np.exp(x)
    return x, e, e @ np.ones(e.shape[1], e.dtype)


def emit(model: Model, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target: that of its class, and within an explicit class its own. target -1: any other word."""
    w = model.weights
    cls = np.where(target >= 0, target // CLASS_SIZE, CLASSES)
    used = np.append(np.arange(-(-model.explicit // CLASS_SIZE)), CLASSES)  # few words leave classes empty
    x, _, sums = _exps(h, w["c"][:, used], w["cb"][used])
    out = (x[np.arange(len(h)), np.minimum(cls, len(used) - 1)] - np.log(sums)).astype(np.float64)
    order = np.argsort(cls.astype(np.int8), kind="stable")  # CLASSES + 1 values
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    order = order[: bounds[-1]]
    h, own, small = h[order], target[order] % CLASS_SIZE, _small(h, w)
    for k in range(CLASSES):
        lo, hi = bounds[k], bounds[k + 1]
        if hi > lo:
            width = min(CLASS_SIZE, model.explicit - k * CLASS_SIZE)
            x, _, sums = _exps(h[lo:hi], w["w"][k, :, :width], w["wb"][k, :width], small[k])
            out[order[lo:hi]] += x[np.arange(hi - lo), own[lo:hi]] - np.log(sums)
    return out


def lanes(length: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Deal sequences to lanes, longest first to the emptiest lane: lane and first step of each, steps, lanes."""
    total, longest = int(length.sum()), int(length.max())
    n = int(np.clip(-(-total // max(longest, 256)), 1, most))
    n = max(n, min(most, len(length), 64))
    import heapq

    heap = [(0, i) for i in range(n)]
    lane, start = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for i in np.argsort(-length, kind="stable"):
        used, k = heapq.heappop(heap)
        lane[i], start[i] = k, used
        heapq.heappush(heap, (used + int(length[i]), k))
    return lane, start, max(u for u, _ in heap), n


def grid(model: Model, hashes: np.ndarray, off: np.ndarray, most: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets (-2: padding), resets and text numbers as (step, lane) arrays. place: that of each hash, if known."""
    place = model.classed(hashes) if place is None else place
    target = np.where(place < model.explicit, place, -1)
    given = model.inputs(place, hashes)
    length = np.diff(off)
    lane, start, steps, n = lanes(length, most)
    text = np.repeat(np.arange(len(length)), length)
    at = (np.arange(len(hashes)) - off[:-1][text] + start[text]) * n + lane[text]
    before = np.concatenate([[0], given[:-1]])
    first = np.zeros(len(hashes), bool)
    first[off[:-1]] = True
    before[first] = 0
    x, y, fresh_, owner = np.zeros(steps * n, np.int32), np.full(steps * n, -2, np.int32), np.zeros(steps * n, bool), np.zeros(steps * n, np.int32)
    x[at], y[at], fresh_[at], owner[at] = before, target, first, text
    return x.reshape(steps, n), y.reshape(steps, n), fresh_.reshape(steps, n), owner.reshape(steps, n)


def network_scores(model: Model, hashes: np.ndarray, off: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each text's classes and explicit words, over the whole text."""
    out = np.zeros(len(off) - 1)
    if not len(out):
        return out
    x, y, reset, owner = grid(model, hashes, off, 1024, place)
    given, u = _negated(model.weights["x"]), np.ascontiguousarray(_negated(model.weights["u"]).T)
    lane = x.shape[1]
    span = max(SCORED // lane, 1)  # steps between two emissions
    h = np.zeros((HIDDEN, lane), np.float32)
    gh, gates, part, new = (np.empty((k * HIDDEN, lane), np.float32) for k in (3, 2, 1, 1))
    room = np.empty((min(span, len(x)), HIDDEN, lane), np.float32)
    for lo in range(0, len(x), span):
        hi = min(lo + span, len(x))
        states, gx = room[: hi - lo], _columns(given[x[lo:hi]])
        begins, keep = _starts(reset[lo:hi])
        with np.errstate(over="ignore"):
            for t in range(hi - lo):
                if begins[t]:
                    h = h * keep[t]
                cell(u, gx[t], h, gh, gates, part, new, states[t])
                h = states[t]
        h = h.copy()
        real = y[lo:hi] > -2
        out += np.bincount(owner[lo:hi][real], emit(model, states.transpose(0, 2, 1)[real], y[lo:hi][real]), len(out))
    return out


def primed(model: Model, counts: np.ndarray, total: int) -> Model:
    """The model with the biases that the corpus's counts of `words` and of all tokens give; places without a word are shut."""
    per = np.zeros(CLASSES * CLASS_SIZE)
    per[: model.explicit] = counts[: model.explicit]
    shut = np.arange(len(per)) >= model.explicit
    w = {k: v.copy() for k, v in model.weights.items()}
    w["wb"][:] = np.where(shut, -60, np.log(per + 0.5)).reshape(CLASSES, CLASS_SIZE)
    w["cb"][:] = np.log(np.append(per.reshape(CLASSES, CLASS_SIZE).sum(1), total - per.sum()) + 0.5)
    w["cb"][:-1][shut.reshape(CLASSES, CLASS_SIZE).all(1)] = -60
    return Model(model.words, w)


def _room(steps: int, lane: int, kind: np.dtype) -> dict[str, np.ndarray]:
    """A window's arrays: (step, value, lane) where steps follow each other, (value, place) where all places are worked on at once."""
    n, size = HIDDEN, steps * lane
    by_step = {"past": n, "gates": 2 * n, "part": n, "new": n, "states": n, "gx": 3 * n, "through": 3 * n, "dg": 3 * n, "dh": n, "to_new": n, "spare": n, "back": n}
    flat = {"seen": (n + 1) * size, "outer": (CLASSES + 1) * size, "inner": CLASS_SIZE * size, "ds": n * (size + 1), "more": n * size}
    out = {k: np.empty((steps, values, lane), kind) for k, values in by_step.items()} | {k: np.empty(v, kind) for k, v in flat.items()}
    return out | {"all": np.ones((n + 1, size), kind), "rows": np.empty((size, 3 * n), kind), "to_x": np.empty((3 * n, size), kind)}


def _shares(x: np.ndarray, m: int) -> None:
    """Logits, a column for each target, become their exponentials' shares of the column's sum, over m."""
    np.exp(x, out=x)
    sums = np.ones(len(x), x.dtype) @ x
    sums *= m
    x *= np.reciprocal(sums, out=sums)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, reset: np.ndarray, h: np.ndarray, room: dict | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean negative log probability of a window's targets, and the state after it. room: arrays that calls share.

    Values lie in rows with a column for each step and lane, and targets are sorted by class, so that all logits within classes
    are one array. A row of ones below the states stands for the biases.
    """
    n, (steps, lane) = HIDDEN, x.shape
    size = steps * lane
    room = {} if room is None else room
    if room.get("shape") != (x.shape, h.dtype):
        room |= _room(steps, lane, h.dtype) | {"shape": (x.shape, h.dtype)}

    def rows(name: str, k: int, m: int) -> np.ndarray:
        return room[name][: k * m].reshape(k, m)

    u = np.ascontiguousarray(_negated(w["u"]).T)
    gx, past, gates, part, new, states = (room[k] for k in ("gx", "past", "gates", "part", "new", "states"))
    np.copyto(gx, np.take(_negated(w["x"]), x.ravel(), 0, out=room["rows"], mode="clip").reshape(steps, lane, 3 * n).transpose(0, 2, 1))
    begins, keep = _starts(reset)
    keep = keep.astype(h.dtype, copy=False)
    h, gh = np.ascontiguousarray(h.T), np.empty((3 * n, lane), h.dtype)
    with np.errstate(over="ignore"):
        for t in range(steps):
            before = np.multiply(h, keep[t], out=past[t])
            h = states[t]
            cell(u, gx[t], before, gh, gates[t], part[t], new[t], h)
    after = h.T.copy()
    target = y.ravel()
    cls = np.where(target >= 0, target // CLASS_SIZE, CLASSES - 1 - target).astype(np.int8)  # CLASSES: any other word, beyond: padding
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 2)).tolist()
    inside, m = bounds[CLASSES:]
    order = order[:m]
    seen = room["all"]
    np.copyto(seen[:n].reshape(n, steps, lane), states.transpose(1, 0, 2))
    s = np.take(seen, order, 1, out=rows("seen", n + 1, m), mode="clip")
    bounded = not m or s[:n].max() <= 1 and s[:n].min() >= -1
    outer, inner = rows("outer", CLASSES + 1, m), rows("inner", CLASS_SIZE, inside)
    c, inw = np.concatenate([w["c"], w["cb"][None]]), np.concatenate([w["w"], w["wb"][:, None]], 1)
    small = [bool(b) and bounded for b in np.abs(inw).sum(1).max(1) <= 80]  # whether no logit of a class can overflow
    np.matmul(c.T, s, out=outer)
    if not bounded or np.abs(c).sum(0).max() > 80:
        outer -= outer.max(0)
    _shares(outer, max(m, 1))
    full = [(k, slice(lo, hi)) for k, (lo, hi) in enumerate(pairwise(bounds[: CLASSES + 1])) if hi > lo]
    for k, span in full:
        np.matmul(inw[k].T, s[:, span], out=inner[:, span])
        outer[k, span] -= 1 / m
        if not small[k]:
            inner[:, span] -= inner[:, span].max(0)
    outer[CLASSES, inside:] -= 1 / max(m, 1)
    _shares(inner, max(m, 1))
    inner[target[order[:inside]] % CLASS_SIZE, np.arange(inside)] -= 1 / max(m, 1)
    to_c = s @ outer.T
    g = dict.fromkeys(w) | {"c": to_c[:n], "cb": to_c[n]}
    ds, more = rows("ds", n, m + 1), rows("more", n, inside)
    ds[:, m] = 0
    np.matmul(w["c"], outer, out=ds[:, :m])
    to_w = np.zeros_like(inw)
    for k, span in full:
        np.matmul(s[:, span], inner[:, span].T, out=to_w[k])
        np.matmul(w["w"][k], inner[:, span], out=more[:, span])
    g |= {"w": to_w[:, :n], "wb": to_w[:, n]}
    ds[:, :inside] += more
    place = np.full(size, m)
    place[order] = np.arange(m)
    back = room["back"]
    np.copyto(back, np.take(ds, place, 1, out=seen[:n], mode="clip").reshape(n, steps, lane).transpose(1, 0, 2))
    # what a step's gradient is multiplied by on its way to each gate, for all steps at once
    z, r, to_new, spare, through, dg, dhs = gates[:, :n], gates[:, n:], *(room[k] for k in ("to_new", "spare", "through", "dg", "dh"))
    np.multiply(new, new, out=to_new)
    np.subtract(1, to_new, out=to_new)
    np.subtract(1, z, out=spare)
    to_new *= spare
    to_z = np.subtract(past, new, out=through[:, :n])
    to_z *= z
    to_z *= spare
    np.subtract(1, r, out=spare)
    spare *= part
    np.multiply(spare, to_new, out=through[:, n : 2 * n])
    np.multiply(r, to_new, out=through[:, 2 * n :])
    ways, dgs = (a.reshape(steps, 3, n, lane) for a in (through, dg))
    down, more = np.zeros_like(h), np.empty_like(h)
    for t in range(steps - 1, -1, -1):
        dh = np.add(down, back[t], out=dhs[t])
        np.multiply(ways[t], dh, out=dgs[t])
        np.matmul(w["u"], dg[t], out=more)
        np.multiply(dh, z[t], out=down)
        down += more
        if begins[t]:
            down *= keep[t]
    to_x, by_step = room["to_x"], room["to_x"].reshape(3 * n, steps, lane)
    np.copyto(by_step, dg.transpose(1, 0, 2))
    np.copyto(seen[:n].reshape(n, steps, lane), past.transpose(1, 0, 2))
    g["u"] = seen[:n] @ to_x.T
    np.copyto(by_step[2 * n :], np.multiply(dhs, to_new, out=spare).transpose(1, 0, 2))  # r has no part in the input's share
    flat = x.ravel().astype(np.int64)
    g["x"] = np.stack([np.bincount(flat, values, len(w["x"])) for values in to_x], 1).astype(h.dtype)
    return g, after


def fit(model: Model, hashes: np.ndarray, off: np.ndarray, epochs: int = 2, rate: float = 0.01) -> Model:
    """Truncated backpropagation through time with Adam: windows of WINDOW steps, the state carried over."""
    if len(off) < 2:
        return model
    x, y, reset, _ = grid(model, hashes, off, LANES)
    w = {k: v.copy() for k, v in model.weights.items()}
    model = Model(model.words, w)
    flat = np.concatenate([v.ravel() for v in w.values()])
    cuts = np.cumsum([v.size for v in w.values()])
    w |= {k: part.reshape(v.shape) for (k, v), part in zip(list(w.items()), np.split(flat, cuts[:-1]), strict=True)}  # views of `flat`
    one, two, v = (np.zeros_like(flat) for _ in range(3))
    spare = np.empty(8192, flat.dtype)
    parts = [[a[lo : lo + len(spare)] for a in (flat, one, two, v)] for lo in range(0, len(flat), len(spare))]  # each stays in the cache
    done, shared = 0, {}
    for epoch in range(epochs):
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for lo in range(0, len(x), WINDOW):
            hi = min(lo + WINDOW, len(x))
            g, h = gradients(w, x[lo:hi], y[lo:hi], reset[lo:hi], h, shared)
            done += 1
            np.concatenate([g[k].ravel() for k in w], out=v)
            clip = np.float32(min(1.0, 1.0 / max(float(np.sqrt(v @ v)), 1e-9)))
            now = rate * (1.0 if epoch == 0 else 0.3)
            for weight, first, second, new in parts:
                room = spare[: len(new)]
                new *= clip
                first *= np.float32(0.9)
                first += np.multiply(new, np.float32(0.1), out=room)
                second *= np.float32(0.999)
                new *= new
                second += np.multiply(new, np.float32(0.001), out=room)
                np.sqrt(np.divide(second, np.float32(1 - 0.999**done), out=room), out=room)
                room += np.float32(1e-8)
                np.divide(first, room, out=room)
                room *= np.float32(now / (1 - 0.9**done))
                weight -= room
    return model


def pieces(rows: DataFrame, share: float) -> DataFrame:
    """(text, last, key, i): about this share of all pieces of PIECE characters, drawn by a hash of row and place; texts of any length have their share."""
    span = 1 << 30
    n = F.greatest(F.ceil(F.length("text") / PIECE).cast("int"), F.lit(1))
    drawn = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.xxhash64(F.lit("piece"), "key", i), F.lit(span)) < int(span * min(share, 1.0)))
    return rows.select("text", "key", n.alias("n"), F.explode(drawn).alias("i")).select(F.substr("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("text"), (F.col("i") + 1 == F.col("n")).alias("last"), "key", "i")


def piece_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a batch of pieces; END only after a text's last one."""
    hashes, off = tokens(batch.column(0))
    inner = ~batch.column(1).to_numpy(zero_copy_only=False)
    keep = np.ones(len(hashes), bool)
    keep[off[1:][inner] - 1] = False
    off = off - np.concatenate([[0], np.cumsum(inner)])
    full = np.flatnonzero(np.diff(off))
    return hashes[keep], np.append(off[full], off[-1])


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n): exact counts of all tokens of all rows, pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sums() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            hashes, _ = tokens(batch.column(0))
            held.append(hashes)
            size += len(hashes)
            if size > 6_000_000:
                yield sums()
                held, size = [], 0
        if held:
            yield sums()

    return rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """END and the most frequent other words, at most `most` in all, with their counts, ties by hash."""
    end = counts.where("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top = counts.where("word <> 0").orderBy(F.col("n").desc(), "word").limit(most - 1).toArrow()
    words, n = (top.column(c).to_numpy() for c in ("word", "n"))
    order = np.lexsort((words, -n))
    return np.concatenate([[END], words[order].view(np.uint64)]).astype(np.uint64), np.concatenate([[end], n[order]]).astype(np.int64)


def refined(model: Model, rows: DataFrame, share: float, chars: int, rate: float = 0.004) -> Model:
    """The mean, by tokens seen, of the weights that learners come to, each from its own pieces of the drawn share.

    Pieces are dealt by a hash of key and place to as many learners as the corpus has LEARNER_CHARS, and taken in order of both,
    so the result rests on the corpus alone, not on how its files or partitions are cut. Sums are taken block by block in
    groups of PARTY learners, twice, so that no task and not the driver gets all.
    """
    shared = session(rows).sparkContext.broadcast(model)
    names = sorted(model.weights)
    schema = "party int, block int, who long, sums binary, n long"
    learners = max(1, round(chars * share / LEARNER_CHARS))
    dealt = pieces(rows, share).withColumn("who", F.pmod(F.xxhash64(F.lit("learner"), "key", "i"), F.lit(learners)))
    dealt = dealt.repartition(learners, "who").sortWithinPartitions("who", "key", "i").select("text", "last", "who")

    def weights(who: int, held: list) -> pa.RecordBatch:
        lengths = np.concatenate([np.diff(o) for _, o in held])
        seen = int(lengths.sum())
        own = fit(shared.value, np.concatenate([h for h, _ in held]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), 1, rate)
        flat = np.concatenate([own.weights[k].ravel() for k in names]).astype(np.float64) * seen
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        cols = ([who // PARTY] * BLOCKS, range(BLOCKS), [who] * BLOCKS, [x.tobytes() for x in np.array_split(flat, BLOCKS)], [seen] * BLOCKS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["party", "block", "who", "sums", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            ids = batch.column(2).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
            for lo, hi in pairwise(cuts.tolist()):
                if ids[lo] != now and held:
                    yield weights(now, held)
                    held = []
                now = int(ids[lo])
                part = piece_tokens(batch.slice(lo, hi - lo))
                if len(part[0]):
                    held.append(part)
        if held:
            yield weights(now, held)

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("who")
        total = None
        for x in group.column("sums"):
            one = np.frombuffer(x.as_buffer(), np.float64)
            total = one.copy() if total is None else total + one
        party = group.column("party")[0].as_py()
        return pa.table({"party": pa.array([party // PARTY], pa.int32()), "block": group.column("block")[:1], "who": pa.array([party], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64())})

    parts = dealt.mapInArrow(learn, schema)
    for _ in range(2):
        parts = parts.groupBy("party", "block").applyInArrow(add, schema)
    got = sorted(parts.select("block", "who", "sums", "n").collect())  # the weights once for PARTY * PARTY learners
    n = sum(r["n"] for r in got if r["block"] == 0)
    if not n:
        return model
    mean = np.concatenate([sum(np.frombuffer(bytes(r["sums"]), np.float64) for r in got if r["block"] == b) for b in range(BLOCKS)]) / n
    cuts = np.cumsum([model.weights[k].size for k in names])[:-1]
    return Model(model.words, {k: v.reshape(model.weights[k].shape).astype(np.float32) for k, v in zip(names, np.split(mean, cuts), strict=True)})


def train(rows: DataFrame, counts: DataFrame, total: int, share: float = SHARE, start_chars: int = START_CHARS, table: int = TABLE) -> tuple[Model, np.ndarray]:
    """The model of all `rows` (key, text), and the exact counts of its words. share 1 learns from every piece."""
    words, n = frequent(counts, table)
    model = primed(fresh(words), n, total)
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, off = piece_tokens(batch)
            yield pa.RecordBatch.from_arrays([pa.array([hashes[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["tokens"])

    first = pieces(rows, start_chars / max(chars, 1)).mapInArrow(cut, "tokens binary").collect()  # some start_chars / 4 tokens
    texts = [np.frombuffer(b, np.uint64) for b in sorted((bytes(r[0]) for r in first), key=lambda b: (zlib.crc32(b), b))]
    if texts:
        model = fit(model, np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    return (refined(model, rows, share, chars) if share > 0 else model), n


def language_scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, start_chars: int = START_CHARS, table: int = TABLE) -> DataFrame:
    """Scores of all rows; the rows outside fold `held` of crc32(doc_id) are the training corpus.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Null texts count
    as empty: one END. Rows with a null id are in no fold, so they are scored and not learned from
    (held_out is null); repeated rows each count. Without training rows all counts are 0.
    """
    spark = session(docs)
    bound_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), (fold(id_col, folds) == held).alias("held_out"))
    learned = rows.where("NOT held_out").select("key", "text")
    counts = written(word_counts(learned), "counts")
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = int(sizes["total"]), int(sizes["distinct"])
    model, known = train(learned, counts, total, share, start_chars, table)
    explicit = model.explicit
    rest, rest_distinct = total - int(known[:explicit].sum()), distinct - int((known[:explicit] > 0).sum())
    shared = spark.sparkContext.broadcast((model, known))  # `table` words and the network
    whole, others = float(np.log10(total + distinct + 1.0)), float(np.log10(rest + rest_distinct + 1.0))
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = shared.value
        logs = np.log10(n + 1.0)

        def finish(held: list) -> pa.RecordBatch:
            hashes = np.concatenate([h for h, _, _ in held])
            sizes = np.concatenate([np.diff(o) for _, o, _ in held])
            off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            place = own.lookup(hashes)
            inside = place >= 0
            r, p = row[inside], place[inside]
            base = np.bincount(r, logs[p] - whole, len(sizes)) - (sizes - np.bincount(r, minlength=len(sizes))) * whole
            there = np.bincount(r, n[p] > 0, len(sizes)).astype(np.int64)
            late = p >= explicit
            far = sizes - np.bincount(r[~late], minlength=len(sizes))
            net = network_scores(own, hashes, off, place) / np.log(10) + np.bincount(r[late], logs[p[late]], len(sizes)) - far * others
            hashes, row = hashes[~inside], row[~inside]
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if len(hashes) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(hashes))).astype(np.int32)
            ends = pa.array(np.searchsorted(row[new], np.arange(len(sizes) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(hashes[new].view(np.int64)), pa.array(times, pa.int32()))]
            cols = [pa.concat_arrays([b.column(i) for _, _, b in held]) for i in (0, 2, 3)]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array(x) for x in (sizes.astype(np.int64), there, base, net)), *lists], ["id", "key", "held_out", "n_tokens", "n_known", "base", "net", "words", "times"])

        held, size = [], 0
        for batch in batches:
            hashes, off = tokens(batch.column(1))
            held.append((hashes, off, batch))
            size += len(hashes)
            if size > 1_500_000:  # enough for the network to run many texts side by side
                yield finish(held)
                held, size = [], 0
        if held:
            yield finish(held)

    scored = written(rows.mapInArrow(score, f"id {id_type}, key long, held_out boolean, n_tokens long, n_known long, base double, net double, words array<long>, times array<int>"), "scored")
    # words without a count add nothing; rows that repeat id and text share a key and split its sums
    pairs = scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = pairs.join(counts, "word").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"), F.sum("times").alias("met"))
    rows_of = scored.drop("words", "times").withColumn("_copies", F.count("*").over(Window.partitionBy("key")))
    out = rows_of.join(sums.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left")
    logs, met = (F.coalesce(F.col(c), F.lit(0)) / F.col("_copies") for c in ("logs", "met"))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.round(met).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("net") + logs).alias("score"),
    )
