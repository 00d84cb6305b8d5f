"""The language model's network: guards that are taken once for all classes."""

import numpy as np
import pytest

from lectern.llm import lm


@pytest.mark.parametrize("scale", [1, 400])
def test_classes_whose_logits_may_overflow_are_told_once(scale, monkeypatch):
    model = lm.fresh(np.arange(lm.CLASSES * lm.CLASS_SIZE, dtype=np.uint64))
    model.weights["w"][3] *= scale
    r = np.random.default_rng(5)
    h = np.tanh(r.standard_normal((500, lm.HIDDEN))).astype(np.float32)
    target = r.integers(-1, lm.CLASSES * lm.CLASS_SIZE, 500)
    told, exps = [], lm._exps
    monkeypatch.setattr(lm, "_exps", lambda h, w, b, *small: (told.append(small), exps(h, w, b, *small))[1])
    got = lm.emit(model, h, target)
    assert [s for s in told if s].count((False,)) == (scale > 1) and len(told) == lm.CLASSES + 1
    assert lm._small(2 * h / np.abs(h).max(), model.weights) == [False] * lm.CLASSES

    def logp(x):
        x = x - x.max(-1, keepdims=True)
        return x - np.log(np.exp(x).sum(-1, keepdims=True))

    w, d = {k: v.astype(float) for k, v in model.weights.items()}, h.astype(float)
    for i, t in enumerate(target):
        k = t // lm.CLASS_SIZE if t >= 0 else lm.CLASSES
        want = logp(d[i] @ w["c"] + w["cb"])[k]
        if t >= 0:
            want += logp(d[i] @ w["w"][k] + w["wb"][k])[t % lm.CLASS_SIZE]
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_a_window_takes_exponentials_once_for_all_classes(monkeypatch):
    model = lm.primed(lm.fresh(np.arange(lm.CLASSES * lm.CLASS_SIZE, dtype=np.uint64)), np.arange(lm.CLASSES * lm.CLASS_SIZE) + 1, 10**6)
    r = np.random.default_rng(6)
    x, y = r.integers(0, lm.CLASSES * lm.CLASS_SIZE + lm.BUCKETS, (4, 60)), r.integers(-2, lm.CLASSES * lm.CLASS_SIZE, (4, 60))
    calls, exp = [], np.exp
    monkeypatch.setattr(lm.np, "exp", lambda *a, **k: (calls.append(1), exp(*a, **k))[1])
    lm.gradients(model.weights, x, y, np.zeros((4, 60), bool), np.zeros((60, lm.HIDDEN), np.float32))
    assert len(calls) <= len(x) + 2  # once a step, once for classes, once within them


@pytest.mark.parametrize("scale", [1, 400])
def test_shared_arrays_change_no_gradient(scale):
    model = lm.primed(lm.fresh(np.arange(200, dtype=np.uint64)), np.arange(200) + 1, 10**5)
    model.weights["w"][3] *= scale  # logits that may overflow
    wide = {k: v.astype(float) for k, v in model.weights.items()}
    r, room = np.random.default_rng(7), {}
    for steps, lane, least in ((6, 5, -1), (3, 9, -2), (1, 1, 0), (6, 5, -2), (2, 4, -3)):
        x, y = r.integers(0, lm.CLASSES * lm.CLASS_SIZE + lm.BUCKETS, (steps, lane)), np.maximum(r.integers(least, 200, (steps, lane)), -2)
        if least == -3:
            y[:] = -2  # padding alone
        reset, h = r.random((steps, lane)) < 0.2, np.tanh(r.standard_normal((lane, lm.HIDDEN))).astype(np.float32)
        got, after = lm.gradients(model.weights, x, y, reset, h, room)
        want, last = lm.gradients(wide, x, y, reset, h.astype(float))
        assert np.allclose(after, last, atol=1e-5) and all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-5) for k in want)


def test_words_that_share_leading_bits_are_found():
    r = np.random.default_rng(8)
    words = np.unique(np.concatenate([np.array([0, 2**64 - 1, *range(2**63, 2**63 + 9)], np.uint64), r.integers(0, 2**63, 5000, np.uint64)]))
    model = lm.Model(r.permutation(words), {})
    asked = np.concatenate([words, words + np.uint64(1), r.integers(0, 2**63, 5000, np.uint64)])
    place = {w: i for i, w in enumerate(model.words.tolist())}
    assert model.lookup(asked).tolist() == [place.get(h, -1) for h in asked.tolist()]
    assert not len(model.lookup(asked[:0])) and lm.Model(words[:0], {}).lookup(asked[:2]).tolist() == [-1, -1]
