import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import lm, quality
from lectern.llm.langid import _WORD, UNKNOWN, identify, words_of
from lectern.llm.langid import language_scores as languages
from lectern.llm.langid import train as train_languages
from lectern.llm.lm import language_scores
from lectern.llm.neighbours import Tree, distances, nearest

DATA = "/root/testdata/sf0.001"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# Language identification


def test_languages_are_right_on_held_out_documents(spark, real):
    got = languages(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97


def test_language_of_odd_texts(spark, docs, real):
    model = train_languages(real)
    numerals = "²½ 12 ① Ⅷ ٣ _"
    assert identify(docs([(1, numerals)]), model).first()["lang_pred"] == UNKNOWN
    got = {r["doc_id"]: r for r in identify(docs([(1, None), (2, ""), (3, "12 34 !!"), (4, "東京都"), (5, "the " * 50000), (6, "the"), (6, "the")]), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == [UNKNOWN] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] in model.languages and got[5]["lang_pred"] == "en"
    nothing = train_languages(docs([(1, "a")]))
    assert identify(docs([(1, "abc")]), nothing).first()["lang_pred"] == UNKNOWN
    assert languages(docs([])).count() == 0


def test_words_are_runs_of_letters():
    for text in ("Straße x²y ½a１b٣c Ⅷd e①f_g ΑΒΓ東京 don't", "plain ascii 12 a1b", "", "²½ 12", "ªº ǅ ʰ"):
        assert words_of(text) == _WORD.findall(text.lower())


def test_scores_match_a_plain_scorer(spark):
    rows = [(i, w, l) for i, (w, l) in enumerate([("aa ab aa ab aa", "x"), ("ba bb ba b ba", "y"), ("aa cc cc", "y"), ("ab ab", "x"), ("zz", "z"), ("zy", "z"), (None, "x"), ("aa", " "), ("aa", None)] * 2)]
    model = train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y", "z"]
    words, grams = {k: Counter() for k in model.languages}, {k: Counter() for k in model.languages}
    for _, text, lang in rows:
        if text and lang in words:
            for w in text.split():
                words[lang][w] += 1
                for n in range(1, min(5, len(w) + 2) + 1):
                    grams[lang].update(w if n == 1 else [f"\x02{w}\x03"[i : i + n] for i in range(len(w) + 3 - n)])

    def log(tables, x, lang):
        kept = {k: {w: c for w, c in t.items() if c > 1} for k, t in tables.items()}
        size = len(set().union(*kept.values()))
        return math.log((kept[lang].get(x, 0) + 0.5) / (sum(kept[lang].values()) + 0.5 * size)) if any(x in t for t in kept.values()) else None

    def word(w, lang):
        if (own := log(words, w, lang)) is not None:
            return own
        for n in range(min(5, len(w) + 2), 0, -1):
            parts = list(w) if n == 1 else [f"\x02{w}\x03"[i : i + n] for i in range(len(w) + 3 - n)]
            known = [v for g in parts if (v := log(grams, g, lang)) is not None]
            if known:
                return sum(known) / len(known)
        return 0.0

    texts = ["aa ab", "cc ba", "zz aab", "bbc q", "abab zyz zz"]
    got = [r["score"] for r in sorted(identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect())]
    prior = dict(zip(model.languages, np.exp(model.prior), strict=True))
    for text, score in zip(texts, got, strict=True):
        total = {k: math.log(prior[k]) + sum(word(w, k) for w in text.split()) for k in model.languages}
        best = max(total.values())
        assert abs(score - 1 / sum(math.exp(v - best) for v in total.values())) < 1e-4


def test_unseen_words_fall_back_to_shorter_grams(spark):
    rows = [(i, "abcd abcd abce" if i % 2 else "wxyz wxyz wxyq", "one" if i % 2 else "two") for i in range(20)]
    model = train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for word, best in (("abcdd", 0), ("zzwxy", 1), ("c", 0), ("q", 1)):
        assert int(np.argmax(model.backoff(word))) == best
    assert (model.backoff("ñ") == 0).all()


# Language model


def brute_base(rows, held=2):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table)), ""]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i is not None and fold(i, 7) != held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens}


def check_base(got, want):
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert abs(r["base_score"] - base) <= 1e-9 * max(1, abs(base)) and r["score"] < 0


def test_base_scores_match_brute_force_and_the_network_beats_them(spark, real):
    got = language_scores(real).collect()
    check_base(got, brute_base([(r["doc_id"], r["text"]) for r in real.collect()]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "A a\tÀ \n x"), (4, "seldom"), (5, "w " * 30000), (8, "a b a"), (None, "a")]
    got = language_scores(docs(rows)).collect()
    check_base(got, brute_base(rows))
    twice = language_scores(docs(rows + [(3, "A a\tÀ \n x")])).collect()
    check_base(twice, brute_base(rows + [(3, "A a\tÀ \n x")]))
    assert len(twice) == 8 and language_scores(docs([])).count() == 0


def test_the_model_is_a_distribution_and_lanes_change_nothing():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))) for _ in range(30)]
    hashes, off = lm.tokens(pa.array(texts))
    words = np.unique(hashes[hashes != lm.END])[:20]
    model = lm.fit(lm.primed(lm.fresh(np.concatenate([[lm.END], words]).astype(np.uint64)), np.ones(21), 40), hashes, off)
    together = lm.network_scores(model, hashes, off)
    alone = [lm.network_scores(model, hashes[a:b], np.array([0, b - a]))[0] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert np.allclose(together, alone, rtol=1e-4)
    h = np.random.default_rng(0).standard_normal((3, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(lm.emit(model, h, np.full(3, k))) for k in [*range(model.explicit), -1])
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients_agree_with_finite_differences():
    rng = np.random.default_rng(3)
    model = lm.primed(lm.fresh(np.arange(40, dtype=np.uint64)), rng.integers(1, 50, 40), 2000)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    n = lm.CLASSES * lm.CLASS_SIZE
    x = rng.choice([0, 1, 2, 30, n + 5], (7, 3))
    y = rng.choice([-2, -1, 0, 3, 35, 39], (7, 3))
    reset = rng.random((7, 3)) < 0.2
    start = rng.standard_normal((3, lm.HIDDEN)) * 0.3

    def loss(w):
        h, states = start, []
        for t in range(len(x)):
            h, _ = lm.step(w, x[t], np.where(reset[t][:, None], 0, h))
            states.append(h)
        real = y > -2
        got = lm.emit(lm.Model(model.words, {k: v for k, v in w.items()}), np.array(states)[real], y[real])
        return -got.mean()

    g, _ = lm.gradients(w, x, y, reset, start)
    for name, value in w.items():
        places = np.argsort(-np.abs(g[name]).ravel())[:6].tolist() + rng.integers(0, value.size, 6).tolist()
        for i in places:
            at = np.unravel_index(i, value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss(w)
            value[at] = kept - 1e-5
            down = loss(w)
            value[at] = kept
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6, (name, at)


def test_network_scores_match_a_plain_loop():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    hashes, off = lm.tokens(pa.array(texts))
    words, n = np.unique(hashes, return_counts=True)
    model = lm.fit(lm.primed(lm.fresh(words[:8]), n[:8], int(n.sum())), hashes, off, 3)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    got = lm.network_scores(model, hashes, off)
    for d, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        h, total, before = np.zeros((1, lm.HIDDEN)), 0.0, 0
        for token in hashes[a:b]:
            h, _ = lm.step(w, np.array([before]), h)
            place = words[:8].tolist().index(token) if token in words[:8] else -1
            used = np.append(h[0] @ w["c"] + w["cb"], [])[[0, lm.CLASSES]]
            p = np.exp(used - used.max())
            p /= p.sum()
            total += np.log(p[0] if place >= 0 else p[1])
            if place >= 0:
                e = (h[0] @ w["w"][0] + w["wb"][0])[:8]
                total += e[place] - np.log(np.exp(e).sum())
            before = place if place >= 0 else lm.CLASSES * lm.CLASS_SIZE + int(token % np.uint64(lm.BUCKETS))
        assert abs(total - got[d]) < 1e-3 * max(1, abs(total))


def test_small_tables_and_all_pieces_change_no_base_score(spark, docs):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(50, "zz yy " * 9000)]
    one = {r["doc_id"]: r for r in language_scores(docs(rows), table=3, share=1.0).collect()}
    check_base(one.values(), brute_base(rows))
    pieces = lm.pieces(docs(rows).selectExpr("doc_id AS key", "text"), 1.0).collect()
    assert sum(len(p["text"]) for p in pieces) == sum(len(t) for _, t in rows) and sum(p["last"] for p in pieces) == len(rows)


# Quality


def test_quality_of_held_out_documents(spark):
    docs_, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(docs_, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    rows = [(1, "Some fine words.\nMore of them."), (2, "###### $$$"), (3, None), (4, ""), (5, "\n \n"), (6, "x " * 50000), (None, "y"), (2, "###### $$$")]
    got = quality.quality_scores(docs(rows), labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(docs([]), labels).count() == 0
    assert quality.quality_scores(docs(rows), labels.limit(0)).where("score <> 0.5").count() == 0


def test_forward_backward_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    emission, transition = rng.standard_normal(7), rng.standard_normal((2, 2))
    off = np.array([0, 4, 4, 5, 7])
    p, pairs = quality.forward_backward(emission, off, transition)
    for d, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        total, marginal, expected = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in product((0, 1), repeat=b - a):
            w = math.exp(sum(e for e, l in zip(emission[a:b], y, strict=True) if l) + sum(transition[i, j] for i, j in zip(y, y[1:])))
            total += w
            marginal += w * np.array(y)
            for i, j in zip(y, y[1:]):
                expected[i, j] += w
        if b > a:
            assert np.allclose(p[a:b], marginal / total) and np.allclose(pairs[d], expected / total)


def test_line_features_leave_out_blank_lines():
    x, length, off = quality.line_features(pa.array(["A b.\n\n  \nccc", None, "", "\n", "é!"]))
    assert off.tolist() == [0, 2, 2, 2, 2, 3] and len(x) == len(length) == 3


# Neighbours


@pytest.mark.parametrize("rows,leaf", [(700, 16), (300, 128), (40, 8)])
def test_exact_search_matches_brute_force(rows, leaf):
    rng = np.random.default_rng(rows)
    x = np.repeat(rng.standard_normal((rows // 2, 6)), 2, axis=0)
    x[:30] = x[0]
    ids = rng.permutation(rows)
    q = np.concatenate([x[:5], rng.standard_normal((20, 6))])
    q_ids = np.concatenate([ids[:5], np.arange(10_000, 10_020)])
    d, i = Tree(ids, x, 10, leaf).search(q_ids, q, 10)
    for n in range(len(q)):
        all_d = distances(np.repeat(q[n : n + 1], rows, 0), x)
        want = sorted((a, b) for a, b in zip(all_d, ids, strict=True) if b != q_ids[n])[:10]
        assert [b for _, b in want] == i[n].tolist() and np.array_equal([a for a, _ in want], d[n])


def test_nearest_over_shards_and_blocks(spark):
    rng = np.random.default_rng(4)
    good = [(k, rng.standard_normal(5).tolist()) for k in range(60)]
    odd = [(100, None), (101, [0.0] * 5), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, []), (None, [1.0] * 5), (105, [1.0, 2.0]), (106, [1.0, 3.0]), good[7]]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").selectExpr("*", "0 AS score", "1 AS rank")
    got = nearest(df, df.where("vec_id % 10 = 0 OR vec_id = 105"), 10, shard_rows=9, block_queries=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert sorted(by) == [0, 10, 20, 30, 40, 50, 105] and by[105] == [(1.0, 106)]
    v = dict(good)
    for q in (0, 10, 50):
        want = sorted((float(distances(np.array([v[q]]), np.array([x]))[0]), k) for k, x in good if k != q)[:10]
        assert by[q] == want
    relaxed = nearest(df, df.where("vec_id % 10 = 0"), 10, factor=0.5).count()
    assert relaxed > 0
    with pytest.raises(ValueError):
        nearest(df, df, factor=0)
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_vectors_whose_squares_overflow_keep_their_neighbours(spark):
    vectors = [[1e160, 1.0], [1e160, 5.0], [-1e160, 2.0], [3.0, 4.0], [3.0, 1.0], [1e308, 1e308], [-1e308, -1e308]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in nearest(df, df, 10).orderBy("query_id", "rank").collect()]
    want = []
    for q, a in enumerate(vectors):
        scores = [(math.hypot(*(x - y for x, y in zip(a, b, strict=True))), i) for i, b in enumerate(vectors) if i != q]
        want += [(q, i, s) for s, i in sorted(scores)]
    assert [(q, i) for q, i, _ in got] == [(q, i) for q, i, _ in want]
    assert all(g == w or math.isclose(g, w, rel_tol=1e-12) for (_, _, g), (_, _, w) in zip(got, want, strict=True))


def test_scores_do_not_depend_on_partitions(spark, real, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER_CHARS", 100_000)
    rows = real.select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in language_scores(rows.repartition(n, "text"), start_chars=50_000, share=1.0).collect()} for n in (1, 8))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-3, abs_tol=1e-3) for k in one)
