import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from math import floor, inf, nan

import numpy as np
import pytest

from lectern.llm import embeddups
from lectern.llm.codes import search, vector_codes
from lectern.llm.covers import CoverTree, Links, cosines, dual, scaled
from lectern.llm.embeddups import embedding_duplicates
from lectern.llm.spelling import counted, near_words, spelling_variants

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n_links string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)


def finite(v):
    return v is not None and all(x is not None and abs(x) < inf for x in v)


# Vector codes


def plain_codes(rows, entries=64, rounds=2):
    """Everything by its definition, in Python's whole numbers."""
    kept = [(i, label, [floor(256 * x) for x in v]) for i, v, label in rows if finite(v)]
    width = len(kept[0][2]) // 16
    cut = [[v[p * width : (p + 1) * width] for p in range(16)] for _, _, v in kept]
    firsts = {}
    for (i, _, _), c in zip(kept, cut, strict=True):
        if i is not None:
            firsts[i] = min(firsts.get(i, c), c)
    books = [[firsts[i][p] for i in sorted(firsts)[:entries]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(16):
            of = defaultdict(list)
            for c in cut:
                of[nearest(p, c[p])[1]].append(c[p])
            new.append([[sum(z) // len(z) for z in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])])
        books = new
    sha = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        best = [nearest(p, c[p]) for p in range(16)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    total = Counter()
    for _, label, _, error in out:
        total[label] += error
    return sorted(((i, code, error, total[label], sha) for i, label, code, error in out), key=repr)


def codes_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("width", [1, 4])
def test_codes_are_those_of_the_definition(spark, width):
    r = random.Random(width)
    rows = [(i, [r.choice([-1, 1]) * r.random() ** 3 for _ in range(16 * width)], r.choice([None, 1, 2])) for i in range(300)]
    rows += [(7, rows[3][1], 1), (400, rows[5][1], None), (401, [0.0] * 16 * width, 3), (None, rows[9][1], 2)]
    rows += [(500, None, 1), (501, [nan] * 16 * width, 1), (502, [inf] + rows[0][1][1:], 1), (503, [None] + rows[0][1][1:], 1)]
    r.shuffle(rows)
    got = codes_of(vector_codes(table(spark, rows).repartition(3)))
    assert got == plain_codes(rows) and len(got) == 304


def test_the_search_keeps_ties_and_the_lowest_entry():
    r = np.random.default_rng(1)
    for width in (1, 2, 4, 7):
        book = r.integers(-3, 4, (64, width))
        x = r.integers(-4, 5, (5000, width))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        entry, least = search(x, book)
        assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()


def test_codes_of_odd_tables(spark):
    assert vector_codes(table(spark, [])).count() == 0
    assert vector_codes(table(spark, [(1, None, 1), (2, [nan], 1)])).count() == 0
    got = {r["vec_id"]: r for r in vector_codes(table(spark, [(1, [1.0] * 5, 1), (2, [], 1), (3, [0.5] * 5, 1), (4, [1e300] * 16, None), (5, [-1e300] * 16, None)])).collect()}
    assert got[1]["code"][:10] == "00" * 5 and got[3]["code"][:10] == "01" * 5 and got[2]["code"] == "00" * 16
    assert got[4]["error"] == 0 and got[5]["code"] == "01" * 16  # held within the bound
    assert [r["code"] for r in vector_codes(table(spark, [(None, [1.0] * 16, 1)])).collect()] == [None]


# Near duplicates among embeddings


def plain_duplicates(rows, threshold=0.9):
    ok = [k for k, (i, v, _) in enumerate(rows) if i is not None and finite(v) and v and any(v)]
    links = defaultdict(set)
    for k in ok:
        for m in ok:
            if k < m and len(rows[k][1]) == len(rows[m][1]):
                a, b = scaled(np.array([rows[k][1]])), scaled(np.array([rows[m][1]]))
                if cosines(a, b)[0] >= threshold:
                    links[k].add(m)
                    links[m].add(k)
    out, seen = {}, {}
    for k in range(len(rows)):
        if k not in seen:
            reach, stack = {k}, [k]
            while stack:
                for m in links[stack.pop()]:
                    if m not in reach:
                        reach.add(m)
                        stack.append(m)
            least = None if rows[k][0] is None else min(rows[m][0] for m in reach)
            seen |= {m: least for m in reach}
        out[k] = (rows[k][0], len(links[k]), seen[k], rows[k][0] == seen[k])
    return sorted(out.values(), key=repr)


def duplicates_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clustered(r, n, size, spread):
    centres = r.normal(size=(4, size))
    out = centres[r.integers(0, 4, n)] + r.normal(size=(n, size)) * r.choice(spread, n)[:, None]
    return out * r.choice([0.01, 1, 40], n)[:, None]


@pytest.mark.parametrize(("size", "spread"), [(2, [0.01, 0.3]), (3, [0.02, 2.0]), (16, [0.02, 0.1, 0.2, 1.0]), (16, [0.001])])
def test_a_dual_traversal_finds_all_pairs(size, spread):
    r = np.random.default_rng(size)
    x, y = scaled(clustered(r, 700, size, spread)), scaled(clustered(r, 150, size, spread))
    y[:50] = x[:50]
    x[60:70] = x[60]
    w, wy = r.integers(1, 4, 700), r.integers(1, 4, 150)
    a, b = CoverTree(x, w), CoverTree(y, wy)
    ux, uy = (z / np.linalg.norm(z, axis=1)[:, None] for z in (x, y))
    for other, weight, u in ((a, w, ux), (b, wy, uy)):
        links = Links([700, 0 if other is a else 150])
        dual(a, other, links, 0, 0 if other is a else 700, 0.9)
        near = ux @ u.T >= 0.9
        assert (links.count[:700] == (near * weight[None]).sum(1)[a.order]).all()
        if other is b:
            assert (links.count[700:] == (near * w[:, None]).sum(0)[b.order]).all()
        else:
            root = links.find(np.arange(700))
            label = np.arange(700)  # smallest position reached, by propagation
            linked = near[np.ix_(a.order, a.order)]
            for _ in range(700):
                lower = np.where(linked, label[None], 700).min(1)
                if (lower == label).all():
                    break
                label = lower
            assert (root == label).all()


def test_nodes_hold_their_points():
    r = np.random.default_rng(5)
    t = CoverTree(scaled(clustered(r, 500, 8, [0.01, 0.2, 1.0])), np.ones(500, np.int64))
    assert sorted(t.order) == list(range(500))
    for k in range(len(t.radius)):
        d = np.arccos(np.clip(t.u[t.lo[k] : t.hi[k]] @ t.u[t.centre[k]], -1, 1))
        assert d.max() <= t.radius[k] + 1e-7 and t.lo[k] <= t.centre[k] < t.hi[k]
        if t.children[k] is not None:  # nested: one child keeps the centre
            assert t.centre[k] in t.centre[t.children[k]] and (t.radius[t.children[k]] <= t.radius[k] + 1e-7).all()


@pytest.mark.parametrize(("size", "spread", "rows_a_shard", "guests"), [(3, [0.01, 0.4], 64, 160), (8, [0.02, 0.15, 1.0], 64, 1000), (8, [0.001, 0.01], 128, 200), (24, [0.01, 3.0], 4096, 1 << 18)])
def test_duplicates_are_those_of_all_pairs(spark, monkeypatch, size, spread, rows_a_shard, guests):
    monkeypatch.setattr(embeddups, "PIVOTS", 12)
    r = np.random.default_rng(size)
    v = clustered(r, 300, size, spread)
    v[100:130] = v[5]  # copies
    rows = [(int(i) + 3, v[i].tolist(), 1) for i in r.permutation(300)]
    rows += [(2000, None, 1), (2001, [0.0] * size, 1), (2002, [nan] * size, 1), (2003, [None] * size, 1), (2004, [], 1), (None, v[5].tolist(), 1), (None, None, 1)]
    rows += [(2005, v[5].tolist()[:2], 1), (2006, (v[5] * 1e160).tolist()[:2], 1), (2007, (v[5] * 1e-200).tolist()[:2], 1), (3, v[0].tolist(), 2), (2000, v[7].tolist(), 1)]
    got = duplicates_of(embedding_duplicates(table(spark, rows).repartition(3), shard_rows=rows_a_shard, visitors=guests))
    assert got == plain_duplicates(rows)


def test_duplicates_of_odd_tables(spark):
    assert embedding_duplicates(table(spark, [])).count() == 0
    assert duplicates_of(embedding_duplicates(table(spark, [(5, None, 1), (4, [0.0], 1)]))) == [(4, 0, 4, True), (5, 0, 5, True)]


# Spelling variants


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if ("A" <= c <= "Z") or ("a" <= c <= "z") or ("À" <= c <= "ÿ"):
                run += c.lower() if c < "\x80" else c
                continue
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
            run = ""
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    form, out = {}, []
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_are_those_of_all_pairs(spark, docs):
    r = random.Random(3)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(6, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "prefixab" + "c" * 12]

    def changed(w):
        at, c = r.randrange(len(w) + 1), r.choice("abÿé")
        return r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])

    rows = []
    for i in range(400):
        words = [w for s in r.sample(stems, 5) for w in [s] * r.choice([1, 1, 30]) + [changed(s)] * r.choice([0, 2]) + [changed(changed(s))] * r.choice([0, 2])]
        rows.append((i, r.choice([" ", "-", "1", "\n", "_"]).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in words)))
    rows += [(None, "nothing nothing Nothing notthing"), (900, None), (901, ""), (902, "12 ?"), (903, "verylong" * 5000), (903, "verylong" * 5000), (904, "ÉCOLIERS écoliers école×mixing école×mixing ÷dividers÷dividers")]
    got = variants_of(spelling_variants(docs(rows)))
    want = plain_variants(rows)
    assert got == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[1] != w[2] for w in want)
    assert spelling_variants(docs([])).count() == 0


def test_every_near_pair_comes_once(spark, docs):
    r = random.Random(9)
    words = {"".join(r.choice("ab") for _ in range(r.randint(7, 10))) for _ in range(400)} | {"a" * k for k in range(7, 14)}
    got = [tuple(sorted((x["a"], x["b"]))) for x in near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        spelling_variants(docs([]), times=1)


def test_words_are_counted_as_stated(spark, docs):
    rows = [(i, "grandes grandes Étagère plainte, plaintes") for i in range(200)]
    assert {r["word"]: r["n"] for r in counted(docs(rows)).collect()} == plain_words(rows)
