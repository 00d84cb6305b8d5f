import math
import random
import re

import numpy as np
import pyarrow as pa

from lectern.llm.common import word_hashes
from lectern.llm.components import components
from lectern.llm.decontaminate import BLOCKS, RADIUS, Index, decontaminate, leaks
from lectern.llm.neardup import RARE, Weights, bags, frequencies, keep_one, near_duplicates, samples, signatures, similarities, slots

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, n, seed):
    r = random.Random(seed)
    words = text.split()
    for i in r.sample(range(len(words)), n):
        words[i] = "edit" + str(r.random())[2:8]
    return " ".join(words)


def drifting(chains, versions, words=200, seed=0):
    """Chains of versions, each with three or four words other than the one before it, ids shuffled."""
    r = random.Random(seed)
    texts = []
    for c in range(chains):
        text = prose(words, 10_000 * seed + c)
        for v in range(versions):
            texts.append(text)
            text = edited(text, r.choice((3, 4)), 10_000 * seed + 100 * c + v)
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def linked(spark, docs, rows):
    """By brute force: all pairs of at least 0.8, and those among them that share a bucket."""
    idf = Weights(*frequencies(docs(rows)))
    bands = {r["id"]: set(r["bands"]) for r in signatures(docs(rows), idf, "doc_id", "text").collect()}
    shingled = {i: set(bags(pa.array([t]))[0].tolist()) for i, t in rows}
    pairs = [(a, b) for n, (a, _) in enumerate(rows) for b, _ in rows[n + 1 :] if len(shingled[a] & shingled[b]) * 3 > len(shingled[a])]
    text = dict(rows)
    sims = similarities(pa.array([text[a] for a, _ in pairs]), pa.array([text[b] for _, b in pairs]), idf)
    links = [p for p, s in zip(pairs, sims, strict=True) if s >= 0.8]
    return links, [(a, b) for a, b in links if bands[a] & bands[b]]


def classes_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_classes_are_the_components_of_all_links_that_share_a_bucket(spark, docs):
    rows = drifting(40, 14)
    links, met = linked(spark, docs, rows)
    assert len(links) > 300 and len(met) >= 0.99 * len(links)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs(rows)).collect()}
    assert got == classes_of([i for i, _ in rows], met)
    assert 40 <= len(set(got.values())) < 120  # some steps are below the threshold


def chained(seed, own=30):
    """Two groups far apart and a link between two texts at their rims, each of which has nearer texts of its group in every bucket."""
    base = prose(400, seed).split()
    spots = [int((i + 0.5) * 400 / 22) for i in range(22)]

    def text(steps, extra=None):
        words = list(base)
        for k in range(2 * steps):
            words[spots[k]] = f"other{k}"
        if extra is not None:
            words[spots[20] + extra % 3] = f"own{extra}"
        return " ".join(words)

    return [(k, text(0, k)) for k in range(own)] + [(100 + k, text(10, 100 + k)) for k in range(own)] + [(500, text(3)), (501, text(7))]


def test_links_between_texts_that_head_no_bucket_are_found(spark, docs):
    for seed in (40, 63):
        rows = chained(seed)
        _, met = linked(spark, docs, rows)
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs(rows)).collect()}
        assert got == classes_of([i for i, _ in rows], met)


def test_odd_rows_of_near_duplicates(spark, docs):
    text = prose(60, 1)
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "two words"), (6, "Two  words."), (7, "!!!"), (8, "???"), (None, text), (9, "long " * 60000), (10, "long " * 60000)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 9}
    kept = keep_one(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 5, 7, 8, 9]
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == docs([]).columns
    assert near_duplicates(docs([])).count() == 0


def test_rows_that_share_an_id_are_one_document(spark, docs):
    a, b = prose(80, 3), prose(80, 4)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs([(5, a), (5, b), (7, b), (3, a)])).collect()}
    assert len(set(got.values())) == 1


def test_samples_agree_as_often_as_the_weighted_similarity():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 30))
    wa, wb = r.uniform(0.5, 8, 80), r.uniform(0.5, 8, 90)
    wb[:60] = wa[:60] * r.uniform(0.5, 2, 60)
    left = samples(np.append(common, a), wa, np.array([0, 80]), 4000)[0]
    right = samples(np.append(common, b), wb, np.array([0, 90]), 4000)[0]
    exact = np.minimum(wa[:60], wb[:60]).sum() / (np.maximum(wa[:60], wb[:60]).sum() + wa[60:].sum() + wb[60:].sum())
    assert abs((left == right).mean() - exact) < 0.03


def test_frequencies_cover_all_rows(spark, docs):
    rows = [(i, "same five words stand here") for i in range(30)] + [(99, prose(50, 9)), (100, None)]
    table, n = frequencies(docs(rows).repartition(7))
    assert n == 32 and table.max() == 30 and table.sum(1).tolist() == [76, 76]
    idf = Weights(table, n)
    assert np.allclose(idf(bags(pa.array(["Same five words, stand here!"]))[0]), 1 + math.log(32 / 30) / math.log(32), atol=1e-3)
    assert np.allclose(idf(bags(pa.array([prose(50, 9)]))[0]), 2, atol=1e-3)


def test_weights_do_not_depend_on_the_number_of_documents():
    rng = np.random.default_rng(4)
    shingles = rng.integers(1, 1 << 63, 5).astype(np.uint64) * np.uint64(2)
    seen = []
    for n in (50_000, 5_000_000, 5_000_000_000):
        table = rng.poisson(300 * n / (1 << 20), (2, 1 << 20)).astype(np.int64)
        for share, x in zip((1.0, 0.3, 0.05, 0.01, 0.0), shingles, strict=True):
            for row, at in zip(table, slots(np.array([x])), strict=True):
                row[at] += int(share * n)
        seen.append(Weights(table, n)(shingles))
    for share, w in zip((1.0, 0.3, 0.05, 0.01), seen[1], strict=False):
        assert abs(w - (1 + math.log(1 / share) / math.log(RARE))) < 0.02
    assert np.allclose(seen[0], seen[1], atol=0.02) and np.allclose(seen[1], seen[2], atol=0.02) and seen[2][4] > 1.99


def test_similarity_is_weighted_jaccard():
    idf = Weights(np.random.default_rng(0).integers(0, 900, (2, 1 << 20)), 1000)
    x, y = prose(40, 1), edited(prose(40, 1), 1, 2)
    got = similarities(pa.array([x, None]), pa.array([y, "a"]), idf)

    bag = [dict(zip(*(v.tolist() for v in bags(pa.array([t]))[:2]), strict=True)) for t in (x, y)]
    w = {h: float(idf(np.array([h], np.uint64))[0]) for b in bag for h in b}
    low = sum(w[h] * min(bag[0].get(h, 0), bag[1].get(h, 0)) for h in w)
    high = sum(w[h] * max(bag[0].get(h, 0), bag[1].get(h, 0)) for h in w)
    assert abs(got[0] - low / high) < 1e-9 and got[1] == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_leaks_are_found_and_clean_documents_stay(spark, docs):
    items = [(k, prose(n, 50 + k)) for k, n in enumerate((18, 35, 60, 4, 2))]
    bench = spark.createDataFrame([*items, (8, None), (9, " "), (9, " ")], "item_id long, text string")
    rows = [
        (1, prose(50, 1) + " " + items[0][1].upper() + ". " + prose(30, 2)), (2, items[1][1]), (3, prose(300, 3)), (4, "x " + items[3][1] + " y"), (5, None), (6, ""),
        (7, prose(40, 4) + "\n" + edited(items[2][1], 1, 7) + " " + prose(9, 5)), (8, " ".join(items[1][1].split()[:20]) + " " + prose(50, 6)), (9, items[2][1] + " " + items[0][1]),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(docs(rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 3), (7, 2), (9, 2), (9, 0)}
    assert got[1, 0]["start"] == 50 and got[1, 0]["similarity"] == 1.0 and got[1, 0]["hamming"] == 0
    clean = decontaminate(docs(rows), bench, items_a_pass=2)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 6, 8] and clean.columns == docs([]).columns
    assert leaks(docs([]), bench).count() == 0 and leaks(docs(rows), bench.limit(0)).count() == 0


def test_passes_give_the_same_leaks_as_one(spark, docs):
    common = prose(8, 400)
    items = [(k, common + " " + prose(22, 300 + k)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, prose(20, k) + " " + edited(t, 1, k) + " " + prose(20, 90 + k)) for k, t in items] + [(50 + k, t) for k, t in items]
    one, many = (sorted(map(tuple, leaks(docs(rows), bench, similarity=0.6, items_a_pass=n).collect())) for n in (5000, 3))
    assert one == many and len(one) >= 12


def test_leaks_match_brute_force(spark, docs):
    r = random.Random(12)
    items = [(k, prose(r.choice((8, 12, 20)), 400 + k)) for k in range(6)] + [(None, prose(15, 900)), (7, "  "), (3, prose(12, 777))]
    rows = []
    for k in range(30):
        words = prose(r.randint(5, 60), 5000 + k).split()
        if k % 2:
            item = r.choice(items[:7])[1].split()
            for _ in range(r.choice((0, 0, 1))):
                item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = item
        rows.append((k, " ".join(words)))
    rows += [(100, None), (101, items[0][1]), (101, items[0][1]), (None, items[1][1]), (102, "filler words " * 30_000 + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = Index([i for i, t in items if t.strip()], [t for _, t in items if t.strip()])
    want = []
    for d, text in rows:
        words = word_hashes(pa.array([text or ""]))[0]
        for i, own in enumerate(index.words):
            m = min(len(own), len(words))
            if not m:
                continue
            best = None
            for start in range(len(words) - m + 1) if len(words) < 1000 else range(len(words) - m - 20, len(words) - m + 1):
                if not set(words[start : start + m].tolist()) & set(own.tolist()):
                    continue
                gap = int(np.bitwise_count(index.fingerprints(words[start : start + m], np.array([0]), m) ^ index.prints[i])[0])
                s = index.similarity(words[start : start + m], i) if gap <= RADIUS else 0
                if s >= 0.8 and (best is None or s > best[3]):
                    best = (start, m, gap, s)
            if best:
                want.append((d, index.ids[i], *best))
    got = [tuple(x) for x in leaks(docs(rows), bench).collect()]
    assert len(want) > 8 and sorted(got, key=str) == sorted(want, key=str)


def test_the_index_finds_every_fingerprint_in_the_radius():
    index = Index(list(range(40)), [prose(30, k) for k in range(40)])
    r = np.random.default_rng(2)
    probes = []
    for p in index.prints:
        for n in (0, 3, BLOCKS * 3, RADIUS):
            flip = sum(1 << int(b) for b in r.choice(64, n, replace=False))
            probes.append(p ^ np.uint64(flip))
    probes = np.array(probes, np.uint64)
    got = set(zip(*(x.tolist() for x in index.within(probes)), strict=True))
    want = {(w, i) for w, p in enumerate(probes) for i, q in enumerate(index.prints) if int(p ^ q).bit_count() <= RADIUS}
    assert got == want
