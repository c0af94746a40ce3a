"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names, bounds that prune."""

import math
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest

from riskloom.llm import op11_whitening as W
from riskloom.llm import op12_mixing as M
from riskloom.llm import op13_search as S

KIND = "vec_id long, embedding array<double>, n long, component int, x string, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 8, "x", 9) for i, v in rows], KIND).repartition(3)


def dense(seed, n, d, decay=0.5):
    rng = np.random.default_rng(seed)
    mix = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return (rng.normal(size=(n, d)) * decay ** np.arange(d)) @ mix


def test_whitening_equals_the_eigenvectors(spark):
    v = dense(1, 300, 12)
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)] + [(3, list(map(float, v[3]))), (None, list(map(float, v[4])))]
    bad = [(900, None), (901, [None] * 12), (902, [math.nan] + [0.0] * 11), (903, [math.inf] + [0.0] * 11), (904, [-math.inf, None] + [0.0] * 10)]
    got = W.whiten(vectors(spark, rows + bad)).collect()
    x = np.array([[math.floor(1024 * c) + 100000 for c in r] for _, r in rows], np.int64)
    n = len(x)
    y = (x * n - x.sum(axis=0)) / n
    values, parts = np.linalg.eigh(y.T @ y / n)
    values, parts = values[::-1], parts[:, ::-1]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    far = ((x * n - x.sum(axis=0)).astype(object) ** 2).sum(axis=1)
    want = defaultdict(list)
    for (i, _), a, f in zip(rows, y @ parts / np.sqrt(values), far, strict=True):
        want[i].append((a, int(f)))
    signs = {}
    for r in got:
        k = r["component"]
        assert abs(r["explained"] - values[k - 1] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9
        a, f = next((a, f) for a, f in want[r["vec_id"]] if int(r["deviation"]) == f)
        if abs(a[k - 1]) > 1e-6:
            sign = signs.setdefault(k, np.sign(a[k - 1] * r["whitened"]))
            assert abs(a[k - 1] * sign - r["whitened"]) < 1e-8
    assert Counter(r["vec_id"] for r in got)[3] == 16


def test_whitening_of_few_directions_and_of_nothing(spark):
    flat = np.outer(np.arange(40.0), [1.0, 2.0, 0.0, -1.0, 0.0]) + np.outer(np.arange(40) % 3, [0.0, 1.0, 1.0, 0.0, 0.0])
    got = W.whiten(vectors(spark, [(i, list(map(float, x))) for i, x in enumerate(flat)])).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9
    for rows in ([], [(1, None)], [(1, []), (2, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(5, [3.0])]):
        assert W.whiten(vectors(spark, rows)).count() == 0
    assert W.whiten(vectors(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [2.0, 5.0])])).count() == 3
    with pytest.raises(ValueError, match="from 1 to 2"):
        W.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_whitening_keeps_small_directions(spark):
    """Singular values over seven orders: one Gram matrix has lost the last of them, the repeated passes haven't."""
    rng = np.random.default_rng(5)
    big, small = rng.integers(-(2**33), 2**33, 400), rng.integers(-40, 40, 400)
    v = np.column_stack([big, big + small, rng.integers(-(2**20), 2**20, 400)]) / 1024.0
    got = W.whiten(vectors(spark, [(i, list(map(float, x))) for i, x in enumerate(v)])).collect()
    assert len(got) == 1200 and max(r["identity_error"] for r in got) < 1e-4
    # the last direction is the difference of the first two columns, less what the others explain of it
    others = np.column_stack([np.ones(400), big / 2**33, v[:, 2]])
    small = small - others @ np.linalg.lstsq(others, small, rcond=None)[0]
    least = np.array([r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == 3])
    assert abs(np.corrcoef(least, small)[0, 1]) > 0.99999


def test_deviations_beyond_64_bits():
    x, n = np.array([[2**30, -(2**30)], [5, 7]], np.int64), 2**20
    sums = np.array([3, 4], np.int64)
    assert W.deviations(x, n, sums) == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert Decimal(W.deviations(x, n, sums)[0]) > 2**63


TEXTS = "documents"


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(i, s, t, 1, 2.0, "k") for i, s, t in rows], "doc_id long, source string, text string, size int, target double, key string").repartition(5)
    return [tuple(r) for r in M.mix(df, **options).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By resharing, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole >= most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_mixing_meets_budgets(spark):
    rng = random.Random(2)
    names = ["b", "a", None, "é", "Z", "hot", "", "𝄞"]
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(names), rng.choice([None, "", " \n", "w " * rng.randrange(60), "x\ty\x0bz"])) for i in range(600)]
    rows += [(5000, "a", "w " * 9000), (7, "b", "one two"), (7, "b", "one two"), (None, "b", "three"), (None, None, None)]
    got = mixed(spark, rows)
    sizes = Counter({s: 0 for _, s, _ in rows})
    for _, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    assert sorted((g[0] is None, g[0] or 0, g[1] or "~", g[2]) for g in got) == sorted((i is None, i or 0, s or "~", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows)
    taken = Counter()
    for _, s, size, whole, target, took in got:
        assert whole == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= took <= 2 * size
        taken[s] += took
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    # at most one document of a source is cut: the others are taken a whole number of times, and those counts are at most one apart
    for s in sizes:
        times = [took / size for _, x, size, _, _, took in got if x == s and size]
        assert sum(t != int(t) for t in times) <= 1 and (not times or max(times) - min(times) <= 1)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(mixed(spark, rows), key=key) == sorted(got, key=key)


def test_mixing_of_little(spark):
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, None, None), (2, "a", "")]) in ([(1, None, 0, 0, 0.0, 0), (2, "a", 0, 0, 0.0, 0)], [(2, "a", 0, 0, 0.0, 0), (1, None, 0, 0, 0.0, 0)])
    assert mixed(spark, [(1, "a", "one two three four")]) == [(1, "a", 4, 4, 6.0, 6)]
    with pytest.raises(ValueError, match="can't be reached"):
        mixed(spark, [(1, "a", "x")], share=3.0)


def brute_search(docs, items, k=20):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in pattern.findall(t or "")]
    counted = [(i, Counter(low(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m = 100 - 25 + ((25 * sum(c.values()) * n_docs) // n_terms) if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in low(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if nil else i, -s) for r, (s, nil, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def searched(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in docs], "doc_id long, text string, rank int, score long, n string").repartition(4)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in S.search(d, q, **options).select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: tuple((v is None, v) for v in r))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "straße", "x1", "漢字", "É"]
    made = [(i, " ".join(rng.choice(words) if rng.random() < 0.5 else words[int(rng.expovariate(0.1)) % 300] for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    return made, [(i, " ".join(rng.sample(words, 25))) for i in range(8)]


def test_search_equals_all_scores(spark):
    docs, items = corpus(1, 500)
    docs += [(1000, None), (1001, ""), (1002, "!!! ---"), (3, docs[3][1]), (None, "w1 w2 Über"), (None, "w1 w2 Über"), (1003, "w7 " * 20000 + "W8")] + [(2000 + i, "w1 w2 w3 w4 w5,W6") for i in range(60)]
    items += [(20, None), (21, "nothing known"), (22, "w1 w2 w3 w4 w5 w6 w6"), (22, "W7|w8"), (None, "über É Straße 漢字"), (23, "")]
    assert searched(spark, docs, items) == brute_search(docs, items)
    assert searched(spark, docs, items, k=3) == brute_search(docs, items, 3)


def test_search_in_small_blocks_and_buckets(spark, monkeypatch):
    docs, items = corpus(2, 300)
    for name, value in (("BLOCK_ITEMS", 3), ("BLOCK_TERMS", 60), ("CELLS", 2000), ("FOCUS", 2)):
        monkeypatch.setattr(S, name, value)
    assert searched(spark, docs, items) == brute_search(docs, items)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_prune_and_keep_what_counts():
    """A bucket of short vectors is dropped whole, and inside a bucket few of the pairs are scored; the lists stay those of all pairs."""
    rng = np.random.default_rng(3)
    terms, width = 400, 500
    weights = rng.integers(100, 9000, terms)
    block = S.Block([{int(t): 1 for t in rng.choice(terms, 30, replace=False)} for _ in range(6)], terms, 20)
    table = np.where(rng.random((terms, width)) < 0.05, weights[:, None] * rng.integers(1, 100, (terms, width)), 0)
    for i in range(6):  # a few documents of each query's own words
        for d in range(30):
            table[block.codes[i], 30 * i + d] = weights[block.codes[i]] * 90
    codes, rows = np.nonzero(table)
    lengths = np.sqrt((table.astype(float) ** 2).sum(axis=0))
    none, last = np.zeros(6, np.int64), np.full(6, S.NULL_ID)
    lists = S.Lists(6, 20, none, last)
    scores = np.array([(table[c] * n[:, None]).sum(axis=0) for c, n in zip(block.codes, block.counts, strict=True)])
    need = np.sort(scores, axis=1)[:, -20]
    lists = S.Lists(6, 20, need, last)
    scored = S.search_bucket(block, weights, lists, np.arange(width), lengths, codes, table[codes, rows], rows)
    for i in range(6):
        want = np.lexsort((np.arange(width), -scores[i]))[:20]
        assert lists.ids[i].tolist() == want.tolist() and lists.scores[i].tolist() == scores[i][want].tolist()
    assert scored < 0.5 * 6 * width
    assert S.search_bucket(block, weights, S.Lists(6, 20, need, last), np.arange(3), np.ones(3), np.arange(3), np.ones(3, np.int64), np.arange(3)) == 0
