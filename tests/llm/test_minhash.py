import random
from collections import Counter

import numpy as np

from reelmill.llm import minhash as M
from tests.llm import edge


def grams(text):
    w = [x for x in (text or "").lower().split() if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(x, y):
    if not x and not y:
        return 1.0
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x.keys() & y.keys())


def classes(docs):
    up = {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(docs):
        for b, y in docs[:i]:
            if x.keys() & y.keys() or not (x or y):
                if similarity(x, y) >= 0.8:
                    low, high = sorted((find(a), find(b)))
                    up[high] = low
    return {d: find(d) for d in up}


def near_copies(seed=11):
    rng = random.Random(seed)
    data = []
    for g in range(12):
        base = edge.words(rng, rng.choice([30, 80, 200])).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            data.append((len(data), " ".join(w), "en", "s", None, "x", "y", "z", 1, "c", "g"))
    return data


def test_classes_against_brute_force(spark):
    data = near_copies()
    want = classes([(d, grams(t)) for d, t, *_ in data])
    got = {r.doc_id: r.class_id for r in M.near_duplicates(edge.table(spark, data)).collect()}
    assert got == want
    assert sorted(r.doc_id for r in M.drop_near_duplicates(edge.table(spark, data)).collect()) == sorted(set(want.values()))


def test_edges(spark):
    data = [r for r in edge.rows() if r[0] is not None]
    want = classes(list({d: grams(t) for d, t, *_ in data}.items()))
    found = M.near_duplicates(edge.table(spark)).collect()
    assert [(r.class_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]
    found = [r for r in found if r.doc_id is not None]
    assert len(found) == len(data) and {r.doc_id: r.class_id for r in found} == want
    named = [(3, "some few words", *[None] * 9), (None, "Some  few words", *[None] * 9)]
    assert {(r.doc_id, r.class_id, r.kept) for r in M.near_duplicates(edge.table(spark, named)).collect()} == {(3, 3, True), (None, 3, False)}
    kept = M.drop_near_duplicates(edge.table(spark))
    assert kept.columns == edge.SCHEMA.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert M.near_duplicates(edge.table(spark, [])).collect() == []


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(2)
    x = Counter(rng.randrange(200) for _ in range(300))
    y = Counter({k: v for k, v in x.items() if k % 5}) + Counter(rng.randrange(150, 260) for _ in range(40))
    both = [(np.full(len(c), i), np.array(list(c), np.uint64), np.array(list(c.values()))) for i, c in enumerate((x, y))]
    rows, ids, weights = (np.concatenate(z) for z in zip(*both, strict=True))
    sign = M.prob_minhash(rows, ids, weights, 2, 4096)
    assert abs((sign[0] == sign[1]).mean() - similarity(x, y)) < 0.04
    pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
    assert abs(M.probability_jaccard(pack(x), pack(y)) - similarity(x, y)) < 1e-9


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = ["a bb  ccc\n", "", None, "x y z " * 50, "Ünï çödé"]
    whole = [(c.tolist(), w.tolist()) for _, c, w in M.words_of(texts)]
    monkeypatch.setattr(M, "STEP", 16)
    parts = [(c.tolist(), w.tolist()) for _, c, w in M.words_of(texts)]
    assert sum((c for c, _ in parts), []) == sum((c for c, _ in whole), [])
    assert sum((w for _, w in parts), []) == sum((w for _, w in whole), [])


def test_pieces_and_blocks_do_not_change_signatures(monkeypatch):
    rng = np.random.default_rng(0)
    counts = np.concatenate([rng.integers(0, 6, 40), rng.integers(100, 300, 20)])
    rows = np.repeat(np.arange(60), counts)
    ids, weights = rng.integers(0, 1 << 40, len(rows)).astype(np.uint64), rng.integers(1, 4, len(rows))
    whole = M.prob_minhash(rows, ids, weights, 60)
    monkeypatch.setattr(M, "PIECE", 7 * M.M)
    assert (M.prob_minhash(rows, ids, weights, 60) == whole).all()


def test_units_of_many_blocks_lose_no_link(spark, monkeypatch):
    data = near_copies(5)
    want = classes([(d, grams(t)) for d, t, *_ in data])
    monkeypatch.setattr(M, "BLOCK_ROWS", 2)
    assert {r.doc_id: r.class_id for r in M.near_duplicates(edge.table(spark, data)).collect()} == want
    # no hub links: the units find all of them
    monkeypatch.setattr(M, "max_differ", lambda *_: -1)
    assert {r.doc_id: r.class_id for r in M.near_duplicates(edge.table(spark, data)).collect()} == want


def packed(counter):
    ids = np.array(sorted(hash(k) & ((1 << 40) - 1) for k in counter), np.uint64)
    by = {hash(k) & ((1 << 40) - 1): v for k, v in counter.items()}
    return ids, np.array([by[int(i)] for i in ids], np.uint32)


def test_forest_against_all_pairs():
    rng = random.Random(8)
    base = edge.words(rng, 90).split()
    bags = []
    for k in range(60):
        w = [x if rng.random() > 0.006 * (k % 5) else f"q{rng.randrange(9)}" for x in base] + (base[:30] if k % 7 == 0 else [])
        bags.append(packed(grams(" ".join(w))))
    comps = [k // 2 * 2 for k in range(60)]
    sides = [k % 2 for k in range(60)]
    for side in (sides, [2] * 60):
        found = M.forest(comps, side, bags, 0.8)
        up = {c: c for c in comps}

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(60):
            for j in range(i):
                if (side[i] == 2 or side[i] != side[j]) and M.probability_jaccard(bags[i], bags[j]) >= 0.8:
                    up[max(find(comps[i]), find(comps[j]))] = min(find(comps[i]), find(comps[j]))
        merges = len(set(comps)) - len({find(c) for c in comps})
        assert len(found) == merges and merges > 5
        assert all(M.probability_jaccard(bags[i], bags[j]) >= 0.8 and find(comps[i]) == find(comps[j]) for i, j in found)


def test_packed_shingles_come_back():
    for w in ([1, 1, 1], [1, 3, 2], []):
        ids = np.array([5, 1 << 33, (1 << 40) - 1][: len(w)], np.uint64)
        back = M._unpacked(M._packed(ids, np.array(w)))
        assert back[0].tolist() == ids.tolist() and back[1].tolist() == w
