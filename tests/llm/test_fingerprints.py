import hashlib

import numpy as np
import pytest

from reelmill.llm import fingerprints as P
from reelmill.llm import queries as Q
from tests.llm import edge


def grams(text):
    w = [x for x in (text or "").lower().split(" ") for x in x.split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def follow(data, tie):
    """doc_id, text, text of the next row, in order."""
    rows = sorted(((d is None, d or 0, tie[t or ""], d, t or "") for d, t, *_ in data), key=lambda r: r[:3])
    return [(r[3], r[4], rows[(i + 1) % len(rows)][4]) for i, r in enumerate(rows)]


def check(found, data, spark):
    texts = sorted({t or "" for _, t, *_ in data})
    tie = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) h").collect()} if texts else {}
    want = []
    for d, t, nxt in follow(data, tie):
        k = len(t) // 4
        new = t[: len(t) - k] + nxt[:k]
        want.append((-1 if d is None else d, len(t), hashlib.sha256(new.encode()).hexdigest(), jaccard(grams(t), grams(new)), jaccard(grams(t), grams(nxt))))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert abs(a[3] - b[3]) < 0.13 and abs(a[4] - b[4]) < 0.13, (a, b)
    return got


def test_edges_against_plain_sets(spark):
    found = P.follow(edge.table(spark)).collect()
    check(found, edge.rows(), spark)
    texts = {d: t for d, t, *_ in edge.rows() if d is not None}
    prints = {}
    for r in found:
        if r.doc_id is not None:
            assert prints.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
            assert len(r.fingerprint) == (P.BINS * P.BITS // 8 if (texts[r.doc_id] or "").split() else 0)


@pytest.mark.parametrize("ids", [[], [5], [5, 5], [None, None, 3], list(range(60))])
def test_ranges_meet(spark, ids):
    data = [(d, f"{i % 7} " * (i % 11) + f"a b c d e f {i}", None, None, None, "", "", "", 1, "", "") for i, d in enumerate(ids)]
    check(P.follow(edge.table(spark, data)).collect(), data, spark)


def test_the_registered_query(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = Q.op11_document_fingerprints(spark, sf_dir).collect()
    check(found, data, spark)
    assert all(set(r.fingerprint) <= set("0123456789abcdef") for r in found)


def test_densification_and_bits():
    rng = np.random.default_rng(1)
    for held in (1, 2, 3, 40, 600):
        ids = rng.integers(0, 1 << 40, held).astype(np.uint64)
        found = P.sketch(np.zeros(held, np.int64), ids, 1)
        full = P.densify(found)
        assert (full != P.EMPTY).all() and (full[found != P.EMPTY] == found[found != P.EMPTY]).all()
        kept = set(found[found != P.EMPTY].tolist())
        assert set(full.ravel().tolist()) <= kept
        for b in np.flatnonzero(found[0] == P.EMPTY):
            asked = P.probes(P.BINS)[:, b]
            hits = asked[found[0, asked] != P.EMPTY]
            assert full[0, b] == found[0, hits[0]]
    assert (P.densify(np.full((2, P.BINS), P.EMPTY)) == P.EMPTY).all()
    for bits in (1, 3, 8):
        code = rng.integers(0, 1 << bits, (4, 40)).astype(np.uint8)
        back, any_word = P.unpacked(P.packed(code, np.array([True, False, True, True]), bits), 40, bits)
        assert (back[[0, 2, 3]] == code[[0, 2, 3]]).all() and any_word.tolist() == [True, False, True, True]


def test_probes_that_fill_nothing_end_at_the_next_bin(monkeypatch):
    monkeypatch.setattr(P, "PROBES", 1)
    monkeypatch.setattr(P, "_TABLES", {})
    found = np.full((1, 64), P.EMPTY)
    found[0, [3, 40]] = 7, 9
    assert (P.densify(found) != P.EMPTY).all()


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_bias_correction(bits):
    rng = np.random.default_rng(bits)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 3000)]
    errors = []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        k = int(1500 * share)
        a, b = " ".join(words[:1500]), " ".join(words[:k] + words[1500 : 3000 - k])
        (x, y), ok = P.codes([a, b], 2048, bits)
        errors.append(P.likeness(x[None], y[None], ok[:1], ok[1:], bits)[0] - jaccard(grams(a), grams(b)))
    assert max(map(abs, errors)) < 0.09


def test_fingerprints_and_compare(spark):
    prints = P.fingerprints(edge.table(spark))
    assert prints.count() == len(edge.rows())
    pairs = prints.alias("x").join(prints.alias("y"), "doc_id").selectExpr("doc_id", "x.fingerprint a", "y.fingerprint b")
    assert {r.likeness for r in P.compare(pairs, "a", "b").collect()} == {1.0}
