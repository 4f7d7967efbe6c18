import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from reelmill.llm import packing as P
from reelmill.llm.queries import vocabulary
from tests.llm import edge


def test_pack_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = P.pack_documents(edge.table(spark), *vocabulary()).collect()
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t, *_ in edge.rows()}
    want = defaultdict(int)
    for d, *_ in edge.rows():
        want[d] += len(ids[d])
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(want.values())
    assert len(bins) <= total / 1024 * 1.05 + 2
    assert P.pack_documents(edge.table(spark, []), *vocabulary()).collect() == []


def test_ids_are_those_of_the_json(spark):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    place = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(place)
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|", "<|", "|>", " ", "  ", "\n", "It's", "a", "É", "日本", "1", "😀", "\u00a0"]
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 1500] + ["".join(rng.choices(parts, k=12)) for _ in range(300)]
    rows = P.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *vocabulary()).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for d, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want |= {(d, k): (a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(P.pieces_of(len(ids), 1024))}
    assert tok.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275] and got == want
    with open(place) as f:
        assert {t["content"]: t["id"] for t in json.load(f)["added_tokens"]} == P.SPECIAL


@pytest.mark.parametrize("rule", ["dot", "norm"])
@pytest.mark.parametrize("limits", [{}, {"max_docs": 3}, {"max_cost": 400_000}, {"max_docs": 4, "max_cost": 300_000}])
def test_every_constraint_holds(rule, limits):
    rng = random.Random(5)
    lengths = np.array([rng.choice([1, 5, 60, 300, 511, 512, 513, 700, 1023]) for _ in range(400)])
    bins, offsets = P.best_fit(lengths, rule=rule, **limits)
    for b in set(bins.tolist()):
        n = lengths[bins == b]
        assert n.sum() <= 1024 and len(n) <= limits.get("max_docs", 1024)
        assert (n**2).sum() <= limits.get("max_cost", 1 << 20) or len(n) == 1
        assert sorted(zip(offsets[bins == b], n, strict=True)) == list(zip(np.cumsum(sorted_by(offsets[bins == b], n)) - sorted_by(offsets[bins == b], n), sorted_by(offsets[bins == b], n), strict=True))
    if not limits:
        assert len(set(bins.tolist())) <= 1.1 * lengths.sum() / 1024 + 1


def sorted_by(offsets, n):
    return n[np.argsort(offsets)]


def test_groups_are_bounded(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + id % 700 as length", "id as ids_crc32")
    rows = P.pack(pieces, group=500).collect()
    assert len({r.sequence_id >> 40 for r in rows}) > 1
    sums = defaultdict(int)
    for r in rows:
        sums[r.sequence_id] += r.length
    assert max(sums.values()) <= 1024 and sum(sums.values()) == sum(1 + i % 700 for i in range(3000))


def test_groups_of_consecutive_rows(spark):
    pieces = spark.range(0, 3000, 1, 3).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + id % 1024 as length", "id as ids_crc32", "monotonically_increasing_id() as place")
    rows = P.pack(pieces, group=250, in_order=True).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    assert len(rows) == 3000 and max(sum(r.length for r in b) for b in bins.values()) <= 1024
    assert all(len({r.doc_id // 250 for r in b}) == 1 for b in bins.values())
    assert all(o == sum(r.length for r in b if r.offset < o) for b in bins.values() for o in [x.offset for x in b])
