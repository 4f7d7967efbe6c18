import zlib
from collections import defaultdict

from reelmill.llm import sharding as S
from tests.llm import edge


def check(rows, data, shards):
    assert len(rows) == len(data)
    texts = {d: t or "" for d, t, *_ in data}
    where, slots, loads, groups = {}, defaultdict(list), defaultdict(int), defaultdict(int)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert where.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        groups[raw] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return loads, groups


def test_edges(spark):
    check(S.shard_documents(edge.table(spark)).collect(), edge.rows(), 24)
    assert S.shard_documents(edge.table(spark, [])).collect() == []


def test_balance_and_slots_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_BUCKET", 10)
    data = [(i, f"{i % 700} " * (1 + i * 31 % 40), None, None, None, "", "", "", 1, "", "") for i in range(2500)]
    loads, groups = check(S.shard_documents(edge.table(spark, data), 8).collect(), data, 8)
    fair = sum(groups.values()) / 8
    assert max(loads.values()) - min(loads.values()) <= max(fair * 0.02, max(groups.values()))


def test_lpt_against_a_plain_loop():
    sizes = {i: (i * 7919) % 101 + 1 for i in range(60)}
    loads, want = [0] * 5, {}
    for item in sorted(sizes, key=lambda i: (-sizes[i], i)):
        k = min(range(5), key=lambda s: (loads[s], s))
        want[item] = k
        loads[k] += sizes[item]
    assert S.lpt(sizes, 5) == want
