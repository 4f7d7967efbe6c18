import math
from collections import defaultdict

from reelmill.llm import mixing as M
from tests.llm import edge


def brute(tokens, target, limit):
    total = sum(tokens.values())
    p = [t / total for t in tokens.values()]

    def entropy(a):
        z = sum(x**a for x in p)
        return -sum(x**a / z * math.log(x**a / z) for x in p) / math.log(len(p))

    def edge_of(ok):
        lo, hi = 0.0, 1.0
        if ok(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    return max(edge_of(lambda a: entropy(a) >= target), edge_of(lambda a: (max(p) / min(p)) ** (1 - a) > limit))


def table(spark, n=400):
    data = [(i, "w " * (1 + i * 37 % 50), None, "hot" if i % 3 else f"s{i % 4}", None, "", "", "", 1, "", "") for i in range(n)]
    return edge.table(spark, data), data


def test_weights_and_draws_against_brute_force(spark):
    docs, data = table(spark)
    for target, limit in ((0.95, 1.25), (0.95, 100.0), (0.2, 1.5), (1.0, 3.0)):
        tokens = defaultdict(int)
        for _, t, _, s, *_ in data:
            tokens[s] += len(t.split())
        rows = M.mix(docs, target, limit, block_tokens=500).collect()
        alpha = rows[0].alpha
        assert abs(alpha - brute(tokens, target, limit)) < 1e-5
        total = sum(tokens.values())
        raw = {s: (t / total) ** alpha for s, t in tokens.items()}
        least = min(raw[s] / tokens[s] for s in raw)
        epochs = {s: raw[s] / tokens[s] / least for s in raw}
        assert max(epochs.values()) <= limit + 1e-6
        drawn, times = defaultdict(int), defaultdict(int)
        for r in rows:
            assert abs(r.weight - raw[r.source] / sum(raw.values())) < 1e-9
            drawn[r.source] += r.tokens
            times[r.doc_id, r.epoch] += 1
        assert set(times.values()) == {1} and {d for d, e in times if e == 0} == {d for d, *_ in data}
        for s, t in tokens.items():
            assert epochs[s] * t - 1e-6 <= drawn[s] < epochs[s] * t + 50
        share = defaultdict(lambda: defaultdict(int))
        for r in rows:
            share[r.block][r.source] += r.tokens
        for block in list(share.values()):
            for s in raw:
                assert abs(block[s] - raw[s] / sum(raw.values()) * sum(block.values())) < 160


def test_apply_repeats_rows(spark):
    docs, data = table(spark)
    mixture = M.mix(docs, 1.0, 2.0)
    want = defaultdict(int)
    for r in mixture.collect():
        want[r.doc_id] += 1
    out = M.apply_mix(docs, mixture)
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == want and out.columns == docs.columns and max(got.values()) == 2


def test_partitions_lie_in_the_order_of_the_mixture(spark):
    from pyspark.sql import functions as F

    docs, data = table(spark, 900)
    mixture = M.mix(docs, 1.0, 2.0, block_tokens=300)
    order = defaultdict(list)
    for r in mixture.orderBy("block", "slot_key").collect():
        order[r.doc_id].append((r.block, r.slot_key))
    placed = M.apply_mix(docs, mixture).select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).collect()
    parts = defaultdict(list)
    for r in sorted(placed, key=lambda r: r["at"]):
        parts[r.part].append(r.doc_id)
    seen, got = defaultdict(int), []
    for ids in parts.values():
        places = []
        for d in ids:
            places.append(order[d][seen[d]])
            seen[d] += 1
        assert places == sorted(places)
        got += places
    assert sorted(got) == sorted(x for some in order.values() for x in some) and len({b for b, _ in got}) > 8


def test_edges(spark):
    docs = edge.table(spark)
    mixture = M.mix(docs)
    assert mixture.filter("epoch = 0").count() == len(edge.rows())
    out = M.apply_mix(docs, mixture).collect()
    assert len(out) >= len(edge.rows()) and {r.doc_id for r in out} == {r[0] for r in edge.rows()}
    assert len(out) - len(edge.rows()) == mixture.filter("epoch > 0 and doc_id is not null").count()
    assert M.mix(edge.table(spark, [])).collect() == [] and M.apply_mix(edge.table(spark, []), M.mix(edge.table(spark, []))).collect() == []
