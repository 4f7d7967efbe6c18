import hashlib
import math
import random

import numpy as np
import pytest

from reelmill.llm import centroids as C
from reelmill.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, label int, q string, cluster int, near string"


def plain(data, k=8, rounds=10, seed=3, dims=64):
    kept = [(d, [math.floor(1024 * float(np.float32(x))) for x in v]) for d, v in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda d: hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        who = assign()
        for i in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, who, strict=True) if c == i]
            if mine:
                centres[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    who = assign()
    sums = [sum(d for d, c in who if c == i) for i in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(d), c, dist, sums[c], sum(sums), sha[c]) for (d, _), (dist, c) in zip(kept, who, strict=True))


def rows(n=120, seed=1, dims=64):
    rng = random.Random(seed)
    heart = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    made = [(i, [x + rng.gauss(0, 0.4) for x in heart[i % 5]]) for i in range(n)]
    made += [(n, None), (n + 1, []), (n + 2, [0.5] * (dims - 1)), (n + 3, [None] + [0.5] * (dims - 1)), (n + 4, [float("nan")] + [0.5] * (dims - 1)), (n + 5, [float("-inf")] + [0.5] * (dims - 1))]
    made += [made[7], made[7], (7, made[8][1]), (None, made[9][1]), (None, [0.0] * dims), (n + 6, [-0.0] * dims), (n + 7, [1e-9] * dims), (n + 8, [-1e-9] * dims)]
    return made


def table(spark, data):
    return spark.createDataFrame([(d, v, 1, "x", 9, "y") for d, v in data], SCHEMA).repartition(3)


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("case", ["all", "few", "equal", "none", "large"])
def test_against_plain_rounds(spark, case):
    data = rows()
    if case == "few":
        data = data[:5]
    if case == "equal":
        data = [(i, [0.25] * 64) for i in range(20)] + [(20, [3.0] * 64)]
    if case == "none":
        data = [(1, None), (2, [1.0])]
    if case == "large":
        data = [(i, [x * 1e5 for x in v]) for i, v in rows(20) if v is not None and len(v) == 64 and v[0] is not None and math.isfinite(v[0])]
    assert found(C.cluster(table(spark, data))) == plain(data)
    assert C.cluster(table(spark, [])).collect() == []


def test_the_registered_query(spark, sf_dir):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(Q.op13_pivot_clusters(spark, sf_dir)) == plain(data)


def test_a_component_beyond_long_is_an_error(spark):
    with pytest.raises(Exception, match="beyond 2\\^62"):
        C.cluster(table(spark, [(1, [1e30] * 64)])).collect()


def test_bounds_never_hide_the_nearest():
    rng = np.random.default_rng(2)
    heart = rng.integers(-4000, 4000, (6, 16))
    q = heart[rng.integers(0, 6, 500)] + rng.integers(-300, 300, (500, 16))
    pivots = C.choose_pivots(q[:100], 6)
    assert len(pivots) == 6 and len(C.choose_pivots(np.zeros((9, 4), np.int64), 3)) == 1
    who, best, measured = C.nearest(q, C.to_pivots(q, pivots), heart, C.to_pivots(heart, pivots))
    d = ((q[:, None, :] - heart[None]) ** 2).sum(2)
    assert (who == d.argmin(1)).all() and (best == d.min(1)).all()
    assert measured < 0.5 * d.size  # the bounds spare most of the distances
    x = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 31) ** 2, (1 << 31) ** 2 - 1, (3_037_000_498) ** 2 - 1])
    assert C.roots(x).tolist() == [math.isqrt(int(v)) for v in x] == [int(v) for v in C.roots(x.astype(object))]
