import hashlib
import random

from reelmill.llm import suffix_dedup as S
from tests.llm import edge


def expected(docs, length):
    first = {}
    for d, b in sorted(docs.items()):
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, b in docs.items():
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))
        out.append((d, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect() if r.doc_id is not None)


def test_against_brute_force(spark):
    rng = random.Random(4)
    passages = ["".join(rng.choice("ab c") for _ in range(n)) for n in (50, 51, 80, 300)]
    data = []
    for i in range(60):
        t = "".join("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(70))) + rng.choice(passages)[rng.randrange(20) :] for _ in range(rng.randrange(4)))
        data.append((i * 7 % 61, t, None, None, None, "", "", "", 1, "", ""))
    docs = {d: t.encode() for d, t, *_ in data}
    assert found(S.cut_repeats(edge.table(spark, data))) == expected(docs, 50)
    assert found(S.cut_repeats(edge.table(spark, data), length=20)) == expected(docs, 20)


def test_edges(spark):
    data = edge.rows()
    docs = {d: (t or "").encode() for d, t, *_ in data if d is not None}
    got = found(S.cut_repeats(edge.table(spark)))
    assert sorted(set(got)) == expected(docs, 50) and len(got) == len([r for r in data if r[0] is not None])
    free = [r for r in S.cut_repeats(edge.table(spark)).collect() if r.doc_id is None]
    assert [(r.n_removed, bytes(r.kept)) for r in free] == [(0, b"no id at all here")]
    assert S.cut_repeats(edge.table(spark, [])).collect() == []


def test_steps_do_not_change_windows(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    docs = [bytes(rng.choice(b"ab ") for _ in range(n)) for n in (0, 49, 50, 51, 400, 10)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0] + [len(d) for d in docs])
    for step in (1 << 20, 64, 7):
        monkeypatch.setattr(S, "STEP", step)
        row, start, count, key = S.window_runs(data, offsets, 50)
        got = {(int(r), int(s) + i): int(k) for r, s, c, k in zip(row, start, count, key, strict=True) for i in range(c)}
        assert set(got) == {(i, j) for i, d in enumerate(docs) for j in range(len(d) - 49)}


def test_longest_previous_factors(monkeypatch):
    import numpy as np

    rng = random.Random(6)
    text = bytes(rng.choice(b"ab") for _ in range(300)) * 2
    flat, n, length = np.frombuffer(text, np.uint8), 500, 50
    starts = np.arange(n)
    place = np.array([rng.randrange(40) for _ in range(n)])
    words = S.suffix_words(flat, starts, length)

    def common(i, j):
        return next((k for k in range(length) if text[i + k] != text[j + k]), length)

    want = [max((common(i, j) for j in range(n) if place[j] < place[i]), default=0) for i in range(n)]
    assert S.previous_factors(words, place, length).tolist() == want
    assert S.previous_factors(words, place, length, 20).tolist() == [x if x >= 20 else 0 for x in want]
    for windows in (10**6, 100, 1):
        monkeypatch.setattr(S, "WINDOWS", windows)
        assert S._repeated(flat, starts, place, length).tolist() == [x >= length for x in want]


def test_many_groups_and_buckets(spark, monkeypatch):
    data = [r for r in edge.rows() if r[0] is not None]
    docs = {d: (t or "").encode() for d, t, *_ in data}
    monkeypatch.setattr(S, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(S, "PARTITIONS", 5)
    monkeypatch.setattr(S, "BATCH_BYTES", 5_000)
    assert sorted(set(found(S.cut_repeats(edge.table(spark))))) == expected(docs, 50)
