"""Near-duplicate detection by ProbMinHash signatures, banding and exact verification.

A document is the multiset of its lower-cased five-word shingles, each weighted by its count. Every shingle starts a
Poisson process whose rate is its weight; its arrivals fall on random signature components, and a component keeps the
shingle that arrives first. A shingle is dropped as soon as its next arrival is later than all components' first ones.
Two documents agree in a component with the probability Jaccard similarity of their weights. Bands of ROWS components
name candidate buckets. In a bucket candidates are first compared with its smallest document, so a bucket of any size
costs one pair a row. Buckets that still hold several components are dealt out in units: a bucket, or a pair of its
bounded blocks. A unit verifies its pairs on the exact similarity and passes on a spanning forest of the verified ones,
so it never emits more links than it has rows. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces, mixed, stored
from reelmill.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Shingle identities have this many bits.
ID_BITS = 40
#: Bytes of text that are hashed at once.
STEP = 1 << 17
#: Components that are worked on at once.
PIECE = 1 << 19
#: Bytes of text that a task takes from a batch at once.
BATCH_BYTES = 2 << 20
#: A unit holds at most two blocks of a bucket, each of about so many rows and bytes of shingles.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20
#: Beyond this many candidate documents the filter on the documents is a shuffled join, not a broadcast.
BROADCAST_IDS = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def max_differ(similarity: float, bits: int) -> int:
    """One-bit signatures that differ in more bits than this are below the similarity (by five standard deviations)."""
    p = (1 - similarity) / 2
    return int(bits * p + 5 * (bits * p * (1 - p)) ** 0.5)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse modulo 2^64; kept up to a little over STEP."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", int(_BASE)), ("back", pow(int(_BASE), -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, np.uint64(base)))), dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["back"][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (a run without ASCII white space) of data, by prefix sums of a polynomial."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    with np.errstate(over="ignore"):
        power, back = _powers(len(data))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
        return mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64)), start


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, last text + 1, bytes) of joined texts of about STEP bytes; a longer text comes in several slices."""
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) < STEP:
            size += len(texts[b]) + 1
            b += 1
        yield a, b, np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        a = b


def _long_words(text: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, slice by slice, each cut at white space."""
    out, a = [], 0
    while a < len(text):
        b = min(len(text), a + STEP)
        while b < len(text) and not _SPACE[text[b]]:
            b += 1
        out.append(word_hashes(text[a:b])[0])
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, words a text, word hashes) of consecutive texts."""
    raw = [(t or "").lower().encode() for t in texts]
    for a, b, data in _slices(raw):
        if b - a == 1 and len(data) > STEP:
            w = _long_words(data)
            yield a, np.array([len(w)]), w
            continue
        w, start = word_hashes(data)
        ends = np.cumsum([len(t) + 1 for t in raw[a:b]])
        yield a, np.bincount(np.searchsorted(ends, start, side="right"), minlength=b - a), w


def shingles(counts: np.ndarray, words: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, identity, weight) of the distinct n-word shingles; a text of fewer words has one shingle of all of them."""
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - at
    size = np.minimum(n, np.repeat(counts, counts))
    is_start = left >= size
    with np.errstate(over="ignore"):
        h = np.zeros(len(words), np.uint64)
        for i in range(n):
            nxt = np.zeros(len(words), np.uint64)
            nxt[: max(0, len(words) - i)] = words[i:]
            h = np.where(i < size, h * _BASE + nxt, h)
        h = mixed(h + size.astype(np.uint64)) >> np.uint64(64 - ID_BITS)
    # texts in a call are fewer than 2^(64 - ID_BITS)
    key = np.sort((row[is_start].astype(np.uint64) << np.uint64(ID_BITS)) | h[is_start])
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> np.uint64(ID_BITS)).astype(np.int64), key & np.uint64((1 << ID_BITS) - 1), weight


def prob_minhash(rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m signatures (ProbMinHash). In a round every live element has its next exponential arrival, or the next few
    where few elements are left; rows are in rising order, and long inputs go in pieces of PIECE components."""
    piece = max(1, PIECE // m)
    if n > piece:
        cut = np.searchsorted(rows, np.arange(0, n + piece, piece))
        parts = [(rows[a:b] - i * piece, ids[a:b], weights[a:b], min(piece, n - i * piece)) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i * piece < n]
        return np.concatenate([prob_minhash(*x, m) for x in parts])
    first = np.full(n * m, np.inf)
    sign = np.zeros(n * m, np.uint64)
    time = np.zeros(len(rows))
    rows, weights = rows.astype(np.int64), weights.astype(np.float64)
    turn = 1
    with np.errstate(over="ignore"):
        while len(rows):
            k = max(1, min(64, (1 << 16) // len(rows)))
            turns = np.arange(turn, turn + k, dtype=np.uint64)
            turn += k
            z = mixed((ids * np.uint64(0xD1342543DE82EF95))[:, None] + turns * _BASE)
            steps = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
            steps[:, 0] += time
            times = np.cumsum(steps, axis=1)
            slot = (rows[:, None] * m + (z & np.uint64(m - 1)).astype(np.int64)).ravel()
            flat = times.ravel()
            np.minimum.at(first, slot, flat)
            hit = np.flatnonzero(first[slot] == flat)
            sign[slot[hit]] = ids[hit // k]
            last = first.reshape(n, m).max(1)
            time = times[:, -1]
            live = time < last[rows]
            rows, ids, weights, time = rows[live], ids[live], weights[live], time[live]
    return sign.reshape(n, m)


def band_keys(sign: np.ndarray) -> np.ndarray:
    """n x BANDS keys; the band's number is part of its key."""
    with np.errstate(over="ignore"):
        part = sign.reshape(len(sign), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), part.shape[:2]).copy()
        for i in range(ROWS):
            key = mixed(key * _BASE + part[:, :, i])
    return key.view(np.int64)


def bit_words(sign: np.ndarray) -> np.ndarray:
    """One bit a component, as rows of signed 64-bit words; an element has another bit in each component, so that the
    bits of different elements agree independently."""
    with np.errstate(over="ignore"):
        bits = (mixed((sign + np.uint64(1)) * _BASE + np.arange(sign.shape[1], dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_pieces(batches, 1, BATCH_BYTES):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        prints, n_words, keys, bits = [], [], [], []
        for _, counts, words in words_of(texts):
            rows, grams, weights = shingles(counts, words)
            sign = prob_minhash(rows, grams, weights, len(counts))
            at = np.concatenate(([0], np.cumsum(counts)))
            prints += [hashlib.blake2b(words[at[i] : at[i + 1]].tobytes(), digest_size=16).hexdigest() for i in range(len(counts))]
            n_words.append(counts)
            keys.append(band_keys(sign))
            bits.append(bit_words(sign))
        if prints:
            bands = np.concatenate(keys)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
            word = np.concatenate(bits)
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints), pa.array(np.concatenate(n_words), pa.int64()), lists, pa.array(word[:, 0]), pa.array(word[:, 1])], ["doc_id", "fp", "n_words", "bands", "s0", "s1"])


def _packed(ids: np.ndarray, weights: np.ndarray) -> bytes:
    """Shingles in rising order: whether weights follow, 5 bytes an identity, then 4 bytes a weight unless all are 1."""
    small = ids.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return b"\1" + small + weights.astype(np.uint32).tobytes() if (weights != 1).any() else b"\0" + small


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(blob) - 1) // (9 if blob[0] else 5)
    ids = np.zeros((n, 8), np.uint8)
    ids[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 1).reshape(n, 5)
    return ids.view(np.uint64)[:, 0], np.frombuffer(blob, np.uint32, n, 1 + 5 * n) if blob[0] else np.ones(n, np.uint32)


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, its packed shingles)."""
    for batch in byte_pieces(batches, 1, BATCH_BYTES):
        blobs = []
        for _, counts, words in words_of(batch.column(1).to_pylist()):
            rows, grams, weights = shingles(counts, words)
            at = np.searchsorted(rows, np.arange(len(counts) + 1))
            blobs += [_packed(grams[a:b], weights[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc_id", "grams"])


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements d of 1 / sum_e max(x_e / x_d, y_e / y_d); the plain Jaccard if all weights are equal."""
    common, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    xs, ys = x[1].astype(np.float64), y[1].astype(np.float64)
    if xs.min() == xs.max() and ys.min() == ys.max():
        return len(common) / (len(xs) + len(ys) - len(common))
    xc, yc = xs[i], ys[j]
    only_x, only_y = xs.sum() - xc.sum(), ys.sum() - yc.sum()
    total = 0.0
    ratio = yc / xc
    for r in np.unique(ratio):
        # elements with this ratio share the denominator up to their own weight
        whole = only_x + only_y / r + np.maximum(xc, yc / r).sum()
        total += xc[ratio == r].sum() / whole
    return float(total)


def _verified(limit: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [probability_jaccard(_unpacked(x.as_py()), _unpacked(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            ok = pa.array([s >= limit - 1e-12 for s in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(ok)

    return run


def _lists(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of their ids, and for each position the stretch of that order with the same id after it."""
    order = np.argsort(ids, kind="stable")
    head = np.concatenate(([True], ids[order][1:] != ids[order][:-1]))
    stop = np.append(np.flatnonzero(head)[1:], len(ids))[np.cumsum(head) - 1]
    after, end = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    after[order], end[order] = np.arange(1, len(ids) + 1), stop
    return order, after, end


def _rare_heads(row: np.ndarray, ids: np.ndarray, weight: np.ndarray, total: np.ndarray, limit: float) -> np.ndarray:
    """Which shingles of each row are its head: the rarest ones, as many as it takes that the rest has less than `limit` of
    the row's weight. Of two rows whose common part is `limit` of both, the heads meet."""
    _, where, often = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((ids, often[where], row))
    run = np.cumsum(weight[order])
    before = np.concatenate(([0.0], np.cumsum(total)))[row]
    # what the row has from this shingle on
    rest = before + total[row] - np.concatenate(([0.0], run[:-1]))
    head = np.empty(len(ids), bool)
    head[order] = rest >= (limit - 1e-9) * total[row] - 1e-9
    return head


#: Beyond so many candidates of a row their common shingles are counted together, not a pair at a time.
TOGETHER = 48
#: Rows that are counted together, and the bytes of the table of the shingles that many rows have.
STRIP, DENSE_BYTES = 64, 24 << 20


class _Common:
    """Common shingles (and their weights) of each row with all rows of a unit: those that many rows have by products of
    tables, a strip of rows at a time, the others by the lists of their rows."""

    def __init__(self, n: int, row: np.ndarray, ids: np.ndarray, weight: np.ndarray, weighted: bool) -> None:
        self.n, self.weighted, self.at = n, weighted, -1
        _, column, often = np.unique(ids, return_inverse=True, return_counts=True)
        most = max(1, DENSE_BYTES // (4 * n))
        chosen = np.argsort(-often, kind="stable")[:most]
        chosen = chosen[often[chosen] >= max(TOGETHER, n // 32)]
        place = np.full(len(often), -1)
        place[chosen] = np.arange(len(chosen))
        dense = place[column] >= 0
        self.has = np.zeros((n, len(chosen)), np.float32)
        self.has[row[dense], place[column][dense]] = 1
        self.heavy = None
        if weighted:
            self.heavy = np.zeros_like(self.has)
            self.heavy[row[dense], place[column][dense]] = weight[dense]
        rest = np.flatnonzero(~dense)
        self.weight, self.start = weight[rest], np.searchsorted(row[rest], np.arange(n + 1))
        order, self.after, self.end = _lists(ids[rest]) if len(rest) else (rest, rest, rest)
        self.listed, self.listed_weight = row[rest][order], weight[rest][order]

    def of(self, x: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """How many shingles x shares with each row; with weights, what they weigh in x and in the other. Lists count
        later rows alone."""
        if self.at != x // STRIP:
            self.at = x // STRIP
            part = slice(self.at * STRIP, (self.at + 1) * STRIP)
            self.strip = self.has[part] @ self.has.T
            if self.weighted:
                self.strips = self.heavy[part] @ self.has.T, self.has[part] @ self.heavy.T
        mine = slice(self.start[x], self.start[x + 1])
        where, n = _stretches(self.after[mine], self.end[mine])
        others, k = self.listed[where], x % STRIP
        common = self.strip[k] + np.bincount(others, minlength=self.n)
        if not self.weighted:
            return common, None, None
        return common, self.strips[0][k] + np.bincount(others, np.repeat(self.weight[mine], n), self.n), self.strips[1][k] + np.bincount(others, self.listed_weight[where], self.n)


def _stretches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions from a to b, and how many each gives."""
    n = b - a
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def forest(comps: list[int], sides: list[int], grams: list[tuple[np.ndarray, np.ndarray]], limit: float) -> list[tuple[int, int]]:
    """Pairs of positions with at least the similarity `limit` that join components: a spanning forest of all such pairs.

    sides: 0 and 1 are compared with each other alone; rows of side 2 with one another. Candidates of a row are the later
    rows (by size) that share a shingle of both rows' rare heads, are not too large for it and belong to another
    component; so rows that are alike in frequent shingles alone are never compared. Equal weights give the similarity
    from the counts; else the smaller share of the weights that is common bounds it from above, and what passes is
    computed.
    """
    sizes = np.array([len(g) for g, _ in grams])
    rank = np.argsort(sizes, kind="stable")
    row = np.repeat(np.arange(len(rank)), sizes[rank])
    ids = np.concatenate([grams[i][0] for i in rank])
    weight = np.concatenate([grams[i][1] for i in rank]).astype(np.float64)
    sizes, side = sizes[rank], np.array(sides)[rank]
    plain = np.array([(grams[i][1] == grams[i][1][:1]).all() for i in rank])
    total = np.bincount(row, weight, len(rank))
    counted: _Common | None = None
    picked = np.flatnonzero(_rare_heads(row, ids, weight, total, limit))
    head_order, head_after, head_end = _lists(ids[picked])
    head_listed, head_at = row[picked][head_order], np.searchsorted(row[picked], np.arange(len(rank) + 1))
    _, group = np.unique(np.array(comps)[rank], return_inverse=True)
    links = []
    for x in range(len(rank)):
        h = slice(head_at[x], head_at[x + 1])
        a, b = head_after[h], head_end[h]
        # heads that meet most of the rows tell little: then all later rows are candidates
        near = np.unique(head_listed[_stretches(a, b)[0]]) if (b - a).sum() < 2 * len(rank) else np.arange(x + 1, len(rank))
        near = near[(group[near] != group[x]) & (~(plain[near] & plain[x]) | (sizes[x] >= limit * sizes[near] - 1e-9))]
        if side[x] < 2:
            near = near[side[near] != side[x]]
        if len(near) > TOGETHER:
            counted = counted or _Common(len(rank), row, ids, weight, not plain.all())
            common, mine, theirs = (None if c is None else c[near] for c in counted.of(x))
            maybe = common / (sizes[x] + sizes[near] - common) >= limit - 1e-12
            if mine is not None:
                maybe = np.where(plain[near] & plain[x], maybe, np.minimum(mine / total[x], theirs / total[near]) >= limit - 1e-6)
            near = near[maybe]
        for y in near.tolist():
            if group[x] != group[y] and probability_jaccard(grams[rank[x]], grams[rank[y]]) >= limit - 1e-12:
                group[group == group[y]] = group[x]
                links.append((int(rank[x]), int(rank[y])))
    return links


def _forests(limit: float):
    """Rows (unit: band, i, j, then id, comp, side, grams) sorted by unit: the links of each unit's forest."""

    def links(held: list[tuple]) -> pa.RecordBatch:
        ids = [r[0] for r in held]
        found = forest([r[1] for r in held], [r[2] for r in held], [_unpacked(r[3]) for r in held], limit)
        return pa.RecordBatch.from_arrays([pa.array([min(ids[x], ids[y]) for x, y in found], pa.int64()), pa.array([max(ids[x], ids[y]) for x, y in found], pa.int64())], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            units = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rows = zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True)
            for unit, row in zip(units, rows, strict=True):
                if unit != now and held:
                    yield links(held)
                    held = []
                now = unit
                held.append(row)
        if held:
            yield links(held)

    return run


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of a table of doc_id; the ids are broadcast if they are few."""
    wanted = stored(ids.distinct(), "wanted")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")


def _shingled(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, grams of each document in a table of doc_id, stored."""
    return stored(_texts_of(ids, texts).mapInArrow(_grams, "doc_id long, grams binary").dropDuplicates(["doc_id"]), "grams")


def _hub_links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The stored pairs (a, b) whose documents are similar enough."""
    grams = _shingled(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))), texts)
    one = pairs.join(grams.withColumnsRenamed({"doc_id": "b", "grams": "gb"}), "b")
    two = one.join(grams.withColumnsRenamed({"doc_id": "a", "grams": "ga"}), "a")
    return stored(two.select("a", "b", "ga", "gb").mapInArrow(_verified(similarity), "a long, b long"), "links")


def _unit_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Stored links (a, b) that join the components left in the buckets of members (band, id, s0, comp)."""
    part = F.shiftright("band", 60).alias("part")
    sets = members.groupBy("band", part).agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("id", "s0")).alias("x"), F.bit_xor(F.xxhash64("s0", "id")).alias("y")).filter("lo != hi")
    # buckets of several bands that hold the same documents are one
    chosen = sets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
    rest = stored(members.join(chosen, "band").select("band", "id", "comp"), "rest")
    if rest.isEmpty():
        return rest.select(F.col("id").alias("a"), F.col("id").alias("b"))
    grams = _shingled(rest.select(F.col("id").alias("doc_id")), texts).withColumnRenamed("doc_id", "id")
    sizes = rest.join(grams.select("id", F.length("grams").alias("bytes")), "id").groupBy("band", part).agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    dealt = rest.join(sizes.select("band", "blocks"), "band").withColumn("k", F.pmod(F.xxhash64("id", "band"), F.col("blocks")).cast("int"))
    units = dealt.join(grams, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("k", "other"), F.greatest("k", "other")
    # a row is in the unit of each block with its own; the pairs inside a block are compared in the unit of the block with itself
    side = F.when(i == j, F.lit(2)).otherwise((F.col("k") == j).cast("int"))
    units = units.select("band", i.alias("i"), j.alias("j"), "id", "comp", side.alias("side"), "grams")
    return stored(units.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id").mapInArrow(_forests(similarity), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), kept (it is that one) for every row of docs.

    Documents with the same lower-cased words are one class outright; texts without words (null, empty, white) are one
    class too. A text of fewer than five words has one shingle. Rows that repeat a doc_id get one class: the one of the
    row whose words hash lowest. Rows with a null doc_id get the class of the documents with the same words; where there
    are none, class_id is null and kept is true. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signatures, "doc_id long, fp string, n_words long, bands array<long>, s0 long, s1 long"), "signatures")
    # grouped by more than the join key below, so that both sides of that join are exchanged and a hot print can be split
    heads = stored(signed.groupBy("fp", "n_words").agg(F.min("doc_id").alias("rep")), "heads")
    reps = signed.join(heads.select("fp", F.col("rep").alias("doc_id")), ["fp", "doc_id"], "left_semi").filter("n_words > 0").dropDuplicates(["fp", "doc_id"])
    rows = reps.select(F.col("doc_id").alias("id"), "s0", "s1", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band", F.shiftright("band", 60).alias("part")).agg(F.min("id").alias("hub"), F.max("id").alias("most")).filter("hub != most").select("band", "hub")
    members = stored(rows.join(buckets, "band"), "members")
    hubs = members.filter("id = hub").select("band", F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1")))
    near = members.filter("id != hub").join(hubs, "band").filter(differ <= max_differ(similarity, M))
    links = _hub_links(stored(near.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs"), texts, similarity)
    comps = connected_components(links)
    state = members.join(comps, "id", "left").select("band", "id", "s0", F.coalesce("comp", "id").alias("comp"))
    more = _unit_links(state, texts, similarity)
    if not more.isEmpty():
        comps = connected_components(links.unionByName(more))
    classes = heads.select("fp", F.col("rep").alias("id"))
    classes = classes.join(comps, "id", "left").select("fp", F.coalesce("comp", "id").alias("class_id"))
    return signed.select("doc_id", "fp").join(classes, "fp").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one a class (of its smallest doc_id the longest text), with all their columns; rows with
    a null doc_id all stay. Rows are compared as rows, so different texts under one doc_id are judged one by one."""
    rows = stored(docs.filter(F.col(id_col).isNotNull()).withColumn("_rm_row", F.monotonically_increasing_id()), "rows")
    classes = near_duplicates(rows, similarity, "_rm_row", text_col).select(F.col("doc_id").alias("_rm_row"), "class_id")
    order = rows.select("_rm_row", F.struct(F.col(id_col), -F.coalesce(F.length(text_col), F.lit(-1)), F.xxhash64(text_col), F.col("_rm_row").alias("_rm_kept")).alias("_rm_order"))
    kept = order.join(classes, "_rm_row").groupBy("class_id").agg(F.min("_rm_order").alias("first")).select(F.col("first._rm_kept").alias("_rm_row"))
    return rows.join(kept, "_rm_row", "left_semi").drop("_rm_row").unionByName(docs.filter(F.col(id_col).isNull()))
