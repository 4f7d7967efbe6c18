"""Language identification by error-correcting output codes.

Every language has a codeword of bits; a binary classifier over hashed byte n-grams predicts each bit, and decoding
takes the language whose codeword has the least weighted loss over the bits' margins. A text whose best two languages
are closer than a margin is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces, flat_bytes, mixed

BUCKETS = 1 << 12
ORDERS = (2, 3, 4)
#: The classifiers are fitted on at most this many distinct labelled texts a language, chosen by a hash; each is read whole.
SAMPLE_ROWS = 300
AMBIGUOUS = 0.15
#: A filtering stage rejects texts whose best language scores less: theirs is none of the known ones, or many at once.
MIN_SCORE = 0.4
STEP = 1 << 18
#: Bytes of text that a task takes from a batch at once.
BATCH_BYTES = 2 << 20
LETTER = regex.compile(r"\p{L}")


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, everything else below 128 as a space; other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for c in range(97, 123):
        table[c] = c
        table[c - 32] = c
    return table[data]


def buckets_of(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte but the last n-1."""
    with np.errstate(over="ignore"):
        key = np.zeros(len(data) - n + 1, np.uint64)
        for i in range(n):
            key = (key << np.uint64(8)) | data[i : len(data) - n + 1 + i]
        return (mixed(key * np.uint64(2 * n + 1)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def codewords(k: int) -> np.ndarray:
    """k distinct codewords of -1/1. Up to six languages have an exhaustive code: all two-way splits. More have
    12 log2(k) balanced splits drawn at random, or all balanced splits where these are fewer. A split and its inverse
    are the same one."""
    if k <= 6:
        bits = [[1 if (m >> i) & 1 else -1 for i in range(k)] for m in range(1, 1 << (k - 1))] if k > 1 else [[1]]
        return np.array(bits, np.float32).T
    half = k // 2
    there = comb(k, half) // (2 if k % 2 == 0 else 1)
    width = min(there, 12 * ceil(log2(k)))
    if there <= 4 * width:
        every = np.full((comb(k, half), k), -1, np.float32)
        for i, ones in enumerate(combinations(range(k), half)):
            every[i, list(ones)] = 1
        every = every[every[:, 0] > 0] if k % 2 == 0 else every
        return every[np.sort(np.random.default_rng(7).permutation(len(every))[:width])].T.copy()
    rng = np.random.default_rng(7)
    while True:
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < width:
            c = rng.permutation(np.where(np.arange(k) < half, 1, -1)).astype(np.float32)
            c = c if k % 2 or c[0] > 0 else -c
            columns[c.tobytes()] = c
        code = np.stack(list(columns.values()), 1)
        # no two languages may be near each other: in a drawn code they differ in about half the bits
        agree = code @ code.T
        if (agree - 2 * width * np.eye(k)).max() < width / 2 + 1:
            return code


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-normalised, square-rooted bucket counts of each text (rows), for fitting."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    for i in range(len(offsets) - 1):
        for n in ORDERS:
            for a in range(offsets[i], offsets[i + 1] - n + 1, STEP):
                part = folded(data[a : min(offsets[i + 1], a + STEP + n - 1)])
                out[i] += np.bincount(buckets_of(part, n), minlength=BUCKETS)
    return out / np.maximum(1, out.sum(1, keepdims=True))


class Model:
    """langs, codewords, the bit classifiers' weights (BUCKETS x bits) and bias, and the weight of each bit's loss."""

    def __init__(self, langs: list[str], code: np.ndarray, weight: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.langs, self.code, self.weight, self.bias, self.trust = langs, code, weight, bias, trust

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bits' margins (texts x bits): the mean weight of all n-grams of each whole text, plus bias."""
        total = np.zeros((len(offsets) - 1, len(self.bias)), np.float64)
        count = np.zeros(len(offsets) - 1)
        for n in ORDERS:
            count += np.maximum(0, np.diff(offsets) - n + 1)
        for a in range(0, len(data), STEP):
            b = min(len(data), a + STEP)
            whole = folded(data[a : b + max(ORDERS) - 1])
            for n in ORDERS:
                part = whole[: b - a + n - 1]
                if len(part) < n:
                    continue
                bucket = buckets_of(part, n)
                at = np.arange(a, a + len(bucket))
                row = np.searchsorted(offsets, at, side="right") - 1
                inside = at + n <= offsets[row + 1]
                row, bucket = row[inside], bucket[inside]
                if not len(row):
                    continue
                heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                total[row[heads]] += np.add.reduceat(self.weight[bucket], heads, axis=0, dtype=np.float64)
        return total / np.maximum(1, count)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score in 0..1 and ambiguity: a logistic loss a bit, weighted by the bit's trust."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        order = np.argsort(loss, 1, kind="stable")
        like = np.exp(-(loss - loss.min(1, keepdims=True)))
        like /= like.sum(1, keepdims=True)
        best = order[:, 0]
        score = np.take_along_axis(like, best[:, None], 1)[:, 0]
        second = np.take_along_axis(like, order[:, 1:2], 1)[:, 0] if like.shape[1] > 1 else np.zeros(len(best))
        return best, score, score - second < AMBIGUOUS


def fit(texts: list[bytes], langs: list[str]) -> Model:
    """A model of labelled texts."""
    return fit_features(features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))), langs)


def fit_features(x: np.ndarray, langs: list[str], steps: int = 200, rate: float = 0.5, l2: float = 1e-6) -> Model:
    """Fits one logistic classifier a bit (full-batch, with momentum; languages have equal weight) on rows of features."""
    names = sorted(set(langs))
    code = codewords(len(names))
    scale = 1 / (x.std(0) + 1e-5)
    mean = x.mean(0)
    x = (x - mean) * scale / np.sqrt(BUCKETS)
    y = np.array([names.index(v) for v in langs])
    each = (1 / np.bincount(y, minlength=len(names)))[y] / len(names)
    target = code[y]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = (-target / (1 + np.exp(target * (x @ w + b))) * each[:, None]).astype(np.float32)
        vw = 0.9 * vw + x.T @ g + l2 * w
        vb = 0.9 * vb + g.sum(0)
        w -= rate * 20 * vw
        b -= rate * vb
    right = ((x @ w + b) * target > 0).astype(np.float32)
    trust = np.maximum(0.05, (right * each[:, None]).sum(0) * 2 - 1)
    weight = w * scale[:, None] / np.sqrt(BUCKETS)
    return Model(names, code, weight.astype(np.float32), (b - mean @ weight).astype(np.float64), trust / trust.sum() * code.shape[1])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, the features of the whole text, compressed) of (lang, h, text)."""
    for batch in byte_pieces(batches, 2, BATCH_BYTES):
        data, offsets = flat_bytes(batch.column(2))
        found = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in features(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "h", "x"])


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from a bounded sample of the labelled texts: of each language, up to sample_rows distinct texts with the
    smallest hashes, whole. What reaches the driver is their features, of a fixed size each. Every labelled language has
    a text in it, whatever the copies in the others. None if no row is labelled."""
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and length(text) > 0")
    share = known.withColumn("h", F.xxhash64("text"))
    todo = {r["lang"]: r["n"] for r in share.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not todo:
        return None
    kept: dict[str, list[bytes]] = {}
    wide = 1.5
    while todo:
        # a hash threshold a language keeps about wide * sample_rows of its distinct texts (all, if it has fewer)
        cut = F.create_map(*[F.lit(x) for lang, n in todo.items() for x in (lang, min(1.0, wide * sample_rows / max(1, n)))])
        picked = share.filter(F.pmod("h", F.lit(1 << 40)) < cut[F.col("lang")] * F.lit(1 << 40)).select("lang", "h", "text").distinct()
        for r in sorted(picked.mapInArrow(_counted, "lang string, h long, x binary").collect()):
            if len(kept.setdefault(r["lang"], [])) < sample_rows:
                kept[r["lang"]].append(bytes(r["x"]))
        todo = {lang: n for lang, n in todo.items() if lang not in kept}
        wide *= 16
    names = sorted(kept)
    x = np.stack([np.frombuffer(pa.decompress(b, 4 * BUCKETS, "zstd", asbytes=True), np.float32) for lang in names for b in kept[lang]])
    return fit_features(x, [lang for lang in names for _ in kept[lang]])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row, from its text alone.

    Null texts and texts without a letter are `und` with score 0. With no model (no labelled rows) every row is `und`.
    Repeated rows are predicted one by one; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_pieces(batches, 1, BATCH_BYTES):
            data, offsets = flat_bytes(batch.column(1))
            letters = np.array([bool(LETTER.search(t.as_py() or "")) for t in batch.column(1)], bool)
            n = len(offsets) - 1
            langs, score, unsure = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if model is not None and n:
                best, score, unsure = model.decode(model.margins(data, offsets))
                langs = np.array(model.langs, object)[best]
                langs[~letters], score[~letters], unsure[~letters] = "und", 0.0, True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, that are in a known language: they have a letter, and the best language
    reaches the score `least`. A text in two known languages stays. Repeated rows and rows with a null id are judged
    like any other."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_pieces(batches, at, BATCH_BYTES):
            data, offsets = flat_bytes(batch.column(at))
            keep = np.array([bool(LETTER.search(t.as_py() or "")) for t in batch.column(at)], bool)
            if len(keep):
                keep &= model.decode(model.margins(data, offsets))[1] >= least
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
