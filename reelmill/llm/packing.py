"""Vector best-fit packing of documents into fixed-length training sequences.

Documents are tokenised where they lie; only lengths and checksums travel. Documents longer than a sequence are cut so
that all but the first piece are full; the rest of the work is a vector bin packing in which a bin has three residual
capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces are placed in falling length; of
the bins that can take a piece under every constraint, the best by weighted dot-product (or by least residual norm) gets
it. Packing runs in groups of about GROUP pieces, dealt by hash or of consecutive rows (so that a sequence holds what
lay together in a mixture), so no task holds more than a bounded number.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces, stored

CAPACITY = 1024
EOS = 2
GROUP = 40_000
#: Bytes of text that a task takes from a batch at once.
BATCH_BYTES = 4 << 20
WEIGHTS = (1.0, 0.05, 0.2)
#: The added tokens of byte_bpe_50k.json; the rank file has none.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    """A byte-level BPE encoder with the ranks of ranks_path; each string of SPECIAL in a text is one token."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("documents", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full ones, and a first one of what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and place, which numbers the rows of docs in their order; a
    null text is empty and has the end token alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode_to_numpy
        for batch in byte_pieces(batches, 1, BATCH_BYTES):
            out: list[tuple] = []
            for doc, text, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                ids = np.append(encode(text, allowed_special="all").astype("<u4"), np.uint32(eos)).astype("<u4")
                out += [(doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes()), place) for k, (a, n) in enumerate(pieces_of(len(ids), capacity))]
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, place long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "dot", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, by vector best-fit over falling lengths.

    max_docs (default: capacity) and max_cost (default: capacity squared) bound the documents and the sum of squared
    lengths of a bin; a piece that alone exceeds max_cost has a bin of its own. Open bins with equal residuals are one
    class, so a step looks at the distinct residual vectors only. rule "dot" takes the bin whose normalised residual has
    the least weighted dot-product with the piece (the tightest fit), "norm" the one with the least weighted norm of
    what is left over; ties go to the smallest residual, then to the bin opened last.
    """
    docs = capacity if max_docs is None else max_docs
    cost = capacity * capacity if max_cost is None else max_cost
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    classes: dict[tuple[int, int, int], list[int]] = {}
    # residual vectors by residual tokens, tightest first
    by_tokens: dict[int, set] = defaultdict(set)
    tokens_left: list[int] = []
    opened = 0
    wt, wd, wc = weights[0] / capacity, weights[1] / docs, weights[2] / cost

    def score(left: tuple[int, int, int], n: int) -> float:
        if rule == "dot":
            return left[0] * wt * n / capacity + left[1] * wd / docs + left[2] * wc * n * n / cost
        a, b, c = (left[0] - n) * wt, (left[1] - 1) * wd, (left[2] - n * n) * wc
        return a * a + b * b + c * c

    def forget(left: tuple[int, int, int]) -> None:
        del classes[left]
        by_tokens[left[0]].discard(left)
        if not by_tokens[left[0]]:
            del by_tokens[left[0]]
            tokens_left.pop(bisect.bisect_left(tokens_left, left[0]))

    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        best, best_score = None, 0.0
        bound = 0
        for t in tokens_left[bisect.bisect_left(tokens_left, n) :]:
            # no vector with more tokens left can beat the best one once the token term alone exceeds its score
            bound = t * wt * n / capacity if rule == "dot" else ((t - n) * wt) ** 2
            if best is not None and bound > best_score:
                break
            for left in by_tokens[t]:
                if left[1] >= 1 and left[2] >= n * n and (best is None or (score(left, n), left) < (best_score, best)):
                    best, best_score = left, score(left, n)
        if best is None:
            k, left = opened, (capacity, docs, max(cost, n * n))
            opened += 1
        else:
            left = best
            k = classes[left].pop()
            if not classes[left]:
                forget(left)
        bins[i], offsets[i] = k, capacity - left[0]
        rest = (left[0] - n, left[1] - 1, left[2] - n * n)
        if rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
            if rest not in classes:
                classes[rest] = []
                if rest[0] not in by_tokens:
                    bisect.insort(tokens_left, rest[0])
                by_tokens[rest[0]].add(rest)
            classes[rest].append(k)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "dot", weights: tuple[float, float, float] = WEIGHTS, group: int = GROUP, in_order: bool = False) -> DataFrame:
    """sequence_id and offset for stored pieces, whose columns besides place are kept.

    A full piece is a sequence of its own where it lies. The others are dealt by hash into groups of about `group`
    pieces, or with in_order into groups of at most `group` consecutive rows of a partition (a row has one piece that is
    not full); each is packed on its own, which costs at most about one part-filled sequence a group. Sequence ids of
    full pieces are negative. An empty table gives no rows.
    """
    docs = capacity if max_docs is None else max_docs
    short = pieces.filter(F.col("length") < capacity)
    if in_order:
        # the first place of the group; its bins are no more than its rows, so first place + bin tells all sequences apart
        key, step = F.col("place") - F.col("place").bitwiseAND((1 << 33) - 1) % group, 1
    else:
        groups = max(1, round(short.count() / group))
        key, step = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)).cast("long"), 1 << 40
    keyed = short.withColumn("_rm_group", key)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity, docs, max_cost, rule, weights)
        return frame.assign(sequence_id=frame["_rm_group"] * step + bins, offset=offsets).drop(columns=["_rm_group", "place"], errors="ignore")

    kept = [f for f in pieces.schema if f.name != "place"]
    packed = keyed.groupBy("_rm_group").applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long")).drop("place")
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, eos: int = EOS, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Null and empty texts have the end token alone; rows that repeat a doc_id are packed one by one; a null doc_id is
    packed like any other. Only texts longer than a sequence are cut.
    """
    return pack(stored(token_pieces(docs, ranks_path, pattern, capacity, eos, id_col, text_col), "pieces"), capacity, **limits)
