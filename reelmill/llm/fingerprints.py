"""Document fingerprints by one-permutation MinHash.

The distinct five-word shingles of a text are hashed once. The low bits of a hash name one of BINS bins and a bin keeps
the smallest rest of its hashes. An empty bin is filled by optimal densification: a sequence of probes that depends on
the bin alone, the same for all texts, borrows from the first bin that is not empty. Of each bin the BITS low-order bits
are stored, packed. Two fingerprints agree in a bin with probability J + (1 - J) / 2^BITS, which `likeness` inverts.

`fingerprints` needs no shuffle. `follow` also compares each text with its successor in the order of doc_id: the texts
are dealt by ranges of doc_id, a task walks its range in order, and only the first and the last text of each range meet
in a second, small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces, mixed, stored, text_of
from reelmill.llm.minhash import WORDS, shingles, words_of

BINS, BITS = 512, 4
#: Probes of a bin that are laid out as a table; a bin that none of them fills takes the next one that is not empty.
PROBES = 4096
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text and rows that are worked on at once.
PIECE_BYTES, PIECE_ROWS = 2 << 20, 2048

_SEED = np.uint64(0xA0761D6478BD642F)
_TABLES: dict[int, np.ndarray] = {}


def probes(bins: int) -> np.ndarray:
    """PROBES x bins: the bins that an empty bin asks, in turn."""
    if bins not in _TABLES:
        with np.errstate(over="ignore"):
            z = mixed(np.arange(1, PROBES + 1, dtype=np.uint64)[:, None] * _SEED + np.arange(bins, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        _TABLES[bins] = (z % np.uint64(bins)).astype(np.int32)
    return _TABLES[bins]


def sketch(rows: np.ndarray, ids: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins: the smallest value of each bin, EMPTY where no shingle fell."""
    out = np.full(n * bins, EMPTY)
    with np.errstate(over="ignore"):
        z = mixed((ids.astype(np.uint64) + np.uint64(1)) * _SEED)
    np.minimum.at(out, rows.astype(np.int64) * bins + (z % np.uint64(bins)).astype(np.int64), z // np.uint64(bins))
    return out.reshape(n, bins)


def densify(found: np.ndarray) -> np.ndarray:
    """Fills the empty bins of every row that has a value at all."""
    n, bins = found.shape
    full = found != EMPTY
    out, table = found.copy(), probes(bins)
    held = full.sum(1)
    one = held == 1
    out[one] = found[one].min(1)[:, None]  # whatever the probes are, they end at the only value
    r, b = np.nonzero(~full & (held > 1)[:, None])
    at, step = 0, 1
    while len(r) and at < PROBES:
        asked = table[at : at + step][:, b]
        hit = full[r, asked]
        done = hit.any(0)
        first = hit.argmax(0)
        out[r[done], b[done]] = found[r[done], asked[first[done], np.flatnonzero(done)]]
        r, b, at, step = r[~done], b[~done], at + step, min(64, step * 2)
    for i, j in zip(r, b, strict=True):
        out[i, j] = found[i, (j + 1 + int(np.roll(full[i], -j - 1).argmax())) % bins]
    return out


def low_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Low-order bits of each value hashed with its bin, so that a value that many bins have borrowed agrees by chance
    with another one in each of them independently."""
    with np.errstate(over="ignore"):
        z = mixed(values + np.arange(values.shape[1], dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
    return (z & np.uint64((1 << bits) - 1)).astype(np.uint8)


def codes(texts: list[str | None], bins: int = BINS, bits: int = BITS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """n x bins low-order bits, and which texts have a word at all."""
    out, any_word = [], []
    for _, counts, hashes in words_of(texts):
        rows, ids, _ = shingles(counts, hashes, words)
        for a in range(0, len(counts), PIECE_ROWS):
            b = min(len(counts), a + PIECE_ROWS)
            lo, hi = np.searchsorted(rows, (a, b))
            out.append(low_bits(densify(sketch(rows[lo:hi] - a, ids[lo:hi], b - a, bins)), bits))
        any_word.append(counts > 0)
    if not out:
        return np.zeros((0, bins), np.uint8), np.zeros(0, bool)
    return np.concatenate(out), np.concatenate(any_word)


def packed(code: np.ndarray, any_word: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The bits of each row, bin after bin; no bytes for a text without a word."""
    each = (code[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    rows = np.packbits(each.reshape(len(code), -1), axis=1) if len(code) else code
    return [r.tobytes() if ok else b"" for r, ok in zip(rows, any_word, strict=True)]


def unpacked(prints: list[bytes], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    any_word = np.array([len(p) > 0 for p in prints], bool)
    raw = np.zeros((len(prints), (bins * bits + 7) // 8), np.uint8)
    for i, p in enumerate(prints):
        if p:
            raw[i] = np.frombuffer(p, np.uint8)
    each = np.unpackbits(raw, axis=1, count=bins * bits).reshape(len(prints), bins, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8), any_word


def likeness(x: np.ndarray, y: np.ndarray, x_any: np.ndarray, y_any: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, corrected for the bins that agree by chance in their low-order bits, from 0 to 1.
    Two texts without a word are alike, one of them is unlike all others."""
    chance = 0.5**bits
    estimate = np.clip(((x == y).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(x_any & y_any, estimate, (x_any == y_any).astype(np.float64))


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _pieces(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_pieces(batches, column, PIECE_BYTES):
        for a in range(0, len(batch), PIECE_ROWS):
            yield batch.slice(a, PIECE_ROWS)


def _fingerprints(bins: int, bits: int, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            prints = packed(*codes(batch.column(1).to_pylist(), bins, bits, words), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["doc_id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (binary of bins * bits / 8 bytes; empty for null texts and texts without a word) a row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_fingerprints(bins, bits, words), "doc_id long, fingerprint binary")


def _likeness(bins: int, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), PIECE_ROWS):
                batch = whole.slice(a, PIECE_ROWS)
                (x, x_any), (y, y_any) = (unpacked([p or b"" for p in batch.column(i).to_pylist()], bins, bits) for i in (batch.num_columns - 2, batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(likeness(x, y, x_any, y_any, bits))], [*batch.schema.names[:-2], "likeness"])

    return run


def compare(pairs: DataFrame, a: str, b: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """pairs with the likeness of the fingerprints in columns a and b in their place (null: no word)."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    schema = pairs.select(*rest).schema.add("likeness", "double")
    return pairs.select(*rest, F.col(a).alias("_rm_a"), F.col(b).alias("_rm_b")).mapInArrow(_likeness(bins, bits), schema)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
FIRST, LAST = 1, 2


def _compared(ids: list, texts: list[str], code: np.ndarray, any_word: np.ndarray, following: list[str], next_code: np.ndarray, next_any: np.ndarray, bins: int, bits: int, words: int) -> list[pa.Array]:
    """The columns RESULT."""
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    e_code, e_any = codes(new, bins, bits, words)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        pa.array(packed(code, any_word, bits), pa.binary()),
        pa.array(packed(e_code, e_any, bits), pa.binary()),
        pa.array(likeness(code, e_code, any_word, e_any, bits)),
        pa.array(likeness(code, next_code, any_word, next_any, bits)),
    ]


def _walk(bins: int, bits: int, words: int):
    """Rows (doc_id, tie, text) of one range in order -> results of all but the last one, and the range's two ends."""

    def end(row: tuple, edge: int) -> pa.RecordBatch:
        nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *nothing, pa.array([edge], pa.int32()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.string())], [*NAMES, "edge", "tie", "text"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in _pieces(batches, 2):
            ids, ties, texts = (batch.column(i).to_pylist() for i in range(3))
            code, any_word = codes(texts, bins, bits, words)
            if last is None:
                yield end((ids[0], ties[0], texts[0]), FIRST)
            else:
                row, row_code, row_any = last
                ids, ties, texts = [row[0], *ids], [row[1], *ties], [row[2], *texts]
                code, any_word = np.concatenate((row_code, code)), np.concatenate((row_any, any_word))
            if len(ids) > 1:
                made = _compared(ids[:-1], texts[:-1], code[:-1], any_word[:-1], texts[1:], code[1:], any_word[1:], bins, bits, words)
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([*made, pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], [*NAMES, "edge", "tie", "text"])
            last = (ids[-1], ties[-1], texts[-1]), code[-1:].copy(), any_word[-1:].copy()
        if last is not None:
            yield end(last[0], LAST)

    return run


def _meet(bins: int, bits: int, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
            own, after = codes(texts, bins, bits, words), codes(following, bins, bits, words)
            yield pa.RecordBatch.from_arrays(_compared(ids, texts, *own, following, *after, bins, bits, words), NAMES)

    return run


def follow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness and the next text's: the columns RESULT.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next row's
    text by rising doc_id; after the last row comes the first. A null text is empty; texts without a word have an empty
    fingerprint, alike to each other (1) and to no other (0). Rows that repeat a doc_id follow each other by a hash of
    their texts, rows with a null doc_id come last; equal rows are each other's successors. A table of one row follows
    itself, an empty one gives no rows. Other columns of docs are not read.
    """
    text = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    walked = texts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk(bins, bits, words), f"{RESULT}, edge int, tie long, text string")
    walked = stored(walked, "fingerprints", compression="zstd")
    ends = walked.filter("edge > 0").select("doc_id", "tie", "edge", "text")
    # two rows a range, without their texts: as many as there are partitions
    turn = ends.select("doc_id", "tie", "edge").withColumn("turn", F.row_number().over(Window.orderBy(*order, "edge")))
    last = F.max("turn").over(Window.partitionBy())
    turn = turn.withColumn("next_turn", F.when(F.col("turn") == last, 1).otherwise(F.col("turn") + 1))
    placed = ends.alias("e").join(turn.alias("t"), F.expr("e.doc_id <=> t.doc_id and e.tie = t.tie and e.edge = t.edge")).select("e.doc_id", "e.edge", "e.text", "t.turn", "t.next_turn")
    firsts = placed.filter(F.col("edge") == FIRST).select(F.col("turn").alias("next_turn"), F.col("text").alias("next_text"))
    met = placed.filter(F.col("edge") == LAST).join(firsts, "next_turn").select("doc_id", "text", "next_text").mapInArrow(_meet(bins, bits, words), RESULT)
    return walked.filter("edge = 0").select(*NAMES).unionByName(met)
