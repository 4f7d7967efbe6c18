"""Fill-in-the-middle transformation.

The units of a text (its lines, or what a pattern says) are appended to an indexable skip list. Each link of a lane
carries how many units and how many code points it passes over, so that the code point before which a rank cuts is found
by a descent through the lanes. Both cuts come from a hash of the document's id, so a run repeats exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces, text_of

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
PIECE_BYTES = 4 << 20
MAX_LANES = 24


def height(node: int) -> int:
    """Lanes of a node: each further one with probability 1/4, by a fixed hash of its number."""
    x = node * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    lanes = 1
    while not x & 3 and lanes < MAX_LANES:
        x >>= 2
        lanes += 1
    return lanes


class SkipList:
    """Units in order. Node r stands after r units, node 0 is the head of every lane. units[l][k] and chars[l][k] are the
    widths of the link that leaves the k-th node of lane l, down[l][k] is that node's place in the lane below."""

    def __init__(self, widths: Iterable[int] = ()) -> None:
        self.n = self.n_chars = 0
        self.units: list[list[int]] = []
        self.chars: list[list[int]] = []
        self.down: list[list[int]] = []
        self.tail: list[tuple[int, int]] = []
        for w in widths:
            self.append(w)

    def append(self, width: int) -> None:
        self.n += 1
        self.n_chars += width
        for lane in range(height(self.n)):
            if lane == len(self.units):
                self.units.append([])
                self.chars.append([])
                self.down.append([0])
                self.tail.append((0, 0))
            at, at_chars = self.tail[lane]
            self.units[lane].append(self.n - at)
            self.chars[lane].append(self.n_chars - at_chars)
            self.down[lane].append(len(self.units[lane - 1]) if lane else 0)
            self.tail[lane] = self.n, self.n_chars

    def seek(self, rank: int) -> int:
        """Code points before the cut after `rank` units (0 to n)."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        passed = chars = k = 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, widths = self.units[lane], self.chars[lane]
            while k < len(units) and passed + units[k] <= rank:
                passed += units[k]
                chars += widths[k]
                k += 1
            k = self.down[lane][k]
        return chars


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of sha256(seed:doc_id); a null doc_id is written null."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """A cut text can be read back if no sentinel holds another or ends as it begins."""
    for i, s in enumerate(sentinels):
        if not s or any(s[:k] == s[-k:] for k in range(1, len(s))) or any(s in t for j, t in enumerate(sentinels) if i != j):
            raise ValueError(f"sentinels {sentinels} cannot be told apart from text around them")
    if any(a[-k:] == b[:k] for a in sentinels for b in sentinels if a != b for k in range(1, min(len(a), len(b)))):
        raise ValueError(f"sentinels {sentinels} overlap")


def transformed(text: str, widths: list[int], h: list[int], fim: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[str, int | None, int | None, str]:
    """form, prefix and middle code points, output."""
    p, s, m = sentinels
    if not text or any(x in text for x in sentinels) or h[2] % 100 >= fim:
        return "plain", None, None, text
    units = SkipList(widths)
    a, b = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
    i, j = units.seek(a), units.seek(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h[3] % 100 < spm:
        return "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _transform(pattern: str, fim: int, spm: int, seed: int, sentinels: tuple[str, str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(pattern)
        for batch in byte_pieces(batches, 1, PIECE_BYTES):
            counts, made = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if pattern == LINES:
                    widths = list(map(len, unit.findall(text)))
                else:
                    # a unit lasts from its match to the next one; what stands before the first belongs to it
                    starts = [0, *[x.start() for x in unit.finditer(text) if x.end() > x.start()][1:], len(text)] if text else [0]
                    widths = [b - a for a, b in pairwise(starts)]
                counts.append(len(widths))
                made.append(transformed(text, widths, draws(doc, seed), fim, spm, sentinels))
            form, prefix, middle, output = zip(*made, strict=True)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LINES, fim: int = 100, spm: int = 50, seed: int = 0, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of docs.

    fim is the share of texts, in per cent, that are cut, spm the share of these with the suffix first. Empty and null
    texts (n = 0, output empty) and texts that hold a sentinel stay plain. Cuts fall on any of the n + 1 ranks, so parts
    may be empty. Rows that repeat a doc_id get the same draws; a null doc_id has draws of its own. No shuffle; a text
    is worked on whole, whatever its length. An empty table gives no rows; other columns of docs are not read.
    """
    check_sentinels(sentinels)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(_transform(pattern, fim, spm, seed, tuple(sentinels)), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str | Column = "output", form: str | Column = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of fill_in_middle was made from, as a column."""
    out, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = sentinels

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.char_length(text))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = after(out, second)
        return after(F.substring_index(out, second, 1), first), F.substring_index(rest, m, 1), after(rest, m)

    (prefix, suffix, middle), (suffix2, prefix2, middle2) = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(out)
