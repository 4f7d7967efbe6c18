"""Exact dedup by Patricia-trie owners.

Every text, with white space removed, is inserted as a full byte string into a compressed radix trie. A trie's terminal
nodes hold the owner (most code points in the original, then smallest doc_id) and the number of documents. The tries are
built twice: in each map task, so that a group of copies, however large, leaves a task as one row; then in the partition
that the byte length and a hash of the content name. A trie over its memory budget hands its largest root subtree on as
finished rows (the spill goes into Spark's shuffle, not to a local disk), and a last aggregation by digest and length
joins what a spill has parted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The white space that equality ignores: [\x20\x09-\x0D].
IGNORED = b" \t\n\x0b\x0c\r"
TRIE_BYTES = 48 << 20
#: Stands for a null doc_id inside the tries, so that it comes last.
NO_ID = (1 << 63) - 1
OUT_BYTES = 8 << 20


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    n = min(len(a), len(b) - at)
    if n <= 16:
        for i in range(n):
            if a[i] != b[at + i]:
                return i
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n, at)
    first = int(differ.argmax())
    return first if differ[first] else n


class PatriciaTrie:
    """Byte strings in a compressed radix trie; a node is [label, children by first byte, owner or None].

    An owner is [-code points, doc_id, documents]; the smaller (first two) stays.
    """

    NODE = 200

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size: dict[int, int] = {}
        self.total = 0

    def insert(self, key: bytes, owner: list) -> None:
        node, at, grown = self.root, 0, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, owner]
                self._grow(key, len(key) - at + self.NODE)
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _common(label, key, at)
            middle = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][label[0]] = middle
            node, at, grown = middle, at + n, grown + self.NODE
        if grown:
            self._grow(key, grown)
        if node[2] is None:
            node[2] = owner
        else:
            n = node[2][2] + owner[2]
            node[2] = [*min(node[2][:2], owner[:2]), n]

    def _grow(self, key: bytes, n: int) -> None:
        self.size[key[0]] = self.size.get(key[0], 0) + n
        self.total += n

    @staticmethod
    def terminals(node: list, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            (label, children, owner), prefix = stack.pop()
            key = prefix + label
            if owner is not None:
                yield key, owner
            stack += [(child, key) for child in children.values()]

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Removes the largest subtree below the root and gives its terminals."""
        first = max(self.size, key=self.size.get)
        self.total -= self.size.pop(first)
        yield from self.terminals(self.root[1].pop(first))

    def drain(self) -> Iterator[tuple[bytes, list]]:
        yield from self.terminals(self.root)
        self.__init__()


def _owners(rows: Iterable[tuple[bytes, list]], budget: int) -> Iterator[tuple[bytes, list]]:
    trie = PatriciaTrie()
    for key, owner in rows:
        trie.insert(key, owner)
        while trie.total > budget and trie.size:
            yield from trie.spill()
    yield from trie.drain()


def _batches(found: Iterable[tuple[bytes, list]], last: bool) -> Iterator[pa.RecordBatch]:
    keys, owners, size = [], [], 0

    def made() -> pa.RecordBatch:
        cps, ids, n = zip(*owners, strict=True)
        who = [pa.array([-x for x in cps], pa.int64()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())]
        if last:
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(k).hexdigest() for k in keys]), pa.array([len(k) for k in keys], pa.int64()), *who], ["sha", "n_bytes", "cps", "owner", "n"])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *who], ["norm", "cps", "owner", "n"])

    for key, owner in found:
        keys.append(key)
        owners.append(owner)
        size += len(key) + 64
        if size > OUT_BYTES:
            yield made()
            keys, owners, size = [], [], 0
    if keys:
        yield made()


def _map_tries(budget: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, list]]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for i, (doc, text) in enumerate(zip(ids, batch.column(1), strict=True)):
                    text = text.as_py() or ""
                    yield text.encode().translate(None, IGNORED), [-len(text), doc, 1]

        yield from _batches(_owners(rows(), budget), last=False)

    return run


def _reduce_tries(budget: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, list]]:
            for batch in batches:
                cps, ids, n = (batch.column(i).to_pylist() for i in (1, 2, 3))
                for i, key in enumerate(batch.column(0)):
                    yield key.as_py(), [-cps[i], ids[i], n[i]]

        yield from _batches(_owners(rows(), budget), last=True)

    return run


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256((t.as_py() or "").encode().translate(None, IGNORED)).hexdigest() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string())], ["doc_id", "sha"])


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct text: sha, n_bytes, owner (the doc_id that stays; NO_ID for a null one), group_size."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    first = texts.mapInArrow(_map_tries(trie_bytes), "norm binary, cps long, owner long, n long")
    dealt = first.repartition(F.length("norm"), F.xxhash64("norm"))
    found = dealt.mapInArrow(_reduce_tries(trie_bytes), "sha string, n_bytes long, cps long, owner long, n long")
    return found.groupBy("sha", "n_bytes").agg(F.min(F.struct((-F.col("cps")).alias("c"), F.col("owner").alias("owner")))["owner"].alias("owner"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Null text counts as empty; empty and all-white texts are one group. Rows that repeat a doc_id get the same keep_id
    (and the same kept). A null doc_id is the largest one: such rows are members like any other, and a group that one of
    them owns (by its code points, or as there is no other row) has a null keep_id, kept for its rows with a null doc_id.
    An empty table gives no rows. Other columns of docs are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = texts.mapInArrow(_digests, "doc_id long, sha string")
    # the join key is narrower than the owners' grouping, so both sides are exchanged and Spark can split a hot digest
    keep = F.nullif("owner", F.lit(NO_ID))
    return members.join(owners(docs, id_col, text_col, trie_bytes), "sha").select("doc_id", keep.alias("keep_id"), "group_size", keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row of docs for each distinct text, with all its columns: a row of the owner's doc_id with that text, the
    longest one if several have it. Rows with a null doc_id are all kept."""
    kept = owners(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, trie_bytes).select(F.col("owner").alias("_rm_owner"), F.col("sha").alias("_rm_kept"))
    named = docs.withColumn("_rm_sha", F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), IGNORED.decode(), "").cast("binary"), 256))
    mine = named.join(kept, (F.col(id_col) == F.col("_rm_owner")) & (F.col("_rm_sha") == F.col("_rm_kept")), "left_semi")
    one = Window.partitionBy(id_col, "_rm_sha").orderBy(F.length(text_col).desc_nulls_last(), F.xxhash64(text_col))
    whole = mine.withColumn("_rm_row", F.row_number().over(one)).filter("_rm_row = 1").drop("_rm_row", "_rm_sha")
    return whole.unionByName(docs.filter(F.col(id_col).isNull()))
