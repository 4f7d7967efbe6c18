"""Suffix-array dedup across documents: longest-previous-factor matches of at least `length` bytes.

A byte of a document goes if a `length`-byte string over it also starts in a document with a smaller doc_id. Suffixes
are dealt to tasks so that equal strings meet:

1. Every window of `length` bytes belongs to the smallest hash of the K-byte grams in it (its minimiser). Neighbouring
   windows mostly share theirs, so a document becomes runs of windows: (minimiser, start, windows).
2. The minimisers meet in buckets; those that occur once in the corpus are done with. What goes back to the documents
   is the minimisers that occur twice or more. A minimiser that repeats inside a map batch is known to be shared there
   and leaves the batch once, so a passage that a third of all rows hold costs one entry a batch.
3. The texts of the shared runs meet in buckets. Equal runs leave a batch once, with their smallest document. In a
   bucket equal runs are one position, with the smallest document as its place in the text order; the windows of the
   distinct runs are put in suffix order, with the longest common prefixes of neighbours. The previous and the next
   smaller position in suffix order give the longest previous factor of each; where it reaches `length`, the window
   starts in an earlier document.
4. The matched ranges of a document are united and cut out.

Documents are dealt by a hash into groups of about GROUP_BYTES, minimisers into as many buckets. A bucket answers a group
in one row, however many documents of it it names, and the group meets its texts in one cogroup.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import byte_pieces, flat_bytes, mixed

LENGTH = 50
GRAM = 16
STEP = 1 << 20
KNOWN = -1
#: Bytes of text that a task works on at once.
BATCH_BYTES = 8 << 20
#: Bytes of text in a group of documents; there are as many buckets of minimisers as groups.
GROUP_BYTES = 8 << 20
#: More partitions than this are not made; a partition then has several groups or buckets, one after the other.
PARTITIONS = 20_000
#: Windows that are sorted at once, unless more start with the same eight bytes.
WINDOWS = 200_000
#: Bytes of results that a task gathers before it sends them on.
DONE_BYTES = 32 << 20
#: Bytes of a minimiser that travel (its upper ones); the bucket adds to them. A clash only costs work.
KEY_BYTES = 6
#: A row for a bucket has no group; one with a group is finished, and passes its bucket by.
BLOBS = "bucket long, grp long, n long, blob binary"
BLOB_TYPES, BLOB_NAMES = [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["bucket", "grp", "n", "blob"]
FOUND = "grp long, blob binary"


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the k bytes at each position (k a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h, base, n = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
        while n < k:
            h = h[:-n] * base + h[n:]
            base = base * base
            n *= 2
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: row, start in the row, windows, minimiser. Long data goes in steps."""
    rows, starts, counts, keys = [], [], [], []
    ends = offsets[1:]
    for a in range(0, max(0, len(data) - length + 1), STEP):
        part = data[a : min(len(data), a + STEP + length - 1)]
        least = sliding_min(gram_hashes(part), length - GRAM + 1)
        at = np.arange(a, a + len(least))
        # windows that leave their document are none
        edge = ends[(ends > a) & (ends < a + len(part))]
        inside = np.zeros(len(least) + 1, np.int32)
        np.add.at(inside, np.clip(edge - length + 1 - a, 0, len(least)), 1)
        np.add.at(inside, np.clip(edge - a, 0, len(least)), -1)
        valid = np.cumsum(inside[:-1]) == 0
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        first = np.flatnonzero(head)
        if not len(first):
            continue
        last = np.flatnonzero(valid & ~np.append(valid[1:], False)) + 1  # ends of the stretches of windows
        stop = np.minimum(np.append(first[1:], len(least)), last[np.searchsorted(last, first, side="right")])
        row = np.searchsorted(ends, at[first], side="right")
        rows.append(row)
        starts.append(at[first] - offsets[row])
        counts.append(stop - first)
        keys.append(least[first])
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in (rows, starts, counts, keys))


def upper(key: np.ndarray) -> np.ndarray:
    """Keys without the bytes that do not travel."""
    return key & ~np.uint64((1 << 8 * (8 - KEY_BYTES)) - 1)


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def _group_of(doc: int, groups: int) -> int:
    """As `_group` in SQL."""
    return zlib.crc32(str(doc).encode()) % groups


def _group(doc_id: str, groups: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % groups


def _by_group(docs: np.ndarray, values: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, packed documents with their values), values as rows."""
    names, of = np.unique(docs, return_inverse=True)
    group = np.array([_group_of(int(d), groups) for d in names], np.int64)
    order = np.lexsort((of, group[of]))
    of, values = of[order], values[order]
    at = _groups(group[of])
    for a, b in zip(at[:-1], at[1:], strict=True):
        which, times = np.unique(of[a:b], return_counts=True)
        yield int(group[of[a]]), b"".join((np.array([len(which)]).tobytes(), names[which].tobytes(), times.astype(np.uint32).tobytes(), values[a:b].tobytes()))


def _named(blobs: Iterable[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents and values (rows of `width` 64-bit numbers) of all blobs of a group."""
    docs, values = [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)]
    for blob in blobs:
        m = int(np.frombuffer(blob, np.int64, 1)[0])
        docs.append(np.repeat(np.frombuffer(blob, np.int64, m, 8), np.frombuffer(blob, np.uint32, m, 8 + 8 * m)))
        values.append(np.frombuffer(blob[8 + 12 * m :], np.int64).reshape(-1, width))
    return np.concatenate(docs), np.concatenate(values)


def _squeezed(*parts: np.ndarray | bytes) -> bytes:
    raw = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _asks(buckets: int, length: int):
    """Map side of step 2. A row without a group asks (n keys, then their documents); a row with one is finished: its
    documents' keys that are known to be shared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_pieces(batches, 1, BATCH_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = flat_bytes(batch.column(1))
            row, _, _, key = window_runs(data, offsets, length)
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            key, row = key[once], row[once]
            at = _groups(key)
            size = np.repeat(np.diff(at), np.diff(at))
            out: list[tuple] = [(g, g, 0, b) for g, b in _by_group(ids[row[size > 1]], upper(key[size > 1]), buckets)]
            head = np.zeros(len(key), bool)
            head[at[:-1]] = True
            doc = np.where(size > 1, KNOWN, row)[head]
            key = key[head]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            bucket, doc, key = bucket[order], doc[order], key[order]
            small = key.view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :]
            at = _groups(bucket)
            for a, b in zip(at[:-1], at[1:], strict=True):
                by = _groups(doc[a:b])
                present = doc[a:b][by[:-1]]
                named = np.where(present == KNOWN, 0, ids[np.maximum(present, 0)])
                out.append((int(bucket[a]), None, int(b - a), b"".join((small[a:b].tobytes(), np.diff(by).astype(np.uint32).tobytes(), (present == KNOWN).tobytes(), named.astype(np.int64).tobytes()))))
            if out:
                yield _batch(out, BLOB_TYPES, BLOB_NAMES)

    return run


def _by_bucket(batches: Iterable[pa.RecordBatch], reduce, groups: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: each bucket's (n, blob) go through reduce, which gives documents and their values. They
    leave as a row a group for all buckets of the task (up to DONE_BYTES at a time); finished rows pass as they are."""
    held: list[tuple[int, bytes]] = []
    done: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def sent() -> pa.RecordBatch:
        docs, values = (np.concatenate(x) for x in zip(*done, strict=True))
        done.clear()
        found = list(_by_group(docs, values, groups))
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["grp", "blob"])

    def met() -> Iterator[pa.RecordBatch]:
        if held:
            done.append(reduce(held))
            held.clear()
            if sum(d.nbytes + v.nbytes for d, v in done) > DONE_BYTES:
                yield sent()

    for batch in batches:
        over = batch.filter(pc.is_valid(batch.column(1)))
        if len(over):
            yield over.select(["grp", "blob"])
        for bucket, group, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if group is not None:
                continue
            if bucket != now:
                yield from met()
            now = bucket
            held.append((n, blob))
    yield from met()
    if done:
        yield sent()


def _answers(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Reduce side of step 2: documents and their minimisers that occur elsewhere too."""
    keys, docs, known = [], [], []
    for n, blob in held:
        rest = blob[KEY_BYTES * n :]
        m = len(rest) // 13
        key = np.zeros((n, 8), np.uint8)
        key[:, 8 - KEY_BYTES :] = np.frombuffer(blob, np.uint8, KEY_BYTES * n).reshape(n, KEY_BYTES)
        keys.append(key.view(np.uint64)[:, 0])
        times = np.frombuffer(rest, np.uint32, m)
        known.append(np.repeat(np.frombuffer(rest, np.uint8, m, 4 * m), times))
        docs.append(np.repeat(np.frombuffer(rest[5 * m :], np.int64, m), times))
    key, doc, told = np.concatenate(keys), np.concatenate(docs), np.concatenate(known)
    order = np.argsort(key, kind="stable")
    key, doc, told = key[order], doc[order], told[order]
    at = _groups(key)
    size = np.repeat(np.diff(at), np.diff(at))
    ask = (size > 1) & (told == 0)
    return doc[ask], key[ask]


def _shared_runs(buckets: int, length: int):
    """Map side of step 3, for a group's texts (grp, doc_id, text) and what it was told (grp, blob). A row without a group holds
    n distinct runs with their smallest document; a row with one is finished: ranges of documents that are not the
    smallest of an equal run."""

    def piece(ids: np.ndarray, text: pa.Array, wanted: np.ndarray) -> list[tuple]:
        data, offsets = flat_bytes(text)
        row, start, count, key = window_runs(data, offsets, length)
        # a minimiser that one document shares is shared by all that have it
        pick = np.flatnonzero(np.isin(upper(key), wanted))
        pick = pick[np.argsort(ids[row[pick]], kind="stable")]
        raw, begin = data.tobytes(), (offsets[row] + start)[pick].tolist()
        first: dict[bytes, int] = {}
        send, texts, gone = [], [], []
        for j, d, a, n in zip(pick.tolist(), ids[row[pick]].tolist(), begin, (count[pick] + length - 1).tolist(), strict=True):
            run = raw[a : a + n]
            if first.setdefault(run, d) == d:
                send.append(j)
                texts.append(run)
            else:
                gone.append(j)
        gone = np.array(gone, np.int64)
        out: list[tuple] = [(g, g, 0, b) for g, b in _by_group(ids[row[gone]], np.stack([start[gone], start[gone] + count[gone] + length - 1], 1), buckets)]
        send = np.array(send, np.int64)
        bucket = (key[send] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = _groups(bucket[order])
        for a, b in zip(at[:-1], at[1:], strict=True):
            js = send[order[a:b]]
            run = b"".join([texts[i] for i in order[a:b].tolist()])
            # in rising order of the documents; half a minimiser is enough to tell runs apart
            docs, times = np.unique(ids[row[js]], return_counts=True)
            out.append((int(bucket[order[a]]), None, len(js), _squeezed(np.array([len(docs)]), docs, times.astype(np.uint32), start[js].astype(np.int64), count[js].astype(np.uint32), (key[js] >> np.uint64(32)).astype(np.uint32), run)))
        return out

    def run(_: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        wanted = np.unique(_named(told.column("blob").to_pylist(), 1)[1].view(np.uint64))
        out: list[tuple] = []
        if len(wanted):
            for batch in byte_pieces(texts.select(["doc_id", "text"]).to_batches(), 1, BATCH_BYTES):
                out += piece(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), wanted)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, BLOB_TYPES, strict=True)], BLOB_NAMES)

    return run


def suffix_words(text: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """The `length` bytes at each start as big-endian 8-byte words (zero-padded), first word first."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length)[starts]
    full = np.zeros((len(starts), -(-length // 8) * 8), np.uint8)
    full[:, :length] = windows
    words = full.view(">u8").astype(np.uint64)
    return [words[:, i] for i in range(words.shape[1])]


def common_prefixes(words: list[np.ndarray], length: int) -> np.ndarray:
    """LCP array of suffixes in suffix order: the bytes that each shares with the one before it, at most `length`."""
    n = len(words[0])
    lcp = np.full(n, length, np.int64)
    undecided = np.arange(1, n)
    for k, w in enumerate(words):
        x = w[undecided] ^ w[undecided - 1]
        differ = x != 0
        lcp[undecided[differ]] = np.minimum(length, 8 * k + 7 - _high_byte(x[differ]))
        undecided = undecided[~differ]
    lcp[:1] = 0
    return lcp


def _high_byte(x: np.ndarray) -> np.ndarray:
    """Number (0 to 7) of the highest byte of each that is not 0."""
    high = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        up = (x >> np.uint64(shift)) != 0
        high += np.where(up, shift // 8, 0)
        x = np.where(up, x >> np.uint64(shift), x)
    return high


def nearest_smaller(place: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, in suffix order: the common prefix with the nearest suffix before it whose place is smaller (the
    previous smaller value), 0 if it is below `least` or there is none. Pointers jump over what is not smaller."""
    n = len(place)
    at, reach = np.arange(-1, n - 1), lcp.copy()
    active = np.flatnonzero((at >= 0) & (reach >= least))
    while len(active := active[place[at[active]] >= place[active]]):
        over = at[active]
        at[active], reach[active] = at[over], np.minimum(reach[active], reach[over])
        active = active[(at[active] >= 0) & (reach[active] >= least)]
    return np.where((at >= 0) & (reach >= least), reach, 0)


def previous_factors(words: list[np.ndarray], place: np.ndarray, length: int, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix: the longest prefix, up to `length` bytes, that also starts at a smaller
    place; 0 where it is below `least`. words: the suffixes' first bytes, as of suffix_words."""
    order = np.lexsort((place, *reversed(words)))
    lcp = common_prefixes([w[order] for w in words], length)
    before = nearest_smaller(place[order], lcp, least)
    back = np.concatenate((lcp[1:], [0]))[::-1]
    after = nearest_smaller(place[order][::-1], back, least)[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _several(texts_of: dict[int, set], length: int) -> Iterator[list[bytes]]:
    """The runs of minimisers that have several (only there can a window lie in two runs), about WINDOWS windows at a time."""
    held, windows = [], 0
    for texts in texts_of.values():
        if len(texts) > 1:
            held += texts
            windows += sum(len(t) - length + 1 for t in texts)
            if windows > WINDOWS:
                yield held
                held, windows = [], 0
    if held:
        yield held


def _repeated(flat: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes at each start also lie at a start with a smaller place. Many starts are sorted in
    stretches of the suffix order, cut where the first eight bytes change."""
    covered = np.zeros(len(starts), bool)
    stretches = [np.arange(len(starts))]
    if len(starts) > WINDOWS:
        first = suffix_words(flat, starts, 8)[0]
        order = np.argsort(first, kind="stable")
        heads = _groups(first[order])
        cuts = np.unique(heads[np.minimum(np.searchsorted(heads, np.arange(0, len(starts) + WINDOWS, WINDOWS)), len(heads) - 1)])
        stretches = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for some in stretches:
        covered[some] = previous_factors(suffix_words(flat, starts[some], length), place[some], length, length) >= length
    return covered


def _matches(length: int):
    """Reduce side of step 3: documents and ranges whose windows start in an earlier document."""

    def reduce(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        found: dict[bytes, list] = {}
        texts_of: dict[int, set] = defaultdict(set)
        for n, blob in held:
            blob = _unsqueezed(blob)
            m = int(np.frombuffer(blob, np.int64, 1)[0])
            doc = np.repeat(np.frombuffer(blob, np.int64, m, 8), np.frombuffer(blob, np.uint32, m, 8 + 8 * m)).tolist()
            at = 8 + 12 * m
            start, count, key = np.frombuffer(blob, np.int64, n, at).tolist(), np.frombuffer(blob, np.uint32, n, at + 8 * n).tolist(), np.frombuffer(blob, np.uint32, n, at + 12 * n).tolist()
            at += 16 * n
            for d, s, c, k in zip(doc, start, count, key, strict=True):
                text = blob[at : at + c + length - 1]
                at += c + length - 1
                found.setdefault(text, []).append((d, s))
                texts_of[k].add(text)
        docs, ranges = [], []
        for text, where in found.items():
            owner = min(where)[0]
            for d, s in where:
                if d > owner:
                    docs.append(d)
                    ranges.append((s, s + len(text)))
        for inner in _several(texts_of, length):
            flat = np.frombuffer(b"".join(inner), np.uint8)
            sizes = np.array([len(t) for t in inner])
            begin = np.cumsum(sizes) - sizes
            windows = sizes - length + 1
            which = np.repeat(np.arange(len(inner)), windows)
            shift = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
            owner = np.array([min(found[t])[0] for t in inner], np.int64)
            at = np.flatnonzero(_repeated(flat, begin[which] + shift, owner[which], length))
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 1) | (which[at[1:]] != which[at[:-1]])
            first = at[new]
            last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else first
            for w, a, b in zip(which[first].tolist(), shift[first].tolist(), shift[last].tolist(), strict=True):
                for d, s in found[inner[w]]:
                    if d == owner[w]:
                        docs.append(d)
                        ranges.append((s + a, s + b + length))
        return np.array(docs, np.int64), np.array(ranges, np.int64).reshape(-1, 2)

    return reduce


def united(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of half-open ranges (n x 2)."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    head = np.concatenate(([True], ranges[1:, 0] > reach[:-1]))
    last = np.append(np.flatnonzero(head)[1:] - 1, len(ranges) - 1)
    return np.stack([ranges[head, 0], reach[last]], 1)


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), SPAN]
CUT_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]


def _cut_out(doc: int | None, text: str | None, ranges: np.ndarray) -> tuple:
    data = (text or "").encode()
    spans = np.minimum(united(ranges), len(data))
    spans = spans[spans[:, 0] < spans[:, 1]].tolist()
    cut, at = [], 0
    for a, b in spans:
        cut.append(data[at:a])
        at = b
    kept = b"".join([*cut, data[at:]])
    return doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in spans]


def _cut(_: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
    """A group's texts (grp, doc_id, text) without the ranges that it was told (grp, blob)."""
    docs, ranges = _named(told.column("blob").to_pylist(), 2)
    order = np.argsort(docs, kind="stable")
    docs, ranges = docs[order], ranges[order]
    out = []
    for doc, text in zip(texts.column("doc_id").to_pylist(), texts.column("text"), strict=True):
        out.append(_cut_out(doc, text.as_py(), ranges[np.searchsorted(docs, doc) : np.searchsorted(docs, doc, side="right")]))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, CUT_TYPES, strict=True)], CUT_NAMES)


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that no match touches."""
    for batch in batches:
        if len(batch):
            yield _batch([_cut_out(None, t.as_py(), np.zeros((0, 2), np.int64)) for t in batch.column(0)], CUT_TYPES, CUT_NAMES)


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans (start, stop) for every row of docs.

    length is at least GRAM. Null texts are empty; texts shorter than length lose nothing. A document never matches
    itself, nor rows that repeat its doc_id; rows that repeat a doc_id with another text get the ranges of all of them,
    cut to their own length. Rows with a null doc_id neither match nor are matched. An empty table gives no rows.
    Cutting bytes can part a character, hence kept is binary.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    texts = docs.select(id_col, text_col)
    if dict(texts.dtypes) != {"doc_id": "bigint", "text": "string"}:
        texts = texts.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.filter("doc_id is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, -(-size // GROUP_BYTES))
    parts = max(least, min(groups, PARTITIONS))

    def part(name: str):
        return (F.col(name) % parts).cast("int")

    def met(made: DataFrame, reduce) -> DataFrame:
        """What the buckets give, a row a task and group, dealt to the groups' partitions."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _by_bucket(batches, reduce, groups)

        found = made.repartitionById(parts, part("bucket")).sortWithinPartitions("bucket").mapInArrow(run, FOUND)
        return found.withColumn("part", part("grp")).repartitionById(parts, F.col("part")).groupBy("part", "grp")

    grouped = rows.withColumn("grp", _group("doc_id", groups)).withColumn("part", part("grp"))
    # both cogroups read the same exchange of the rows by group
    dealt = grouped.repartitionById(parts, F.col("part")).groupBy("part", "grp")
    runs = dealt.cogroup(met(rows.mapInArrow(_asks(groups, length), BLOBS), _answers)).applyInArrow(_shared_runs(groups, length), BLOBS)
    cut = dealt.cogroup(met(runs, _matches(length))).applyInArrow(_cut, CUT)
    return cut.unionByName(texts.filter("doc_id is null").select("text").mapInArrow(_whole, CUT))
