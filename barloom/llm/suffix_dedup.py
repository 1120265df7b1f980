"""Removal of repeated byte strings by suffix arrays (operator 8).

A byte goes if it lies in a string of ``SIZE`` bytes that also starts anywhere else.

1. Each window of SIZE bytes has a key: the least hash among its ``GRAM``-byte strings.
   Equal windows have equal keys, and neighbouring windows mostly share one, so a text is
   a short list of keys. Texts that are equal as a whole are one text from here on.
2. Keys that occur once can hold no repeat. Runs of windows whose key occurs again
   become pieces: the run's bytes and the SIZE - 1 after it, sent to the shard of their key.
3. A shard sorts the suffixes of its distinct pieces in blocks: Larsson-Sadakane
   refinement in numpy (only groups that are not yet sorted are refined, the compared
   length doubles each round). Equal windows are neighbours among the windows in the array. Whether
   neighbours are equal over SIZE bytes is read from the ranks of the last round that compared no more
   than SIZE bytes: those of both beginnings and of both ends.
4. All windows of a key are in one shard, unless its pieces weigh over ``SPLIT``: then
   it is dealt over several. Each hands on its distinct windows as sorted fingerprints,
   packed by ranges, and those are merged across shards by binary search. A piece weighs
   one (two if its key occurs in it twice) and one more for each ``HEAVY`` windows.
5. The repeats of a document are united and cut out.

Bytes are one measure of a passage, words another: the same five steps over the texts
written as three bytes for each word (24 bits of its hash) give ``n_shared_words``, the words that lie in a string
of ``PASSAGE`` words which another document holds too. Nothing is cut by it.

Defined cases: null text counts as empty; texts under SIZE bytes lose nothing; a text
equal to another of SIZE bytes or more goes whole; overlapping repeats in one text count;
equal rows each appear; a null doc_id is passed on. A very long text is read in one task,
but its pieces are spread by key, and a run of windows with one key (periodic text) is cut
into pieces of ``LONG`` windows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, _MIX, SPACE, TextBlock, materialize, mix, powers, slices, span_hashes, texts, worker_cache

SIZE, GRAM = 400, 128
SPLIT = 1_000
BLOCK = 1 << 18
HEAVY, LONG = 512, 32 << 10
PASSAGE, CODE = 50, 3  # CODE: bytes for a word
WORD_GRAM = 8 * CODE
_PLACE = 22  # bits for a position in a chunk; the others of a word are the key's
_PACKED = 63  # bits of the number that holds two ranks and a suffix
_CHUNK = 1 << 16  # arrays of so many numbers, and those of a slice's words, stay in a core's cache
READ_BYTES = 1 << 18
CHAIN = 256


def kept_powers(base: np.uint64, n: int) -> np.ndarray:
    """``powers``; a worker keeps those that a slice needs."""
    if n > 2 * READ_BYTES:
        return powers(base, n)
    kept = worker_cache()
    if ("powers", int(base)) not in kept:
        kept["powers", int(base)] = powers(base, 2 * READ_BYTES)
    return kept["powers", int(base)][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position that has so many after it."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_MIX[data] * kept_powers(_BASE, len(data)), out=sums[1:])
        out = sums[gram:] - sums[:n]
        out *= kept_powers(_INVERSE, n)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
        return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_keys(data: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` bytes its key, and the position of the string that gives it (the first of equals)."""
    width = size - gram + 1
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.empty(n, np.int64), np.empty(n, np.int64)
    low = np.uint64((1 << _PLACE) - 1)
    for base in range(0, n, _CHUNK):
        part = gram_hashes(data[base : min(base + _CHUNK, n) + size - 1], gram)
        least = sliding_least((part & ~low) | np.arange(len(part), dtype=np.uint64), width)
        keys[base : base + len(least)] = (least >> np.uint64(_PLACE)).view(np.int64)
        at[base : base + len(least)] = (least & low).view(np.int64) + base
    return keys, at


def word_codes(block: TextBlock) -> TextBlock:
    """The same documents with CODE bytes for each word: 24 bits of its hash."""
    starts, ends = block.runs(~SPACE[block.bytes])
    out = TextBlock.__new__(TextBlock)
    out.bytes = np.ascontiguousarray(span_hashes(block.bytes, starts, ends, kept_powers).view(np.uint8).reshape(-1, 8)[:, 8 - CODE :]).ravel()
    out.offsets, out.n = CODE * np.searchsorted(starts, block.offsets), block.n
    return out


def key_runs(block: TextBlock, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of at most LONG windows with one key: document, first window (in the block), windows, key, weight."""
    keys, at = window_keys(block.bytes, size, gram)
    n = len(keys)
    fits = np.zeros(n, bool)
    for a, b in zip(block.offsets[:-1].tolist(), (block.offsets[1:] - size + 1).tolist(), strict=True):
        if b > a:
            fits[a:b] = True
    if not fits.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    first = fits.copy()
    first[1:] &= ~fits[:-1] | (keys[1:] != keys[:-1])
    edge = block.offsets[:-1]
    edge = edge[edge < n]
    first[edge] = fits[edge]
    start = np.flatnonzero(first)
    last = fits.copy()
    last[:-1] &= ~fits[1:] | first[1:]
    end = np.flatnonzero(last)
    double = at[start] != at[end]
    parts = (end - start) // LONG + 1
    if (parts > 1).any():  # only a key that occurs again and again gives so long a run
        double = np.repeat(double, parts)
        nth = np.arange(len(double)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = np.repeat(start, parts) + nth * LONG, np.repeat(end, parts)
        end = np.minimum(end, start + LONG - 1)
    windows = end - start + 1
    return block.owner(start), start, windows, keys[start], 1 + double + windows // HEAVY


def read_keys(rows: DataFrame, size: int, gram: int, passage: int) -> DataFrame:
    """One row per document: sizes, digests and keys of bytes and of words (each shifted by eight bits, which hold its weight)."""

    def lists(block: TextBlock, size: int, gram: int) -> pa.Array:
        doc, _, _, keys, weight = key_runs(block, size, gram)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(block.n + 1)).astype(np.int32)), pa.array(keys << 8 | weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, READ_BYTES):
                block = TextBlock(batch.column(2))
                words = word_codes(block)
                digests = [hashlib.sha256(block.bytes[a:b]) for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        batch.column(0), batch.column(3), batch.column(1), pa.array(np.diff(block.offsets)), pa.array([d.hexdigest() for d in digests], pa.string()),
                        pa.array([d.digest()[:16] for d in digests], pa.binary()), pa.array(np.diff(words.offsets) // CODE), lists(block, size, gram), lists(words, CODE * passage, WORD_GRAM),
                    ],
                    names=["uid", "row_key", "doc_id", "n_bytes", "sha256", "same", "n_words", "keys", "word_keys"],
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", "row_key")
    return numbered.mapInArrow(run, "uid long, row_key binary, doc_id long, n_bytes long, sha256 string, same binary, n_words long, keys array<long>, word_keys array<long>")


def keys_again(first: DataFrame, column: str) -> DataFrame:
    """(uid, keys, counts): of each text the keys that occur again anywhere, with their weight in all texts."""
    own = first.select("uid", F.explode(column).alias("x"))
    own = own.select("uid", F.shiftright("x", 8).alias("key"), F.col("x").bitwiseAND(255).alias("n")).groupBy("uid", "key").agg(F.sum("n").alias("n"))
    often = own.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    lists = own.select("uid", "key").join(often, "key").groupBy("uid").agg(F.collect_list(F.struct("key", "n")).alias("x"))
    return lists.select("uid", F.col("x.key").alias(column), F.col("x.n").alias(column + "_n"))


def cut_pieces(rows: DataFrame, size: int, gram: int, split: int, words: bool = False) -> DataFrame:
    """(uid, text, keys, counts) -> the pieces of keys that occur again, of the text's bytes or of its words' codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, READ_BYTES):
                block = TextBlock(batch.column(1))
                if words:
                    block = word_codes(block)
                doc, start, windows, keys, _ = key_runs(block, size, gram)
                begin = np.searchsorted(doc, np.arange(block.n + 1))
                uids = batch.column(0).to_numpy()
                known, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                out: list[tuple] = []
                for d in range(block.n):
                    a, b = int(begin[d]), int(begin[d + 1])
                    often = dict(zip(known[d], counts[d], strict=True))
                    uid, base = int(uids[d]), int(block.offsets[d])
                    for key, p, n in zip(keys[a:b].tolist(), start[a:b].tolist(), windows[a:b].tolist(), strict=True):
                        if key in often:
                            parts = -(-often[key] // split)
                            part = hash((uid, p - base)) % parts if parts > 1 else 0
                            out.append((key, part, parts, uid, p - base, n, block.bytes[p : p + n + size - 1].tobytes()))
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)

    return rows.mapInArrow(run, "key long, part int, parts int, uid long, start long, windows long, piece binary")


_PIECE_NAMES = ["key", "part", "parts", "uid", "start", "windows", "piece"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def eight_bytes(data: np.ndarray, more: int = 0) -> np.ndarray:
    """The eight bytes from each position, the first the highest; bytes past the end are zero."""
    eight = np.concatenate((data, np.zeros(8 + more, np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):
        eight = (eight[:-step] << np.uint64(8 * step)) | eight[step:]
    return eight[: len(data) + more]


def doublings(data: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(h, rank of each suffix by its first h bytes) for h = 8, 16 and so on to ``depth``, or until no two share a rank.

    The array of ranks is one and the same each time. Larsson and Sadakane: only groups that are not sorted yet are refined.
    """
    n = len(data)
    eight = eight_bytes(data)
    rest = np.argsort(eight)
    ordered = eight[rest]
    rank = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), ordered[1:] != ordered[:-1])))
    place = starts + 1
    bits = np.int64(n.bit_length())
    packs = 3 * bits <= _PACKED  # both ranks and the suffix fit one number, which is sorted as it is
    h = 8
    while True:
        sizes = np.diff(starts, append=len(rest))
        rank[rest] = np.repeat(place, sizes)
        yield h, rank
        rest = rest[np.repeat(sizes > 1, sizes)]  # suffixes in groups that are not sorted yet
        if h >= depth or not len(rest):
            return
        key = rank[rest] << bits | rank[np.minimum(rest + h, n)]
        if packs:
            key = key << bits | rest
            key.sort()
            rest = key & np.int64((1 << int(bits)) - 1)
            key >>= bits
        else:
            by = np.argsort(key)
            rest, key = rest[by], key[by]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        group = key[starts] >> bits
        old = np.concatenate(([True], group[1:] != group[:-1]))
        place = group + starts - np.maximum.accumulate(np.where(old, starts, 0))
        h *= 2


def refine(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` bytes (8 times a power of two), or by all of them; equal prefixes share a rank.

    A rank is the place of the group's first suffix in sorted order. Bytes past the end are zero.
    """
    for _, rank in doublings(data, depth or len(data)):
        pass
    return rank


def array_of(rank: np.ndarray) -> np.ndarray:
    """The suffix array, from the ranks of all suffixes by all of their bytes."""
    n = len(rank)
    array, every = np.zeros(n, np.int64), np.arange(n)
    array[rank - 1] = every
    if (array[rank - 1] == every).all():
        return array
    # only a suffix and the same with zero bytes after it are still equal: the shorter one comes first
    return n - 1 - np.argsort(rank[::-1], kind="stable")


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order."""
    return array_of(refine(data)[: len(data)])


def kasai(data: bytes | np.ndarray, array: list[int] | np.ndarray, most: int | None = None, chain: int = CHAIN) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the suffix array, up to ``most``.

    Going from a suffix to the next one in the text, a common prefix shrinks by one byte at
    most, so only bytes beyond that are compared. The text is cut into chains of ``chain``
    positions that start afresh, and all chains take a step together. ``repeated_windows`` needs less
    than these lengths; the tests compare the two.
    """
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    array = np.asarray(array, np.int64)
    n = len(data)
    most = n if most is None else min(most, n)
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    eight = eight_bytes(data, most + 16)
    wide = 8 * np.arange(1, 9)
    out = np.zeros(n, np.int64)
    starts = np.arange(0, n, chain)
    h = np.zeros(len(starts), np.int64)
    for step in range(min(chain, n)):
        s = starts + step
        if s[-1] >= n:
            starts, s, h = starts[:-1], s[:-1], h[:-1]
        here = place[s]
        t = array[here - 1]  # for the first suffix the last one, put right below
        differ = eight[s + h] ^ eight[t + h]
        h += _equal_bytes(differ)
        left = np.flatnonzero((differ == 0) & (h < most))
        while len(left):
            a, b = s[left], t[left]
            at = h[left, None] + wide - 8
            differ = eight[np.minimum(a[:, None] + at, n + most)] ^ eight[np.minimum(b[:, None] + at, n + most)]
            whole = (differ == 0).all(axis=1)
            word = np.where(whole, 7, (differ != 0).argmax(axis=1))
            h[left] += 8 * word + _equal_bytes(differ[np.arange(len(left)), word])
            left = left[whole & (h[left] < most)]
        h = np.minimum(h, np.minimum(n - np.maximum(s, t), most))
        h[here == 0] = 0
        out[here] = h
        h = np.maximum(h - 1, 0)
    return out


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many of the eight bytes are equal, from the first on."""
    out = np.full(len(differ), 8, np.int64)
    some = differ != 0
    # the byte of the highest bit that differs, by halving
    x = differ[some]
    top = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        high = x >> np.uint64(bits) != 0
        top[high] += bits
        x = np.where(high, x >> np.uint64(bits), x)
    out[some] = 7 - (top >> 3)
    return out


def repeated_windows(pieces: list[bytes], windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all pieces, in order: position in the joined pieces, class, and how many share the class.

    Two windows have one class if, and only if, their bytes are equal. Equal ones are neighbours among the windows in
    the suffix array, and are told by ranks that its sort has passed: by the first ``reach`` bytes, at most ``size``,
    of a window and those of its end.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    length = windows + size - 1
    base = np.cumsum(length) - length
    at = np.repeat(base - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    reach, near = min(size, 8), eight_bytes(data) >> np.uint64(8 * (8 - min(size, 8)))
    for h, rank in doublings(data, len(data)):
        if h <= size < 2 * h:
            reach, near = h, rank.copy()
        elif h <= size:
            reach, near = h, rank
    is_window = np.zeros(len(data), bool)
    is_window[at] = True
    array = array_of(rank[: len(data)])
    array = array[is_window[array]]  # suffixes that run on into the next piece lie between windows
    first, last = near[array], near[array + (size - reach)]
    fresh = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    kind = np.concatenate(([0], np.cumsum(fresh)))
    count = np.bincount(kind)
    classes = np.empty(len(data), np.int64)
    classes[array] = kind
    return at, classes[at], count[classes[at]]


def _fingerprints(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the ``size`` bytes from each position."""
    with np.errstate(over="ignore"):
        out = []
        for base, salt in ((_BASE, 1), (np.uint64(0xC2B2AE3D27D4EB4F), 2)):
            inverse = np.uint64(pow(int(base), -1, 2**64))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(mix(_MIX + np.uint64(salt))[data] * powers(base, len(data)), out=sums[1:])
            out.append(mix((sums[at + size] - sums[at]) * powers(inverse, len(data) + 1)[at]).view(np.int64))
        return out[0], out[1]


_FOUND = "uid long, start long, stop long, key long, slot int, packed binary"
_FOUND_NAMES = ["uid", "start", "stop", "key", "slot", "packed"]


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_FOUND_NAMES)


def settle(group: list[tuple], size: int, across: bool = False) -> Iterator[pa.RecordBatch]:
    """Repeats of some whole keys: spans of repeated windows; of split keys also their distinct windows.

    ``across``: only windows that two documents hold count.

    Those go packed: for each slot of fingerprints one row with the sorted fingerprints,
    a place of each, and whether its window was alone here. A key of p parts has p slots,
    so a slot gathers about as much as a part holds.
    """
    of: dict[bytes, int] = {}
    refs: list[list[tuple[int, int]]] = []
    key_of, parts_of = [], []
    for key, _, parts, uid, start, _, piece in group:
        i = of.setdefault(piece, len(refs))
        if i == len(refs):
            refs.append([])
            key_of.append(key)
            parts_of.append(parts)
        refs[i].append((uid, start))
    pieces = list(of)
    windows = np.array([len(p) - size + 1 for p in pieces], np.int64)
    at, classes, count = repeated_windows(pieces, windows, size)
    copies = np.array([len(r) for r in refs])
    owner = np.repeat(np.arange(len(pieces)), windows)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
    if across:
        low, high = (np.array([f(r)[0] for r in refs], np.int64)[owner] for f in (min, max))
        least, most = np.full(len(count), np.iinfo(np.int64).max), np.full(len(count), np.iinfo(np.int64).min)
        np.minimum.at(least, classes, low)
        np.maximum.at(most, classes, high)
        again = least[classes] != most[classes]
    else:
        again = (count > 1) | (copies[owner] > 1)
    first, last = again.copy(), again.copy()
    same = owner[1:] == owner[:-1]
    first[1:] &= ~(again[:-1] & same)
    last[:-1] &= ~(again[1:] & same)
    rows = []
    for i, a, b in zip(owner[first].tolist(), inside[first].tolist(), (inside[last] + size).tolist(), strict=True):
        rows += [(uid, start + a, start + b) for uid, start in refs[i]]
    if rows:
        yield _spans(rows)
    parts = np.array(parts_of, np.int64)
    pick = np.flatnonzero(parts[owner] > 1)
    if not len(pick):
        return
    _, one = np.unique(classes[pick], return_index=True)
    pick = np.union1d(pick[one], pick[~again[pick]])
    fp1, fp2 = _fingerprints(np.frombuffer(b"".join(pieces), np.uint8), at[pick], size)
    piece = owner[pick]
    keys = np.array(key_of, np.int64)[piece]
    slot = ((fp1.view(np.uint64) >> np.uint64(32)) * parts[piece].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    place = np.array([refs[i][0] for i in piece.tolist()], np.int64)
    cells = np.stack([fp1, fp2, place[:, 0], place[:, 1] + inside[pick], (~again[pick]).astype(np.int64)])
    order = np.lexsort((fp2, fp1, slot, keys))
    keys, slot, cells = keys[order], slot[order], cells[:, order]
    fresh = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (slot[1:] != slot[:-1]))))
    ends = np.append(fresh[1:], len(keys))
    packed = [np.ascontiguousarray(cells[:, a:b]).tobytes() for a, b in zip(fresh.tolist(), ends.tolist(), strict=True)]
    none = pa.nulls(len(fresh), pa.int64())
    yield pa.record_batch([none, none, none, pa.array(keys[fresh]), pa.array(slot[fresh].astype(np.int32)), pa.array(packed, pa.binary())], names=_FOUND_NAMES)


def search_shards(pieces: DataFrame, size: int, block: int, across: bool = False) -> DataFrame:
    """Suffix arrays of the shards, block by block of whole (key, part) groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight, before = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != before:
                    if weight >= block:
                        yield from settle(held, size, across)
                        held, weight = [], 0
                    before = row[:2]
                held.append(row)
                weight += len(row[6])
        if held:
            yield from settle(held, size, across)

    return pieces.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, _FOUND)


def merge_slot(packed: list[bytes], size: int, across: bool = False) -> list[tuple[int, int, int]]:
    """Windows that were alone in their shard but are in another one too: each shard's sorted fingerprints are searched in the others'.

    ``across``: a window is alone, too, while only one document holds it.
    """
    shards = [np.frombuffer(p, np.int64).reshape(5, -1) for p in packed]
    every = np.concatenate(shards, axis=1)
    ordered = np.sort(every[0])
    out = []
    # a fingerprint's first half that several shards hold, by binary search among all
    several = np.searchsorted(ordered, every[0], side="right") - np.searchsorted(ordered, every[0], side="left") > 1
    close = every[:, several]
    order = np.lexsort((close[2], close[1], close[0]))
    close = close[:, order]
    equal = (close[:2, 1:] == close[:2, :-1]).all(axis=0)
    shared = np.zeros(close.shape[1], bool)
    shared[1:] |= equal
    shared[:-1] |= equal
    if across and len(shared):
        begin = np.flatnonzero(np.concatenate(([True], ~equal)))
        # a window that several documents of one shard hold stands there once, under one of them
        several = (np.minimum.reduceat(close[2], begin) != np.maximum.reduceat(close[2], begin)) | (np.minimum.reduceat(close[4], begin) == 0)
        shared = np.repeat(several, np.diff(np.append(begin, len(shared))))
    for uid, start in close[2:4, shared & (close[4] == 1)].T.tolist():
        out.append((uid, start, start + size))
    return out


def merge_shards(found: DataFrame, size: int, across: bool = False) -> DataFrame:
    """(uid, start, stop) of windows of split keys that only another shard repeats; a task merges whole (key, slot) groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def batch_of(rows):
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["uid", "start", "stop"])

        for batch in batches:
            for key, slot, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, slot) != now:
                    if len(held) > 1 and (rows := merge_slot(held, size, across)):
                        yield batch_of(rows)
                    held, now = [], (key, slot)
                held.append(packed)
        if len(held) > 1 and (rows := merge_slot(held, size, across)):
            yield batch_of(rows)

    dealt = found.where("packed is not null").select("key", "slot", "packed").repartition("key", "slot").sortWithinPartitions("key", "slot")
    return dealt.mapInArrow(run, "uid long, start long, stop long")


def cut_out(rows: DataFrame) -> DataFrame:
    """(uid, text, spans) -> (uid, n_removed, n_spans, kept_sha256, kept)."""

    def one(text: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
        kept, past, removed, runs = [], 0, 0, 0
        for span in sorted((s["start"], s["stop"]) for s in spans):
            if span[0] > past or not runs:
                kept.append(text[past : span[0]])
                runs += 1
                past = span[0]
            if span[1] > past:
                removed += span[1] - past
                past = span[1]
        kept.append(text[past:])
        return removed, runs, b"".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [one((t or "").encode(), s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                removed, runs, kept = zip(*rows, strict=True)
                yield pa.record_batch(
                    [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                    names=["uid", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return rows.mapInArrow(run, "uid long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeats_of(wanted: DataFrame, column: str, size: int, gram: int, split: int, block: int, words: bool) -> DataFrame:
    """(uid, spans): where texts of ``wanted`` repeat, by the keys in ``column``; of words only what two documents share."""
    pieces = cut_pieces(wanted.where(F.col(column).isNotNull()).select("uid", "text", column, column + "_n"), size, gram, split, words)
    found = materialize(search_shards(pieces, size, block, words), "repeats")
    spans = found.where("packed is null").select("uid", "start", "stop").union(merge_shards(found, size, words))
    return spans.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def words_within(spans: Column, passage: int) -> Column:
    """Words in the union of spans of word codes (CODE bytes each); parts of words at the ends don't count."""
    whole = F.transform(spans, lambda s: F.struct(F.ceil(s["start"] / CODE).alias("a"), F.floor(s["stop"] / CODE).alias("b")))
    ordered = F.array_sort(F.filter(whole, lambda s: s["b"] - s["a"] >= passage))
    zero = F.struct(F.lit(0).cast("long").alias("past"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["past"], s["b"]).alias("past"), (acc["n"] + F.greatest(s["b"] - F.greatest(acc["past"], s["a"]), F.lit(0).cast("long"))).alias("n"))
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"])


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, split: int = SPLIT, block: int = BLOCK, keep_bytes: bool = False, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words: one row per document; ``kept`` (bytes) on demand.

    Rows are numbered once, in a written table. Texts are found again by a 128-bit digest of
    id and text, so it doesn't matter in which order the input is computed a second time.
    """
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))
    rows = texts(docs).withColumn("row_key", F.unhex(digest))
    read = materialize(read_keys(rows, size, gram, passage), "keys")
    # written, so that the last join has plain shuffles on both sides, which Spark splits where a text is hot
    groups = materialize(read.groupBy("same").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")), "groups")
    first = read.join(groups.select("uid"), "uid", "left_semi")
    lists = keys_again(first, "keys").join(keys_again(first, "word_keys"), "uid", "full")
    lists = first.select("uid", "row_key").join(lists, "uid")
    wanted = rows.select("row_key", "text").join(lists, "row_key").dropDuplicates(["row_key"])
    wanted = materialize(wanted.drop("row_key"), "candidates")
    spans = repeats_of(wanted, "keys", size, gram, split, block, False)
    shared = repeats_of(wanted, "word_keys", CODE * passage, WORD_GRAM, split, block, True).select("uid", words_within(F.col("spans"), passage).alias("n_shared"))
    cut = cut_out(wanted.select("uid", "text").join(spans, "uid"))
    more = ["kept"] if keep_bytes else []
    # a text that stands for its copies may be cut; copies of a text too short to be cut are left as they are
    cut = cut.select("uid", "n_removed", "n_spans", F.col("kept_sha256").alias("cut_sha256"), *more).join(shared, "uid", "full")
    full = read.drop("keys", "word_keys").join(groups.select("same", "copies"), "same").join(cut, "uid", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= size)
    nothing = hashlib.sha256(b"").hexdigest()
    out = [
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= passage), F.col("n_words")).otherwise(F.coalesce("n_shared", F.lit(0))).alias("n_shared_words"),
    ]
    if not keep_bytes:
        return full.select(*out)
    plain = rows.select("row_key", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw")).dropDuplicates(["row_key"])
    return full.join(plain, "row_key").select(*out, F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "raw")).alias("kept"))
