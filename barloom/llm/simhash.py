"""SimHash near-duplicates by bit-sliced comparison (operator 9).

1. A fingerprint for every text: XXH64 (seed 42) of each 4-word shingle, a bit set where
   over half of the shingles have it.
2. Equal fingerprints become one node (aggregated before the shuffle, so a text with any
   number of copies stays one row from there on).
3. Nodes within ``radius`` bits agree in at least ``bands - radius`` of ``bands`` bands.
   Each choice of bands is a table; nodes meet in a bucket of equal bands.
4. Bit planes stand vertically, 64 lanes to a machine word: carry-save counters add the
   differing bits plane by plane, and a block is left once every lane exceeds the radius.
   In a bucket of over ``SMALL`` nodes a node is compared with all still unlinked nodes at
   once; each node that a comparison finds is linked once and leaves the block, so a bucket
   gives a spanning forest, never all of its pairs. Buckets of up to ``SMALL`` nodes share
   planes: a lane is a pair of nodes some places apart in one bucket, many buckets to a word.
5. Components of the links; a component is named by its smallest doc_id. Components with
   over a ten-thousandth of all nodes (at most ten thousand) get their names by broadcast,
   so no task gathers one.

Defined cases: null text counts as empty; texts without words have fingerprint zero and
link like any other; equal rows each appear in the result; a null doc_id keeps its row and
takes no part in the naming of its component; an empty table gives an empty result; a very
long text is one slice in one task. Other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, TextBlock, map_slices, materialize, texts
from .components import connected_components, join_spread

SHINGLE = 4
RADIUS = 4
BANDS = 6
SMALL = 8
SEED = 42


def shingle_hashes(block: TextBlock, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, document by document, and how many each document has."""
    inside = ~SPACE[block.bytes]
    starts, ends = block.runs(inside)
    doc = block.owner(starts)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(block.n, np.int64)
    # words with one blank after each
    lengths = ends - starts
    new_start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    flat = np.full(int(new_start[-1] + lengths[-1] + 1), 32, np.uint8)
    flat[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(starts)), lengths)] = LOWER[block.bytes[inside]]
    words = np.bincount(doc, minlength=block.n)
    first = np.cumsum(words) - words
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = at + np.repeat(np.minimum(np.maximum(words, 1), shingle) - 1, count)
    view = memoryview(flat.tobytes())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(new_start[at].tolist(), (new_start[last] + lengths[last]).tolist(), strict=True)), np.uint64, len(at))
    return hashes, count


def fingerprints_of(block: TextBlock, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit SimHash of each document of the block."""
    return majority_bits(*shingle_hashes(block, shingle, seed))


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The bits that over half of each document's hashes have; hashes stand document by document, none gives zero."""
    out = np.zeros(len(count), np.uint64)
    if not len(hashes):
        return out
    some = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[some]
    step = 1 << 14  # hashes at a time: 64 bits of each are summed as 64-bit numbers
    ones = np.zeros((len(some), 64), np.int64)
    for lo in range(0, len(hashes), step):
        part = hashes[lo : lo + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.searchsorted(begin, lo, side="right") - 1, np.searchsorted(begin, lo + len(part), side="left")
        ones[i:j] += np.add.reduceat(bits, np.maximum(begin[i:j] - lo, 0), axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * ones > count[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = fingerprints_of(TextBlock(batch.column(1)), shingle, seed)
            return pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

        return work

    return map_slices(texts(docs, id_col, text_col), make, "doc_id long, fp long")


def band_masks(bands: int, radius: int) -> list[int]:
    """64-bit masks, one for each choice of bands - radius bands that must agree."""
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(bands), bands - radius)]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """planes[b] holds bit b of all values, 64 values in each word; spare lanes are never asked for."""
    lanes = -(-len(values) // 64) * 64
    padded = np.full(lanes, ~values[0], np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, query: int, radius: int, chunk: int = 8) -> np.ndarray:
    """A word mask of the lanes within ``radius`` bits of ``query``.

    Counter planes of weight 1, 2, 4, ... start so that a lane overflows at radius + 1;
    overflow is sticky. After each ``chunk`` of planes, words whose lanes have all
    overflowed are abandoned.
    """
    width = max(1, int(radius).bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    offset = (1 << width) - 1 - radius
    live = np.arange(planes.shape[1])
    counters = [np.full(len(live), full if offset >> w & 1 else np.uint64(0)) for w in range(width)]
    over = np.zeros(len(live), np.uint64)
    for b in range(64):
        carry = planes[b, live] ^ (full if query >> b & 1 else np.uint64(0))
        for w in range(width):
            counters[w], carry = counters[w] ^ carry, counters[w] & carry
        over |= carry
        if b % chunk == chunk - 1:
            keep = over != full
            if not keep.all():
                live, over = live[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    break
    out = np.zeros(planes.shape[1], np.uint64)
    out[live] = ~over
    return out


def lanes_of(mask: np.ndarray, n: int) -> np.ndarray:
    found = np.unpackbits(mask.view(np.uint8), bitorder="little")[:n]
    return np.flatnonzero(found)


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of ``values`` that a chain of steps within ``radius`` joins: at most len - 1."""
    left, right = [], []
    rest = np.arange(len(values))
    planes = bit_planes(values)
    alive = np.ones(len(values), bool)
    stack: list[int] = []
    dead = 0
    for seed in range(len(values)):
        if not alive[seed]:
            continue
        alive[seed] = False
        stack.append(seed)
        while stack:
            node = stack.pop()
            near = rest[lanes_of(within(planes, int(values[node]), radius), len(rest))]
            near = near[alive[near]]
            alive[near] = False
            dead += len(near) + 1
            left += [values[node]] * len(near)
            right += values[near].tolist()
            stack += near.tolist()
            if dead > 64 and dead * 2 > len(rest):  # take out what is linked already
                rest = rest[alive[rest]]
                if not len(rest):
                    rest = np.zeros(0, np.int64)
                    break
                planes, dead = bit_planes(values[rest]), 0
        if not len(rest):
            break
    return np.array(left, np.uint64), np.array(right, np.uint64)


def small_links(values: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int, most: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets of at most ``most`` nodes, for all buckets of a batch at once: planes of the differing bits of all pairs."""
    left, right = [], []
    for shift in range(1, most):
        i = np.flatnonzero((size[:-shift] <= most) & (group[:-shift] == group[shift:])) if len(group) > shift else np.zeros(0, int)
        if not len(i):
            break
        a, b = values[i], values[i + shift]
        near = lanes_of(within(bit_planes(a ^ b), 0, radius), len(a))
        left.append(a[near])
        right.append(b[near])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int, most: int = SMALL) -> Iterator[pa.RecordBatch]:
    """Links of buckets that arrive in order of their key; a bucket may span batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle(which, keys, values):
        change = np.flatnonzero((which[1:] != which[:-1]) | (keys[1:] != keys[:-1])) + 1
        begin = np.concatenate(([0], change))
        size = np.diff(np.append(begin, len(keys)))
        group = np.repeat(np.arange(len(begin)), size)
        a, b = small_links(values, group, size[group], radius, most)
        parts = [(a, b)] + [forest(values[s : s + n], radius) for s, n in zip(begin[size > most].tolist(), size[size > most].tolist(), strict=True)]
        a, b = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (0, 1))
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        which, keys, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        last = np.flatnonzero((which != which[-1]) | (keys != keys[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            held.append((which[:cut], keys[:cut], values[:cut].view(np.uint64)))
            yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        held.append((which[cut:], keys[cut:], values[cut:].view(np.uint64)))
    if held:
        yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(nodes: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``; their closure is exact."""
    masks = band_masks(bands, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("x")).select("x.which", "x.key", "fp")
    # in order of fp as well, so that the spanning links don't depend on the order of the input
    dealt = keyed.repartition("which", "key").sortWithinPartitions("which", "key", "fp")
    return dealt.mapInArrow(lambda batches: bucket_links(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_links.

    n_links counts other fingerprints that the spanning links of this document's own
    fingerprint touch; zero means that no different text is near.
    """
    prints = materialize(fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = materialize(links(nodes.select("fp"), radius, bands).distinct(), "near")
    roots = connected_components(found)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    touch = found.select(F.col("a").alias("fp")).union(found.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    named = materialize(named.join(touch, "fp", "left").select("root", "fp", "least", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    classes = join_spread(named, least, "root").select("fp", "component_id", "n_links")
    # from a written table both sides of the last join are plain shuffles, which Spark splits where a fingerprint is hot
    classes = materialize(classes, "classes")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component; all columns stay.

    Rows that share that doc_id are all kept, and so is a row whose doc_id is null.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    away = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__away")).distinct()
    return docs.join(away, docs[id_col].cast("long") == away["__away"], "left_anti")
