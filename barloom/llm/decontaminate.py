"""Benchmark decontamination by spaced seeds (operator 6).

Texts are compared as normalised tokens: letters lower-cased, punctuation dropped, words
at white space. A fixed mask samples some positions of a window of at least ``SPAN`` tokens
and ignores the others, so a substitution at an ignored position leaves the seed as it was.
Together the masks meet every stretch that counts as a leak by default (``MASKS``).
The seeds of all benchmark windows form an index; the windows of every document are
joined to it, and each hit names an item and a diagonal (document position minus item
position). Along that diagonal the tokens are compared one by one: the longest stretch
that begins and ends inside both texts with at least ``share`` equal tokens counts as
leaked if it has ``least`` tokens, or is the whole of an item of fewer than ``least``
(equal in every token). Items under ``SHORT`` tokens are no evidence.

Documents never move: the index travels to them. It is sent in blocks of bounded size
(``BLOCK_BYTES`` of benchmark text), one pass over the documents for each block; the driver
holds one block at a time. Seeds that many items share give many hits: those are compared
``HITS`` at a time, all of them.

Defined cases: null texts count as empty; empty texts leak nothing; equal rows each
appear; repeated items each match; a null doc_id or item_id is passed on. Items of fewer
than ``short`` tokens are ignored: four words or less stand in clean text by chance; a
caller who wants them sets ``short=1``. A very long text is one slice in one task. Other
columns of the input are ignored (or kept, by ``keep_clean``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, STAGE_BYTES, TextBlock, _byte_table, map_slices, materialize, mix, powers, received, runs_of, send, slices, span_hashes, texts

#: Sampled positions are 1; no mask spans fewer than SPAN tokens. By enumeration of all placements of substitutions
#: every stretch of 13 to 25 tokens with four fifths equal holds a seed of one of them (the last is for what the
#: first three miss); a longer stretch can be cut into such lengths, one of which has four fifths equal.
MASKS = ("11101011", "11011101", "10110111", "111000000111")
SPAN = 8
LEAST, SHARE, SHORT = 13, 0.8, 5
BLOCK_BYTES = 32 << 20
HITS = 1 << 20
_WORD = _byte_table(b"0123456789" + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_FOLD_BITS = 22


def tokens_of(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the whole block and where each document's tokens begin (n + 1 entries)."""
    data = block.bytes
    low = LOWER[data]
    accented = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[accented] += 0x20  # capital letters of Latin-1
    kept = _WORD[data] | SPACE[data]
    before = np.concatenate(([0], np.cumsum(kept)))
    flat, offsets = low[kept], before[block.offsets]
    starts, ends = runs_of(~SPACE[flat], offsets)
    return span_hashes(flat, starts, ends), np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class SeedIndex:
    """Sorted seeds with the item position each comes from, and the items' tokens."""

    seeds: tuple[np.ndarray, ...]  # for each probe
    places: tuple[np.ndarray, ...]
    probes: tuple[tuple[int, ...], ...]  # sampled offsets of each probe
    tokens: np.ndarray
    begins: np.ndarray
    ids: tuple


def _seeds(tokens: np.ndarray, probe: tuple[int, ...]) -> np.ndarray:
    n = max(0, len(tokens) - probe[-1])
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for weight, at in zip(powers(np.uint64(0xA24BAED4963EE407), len(probe)), probe, strict=True):
            out += tokens[at : at + n] * weight
    return mix(out)


def build_index(items: list[tuple[object, str | None]], short: int = SHORT) -> SeedIndex:
    block = TextBlock(pa.array([t or "" for _, t in items], pa.string()))
    tokens, begins = tokens_of(block)
    sizes = np.diff(begins)
    probes = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
    probes += [tuple(range(int(n))) for n in np.unique(sizes[(sizes >= max(short, 1)) & (sizes < SPAN)])]
    seeds, places = [], []
    for probe in probes:
        own = _seeds(tokens, probe)
        place = np.arange(len(own))
        item = np.searchsorted(begins, place, side="right") - 1
        whole = probe[-1] + 1 if probe[-1] + 1 < SPAN else 0  # short probes are for items of that very length
        fits = (place + probe[-1] < begins[item + 1]) & ((sizes[item] == whole) if whole else True)
        order = np.argsort(own[fits], kind="stable")
        seeds.append(own[fits][order])
        places.append(place[fits][order])
    return SeedIndex(tuple(seeds), tuple(places), tuple(probes), tokens, begins, tuple(i for i, _ in items))


def longest(equal: np.ndarray, share: float) -> tuple[int, int]:
    """Longest stretch of ``equal`` in which at least ``share`` hold: its start and length."""
    gain = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - share, -share))))
    best = np.maximum.accumulate(gain[::-1])[::-1]  # non-increasing
    reach = np.searchsorted(-best, -gain + 1e-9, side="right") - 1
    size = reach - np.arange(len(gain))
    at = int(np.argmax(size))
    return at, int(size[at])


def seed_hits(tokens: np.ndarray, begins: np.ndarray, index: SeedIndex, filters: list[np.ndarray], most: int = HITS) -> Iterator[np.ndarray]:
    """Rows (document, item, diagonal) with an equal seed, about ``most`` at a time."""
    for seeds, places, probe, known in zip(index.seeds, index.places, index.probes, filters, strict=True):
        own = _seeds(tokens, probe)
        at = np.flatnonzero(known[(own >> np.uint64(64 - _FOLD_BITS)).astype(np.int64)])
        lo = np.searchsorted(seeds, own[at], side="left")
        n = np.searchsorted(seeds, own[at], side="right") - lo
        doc = np.searchsorted(begins, at, side="right") - 1
        some = (n > 0) & (at + probe[-1] < begins[doc + 1])
        at, lo, n, doc = at[some], lo[some], n[some], doc[some]
        total = np.cumsum(n)
        cuts = np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, most)[1:])
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            if b > a:
                k = n[a:b]
                place = places[np.repeat(lo[a:b] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
                yield np.unique(np.column_stack([np.repeat(doc[a:b], k), np.searchsorted(index.begins, place, side="right") - 1, np.repeat(at[a:b], k) - place]), axis=0)


def hits_of(block: TextBlock, index: SeedIndex, filters: list[np.ndarray], least: int, share: float, most: int = HITS) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, document token, item token, tokens, equal tokens): the longest leak of each pair."""
    tokens, begins = tokens_of(block)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for rows in seed_hits(tokens, begins, index, filters, most):
        for doc, item, diagonal in rows.tolist():
            a, b = int(index.begins[item]), int(index.begins[item + 1])
            lo, hi = max(a, int(begins[doc]) - diagonal), min(b, int(begins[doc + 1]) - diagonal)
            equal = index.tokens[lo:hi] == tokens[lo + diagonal : hi + diagonal]
            at, size = longest(equal, share)
            same = int(equal[at : at + size].sum())
            found = (size, same, lo + at + diagonal - int(begins[doc]), lo + at - a)
            # of leaks of one length the one with most equal tokens, then the first; hits come in no order
            if (size >= least or size == b - a == same) and ((doc, item) not in best or (-size, -same, *found[2:]) < (-best[doc, item][0], -best[doc, item][1], *best[doc, item][2:])):
                best[doc, item] = found
    return [(d, i, p, q, n, e) for (d, i), (n, e, p, q) in sorted(best.items())]


def _filters(index: SeedIndex) -> list[np.ndarray]:
    out = []
    for seeds in index.seeds:
        known = np.zeros(1 << _FOLD_BITS, bool)
        known[(seeds >> np.uint64(64 - _FOLD_BITS)).astype(np.int64)] = True
        out.append(known)
    return out


def index_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, short: int = SHORT) -> tuple[int, Iterator[SeedIndex]]:
    """Broadcast-sized indexes of the benchmark, one by one, and how many; together they cover all of its items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-int(total) // block_bytes) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return blocks, (build_index([tuple(r) for r in items.where(part == i).orderBy("item_id", "text").collect()], short) for i in range(blocks))


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, short: int = SHORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item with a leak: doc_id, item_id, doc_token, item_token, n_overlap, n_equal."""
    spark = docs.sparkSession

    def one(index: SeedIndex) -> DataFrame:
        sent = send(spark, index)

        def make():
            index = received(sent)
            filters = _filters(index)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                rows = hits_of(TextBlock(batch.column(1)), index, filters, least, share)
                if not rows:
                    return None
                doc, item, *rest = zip(*rows, strict=True)
                return pa.record_batch(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([index.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)],
                    names=["doc_id", "item_id", "doc_token", "item_token", "n_overlap", "n_equal"],
                )

            return work

        out = map_slices(texts(docs), make, "doc_id long, item_id long, doc_token long, item_token long, n_overlap long, n_equal long")
        if blocks > 1:  # so that this block's index can go before the next one comes
            out = materialize(out, "leaks")
            sent.destroy()
        return out

    blocks, indexes = index_blocks(benchmark, block_bytes, short)
    return reduce(DataFrame.union, map(one, indexes))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE, short: int = SHORT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without documents that hold a leak; each is judged where it lies, nothing is shuffled."""
    spark, out = docs.sparkSession, docs.withColumn("text", F.col("text").cast("string"))
    schema = out.schema
    blocks, indexes = index_blocks(benchmark, block_bytes, short)
    for index in indexes:
        sent = send(spark, index)

        def run(batches, sent=sent):
            index = received(sent)
            filters = _filters(index)
            for whole in batches:
                for batch in slices(whole, STAGE_BYTES):
                    block = TextBlock(batch.column(batch.schema.get_field_index("text")))
                    clean = np.ones(block.n, bool)
                    clean[[r[0] for r in hits_of(block, index, filters, least, share)]] = False
                    yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
        if blocks > 1:
            out = materialize(out, "clean")
            sent.destroy()
    return out
