"""Token counts by a two-tier lookup (operator 10).

Texts are cut into pre-tokens in the worker that reads them; no pre-token is ever shuffled
with its text. The cut is numpy work over the code points of many documents at once, and a
pre-token is looked up by a 64-bit hash of its code points.

Tier one is a compact hash table (open addressing: slots of hash and length, at most half
full) of frequent pre-tokens, broadcast to all workers and probed for every pre-token. It is
found over the whole corpus by bounded per-task summaries: each task hands on its ``SUMMARY``
most frequent ones, and ``TABLE`` of all enter. Tier two is a bounded cache in each worker,
by the pre-token itself, asked only for misses (once for each distinct one of a slice); what
it lacks is encoded by the tokenizer library, many pre-tokens to a call. The tiers only save
time: counts are the library's for every text.

Defined cases: a null or empty text has no tokens; a special token's string inside a text
is one token, as the library's default has it; equal rows each appear; a null doc_id is
passed on; a very long text is one slice in one task. Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, TextBlock, map_slices, mix, powers, received, send, slices, texts, worker_cache

MODEL = "byte_bpe_50k.json"
TABLE = 50_000
SUMMARY = 8_000
COUNTED = 150_000
CACHED = 400_000
LIMIT = 512
SLICE = 1 << 20
LETTER, NUMBER, BLANK, OTHER = range(4)
_ALL = 0x110000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kinds() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    import regex

    out = np.full(_ALL, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(_ALL) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
        out[np.array([ord(c) for c in regex.findall(pattern, every)])] = kind
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the documents' offsets in them."""
    if not len(data) or data.max() < 128:
        return data, offsets
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begins[offsets]


def cut(points: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, in the code points of documents back to back.

    The rule of the byte-level vocabulary: a run of letters, of numbers or of other signs,
    with one blank (0x20) before it; white space but for such a blank, the last sign of
    which stands alone before a run; and 's 't 're 've 'm 'll 'd where an apostrophe begins
    a pre-token.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = edge[:n]  # of its document
    k = kind[points]
    blank = k == BLANK
    begin = first.copy()
    begin[1:] |= k[1:] != k[:-1]
    # the last white space before a run begins a pre-token of its own; if it is a blank, the run belongs to it
    last = blank[:-1] & ~blank[1:] & ~first[1:]
    begin[:-1] |= last
    joined = np.zeros(n, bool)
    joined[1:] = last & (points[:-1] == 32)
    begin &= ~joined
    mark = np.flatnonzero((points == 39) & begin)
    if len(mark):
        # positions past the document's end read as 0, which no ending has
        document_end = offsets[np.searchsorted(offsets, mark, side="right")]
        one, two = (np.where(mark + i < document_end, points[np.minimum(mark + i, n - 1)], 0) for i in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for size, found in ((1, mark[short]), (2, mark[long])):
            begin[found + 1] = False
            after = found + 1 + size
            after = after[after < n]
            begin[after[~blank[after]]] = True
    return np.flatnonzero(begin)


def hashes_of(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pre-token's code points."""
    n = len(points)
    ends = np.append(begins[1:], n)
    with np.errstate(over="ignore"):
        values = points.astype(np.uint64)
        values += np.uint64(0x632BE59BD9B4E019)
        values *= np.uint64(0x9E6C63D0876A9A47)
        values ^= values >> np.uint64(29)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, n), out=sums[1:])
        return mix((sums[ends] - sums[begins]) * powers(_INVERSE, n)[begins] + (ends - begins).astype(np.uint64))


@dataclass(frozen=True)
class LengthTable:
    """Open addressing over a power of two of slots; a slot without a length is free."""

    keys: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, lengths: np.ndarray) -> LengthTable:
        slots = 1 << max(4, int(2 * len(keys)).bit_length())
        out, held = np.zeros(slots, np.uint64), np.zeros(slots, np.uint16)
        for key, length in zip(keys.tolist(), lengths.tolist(), strict=True):
            at = key & (slots - 1)
            while held[at]:
                at = (at + 1) & (slots - 1)
            out[at], held[at] = key, length
        return LengthTable(out, held)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Length of each key, 0 where the table lacks it."""
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.lengths[at], 0).astype(np.int64)
        left = np.flatnonzero((out == 0) & (self.lengths[at] > 0))
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            hit = (self.keys[at] == keys[left]) & (self.lengths[at] > 0)
            out[left[hit]] = self.lengths[at[hit]]
            more = ~hit & (self.lengths[at] > 0)
            left, at = left[more], at[more]
        return out


class Splitter:
    """Slices of texts to pre-tokens, and the library behind the tiers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kinds()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def split(self, block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, document offsets, begins and hashes of all pre-tokens."""
        points, offsets = code_points(block.bytes, block.offsets)
        begins = cut(points, offsets, self.kind)
        return points, offsets, begins, hashes_of(points, begins) if len(begins) else np.zeros(0, np.uint64)

    def odd(self, block: TextBlock) -> list[int]:
        """Documents that hold the string of a special token."""
        data = block.bytes.tobytes()
        if not any(s in data for s in self.special):
            return []
        return [d for d, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)) if any(s in data[a:b] for s in self.special)]

    def lengths(self, tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]


def text_of(points: np.ndarray, begin: int, end: int) -> str:
    return points[begin:end].astype(np.uint32).tobytes().decode("utf-32-le")


def splitter(path: str) -> Splitter:
    store = worker_cache()
    if ("splitter", path) not in store:
        store["splitter", path] = Splitter(path)
    return store["splitter", path]


def frequent(docs: DataFrame, path: str, table: int = TABLE) -> LengthTable:
    """At most ``table`` pre-tokens of the whole corpus, most frequent first, with their token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(path)
        names: dict[int, str] = {}
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole, SLICE):
                points, _, begins, hashes = own.split(TextBlock(batch.column(0)))
                found, first, n = np.unique(hashes, return_index=True, return_counts=True)
                ends = np.append(begins[1:], len(points))
                for h, i in zip(found[n > 1].tolist(), first[n > 1].tolist(), strict=True):
                    if h not in names:
                        names[h] = text_of(points, int(begins[i]), int(ends[i]))
                keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
                if len(keys) > 2 * COUNTED:
                    keep = np.sort(np.argsort(-counts, kind="stable")[:COUNTED])
                    keys, counts = keys[keep], counts[keep]
                    held = set(keys.tolist())
                    names = {h: t for h, t in names.items() if h in held}
        order = np.argsort(-counts, kind="stable")
        top = [(names[h], n) for h, n in zip(keys[order].tolist(), counts[order].tolist(), strict=True) if h in names and len(names[h]) <= 64][:SUMMARY]
        if top:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*top, strict=True), (pa.string(), pa.int64()), strict=True)], names=["token", "n"])

    found = texts(docs).select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    names = [r.token for r in found.orderBy(F.desc("n"), "token").limit(table).collect()]
    lengths = np.array(splitter(path).lengths(names) if names else [], np.int64)
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in names], np.int64)
    keys = hashes_of(points, np.cumsum(sizes) - sizes) if names else np.zeros(0, np.uint64)
    return LengthTable.of(keys, lengths)


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""
    path = path or model_path()
    sent = send(docs.sparkSession, frequent(docs, path, table))

    def make():
        own, known = splitter(path), received(sent)
        cache: dict[str, int] = worker_cache().setdefault(("lengths", path), {})

        def lengths_of(points: np.ndarray, begins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            out = known.find(hashes)
            missed = np.flatnonzero(out == 0)
            if len(missed):
                _, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
                at = missed[first]
                tokens = [text_of(points, a, b) for a, b in zip(begins[at].tolist(), np.append(begins[1:], len(points))[at].tolist(), strict=True)]
                if len(cache) > CACHED:
                    cache.clear()
                new = [t for t in tokens if t not in cache]
                for lo in range(0, len(new), 20_000):
                    part = new[lo : lo + 20_000]
                    cache.update(zip(part, own.lengths(part), strict=True))
                out[missed] = np.fromiter((cache[t] for t in tokens), np.int64, len(tokens))[back]
            return out

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            block = TextBlock(batch.column(1))
            points, offsets, begins, hashes = own.split(block)
            tokens = np.zeros(block.n, np.int64)
            if len(begins):
                doc = np.searchsorted(offsets, begins, side="right") - 1
                tokens = np.bincount(doc, lengths_of(points, begins, hashes), minlength=block.n).astype(np.int64)
            for d in own.odd(block):
                tokens[d] = own.lengths([batch.column(1)[d].as_py()])[0]
            return pa.record_batch([batch.column(0), pa.array(np.diff(block.offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return work

    return map_slices(texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", SLICE)
