"""Best-fit packing of documents into sequences by a grouping genetic algorithm (operator 13).

Every text becomes token ids and an end token; only what is longer than a sequence is cut,
into whole sequences and a rest. Ids are the library's: no pre-token of the vocabulary holds
white space, so a text is cut at ASCII white space and each part is looked up in a bounded
cache of the worker, which encodes what it lacks, many parts to a call.

Pieces of a full sequence stand alone. The others are dealt over blocks of about ``BLOCK``
pieces by a hash of their row number. Each block is packed on ``islands``, populations that
evolve on their own for an epoch. A genome says which bin holds each piece. Crossover injects
some of the fullest bins of one parent whole into the other, removes that one's bins in which
a piece would now stand twice, and puts the displaced pieces back by best fit, longest first;
mutation dissolves some of the emptiest bins. Fitness is the mean squared fill, after the
number of bins. After each epoch the best genome of every island goes to the next one of its
block, in place of the worst there (a join of small written rows). A block stops when its bins
are as few as any packing can have.

Bins of a block that are nearly full (``FULL``) are final. What lies in the others goes to the next
level, dealt over fewer blocks, until one block holds it all or it no longer shrinks; so a block's last,
half-empty bin meets those of other blocks.

Defined cases: a null or empty text is its end token alone; a special token's string in a
text is one id, as the library's default has it; equal rows each are packed; a null doc_id
is passed on; an empty table gives an empty one. A very long text is one task's work. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, TextBlock, map_slices, materialize, runs_of, texts, worker_cache

MODEL = "word_bpe_49k.json"
SIZE, END = 4096, 1
BLOCK = 4_000
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3, 6, 3, 12
FULL = 0.999
LEVELS = 6
CACHED, LONGEST = 400_000, 64
SPECIAL, BLANKS = b"<|", b" \t\n\v\f\r"
LATIN, DOTTED = "\u017f", "\u0130".encode()  # the last letter of Latin Extended-A; the one that lower-cases to two signs
#: letter 1, digit 2, other sign 3; white space and all beyond ASCII 0
KINDS = np.array([0 if c >= 128 or c in b" \t\n\v\f\r" else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 for c in range(256)], np.uint8)
#: byte-level signs: printable bytes stand for themselves, the others for 256, 257, ... in order
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SLICE = 4 << 20
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- token ids


class Encoder:
    """Ids of texts, part by part, with a cache of the parts; ids are held as little-endian 32-bit words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, part: bytes) -> bytes:
        """A part of Latin letters is one pre-token, which goes straight to the merges; any other to the whole library."""
        plain = part.isascii()
        word = (part if plain else part.decode().lower().encode()).decode("latin-1")
        if part.isalpha() if plain else (word.encode("latin-1").decode().isalpha() and max(part.decode()) <= LATIN and DOTTED not in part):
            return array("I", [t.id for t in self.model.tokenize(word.lower() if plain else word.translate(BYTE_SIGNS))]).tobytes()
        return array("I", self.tokenizer.encode(part.decode(), add_special_tokens=False).ids).tobytes()

    def found(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different parts."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for p in parts:
            ids = known.get(p)
            if ids is None:
                ids = older.get(p)
                if ids is None:
                    ids = self.ids(p.strip(BLANKS))
                if len(p) <= LONGEST:
                    known[p] = ids
            out.append(ids)
        return out

    def encode(self, block: TextBlock) -> list[np.ndarray]:
        """The ids of each document."""
        data, ends = cut(block)
        starts, _ = runs_of(~SPACE[data], ends)
        if not len(starts):
            return [np.zeros(0, "<u4")] * block.n
        # each part with the white space after it, so that the parts lie back to back; equal ones are looked up once
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        ids = self.found(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        at = parts.indices.to_numpy()
        n = sizes[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        flat = flat[np.repeat(begin[at] - upto[:-1], n) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(starts, ends)].tolist()
        out = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        raw = block.bytes.tobytes()
        if SPECIAL in raw:  # nothing is lower-cased or cut in a text that may hold a special token
            where = block.offsets.tolist()
            for d, (a, b) in enumerate(zip(where[:-1], where[1:], strict=True)):
                if raw.find(SPECIAL, a, b) >= 0:
                    out[d] = np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, "<u4")
        return out


def encoder(path: str) -> Encoder:
    store = worker_cache()
    if ("encoder", path) not in store:
        store["encoder", path] = Encoder(path)
    return store["encoder", path]


def cut(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The texts with A-Z lower-cased and a blank where pre-tokens surely part, and where each text ends.

    Between two ASCII signs that is so if they are of two kinds (letter, digit, other) or both
    digits, but for an apostrophe before a letter.
    """
    low = LOWER[block.bytes]
    kind = KINDS[low]
    one, two = kind[:-1], kind[1:]
    at = np.flatnonzero((one > 0) & (two > 0) & ((one != two) | (one == 2)) & ((low[:-1] != 39) | (two != 1))) + 1
    return np.insert(low, at, 32), block.offsets + np.searchsorted(at, block.offsets, side="left")


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """row (unique), doc_id, piece, start, length and ids_crc32 of every piece, and its ids if asked for."""
    path = path or model_path()

    def make():
        from pyspark import TaskContext

        own, begun = encoder(path), TaskContext.get().partitionId() << 33
        given = 0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal given
            block = TextBlock(batch.column(1))
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for d, found in enumerate(own.encode(block)):
                flat = np.append(found, np.uint32(end))
                for k, lo in enumerate(range(0, len(flat), size)):
                    part = flat[lo : lo + size]
                    doc.append(d)
                    piece.append(k)
                    start.append(lo)
                    length.append(len(part))
                    crc.append(crc32(part))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            row = np.arange(given, given + len(doc)) + begun
            given += len(doc)
            columns = [pa.array(row), batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.record_batch(columns, names=names)

        return work

    return map_slices(texts(docs), make, PIECES + ", ids array<int>" * keep_ids, SLICE)


# ---- one block


def best_fit(bins: np.ndarray, free: list[int], items: list[int], lengths: list[int], size: int) -> None:
    """Put each of ``items`` into the fullest bin that holds it, or a new one; changes ``bins`` and ``free``."""
    at: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit f is set if a bin has f free
    for b, f in enumerate(free):
        at[f].append(b)
        some |= 1 << f
    for i in items:
        n = lengths[i]
        fits = some >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = at[f].pop()
            if not at[f]:
                some ^= 1 << f
        else:
            b, f = len(free), size
            free.append(f)
        f -= n
        bins[i], free[b] = b, f
        at[f].append(b)
        some |= 1 << f


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def fitness(bins: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    fill = np.bincount(bins, lengths)
    return -len(fill), float(((fill / size) ** 2).mean())


def refit(bins: np.ndarray, out: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """``bins`` with the pieces of ``out`` (marked) taken out and put back by best fit, longest first."""
    left = np.flatnonzero(~out)
    child = np.empty(len(bins), np.int64)
    child[left] = compact(bins[left])
    free = (size - np.bincount(child[left], lengths[left])).astype(np.int64).tolist() if len(left) else []
    moved = np.flatnonzero(out)
    best_fit(child, free, moved[np.argsort(-lengths[moved], kind="stable")].tolist(), lengths.tolist(), size)
    return child


def crossover(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Some of the fuller half of one's bins, whole; two's bins without any of their pieces; the rest by best fit."""
    fill = np.bincount(one, lengths)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    given = np.zeros(len(fill), bool)
    given[full[rng.random(len(full)) < rng.uniform(0.3, 0.9)]] = True
    injected = given[one]
    gone = np.zeros(int(two.max()) + 1, bool)
    gone[two[injected]] = True
    both = np.where(injected, one, two + len(fill))
    return refit(both, ~injected & gone[two], lengths, size)


def mutate(bins: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve a few bins, emptier ones more often."""
    fill = np.bincount(bins, lengths)
    odds = (size - fill) + 1.0
    chosen = rng.choice(len(fill), min(len(fill), 2 + len(fill) // 50), replace=False, p=odds / odds.sum())
    gone = np.zeros(len(fill), bool)
    gone[chosen] = True
    return refit(bins, gone[bins], lengths, size)


def least_bins(lengths: np.ndarray, size: int) -> int:
    """No packing has fewer bins: by the total, by the pieces that can't share one, and by both together.

    For each bound t: pieces longer than size - t share no bin with one of at least t; those
    over a half stand apart, and what pieces of t to a half exceed in their free space needs more.
    """
    best = max(-(-int(lengths.sum()) // size), int((2 * lengths > size).sum()))
    ordered = np.sort(lengths)
    sums = np.concatenate(([0], np.cumsum(ordered)))
    half = int(np.searchsorted(ordered, size // 2, side="right"))
    for t in np.unique(ordered[:half]).tolist():
        lone = int(np.searchsorted(ordered, size - t, side="right"))
        low = int(np.searchsorted(ordered, t, side="left"))
        apart = lone - half
        spare = apart * size - int(sums[lone] - sums[half])
        need = int(sums[half] - sums[low]) - spare
        best = max(best, len(ordered) - half + max(0, -(-need // size)))
    return best


def populate(lengths: np.ndarray, size: int, population: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit of the pieces, longest first, and of random orders; the first alone if it can't be better."""
    out: list[np.ndarray] = []
    for i in range(population):
        if i and int(out[0].max()) + 1 <= least_bins(lengths, size):
            break
        order = np.argsort(-lengths, kind="stable") if i == 0 else rng.permutation(len(lengths))
        bins: np.ndarray = np.empty(len(lengths), np.int64)
        best_fit(bins, [], order.tolist(), lengths.tolist(), size)
        out.append(bins)
    return out


def evolve(people: list[np.ndarray], lengths: np.ndarray, size: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best first. Each generation's child takes the place of the worst, if it is better."""
    aim = least_bins(lengths, size)
    people = sorted(people, key=lambda b: fitness(b, lengths, size), reverse=True)
    for _ in range(generations):
        if int(people[0].max()) + 1 <= aim or len(people) < 2:
            break
        two = [min(rng.integers(0, len(people), 2).tolist()) for _ in range(2)]  # the fitter of two, twice
        child = crossover(people[two[0]], people[two[1]], lengths, size, rng)
        if rng.random() < 0.5:
            child = mutate(child, lengths, size, rng)
        if fitness(child, lengths, size) > fitness(people[-1], lengths, size):
            people[-1] = child
            people.sort(key=lambda b: fitness(b, lengths, size), reverse=True)
    return people


# ---- all blocks


STATE = "block long, island int, rows array<long>, lengths array<int>, people array<array<int>>, done boolean"


def _list(row: pa.Array, kind=np.int64) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False).astype(kind)


def _step(state: DataFrame, size: int, population: int, generations: int, epoch: int, level: int) -> DataFrame:
    """One epoch of every island; ``people`` may be empty at first, ``guest`` is the neighbour's best genome."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, island = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                lengths = _list(batch.column(3)[r])
                rng = np.random.default_rng([level, epoch, block, island])
                held = [_list(p) for p in batch.column(4)[r].values] if batch.column(4)[r].is_valid else []
                guest = batch.column(5)[r]
                if not held:
                    held = populate(lengths, size, population, rng)
                elif guest.is_valid:
                    held[-1] = _list(guest)
                people = evolve(held, lengths, size, generations, rng)
                done = int(people[0].max()) + 1 <= least_bins(lengths, size)
                people = people[:1] if done else people
                columns = [pa.array([block]), pa.array([island], pa.int32()), batch.column(2).slice(r, 1), batch.column(3).slice(r, 1), pa.array([[p.astype(np.int32) for p in people]], pa.list_(pa.list_(pa.int32()))), pa.array([done])]
                yield pa.record_batch(columns, names=["block", "island", "rows", "lengths", "people", "done"])

    return state.select("block", "island", "rows", "lengths", "people", "guest").mapInArrow(run, STATE)


def _best(state: DataFrame) -> DataFrame:
    """The best genome of each block over its islands: block, rows, lengths, bins."""
    worth = F.struct(-F.array_max(F.col("people")[0]), -F.col("island"))
    return state.groupBy("block").agg(F.max_by(F.struct("rows", "lengths", F.col("people")[0].alias("bins")), worth).alias("b")).select("block", "b.*")


def _solve(items: DataFrame, blocks: int, size: int, islands: int, population: int, epochs: int, generations: int, level: int) -> DataFrame:
    """row, length, block, bin, fill, offset of every item (row, length), packed block by block."""
    dealt = items.groupBy(F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "length"))).alias("x"))
    state = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.row").alias("rows"), F.transform("x.length", lambda n: n.cast("int")).alias("lengths"))
    state = state.withColumns({"people": F.lit(None).cast("array<array<int>>"), "guest": F.lit(None).cast("array<int>")})
    finished = []
    for epoch in range(epochs):
        state = materialize(_step(state, size, population, generations, epoch, level), f"islands-{level}-{epoch}")
        # a block is through as soon as one island has as few bins as can be
        through = state.groupBy("block").agg(F.max("done").alias("through"))
        state = state.join(through, "block")
        finished.append(_best(state if epoch == epochs - 1 else state.where("through")))
        state = state.where(~F.col("through"))
        if epoch == epochs - 1 or state.limit(1).count() == 0:
            break
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("people")[0].alias("guest"))
        state = state.join(guests, ["block", "island"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                rows, lengths, bins = (_list(batch.column(i)[r]) for i in (1, 2, 3))
                order = np.argsort(bins, kind="stable")  # rows rise within a bin
                rows, lengths, bins = rows[order], lengths[order], bins[order]
                ends = np.cumsum(lengths)
                fill = np.bincount(bins, lengths).astype(np.int64)
                begin = np.concatenate(([0], np.cumsum(fill)))[bins]
                yield pa.record_batch([pa.array(rows), pa.array(lengths), pa.array([batch.column(0)[r].as_py()] * len(rows), pa.int64()), pa.array(bins), pa.array(fill[bins]), pa.array(ends - lengths - begin)], names=["row", "length", "block", "bin", "fill", "offset"])

    return reduce(DataFrame.unionByName, finished).mapInArrow(run, "row long, length long, block long, bin long, fill long, offset long")


def place(found: DataFrame, size: int = SIZE, block: int = BLOCK, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS, full: float = FULL, levels: int = LEVELS) -> DataFrame:
    """row, sequence_id, offset of all pieces; ``found`` (row, length, ...) should be a written table."""
    whole = found.where(F.col("length") >= size).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items, parts = found.where(F.col("length") < size).select("row", "length"), [whole]
    n = items.count()
    for level in range(levels):
        if not n:
            break
        blocks = -(-n // block)
        packed = materialize(_solve(items, blocks, size, islands, population, epochs, generations, level), f"packed-{level}")
        named = packed.withColumn("sequence_id", F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft("block", 20) + F.col("bin"))
        rest = packed.where(F.col("fill") < full * size).select("row", "length")
        left = rest.count() if blocks > 1 and level < levels - 1 else 0
        if left and -(-left // block) < blocks:
            parts.append(named.where(F.col("fill") >= full * size).select("row", "sequence_id", "offset"))
            items, n = rest, left
        else:
            parts.append(named.select("row", "sequence_id", "offset"))
            break
    return reduce(DataFrame.unionByName, parts)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, keep_ids: bool = False, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its ids if asked for."""
    found = materialize(pieces(docs, path, size, keep_ids=keep_ids), "pieces")
    return found.join(place(found, size, **options), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from ``pack`` with ids; a group has at most a sequence's tokens."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
