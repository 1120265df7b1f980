"""Brown class-based bigram scores (operator 4).

1. Counts of all words come from all training documents: combined in each worker, then
   summed by word. The ``HEAD`` most frequent words travel to the workers.
2. Exchange clustering starts with the ``MOVED`` most frequent words: from a round-robin
   assignment to ``CLASSES`` classes each is moved to the class that raises the class-bigram
   likelihood most, until a round moves none or ``ROUNDS`` are over. The input is one matrix
   of bigram counts of all training text.
3. Every other word goes to the class that raises the same likelihood most, given how often
   each class stands before and after it in all training text: first the other words of
   the head, then all that remain (the tail), each in one distributed pass. No word keeps a
   class by its form.
4. Documents become byte strings, a class for each token. Tail tokens wait as 255 until the
   pass over the tail, which is shuffled by word once, has given each its class and count.
5. Class transitions are counted over those of the training documents, then all are scored.

log10 p(text) = sum of log10 p(class | class before) + log10 p(word | class). Transitions
are interpolated with the class frequencies, emissions are (c + 0.5) / (N_class + 0.5 *
(V_class + 1)): each class keeps room for a word that training has not shown. Such a word
has the sum over all classes of that room; what follows it starts from the classes' shares
of the room. So the probabilities of all training words, the end and one unknown word sum
to 1 after any token. Words are compared by 64-bit hashes of their bytes.

Defined cases: a null text counts as empty; an empty text is its end token alone; a null
doc_id is training text; without training text N and V are 0 and scores stay finite; equal
rows each appear and count; ties between classes go to the lower one. A very long text is
one row (a byte a token). Other columns of the input are ignored, whatever their names. A
tail word is in one task: none has more tokens than any of the HEAD words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, TextBlock, map_slices, materialize, received, send, slices, span_hashes, texts

HEAD, MOVED, CLASSES, ROUNDS, PULL = 100_000, 1_500, 64, 10, 10.0
END = np.uint64(0x5EED0FE11D)
OPEN = 255  # a token without a class yet; after the pass over the tail: a word that training has not shown


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def words_of(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word of the block, in order."""
    starts, ends = block.runs(~SPACE[block.bytes])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return span_hashes(LOWER[block.bytes], starts, ends), block.owner(starts)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, is_end, n) over all training texts."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            block = TextBlock(batch.column(1))
            found, n = np.unique(words_of(block)[0], return_counts=True)
            return pa.record_batch(
                [pa.array(np.append(found, END).view(np.int64)), pa.array(np.append(np.zeros(len(found), bool), True)), pa.array(np.append(n, block.n).astype(np.int64))],
                names=["word", "is_end", "n"],
            )

        return work

    return map_slices(training, make, "word long, is_end boolean, n long").groupBy("word", "is_end").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Head:
    """The most frequent words, by rising hash; rank: place by falling count."""

    words: np.ndarray
    counts: np.ndarray
    rank: np.ndarray

    def find(self, words: np.ndarray) -> np.ndarray:
        """Index of each word, -1 where it is not in the head."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def head_of(counts: DataFrame, head: int = HEAD) -> Head:
    top = counts.where("not is_end").orderBy(F.desc("n"), "word").limit(head).toArrow()
    words, n = (top.column(c).to_numpy() for c in ("word", "n"))
    order = np.lexsort((words, -n))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = words.astype(np.int64).view(np.uint64)
    by_hash = np.argsort(words)
    return Head(words[by_hash], n[by_hash].astype(np.int64), rank[by_hash])


def chain_of(head: Head, symbols: np.ndarray, other: int, end: int, block: TextBlock) -> tuple[np.ndarray, ...]:
    """For all tokens with ends: document, symbol, head index (-1: tail, -2: end) and hash. ``symbols`` are those of the head's words."""
    words, doc = words_of(block)
    at = head.find(words)
    n = np.bincount(doc, minlength=block.n)
    place = np.arange(len(words)) + doc  # each document before leaves one end token
    total = len(words) + block.n
    chain, index, hashes = np.full(total, end), np.full(total, -2), np.zeros(total, np.uint64)
    chain[place] = np.where(at >= 0, symbols[at], other) if len(symbols) else other
    index[place], hashes[place] = at, words
    return np.repeat(np.arange(block.n), n + 1), chain, index, hashes


def before_of(chain: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate(([end], chain[:-1]))  # what follows an end follows the border


def pair_counts(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], size: int, column: str = "text") -> np.ndarray:
    """size x size counts of the codes (before * size + after) that ``make()`` finds in each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, column=column):
                pair, n = np.unique(work(batch), return_counts=True)
                yield pa.record_batch([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    found = rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def bigrams(training: DataFrame, head: Head, moved: int) -> np.ndarray:
    """Counts of (symbol before, symbol) over all training text: the moved words, then all others as one, then the border."""
    symbols = np.where(head.rank < moved, head.rank, moved)
    sent = send(training.sparkSession, (head, symbols))

    def make():
        own, codes = received(sent)

        def work(batch: pa.RecordBatch) -> np.ndarray:
            _, chain, _, _ = chain_of(own, codes, moved, moved + 1, TextBlock(batch.column(1)))
            return before_of(chain, moved + 1) * (moved + 2) + chain

        return work

    return pair_counts(training, make, moved + 2)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, moved: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol: the first ``moved`` are exchanged between ``classes``, the others keep one of their own."""
    size = len(counts)
    of = np.concatenate((np.arange(moved) % classes, classes + np.arange(size - moved)))
    total = classes + size - moved
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    table = member.T @ counts @ member
    rows, cols = counts @ member, counts.T @ member  # of each symbol: by the class after it, by the class before it
    k = np.arange(classes)
    for _ in range(rounds):
        changed = 0
        for w in range(moved):
            own, itself = of[w], counts[w, w]
            after, ahead = rows[w].copy(), cols[w].copy()
            after[own] -= itself
            ahead[own] -= itself
            if not (after.any() or ahead.any() or itself):
                continue
            table[own] -= after
            table[:, own] -= ahead
            table[own, own] -= itself
            left, right = table.sum(axis=1), table.sum(axis=0)
            out_row, in_col = table[:classes], table[:, :classes].T
            some, same = np.flatnonzero(after), np.flatnonzero(ahead)
            gain = (_xlogx(out_row[:, some] + after[some]) - _xlogx(out_row[:, some])).sum(axis=1)
            gain += (_xlogx(in_col[:, same] + ahead[same]) - _xlogx(in_col[:, same])).sum(axis=1)
            both = table[k, k]
            gain -= _xlogx(both + after[k]) + _xlogx(both + ahead[k]) - 2 * _xlogx(both)
            gain += _xlogx(both + after[k] + ahead[k] + itself) - _xlogx(both)
            n_left, n_right = after.sum() + itself, ahead.sum() + itself
            gain -= _xlogx(left[k] + n_left) - _xlogx(left[k]) + _xlogx(right[k] + n_right) - _xlogx(right[k])
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += after
            table[:, best] += ahead
            table[best, best] += itself
            if best != own:
                changed += 1
                of[w] = best
                rows[:, own] -= counts[:, w]
                rows[:, best] += counts[:, w]
                cols[:, own] -= counts[w]
                cols[:, best] += counts[w]
        if not changed:
            break
    return of


@dataclass(frozen=True)
class Gains:
    """What a word adds to the class-bigram likelihood by joining a class, from a table of class bigrams.

    The table has one row and column more than classes for words without one yet, and one for the border.
    """

    table: np.ndarray
    classes: int

    def best(self, word: np.ndarray, side: np.ndarray, near: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Best class of words 0, 1, ...; rows (sorted by word) say how often class ``near`` stands before (0) or after (1) it."""
        both = np.stack([self.table[:, : self.classes], self.table[: self.classes].T])
        plain = _xlogx(both)
        few = [(_xlogx(both + k) - plain).astype(np.float32) for k in range(1, 4)]
        words = int(word[-1]) + 1
        gain = np.zeros((words, self.classes), np.float32)
        for lo in range(0, len(word), 1 << 16):
            w, s, c, k = (x[lo : lo + (1 << 16)] for x in (word, side, near, n))
            part = np.empty((len(w), self.classes), np.float32)
            for m, known in enumerate(few, 1):
                part[k == m] = known[s[k == m], c[k == m]]
            many = k > len(few)
            part[many] = _xlogx(both[s[many], c[many]] + k[many, None]) - plain[s[many], c[many]]
            begin = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            gain[w[begin]] += np.add.reduceat(part, begin, axis=0)
        for s, margin in ((0, self.table.sum(axis=0)), (1, self.table.sum(axis=1))):
            total = np.bincount(word, n * (side == s), minlength=words)
            margin = margin[: self.classes]
            gain -= (_xlogx(margin + total[:, None]) - _xlogx(margin)).astype(np.float32)
        return gain.argmax(axis=1)


def place_head(training: DataFrame, head: Head, core: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """Class of every word of the head: the exchanged ones keep theirs (``core``, by rank), the others take the best."""
    moved = len(core)
    symbols = np.where(head.rank < moved, core[np.minimum(head.rank, moved - 1)] if moved else 0, classes)
    if len(head.words) <= moved:
        return symbols
    sent = send(training.sparkSession, (head, symbols))
    size = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = received(sent)
        for whole in batches:
            for batch in slices(whole):
                _, chain, index, _ = chain_of(own, codes, classes, classes + 1, TextBlock(batch.column(1)))
                before, after = before_of(chain, classes + 1), np.append(chain[1:], classes + 1)
                at = np.flatnonzero((index >= 0) & (chain == classes))
                code, n = np.unique(np.concatenate([(index[at] * 2 + side) * size + near[at] for side, near in ((0, before), (1, after))]), return_counts=True)
                yield pa.record_batch([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    counted = training.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = counted.select(F.expr(f"code div {2 * size}").alias("word"), "code", "n")
    gains = send(training.sparkSession, Gains(table, classes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = received(gains)
        for word, code, n in whole_words(batches):
            names, each = np.unique(word, return_inverse=True)
            best = held.best(each, code // size % 2, code % size, n)
            yield pa.record_batch([pa.array(names), pa.array(best.astype(np.int64))], names=["word", "cls"])

    placed = counted.repartition("word").sortWithinPartitions("word", "code").mapInArrow(place, "word long, cls long").toArrow()
    symbols = symbols.copy()
    symbols[placed.column("word").to_numpy()] = placed.column("cls").to_numpy()
    return symbols


def whole_words(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Columns of some batches that are sorted by their first column, cut so that equal values stay together."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= rows:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held, size = [[c[cut:] for c in columns]], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


_SEQUENCE = "uid long, doc_id long, train boolean, seq binary, known double, n_known long, tail array<long>, at binary"


def sequences(rows: DataFrame, head: Head, symbols: np.ndarray, classes: int) -> DataFrame:
    """One row per document: a class for each token, and which tail words its open tokens are."""
    sent = send(rows.sparkSession, (head, symbols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = received(sent)
        logs = np.log10(own.counts + 0.5)
        for whole in batches:
            for batch in slices(whole):
                block = TextBlock(batch.column(3))
                owner, chain, index, hashes = chain_of(own, codes, OPEN, classes, block)
                known = np.where(index >= 0, logs[np.maximum(index, 0)] if len(logs) else 0.0, 0.0)
                rare = np.flatnonzero(index == -1)
                order = rare[np.lexsort((hashes[rare], owner[rare]))]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
                first = order[np.flatnonzero(fresh)]
                per_doc = np.bincount(owner[first], minlength=block.n)
                offsets = np.concatenate(([0], np.cumsum(per_doc)))
                nth = np.empty(len(chain), np.int64)
                nth[order] = np.cumsum(fresh) - 1 - offsets[owner[order]]
                ends = np.searchsorted(owner, np.arange(block.n + 1))
                opens = np.searchsorted(rare, ends)
                flat, at = chain.astype(np.uint8), nth[rare].astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0), batch.column(1), batch.column(2), _binary(flat, ends), pa.array(np.bincount(owner, known, minlength=block.n)),
                        pa.array(np.bincount(owner[index >= 0], minlength=block.n).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[first].view(np.int64))), _binary(at.view(np.uint8), opens * 4),
                    ],
                    names=["uid", "doc_id", "train", "seq", "known", "n_known", "tail", "at"],
                )

    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (~held_out()).alias("train"), "text").mapInArrow(run, _SEQUENCE)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _chains(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes of a binary column and its offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def class_bigrams(seqs: DataFrame, classes: int, size: int) -> np.ndarray:
    """Class bigrams of the training documents. With size = classes + 2 open tokens are the class before the border."""
    border = size - 1

    def make():
        codes = np.arange(256)
        codes[classes], codes[OPEN] = border, classes

        def work(batch: pa.RecordBatch) -> np.ndarray:
            flat, _ = _chains(batch.column(0))
            chain = codes[flat]
            return before_of(chain, border) * size + chain

        return work

    return pair_counts(seqs.where("train").select("seq"), make, size, "seq")


def place_tail(seqs: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """(uid, j, cls, n, fresh): class and training count of each document's j-th tail word (OPEN and 0: not in training).

    Every tail token goes to the task of its word once, with the classes beside it; ``fresh``
    marks one row of each training word.
    """
    gains = send(seqs.sparkSession, Gains(table, classes))
    other, border = classes, classes + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.arange(256)
        codes[classes], codes[OPEN] = border, other
        for whole in batches:
            for batch in slices(whole, column="seq"):
                flat, offsets = _chains(batch.column(2))
                at = np.flatnonzero(flat == OPEN)
                if not len(at):
                    continue
                chain = codes[flat]
                before, after = before_of(chain, border)[at], chain[at + 1]
                doc = np.searchsorted(offsets, at, side="right") - 1
                nth = _chains(batch.column(4))[0].view(np.int32).astype(np.int64)
                lists = batch.column(3)
                begin = lists.offsets.to_numpy().astype(np.int64)
                words = lists.values.to_numpy()[begin[doc] + nth]
                uid, train = batch.column(0).to_numpy()[doc], batch.column(1).to_numpy(zero_copy_only=False)[doc]
                yield pa.record_batch([pa.array(words), pa.array(uid), pa.array(nth.astype(np.int32)), pa.array((before * 256 + after).astype(np.int32)), pa.array(train)], names=["word", "uid", "j", "near", "train"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = received(gains)
        for word, uid, j, near, train in whole_words(batches):
            _, each = np.unique(word, return_inverse=True)
            n = np.bincount(each, train)
            cls = np.full(len(n), OPEN)
            t = np.flatnonzero(train)
            if len(t):
                code, times = np.unique(np.concatenate([(each[t] * 2 + side) * 256 + beside for side, beside in ((0, near[t] >> 8), (1, near[t] & 255))]), return_counts=True)
                some = np.flatnonzero(n)
                small = np.empty(len(n), np.int64)
                small[some] = np.arange(len(some))
                cls[some] = held.best(small[code >> 9], code >> 8 & 1, code & 255, times)
            order = np.lexsort((j, uid, each))
            one = np.ones(len(order), bool)
            one[1:] = (each[order[1:]] != each[order[:-1]]) | (uid[order[1:]] != uid[order[:-1]])
            keep = order[one]
            fresh = np.concatenate(([True], each[keep[1:]] != each[keep[:-1]])) & (n[each[keep]] > 0)
            yield pa.record_batch([pa.array(uid[keep]), pa.array(j[keep]), pa.array(cls[each[keep]].astype(np.int32)), pa.array(n[each[keep]].astype(np.int64)), pa.array(fresh)], names=["uid", "j", "cls", "n", "fresh"])

    tokens = seqs.where(F.size("tail") > 0).select("uid", "train", "seq", "tail", "at").mapInArrow(cut, "word long, uid long, j int, near int, train boolean")
    return tokens.repartition("word").sortWithinPartitions("word").mapInArrow(place, "uid long, j int, cls int, n long, fresh boolean")


def fill(seqs: DataFrame, tail: DataFrame) -> DataFrame:
    """The documents' sequences without open tokens but for unknown words, and their sums of log counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column="seq"):
                flat, offsets = _chains(batch.column(3))
                flat = flat.copy()
                at = np.flatnonzero(flat == OPEN)
                doc = np.searchsorted(offsets, at, side="right") - 1
                docs = batch.num_rows
                if len(at):
                    nth = _chains(batch.column(6))[0].view(np.int32)
                    pairs = batch.column(7)
                    begin = pairs.offsets.to_numpy().astype(np.int64)
                    cls, n = (pairs.values.field(i).to_numpy()[begin[doc] + nth] for i in (1, 2))
                    flat[at] = cls
                    more, met, new = np.bincount(doc, np.log10(n + 0.5), minlength=docs), np.bincount(doc[n > 0], minlength=docs), np.bincount(doc[n == 0], minlength=docs)
                else:
                    more, met, new = np.zeros(docs), np.zeros(docs, np.int64), np.zeros(docs, np.int64)
                known, n_known = (batch.column(i).to_numpy() for i in (4, 5))
                yield pa.record_batch(
                    [batch.column(1), batch.column(2), pa.array(np.diff(offsets)), pa.array(n_known + met), pa.array(new.astype(np.int64)), pa.array(known + more), _binary(flat, offsets)],
                    names=["doc_id", "train", "n_tokens", "n_known", "n_new", "logs", "seq"],
                )

    lists = tail.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("j", "cls", "n"))).alias("x"))
    rows = seqs.drop("tail").join(lists, "uid", "left").select("uid", "doc_id", "train", "seq", "known", "n_known", "at", "x")
    return rows.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, n_new long, logs double, seq binary")


@dataclass(frozen=True)
class ClassModel:
    move: np.ndarray  # log10 p(class | class before); the last class is the border, the last row what follows an unknown word
    room: np.ndarray  # log10 of each class's emission denominator
    new: np.ndarray  # log10 p(unknown word | class before)
    tokens: int
    types: int
    ends: int

    @property
    def base_room(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.types + 1)))


def model_of(table: np.ndarray, mass: np.ndarray, types: np.ndarray, tokens: int, vocabulary: int, ends: int) -> ClassModel:
    """From class bigrams and each class's tokens and types (border included)."""
    size = len(table)
    often = table.sum(axis=0)
    share = (often + 0.5) / (often.sum() + 0.5 * size)
    move = (table + PULL * share) / (table.sum(axis=1, keepdims=True) + PULL)
    wide = mass + 0.5 * (types + 1)
    new = move @ (0.5 / wide)
    weight = share * 0.5 / wide
    after = (weight / weight.sum()) @ move
    return ClassModel(np.log10(np.vstack([move, after])), np.log10(wide), np.log10(np.append(new, after @ (0.5 / wide))), tokens, vocabulary, ends)


def learn(rows: DataFrame, head: int = HEAD, moved: int = MOVED, classes: int = CLASSES) -> tuple[ClassModel, DataFrame]:
    """The model, and the written class sequences of all documents."""
    training = rows.where(~held_out())
    counts = materialize(word_counts(training), "word-counts")
    totals = {r["is_end"]: (r["n"], r["v"]) for r in counts.groupBy("is_end").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    top = head_of(counts, head)
    moved = min(moved, len(top.words))
    pairs = bigrams(training, top, moved)
    core = exchange(pairs, moved, classes)
    member = np.zeros((len(pairs), classes + 2))
    member[np.arange(len(pairs)), core] = 1
    symbols = place_head(training, top, core[:moved], member.T @ pairs @ member, classes)
    seqs = materialize(sequences(rows, top, symbols, classes), "sequences")
    tail = materialize(place_tail(seqs, class_bigrams(seqs, classes, classes + 2), classes), "tail-words")
    filled = materialize(fill(seqs, tail), "filled")
    mass, types = np.zeros(classes + 1), np.zeros(classes + 1)
    np.add.at(mass, symbols, top.counts)
    np.add.at(types, symbols, 1)
    for r in tail.where("fresh").groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r["cls"]] += r["n"]
        types[r["cls"]] += r["v"]
    ends = int(totals.get(True, (0, 0))[0])
    mass[classes], types[classes] = ends, int(ends > 0)
    # without training text the end, too, is a word that training has not shown, but it still ends every text
    table = class_bigrams(filled, classes, classes + 2)[:, [*range(classes), classes + 1]][[*range(classes), classes + 1]]
    return model_of(table, mass, types, int(sum(n for n, _ in totals.values())), int(sum(v for n, v in totals.values() if n)), ends), filled


def score(docs: DataFrame, head: int = HEAD, moved: int = MOVED, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row per document."""
    model, filled = learn(texts(docs), head, moved, classes)
    sent = send(docs.sparkSession, model)
    end, border = float(np.log10(model.ends + 0.5)), classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(sent)
        for whole in batches:
            for batch in slices(whole, column="seq"):
                flat, offsets = _chains(batch.column(5))
                owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                chain = np.where(flat == OPEN, border + 1, flat).astype(np.int64)
                before = before_of(chain, border)
                new = chain > border
                at = np.minimum(chain, border)
                step = np.where(new, m.new[before], m.move[before, at] - m.room[at])
                n, n_new, logs = (batch.column(i).to_numpy() for i in (1, 3, 4))
                logs = logs + end
                base = logs - n * m.base_room
                total = logs - n_new * np.log10(0.5) + np.bincount(owner, step, minlength=batch.num_rows)
                n_known = batch.column(2).to_numpy() + int(m.ends > 0)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_known), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = filled.select("doc_id", "n_tokens", "n_known", "n_new", "logs", "seq").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
