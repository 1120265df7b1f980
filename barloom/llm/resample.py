"""Importance resampling towards a target's n-gram distribution (operator 11).

Features of a text are all runs of 1 to ``n`` consecutive words, joined by one blank; a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``. One scan per document keeps
a ring of running CRC states, one for each of the last ``n`` places where a run can begin:
a new word extends every state by a blank and itself, so no run is ever built as a string.
The scan writes each document's buckets with their counts (at most ``buckets`` pairs,
however long the text). Bucket totals of the corpus and of the target give every bucket a
gain; a document's weight is the sum of its features' gains, its score adds Gumbel noise
from a hash of its id, and the highest scores are drawn: sampling without replacement in
proportion to the exponent of the weight.

The ranking is one range sort of small rows over (score, doc_id, row): rows are told apart,
so rows that repeat never fall into one task; a row's rank is its place in its partition
and the count of all partitions before it.

Defined cases: a null text has no words, so weight 0; documents of fewer than
``least_words`` words are never drawn; a null doc_id is hashed as an empty string and comes
after all others of its score; equal rows each get a rank, in any order among themselves;
an empty table gives an empty one; without target texts every gain is taken with T and t
of 0. A very long text is one task's work, cut into pieces of ``PIECE`` bytes at a
word's end. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, TextBlock, map_slices, materialize, texts

N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
PIECE = 1 << 20
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: A-Z to a-z, every byte that is no part of a word to a blank
FOLD = bytes(b if (b := int(LOWER[i])) in _WORD else 32 for i in range(256))
FEATURES = "row long, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"


def word_pieces(data: bytes, piece: int = PIECE):
    """Words of a text, a list for each piece of about ``piece`` bytes."""
    folded = data.translate(FOLD)
    begin = 0
    while begin < len(folded):
        end = folded.find(b" ", begin + piece) if begin + piece < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[begin:end].split()
        begin = end


class Ring:
    """Running CRC states of the runs that begin at the last ``n`` words, longest run first."""

    def __init__(self, n: int):
        self.n, self.states = n, []

    def feed(self, words: list[bytes]) -> list[int]:
        """CRCs of all runs that end at one of ``words``."""
        n, states, out = self.n, self.states, []
        for word in words:
            if n > 1:
                spaced = b" " + word
                states = [crc32(spaced, s) for s in states[1 - n :]]
                states.append(crc32(word))
                out += states
            else:
                out.append(crc32(word))
        self.states = states
        return out


def counted(data: bytes, n: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, buckets in order and their counts of one text."""
    ring, words, runs = Ring(n), 0, 0
    held, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in word_pieces(data):
        found = np.array(ring.feed(part), np.int64) % buckets
        words, runs = words + len(part), runs + len(found)
        keys, back = np.unique(np.concatenate([held, found]), return_inverse=True)
        held, times = keys, np.bincount(back, np.concatenate([times, np.ones(len(found), np.int64)]), len(keys)).astype(np.int64)
    return words, runs, held, times


def features(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features and the buckets of a text's features with their counts.

    Needs the columns doc_id, text and row.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            block = TextBlock(batch.column(1))
            data, ends = block.bytes.tobytes(), block.offsets.tolist()
            words, runs, held, times = zip(*(counted(data[a:b], n, buckets) for a, b in zip(ends[:-1], ends[1:], strict=True)), strict=True)
            edges = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in held]))), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x), kind)) for x, kind in ((held, pa.int32()), (times, pa.int64()))]
            return pa.record_batch([batch.column(2), batch.column(0), pa.array(words, pa.int64()), pa.array(runs, pa.int64()), *lists], names=["row", "doc_id", "n_words", "n_features", "buckets", "counts"])

        return work

    return map_slices(docs, make, FEATURES)


def totals(found: DataFrame) -> DataFrame:
    """(bucket, n) over all documents; sums are made where the rows lie before ``buckets`` rows a task are shuffled."""
    return found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; what reaches the driver is at most ``buckets`` rows of each side."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, found in ((s, corpus), (t, target)):
        for r in totals(found).collect():
            into[r.bucket] = r.n
    big_s, big_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (big_s + buckets)) / float((a + 1) * (big_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, doc_id, n_words, n_features, weight."""

    def run(batches):
        for batch in batches:
            held, times = batch.column(4), batch.column(5)
            edges = held.offsets.to_numpy()
            each = np.zeros(edges[-1] - edges[0] + 1, np.int64)
            np.cumsum(gain[held.flatten().to_numpy()] * times.flatten().to_numpy(), out=each[1:])
            weight = each[edges[1:] - edges[0]] - each[edges[:-1] - edges[0]]
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(weight)], names=["row", "doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """``rows`` (score, doc_id, row, ...) with ``rank`` by falling score, then rising doc_id; null beyond ``draw``."""
    ordered = rows.repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    # the id is the partition's number times 2^33 and the row's place in it
    placed = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row for each partition
    rank = F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1
    return placed.join(F.broadcast(starts), "__part").withColumn("rank", F.when(rank <= draw, rank)).drop("__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``target`` has a column text."""
    numbered = texts(docs).withColumn("row", F.monotonically_increasing_id())
    found = materialize(features(numbered, n, buckets), "features")
    aim = features(texts(target.select(F.lit(None).cast("long").alias("doc_id"), "text")).withColumn("row", F.lit(0).cast("long")), n, buckets)
    rows = weighted(found, gains(found, aim, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    rows = rows.withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= least_words
    draw = percent * found.where(able).count() // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked(rows.where(able), draw).select(*columns).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))
