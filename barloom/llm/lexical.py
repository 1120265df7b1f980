"""Ranked lexical search by MaxScore (operator 12).

Terms are runs of letters, digits and signs beyond ASCII, A-Z lower-cased. One scan of the
texts builds an inverted index for each shard, a slice of about ``SHARD`` bytes of text:
for every term of the queries the documents that hold it, in order, with their counts, and
the length of every document. From the index come the collection's counts (documents,
terms, document frequencies), and from these each posting's share of a score, in 64-bit
integers.

A task goes through its shards with the best ``k`` results of each query so far. In a
shard, a query's terms are ordered by their upper bounds, the largest share that any
posting of theirs gives there. The longest run of smallest bounds whose sum stays below the
score of the ``k``-th result is non-essential: a document that holds only these can't enter.
All postings of essential terms are added up; the non-essential ones are then probed by
binary search, largest bound first, for those documents only that can still reach the
threshold, which rises with the partial scores themselves. A document that could only tie is
kept, since its id may decide. The tasks' results, ``k`` a query at most, are merged by rank.

Queries come in blocks of bounded text (``BLOCK_BYTES``), a pass for each block.

Defined cases: a null text has no term, counts for neither N nor L and is never found; a query
without terms has no rows; rows of one item_id are one query; equal rows each have a rank;
of equal scores the smaller doc_id comes first, a null one last; a null item_id is a query
like any other; an empty table gives an empty one. A very long text is one shard. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, TextBlock, map_slices, materialize, texts

K = 50
B_TENTHS = 50  # percent of the length norm
SHARD = 4 << 20
BLOCK_BYTES = 8 << 20
SALTS = 32
_LAST = np.iinfo(np.int64).max
_TERM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: A-Z to a-z, every byte that is no part of a term to a blank
FOLD = bytes(b if (b := int(LOWER[i])) in _TERM else 32 for i in range(256))
SHARDS = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<int>, dfs array<long>, posts array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def query_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes], list[np.ndarray]]]:
    """Item ids, the block's vocabulary and each item's terms as places in it; one block at a time on the driver."""
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-int(total) // block_bytes) or 1
    for i in range(blocks):
        own: dict[int | None, set[bytes]] = {}
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect():
            own.setdefault(item, set()).update(terms_of(text))
        words = sorted(set().union(*own.values()))
        place = {w: i for i, w in enumerate(words)}
        ids = sorted(own, key=lambda x: (x is None, x or 0))
        yield ids, words, [np.array(sorted(place[w] for w in own[x]), np.int64) for x in ids]


def index(docs: DataFrame, words: list[bytes], shard: int = SHARD) -> DataFrame:
    """One row for each shard: its documents with at least one term, and the postings of ``words`` in them, term by term."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        find = {w: i for i, w in enumerate(sent.value)}.get

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            block = TextBlock(batch.column(1))
            data, ends = block.bytes.tobytes().translate(FOLD), block.offsets.tolist()
            sizes = np.zeros(block.n, np.int64)
            found, counts = [], np.zeros(block.n, np.int64)
            for d in range(block.n):
                terms = data[ends[d] : ends[d + 1]].split()
                sizes[d] = len(terms)
                met = [i for i in map(find, terms) if i is not None]
                counts[d] = len(met)
                found += met
            kept = np.flatnonzero(sizes)
            if not len(kept):
                return None
            place = np.cumsum(sizes > 0) - 1
            key, tf = np.unique(np.array(found, np.int64) * len(kept) + np.repeat(place, counts), return_counts=True)
            term, post = np.divmod(key, len(kept))
            terms, df = np.unique(term, return_counts=True)
            lists = [(batch.column(0).take(pa.array(kept)), pa.int64()), (sizes[kept], pa.int64()), (terms, pa.int32()), (df, pa.int64()), (post, pa.int32()), (tf, pa.int32())]
            columns = [pa.array([len(kept)]), pa.array([int(sizes.sum())])]
            columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind)) for x, kind in lists]
            return pa.record_batch(columns, names=["n_docs", "n_terms", "ids", "sizes", "terms", "dfs", "posts", "tfs"])

        return work

    return map_slices(texts(docs), make, SHARDS, shard)


def norms(sizes: np.ndarray, n_docs: int, n_terms: int, b: int = B_TENTHS) -> np.ndarray:
    """100 - b + (b * n * N) div L of each document; through Python's integers where 64 bits don't hold it."""
    if len(sizes) and int(sizes.max()) * b * n_docs >= 2**63:
        return np.array([100 - b + (b * n * n_docs) // n_terms for n in sizes.tolist()], np.int64)
    return 100 - b + (b * sizes * n_docs) // max(n_terms, 1)


def top_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


class Results:
    """The best ``k`` (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this can't enter; nor can one of zero."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        self.score, self.ids = top_of(np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), self.k)


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray, n: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that reach ``least``, and their scores; ``lists`` are (documents, shares) by rising bound."""
    reach = np.cumsum(bounds)  # what a document can get from a list and all before it
    first = int(np.searchsorted(reach, least, side="left"))  # lists before it are non-essential
    acc = np.zeros(n, np.int64)
    for docs, shares in lists[first:]:
        acc[docs] += shares
    live = np.flatnonzero(acc)
    for j in range(first - 1, -1, -1):
        if len(live) > k:  # k documents have at least this much already
            least = max(least, int(np.partition(acc[live], len(live) - k)[len(live) - k]))
        live = live[acc[live] + reach[j] >= least]
        if not len(live):
            break
        docs, shares = lists[j]
        at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
        hit = docs[at] == live
        acc[live[hit]] += shares[at[hit]]
    live = live[acc[live] >= max(least, 1)]
    return live, acc[live]


def search(docs: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query with a score above 0."""
    parts = [_search_block(docs, *block, k, shard) for block in query_blocks(queries, block_bytes)]
    return reduce(DataFrame.unionByName, parts)


def _search_block(docs: DataFrame, items: list, words: list[bytes], own: list[np.ndarray], k: int, shard: int) -> DataFrame:
    shards = materialize(index(docs, words, shard), "shards")
    n_docs, n_terms = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = np.zeros(len(words), np.int64)
    for r in shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect():  # at most a row for each word of the block
        df[r.terms] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((items, own, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own, weight = sent.value
        best = [Results(k) for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, terms, dfs, posts, tfs = (batch.column(i)[r].values for i in range(2, 8))
                ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
                sizes, terms, dfs, posts, tfs = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (sizes, terms, dfs, posts, tfs))
                if not len(terms):
                    continue
                shares = np.repeat(weight[terms], dfs) * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * norms(sizes, n_docs, n_terms)[posts]))
                ends = np.cumsum(dfs)
                bounds = np.maximum.reduceat(shares, ends - dfs)
                lists = [(posts[b - n : b], shares[b - n : b]) for b, n in zip(ends.tolist(), dfs.tolist(), strict=True)]
                at = np.full(len(weight), -1)
                at[terms] = np.arange(len(terms))
                for query, results in zip(own, best, strict=True):
                    here = at[query]
                    here = here[here >= 0]
                    here = here[np.argsort(bounds[here], kind="stable")]
                    if len(here) and bounds[here].sum() >= results.least:
                        docs, score = max_score([lists[i] for i in here.tolist()], bounds[here], len(ids), results.least, k)
                        if len(docs):
                            results.add(*top_of(score, ids[docs], k))
        for item, results in zip(items, best, strict=True):
            if len(results.score):
                n = len(results.score)
                yield pa.record_batch([pa.array([item] * n, pa.int64()), pa.array(results.ids, pa.int64(), mask=results.ids == _LAST), pa.array(results.score)], names=["item_id", "doc_id", "score"])

    found = shards.mapInArrow(run, "item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    some = found.withColumn("__s", salt).withColumn("__r", F.row_number().over(Window.partitionBy("item_id", "__s").orderBy(*order))).where(F.col("__r") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
